"""The page parser: linear on broken markup, and its sums over elements against plain loops over each line's elements."""

from __future__ import annotations

import random
import time

import numpy as np
import pytest

from tidemark.llm import html

TAGS = "div p li ul ol td tr table section article main b i a span h1 form header nav option select dt dd dl aside".split()


def chain(tree, at):
    out = []
    while at >= 0:
        out.append(at)
        at = tree.parent[at]
    return out[::-1]


def parsed(page):
    p = html.Lines()
    p.feed(page)
    p.close()
    p.flush()
    return p


def random_page(rng):
    part = lambda: rng.choice([f"<{rng.choice(TAGS)}>", f"<{rng.choice(TAGS)} class='{rng.choice(['ad', 'x', 'comments', 'nav-x'])}'>", f"</{rng.choice(TAGS)}>", "word " * rng.choice([1, 3, 30]), "<br>"])
    return "".join(part() for _ in range(rng.randrange(60)))


def plain_corrected(p):
    rows = [x for x in p.lines if not x.out]
    marked = lambda x: any(p.names[c] in html.MARKED for c in chain(p.containers, x.container))
    total, articles = sum(len(x.text) for x in rows), sum(map(marked, rows))

    def kept(k):
        own = [x for x in rows if k in chain(p.doubts, x.doubtful)]
        return len(own) > 1 and 2 * sum(len(x.text) for x in own) >= total and sum(map(marked, own)) == articles

    return [not x.out and all(kept(k) for k in chain(p.doubts, x.doubtful)[1:]) for x in p.lines]


def plain_region(p, content):
    at = 0
    while p.names[at] not in html.MARKED:
        chains = [chain(p.containers, x.container) for x, c in zip(p.lines, content, strict=True) if c]
        inner = {c[c.index(at) + 1] if c[-1] != at else None for c in chains}
        if len(inner) != 1 or None in inner:
            return at
        at = inner.pop()
    return at


def test_sums_over_elements_equal_plain_loops():
    rng = random.Random(7)
    for _ in range(400):
        p = parsed(random_page(rng))
        if not p.lines:
            continue
        assert p.corrected().tolist() == plain_corrected(p)
        content = np.array([rng.random() < 0.5 for _ in p.lines])
        if content.any():
            assert p.region(content) == plain_region(p, content)
        last = p.containers.last()
        for at in range(len(last)):
            below = p.containers.below(at)
            for n in range(len(last)):
                c = chain(p.containers, n)
                assert (at in c) == (at <= n <= last[at])
                if at in c:
                    assert below[n] == (c[c.index(at) + 1] if n != at else at)


@pytest.mark.parametrize("piece", ["<b>x ", "<div>x ", "<form>x ", "<li><p>a", "<div><a>", "<!--", "<td><aside>y ", "<p>"])
def test_broken_markup_takes_time_in_proportion(piece):
    began = time.perf_counter()
    html.extract(piece * 50_000 + "</b></p>" * 10_000)
    assert time.perf_counter() - began < 15
