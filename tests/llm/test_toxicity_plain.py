"""The features of toxicity, the trees' paths, their first split and the calibration against plain loops."""

from __future__ import annotations

import random
import re

import numpy as np

from tidemark.llm import toxicity

LEXICON = {"idiot": 3.0, "hate": 1.5, "stup*": 2.0, "garba*": 1.0}
PLAIN = str.maketrans("01345789@$!|€", "oieastbgasiie")


def cleared(word):
    letters = re.sub(r"[^\w]|_", "", word.lower().translate(PLAIN))
    return re.sub(r"(.)\1{2,}", r"\1", letters)


def weight(word):
    return max([LEXICON.get(word, 0.0), *(LEXICON.get(word[:n] + "*", 0.0) for n in (4, 5, 6) if len(word) >= n)])


def plain(text):
    words = text.split()
    n = len(words)
    if not n:
        return [0.0] * 17
    rows = []
    for raw in words:
        bare = raw.lower().strip("\"'.,;:!?()[]{}<>-…*#%&$|")
        clear = cleared(bare)
        hidden = weight(clear) if not weight(bare) and clear != bare else 0.0
        insult = bare in toxicity.INSULTS or clear in toxicity.INSULTS
        odd = not bare.isalpha() and any(c.isalpha() for c in bare) and len(bare) > 2 and (re.search(r"\w[^\w\s'’-]+\w", bare) or re.search(r"[^\W\d_]\d+[^\W\d_]", bare))
        rows.append((max(weight(bare), hidden), insult, hidden > 0 or (clear != bare and clear in toxicity.INSULTS), bare in toxicity.SECOND_PERSON, len(raw) > 2 and raw.isupper(), bool(odd), bool(re.search(r"(.)\1{2,}", bare))))
    hits = [i for i, r in enumerate(rows) if r[0] or r[1]]
    near = sum(any(rows[j][3] for j in range(n) if abs(i - j) <= 5) for i in hits)
    letters = "".join(words)
    rate = lambda k: sum(r[k] for r in rows) / n
    return [len(hits) / n, sum(rows[i][0] for i in hits) / n, max([0.0, *(rows[i][0] for i in hits)]), min(len(hits), 5), rate(1), rate(2), near / n, rate(3), sum(c.isupper() for c in letters) / len(letters), rate(4), sum(bool(re.match(r"[^\w]|_", c)) for c in letters) / len(letters), letters.count("!") / n, sum(c in "0123456789" for c in letters) / len(letters), rate(5), rate(6), np.log1p(n), len(letters) / n]


def test_features_equal_a_plain_loop(monkeypatch):
    rng = random.Random(5)
    bits = "you YOUR Idiot 1d10t i.d.i.o.t stuuupid stupid! GARBAGE garbages, hate hateful it's a1b2 x_y ... É ß İ ñandú !!! 42 (du) euch word Word WORD - $$ aaa".split()
    texts = [" ".join(rng.choice(bits) for _ in range(rng.randrange(40))) + rng.choice(["", "\n", " \t "]) for _ in range(300)] + ["", " \x1c ", "x\x1cy"]
    for limit in (100_000, 7):
        monkeypatch.setattr(toxicity.Words, "LIMIT", limit)
        look = toxicity.Words(LEXICON)
        for text in texts:
            assert np.allclose(look.features(text), plain(text), rtol=1e-12), text
    assert look.features(None) == plain("")


def test_trees_equal_a_walk_and_the_first_split_is_the_best():
    rng = np.random.default_rng(3)
    x = rng.random((400, 3)).round(2)
    y = (x[:, 1] + 0.1 * rng.random(400) > 0.6).astype(float)
    trees = toxicity.boost(x, y, rounds=4, depth=2, bins=8)

    def walk(row):
        out = trees.base
        for feature, limit, leaf in zip(trees.features, trees.limits, trees.leaves, strict=True):
            node = 0
            for _ in range(2):
                node = 2 * node + 1 + int(row[feature[node]] > limit[node])
            out += leaf[node - 3]
        return out

    assert np.allclose(trees.raw(x), [walk(r) for r in x])
    p = y.mean()
    g, h = y - p, np.full(400, p * (1 - p))
    gain = lambda left: g[left].sum() ** 2 / (h[left].sum() + 2) + g[~left].sum() ** 2 / (h[~left].sum() + 2)
    options = {(j, e): gain(x[:, j] <= e) for j in range(3) for e in np.unique(np.quantile(x[:, j], np.linspace(0, 1, 9)[1:-1]))}
    assert options[trees.features[0][0], trees.limits[0][0]] >= max(options.values()) - 1e-9


def test_calibration_equals_pooling_by_hand():
    score, label = np.array([0.1, 0.2, 0.3, 0.4, 0.5, 0.5]), np.array([0, 1, 0, 0, 1, 0.0])
    knots, p = toxicity.isotonic(score, label)
    held = lambda s, n: (s + 0.02) / (n + 0.04)
    assert np.allclose(np.interp(score, knots, p), [held(0, 1), *[held(1, 3)] * 3, *[held(1, 2)] * 2])
