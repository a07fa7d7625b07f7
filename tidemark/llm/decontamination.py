"""Benchmark decontamination: a broadcast hash set of test windows, scanned over every text.

Words are maximal runs of ASCII letters, ASCII digits and non-ASCII characters after lower-casing A-Z.
A window is ``size`` consecutive words of an item; an item with fewer words, but at least one, is one
window. A rolling hash of the text's words is probed in a bitmap, then in the sorted window hashes, and
each candidate is compared word by word, so a hash collision can't make a hit.

Defined results: a null or empty text has no words and no hits; items without words and items with null
text have no windows; a null item_id hits words but is named nowhere; repeated items are each named.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.texts import cuts, hashes, rolled, small_batches

#: A-Z to a-z; every other ASCII character that is no letter or digit to a space.
TABLE = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))
SCHEMA = "n_words long, n_hit long, spans array<int>, item_ids array<string>"
CUT_SCHEMA = f"{SCHEMA}, left string"


class Windows:
    """An index of item windows: ids by hash and words, bitmaps by window length."""

    def __init__(self, items: list[tuple[str | None, list[bytes]]], size: int) -> None:
        self.at: dict[int, dict[int, list[tuple[tuple[bytes, ...], str | None]]]] = {}
        for item, tokens in items:
            n = min(size, len(tokens))
            for k, h in enumerate(rolled(hashes(tokens), n).tolist() if n else []):
                found = self.at.setdefault(n, {}).setdefault(h, [])
                if (w := (tuple(tokens[k : k + n]), item)) not in found:
                    found.append(w)
        self.maps = {}
        for n, by in self.at.items():
            bits = max(16, len(by).bit_length() + 5)
            shift = np.uint64(64 - bits)
            seen = np.zeros(1 << bits, bool)
            keys = np.sort(np.fromiter(by, np.uint64, len(by)))
            seen[keys >> shift] = True
            self.maps[n] = (shift, seen, keys)

    def hits(self, tokens: list[bytes], starts: np.ndarray, h: np.ndarray) -> Iterator[tuple[int, int, str | None]]:
        """(first word, length, item) of each occurring window; a window never reaches over two texts."""
        ends = np.append(starts[1:], len(tokens))
        for n, (shift, seen, keys) in self.maps.items():
            run = rolled(h, n)
            maybe = np.flatnonzero(seen[run >> shift])
            maybe = maybe[keys[np.minimum(np.searchsorted(keys, run[maybe]), len(keys) - 1)] == run[maybe]]
            text = np.searchsorted(starts, maybe, "right") - 1
            for k in maybe[maybe + n <= ends[text]].tolist():
                for wanted, item in self.at[n][int(run[k])]:
                    if tuple(tokens[k : k + n]) == wanted:
                        yield k, n, item


def without(text: str, edges: list[int]) -> str:
    """The text without the words of the spans and what stands between the words of one span."""
    raw = text.encode()
    at = [m.span() for m in re.finditer(rb"[^ ]+", raw.translate(TABLE))]
    keep, last = [], 0
    for a, b in zip(edges[::2], edges[1::2], strict=True):
        keep.append(raw[last : at[a][0]])
        last = at[b - 1][1]
    return b"".join([*keep, raw[last:]]).decode(errors="ignore")


def scan(texts: list[str | None], before: list, windows: Windows, cut: bool = False) -> pd.DataFrame:
    split = [(x or "").encode().translate(TABLE).split() for x in texts]
    tokens = [w for x in split for w in x]
    lengths = np.array([len(x) for x in split], np.int64)
    starts = np.cumsum(lengths) - lengths
    hit = np.zeros(len(tokens) + 1, bool)
    items: list[set[str]] = [set() for _ in texts]
    filled = np.flatnonzero(lengths)
    for k, n, item in windows.hits(tokens, starts[filled], hashes(tokens)) if len(filled) else ():
        hit[k : k + n] = True
        if item is not None:
            items[filled[np.searchsorted(starts[filled], k, "right") - 1]].add(item)
    out = []
    for i, (s, n) in enumerate(zip(starts.tolist(), lengths.tolist(), strict=True)):
        own = hit[s : s + n].copy()
        if before and before[i] is not None:
            for a, b in zip(before[i]["spans"][::2], before[i]["spans"][1::2], strict=True):
                own[a:b] = True
            items[i].update(before[i]["item_ids"])
        edges = np.flatnonzero(np.diff(np.concatenate(([0], own.view(np.int8), [0]))))
        spans = edges.tolist()
        out.append((n, int(own.sum()), spans, sorted(items[i]), *([without(texts[i], spans) if spans else None] if cut else [])))
    return pd.DataFrame(out, columns=["n_words", "n_hit", "spans", "item_ids", *(["left"] if cut else [])])


def _in_slices(values: list, known: list, windows: Windows, cut: bool) -> Iterator[pd.DataFrame]:
    if not values:
        yield scan(values, known, windows, cut)
    for a, b in cuts(values):
        yield scan(values[a:b], known[a:b], windows, cut)


def _first(shared, size: int, cut: bool):
    @F.pandas_udf(CUT_SCHEMA if cut else SCHEMA)
    def apply(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        windows = Windows(shared.value, size)
        for texts in batches:
            yield from _in_slices(texts.tolist(), [], windows, cut)

    return apply.asNondeterministic()


def _later(shared, size: int, cut: bool):
    @F.pandas_udf(CUT_SCHEMA if cut else SCHEMA)
    def apply(batches: Iterator[tuple[pd.Series, pd.DataFrame]]) -> Iterator[pd.DataFrame]:
        windows = Windows(shared.value, size)
        for texts, before in batches:
            yield from _in_slices(texts.tolist(), before.to_dict("records"), windows, cut)

    return apply.asNondeterministic()


def contamination(column: Column, benchmark: DataFrame, size: int = 10, block_words: int = 500_000, cut: bool = False) -> Column:
    """A struct (n_words, n_hit, spans, item_ids) for each text; spans are pairs of word numbers (from, until).

    With ``cut`` there is also ``left``, the text without its spans as of ``without_spans``, null where there are none: so
    one Python worker does both, and Spark, which keeps workers for later stages, keeps half as many.

    The test windows go to the executors in blocks of ``block_words`` words at most (some 60 MB with
    their index; a single longer item is a block of its own). A benchmark within one block, the usual case,
    costs one pass over the texts and no shuffle; a larger one costs a further pass per block, each adding to
    what the passes before have found, so no broadcast grows with the benchmark.
    """
    small_batches(benchmark.sparkSession)
    context = benchmark.sparkSession.sparkContext
    rows = benchmark.select(F.col("item_id").cast("string"), "text").where("text is not null")
    blocks, block, n = [], [], 0
    for item, text in rows.toLocalIterator():
        tokens = text.encode().translate(TABLE).split()
        if block and n + len(tokens) > block_words:
            blocks.append(context.broadcast(block))
            block, n = [], 0
        block.append((item, tokens))
        n += len(tokens)
    blocks.append(context.broadcast(block))
    found = None
    for shared in blocks:
        last = cut and shared is blocks[-1]
        found = _first(shared, size, last)(column) if found is None else _later(shared, size, last)(column, found)
    return found


def without_spans(column: Column, spans: Column) -> Column:
    """The text without the words of the spans and what stands between the words of one span; texts without a span stay as they are."""

    @F.pandas_udf("string")
    def cut(texts: pd.Series, spans: pd.Series) -> pd.Series:
        return pd.Series([without(t, edges) if t is not None and edges is not None and len(edges) else t for t, edges in zip(texts, spans, strict=True)], dtype=object)

    return cut(column, spans)
