"""Blocks of documents that ask shards of a table about what they hold.

Documents are packed into blocks, their texts compressed. A block sends each shard, a range of numbers, its distinct ones in
order; the shard answers in the same order, so an answer needs no key; and the answers meet the block's texts again. What
travels is a block's distinct numbers and not its occurrences. A block is named by what it holds: the documents are read once to
ask and once to go on, and if they don't come in the same order both times, as a table or a stored frame does, an error tells.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame

from tidemark.llm.texts import mixed, sliced, small_batches, tidied

#: Bytes of a block's texts.
BLOCK = 14_000_000
SCHEMA = "block string, f int, texts binary, sizes binary, ids binary, known binary"


def blocks(docs: DataFrame, once: bool = False, folds: int = 1, size: int | None = None, each: tuple[Callable, str] | None = None) -> DataFrame:
    """SCHEMA rows of ``docs`` (id long, f int below ``folds``, text); a null text is empty. With ``once`` a task's rows of equal ids count as one.

    ``size``: bytes of a block's texts, unless one is longer. ``each``: a function from a block's row to a frame, and its schema; it gives the result
    instead, in the same Python worker.
    """
    limit = size or BLOCK
    small_batches(docs.sparkSession)

    @tidied
    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        task, number, seen = TaskContext.get().partitionId(), 0, set()
        waiting = {f: ([], [], []) for f in range(folds)}
        chars = dict.fromkeys(waiting, 0)
        writer = {f: zstandard.ZstdCompressor(level=3).compressobj() for f in waiting}

        def done(f: int) -> pd.DataFrame:
            nonlocal number
            raw, sizes, own = waiting[f]
            known = np.array([i is not None and i == i for i in own])
            ids = np.array([int(i) if k else 0 for i, k in zip(own, known, strict=True)], np.int64)
            size = np.array(sizes, np.int64)
            sign = np.bitwise_xor.reduce(mixed(mixed(ids.view(np.uint64) + np.arange(len(ids), dtype=np.uint64)) + size.view(np.uint64)))
            out = pd.DataFrame([(f"{task}-{number}-{sign:016x}", f, b"".join([*raw, writer[f].flush()]), size.tobytes(), ids.tobytes(), known.tobytes())], columns=["block", "f", "texts", "sizes", "ids", "known"])
            waiting[f], chars[f], writer[f] = ([], [], []), 0, zstandard.ZstdCompressor(level=3).compressobj()
            number += 1
            return out

        for part in sliced(batches):
            for i, f, text in zip(part.id.tolist(), part.f, part.text, strict=True):
                if once and i in seen:
                    continue
                if once:
                    seen.add(i)
                body = (text or "").encode()
                if chars[f] and chars[f] + len(body) > limit:
                    yield done(f)
                waiting[f][0].append(writer[f].compress(body))
                waiting[f][1].append(len(body))
                waiting[f][2].append(i)
                chars[f] += len(body)
        for f in waiting:
            if waiting[f][2]:
                yield done(f)

    rows = docs.select("id", "f", "text")
    if each is None:
        return rows.mapInPandas(pack, SCHEMA)
    f, schema = each

    @tidied
    def both(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        return (f(row) for frame in pack(batches) for row in frame.itertuples())

    return rows.mapInPandas(both, schema)


def unpacked(row) -> Iterator[str]:
    with zstandard.ZstdDecompressor().stream_reader(row.texts) as reader:
        for n in np.frombuffer(row.sizes, np.int64).tolist():
            yield reader.read(n).decode() if n else ""


def ids_of(row) -> pd.array:
    return pd.array(np.where(np.frombuffer(row.known, bool), np.frombuffer(row.ids, np.int64), None), "Int64")


def only(block: pd.DataFrame):
    """The row of the block that answers have come for."""
    if not len(block):
        raise RuntimeError("the documents came in another order; store them first")
    return next(block.itertuples())


def answered(answers: pd.DataFrame, name: str, kind: type, expected: int) -> np.ndarray:
    """All answers of a block, in the order of its numbers."""
    found = np.frombuffer(b"".join(zstandard.decompress(x) for x in answers.sort_values("shard")[name]), kind)
    if len(found) != expected:
        raise RuntimeError("the documents came in another order; store them first")
    return found


def ranges(values: np.ndarray, bits: int, shards: int) -> Iterator[tuple[int, int, int]]:
    """(shard, from, until) of sorted numbers of so many bits, by equal ranges; shards without a number are left out."""
    top = values >> np.uint64(bits - 32) if bits > 32 else values
    of = (top * np.uint64(shards)) >> np.uint64(32)
    at = np.searchsorted(of, np.arange(shards + 1, dtype=np.uint64))
    for k, (a, b) in enumerate(zip(at[:-1].tolist(), at[1:].tolist(), strict=True)):
        if a < b:
            yield k, a, b
