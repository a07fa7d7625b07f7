"""Helpers that the text operators share: tokens as bytes, 64-bit hashes, batched text functions."""

from __future__ import annotations

import ctypes
import gc
import tempfile
from collections.abc import Callable, Iterator
from functools import wraps

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest

TRIM = getattr(ctypes.CDLL(None), "malloc_trim", None)
#: A row of this table is worked on together with so many others at most, so that memory is bounded by a few texts.
SLICE = 256
#: And with texts of so many characters in all, unless it is longer itself.
CHARS = 600_000


def words(text: str | None) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` after lower-casing A-Z; bytes.split() parts at exactly those six characters."""
    return (text or "").encode().lower().split()


def hashes(tokens: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxh3_64_intdigest, tokens), np.uint64, len(tokens))


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit (the finaliser of splitmix64)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def rolled(h: np.ndarray, size: int) -> np.ndarray:
    """The hash of each run of ``size`` consecutive values, in order."""
    if len(h) < size:
        return h[:0]
    total = np.zeros(len(h) - size + 1, np.uint64)
    for k in range(size):
        total = total * np.uint64(0x9E3779B97F4A7C15) + h[k : k + len(total)]
    return mixed(total)


def cuts(values: list[str | None], together: int = SLICE, chars: int = CHARS) -> Iterator[tuple[int, int]]:
    """(from, until) of runs of so many texts and characters at most; a longer text is a run of its own."""
    start = size = 0
    for k, x in enumerate(values):
        n = len(x or "")
        if k > start and (k - start == together or size + n > chars):
            yield start, k
            start, size = k, 0
        size += n
    if start < len(values):
        yield start, len(values)


#: What a batch between Spark and a Python worker holds at most: ten thousand whole texts, Spark's default, can be gigabytes.
ARROW = {"spark.sql.execution.arrow.maxRecordsPerBatch": 1000, "spark.sql.execution.arrow.maxBytesPerBatch": 8 << 20}


def tidy() -> None:
    """Gives back what a worker has freed. Spark keeps finished workers for other tasks, and beside their peaks an executor has no room."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    if TRIM is not None:
        TRIM(0)


def tidied(f: Callable) -> Callable:
    """A generator function of a Python worker that tidies up after it."""

    @wraps(f)
    def run(*args):
        try:
            yield from f(*args)
        finally:
            tidy()

    return run


def small_batches(spark: SparkSession) -> None:
    """Lowers the session's limits of batches to ``ARROW`` where they are higher or none. Batches shape memory, never results."""
    for key, most in ARROW.items():
        now = str(spark.conf.get(key))
        if not now.isdigit() or not 0 < int(now) <= most:
            spark.conf.set(key, most)


def over_texts(column: Column, start: Callable[[], Callable[[list[str | None]], pd.DataFrame]], schema: str, together: int = SLICE) -> Column:
    """A struct column computed from texts in Arrow batches.

    ``start`` runs once for each task and returns a function from a list of texts to a frame with the
    schema's columns; a task holds the results of ``together`` texts at most. The column counts as non-deterministic only so that a filter on it never makes
    Spark compute it twice.
    """

    if (spark := SparkSession.getActiveSession()) is not None:
        small_batches(spark)

    @F.pandas_udf(schema)
    def apply(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        yield from scored(batches)

    @tidied
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        score = start()
        for texts in batches:
            values = [None if x is None or x != x else x for x in texts.tolist()]
            if not values:
                yield score(values)
            for a, b in cuts(values, together):
                yield score(values[a:b])

    return apply.asNondeterministic()(column)


def arrow_over_texts(column: Column, start: Callable[[], Callable[[list[str | None]], pa.StructArray]], schema: str, together: int = SLICE) -> Column:
    """``over_texts`` for functions that give an Arrow array of structs, so that long lists of numbers never become Python objects."""

    if (spark := SparkSession.getActiveSession()) is not None:
        small_batches(spark)

    @F.arrow_udf(schema)
    def apply(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        yield from scored(batches)

    @tidied
    def scored(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        score = start()
        for texts in batches:
            values = texts.to_pylist()
            if not values:
                yield score(values)
            for a, b in cuts(values, together):
                yield score(values[a:b])

    return apply.asNondeterministic()(column)


def sliced(batches: Iterator[pd.DataFrame], chars: int = CHARS, rows: int = SLICE) -> Iterator[pd.DataFrame]:
    """The rows of the batches (text and others) in pieces of so many characters and rows at most; a longer text is a piece of its own."""
    for part in batches:
        if len(part):
            size = part.text.str.len().fillna(0).to_numpy(np.int64)
            at = np.cumsum(size) // chars + np.arange(len(part)) // rows
            yield from (piece for _, piece in part.groupby(at, sort=False))


def fold(n: int, id_column: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo n; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(id_column).cast("string"), F.lit("")).cast("binary")) % n


def stored(df: DataFrame) -> DataFrame:
    """The frame written to the checkpoint folder that all executors share; one is made only where none is set, as in tests. On a cluster one must be set."""
    small_batches(df.sparkSession)
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        folder = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if folder is None and context.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="checkpoints-"))
    return df.checkpoint()


def fresh(name: str, docs: DataFrame) -> str:
    """A column name that ``docs`` lacks."""
    while name.lower() in {c.lower() for c in docs.columns}:
        name = f"_{name}"
    return name
