"""Order across tasks: rows dealt out by ranges of a key and an order, and what one range hands on to the next.

A key that holds most of the rows fills several ranges, so no key is one task. What ranges hand on is one row for each of them.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, WindowSpec
from pyspark.sql import functions as F


def stored(df: DataFrame) -> DataFrame:
    """The frame written to the checkpoint folder that all executors share; one is made only under a local master, where none is set."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        folder = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if folder is None and context.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="checkpoints-"))
    return df.checkpoint()


def filed(df: DataFrame, rows: int = 0) -> DataFrame:
    """The same as compressed columns, of which each reader takes those that it needs: for texts that are read several times. With ``rows`` a file has so many at most."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        stored(df.sparkSession.range(1))  # sets the folder
    path = f"{context.getCheckpointDir()}/filed-{uuid.uuid4()}"
    df.write.option("compression", "zstd").option("maxRecordsPerFile", rows).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def shuffle_partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def in_ranges(rows: DataFrame, key: str, order: list, parts: int | None = None) -> DataFrame:
    """``rows`` dealt out by ``key`` (a column without nulls) and ``order``, each range sorted, and stored. Adds ``_part`` (the range's number), ``_at`` (the row's place, from
    0, among those of its key in its range) and ``_end`` (it is the last row of its range)."""
    dealt = rows.repartitionByRange(parts or shuffle_partitions(rows), key, *order).sortWithinPartitions(key, *order)

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, last, at, waiting = TaskContext.get().partitionId(), None, 0, None
        for batch in batches:
            if not len(batch):
                continue
            if waiting is not None:
                yield waiting
            v = batch[key].to_numpy()
            head = np.r_[True, v[1:] != v[:-1]]
            place = np.arange(len(v))
            place -= np.maximum.accumulate(np.where(head, place, 0))
            if last is not None and v[0] == last:
                place[: len(v) if head.sum() == 1 else int(np.flatnonzero(head)[1])] += at
            last, at = v[-1], int(place[-1]) + 1
            waiting = batch.assign(_part=part, _at=place, _end=False)
        if waiting is not None:
            waiting.iloc[-1, waiting.columns.get_loc("_end")] = True
            yield waiting

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    return stored(dealt.mapInPandas(counted, f"{schema}, _part int, _at long, _end boolean"))


def handed_on(ranged: DataFrame, key: str) -> list[tuple[int, object, int]]:
    """(range, key, rows of the key in the ranges before) for each range that begins with a key that others had before: one row a range at most."""
    out, now, before = [], None, 0
    for part, last, at in sorted(map(tuple, ranged.where("_end").select("_part", key, "_at").collect())):
        if now is not None:
            out.append((part, now, before))
        before = before + at + 1 if last == now else at + 1
        now = last
    return out


def numbered(rows: DataFrame, key: str, order: list, name: str, parts: int | None = None) -> DataFrame:
    """``rows`` with ``name``: the place of each among the rows of its key by ``order``, from 0. ``rows`` pass through Python, so give keys and not texts."""
    ranged = in_ranges(rows, key, order, parts)
    carried = handed_on(ranged, key)
    if not carried:
        return ranged.withColumn(name, F.col("_at")).select(*rows.columns, name)
    kind = rows.schema[key].dataType.simpleString()
    offsets = rows.sparkSession.createDataFrame(carried, f"_part int, {key} {kind}, _before long")  # one row a range
    return ranged.join(F.broadcast(offsets), ["_part", key], "left").withColumn(name, F.col("_at") + F.coalesce("_before", F.lit(0))).select(*rows.columns, name)


def positions(rows: DataFrame, order: list, name: str, parts: int | None = None) -> DataFrame:
    """``rows`` with ``name``: the place of each among all rows by ``order``, from 0, with no window over all of them."""
    return numbered(rows.withColumn("_all", F.lit(0)), "_all", order, name, parts).drop("_all")


def near(rows: DataFrame, key: str, order: str, by_block: int = 512) -> tuple[DataFrame, WindowSpec]:
    """``rows`` (of a unique ``order`` in each ``key``) and a window over each row's neighbours in its key, in which a key of any size is many tasks.

    Rows are numbered by key and order alone, dealt out in blocks of ``by_block`` places, and the first and the last row of a block are repeated in the block beside it. After the
    window keep the rows where ``_own`` is true, and drop ``_own``, ``_block`` and ``_place``.
    """
    places = numbered(rows.select(F.col(key).alias("_key"), F.col(order).alias("_order")), "_key", ["_order"], "_place")
    placed = rows.join(places, (rows[key] == places["_key"]) & rows[order].eqNullSafe(places["_order"])).drop("_key", "_order")
    block, at = F.floor(F.col("_place") / by_block), F.col("_place") % by_block
    blocks = F.array_compact(F.array(block, F.when(at == 0, block - 1), F.when(at == by_block - 1, block + 1)))
    dealt = placed.withColumn("_block", F.explode(blocks)).withColumn("_own", F.col("_block") == block)
    return dealt, Window.partitionBy(key, "_block").orderBy("_place")
