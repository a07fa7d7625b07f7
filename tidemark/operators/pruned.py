"""Lexical top-k from postings in blocks, without reading those that can't matter.

Chunks are dealt out to buckets; the postings of a term in a bucket are a block, with the largest score in it. A bucket is one row of the index, so a task that has it scores its chunks where
they are and hands on only what may be among a query's best. A few postings of each query's
weightiest terms give a first threshold: the k-th best sum so far, which the k-th best score can't be below. Terms of which even all together can't lift a chunk to the threshold don't propose
chunks. The others are read; with them the threshold rises; and the remaining terms' blocks are read only in buckets that hold a chunk which the blocks' largest scores could still lift to it. So the rows are exactly those of
``retrieval.bm25``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.config import SETTINGS
from tidemark.functions.tokens import lexical_tokens, term_counts
from tidemark.operators import retrieval
from tidemark.operators.best import Best, rounded
from tidemark.operators.ranges import filed
from tidemark.operators.small import MOST

#: Scores are compared as rounded to six digits; bounds keep this much more.
SLACK = 2e-6
#: Postings of the weightiest terms from which the first threshold comes, for each hit.
SEED = 5
#: Queries, and pairs of a query and a term, that go to every task at a time.
QUERIES, TERMS = 20_000, MOST
#: Pairs of a posting and a query that are scored at once.
PAIRS = 2_000_000
#: Buckets in a file of the index at most: a reader holds so many at once.
BUCKETS = 256


def weight(tf: np.ndarray, dl: np.ndarray, avgdl: float) -> np.ndarray:
    """What a term adds to a chunk's score, for an idf of 1."""
    return tf * (SETTINGS.k1 + 1) / (tf + SETTINGS.k1 * (1 - SETTINGS.b + SETTINGS.b * dl / avgdl))


def runs(starts: np.ndarray, many: np.ndarray) -> np.ndarray:
    """The ``many`` numbers from each start on, one run after the other."""
    return (starts - np.cumsum(many) + many).repeat(many) + np.arange(many.sum())


def indexed(chunks: DataFrame, latin: bool = False, chunks_per_bucket: int = 64) -> tuple[DataFrame, int, float]:
    """The index of ``chunks`` (chunk_id, text) as of ``blocks``: the text is read once and terms are counted where the row is."""
    counted = chunks.select("chunk_id", term_counts(F.col("text"), latin).alias("c")).select("chunk_id", F.col("c.dl").alias("dl"), F.array_join("c.terms.term", " ").alias("terms"), F.col("c.terms.tf").alias("tf"))
    counted = filed(counted.withColumn("tf", F.col("tf").cast("array<int>")))
    return _dealt(counted, retrieval.totals(counted), chunks_per_bucket)


def blocks(postings: DataFrame, totals: DataFrame, chunks_per_bucket: int = 64) -> tuple[DataFrame, int, float]:
    """(blocks, n, avgdl) from ``postings`` and ``totals`` of ``retrieval``. Of blocks a bucket is a row, to be written once: its chunks and their lengths; its terms, of each the number ``n`` of its postings and
    their largest score ``best`` for an idf of 1; and the postings of one term after the other, each the ``place`` of its chunk in the bucket and its ``tf``."""
    p = F.collect_list(F.struct("term", F.col("tf").cast("int").alias("tf")))
    counted = postings.groupBy("chunk_id", "dl").agg(p.alias("p")).select("chunk_id", "dl", F.array_join("p.term", " ").alias("terms"), F.col("p.tf").alias("tf"))
    return _dealt(counted, totals, chunks_per_bucket)


def _dealt(counted: DataFrame, totals: DataFrame, chunks_per_bucket: int) -> tuple[DataFrame, int, float]:
    n, avgdl = totals.first()
    bucket = F.pmod(F.xxhash64("chunk_id"), F.lit(max(1, -(-n // chunks_per_bucket)))).cast("int")

    def gathered(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("chunk_id")
        numbers: dict[str, int] = {}
        found = [[numbers.setdefault(t, len(numbers)) for t in x.split()] for x in rows["terms"].to_pylist()]
        place = np.arange(len(found)).repeat([len(x) for x in found])
        ids, tf = np.array([i for x in found for i in x], int), np.array([i for x in rows["tf"].to_pylist() for i in x], np.int32)
        order = np.argsort(ids, kind="stable")
        place, tf, many = place[order].astype(np.int32), tf[order], np.bincount(ids, minlength=len(numbers))
        f = weight(tf, rows["dl"].to_numpy()[place], avgdl)
        best = np.maximum.reduceat(f, np.cumsum(many) - many) if len(f) else f
        columns = {"chunk_ids": (rows["chunk_id"].to_pylist(), rows.schema.field("chunk_id").type), "dl": (rows["dl"].to_pylist(), pa.int32()), "terms": (list(numbers), pa.string())}
        columns |= {"n": (many.astype(np.int32), pa.int32()), "best": (best, pa.float64()), "place": (place, pa.int32()), "tf": (tf, pa.int32())}
        return pa.table({"bucket": rows["bucket"][:1]} | {name: pa.array([x], pa.list_(kind)) for name, (x, kind) in columns.items()})

    id_type = counted.schema["chunk_id"].dataType.simpleString()
    schema = f"bucket int, chunk_ids array<{id_type}>, dl array<int>, terms array<string>, n array<int>, best array<double>, place array<int>, tf array<int>"
    dealt = counted.select(bucket.alias("bucket"), "chunk_id", "dl", "terms", "tf").groupBy("bucket").applyInArrow(gathered, schema)
    return filed(dealt, BUCKETS), n, avgdl


@dataclass
class Asked:
    """Queries of a round as every task has them: of term number i the queries ``owner[starts[i] : starts[i + 1]]``, and for each such pair whether the term is the query's seed and weak."""

    names: list
    numbers: dict[str, int]
    starts: np.ndarray
    owner: np.ndarray
    idf: np.ndarray
    seed: np.ndarray
    weak: np.ndarray
    least: np.ndarray  # of each query: the threshold so far
    more: np.ndarray  # of each query: what its weak terms can add at most

    def pairs(self, ids: np.ndarray, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place in ``ids``, query) of each chosen pair of these terms."""
        many = self.starts[ids + 1] - self.starts[ids]
        at = runs(self.starts[ids], many)
        kept = chosen[at]
        return np.arange(len(ids)).repeat(many)[kept], self.owner[at[kept]]


class Bucket:
    """A row of the index, of which only the blocks of asked terms are looked at."""

    def __init__(self, row, asked: Asked, avgdl: float) -> None:
        self.chunks, number = row.chunk_ids, asked.numbers.get
        known = [(i, k) for i, t in enumerate(row.terms) if (k := number(t)) is not None]
        at, self.ids = np.array(known, int).reshape(-1, 2).T
        ends = np.cumsum(row.n)
        self.n, self.end, self.best = row.n[at].astype(int), ends[at], row.best[at] * asked.idf[self.ids]
        self.row, self.asked, self.avgdl = row, asked, avgdl

    def scores(self, block: np.ndarray, query: np.ndarray) -> np.ndarray:
        """(chunks by queries): sums over the postings of these blocks, each for its query."""
        width = len(self.asked.names)
        total = np.zeros(len(self.chunks) * width)
        read, which = np.unique(block, return_inverse=True)
        n = self.n[read]
        at = runs(self.end[read] - n, n)
        place = self.row.place[at].astype(int)
        w = self.asked.idf[self.ids[read]].repeat(n) * weight(self.row.tf[at].astype(float), self.row.dl[place], self.avgdl)
        place, first, ends = place * width, np.cumsum(n) - n, np.cumsum(n[which])
        cut = 0
        while cut < len(block):  # as many blocks at once as have about so many postings
            upto = max(cut + 1, int(np.searchsorted(ends, (ends[cut - 1] if cut else 0) + PAIRS)))
            part = which[cut:upto]
            at = runs(first[part], n[part])
            total += np.bincount(place[at] + query[cut:upto].repeat(n[part]), w[at], len(total))
            cut = upto
        return total.reshape(len(self.chunks), width)


def search(queries: DataFrame, blocks: DataFrame, n: int, avgdl: float, k: int = SETTINGS.lexical_k, latin: bool = False) -> tuple[DataFrame, DataFrame]:
    """(query_id, chunk_id, score, rank) as of ``retrieval.bm25``, and (query_id, n_postings, n_read): of how many postings of its terms a query read how many. Queries go to every task, up to ``QUERIES`` of them in a round."""
    terms = filed(queries.select("query_id", F.explode(F.array_distinct(lexical_tokens(F.col("text"), latin))).alias("term")))
    size = terms.agg(F.count("*"), F.count_distinct("query_id")).first()
    rounds = max(1, -(-size[0] // TERMS), -(-size[1] // QUERIES))
    q_type, c_type = dict(queries.dtypes)["query_id"], dict(blocks.dtypes)["chunk_ids"][6:-1]
    parts = [_round(terms.where(F.pmod(F.xxhash64("query_id"), F.lit(rounds)) == i), blocks, n, avgdl, k, f"query_id {q_type}, chunk_id {c_type}, score double, n long", q_type) for i in range(rounds)]
    found, counts = parts[0]
    for f, c in parts[1:]:
        found, counts = found.union(f), counts.union(c)
    hits = retrieval.top(found.where("n is null").select("query_id", "chunk_id", "score"), k, F.desc("score"), F.col("chunk_id"))
    again = found.where("n is not null").groupBy("query_id").agg(F.sum("n").alias("n"))
    return hits, counts.join(again, "query_id", "left").select("query_id", "n_postings", (F.col("n_read") + F.coalesce("n", F.lit(0))).alias("n_read"))


def _round(terms: DataFrame, blocks: DataFrame, n: int, avgdl: float, k: int, schema: str, q_type: str) -> tuple[DataFrame, DataFrame]:
    """(hits and counts of postings that tasks hand on, what each query has and reads at least) of the queries of a round, which fit into a task."""
    spark = terms.sparkSession
    pairs = terms.toPandas()
    heads = blocks.select(F.inline(F.arrays_zip("terms", "n", "best"))).withColumnRenamed("terms", "term")
    heads = heads.join(F.broadcast(terms.select("term").distinct()), "term").groupBy("term").agg(F.sum("n").alias("df"), F.max("best").alias("best")).toPandas()
    heads = heads.sort_values("term", ignore_index=True)
    idf = np.log(1 + (n - heads.df.to_numpy(float) + 0.5) / (heads.df.to_numpy(float) + 0.5))
    heads["best"] *= idf
    pairs = pairs.merge(heads.assign(id=np.arange(len(heads))), "inner", "term")
    codes, names = pd.factorize(pairs.query_id)
    pairs["q"] = codes
    pairs = pairs.sort_values(["q", "best", "id"], ascending=[True, False, True])  # the weightiest first
    pairs["seed"] = pairs.groupby("q").df.cumsum() - pairs.df < SEED * k
    pairs["lightest"] = pairs[::-1].groupby("q").best.cumsum()  # of a term and all lighter ones
    pairs = pairs.sort_values(["id", "q"], ignore_index=True)
    starts = np.searchsorted(pairs.id, np.arange(len(heads) + 1))
    least, nothing = np.zeros(len(names)), np.zeros(len(pairs), bool)
    asked = Asked(names.tolist(), dict(zip(heads.term, range(len(heads)), strict=True)), starts, pairs.q.to_numpy(), idf, pairs.seed.to_numpy(bool), nothing, least, least)

    def threshold(chosen: np.ndarray) -> np.ndarray:
        """The k-th largest sum over the chosen terms of each query that has so many chunks, else 0."""
        shared = spark.sparkContext.broadcast((asked, chosen))

        def summed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            asked, chosen = shared.value
            best = Best(len(asked.names), k)
            for row in _rows(batches):
                bucket = Bucket(row, asked, avgdl)
                best.offered(bucket.scores(*asked.pairs(bucket.ids, chosen)), 0.0)
            score, q = best.scores.ravel(), np.tile(np.arange(len(asked.names)), k)
            yield pd.DataFrame({"query_id": q[score > 0], "score": score[score > 0]})

        last = retrieval.top(blocks.mapInPandas(summed, "query_id long, score double"), k, F.desc("score")).where(F.col("rank") == k)
        out = np.zeros(len(names))
        for r in last.collect() if chosen.any() else []:
            out[r.query_id] = r.score
        return out

    asked.least = threshold(asked.seed)
    asked.weak = pairs.lightest.to_numpy() < asked.least[asked.owner] - SLACK
    asked.least = threshold(~asked.weak)
    asked.more = np.bincount(asked.owner[asked.weak], pairs.best.to_numpy()[asked.weak], len(names))
    shared = spark.sparkContext.broadcast(asked)

    def ranked(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        asked = shared.value
        best, names, read = Best(len(asked.names), k), np.array(asked.names, dtype=object), np.zeros(len(asked.names), int)
        for row in _rows(batches):
            bucket = Bucket(row, asked, avgdl)
            score = bucket.scores(*asked.pairs(bucket.ids, ~asked.weak))
            could = (score > 0) & (score + asked.more >= asked.least - SLACK)
            block, query = asked.pairs(bucket.ids, asked.weak)
            bound = np.bincount(query, bucket.best[block], len(names))
            left = could & (score + bound >= asked.least - SLACK)
            needed = left.any(axis=0)[query]
            block, query = block[needed], query[needed]
            score = rounded(np.where(left, score + bucket.scores(block, query), 0.0))
            seeded = _seeded(asked, bucket.ids[block], query)
            read += np.bincount(query[~seeded], bucket.n[block[~seeded]], len(names)).astype(int)
            r, q = best.offered(score, 0.0)
            yield pd.DataFrame({"query_id": plain(names[q]), "chunk_id": plain(bucket.chunks[r]), "score": score[r, q], "n": pd.array([None] * len(r), "Int64")})
        q = np.flatnonzero(read)
        yield pd.DataFrame({"query_id": plain(names[q]), "chunk_id": plain([None] * len(q)), "score": [None] * len(q), "n": read[q]})

    opened = pairs.df.where(asked.seed | ~asked.weak, 0).groupby(pairs.q).sum()
    counts = [(q, int(a), int(b)) for q, a, b in zip(asked.names, pairs.groupby("q").df.sum(), opened, strict=True)]
    return blocks.mapInPandas(ranked, schema), spark.createDataFrame(counts, f"query_id {q_type}, n_postings long, n_read long")


def plain(values) -> pd.Series:
    """As objects: pandas' own strings are no single array when there are none."""
    return pd.Series(values, dtype=object)


def _rows(batches: Iterator[pd.DataFrame]) -> Iterator:
    for batch in batches:
        yield from batch.itertuples(index=False)


def _seeded(asked: Asked, ids: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Whether each of these terms is a seed of its query."""
    width = len(asked.names)
    keys = np.arange(len(asked.starts) - 1).repeat(np.diff(asked.starts)) * width + asked.owner  # ascending
    return asked.seed[np.searchsorted(keys, ids * width + query)]
