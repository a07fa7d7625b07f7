"""Quality classification by an interpolated modified Kneser-Ney model of trusted text, over n-grams of characters.

All trusted texts are counted: the hash of a text deals it to one of two folds, each with a model of its own, and every text
is scored with the model of the other fold, so none with its own n-grams or those of its copies. The counts of the longest
n-grams are summed over all texts; those of shorter ones are the numbers of different n-grams that they end.

No document's n-grams travel. Documents are taken in blocks of one fold; a block asks for its distinct n-grams once each, by ranges of
their hashes; the distinct ones of all blocks are joined, in shards, to the counts of n-grams and of their contexts, order
after order. Up to ``KNOWN`` of them (48 MB) their log probabilities are broadcast; if there are more, each block gets those it asked for, in
the order of its questions, and its texts travel once, compressed. Either way each document's perplexity is summed up where its text is.
A block's questions are far fewer than its characters, and what a task holds is bounded by a block, a shard or that broadcast.
A document is rejected where its perplexity is above the quantile, for its language and kind of length (up to ``SHORT`` tokens, or more), of all trusted documents.

Characters are the tokens because word trigrams are nearly all distinct: their joins took 59 times the input of disk, those of
characters under 1.5 times, and labels are told apart no worse (README).

Defined results: null and empty texts (and those of white space only) have no perplexity and are rejected; a null language is
a language of its own ("und"); a language with under ``least`` trusted documents of a kind takes the quantile over all of the kind; without
trusted documents nothing but empty texts is rejected; a character that no trusted text has takes the unigrams' share for
unknown ones. Rows that repeat an id are judged each by itself. ``docs`` is read twice and must give the same rows in the same order, as
a table or a stored frame does.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.text import BLANKS
from tidemark.llm.blocks import answered, blocks, only, ranges, unpacked
from tidemark.llm.texts import cuts, fresh, mixed, sliced, stored, tidied, tidy

ORDER = 5
#: Private-use characters that stand for what is before a text, its end, and the null character.
BEFORE, END, NULL = 0xE001, 0xE002, 0xE000
#: Texts of up to so many tokens are held against the short trusted texts: their perplexities vary much more.
SHORT = 200
#: N-grams that are looked at together.
RUN = 300_000
#: Characters of the corpus for each shard of questions.
SHARD = 60_000_000
#: Distinct n-grams whose probabilities (twelve bytes each) are broadcast; more of them go to the blocks that asked.
KNOWN = 4_000_000
#: Ids of trusted documents are broadcast up to this number; beyond it documents are joined with a shuffle.
BROADCAST_IDS = 500_000


def symbols(text: str) -> Iterator[np.ndarray]:
    """The codes of a text's characters and its end, in pieces of ``RUN`` characters, each with the ``ORDER - 1`` codes before it."""
    for k in range(0, len(text) + 1, RUN):
        some = text[max(0, k - ORDER + 1) : k + RUN]
        codes = np.frombuffer(some.encode("utf-32-le"), np.uint32)
        first = np.full(max(0, ORDER - 1 - k), BEFORE, np.uint32)
        last = np.full(1 if k + RUN > len(text) else 0, END, np.uint32)
        codes = np.concatenate((first, codes, last))
        if len(codes) >= ORDER:
            codes[codes == 0] = NULL
            yield codes


def hashed(columns: Iterable[np.ndarray]) -> np.ndarray:
    """Hashes of n-grams, given the codes of their first, second, ... characters."""
    h: np.ndarray | np.uint64 = np.uint64(0)
    for codes in columns:
        h = h * np.uint64(0x9E3779B97F4A7C15) + codes + np.uint64(1)
    return mixed(h)


@dataclass
class Run:
    """The n-grams of some texts: the distinct hashes, an n-gram for each, which of them stands at each place, and (text, number of places) in order."""

    h: np.ndarray
    grams: np.ndarray
    of: np.ndarray
    places: list[tuple[int, int]]


def runs(texts: Iterable[str]) -> Iterator[Run]:
    """The n-grams that end in each character of each text and in its end, for ``RUN`` characters or so at a time."""
    pieces: list[np.ndarray] = []
    places: list[tuple[int, int]] = []
    size = 0

    def done() -> Run:
        codes = np.concatenate(pieces).astype(np.uint64)
        n = len(codes) - ORDER + 1
        inside = np.ones(n, bool)
        ends = np.cumsum([len(x) for x in pieces])[:-1]
        for k in range(1, ORDER):  # no n-gram reaches over two pieces
            inside[ends - k] = False
        of, h = pd.factorize(hashed(codes[k : k + n] for k in range(ORDER))[inside])
        first = np.empty(len(h), np.int64)
        first[of[::-1]] = np.flatnonzero(inside)[::-1]
        return Run(h, np.stack([codes[first + k] for k in range(ORDER)], 1).astype(np.uint32), of, list(places))

    for i, text in enumerate(texts):
        for codes in symbols(text):
            pieces.append(codes)
            places.append((i, len(codes) - ORDER + 1))
            size += len(codes)
            if size >= RUN:
                yield done()
                pieces, places, size = [], [], 0
    if pieces:
        yield done()


class Distinct:
    """The distinct n-grams of many texts, in order of their hashes, with their numbers."""

    def __init__(self) -> None:
        self.h, self.grams, self.n = np.zeros(0, np.uint64), np.zeros((0, ORDER), np.uint32), np.zeros(0, np.int64)
        self.waiting: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def add(self, h: np.ndarray, grams: np.ndarray, n: np.ndarray) -> None:
        self.waiting.append((h, grams, n))
        if sum(len(x[0]) for x in self.waiting) > 300_000:
            self.merge()

    def merge(self) -> None:
        if self.waiting:
            h, grams, n = (np.concatenate(x) for x in zip((self.h, self.grams, self.n), *self.waiting, strict=True))
            self.h, first, of = np.unique(h, return_index=True, return_inverse=True)
            self.grams, self.n = grams[first], np.bincount(of, n).astype(np.int64)
            self.waiting = []

    def strings(self) -> np.ndarray:
        return np.ascontiguousarray(self.grams).view(f"<U{ORDER}").ravel()


def counted(trusted: DataFrame) -> list[DataFrame]:
    """(f, g, c) for the n-grams of orders 1 to ``ORDER`` of all texts of ``trusted`` (f, text): how often the longest occur, and how many different n-grams the shorter ones end."""

    @tidied
    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found = {0: Distinct(), 1: Distinct()}

        def done(f: int) -> pd.DataFrame:
            found[f].merge()
            out = pd.DataFrame({"f": f, "g": found[f].strings().astype(object), "c": found[f].n})
            found[f] = Distinct()
            return out

        for part in sliced(batches):
            for f, own in found.items():
                for r in runs(part.text[part.f == f].tolist()):
                    own.add(r.h, r.grams, np.bincount(r.of, minlength=len(r.h)))
                if len(own.h) > 4_000_000:
                    yield done(f)
        for f in found:
            yield done(f)

    rows = trusted.select("f", "text").mapInPandas(count, "f int, g string, c long")
    tables = [stored(rows.groupBy("f", "g").agg(F.sum("c").alias("c")))]
    for n in range(ORDER - 1, 0, -1):
        tables.append(stored(tables[-1].groupBy("f", F.substring("g", 2, n).alias("g")).agg(F.count("*").alias("c"))))
    return tables[::-1]


def discounts(table: DataFrame) -> list[float]:
    """Modified Kneser-Ney discounts for counts of one, two and more, from the counts of counts."""
    n = [float(x or 0) for x in table.agg(*(F.sum((F.col("c") == k).cast("long")) for k in (1, 2, 3, 4))).first()]
    if not all(n[:3]):
        return [0.5, 0.75, 1.0]
    y = n[0] / (n[0] + 2 * n[1])
    return [min(max(0.05, k - (k + 1) * y * n[k] / n[k - 1]), k - 0.05) for k in (1, 2, 3)]


def probabilities(asked: DataFrame, tables: list[DataFrame]) -> DataFrame:
    """``asked`` (f, g and others; g of ``ORDER`` characters) with ``p``, the interpolated probability of g's last character after the others in fold f's model."""
    lower = None
    for n, table in enumerate(tables, 1):
        d = discounts(table)
        cut = F.when(F.col("c") == 1, d[0]).when(F.col("c") == 2, d[1]).otherwise(d[2])
        contexts = table.groupBy("f", F.substring("g", 1, n - 1).alias("x")).agg(F.sum("c").alias("total"), F.sum(cut).alias("cut"), F.count("*").alias("types"))
        own = table.select("f", F.col("g").alias("gram"), (F.col("c") - cut).alias("own"))
        last = asked.select("f", F.substring("g", ORDER - n + 1, n).alias("gram")).distinct() if n < ORDER else asked.withColumnRenamed("g", "gram")
        found = last.withColumn("x", F.substring("gram", 1, n - 1)).join(own, ["f", "gram"], "left").join(contexts, ["f", "x"], "left")
        if n == 1:  # all characters share what is left with one unknown one; without trusted text that is all there is
            shorter = F.coalesce(1 / (F.col("types") + 1), F.lit(1.0))
        else:
            found = found.withColumn("s", F.substring("gram", 2, n - 1)).join(lower.select("f", F.col("gram").alias("s"), F.col("p").alias("q")), ["f", "s"])
            shorter = F.col("q")
        p = F.coalesce("own", F.lit(0.0)) / F.coalesce("total", F.lit(1)) + F.coalesce(F.col("cut") / F.col("total"), F.lit(1.0)) * shorter
        lower = found.withColumn("p", p).drop("x", "s", "q", "own", "total", "cut", "types")
    return lower.withColumnRenamed("gram", "g")


def summed(texts: Iterable[str], n: int, known: np.ndarray, p: np.ndarray) -> np.ndarray:
    """The sum of ``p`` (of each of the sorted hashes ``known``) over the n-grams of each of ``n`` texts."""
    total = np.zeros(n)
    for r in runs(texts):
        own = p[np.searchsorted(known, r.h)].astype(float)
        of, places = np.array(r.places).T
        total += np.bincount(np.repeat(of, places), own[r.of], n)
    return total


def scorer(texts: DataFrame, tables: list[DataFrame], chars: int) -> Callable[[DataFrame, str], DataFrame]:
    """A function that adds a column with the log10 probability of each text to a frame, given that column's name; a text without a character that isn't white space has none.

    ``texts`` (h, f, text; ``chars`` characters in all): the texts that will be scored, ``f`` the fold whose model scores them.
    """
    shards = max(6, -(-chars // SHARD))
    texts = texts.withColumnRenamed("h", "id")
    spark = texts.sparkSession

    def packed(f: int, own: Distinct) -> list[tuple[int, bytes]]:
        return [(f * shards + k, zstandard.compress(np.ascontiguousarray(own.grams[a:b].T).tobytes(), 3)) for k, a, b in ranges(own.h, 64, shards)]

    @tidied
    def gather(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found, seen = [Distinct(), Distinct()], set()

        def done(f: int) -> pd.DataFrame:
            found[f].merge()
            rows, found[f] = packed(f, found[f]), Distinct()
            return pd.DataFrame(rows, columns=["shard", "grams"])

        for part in sliced(batches):
            part = part[~part.id.duplicated() & ~part.id.isin(seen)]
            seen.update(part.id.tolist())
            for f in (0, 1):
                for r in runs(part.text[part.f == f].tolist()):
                    found[f].add(r.h, r.grams, np.ones(len(r.h), np.int64))
                if len(found[f].h) > 3_000_000:
                    yield done(f)
        for f in (0, 1):
            yield done(f)

    def opened(raw: bytes) -> np.ndarray:
        return np.frombuffer(zstandard.decompress(raw), np.uint32).reshape(ORDER, -1)

    @tidied
    def once(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shard, own = None, Distinct()

        def done() -> pd.DataFrame:
            own.merge()
            return pd.DataFrame({"shard": shard, "f": shard // shards, "g": own.strings().astype(object)})

        for part in batches:
            for row in part.itertuples():
                if row.shard != shard and shard is not None:
                    yield done()
                    own = Distinct()
                shard = row.shard
                grams = opened(row.grams)
                own.add(hashed(grams), grams.T, np.ones(grams.shape[1], np.int64))
        if shard is not None:
            yield done()

    def codes_of(g: pd.Series) -> np.ndarray:
        return np.array(g.tolist(), f"<U{ORDER}").view(np.uint32).reshape(-1, ORDER).T

    gathered = texts.select("id", "f", "text").mapInPandas(gather, "shard int, grams binary")
    distinct = stored(gathered.repartition("shard").sortWithinPartitions("shard").mapInPandas(once, "shard int, f int, g string"))
    found = probabilities(distinct, tables).select("shard", "f", "g", F.log10("p").cast("float").alias("p"))
    if distinct.count() <= KNOWN:

        @tidied
        def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for part in batches:
                h = hashed(codes_of(part.g)) if len(part) else np.zeros(0, np.uint64)
                yield pd.DataFrame([(k, h[own].tobytes(), part.p[own].to_numpy(np.float32).tobytes()) for k in (0, 1) for own in [(part.f == k).to_numpy()]], columns=["f", "h", "p"])

        rows = found.mapInPandas(pack, "f int, h binary, p binary").collect()
        model = {}
        for k in (0, 1):
            h, p = (np.concatenate([np.frombuffer(r[c], kind) for r in rows if r.f == k] or [np.zeros(0, kind)]) for c, kind in (("h", np.uint64), ("p", np.float32)))
            order = np.argsort(h)
            model[k] = h[order], p[order]
        shared = spark.sparkContext.broadcast(model)

        @F.pandas_udf("double")
        def here(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
            for column, folds in batches:
                values, out = [x if isinstance(x, str) and not x.isspace() else "" for x in column.tolist()], np.full(len(column), np.nan)
                for a, b in cuts(values):
                    for k in (0, 1):
                        own = [i for i in range(a, b) if values[i] and folds.iat[i] == k]
                        if own:
                            out[own] = summed((values[i] for i in own), len(own), *shared.value[k])
                yield pd.Series(out)
            tidy()

        def add(docs: DataFrame, name: str) -> DataFrame:
            score = here.asNondeterministic()(F.col("text"), 1 - fold_of(F.col("text")))
            return docs.withColumn(name, F.nanvl(score, F.lit(None).cast("double")))

        return add

    def ask(row) -> pd.DataFrame:
        return pd.DataFrame([(k, row.block, raw) for k, raw in packed(row.f, asked_by(row))], columns=["shard", "block", "grams"])

    def answer(asked: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
        h = hashed(codes_of(known.g))
        order = np.argsort(h)
        h, p = h[order], known.p.to_numpy(np.float32)[order]
        return pd.DataFrame([(row.block, row.shard, zstandard.compress(p[np.searchsorted(h, hashed(opened(row.grams)))].tobytes(), 1)) for row in asked.itertuples()], columns=["block", "shard", "p"])

    def asked_by(row) -> Distinct:
        own = Distinct()
        for r in runs(unpacked(row)):
            own.add(r.h, r.grams, np.ones(len(r.h), np.int64))
        own.merge()
        return own

    def score(block: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        row = only(block)
        known = asked_by(row).h
        p = answered(answers, "p", np.float32, len(known))
        return pd.DataFrame({"h": np.frombuffer(row.ids, np.int64), "p": summed(unpacked(row), len(row.ids) // 8, known, p)})

    questions = blocks(texts, once=True, folds=2, each=(ask, "shard int, block string, grams binary"))
    answers = questions.groupBy("shard").cogroup(found.groupBy("shard")).applyInPandas(answer, "block string, shard int, p binary")
    scores = blocks(texts, once=True, folds=2).groupBy("block").cogroup(answers.groupBy("block")).applyInPandas(score, "h long, p double")
    scores = stored(scores.groupBy("h").agg(F.max("p").alias("p")))

    def join(docs: DataFrame, name: str) -> DataFrame:
        key = fresh("h", docs)
        return docs.withColumn(key, hash_of(F.col("text"))).join(scores.select(F.col("h").alias(key), F.col("p").alias(name)), key, "left").drop(key)

    return join


def hash_of(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text, F.lit("")))


def fold_of(text: Column) -> Column:
    return F.pmod(hash_of(text), F.lit(2)).cast("int")


def classify(docs: DataFrame, labels: DataFrame, quantile: float = 0.995, least: int = 30, output: str = "_quality") -> DataFrame:
    """``docs`` with a struct ``output`` (n_tokens: characters and the end, log10_probability, perplexity, limit, keep) in place of any column of that name.

    Trusted are documents of quality 1. All of them are counted and all of them, scored with the other fold's model, give the
    quantiles.
    """
    text = F.coalesce("text", F.lit(""))
    ids = stored(labels.where("quality = 1 and doc_id is not null").select("doc_id").distinct())
    known_ids = F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids
    rows = docs.select("doc_id", hash_of(text).alias("h"), fold_of(text).alias("f"), text.alias("text"), F.coalesce("lang", F.lit("und")).alias("lang")).where(F.col("text").rlike(f"[^{BLANKS}]"))
    chars = rows.agg(F.sum(F.char_length("text"))).first()[0] or 0
    trusted = rows.join(known_ids, "doc_id", "left_semi")
    add = scorer(rows.select("h", (1 - F.col("f")).alias("f"), "text"), counted(trusted.select("f", "text")), chars)
    per_token = lambda p, n: F.pow(F.lit(10.0), F.least(F.lit(300.0), -p / n))
    scored = add(trusted.select("lang", "text", (F.char_length("text") + 1).alias("n")), "p")
    scored = stored(scored.select("lang", (F.col("n") > SHORT).alias("long"), per_token(F.col("p"), F.col("n")).alias("perplexity")))
    at = F.percentile_approx("perplexity", quantile, 10_000)
    # as many rows as there are languages, for short and for long texts
    own = {(r.lang, r.long): r.limit for r in scored.groupBy("lang", "long").agg(F.count("*").alias("n"), at.alias("limit")).collect() if r.n >= least}
    overall = {r.long: r.limit for r in scored.groupBy("long").agg(at.alias("limit")).collect()}
    whole = scored.agg(at).first()[0]

    def limit_of(long: bool) -> Column:
        pairs = [F.lit(x) for (lang, kind), v in own.items() if kind == long for x in (lang, v)]
        table = F.create_map(*pairs) if pairs else F.create_map().cast("map<string,double>")
        return F.coalesce(F.get(F.array(table[F.coalesce(F.col("lang"), F.lit("und"))]), F.lit(0)), F.lit(overall.get(long, whole)).cast("double"), F.lit(float("inf")))

    value, size = fresh("p", docs), fresh("n", docs)
    q = add(docs.withColumn(size, F.char_length(text).cast("long") + 1), value)
    limit = F.when(F.col(size) > SHORT, limit_of(True)).otherwise(limit_of(False))
    perplexed = F.when(F.col(value).isNotNull(), per_token(F.col(value), F.col(size)))
    judged = F.struct(F.col(size).alias("n_tokens"), F.col(value).alias("log10_probability"), perplexed.alias("perplexity"), limit.alias("limit"), F.coalesce(perplexed <= limit, F.lit(False)).alias("keep"))
    return q.withColumn(output, judged).drop(value, size)
