"""LM scoring by a hierarchical Pitman-Yor model whose seating is sampled by Gibbs sweeps.

One restaurant per class of the previous word (``CONTEXTS`` hash classes; frequent words mostly have one for
themselves) serves words to the customers that the training text counts for it; every restaurant's tables are customers of
the one parent they share. The parent's base is uniform over the known words but for a share of unknown ones, which is as large as the
share of the parent's tables that were a new word's first. That share is dealt to classes of spelling: by the mean
probability of a word's bytes, each after the one before, under counts of all training text, in proportion to the words that stand there
once. So a plausible new word costs little more than its class, and a string of random letters much more; the probabilities of all known words and
classes sum to one.

A sweep takes a word's customers and tables out of a restaurant and seats the customers again one after another by the Chinese-restaurant rule, given
the other restaurants of the sweep before. Sweeps are burnt in until the number of all tables changes by under ``SETTLED`` (``burn_in`` sweeps at
most); predictive probabilities are averaged over the ``samples`` sweeps after that.

A word with all its restaurants belongs to one shard, so that the parent's seating of a word needs no exchange; between
sweeps only the totals of each restaurant and of the parent are exchanged. They are summed on the executors, and the driver gets one sum (a
fixed number of values, whatever the corpus). Counts
cover all training text: blocks of documents send each shard their counts, summed up within the block, and a shard merges
them as they come. For scoring, blocks send their occurrences to the shards, whose models are repeated for shards
with more occurrences than ``SHARD``, and sums for each document return to its block.

Defined results: words are ``[^\\x20\\x09-\\x0D]+`` after lower-casing A-Z, then one end; null and empty texts are the end
alone; without training text every token is unknown with the base's probability of its class; rows that repeat an id are scored
each by itself.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.texts import hashes, mixed, stored, tidied

CONTEXTS = 1 << 16
#: Occurrences that a shard is meant for, and tokens that a block is cut at.
SHARD = 6_000_000
BLOCK = 1_500_000
BLOCK_DOCS = 60_000
#: Classes of spelling, and their width in decimal logarithms of a byte's mean probability.
SPELLINGS, WIDTH = 32, 0.1
SETTLED = 0.01
PARTS = 16
START = np.uint64(0x5354415254)
END = np.uint64(0x454E44)


def context_of(previous: np.ndarray) -> np.ndarray:
    return (mixed(previous + np.uint64(7)) >> np.uint64(48)).astype(np.uint16)


#: Bytes as the spelling model sees them: white space is one byte.
FOLDED = bytes(32 if b in b" \t\n\v\f\r" else b for b in range(256))


def pairs_of(raw: bytes) -> np.ndarray:
    """For each byte of a lower-cased text and the space after it, its number with the one before (a space at first)."""
    codes = np.frombuffer(b" " + raw.translate(FOLDED) + b" ", np.uint8).astype(np.int32)
    return codes[:-1] * 256 + codes[1:]


def spellings(raw: bytes, table: np.ndarray) -> np.ndarray:
    """The class of each word of a lower-cased text, with the space after it, and of the text's end."""
    pairs = pairs_of(raw)
    space = (pairs & 255) == 32
    word = np.flatnonzero(~space & (pairs >> 8 == 32)), np.flatnonzero(space & (pairs >> 8 != 32))
    total = np.concatenate(([0.0], np.cumsum(table[pairs])))
    mean = (total[word[1] + 1] - total[word[0]]) / (word[1] + 1 - word[0])
    return np.append(np.clip(-mean / WIDTH, 0, SPELLINGS - 1).astype(np.uint8), np.uint8(0))


def summed(rows: DataFrame) -> np.ndarray:
    """The sum of vectors that ``rows`` (part, x) have in ``PARTS`` equal parts, added on the executors."""

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for part, x in zip(batch.part, batch.x, strict=True):
                sums[part] = sums.get(part, 0.0) + np.frombuffer(x)
        if sums:
            yield pd.DataFrame({"part": list(sums), "x": [x.tobytes() for x in sums.values()]})

    found = {r.part: np.frombuffer(r.x) for r in rows.repartition("part").mapInPandas(add, "part int, x binary").collect()}
    return np.concatenate([found[k] for k in sorted(found)]) if found else np.zeros(0)


def in_parts(x: np.ndarray) -> pd.DataFrame:
    x = np.concatenate((x, np.zeros(-len(x) % PARTS)))
    return pd.DataFrame({"part": np.arange(PARTS), "x": [y.tobytes() for y in x.reshape(PARTS, -1)]})


def spelling(docs: DataFrame) -> np.ndarray:
    """Decimal logarithms of the probability of each byte after each byte, over all training rows of ``docs``: a table of fixed size."""

    @tidied
    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(1 << 16)
        for part in batches:
            for text in part.text:
                raw = (text or "").encode().lower()
                for k in range(0, len(raw), 1 << 22):
                    total += np.bincount(pairs_of(raw[k : k + (1 << 22)]), minlength=1 << 16)
        yield in_parts(total)

    n = summed(docs.where("not held_out").select("text").mapInPandas(count, "part int, x binary"))
    n = (n if len(n) else np.zeros(1 << 16)).reshape(256, 256) + 0.1
    return np.log10(n / n.sum(1, keepdims=True)).ravel()


def blocks(batches: Iterator[pd.DataFrame], table: np.ndarray) -> Iterator[tuple[list, list, list[int], np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(ids, flags, lengths, words, contexts, document numbers, spelling classes) for blocks of documents."""
    ids, flags, tokens, lengths, classes = [], [], [], [], []

    def cut():
        w = np.concatenate(tokens)
        n = np.array(lengths)
        first = np.cumsum(n) - n
        previous = np.concatenate(([START], w[:-1]))
        previous[first] = START
        return list(ids), list(flags), list(lengths), w, context_of(previous), np.repeat(np.arange(len(n)), n).astype(np.uint16), np.concatenate(classes)

    size = 0
    for part in batches:
        for i, flag, text in zip(part.doc_id, part.held_out, part.text, strict=True):
            raw = (text or "").encode().lower()
            h = np.append(hashes(raw.split()), END)
            ids.append(i), flags.append(flag), tokens.append(h), lengths.append(len(h)), classes.append(spellings(raw, table))
            size += len(h)
            if size >= BLOCK or len(ids) == BLOCK_DOCS:
                yield cut()
                ids, flags, tokens, lengths, classes, size = [], [], [], [], [], 0
    if ids:
        yield cut()


def sent(w: np.ndarray, k: np.ndarray, shards: int) -> Iterator[tuple[int, np.ndarray]]:
    """(shard, places of its tokens in order of word and context)"""
    shard = (mixed(w + np.uint64(3)) % np.uint64(shards)).astype(np.int64)
    order = np.lexsort((k, w, shard))
    edges = np.searchsorted(shard[order], np.arange(shards + 1))
    for s in range(shards):
        if edges[s] < edges[s + 1]:
            yield s, order[edges[s] : edges[s + 1]]


def runs(x: np.ndarray) -> np.ndarray:
    """Where each run of equal values starts."""
    return np.flatnonzero(np.concatenate(([True], x[1:] != x[:-1]))) if len(x) else np.zeros(0, np.int64)


@dataclass
class Counts:
    """A shard's training counts: words, how many restaurants each has, and the restaurants and customers of each."""

    words: np.ndarray
    spelled: np.ndarray  # class of each word
    width: np.ndarray
    contexts: np.ndarray
    customers: np.ndarray

    @classmethod
    def of(cls, row) -> Counts:
        return cls(np.frombuffer(row.w, np.uint64), np.frombuffer(row.s, np.uint8), np.frombuffer(row.width, np.uint32).astype(np.int64), np.frombuffer(row.k, np.uint16), np.frombuffer(row.c, np.uint32 if row.narrow else np.uint64).astype(np.int64))

    @classmethod
    def merged(cls, parts: list[Counts]) -> Counts:
        w = np.concatenate([np.repeat(p.words, p.width) for p in parts])
        s = np.concatenate([np.repeat(p.spelled, p.width) for p in parts])
        k = np.concatenate([p.contexts for p in parts])
        c = np.concatenate([p.customers for p in parts])
        order = np.lexsort((k, w))
        w, s, k, c = w[order], s[order], k[order], c[order]
        new = np.flatnonzero(np.concatenate(([True], (w[1:] != w[:-1]) | (k[1:] != k[:-1]))))
        w, s, k, c = w[new], s[new], k[new], np.add.reduceat(c, new)
        first = runs(w)
        return cls(w[first], s[first], np.diff(np.append(first, len(w))).astype(np.uint32), k, c)

    def row(self) -> dict:
        narrow = bool((self.customers < 2**32).all())
        return {"w": self.words.tobytes(), "s": self.spelled.tobytes(), "width": self.width.astype(np.uint32).tobytes(), "k": self.contexts.astype(np.uint16).tobytes(), "c": self.customers.astype(np.uint32 if narrow else np.uint64).tobytes(), "narrow": narrow}


COUNTS = "shard int, w binary, s binary, width binary, k binary, c binary, narrow boolean"


def counted(docs: DataFrame, shards: int, table) -> DataFrame:
    """The shards' counts over the training rows of ``docs`` (doc_id, text, held_out)."""

    @tidied
    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for _, _, _, w, k, _, spelled in blocks(batches, table.value):
            rows = []
            for s, at in sent(w, k, shards):
                ww, kk = w[at], k[at]
                new = np.flatnonzero(np.concatenate(([True], (ww[1:] != ww[:-1]) | (kk[1:] != kk[:-1]))))
                first = runs(ww[new])
                own = Counts(ww[new][first], spelled[at][new][first], np.diff(np.append(first, len(new))), kk[new], np.diff(np.append(new, len(ww))))
                rows.append({"shard": s} | own.row())
            yield pd.DataFrame(rows)

    @tidied
    def merge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shard, held, waiting = None, [], 0
        for part in batches:
            for row in part.itertuples():
                if row.shard != shard:
                    if held:
                        yield pd.DataFrame([{"shard": shard} | Counts.merged(held).row()])
                    shard, held, waiting = row.shard, [], 0
                held.append(Counts.of(row))
                waiting += len(held[-1].contexts)
                if waiting > 3_000_000:
                    held = [Counts.merged(held)]
                    waiting = 0
        if held:
            yield pd.DataFrame([{"shard": shard} | Counts.merged(held).row()])

    sums = docs.where("not held_out").mapInPandas(count, COUNTS)
    return stored(sums.repartitionById(shards, F.col("shard")).sortWithinPartitions("shard").mapInPandas(merge, COUNTS))


def seated(customers: np.ndarray, fresh: np.ndarray, discount: float, rng: np.random.Generator) -> np.ndarray:
    """Tables after seating so many customers of one dish, where ``fresh`` is the weight of a new table.

    The nth customer opens a table with probability fresh / (n - 1 - discount * tables + fresh). Up to 64 customers are
    seated one by one, further ones in blocks that grow by an eighth, each with a Poisson number of new tables.
    """
    tables = np.ones(len(customers))
    live = np.flatnonzero(customers > 1)
    n = 1
    while len(live):
        step = 1 if n < 64 else n // 8
        step_of = np.minimum(step, customers[live] - n)
        p = fresh[live] / (n + (step_of - 1) / 2 - discount * tables[live] + fresh[live])
        if step == 1:
            tables[live] += rng.random(len(live)) < p
        else:
            tables[live] += np.minimum(rng.poisson(p * step_of), step_of)
        n += step
        live = live[customers[live] > n]
    return tables


@dataclass
class Sweep:
    """Totals after a sweep (the first: before any) that all shards know: tables of each restaurant, customers and tables of the parent."""

    tables: np.ndarray
    customers: float
    parent_tables: float


@dataclass
class Model:
    tokens: int
    types: int
    context_customers: np.ndarray
    sweeps: list[Sweep]
    burn_in: int
    discount: float
    strength: float
    parent_discount: float
    parent_strength: float
    spelled: np.ndarray  # the share of unknown words that each class of spelling has

    def novel(self, sweep: Sweep) -> float:
        """The base's share of unknown words: that of the parent's tables which were a word's first."""
        return min(0.99, self.types / sweep.parent_tables) if self.types else 1.0

    def base(self, sweep: Sweep) -> float:
        return (1 - self.novel(sweep)) / self.types if self.types else 0.0

    def parent(self, sweep: Sweep, customers: np.ndarray | float, tables: np.ndarray | float, without: np.ndarray | float = 0.0):
        """The parent's probability of a known word with so many customers and tables, ``without`` some that are taken out."""
        free = self.parent_strength + self.parent_discount * sweep.parent_tables
        left = customers - without
        own = np.maximum(0.0, left - self.parent_discount * np.minimum(tables, left))
        return (own + free * self.base(sweep)) / (self.parent_strength + sweep.customers - without)

    def unknown(self, sweep: Sweep) -> float:
        """The parent's probability of all unknown words together."""
        return (self.parent_strength + self.parent_discount * sweep.parent_tables) * self.novel(sweep) / (self.parent_strength + sweep.customers)

    def chain(self, shard: int, own: Counts, sweeps: int) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray, np.ndarray]]]:
        """(pairs of more than one customer, and after each of the first sweeps: their tables, the parent's customers and its tables); the same for the same shard at any time.

        A pair of one customer has one table whatever is drawn, so only the others, some eighth of all, are seated.
        """
        live = np.flatnonzero(own.customers > 1)
        of = np.repeat(np.arange(len(own.words)), own.width)[live]
        customers, contexts = own.customers[live], own.contexts[live]
        alone = own.width - np.bincount(of, minlength=len(own.words))
        tables, m, s = np.ones(len(live)), own.width.astype(float), np.ones(len(own.words))
        out = []
        for r in range(sweeps):
            rng = np.random.default_rng([shard, r, 20240229])
            before = self.sweeps[r]
            # a dish's own tables are taken out of its restaurant and of the parent before its customers are seated again
            weight = (self.strength + self.discount * (before.tables[contexts] - tables)) * self.parent(before, m[of], s[of], tables)
            tables = seated(customers, weight, self.discount, rng)
            m = alone + np.bincount(of, tables, len(own.words))
            fresh = (self.parent_strength + self.parent_discount * (before.parent_tables - s)) * self.base(before)
            s = seated(m.astype(np.int64), fresh, self.parent_discount, rng)
            out.append((tables, m, s))
        return live, out


def trained(counts: DataFrame, burn_in: int = 4, samples: int = 3, strength: float = 1.0, parent_strength: float = 10.0) -> Model:
    """Sweeps over the shards' counts; discounts come from the numbers of once and twice seen pairs and words."""
    spark = counts.sparkSession

    def totals(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(2 * CONTEXTS + 6 + 2 * SPELLINGS)
        for part in batches:
            for row in part.itertuples():
                own = Counts.of(row)
                n = np.add.reduceat(own.customers, np.cumsum(own.width) - own.width) if len(own.words) else np.zeros(0)
                few = [(x == v).sum() for x in (own.customers, own.width) for v in (1, 2)]
                spelled = [np.bincount(x, minlength=SPELLINGS) for x in (own.spelled[n == 1], own.spelled)]
                total += np.concatenate((np.bincount(own.contexts, own.customers, CONTEXTS), np.bincount(own.contexts, minlength=CONTEXTS), [own.customers.sum(), len(own.words)], few, *spelled))
        yield in_parts(total)

    x = summed(counts.mapInPandas(totals, "part int, x binary"))
    c, t, rest = (x[:CONTEXTS], x[CONTEXTS : 2 * CONTEXTS], x[2 * CONTEXTS :]) if len(x) else (np.zeros(CONTEXTS), np.zeros(CONTEXTS), np.zeros(6 + 2 * SPELLINGS))
    n, v, seen, once, types = int(rest[0]), int(rest[1]), rest[2:6], rest[6 : 6 + SPELLINGS], rest[6 + SPELLINGS : 6 + 2 * SPELLINGS]
    like = (once if once.sum() else types) + 0.1
    discounts = [float(np.clip(a / max(1.0, a + 2 * b), 0.1, 0.95)) for a, b in ((seen[0], seen[1]), (seen[2], seen[3]))]
    model = Model(n, v, c, [Sweep(t, float(t.sum()), float(v))], 0, discounts[0], strength, discounts[1], parent_strength, like / like.sum())
    while len(model.sweeps) <= model.burn_in + samples:
        shared = spark.sparkContext.broadcast(model)

        @tidied
        def sweep(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            total = np.zeros(CONTEXTS + 1)
            for part in batches:
                for row in part.itertuples():
                    own = Counts.of(row)
                    live, chain = shared.value.chain(row.shard, own, len(shared.value.sweeps))
                    tables, _, s = chain[-1]
                    total += np.append(np.bincount(own.contexts, minlength=CONTEXTS) + np.bincount(own.contexts[live], tables - 1, CONTEXTS), s.sum())
            yield in_parts(total)

        x = summed(counts.mapInPandas(sweep, "part int, x binary"))
        t, s = (x[:CONTEXTS], float(x[CONTEXTS])) if len(x) else (np.zeros(CONTEXTS), 0.0)
        before = model.sweeps[-1].customers
        model.sweeps.append(Sweep(t, float(t.sum()), s))
        done = len(model.sweeps) - 1
        if model.burn_in == done - 1 and done <= burn_in and abs(t.sum() - before) > SETTLED * before:
            model.burn_in = done
        shared.unpersist()
    return model


class Scorer:
    """A shard's averaged predictive probabilities."""

    def __init__(self, model: Model, shard: int, own: Counts) -> None:
        self.model, self.own = model, own
        live, chain = model.chain(shard, own, len(model.sweeps) - 1)
        chain = chain[model.burn_in :]
        sweeps = model.sweeps[model.burn_in + 1 :]  # the totals after each of those seatings
        self.first = np.cumsum(own.width) - own.width
        of = np.repeat(np.arange(len(own.words)), own.width)
        size = model.strength + model.context_customers
        # averages over sweeps: of what a seen pair has by itself, and of a restaurant's share for its parent times the parent's probability
        tables = np.ones(len(of))
        tables[live] = sum(t for t, _, _ in chain) / max(1, len(chain)) if len(chain) else 1.0
        self.seen = (own.customers - model.discount * tables) / size[own.contexts]
        self.share = [(model.strength + model.discount * w.tables) / size for w in sweeps]
        self.parents = [model.parent(w, m, s) for w, (_, m, s) in zip(sweeps, chain, strict=True)]
        self.unknown = [float(model.unknown(w)) for w in sweeps]
        self.count = np.add.reduceat(own.customers, self.first) if len(of) else np.zeros(0, np.int64)
        self.key = of.astype(np.uint64) * np.uint64(CONTEXTS) + own.contexts

    def score(self, w: np.ndarray, width: np.ndarray, k: np.ndarray, spelled: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(probability, count of the word) of each occurrence; ``spelled``: the class of each word"""
        like = np.repeat(self.model.spelled[spelled], width)
        if not len(self.own.words):
            return like * sum(share[k] * p for share, p in zip(self.share, self.unknown, strict=True)) / len(self.share), np.zeros(len(k), np.int64)
        at = np.minimum(np.searchsorted(self.own.words, w), len(self.own.words) - 1)
        known = np.repeat(self.own.words[at] == w, width)
        of = np.repeat(at, width)
        p = sum(share[k] * np.where(known, parent[of], u * like) for share, parent, u in zip(self.share, self.parents, self.unknown, strict=True)) / len(self.share)
        key = of.astype(np.uint64) * np.uint64(CONTEXTS) + k
        pair = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
        p += np.where(known & (self.key[pair] == key), self.seen[pair], 0.0)
        return p, np.where(known, self.count[of], 0)


SENT = "shard int, salt int, kind int, block string, w binary, s binary, width binary, k binary, doc binary, c binary, narrow boolean"
SUMS = "block string, kind int, doc binary, score binary, base binary, known binary, ids array<long>, held array<boolean>, sizes array<long>"
SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def scored(docs: DataFrame, counts: DataFrame, model: Model, shards: int, table) -> DataFrame:
    """SCORES for each row of ``docs`` (doc_id, text, held_out)."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)
    sizes = docs.select(F.sum(F.length("text"))).first()[0] or 0
    # how often a shard's model is repeated: its share of the training tokens tells its share of all occurrences
    load = {r.shard: r.n for r in counts.mapInPandas(_loads, "shard int, n long").collect()}
    whole = sum(load.values()) or 1
    repeats = [max(1, -(-int(load.get(s, 0) / whole * sizes / 6) // (2 * SHARD))) for s in range(shards)]
    copies = spark.sparkContext.broadcast(repeats)

    @tidied
    def send(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part = TaskContext.get().partitionId()
        for number, (ids, flags, lengths, w, k, doc, spelled) in enumerate(blocks(batches, table.value)):
            name = f"{part}-{number}"
            rows = [{"shard": -1 - (number + part) % shards, "salt": 0, "kind": 2, "block": name, "w": np.array([-1 if i is None or i != i else i for i in ids], np.int64).tobytes(), "width": np.array([i is None or i != i for i in ids], np.uint8).tobytes(), "k": np.array(flags, np.uint8).tobytes(), "doc": np.array(lengths, np.int64).tobytes()}]
            for s, at in sent(w, k, shards):
                ww = w[at]
                first = runs(ww)
                rows.append({"shard": s, "salt": (number + part) % copies.value[s], "kind": 1, "block": name, "w": ww[first].tobytes(), "s": spelled[at][first].tobytes(), "width": np.diff(np.append(first, len(ww))).astype(np.uint32).tobytes(), "k": k[at].tobytes(), "doc": doc[at].tobytes()})
            yield pd.DataFrame(rows, columns=["shard", "salt", "kind", "block", "w", "s", "width", "k", "doc", "c", "narrow"])

    # a partition for each copy of a model, counted on from the shard's first; ids and flags of blocks go to any
    first = np.cumsum(repeats) - repeats
    place = F.when(F.col("shard") < 0, F.pmod(F.xxhash64("block"), F.lit(int(sum(repeats))))).otherwise(F.get(F.array(*(F.lit(int(x)) for x in first)), F.col("shard")) + F.col("salt")).cast("int")
    copied = spark.createDataFrame([(s, r) for s, n in enumerate(repeats) for r in range(n)], "shard int, salt int")
    models = copied.join(counts, "shard", "left").select("shard", "salt", F.lit(0).alias("kind"), F.lit("").alias("block"), "w", "s", "width", "k", F.lit(None).cast("binary").alias("doc"), "c", "narrow")
    rows = docs.mapInPandas(send, SENT).union(models).repartitionById(int(sum(repeats)), place).sortWithinPartitions("shard", "salt", "kind")

    @tidied
    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorer = None
        for part in batches:
            out = []
            for row in part.itertuples():
                if row.kind == 2:
                    null = np.frombuffer(row.width, np.uint8)
                    ids = [None if z else int(i) for i, z in zip(np.frombuffer(row.w, np.int64), null, strict=True)]
                    out.append((row.block, 2, None, None, None, None, ids, np.frombuffer(row.k, np.uint8).astype(bool).tolist(), np.frombuffer(row.doc, np.int64).tolist()))
                elif row.kind == 0:
                    own = Counts.of(row) if row.w is not None else Counts(np.zeros(0, np.uint64), np.zeros(0, np.uint8), np.zeros(0, np.uint32), np.zeros(0, np.uint16), np.zeros(0, np.int64))
                    scorer = Scorer(shared.value, row.shard, own)
                else:
                    p, c = scorer.score(np.frombuffer(row.w, np.uint64), np.frombuffer(row.width, np.uint32), np.frombuffer(row.k, np.uint16), np.frombuffer(row.s, np.uint8))
                    doc = np.frombuffer(row.doc, np.uint16)
                    there = np.flatnonzero(np.bincount(doc))
                    out.append((row.block, 1, there.astype(np.uint16).tobytes(), np.bincount(doc, np.log10(p))[there].astype(np.float32).tobytes(), np.bincount(doc, np.log10(c + 1.0))[there].tobytes(), np.bincount(doc, c > 0)[there].astype(np.uint32).tobytes(), None, None, None))
            if out:
                yield pd.DataFrame(out, columns=["block", "kind", "doc", "score", "base", "known", "ids", "held", "sizes"])

    sums = rows.mapInPandas(score, SUMS)

    @tidied
    def finish(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = shared.value
        per_token = np.log10(m.tokens + m.types + 1.0)
        own: list = []
        sum_of = np.zeros((3, BLOCK_DOCS))

        def done() -> pd.DataFrame:
            ids, held, lengths = own
            n = np.array(lengths)
            k = len(n)
            out = pd.DataFrame({"doc_id": pd.array(ids, "Int64"), "held_out": held, "n_tokens": n, "n_known": sum_of[2, :k].astype(np.int64), "train_tokens": m.tokens, "base_score": sum_of[1, :k] - n * per_token, "score": sum_of[0, :k]})
            sum_of[:] = 0
            own.clear()
            return out

        block = None
        for part in batches:
            for row in part.itertuples():
                if row.block != block and own:
                    yield done()
                block = row.block
                if row.kind == 2:
                    own[:] = [list(row.ids), list(row.held), list(row.sizes)]
                    continue
                at = np.frombuffer(row.doc, np.uint16)
                sum_of[0, at] += np.frombuffer(row.score, np.float32)
                sum_of[1, at] += np.frombuffer(row.base, np.float64)
                sum_of[2, at] += np.frombuffer(row.known, np.uint32)
        if own:
            yield done()

    return sums.repartition("block").sortWithinPartitions("block", "kind").mapInPandas(finish, SCORES)


def _loads(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for part in batches:
        yield pd.DataFrame([(row.shard, int(Counts.of(row).customers.sum())) for row in part.itertuples()], columns=["shard", "n"])


def language_model(docs: DataFrame, least_shards: int = 12) -> DataFrame:
    """Train on the rows of ``docs`` (doc_id, text, held_out) that are not held out and score all of them."""
    docs = docs.select("doc_id", "text", F.coalesce("held_out", F.lit(False)).alias("held_out"))
    size = docs.select(F.sum(F.length("text"))).first()[0] or 0
    shards = max(least_shards, -(-size // (6 * SHARD)))
    table = docs.sparkSession.sparkContext.broadcast(spelling(docs))
    counts = counted(docs, shards, table)
    return scored(docs, counts, trained(counts), shards, table)
