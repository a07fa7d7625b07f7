"""N-gram Jaccard join by grouped prefixes.

A document's set holds its distinct word shingles. In one order of all shingles, two sets of Jaccard similarity t or more
share a shingle among the first n - ceil(t n) + 1 of each: its prefix. The order puts rare shingles first, by how many documents
have a shingle of the same 32-bit slot: blocks of documents ask the shards of this table of counters for their distinct slots.
What slots shared by chance get wrong changes candidates, never links.

1. Documents with equal sets are one class; classes with equal prefix and size are one group.
2. Groups are listed under each shingle of their prefix and their size band (pairs of similar size share a list), classes of
   one group under the group. In each list the class of the commonest shingles is the hub, and each class is paired with it.
3. Pairs are verified on the whole sets of 64-bit hashes; verified links are closed to components.
4. Pairs that share a list, neither of them the hub, are searched by their differences from it. Let D be what a set has
   and the hub lacks or the other way round. Of a linked pair of which one isn't linked to the hub, the two D
   share half of what |D1| + |D2| exceeds (1 - t) / (1 + t) * (n1 + n2), which is above 0, so they meet in a
   prefix of each D (shingles that the hub lacks first): under half of D, but longer for one that isn't linked to the hub
   beside one that is. Pairs that meet so and pass the place and size filters are verified too; a text that all members of a
   list share makes none. Should they be many more than the members, the prefixes make lists of their own, and step 2 is
   repeated with them, up to ``LEVELS`` times. Nothing is capped.

Defined results: without words, or with null text, a set is empty and linked with nothing; with fewer words than a
shingle the whole sequence is the one element; a null id is its own component; rows that repeat an id are each reported. ``docs`` is
read more than once and must give the same rows in the same order, as a table or a stored frame does.
Shingles are compared by 64-bit hashes, so two different ones count as equal once in 10**19 comparisons.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest, xxh3_128_digest

from tidemark.llm.blocks import answered, blocks, ids_of, only, ranges, unpacked
from tidemark.llm.components import components
from tidemark.llm.texts import hashes, rolled, sliced, stored, tidied, tidy, words

#: Characters of the corpus for each shard of counters.
SHARD = 10_000_000
#: Bytes of the texts of a block, whose sets a task holds together.
BLOCK = 6_000_000
#: Rows to look up are broadcast up to this number (some tens of MB), and joined with a shuffle beyond.
BROADCAST_ROWS = 500_000
#: Pairs that one set is held for in a task.
STAR = 500
LEVELS = 4


def shingles(text: str | None, size: int) -> np.ndarray:
    """Sorted distinct hashes of a text's shingles."""
    h = hashes(words(text))
    if not len(h):
        return h
    if len(h) < size:
        return rolled(h, len(h)) + np.uint64(len(h))
    return np.unique(rolled(h, size))


def slots(h: np.ndarray) -> np.ndarray:
    """The counters of sorted hashes, sorted too."""
    return h >> np.uint64(32)


def described(docs: DataFrame, size: int, percent: int, chars: int) -> DataFrame:
    """doc_id, n (set size), sig (of the set), gid (of prefix and size), common (how common its shingles are), prefix (hashes in order)."""
    shards = max(6, -(-chars // SHARD))
    rows = docs.select(F.col("doc_id").alias("id"), F.lit(0).alias("f"), "text")

    def sets(row) -> Iterator[np.ndarray]:
        return (shingles(text, size) for text in unpacked(row))

    def ask(row) -> pd.DataFrame:
        at, n = np.unique(slots(np.concatenate(list(sets(row)))), return_counts=True)
        # steps between slots are small numbers; as columns of bytes most are zeros
        out = []
        for k, a, b in ranges(at, 32, shards):
            steps = np.diff(at[a:b], prepend=np.uint64(0)).astype("<u4").view(np.uint8).reshape(-1, 4)
            out.append((k, row.block, zstandard.compress(steps.T.tobytes(), 1), zstandard.compress(n[a:b].astype("<u4").tobytes(), 1)))
        return pd.DataFrame(out, columns=["shard", "block", "slots", "n"])

    def answer(asked: pd.DataFrame) -> pd.DataFrame:
        rows = [np.cumsum(np.ascontiguousarray(np.frombuffer(zstandard.decompress(x), np.uint8).reshape(4, -1).T).view("<u4").ravel(), dtype=np.uint64) for x in asked.slots]
        known, of = np.unique(np.concatenate(rows), return_inverse=True)
        total = np.bincount(of, np.concatenate([np.frombuffer(zstandard.decompress(x), "<u4") for x in asked.n]), len(known))
        often = np.minimum(255, np.floor(4 * np.log2(total))).astype(np.uint8)[of]
        parts = np.split(often, np.cumsum([len(x) for x in rows])[:-1])
        out = pd.DataFrame({"block": asked.block, "shard": asked.shard, "often": [zstandard.compress(x.tobytes(), 1) for x in parts]})
        del rows, known, of, total, often, parts
        tidy()
        return out

    def describe(block: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        row, rows = only(block), []
        own_sets = list(sets(row))
        known = np.unique(slots(np.concatenate(own_sets)))
        counted = answered(answers, "often", np.uint8, len(known))
        for own in own_sets:
            n = len(own)
            length = n - -(-percent * n // 100) + 1 if n else 0
            often = counted[np.searchsorted(known, slots(own))]
            prefix = own[np.argsort(often, kind="stable")[:length]]
            sig = xxh3_128_digest(own.tobytes()) if n else None
            rows.append((n, sig, np.uint64(xxh3_64_intdigest(prefix.tobytes(), n)).astype(np.int64), int(1000 * often.mean()) if n else 0, prefix.view(np.int64)))
        out = pd.DataFrame(rows, columns=["n", "sig", "gid", "common", "prefix"])
        out.insert(0, "doc_id", ids_of(row))
        del rows, own_sets, known, counted
        tidy()
        return out

    asked = blocks(rows, size=BLOCK, each=(ask, "shard int, block string, slots binary, n binary"))
    answers = asked.groupBy("shard").applyInPandas(answer, "block string, shard int, often binary")
    return blocks(rows, size=BLOCK).groupBy("block").cogroup(answers.groupBy("block")).applyInPandas(describe, "doc_id long, n int, sig binary, gid long, common int, prefix array<long>")


def differences(held: np.ndarray, own: np.ndarray, linked: bool, percent: int) -> tuple[int, np.ndarray]:
    """(length of the short prefix, prefix) of the difference of a set from its hub's, long enough to meet that of any set it could be linked with."""
    new = np.setdiff1d(own, held, assume_unique=True)
    gone = np.setdiff1d(held, own, assume_unique=True)
    d, n, m, less, more = len(new) + len(gone), len(own), len(held), 100 - percent, 100 + percent
    # beside one that the hub isn't linked with: they share more than half of d + less / more * (m - n)
    short = d - max(1, (d * more + less * (m - n)) // (2 * more) + 1) + 1
    # an unlinked one beside a linked one: they share d - less / more * (n + the other's size) at least
    length = short if linked else max(short, less * (n + 100 * n // percent) // more + 1)
    return max(0, min(d, short)), np.concatenate((new, gone))[: max(0, min(d, length))]


def verified(pairs: DataFrame, docs: DataFrame, size: int, percent: int) -> DataFrame:
    """a, b, linked, n (size of b's set), d, short and z (size, length of the short prefix and prefix of its difference from a's; none where a has one pair) for ``pairs`` (a, b: ids, a the hub).

    Each document sends its set to the hubs it is paired with, once each; a hub with more than ``STAR`` pairs is
    repeated, so that its pairs are dealt to several tasks. A task holds one set and reads the others as a stream.
    """
    pairs = stored(pairs)
    salts = pairs.groupBy("a").agg(F.ceil(F.count("*") / STAR).cast("int").alias("salts"), (F.count("*") > 1).alias("many"))
    ends = salts.select(F.col("a").alias("doc_id"), F.lit(0).alias("kind"), "a", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), "many")
    others = pairs.join(salts, "a").select(F.col("b").alias("doc_id"), F.lit(1).alias("kind"), "a", F.pmod(F.xxhash64("b"), "salts").cast("int").alias("salt"), "many")
    # a class is paired with the hubs of its lists, so at most two a shingle of its prefix meet in one row; a hub has one row a salt
    wanted = stored(ends.union(others).groupBy("doc_id").agg(F.collect_list(F.struct("a", "salt", "kind", "many")).alias("to")))
    chosen = docs.join(F.broadcast(wanted) if pairs.count() <= BROADCAST_ROWS else wanted, "doc_id")

    @tidied
    def sets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in sliced(batches):
            rows = [(x["a"], x["salt"], x["kind"], x["many"], i, raw) for i, text, to in zip(part.doc_id, part.text, part.to, strict=True) for raw in (shingles(text, size).tobytes(),) for x in to]
            for k in range(0, len(rows), 256):
                yield pd.DataFrame(rows[k : k + 256], columns=["a", "salt", "kind", "many", "b", "own"])

    @tidied
    def check(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, held = None, None
        for part in batches:
            out = []
            for a, salt, kind, many, b, raw in zip(part.a, part.salt, part.kind, part.many, part.b, part.own, strict=True):
                own = np.frombuffer(raw, np.uint64)
                if kind == 0:
                    at, held = (a, salt), own
                elif at == (a, salt):
                    shared = len(np.intersect1d(held, own, assume_unique=True))
                    linked = 100 * shared >= percent * (len(held) + len(own) - shared)
                    short, z = differences(held, own, linked, percent) if many else (0, own[:0])
                    out.append((a, b, linked, len(own), len(held) + len(own) - 2 * shared, short, z.view(np.int64)))
            yield pd.DataFrame(out, columns=["a", "b", "linked", "n", "d", "short", "z"])

    sent = chosen.mapInPandas(sets, "a long, salt int, kind int, many boolean, b long, own binary").repartition("a", "salt").sortWithinPartitions("a", "salt", "kind")
    return stored(sent.mapInPandas(check, "a long, b long, linked boolean, n int, d int, short int, z array<long>"))


def looked_up(table: DataFrame) -> DataFrame:
    """A side of a join: broadcast if it is small."""
    return F.broadcast(table) if table.count() <= BROADCAST_ROWS else table


def jaccard_components(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id (the smallest id reachable by links), n_copies (rows with an equal set), for each row of ``docs`` (doc_id, text)."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    chars = docs.agg(F.sum(F.char_length("text"))).first()[0] or 0
    rows = stored(described(docs, size, percent, chars))
    full = rows.where("n > 0 and doc_id is not null")
    classes = stored(full.groupBy("sig", "gid", "n", "common").agg(F.min("doc_id").alias("cid"), F.count("*").alias("copies")))
    # lists of groups by prefix shingle and size band: a class stands in its band's list and in that of the band before
    reps = stored(classes.groupBy("gid").agg(F.min("cid").alias("doc_id")))
    index = full.select("doc_id", "gid", "n", F.explode("prefix").alias("key")).join(looked_up(reps), ["doc_id", "gid"], "left_semi")
    keys = stored(index.groupBy("key").agg(F.count("*").alias("m")).where("m > 1").select("key"))
    band = F.floor(F.log(F.col("n").cast("double")) / float(np.log(100 / percent) * 1.001) + 1e-9).cast("int")
    shared = index.join(looked_up(keys), "key").select("key", "gid", F.explode(F.array(band, band - 1)).alias("band"))
    single = classes.select(F.col("gid").alias("key"), "gid", F.lit(-9).alias("band")).distinct()
    lists = stored(shared.union(single).join(classes.select("gid", "cid", "common"), "gid").select("key", "band", "cid", "common"))
    links = roots = None
    for level in range(LEVELS):
        hubs = lists.groupBy("key", "band").agg(F.count("*").alias("m"), F.max_by("cid", F.struct("common", "cid")).alias("a")).where("m > 1").select("key", "band", "a")
        found = verified(lists.join(hubs, ["key", "band"]).where("cid <> a").select("a", F.col("cid").alias("b")).distinct(), docs, size, percent)
        new = found.where("linked").select("a", "b")
        links = new if links is None else links.union(new)
        roots = components(links)
        # the members of a hub's lists, under each shingle of their difference's prefix
        root = lambda c: roots.select(F.col("id").alias(c), "root")
        members = found.where("size(z) > 0").join(root("b"), "b", "left").withColumn("root", F.coalesce("root", "b"))
        split = members.groupBy("a").agg(F.min("root").alias("r1"), F.max("root").alias("r2")).where("r1 <> r2").select("a")
        members = members.join(looked_up(split), "a").select("a", F.posexplode("z").alias("pos", "key"), F.col("b").alias("cid"), "n", "d", "root", "linked", "short")
        members = stored(members.withColumn("near", ~F.col("linked") & (F.col("pos") < F.col("short"))).drop("short"))
        # pairs of unlinked ones in their short prefixes, and of an unlinked with a linked one, if of different components
        many = lambda c: F.sum(c.cast("long"))
        sums = members.groupBy("a", "key", "root").agg(many(F.col("near")).alias("u"), many(~F.col("linked")).alias("v"), many(F.col("linked")).alias("l")).groupBy("a", "key")
        sums = sums.agg(F.sum(F.col("u") + F.col("v") + F.col("l")).alias("m"), F.sum("u").alias("su"), F.sum("v").alias("sv"), F.sum("l").alias("sl"), F.sum(F.col("u") * F.col("u") + 2 * F.col("v") * F.col("l")).alias("same"))
        sums = stored(sums.select("a", "key", "m", ((F.col("su") * F.col("su") + 2 * F.col("sv") * F.col("sl") - F.col("same")) / 2).alias("pairs")).where("pairs > 0"))
        open_rows, open_pairs = sums.agg(F.sum("m"), F.sum("pairs")).first()
        if not open_rows or open_pairs <= 8 * open_rows or level == LEVELS - 1:
            break
        lists = stored(members.join(looked_up(sums.select("a", "key")), ["a", "key"]).join(classes.select("cid", "common"), "cid").select(F.xxhash64("a", "key").alias("key"), F.lit(level).alias("band"), "cid", "common"))
    if open_rows:
        side = members.join(looked_up(sums.select("a", "key")), ["a", "key"])
        one, two = (side.select("a", "key", *(F.col(c).alias(f"{c}{k}") for c in ("cid", "n", "d", "pos", "root", "linked", "near"))) for k in (1, 2))
        kinds = (F.col("near1") & F.col("near2") & (F.col("cid1") < F.col("cid2"))) | (~F.col("linked1") & F.col("linked2"))
        # linked sets share half of what their differences exceed the allowance by, and none of it stands before this place
        reach = F.least(F.col("d1") - F.col("pos1"), F.col("d2") - F.col("pos2"))
        total = F.col("n1") + F.col("n2")
        enough = 2 * reach * (100 + percent) + total * (100 - percent) >= (F.col("d1") + F.col("d2")) * (100 + percent)
        similar = F.least("n1", "n2") * 100 >= F.greatest("n1", "n2") * percent
        rest = one.where("not linked1").join(two.where("near2 or linked2"), ["a", "key"]).where((F.col("root1") != F.col("root2")) & kinds & enough & similar)
        more = verified(rest.select(F.greatest("cid1", "cid2").alias("a"), F.least("cid1", "cid2").alias("b")).distinct(), docs, size, percent).where("linked")
        roots = components(links.union(more.select("a", "b"))) if not more.isEmpty() else roots
    named = classes.join(roots, classes.cid == roots.id, "left").select("sig", F.coalesce("root", "cid").alias("component"), "copies")
    out = rows.select("doc_id", "n", F.when(F.col("doc_id").isNotNull(), F.col("sig")).alias("sig")).join(named, "sig", "left")
    return out.select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id"), F.coalesce("copies", F.lit(1)).alias("n_copies"))
