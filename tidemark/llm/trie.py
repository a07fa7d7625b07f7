"""A trie of conversations that share beginnings, summed up over heavy paths.

A node is a distinct sequence of first turns. Sequences are told apart by 128 bits that are summed up (exclusive or) over hashes of place and turn, so a prefix needs no more than its
last turn's running sum. Each node's largest child is heavy; nodes that follow each other by heavy children are a path, and as the other children hold half of their
parent's conversations at most, a conversation changes paths a logarithmic number of times. A path is named by the smallest conversation of the leaf that it ends in. Sums over
subtrees take one round for each number of changes, deepest first: suffix sums along the path's nodes, and the top's sum goes to its parent, on a path of the next round.

Nothing is one task: turns are put in order by ranges, running sums go by blocks of ``BLOCK`` places and then over blocks, nodes are counted with map-side sums, and the members that
end at a node are hashed in blocks. Only the hash over very many members of one node is one stream, of one row for each ``MANY`` members, as SHA-256 takes its input in order.

Defined results: rows without a conv_id belong to no conversation. Null roles and texts are empty. Turns of equal number are ordered by the MD5 of length of role, role and text; equal rows are
turns each. Without a conversation there is no node, not even the root. A conversation without turns is a member of the root alone.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.texts import stored, tidied
from tidemark.operators.ranges import numbered

BLOCK = 1024
MANY = 4096
NODE = ["depth", "k1", "k2"]


def turns(conversations: DataFrame) -> DataFrame:
    """conv_id, place (from 1), turn's MD5 and its number of words, of ``conversations`` (conv_id, turn, role, text)."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    rows = conversations.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn", F.md5(F.concat(F.char_length(role).cast("string"), F.lit(":"), role, text)).alias("sign"), F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("words")
    )
    ordered = rows.select("conv_id", F.col("turn").isNotNull().alias("some"), F.coalesce("turn", F.lit(0)).cast("long").alias("turn"), "sign", "words")
    placed = numbered(ordered, "conv_id", ["some", "turn", "sign"], "place")
    return placed.select("conv_id", (F.col("place") + 1).alias("place"), "sign", "words")


def branched(placed: DataFrame, base: Column, shared: Column, most: int) -> tuple[DataFrame, DataFrame]:
    """Conversations that begin with the first turns of another: (conv_id, depth, sign, words) and (conv_id, length).

    ``base``: the other's id; ``shared``: how many turns are taken from it and left out of the own ones, ``most`` at most; both from conv_id. Many may begin with one.
    """
    sizes = stored(placed.groupBy("conv_id").agg(F.count("*").alias("n")))
    plan = sizes.select("conv_id", "n", base.alias("base"), shared.cast("long").alias("shared"))
    bases = sizes.select(F.col("conv_id").alias("base"), F.col("n").alias("base_n"))
    taken = F.least("shared", F.coalesce("base_n", F.lit(0)))
    plan = stored(plan.join(bases, "base", "left").withColumn("taken", taken).withColumn("length", F.col("taken") + F.greatest(F.col("n") - F.col("shared"), F.lit(0))))
    own = placed.join(plan.select("conv_id", "shared", "taken"), "conv_id").where("place > shared")
    heads = placed.where(F.col("place") <= most).select(F.col("conv_id").alias("base"), "place", "sign", "words")
    given = plan.where("taken > 0").select("conv_id", "base", "taken").join(heads, "base").where("place <= taken")
    steps = own.select("conv_id", (F.col("place") - F.col("shared") + F.col("taken")).alias("depth"), "sign", "words").union(given.select("conv_id", F.col("place").alias("depth"), "sign", "words"))
    return steps, plan.select("conv_id", "length")


def prefixes(steps: DataFrame) -> DataFrame:
    """Steps with the 128 bits of the sequence up to each (k1, k2) and up to the one before (u1, u2)."""
    own = {"a": F.xxhash64("depth", "sign"), "b": F.xxhash64("sign", "depth", F.lit("b")), "block": F.floor((F.col("depth") - 1) / BLOCK)}
    by = Window.partitionBy("conv_id", "block").orderBy("depth").rowsBetween(Window.unboundedPreceding, 0)
    rows = steps.withColumns(own).withColumns({"k1": F.bit_xor("a").over(by), "k2": F.bit_xor("b").over(by)})
    over = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, 0)
    before = rows.where(F.col("depth") % BLOCK == 0).select("conv_id", (F.col("block") + 1).alias("block"), F.bit_xor("k1").over(over).alias("o1"), F.bit_xor("k2").over(over).alias("o2"))
    later = rows.where("block > 0").join(before, ["conv_id", "block"]).withColumns({"k1": F.expr("k1 ^ o1"), "k2": F.expr("k2 ^ o2")})
    keep = ["conv_id", "depth", "words", "k1", "k2", F.expr("k1 ^ a").alias("u1"), F.expr("k2 ^ b").alias("u2")]
    return rows.where("block = 0").select(*keep).union(later.select(*keep))


def suffix_sums(rows: DataFrame, names: list[str]) -> DataFrame:
    """Each of ``names`` summed from the row's depth to the end of its path; ``rows``: path, depth without gaps, and names."""
    block = F.floor(F.col("depth") / BLOCK)
    by = Window.partitionBy("path", "block").orderBy(F.desc("depth")).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("block", block).withColumns({n: F.sum(n).over(by) for n in names})
    over = Window.partitionBy("path").orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, 0)
    after = rows.where((F.col("depth") % BLOCK == 0) & (F.col("depth") > F.col("top"))).select("path", (F.col("block") - 1).alias("block"), *(F.sum(n).over(over).alias(f"_{n}") for n in names))
    return rows.join(after, ["path", "block"], "left").withColumns({n: F.col(n) + F.coalesce(f"_{n}", F.lit(0)) for n in names}).drop("block", *(f"_{n}" for n in names))


def end_hashes(ends: DataFrame, nodes: DataFrame, many: int = MANY) -> DataFrame:
    """NODE and the SHA-256 of the ids that end there, ascending, of nodes with more than one; ``ends``: conv_id and NODE."""
    several = nodes.where("n_ends > 1").select(*NODE, "n_ends")
    rows = ends.join(several, NODE)
    joined = F.array_join(F.transform(F.sort_array(F.collect_list("conv_id")), lambda c: c.cast("string")), ",")
    few = rows.where(F.col("n_ends") <= many).groupBy(*NODE).agg(F.sha2(joined, 256).alias("sha"))
    if (nodes.agg(F.max("n_ends")).first()[0] or 0) <= many:
        return few
    named = rows.where(F.col("n_ends") > many).select(F.concat_ws(":", *NODE).alias("node"), "conv_id")
    chunks = numbered(named, "node", ["conv_id"], "place").groupBy("node", F.floor(F.col("place") / many).alias("chunk")).agg(joined.alias("ids"))

    @tidied
    def hashed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, state = None, None
        for batch in batches:
            for node, ids in zip(batch.node, batch.ids, strict=True):
                if node != now:
                    if state is not None:
                        yield pd.DataFrame({"node": [now], "sha": [state.hexdigest()]})
                    now, state = node, hashlib.sha256()
                else:
                    state.update(b",")
                state.update(ids.encode())
        if state is not None:
            yield pd.DataFrame({"node": [now], "sha": [state.hexdigest()]})

    long = chunks.repartition("node").sortWithinPartitions("node", "chunk").select("node", "ids").mapInPandas(hashed, "node string, sha string")
    part = F.split("node", ":")
    return few.union(long.select(*(part[k].cast("long").alias(c) for k, c in enumerate(NODE)), "sha"))


def trie(steps: DataFrame, lengths: DataFrame, many: int = MANY) -> DataFrame:
    """One row a node: conv_id (its smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves and saved_tokens over its subtree, ends_sha256.

    ``steps``: conv_id, depth from 1 without gaps, sign, words; ``lengths``: conv_id, length, of every conversation.
    """
    pre = stored(prefixes(steps).join(lengths, "conv_id").withColumn("end", F.col("depth") == F.col("length")).drop("length"))
    zero = F.lit(0).cast("long")
    root = lengths.agg(F.count("*").alias("n_convs"), F.min("conv_id").alias("conv_id"), zero.alias("words"), zero.alias("u1"), zero.alias("u2"), F.count_if(F.col("length") == 0).alias("n_ends"), F.min(F.when(F.col("length") == 0, F.col("conv_id"))).alias("one_end")).where("n_convs > 0")
    counts = pre.groupBy(*NODE).agg(F.count("*").alias("n_convs"), F.min("conv_id").alias("conv_id"), F.max("words").alias("words"), F.min("u1").alias("u1"), F.min("u2").alias("u2"), F.count_if("end").alias("n_ends"), F.min(F.when(F.col("end"), F.col("conv_id"))).alias("one_end"))
    nodes = stored(counts.unionByName(root.withColumns(dict.fromkeys(NODE, zero))))
    up = [(F.col("depth") - 1).alias("depth"), F.col("u1").alias("k1"), F.col("u2").alias("k2")]
    largest = F.max_by("conv_id", F.struct("n_convs", -F.col("conv_id"))).alias("heavy_conv")
    children = nodes.where("depth > 0").groupBy(*up).agg(F.count("*").alias("n_children"), largest)
    full = stored(nodes.join(children, NODE, "left").withColumn("n_children", F.coalesce("n_children", zero)))
    parents = full.select((F.col("depth") + 1).alias("depth"), F.col("k1").alias("u1"), F.col("k2").alias("u2"), F.col("conv_id").alias("parent_conv_id"), F.col("heavy_conv").alias("chosen"))
    tree = full.join(parents, ["depth", "u1", "u2"], "left").withColumn("heavy", F.coalesce(F.col("chosen") == F.col("conv_id"), F.lit(False)))
    tree = stored(tree.select(*NODE, "conv_id", "parent_conv_id", "n_convs", "n_children", "words", "n_ends", "one_end", "heavy"))

    leaves = tree.where("n_children = 0").select(F.col("conv_id").alias("path"))
    walk = pre.select(F.col("conv_id").alias("path"), *NODE).join(leaves, "path").union(leaves.select("path", zero, zero, zero))
    walk = walk.join(tree.select(*NODE, "conv_id", "parent_conv_id", "n_convs", "n_children", "words", "heavy"), NODE)
    tops = walk.groupBy("path").agg(F.max(F.when(~F.col("heavy"), F.col("depth"))).alias("top"), (F.count_if(~F.col("heavy")) - 1).alias("level"))
    own = {"n_leaves": (F.col("n_children") == 0).cast("long"), "saved_tokens": (F.col("n_convs") - 1) * F.col("words")}
    on_path = stored(walk.join(tops, "path").where("depth >= top").withColumns(own).select("path", "depth", "conv_id", "parent_conv_id", "top", "level", *own))
    rounds, added = [], None
    for level in range(on_path.agg(F.max("level")).first()[0] or 0, -1, -1):
        rows = on_path.where(F.col("level") == level)
        if added is not None:
            rows = rows.join(added, ["depth", "conv_id"], "left").withColumns({n: F.col(n) + F.coalesce(f"add_{n}", zero) for n in own}).drop(*(f"add_{n}" for n in own))
        rounds.append(stored(suffix_sums(rows, list(own)).select("depth", "conv_id", "parent_conv_id", "top", *own)))
        added = rounds[-1].where("depth = top and depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("parent_conv_id").alias("conv_id")).agg(*(F.sum(n).alias(f"add_{n}") for n in own))
    sums = reduce(DataFrame.union, rounds).select("depth", "conv_id", *own)

    ends = pre.where("end").select("conv_id", *NODE).union(lengths.where("length = 0").select("conv_id", zero, zero, zero))
    several = end_hashes(ends, nodes, many)
    alone = F.sha2(F.coalesce(F.col("one_end").cast("string"), F.lit("")), 256)
    out = tree.join(sums, ["depth", "conv_id"]).join(several, NODE, "left").withColumn("ends_sha256", F.coalesce("sha", alone))
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
