"""Document fingerprints from closed syncmers, with DataFrame functions only.

A lower-cased text is a sequence of symbols: up to three characters of a word, counted from the word's start, or one
ideograph or kana. ``inner`` consecutive symbols hash to an inner value; a k-mer of ``inner + reach`` symbols holds
``reach + 1`` of them and is a closed syncmer when the smallest stands first or last. Whether a k-mer is chosen depends on
nothing outside it, so equal passages give equal anchors wherever they stand, and an edit changes only the anchors that
touch it.

Defined results: a null text counts as empty; an empty one, or one of white space only, has no anchors and the empty
fingerprint; a text of fewer symbols than a k-mer has its whole sequence as its single anchor; equal texts have equal
fingerprints; two texts without anchors have likeness 1, one without and one with have 0. Repeated ids are ordered by their
texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

INNER = 3
REACH = 6
#: Three ASCII characters of a word are tried first, which is what the rest gives for them too, without looks at scripts.
SYMBOL = r"[!-~]{3}|[\p{IsHan}\p{IsHiragana}\p{IsKatakana}]|[^\s\p{IsHan}\p{IsHiragana}\p{IsKatakana}]{1,3}"


def inner_values(text: Column, inner: int = INNER) -> Column:
    """Hashes of each run of ``inner`` symbols; of the whole sequence if it is shorter (none without symbols)."""
    symbols = F.regexp_extract_all(F.lower(text), F.lit(SYMBOL), F.lit(0))

    def all_runs(s: Column) -> Column:
        runs = F.transform(F.sequence(F.lit(0), F.size(s) - inner), lambda i: F.xxhash64(*(F.get(s, i + k) for k in range(inner))))
        return F.when(F.size(s) >= inner, runs).when(F.size(s) > 0, F.array(F.xxhash64(F.array_join(s, " ")))).otherwise(F.array().cast("array<bigint>"))

    return F.get(F.transform(F.array(symbols), all_runs), F.lit(0))


def anchors(text: Column, inner: int = INNER, reach: int = REACH) -> Column:
    """array<struct<at int, hash bigint>>: the closed syncmers of a text by symbol number."""

    def chosen(h: Column) -> Column:
        def edge(i: Column) -> Column:
            between = F.least(*(F.get(h, i + k) for k in range(1, reach)))
            return (F.get(h, i) <= between) | (F.get(h, i + reach) <= between)

        def anchor(i: Column) -> Column:
            return F.struct(i.alias("at"), F.xxhash64(F.get(h, i), F.get(h, i + inner), F.get(h, i + reach)).alias("hash"))

        whole = F.array(F.struct(F.lit(0).alias("at"), F.xxhash64(h).alias("hash")))
        none = F.array().cast("array<struct<at:int,hash:bigint>>")
        return F.when(F.size(h) > reach, F.transform(F.filter(F.sequence(F.lit(0), F.size(h) - reach - 1), edge), anchor)).when(F.size(h) > 0, whole).otherwise(none)

    return F.get(F.transform(F.array(inner_values(F.coalesce(text, F.lit("")), inner)), chosen), F.lit(0))


def printed(found: Column) -> Column:
    """Anchor values in text order as one string of eight hexadecimal digits each."""
    return F.array_join(F.transform(found, lambda a: F.lpad(F.hex(a), 8, "0")), "")


def values(found: Column) -> Column:
    """The distinct 32-bit anchor values that a fingerprint holds."""
    return F.array_distinct(F.transform(found, lambda a: a["hash"].bitwiseAND(0xFFFFFFFF)))


def likeness(a: Column, b: Column) -> Column:
    """Twice the shared values over all values of both (0 to 1)."""
    total = F.size(a) + F.size(b)
    return F.when(total == 0, 1.0).otherwise(2.0 * F.size(F.array_intersect(a, b)) / total)


def aligned(a: Column, b: Column) -> Column:
    """How many anchors two texts have in common at the same place. As strings, which are intersected by a hash set; structs would be compared each with each."""
    at = lambda x: F.transform(x, lambda v: F.concat(v["at"].cast("string"), F.lit(":"), v["hash"].cast("string")))
    return F.size(F.array_intersect(at(a), at(b))).cast("long")


def matches(left: DataFrame, right: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """Positional matching: (id, other_id, shift, n) for documents that share anchors, by the shift that most shared anchors agree on.

    Meant for a set of queries against a corpus, not for all pairs of a corpus. The queries' anchors are counted first, and the
    corpus is cut down to them before the join, which is an equi-join whose large partitions adaptive execution splits.
    """
    a = left.select(F.col(id_column).alias("id"), F.inline(anchors(F.col(text))))
    b = right.select(F.col(id_column).alias("other_id"), F.inline(anchors(F.col(text)))).withColumnRenamed("at", "other_at")
    b = b.join(a.select("hash").distinct(), "hash", "left_semi")
    shifts = a.join(b, "hash").groupBy("id", "other_id", (F.col("at") - F.col("other_at")).alias("shift")).agg(F.count("*").alias("n"))
    best = F.max_by(F.struct("shift", "n"), F.struct("n", -F.abs("shift"), "shift"))
    return shifts.groupBy("id", "other_id").agg(best.alias("best")).select("id", "other_id", "best.*")


#: Cuts of the id ranges that stand in the plan, as so many lists of so many; ranges between two cuts are of equal width.
CUTS = 32


def with_next(docs: DataFrame, keep: list[str], derive: dict[str, Column], id_column: str = "doc_id", rows_per_range: int = 1000) -> DataFrame:
    """The id, ``keep`` and the ``derive`` columns of each row, and ``next``: the same of the row that follows by id (after the last: the first).

    Cuts of an approximate quantile summary part the ids into up to ``CUTS`` * ``CUTS`` ranges of about equal size, each of which is parted
    evenly into as many as it takes to hold ``rows_per_range`` rows or so. The first id of each range that has one is found by an aggregate of ids, and the
    first rows are repeated at the end of the range before. Ranges are dealt
    out in one shuffle and sorted each by itself. Null ids come first; ties are ordered by the kept columns.
    """
    key = F.coalesce(F.col(id_column).cast("long"), F.lit(-(2**63)))
    rows = docs.select(key.alias("_key"), id_column, *keep)
    least, most, total = rows.agg(F.min("_key"), F.max("_key"), F.count("*")).first()
    if not total:
        least = most = 0
    cuts = max(1, min(CUTS * CUTS, -(-total // rows_per_range)))
    found = rows.agg(F.percentile_approx("_key", [k / cuts for k in range(1, cuts)], 50 * cuts)).first()[0] if cuts > 1 else []
    firsts = sorted({least, *found})
    parts = max(1, -(-total // (len(firsts) * rows_per_range)))
    lists = [firsts[k : k + CUTS] for k in range(0, len(firsts), CUTS)]
    longs = lambda xs: F.array(*(F.lit(x).cast("long") for x in xs))
    up_to = lambda xs: F.size(F.filter(xs, lambda x: x <= F.col("_key"))) - 1
    outer = up_to(longs([x[0] for x in lists]))
    cut = outer * CUTS + up_to(F.get(F.array(*map(longs, lists)), outer))
    rows = rows.withColumn("_cut", cut)
    if parts > 1:
        low, high = F.get(longs(firsts), F.col("_cut")).cast("double"), F.get(longs([*firsts[1:], most + 1 if most < 2**63 - 1 else most]), F.col("_cut")).cast("double")
        step = F.least(F.lit(parts - 1), F.floor((F.col("_key").cast("double") - low) * parts / F.greatest(F.lit(1.0), high - low)))
    else:
        step = F.lit(0)
    rows = rows.withColumn("_range", (F.col("_cut").cast("long") * parts + step).cast("long")).drop("_cut")
    if parts > 1:
        own = rows.groupBy("_range").agg(F.min("_key").alias("_key"))
        before = F.coalesce(F.lag("_range").over(Window.orderBy("_range")), F.last("_range").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
        heads = rows.join(own.select("_key", before.alias("_to")), "_key")
    else:
        last = len(firsts)
        heads = rows.where(F.col("_key").isin(firsts)).withColumn("_to", (F.col("_range") + last - 1) % last)
    heads = heads.groupBy("_key", "_to").agg(F.min(F.struct(id_column, *keep)).alias("head"))
    both = rows.select("_range", F.lit(0).alias("_last"), "_key", id_column, *keep).union(heads.select("_to", F.lit(1), "_key", "head.*")).repartition("_range")
    both = both.withColumns(derive)
    by = Window.partitionBy("_range").orderBy("_last", "_key", *keep)
    return both.withColumn("next", F.lead(F.struct(*keep, *derive)).over(by)).where("_last = 0").select(id_column, *keep, *derive, "next")
