"""Golden records: one surviving record for each cluster of duplicates, by a secondary sort and a stream of constant state.

Rows are dealt out by cluster, sorted within partitions by RECENT, and streamed: the first row of a cluster reveals the
latest time, so every later row is known at once to be fresh or stale, and of what has gone by only the rows that win a
field so far are kept (five at most) beside two counters. A cluster that is larger than a fair share of a task is dealt
out by a hash as well: what its first row would reveal is summed up beforehand, equal rows are counted as one, every part is streamed to
its winners, and a second stream over the winners ends it. There are at most as many such clusters as four for each partition of a
shuffle, whatever the input.

Defined results: strings that are empty or hold only white space count as null. A source that isn't known, or none, has the lowest trust. Rows with
neither id form one cluster without an id. A balance that is no number counts as null. A record without an id can win, and then the id that it is from is null; in
RECENT it comes after those with one. Rows that agree in all three of RECENT's keys are ordered by name, email, city, nation, segment and balance, null first. Equal
rows are counted each. An empty table has no cluster.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.texts import small_batches, tidied

#: Sources by falling trust.
TRUST = ("partner", "store", "web", "crm")
STALE_AFTER = 30 * 24 * 3_600_000_000
#: A cluster of up to so many rows is never dealt out.
LEAST = 1000
#: The order RECENT, all ascending, down to the last column so that ties are no accident.
RECENT = ("undated", "age", "rank", "unnamed", "client", "name", "email", "city", "nation", "segment", "balance")
KEY = ("cluster", "loose")
STATE = "cluster long, loose boolean, part int, undated boolean, age long, rank int, unnamed boolean, client long, name string, email string, city string, nation long, segment string, balance double, name_chars int, weight long, n_stale long, headed boolean, latest long, dated boolean, chosen string"
NAMES = [c.split()[0] for c in STATE.split(", ")]
RESULT = "cluster_id long, n_records long, n_stale long, name string, email string, segment string, city string, nation_id int, balance double, name_from long, email_from long, segment_from long, balance_from long, address_from long"


def micros(column: str) -> Column:
    """Microseconds since 1970 of a time without a zone, whatever the session's zone is."""
    c = F.col(column).cast("timestamp_ntz")
    return F.unix_date(c.cast("date")).cast("long") * 86_400_000_000 + F.hour(c).cast("long") * 3_600_000_000 + F.minute(c).cast("long") * 60_000_000 + (F.date_part(F.lit("SECOND"), c) * 1_000_000).cast("long")


def rows_of(clients: DataFrame) -> DataFrame:
    """The rows in the form that is streamed (``STATE`` without what a head adds)."""
    text = {c: F.when(F.col(c).rlike(r"[^\x20\x09-\x0D]"), F.col(c)) for c in ("name", "email", "city", "segment", "source")}
    rank = F.lit(len(TRUST))
    for k, source in reversed(list(enumerate(TRUST))):
        rank = F.when(text["source"] == source, k).otherwise(rank)
    cluster = F.coalesce("master_id", "client_id")
    return clients.select(
        F.coalesce(cluster, F.lit(0)).cast("long").alias("cluster"), cluster.isNull().alias("loose"), F.col("updated_at").isNull().alias("undated"), F.coalesce(-micros("updated_at"), F.lit(0)).alias("age"),
        rank.cast("int").alias("rank"), F.col("client_id").isNull().alias("unnamed"), F.coalesce("client_id", F.lit(0)).cast("long").alias("client"), *(text[c].alias(c) for c in ("name", "email", "city", "segment")),
        F.col("nation_id").cast("long").alias("nation"), F.nanvl(F.col("balance").cast("double"), F.lit(None).cast("double")).alias("balance"), F.coalesce(F.char_length(text["name"]), F.lit(0)).alias("name_chars"),
    )


def first_in(group: np.ndarray, allowed: np.ndarray, *keys: np.ndarray) -> np.ndarray:
    """For each group number the place of its least allowed row by ``keys`` and then place, or -1."""
    out = np.full(group[-1] + 1, -1)
    at = np.flatnonzero(allowed)
    at = at[np.lexsort((at, *(k[at] for k in reversed(keys)), group[at]))]
    _, head = np.unique(group[at], return_index=True)
    out[group[at[head]]] = at[head]
    return out


def judged(rows: pd.DataFrame) -> tuple[np.ndarray, dict[str, np.ndarray], pd.DataFrame]:
    """Group numbers, each field's winning places by group, and by group: n_records, n_stale, latest, dated, chosen. ``rows``: sorted by group and RECENT."""
    same = np.ones(len(rows), bool)
    for c in (*KEY, "part"):
        v = rows[c].to_numpy()
        same[1:] &= v[1:] == v[:-1]
    same[0] = False
    group = np.cumsum(~same) - 1
    head = np.flatnonzero(~same)
    undated, age, headed = (rows[c].to_numpy() for c in ("undated", "age", "headed"))
    headed, undated = headed.astype(bool), undated.astype(bool)
    latest = np.where(headed[head], rows.latest.to_numpy()[head], -age[head])
    dated = np.where(headed[head], rows.dated.to_numpy().astype(bool)[head], ~undated[head])
    stale = undated | (-age < latest[group] - STALE_AFTER)
    segment, has = rows.segment.to_numpy(object), {c: rows[c].notna().to_numpy() for c in ("name", "email", "city", "nation", "segment", "balance")}
    best = {"segment": first_in(group, has["segment"])}
    chosen = np.where(best["segment"] >= 0, segment[best["segment"]], None)
    known = rows.chosen.notna().to_numpy()[head]
    chosen = np.where(known, rows.chosen.to_numpy(object)[head], chosen)
    rank = rows["rank"].to_numpy()
    best["email"] = first_in(group, has["email"], stale, rank)
    best["name"] = first_in(group, has["name"], -rows.name_chars.to_numpy(), stale, rank)
    best["balance"] = first_in(group, has["balance"], segment != chosen[group])
    best["address"] = first_in(group, np.ones(len(rows), bool), -(has["city"].astype(int) + has["nation"]), stale, rank)
    weight, counted = rows.weight.to_numpy(), rows.n_stale.to_numpy()
    counted = np.where(counted < 0, stale * weight, counted)
    sums = pd.DataFrame({"n_records": np.bincount(group, weight).astype(np.int64), "n_stale": np.bincount(group, counted).astype(np.int64), "latest": latest, "dated": dated, "chosen": chosen})
    return group, best, sums


def winners(rows: pd.DataFrame, best: dict[str, np.ndarray], sums: pd.DataFrame, group: np.ndarray, of: np.ndarray) -> pd.DataFrame:
    """The rows that win a field in the groups ``of``, in order; the first of a group carries its counts, all what its first row revealed."""
    at = np.unique(np.concatenate([b[of] for b in best.values()]))
    at = at[at >= 0]
    out, g = rows.iloc[at].copy(), group[at]
    top = np.r_[True, g[1:] != g[:-1]]
    out["weight"], out["n_stale"] = np.where(top, sums.n_records.to_numpy()[g], 0), np.where(top, sums.n_stale.to_numpy()[g], 0)
    out["headed"], out["latest"], out["dated"], out["chosen"] = True, sums.latest.to_numpy()[g], sums.dated.to_numpy()[g], sums.chosen.to_numpy(object)[g]
    return out


def records(rows: pd.DataFrame, best: dict[str, np.ndarray], sums: pd.DataFrame, group: np.ndarray, of: np.ndarray) -> pd.DataFrame:
    """The surviving record of each of the groups ``of``."""
    if not len(of):
        return pd.DataFrame({c.split()[0]: [] for c in RESULT.split(", ")})
    at = {k: b[of] for k, b in best.items()}
    take = lambda c, k: pd.Series(np.where(at[k] >= 0, rows[c].to_numpy(object)[at[k]], None))
    client, unnamed = rows.client.to_numpy(), rows.unnamed.to_numpy().astype(bool)
    source = lambda k, some: pd.Series(np.where((at[k] >= 0) & ~unnamed[at[k]] & some, client[at[k]].astype(object), None)).astype("Int64")
    head = np.searchsorted(group, of)
    city, nation = take("city", "address"), take("nation", "address").astype("Float64").astype("Int64")
    return pd.DataFrame({
        "cluster_id": pd.Series(np.where(rows.loose.to_numpy().astype(bool)[head], None, rows.cluster.to_numpy()[head].astype(object))).astype("Int64"), "n_records": sums.n_records.to_numpy()[of], "n_stale": sums.n_stale.to_numpy()[of],
        "name": take("name", "name"), "email": take("email", "email"), "segment": take("segment", "segment"), "city": city, "nation_id": nation.astype("Int32"), "balance": take("balance", "balance").astype("Float64"),
        "name_from": source("name", True), "email_from": source("email", True), "segment_from": source("segment", True), "balance_from": source("balance", True), "address_from": source("address", (city.notna() | nation.notna()).to_numpy()),
    })


def stream(rows: DataFrame, last: bool) -> DataFrame:
    """Rows of ``STATE``, dealt out and sorted, to each cluster's record, or to the rows that win in each of its parts."""
    small_batches(rows.sparkSession)
    give = records if last else winners

    @tidied
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        open_rows = None
        for batch in batches:
            if not len(batch):
                continue
            rows = batch if open_rows is None else pd.concat([open_rows, batch], ignore_index=True)
            group, best, sums = judged(rows)
            if group[-1]:
                yield give(rows, best, sums, group, np.arange(group[-1]))
            open_rows = winners(rows, best, sums, group, group[-1:])
        if open_rows is not None:
            group, best, sums = judged(open_rows)
            yield give(open_rows, best, sums, group, group[-1:])

    dealt = rows.repartition(*KEY, "part").sortWithinPartitions(*KEY, "part", *RECENT)
    return dealt.select(*NAMES).mapInPandas(run, RESULT if last else STATE)


def golden_records(clients: DataFrame, least: int = LEAST) -> DataFrame:
    """``RESULT`` for each cluster of ``clients`` (client_id, master_id, source, updated_at, name, email, city, nation_id, segment, balance).

    A cluster of more than ``least`` rows, and of more than a quarter of a partition's share, goes to several tasks.
    """
    spark = clients.sparkSession
    rows = rows_of(clients)
    none = {"weight": F.lit(1).cast("long"), "n_stale": F.lit(-1).cast("long")}
    unheaded = {"part": F.lit(0), "headed": F.lit(False), "latest": F.lit(0).cast("long"), "dated": F.lit(False), "chosen": F.lit(None).cast("string")}
    limit = max(least, clients.count() // (4 * int(spark.conf.get("spark.sql.shuffle.partitions"))))
    sizes = rows.groupBy(*KEY).agg(F.count("*").alias("n")).where(F.col("n") > limit).collect()
    if not sizes:
        return stream(rows.withColumns(none | unheaded), last=True)
    large = F.broadcast(spark.createDataFrame([(r.cluster, r.loose, r.n // limit + 1) for r in sizes], "cluster long, loose boolean, parts long"))
    held = rows.join(large, [*KEY])
    newest = F.max(F.when(~F.col("undated"), -F.col("age")))
    first = F.min_by("segment", F.when(F.col("segment").isNotNull(), F.struct(*RECENT)))
    heads = held.groupBy(*KEY).agg(F.coalesce(newest, F.lit(0)).alias("latest"), newest.isNotNull().alias("dated"), first.alias("chosen")).collect()
    heads = F.broadcast(spark.createDataFrame([tuple(r) for r in heads], "cluster long, loose boolean, latest long, dated boolean, chosen string"))
    counted = held.groupBy(*KEY, "parts", *RECENT, "name_chars").agg(F.count("*").alias("weight"))
    part = F.pmod(F.xxhash64(*RECENT), "parts").cast("int")
    parted = counted.join(heads, [*KEY]).withColumns({"part": part, "n_stale": F.lit(-1).cast("long"), "headed": F.lit(True)})
    won = stream(parted, last=False).withColumn("part", F.lit(0))
    rest = rows.join(large, [*KEY], "left_anti").withColumns(none | unheaded)
    return stream(rest, last=True).unionByName(stream(won, last=True))
