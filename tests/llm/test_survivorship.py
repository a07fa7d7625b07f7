"""Golden records against a loop over each cluster, whole and dealt out, with odd rows."""

from __future__ import annotations

import math
import random
from datetime import datetime, timedelta

import pytest

from tidemark.llm import queries, survivorship

SCHEMA = "client_id long, master_id long, source string, updated_at timestamp_ntz, name string, email string, city string, nation_id int, segment string, balance double"
TRUST = {"partner": 0, "store": 1, "web": 2, "crm": 3}
NEW = datetime(2024, 5, 1)


def up(x):
    """Null before anything else."""
    return (x is not None, x if x is not None else 0) if not isinstance(x, str) else (True, x)


def plain(rows):
    clusters = {}
    for r in rows:
        r = dict(zip((c.split()[0] for c in SCHEMA.split(", ")), r, strict=True))
        for c in ("source", "name", "email", "city", "segment"):
            if r[c] is not None and not r[c].strip(" \t\n\v\f\r"):
                r[c] = None
        if r["balance"] is not None and math.isnan(r["balance"]):
            r["balance"] = None
        clusters.setdefault(r["master_id"] if r["master_id"] is not None else r["client_id"], []).append(r)
    out = {}
    for key, rows in clusters.items():
        text = lambda x: (x is not None, x or "")
        latest = max((r["updated_at"] for r in rows if r["updated_at"]), default=None)
        rank = lambda r: TRUST.get(r["source"], 4)
        rows.sort(key=lambda r: (r["updated_at"] is None, -((r["updated_at"] or NEW) - NEW).total_seconds(), rank(r), r["client_id"] is None, r["client_id"] or 0, text(r["name"]), text(r["email"]), text(r["city"]), up(r["nation_id"]), text(r["segment"]), up(r["balance"])))
        for k, r in enumerate(rows):
            r["k"], r["stale"] = k, r["updated_at"] is None or r["updated_at"] < latest - timedelta(hours=720)
        trusted = sorted(rows, key=lambda r: (r["stale"], rank(r), r["k"]))
        first = lambda rs, c: next((r for r in rs if r[c] is not None), dict.fromkeys(r))
        segment, email = first(rows, "segment"), first(trusted, "email")
        name = first(sorted(trusted, key=lambda r: -len(r["name"] or "")), "name")
        balance = first(sorted(rows, key=lambda r: r["segment"] != segment["segment"]), "balance")
        place = min(trusted, key=lambda r: (r["city"] is None) + (r["nation_id"] is None))
        some = place["city"] is not None or place["nation_id"] is not None
        out[key] = (len(rows), sum(r["stale"] for r in rows), name["name"], email["email"], segment["segment"], place["city"], place["nation_id"], balance["balance"], name["client_id"], email["client_id"], segment["client_id"], balance["client_id"], place["client_id"] if some else None)
    return out


def random_rows(n, seed):
    rng = random.Random(seed)
    pick = rng.choice
    rows = []
    for i in range(n):
        master = pick([None, 7, 7, 7, rng.randrange(40)])
        at = pick([None, NEW - timedelta(days=rng.randrange(80)), NEW - timedelta(hours=720), NEW - timedelta(hours=720, microseconds=1), NEW])
        rows.append((pick([i, i, i, None]) if master is not None else pick([i, i, i, i, None]), master, pick(["partner", "store", "web", "crm", "other", " ", None]), at, pick([None, "", "\t", "Ann", "Anna Ö", " x ", "𝔄𝔅"]), pick([None, "a@b.c", "d@e.f", " "]), pick([None, "", "Ulm", "Rom"]), pick([None, 1, 2]), pick([None, "", "retail", "public", "export"]), pick([None, math.nan, 1.005, -2.5, 3.0])))
    return rows + rows[: n // 4]  # and equal rows


def got(frame):
    return {r.cluster_id: tuple(r)[1:] for r in frame.collect()}


@pytest.mark.parametrize(("least", "seed"), [(1000, 1), (3, 1), (30, 2)])
def test_golden_records_equal_a_loop(spark, least, seed):
    rows = random_rows(400, seed)
    frame = spark.createDataFrame(rows, SCHEMA).repartition(5).selectExpr("*", "1 as cluster", "'x' as part", "true as stale", "2 as weight")
    kept = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 17)  # clusters go on over several batches
        assert got(survivorship.golden_records(frame, least=least)) == plain(rows)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", kept)


def test_a_cluster_of_equal_rows_and_an_empty_table(spark):
    rows = [(1, 5, "web", NEW, "n", None, None, None, "s", 1.0)] * 500 + [(2, None, None, None, None, None, None, None, None, None)]
    assert got(survivorship.golden_records(spark.createDataFrame(rows, SCHEMA), least=10)) == plain(rows)
    assert got(survivorship.golden_records(spark.createDataFrame([], SCHEMA))) == {}


def test_times_do_not_depend_on_the_session_zone(spark):
    rows = [(1, 9, "crm", datetime(2024, 4, 30, 12), "new", None, None, None, None, None), (2, 9, "web", datetime(2024, 3, 31, 12), "edge", None, None, None, None, None), (3, 9, "web", datetime(2024, 3, 31, 11, 59, 59, 999999), "late!", None, None, None, None, None)]
    zone = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "Europe/Berlin")  # its clocks go forward on 31 March
        (r,) = survivorship.golden_records(spark.createDataFrame(rows, SCHEMA)).collect()
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
    assert (r.n_records, r.n_stale, r.name_from) == (3, 1, 3)


def test_the_query_has_one_row_for_each_cluster(spark):
    sf = "/root/testdata/sf0.001"
    clients = spark.read.parquet(f"{sf}/clients.parquet")
    out = queries.op13_survivorship(spark, sf)
    assert out.count() == clients.selectExpr("coalesce(master_id, client_id) as c").distinct().count() and out.agg({"n_records": "sum"}).first()[0] == clients.count()
