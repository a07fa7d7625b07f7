"""Order across tasks, JSON entries, parts of words and the store, against plain versions and with odd rows."""

from __future__ import annotations

import os
import random
from collections import defaultdict

from pyspark.sql import functions as F

from tidemark.operators import chunking, grams, graph, ranges
from tidemark.sources import store


def test_neighbours_within_a_large_source(spark):
    rows = [("hot", i * 3, f"h{i}") for i in range(333)] + [(f"k{i % 20}", i, f"x{i}") for i in range(90)]
    frame = spark.createDataFrame(rows, "key string, pos long, text string").repartition(6)
    dealt, w = ranges.near(frame, "key", "pos", by_block=8)
    got = dealt.withColumn("near", F.array_join(F.collect_list("text").over(w.rowsBetween(-1, 1)), " ")).where("_own").select("key", "pos", "near").collect()
    sources = defaultdict(list)
    for key, pos, text in sorted(rows):
        sources[key].append((pos, text))
    want = {(key, pos): " ".join(t for _, t in own[max(0, i - 1) : i + 2]) for key, own in sources.items() for i, (pos, _) in enumerate(own)}
    assert len(got) == len(rows) and {(r.key, r.pos): r.near for r in got} == want


def test_positions_over_several_ranges(spark):
    rows = [(random.Random(i).randrange(40), i) for i in range(500)]
    got = ranges.positions(spark.createDataFrame(rows, "n long, id long"), [F.desc("n"), "id"], "place", parts=7).collect()
    want = {i: k for k, (_, i) in enumerate(sorted(rows, key=lambda r: (-r[0], r[1])))}
    assert {r.id: r.place for r in got} == want
    assert ranges.positions(spark.createDataFrame([], "n long, id long"), ["n"], "place").count() == 0


def test_triples_are_numbered_in_order_of_first_mention(spark):
    found = spark.createDataFrame([(2, 0, "a", "is", "b", "s"), (1, 1, "c", "is", "d", "s"), (1, 0, "a", "is", "b", "s"), (3, 0, None, "is", "b", "s")], "seq int, part int, subject string, predicate string, object string, source_name string")
    got = sorted((r.triple_index, r.subject, r.object) for r in graph.numbered_triples(found).collect())
    assert got == [(0, "a", "b"), (1, "c", "d"), (2, None, "b")]


def test_json_entries_of_odd_texts(spark):
    rows = [(1, '{"b": [1, {"z": 1, "a": null}], "a": "t\\"x"}'), (2, "[1, [2], \"s\"]"), (3, "7"), (4, "{broken"), (5, ""), (6, None), (7, "{}"), (8, "[]"), (9, "null"), (1, '{"b": 2}')]
    got = sorted((r.id, r.key_path, r.entry) for r in chunking.json_entries(spark.createDataFrame(rows, "id int, text string").withColumn("pos", F.lit("mine")), "text").collect())
    assert got == sorted([(1, "b", '[1,{"a":null,"z":1}]'), (1, "a", '"t\\"x"'), (2, "0", "1"), (2, "1", "[2]"), (2, "2", '"s"'), (3, "root", "7"), (4, "root", "{broken"), (5, "root", ""), (9, "root", "null"), (1, "b", "2")])


def test_containing_equals_contains(spark):
    rng = random.Random(3)
    texts = [(i, "".join(rng.choice("ab \néc") for _ in range(rng.randrange(60)))) for i in range(120)] + [(900, None), (901, ""), (902, "ab" * 20_000)]
    needles = [(i, "".join(rng.choice("ab \néc") for _ in range(rng.randrange(6)))) for i in range(60)] + [(900, None), (901, ""), (902, "zzz"), (903, "a(.*")]
    t, n = spark.createDataFrame(texts, "id int, text string"), spark.createDataFrame(needles, "needle_id int, needle string")
    got = sorted(map(tuple, grams.containing(n, t, grams.postings(t)).collect()))
    assert got == sorted((i, k) for i, needle in needles for k, text in texts if needle is not None and text is not None and needle in text)


def test_an_index_of_one_search_holds_only_its_runs(spark):
    t = spark.createDataFrame([(1, "abcdefgh"), (2, "xbcdx"), (3, "zzzz"), (4, None)], "id int, text string")
    n = spark.createDataFrame([(1, "bcd"), (2, "defg"), (3, "z"), (4, None), (5, "qqq")], "needle_id int, needle string")
    index = grams.postings(t, n)
    assert sorted((r.gram, r.id) for r in index.collect()) == [("bcd", 1), ("bcd", 2), ("def", 1), ("efg", 1)]
    assert sorted(map(tuple, grams.containing(n, t, index).collect())) == [(1, 1), (1, 2), (2, 1), (3, 3)]


def versions_of(path):
    return {d: {f: os.path.getmtime(f"{path}/{d}/{f}") for f in os.listdir(f"{path}/{d}") if f.endswith(".parquet")} for d in os.listdir(path) if d.startswith("bucket=")}


def test_an_upsert_rewrites_only_the_buckets_that_it_touches(spark, tmp_path):
    path, schema = f"{tmp_path}/store", "id string, version long, text string"
    first = [(f"k{i}", 1, f"v{i}") for i in range(200)] + [("k1", 0, "older"), (None, 1, "no key")]
    assert 20 < store.put(spark.createDataFrame(first, schema), path, "id", 32) <= 32
    before = versions_of(path)
    assert store.put(spark.createDataFrame([("k7", 2, "new"), ("k8", 0, "late and older")], schema), path, "id", 32) <= 2
    assert sum(before[d] != now for d, now in versions_of(path).items()) <= 2
    assert store.delete(spark.createDataFrame([("k9", 5)], "id string, version long"), path, "id", 32) == 1
    store.put(spark.createDataFrame([("k9", 3, "older than its delete")], schema), path, "id", 32)
    assert store.put(spark.createDataFrame([], schema), path, "id", 32) == 0
    want = {f"k{i}": f"v{i}" for i in range(200) if i != 9} | {"k7": "new", None: "no key"}
    assert {r.id: r.text for r in store.rows(spark, path).collect()} == want


def test_a_budget_gathers_no_text_beyond_it(spark):
    from tidemark.operators import graph

    rows = spark.createDataFrame([(None, "n" * 5), (3, "c" * 10), (1, "a" * 10), (2, " "), (2, "b" * 10), (9, "z" * 50)], "source_pos int, text string")
    assert [(r.source_pos, r.text) for r in graph.budgeted(rows, 18).orderBy("source_pos").collect()] == [(None, "nnnnn"), (1, "a" * 10), (2, "bbb")]
    assert [(r.source_pos, r.text) for r in graph.budgeted(rows, 4).collect()] == [(None, "nnnn")]
    assert graph.budgeted(rows.where("source_pos = 2 and text = ' '"), 4).count() == 0
