from __future__ import annotations

import re
import time

from pyspark.sql import functions as F

from tidemark.llm import syncmers


def test_places_of_a_long_text_are_intersected_at_once(spark):
    text = " ".join(f"w{i * 7919 % 99991}" for i in range(60_000))
    rows = spark.createDataFrame([(text, text[:200_000] + " other " + text[200_007:])], "a string, b string")
    began = time.perf_counter()
    r = rows.select(syncmers.anchors(F.col("a")).alias("a"), syncmers.anchors(F.col("b")).alias("b")).select(F.size("a").alias("n"), syncmers.aligned(F.col("a"), F.col("b")).alias("same")).first()
    assert 0 < r.same < r.n and time.perf_counter() - began < 20


def test_symbols_are_the_same_by_the_short_way(spark):
    texts = ["abcdef gh é1xy", "图像ab图abc", "aé bcde 中d efgh\tij", "", "~~~!x\x7fabc ñandú"]
    rows = spark.createDataFrame([(x,) for x in texts], "x string")
    plain = syncmers.SYMBOL.removeprefix("[!-~]{3}|")
    assert re.match(r"\[\\p", plain)
    both = rows.select(F.regexp_extract_all("x", F.lit(syncmers.SYMBOL), F.lit(0)).alias("a"), F.regexp_extract_all("x", F.lit(plain), F.lit(0)).alias("b")).collect()
    assert all(r.a == r.b for r in both)
