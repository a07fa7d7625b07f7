from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import text as t
from tidemark.queries import QUERIES


def test_a_reference_without_its_semicolon_stays(spark, tmp_path):
    spark.createDataFrame([(1, "<p>a &amp; b &quot;&copy;&quot; c &am</p>"), (2, "<p>a &amp</p>"), (3, None)], "page_id long, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = {r.page_id: r.text for r in QUERIES["html_to_text"](spark, str(tmp_path)).collect()}
    assert got == {1: 'a & b "©" c &am', 2: "a &amp", 3: None}
    assert spark.createDataFrame([("a &amp",)], "x string").select(t.html_to_text(F.col("x")).alias("y")).first().y == "a &"


def test_blank_pages_are_no_sections(spark):
    from tidemark.operators import sources

    rows = [(i, "s", "s", "txt", None, x, None) for i, x in enumerate([" \n", None, "a  b", "　\t", "c\r\n\n\n\nd"])]
    docs = spark.createDataFrame(rows, "doc_pos int, source string, source_name string, source_type string, page int, page_content string, source_id string")
    assert [(r.section, r.content) for r in sources.sections(docs).orderBy("section").collect()] == [(0, "a b"), (1, "c\n\nd")]
    assert [(r.n_sections, r.excerpt) for r in sources.profiles(docs).collect()] == [(2, "a b c d")]


def test_texts_are_stripped_as_by_python_and_only_their_ends_are_looked_at(spark):
    spaces = [chr(c) for c in range(0x110000) if chr(c).isspace()]
    texts = [None, "", " ", "".join(spaces), *(f"{c}a{c}b{c}" for c in spaces), "\u200bx\u200b", "\U0001d4b3 \r\n"]
    stripped = spark.createDataFrame([(x,) for x in texts], "x string").select("x", t.strip(F.col("x")).alias("y"))
    assert all(r.y == (None if r.x is None else r.x.strip()) for r in stripped.collect())
    assert "regexp_replace" not in stripped._jdf.queryExecution().analyzed().toString()
