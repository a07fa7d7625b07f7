"""Source records, their attachment to documents, profiles and the texts made of them."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.config import SETTINGS
from tidemark.functions import text as t
from tidemark.operators.ranges import positions
from tidemark.operators.small import small


def source_name(docs: DataFrame) -> Column:
    return t.first_filled(F.col("source_name"), F.col("source"), F.lit(t.UNNAMED))


def source_names(docs: DataFrame) -> DataFrame:
    """name, first_pos: distinct names, to be ordered by where they come first."""
    return docs.groupBy(source_name(docs).alias("name")).agg(F.min("doc_pos").alias("first_pos"))


def keyed(docs: DataFrame) -> DataFrame:
    name = source_name(docs)
    return docs.withColumns({"_name": name, "_path": t.first_filled(F.col("source"), name), "_type": F.lower(t.first_filled(F.col("source_type"), F.lit("unknown")))})


def source_records(docs: DataFrame, session: str = "") -> DataFrame:
    """One row per source: source_pos, source_id, source_name, source_type, session_id, file_hash, source_path, n_pages.

    The hash runs over a source's contents in order, so its rows are sorted and read once as a stream; memory doesn't
    grow with the source.
    """
    rows = keyed(docs).select("_path", "_name", "_type", "doc_pos", F.coalesce("page_content", F.lit("")).alias("content"))

    def digest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, h, first, n = None, None, 0, 0
        for part in batches:
            for row in part.itertuples(index=False):
                if row[:3] != key:
                    if key is not None:
                        yield pd.DataFrame([(*key, h.hexdigest(), first, n)], columns=["_path", "_name", "_type", "file_hash", "first_pos", "n_pages"])
                    key, h, first, n = row[:3], hashlib.sha256(), row.doc_pos, 0
                else:
                    h.update(b"\x1e")
                h.update(row.content.encode())
                n += 1
        if key is not None:
            yield pd.DataFrame([(*key, h.hexdigest(), first, n)], columns=["_path", "_name", "_type", "file_hash", "first_pos", "n_pages"])

    schema = "_path string, _name string, _type string, file_hash string, first_pos long, n_pages long"
    # names of columns are given without the underscore in Python rows
    renamed = rows.toDF("path", "name", "kind", "doc_pos", "content")
    hashed = renamed.repartition("path", "name", "kind").sortWithinPartitions("path", "name", "kind", "doc_pos").mapInPandas(digest, schema)
    identity = t.source_identity(F.col("_type"), F.col("_path"))
    id_ = F.concat(F.lit("src_"), F.substring(F.sha2(F.concat("file_hash", F.lit("\x1f"), identity), 256), 1, 20))
    placed = positions(hashed, ["first_pos", "_path", "_name", "_type"], "source_pos")
    return placed.select("source_pos", id_.alias("source_id"), F.col("_name").alias("source_name"), F.col("_type").alias("source_type"), F.lit(session).alias("session_id"), "file_hash", F.col("_path").alias("source_path"), "n_pages")


def attach_sources(docs: DataFrame, records: DataFrame) -> DataFrame:
    """``docs`` with the source_id of their record: by path, name and type, else by name and type where only one record has them.

    A document without a record raises an error when its row is computed.
    """
    by_all = records.select(F.col("source_path").alias("_path"), F.col("source_name").alias("_name"), F.col("source_type").alias("_type"), F.col("source_id").alias("_exact"))
    by_name = records.groupBy(F.col("source_name").alias("_name"), F.col("source_type").alias("_type")).agg(F.min("source_id").alias("_only"), F.count_distinct("source_id").alias("_n")).where("_n = 1").drop("_n")
    joined = keyed(docs).join(by_all, ["_path", "_name", "_type"], "left").join(by_name, ["_name", "_type"], "left")
    found = F.coalesce("_exact", "_only", F.raise_error(F.concat(F.lit("no source record for "), F.col("_name"))))
    return joined.withColumn("source_id", found).drop("_path", "_name", "_type", "_exact", "_only")


def sections(docs: DataFrame) -> DataFrame:
    """source_key, section (0-based order), page, content: the non-empty pages of each source, numbered pages first."""
    key = t.first_filled(F.col("source_id"), source_name(docs))
    # what is left of a page is empty where it has white space only: asked of the page, so that its text is made once
    rows = docs.where(t.filled(F.col("page_content"))).select(key.alias("source_key"), source_name(docs).alias("name"), F.col("page").try_cast("int").alias("page"), "doc_pos", t.full_text(F.col("page_content")).alias("content"))
    order = Window.partitionBy("source_key").orderBy(F.col("page").asc_nulls_last(), "doc_pos")
    return rows.withColumn("section", F.row_number().over(order) - 1)


def profiles(docs: DataFrame, excerpt: int = SETTINGS.excerpt) -> DataFrame:
    """source_key, name, n_sections, excerpt. Each section adds a character at least, so no more sections than characters are gathered for the excerpt."""
    parts = sections(docs)
    totals = docs.groupBy(t.first_filled(F.col("source_id"), source_name(docs)).alias("source_key")).agg(F.min_by(source_name(docs), "doc_pos").alias("name"), F.count(F.when(t.filled(F.col("page_content")), 1)).alias("n_sections"))
    head = parts.where(F.col("section") < excerpt).withColumn("content", F.substring("content", 1, 2 * excerpt))
    gathered = head.groupBy("source_key").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("section", "content"))), lambda x: x["content"]), "\n").alias("joined"))
    cut = F.substring(t.clean_text(F.col("joined")), 1, excerpt)
    return totals.join(gathered, "source_key", "left").select("source_key", "name", "n_sections", F.coalesce(cut, F.lit("")).alias("excerpt"))


def summary_units(docs: DataFrame, width: int = SETTINGS.summary_unit) -> DataFrame:
    """source_key, section, unit (0-based), text: slices of each section under a label with its source and page."""
    label = F.concat(F.lit("Source: "), "name", F.lit("; Page: "), F.coalesce("page", F.col("section") + 1), F.lit("\n"))
    return sections(docs).select("source_key", "section", F.posexplode(t.pieces(F.col("content"), width)).alias("unit", "piece"), label.alias("label")).select("source_key", "section", "unit", F.concat("label", "piece").alias("text"))


def inventory(names: DataFrame) -> DataFrame:
    """One row, text: the catalog as a list. ``names``: name, first_pos."""
    rows = names.agg(F.count("*").alias("n"), F.array_sort(F.collect_list(F.struct("first_pos", "name"))).alias("all"))
    lines = F.array_join(F.transform("all", lambda x: F.concat(F.lit("- "), x["name"])), "\n")
    return rows.select(F.when(F.col("n") == 0, "当前还没有导入资料。").otherwise(F.concat(F.lit("当前已导入 "), "n", F.lit(" 个来源：\n\n"), lines)).alias("text"))


def overview_lines(found: DataFrame, limit: int = SETTINGS.overview_line) -> DataFrame:
    """name, line: one line on each source of ``found`` (profiles)."""
    about = t.trim_sentence(t.first_filled(F.col("excerpt"), t.inferred_title(F.col("name"))), limit)
    return found.select("name", F.concat(F.lit("- **"), "name", F.lit("**："), about).alias("line"))


def full_text_blocks(docs: DataFrame, selected: DataFrame) -> DataFrame:
    """source_key, section, text: the headed sections of the selected sources (source_key, rank), in order of rank and section; never cut."""
    parts = sections(docs).join(small(selected), "source_key")
    n = F.count("*").over(Window.partitionBy("source_key"))
    head = F.when(F.col("page").isNotNull(), F.concat(F.lit("\n## 第 "), "page", F.lit(" 页\n"))).when(n > 1, F.concat(F.lit("\n## 第 "), F.col("section") + 1, F.lit(" 部分\n"))).otherwise("")
    title = F.when(F.col("section") == 0, F.concat(F.lit("\n# "), "name", F.lit("\n"))).otherwise("")
    return parts.select("source_key", "rank", "section", F.concat(title, head, F.lit("\n"), "content").alias("text"))


def matching_profiles(questions: DataFrame, catalog: DataFrame) -> DataFrame:
    """question_id, name: sources of which a part of the name stands in the question; all sources where none does."""
    stem = F.regexp_replace("name", r"\.[A-Za-z0-9]+$", "")
    parts = F.regexp_extract_all(stem, F.lit(r"[A-Za-z]+|[一-鿿]{2,}"), F.lit(0))
    pairs = questions.join(small(catalog.select("name", parts.alias("parts"))))
    hit = F.exists("parts", lambda p: F.contains(F.col("_compact"), t.compact(p)))
    scored = pairs.withColumn("_compact", t.compact(F.col("question"))).withColumn("hit", hit)
    some = F.max("hit").over(Window.partitionBy("question_id"))
    return scored.withColumn("some", some).where("hit or not some").select("question_id", "name")
