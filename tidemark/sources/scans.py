"""Scans: files, code folders, pages, saved conversations and graphs, as DataFrames with explicit positions."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from tidemark.config import SETTINGS
from tidemark.functions import text as t

#: What is read from code folders, and folders that are not.
CODE_SUFFIXES = ".py .js .jsx .ts .tsx .java .go .rs .cpp .c .h .cs .php .rb .md .txt .json .yaml .yml .toml .html .css .sql".split()
SKIPPED_FOLDERS = ".git .venv venv __pycache__ node_modules dist build docs-db tmp".split()
FILE_SUFFIXES = (".pdf", ".docx", ".md", ".txt")
#: Positions that one file has for its pages, and one part of a mixed scan for its documents: 2**23 parts of 2**40.
PAGES, PART = 1 << 16, 1 << 40
DOCUMENT = "doc_pos long, source string, source_name string, source_type string, page int, page_content string"


def _files(spark: SparkSession, path: str, recursive: bool = False) -> DataFrame:
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(path)
    name = F.regexp_extract("path", r"([^/]+)$", 1)
    return rows.select("path", "length", "content", name.alias("name"), F.lower(F.regexp_extract("path", r"(\.[^./]+)$", 1)).alias("suffix"))


@F.pandas_udf(T.StringType())
def _decoded(content: pd.Series) -> pd.Series:
    return content.map(lambda b: None if b is None else bytes(b).decode("utf-8", errors="ignore"))


@F.pandas_udf(T.StringType())
def _document_part(content: pd.Series) -> pd.Series:
    def part(raw: bytes) -> str:
        with zipfile.ZipFile(io.BytesIO(raw)) as z:
            return z.read("word/document.xml").decode("utf-8", errors="ignore")

    return content.map(lambda b: None if b is None else part(bytes(b)))


@F.pandas_udf(T.ArrayType(T.StructType([T.StructField("page", T.IntegerType()), T.StructField("text", T.StringType())])))
def _pdf_pages(content: pd.Series) -> pd.Series:
    try:
        from pypdf import PdfReader
    except ImportError as e:
        raise RuntimeError("reading PDF files needs the optional package pypdf") from e
    pages = lambda raw: [{"page": i, "text": p.extract_text() or ""} for i, p in enumerate(PdfReader(io.BytesIO(raw)).pages, 1)]
    return pd.Series([None if b is None else pages(bytes(b)) for b in content], dtype=object)


def _positioned(rows: DataFrame, paths: DataFrame) -> DataFrame:
    """doc_pos by path, then page: sorted, so that the order doesn't depend on the file system. Only ``paths`` (source) are numbered in one place; contents stay where they were read."""
    number = paths.withColumn("_file", (F.row_number().over(Window.orderBy("source")) - 1).cast("long"))
    placed = rows.join(number, "source").withColumn("doc_pos", F.col("_file") * PAGES + F.coalesce("page", F.lit(0)))
    return placed.select("doc_pos", "source", "source_name", "source_type", "page", "page_content")


def files(spark: SparkSession, path: str) -> DataFrame:
    """Documents of text, markdown, word-processor and PDF files; another suffix raises an error."""
    rows = _files(spark, path)
    kind = F.substring("suffix", 2, 9)
    texts = rows.where(F.col("suffix").isin(".md", ".txt")).select(F.col("path").alias("source"), F.col("name").alias("source_name"), kind.alias("source_type"), F.lit(None).cast("int").alias("page"), _decoded("content").alias("page_content"))
    docx = rows.where("suffix = '.docx'").select(F.col("path").alias("source"), F.col("name").alias("source_name"), kind.alias("source_type"), F.lit(None).cast("int").alias("page"), t.docx_text(_document_part("content")).alias("page_content"))
    pdf = rows.where("suffix = '.pdf'").select("path", "name", kind.alias("kind"), F.inline(_pdf_pages("content"))).where(t.filled(F.col("text"))).select(F.col("path").alias("source"), F.col("name").alias("source_name"), F.col("kind").alias("source_type"), "page", F.col("text").alias("page_content"))
    odd = rows.where(~F.col("suffix").isin(*FILE_SUFFIXES)).select(F.raise_error(F.concat(F.lit("unsupported file: "), "path")).cast("string").alias("source"), F.col("name").alias("source_name"), kind.alias("source_type"), F.lit(None).cast("int").alias("page"), F.lit("").alias("page_content"))
    return _positioned(texts.unionByName(docx).unionByName(pdf).unionByName(odd), rows.select(F.col("path").alias("source")))


def code_folder(spark: SparkSession, path: str) -> DataFrame:
    """Documents of a code tree: known suffixes, no skipped folders, no large or blank files, each under a line with its name."""
    root = path.rstrip("/") + "/"
    rows = _files(spark, path, recursive=True).where(F.col("length") <= SETTINGS.code_bytes).where(F.col("suffix").isin(*CODE_SUFFIXES))
    relative = F.regexp_extract("path", f"{''.join(f'[{c}]' if c in '.+()[]{}' else c for c in root.removeprefix('file:'))}(.*)$", 1)
    rows = rows.withColumn("rel", relative).where(~F.arrays_overlap(F.split("rel", "/"), F.array(*map(F.lit, SKIPPED_FOLDERS))))
    body = rows.select(F.col("path").alias("source"), F.col("rel").alias("source_name"), F.lit("code").alias("source_type"), F.lit(None).cast("int").alias("page"), _decoded("content").alias("body")).where(t.filled(F.col("body")))
    return _positioned(body.select("source", "source_name", "source_type", "page", F.concat(F.lit("文件: "), "source_name", F.lit("\n\n"), "body").alias("page_content")), rows.select(F.col("path").alias("source")))


def pages(fetched: DataFrame) -> DataFrame:
    """Documents of ``fetched`` (page_id, url, html), with the pages' texts; blank ones are left out."""
    rows = fetched.select(F.col("page_id").alias("doc_pos"), F.col("url").alias("source"), F.col("url").alias("source_name"), F.lit("url").alias("source_type"), F.lit(None).cast("int").alias("page"), t.html_to_text(F.col("html")).alias("page_content"))
    return rows.where(t.filled(F.col("page_content")))


def addresses(spark: SparkSession, urls: list[str], fetch: Callable[[str], str]) -> DataFrame:
    """Documents of addresses: ``fetch`` gets each address's candidates in order on the executors; the first text that is not blank counts, all failing raises an error."""
    asked = spark.createDataFrame([(i, u.strip()) for i, u in enumerate(urls) if u.strip()], "doc_pos long, url string")
    own = F.when(F.size(t.readme_candidates(F.col("url"))) > 0, t.readme_candidates(F.col("url"))).otherwise(F.array("url"))

    @F.pandas_udf("struct<fetched_url:string,html:string>")
    def first(candidates: pd.Series) -> pd.DataFrame:
        import html as h
        import re

        rows = []
        for options in candidates:
            errors, found = 0, (None, None)
            for url in options:
                try:
                    body = fetch(url)
                except Exception:  # noqa: BLE001 - any failure means the next candidate
                    errors += 1
                    continue
                if h.unescape(re.sub(r"(?is)<(script|style)[^>]*>.*?</\1>|<[^>]+>", " ", body)).strip():
                    found = (url, body)
                    break
            if errors == len(options):
                raise RuntimeError(f"none of {list(options)} could be read")
            rows.append(found)
        return pd.DataFrame(rows, columns=["fetched_url", "html"])

    rows = asked.select("doc_pos", "url", first(own).alias("f")).where("f.html is not null")
    return rows.select("doc_pos", F.col("url").alias("source"), F.col("url").alias("source_name"), F.lit("url").alias("source_type"), F.lit(None).cast("int").alias("page"), t.html_to_text(F.col("f.html")).alias("page_content"), "f.fetched_url")


def mixed(parts: list[DataFrame]) -> DataFrame:
    """Documents of several scans, one after the other; positions are (part, doc_pos) folded into one number. A part with a position of ``PART`` or more (16 million files, or a file of over 65535 pages) raises an error."""
    out = None
    for i, part in enumerate(parts):
        inside = F.when(F.col("doc_pos") < PART, F.col("doc_pos")).otherwise(F.raise_error(F.lit("a part has too many positions")))
        moved = part.withColumn("doc_pos", F.lit(i) * F.lit(PART) + inside)
        out = moved if out is None else out.unionByName(moved, allowMissingColumns=True)
    return out


def items(spark: SparkSession, given: list[str], fetch: Callable[[str], str]) -> DataFrame:
    """Documents of addresses, files and code folders in the order given; blank items are passed over, and one that is neither raises an error."""
    parts = []
    for item in filter(None, (x.strip() for x in given)):
        if item.startswith(("http://", "https://")):
            parts.append(addresses(spark, [item], fetch))
            continue
        path = spark._jvm.org.apache.hadoop.fs.Path(item)
        system = path.getFileSystem(spark._jsc.hadoopConfiguration())
        if not system.exists(path):
            raise ValueError(f"neither an address nor a file or folder: {item}")
        parts.append(code_folder(spark, item) if system.getFileStatus(path).isDirectory() else files(spark, item))
    if not parts:
        raise ValueError("nothing to read")
    return mixed(parts)


SAVED = "session_id string, title string, created_at string, updated_at string, saved_at string, source_names array<string>, messages array<struct<role:string,content:string>>"


def saved_conversations(spark: SparkSession, path: str) -> DataFrame:
    """Saved conversations; files that are no JSON object with a session are passed over."""
    schema = f"{SAVED}, _corrupt string"
    rows = spark.read.schema(schema).option("multiLine", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt").json(path)
    meta = rows.select("*", F.col("_metadata.file_path").alias("path"), F.date_format("_metadata.file_modification_time", "yyyy-MM-dd'T'HH:mm:ssXXX").alias("modified_at"))
    return meta.where(F.col("_corrupt").isNull() & t.filled(F.col("session_id"))).drop("_corrupt")


GRAPH = "schema_version int, generated_at string, source_names array<string>, extraction_mode string, error string, triples array<struct<subject:string,predicate:string,object:string,source_name:string,evidence:string>>"


def saved_graph(spark: SparkSession, path: str) -> DataFrame:
    """triple_index and the fields of each triple of a saved graph; a file without triples raises an error."""
    rows = spark.read.schema(GRAPH).option("multiLine", True).json(path)
    checked = F.when(F.col("triples").isNull(), F.raise_error(F.lit("not a knowledge graph"))).otherwise(F.col("triples"))
    return rows.select(F.posexplode(checked).alias("triple_index", "x")).select("triple_index", "x.*")


def vectors(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)
