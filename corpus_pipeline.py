"""A training-data pipeline over documents: five stages, each applying one operator to all that the stage before kept."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import decontamination, jaccard, pieces, quality, toxicity
from tidemark.llm.queries import PIECES, table
from tidemark.llm.texts import fresh, stored


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents whose perplexity under the model of trusted text is above their language's limit, and empty ones (null, or white space only).

    Rows with a null id or a repeated one are judged each by its own text; a row without an id is never trusted. Without labels only empty ones go.
    """
    name = fresh("quality", docs)
    return quality.classify(docs, table(spark, sf_dir, "labels"), output=name).where(F.col(name)["keep"]).select(*docs.columns)


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the calibrated trees call toxic with a probability of at least one half.

    Rows are judged each by its own text, whatever its id; a null text counts as empty. Without labels nothing goes.
    """
    name = fresh("toxicity", docs)
    model = toxicity.train(toxicity.labelled_sample(docs, table(spark, sf_dir, "labels"), "toxic"))
    scored = docs.withColumn(name, toxicity.toxicity(F.col("text"), model, spark))
    return scored.where(F.col(name)["score"] < 0.5).select(*docs.columns)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each component of near duplicates (five-word shingles, Jaccard 0.8 or more): that with the smallest id.

    Rows are told apart by id and text, so rows that repeat an id with other text are documents of their own, and rows without an
    id, which come last, are compared like others. Of rows with equal id and text the one with the smallest other columns stays.
    Texts without words are like no other, so each of them stays.
    """
    row, name = F.xxhash64("doc_id", "text"), fresh("row", docs)
    found = jaccard.jaccard_components(docs.select(row.alias("doc_id"), "text"), size=5, percent=80)
    ids = docs.select(row.alias("row"), "doc_id").distinct()
    ranked = ids.join(found.select(F.col("doc_id").alias("row"), "component_id").distinct(), "row")
    first = ranked.groupBy("component_id").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row")).alias("x")).select(F.col("x.row").alias(name))
    kept = docs.withColumn(name, row).join(first, name, "left_semi")
    return kept.groupBy(name).agg(F.min(F.struct(*docs.columns)).alias("x")).select("x.*")


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes the words of benchmark windows from the texts, and documents of which no word is left.

    Rows are judged each by its own text, whatever its id; texts without a hit stay as they are, null and empty ones too.
    """
    name = fresh("hit", docs)
    found = docs.withColumn(name, decontamination.contamination(F.col("text"), table(spark, sf_dir, "benchmark"), cut=True))
    hit = F.col(name)
    left = found.where((hit["n_hit"] == 0) | (hit["n_hit"] < hit["n_words"]))
    text = F.coalesce(hit["left"], "text")
    return left.withColumn("text", text).withColumn("n_chars", F.char_length("text").cast("long")).select(*docs.columns)


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece numbers of each text, and whether they decode to it again; a null text has null numbers. Every row stays."""
    coded = docs.select("doc_id", "lang", "source", pieces.round_trip(F.col("text"), PIECES).alias("r"))
    return coded.select("doc_id", "lang", "source", "r.n_pieces", "r.ids", "r.exact")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality classifier", quality_stage),
    ("toxicity", toxicity_stage),
    ("n-gram Jaccard join", near_duplicate_stage),
    ("benchmark decontamination", decontamination_stage),
    ("SentencePiece encoding and decoding", encoding_stage),
]
#: Trained models and the closure of links can't be expressed in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stored(docs)
    return docs
