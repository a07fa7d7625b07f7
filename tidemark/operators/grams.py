"""Search for texts that contain a given string, by postings of their runs of three characters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.small import small

#: Of each needle so many of its rarest runs are looked up; what has them all is then searched.
RAREST = 3


def grams(text: Column) -> Column:
    """The distinct runs of three characters of a text; none of a shorter one."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit("(?s)(?=(...))"), F.lit(1)))  # linear, where substrings by place are not


def postings(texts: DataFrame, needles: DataFrame | None = None) -> DataFrame:
    """gram, id of ``texts`` (id, text): to be written once, by gram. With ``needles`` (needle) only their grams, for an index of one search: most runs of a text are in none."""
    rows = texts.select("id", F.explode(grams(F.col("text"))).alias("gram"))
    return rows if needles is None else rows.join(small(needles.select(F.explode(grams(F.col("needle"))).alias("gram")).distinct()), "gram", "left_semi")


def containing(needles: DataFrame, texts: DataFrame, index: DataFrame, rarest: int = RAREST) -> DataFrame:
    """needle_id, id of every text that contains the needle (needle_id, needle), with upper and lower case told apart.

    A text that contains a needle has all of its runs, so those with its rarest runs are candidates, and only they are searched. Needles of one or two characters have
    no run and are searched for in all texts. An empty needle is in every text, a null one in none.
    """
    wanted = needles.select("needle_id", "needle", F.explode(grams(F.col("needle"))).alias("gram"))
    df = index.join(small(wanted.select("gram").distinct()), "gram", "left_semi").groupBy("gram").agg(F.count("*").alias("df"))
    ranked = wanted.join(df, "gram", "left").withColumn("n", F.row_number().over(Window.partitionBy("needle_id").orderBy(F.coalesce("df", F.lit(0)), "gram"))).where(F.col("n") <= rarest)
    ranked = ranked.withColumn("all", F.count("*").over(Window.partitionBy("needle_id")))
    found = index.join(small(ranked.select("needle_id", "needle", "gram", "all")), "gram").groupBy("needle_id", "needle", "all", "id").agg(F.count("*").alias("have")).where(F.col("have") == F.col("all"))
    checked = found.join(texts, "id").where(F.contains("text", F.col("needle"))).select("needle_id", "id")
    short = needles.where(F.char_length("needle") < 3)
    return checked.union(texts.join(small(short), F.contains(texts["text"], F.col("needle"))).select("needle_id", "id"))
