"""Conversations: latest versions, titles, tails, upserts and deletes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.config import SETTINGS
from tidemark.functions import text as t


def title(turns: DataFrame, key: str = "conv_id", first_source: str | None = None) -> DataFrame:
    """key, title, message_count, has_user_message of ``turns`` (key, turn, role, text): the first user message with text, on one line, cut to 60 characters.

    ``first_source``: a column with the name of a conversation's first source, which is the title where no user said anything.
    """
    named = F.substring(F.max(first_source), 1, 60) if first_source else F.lit(None).cast("string")
    said = (F.col("role") == "user") & t.filled(F.col("text"))
    first = F.min_by(F.when(said, F.substring(F.replace(t.strip(F.col("text")), F.lit("\n"), F.lit(" ")), 1, 60)), F.when(said, F.col("turn")))
    return turns.groupBy(key).agg(F.coalesce(first, named, F.lit(t.NEW_CHAT)).alias("title"), F.count("*").alias("message_count"), F.coalesce(F.bool_or(F.col("role") == "user"), F.lit(False)).alias("has_user_message"))


def version(saved: DataFrame) -> Column:
    """When a saved conversation was changed; timestamps are texts and compare as such."""
    return t.first_filled(F.col("updated_at"), F.col("saved_at"), F.col("modified_at"))


def latest(saved: DataFrame) -> DataFrame:
    """The newest row of each session; of equally new ones that of the first path."""
    w = Window.partitionBy("session_id").orderBy(F.desc("_v"), "path")
    return saved.where(t.filled(F.col("session_id"))).withColumn("_v", version(saved)).withColumn("_n", F.row_number().over(w)).where("_n = 1").withColumnRenamed("_v", "version").drop("_n")


def tail(turns: DataFrame, n: int, width: int, roles: tuple[str, ...] | None = None, key: str = "conv_id") -> DataFrame:
    """The last ``n`` turns of each conversation, texts cut to ``width``; roles are chosen after that."""
    w = Window.partitionBy(key).orderBy(F.desc("turn"))
    rows = turns.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= n).select(key, "turn", "role", F.substring("text", 1, width).alias("text"))
    return rows.where(F.col("role").isin(*roles)) if roles else rows


def planner_tail(turns: DataFrame) -> DataFrame:
    return tail(turns, *SETTINGS.planner_tail)


def chat_tail(turns: DataFrame) -> DataFrame:
    return tail(turns, *SETTINGS.chat_tail, ("user", "assistant"))


def upserted(stored: DataFrame, new: DataFrame) -> DataFrame:
    """One row per session of both: the newest, with the oldest creation time."""
    both = stored.unionByName(new, allowMissingColumns=True)
    created = both.groupBy("session_id").agg(F.min(t.first_filled(F.col("created_at"), F.col("saved_at"))).alias("created_at"))
    return latest(both).drop("created_at", "version").join(created, "session_id")


def without(stored: DataFrame, session: str) -> tuple[DataFrame, DataFrame]:
    """(what stays, one row n: how many rows go) when a session is deleted."""
    mine = F.coalesce(F.col("session_id") == session, F.lit(False))
    return stored.where(~mine), stored.where(mine).agg(F.count("*").alias("n"))


def archivable(saved: DataFrame) -> DataFrame:
    """Conversations worth keeping: with a source or a user message."""
    return saved.where((F.size("source_names") > 0) | F.exists("messages", lambda m: m["role"] == "user"))
