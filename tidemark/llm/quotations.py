"""Chat formatting by quotation linking, with DataFrame functions only.

The lines of a message are parsed for nested quote marks (">", as many as its level); consecutive lines of one level
are a passage. A quoted passage is normalised (marks and white space folded, letters lower-cased) and hashed to 128 bits, and the
hashes are joined to those of the lines and paragraphs that messages say themselves. The earliest message of the
conversation that says a passage before the quoting one is what it replies to; where none is found the message before
it is. Conversations come out in reply order, without the quoted lines and the lines that announce a quote ("Ann wrote:").

Reply order is that of a tree: after a message comes what answers it without a quote, the message after it, with all that follows from that; then
come those that answer it by a quote, in their order, each with what follows from it. So a thread is never torn apart, and a
conversation without quotes keeps its order. Messages that follow one another by number are one run; only quotes of other than the
message before begin a new one, and the places of nested runs are found in as many rounds as they are deep (none without quotes).

Defined results: null and empty texts stay as messages with empty text; a message that only quotes keeps an empty text;
repeated (conversation, turn) rows are told apart by role and text, equal rows are one; a message without a conversation is
one by itself; a null turn comes first; a passage that nobody said links to nothing; a line that ends in "wrote:" stays unless
a quote follows it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.llm.texts import stored

MARK = r"^[ \t]*((?:>[ \t]*)+)"
ATTRIBUTION = r"(?i)\b(wrote|schrieb|a écrit|escribió)\s*:\s*$"


def normalised(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), r"[\s>]+", " "))


def hashed(text: Column) -> Column:
    return F.unhex(F.md5(normalised(text)))


def lines_of(text: Column) -> Column:
    """array<struct<level int, line string>> without the lines that announce a quote: the next line that isn't blank is of a higher level."""
    lines = F.split(F.regexp_replace(F.coalesce(text, F.lit("")), r"\r\n?", "\n"), "\n")
    level = lambda x: F.length(F.regexp_replace(F.regexp_extract(x, MARK, 1), r"[^>]", ""))
    each = F.transform(lines, lambda x: F.struct(level(x).alias("level"), F.regexp_replace(x, MARK, "").alias("line")))

    def kept(all_lines: Column) -> Column:
        blank = lambda x: F.trim(x["line"]) == ""

        def announces(x: Column, i: Column) -> Column:
            one, two = F.get(all_lines, i + 1), F.get(all_lines, i + 2)
            after = F.when(blank(one) & (one["level"] == x["level"]), two).otherwise(one)
            return F.coalesce(x["line"].rlike(ATTRIBUTION) & (after["level"] > x["level"]), F.lit(False))

        return F.filter(all_lines, lambda x, i: ~announces(x, i))

    return F.get(F.transform(F.array(each), kept), F.lit(0))


def parsed(messages: DataFrame) -> DataFrame:
    """One row for each passage: conv, message, level (0: own words), run, passage."""
    each = messages.select("conv", "message", F.posexplode(lines_of(F.col("text"))).alias("part", "x")).select("conv", "message", "part", "x.*")
    w = Window.partitionBy("conv", "message").orderBy("part")
    new = F.when(F.lag("level").over(w).eqNullSafe(F.col("level")), 0).otherwise(1)
    runs = each.withColumn("new", new).withColumn("run", F.sum("new").over(w))
    return runs.groupBy("conv", "message", "level", "run").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part", "line"))), lambda x: x["line"]), "\n").alias("passage"))


def numbered(messages: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, conv (a key that is never null), message: the distinct messages, numbered within their conversation."""
    rows = messages.select("conv_id", "turn", "role", "text").distinct()
    alone = F.concat(F.lit("?"), F.hex(F.xxhash64("turn", "role", "text")))
    rows = rows.withColumn("conv", F.coalesce(F.concat(F.lit("="), F.col("conv_id").cast("string")), alone))
    return rows.withColumn("message", F.row_number().over(Window.partitionBy("conv").orderBy(F.col("turn").asc_nulls_first(), "role", "text")))


def said(passages: DataFrame) -> DataFrame:
    """conv, message, hash of each own passage, paragraph and line."""
    own = passages.where("level = 0").select("conv", "message", F.explode(F.array_distinct(F.concat(F.array("passage"), F.split("passage", r"\n\s*\n"), F.split("passage", "\n")))).alias("text"))
    return own.where(normalised(F.col("text")) != "").select("conv", "message", hashed(F.col("text")).alias("hash"))


def linked(messages: DataFrame) -> DataFrame:
    """conv, conv_id, turn, role, message, reply_to (message), quotes (passages that were found), text without quotes."""
    rows = numbered(messages)
    passages = parsed(rows)
    quoted = passages.where("level > 0").select("conv", "message", "level", F.explode(F.array_distinct(F.concat(F.array("passage"), F.split("passage", "\n")))).alias("quote"))
    quoted = quoted.select("conv", F.col("message").alias("quoting"), "level", hashed(F.col("quote")).alias("hash"), F.length(normalised(F.col("quote"))).alias("size")).where("size > 0")
    # the first message of a conversation that says a passage; summed up before the join, so a passage that many messages repeat is one row
    origin = said(passages).groupBy("conv", "hash").agg(F.min("message").alias("message"))
    found = quoted.join(origin, ["conv", "hash"]).where("message < quoting")
    # the outermost quote is what the message answers; of several, the longest
    reply = found.groupBy("conv", F.col("quoting").alias("message")).agg(F.count("*").alias("quotes"), F.max_by("message", F.struct(-F.col("level"), "size", "message")).alias("answered"))
    own = passages.where("level = 0").groupBy("conv", "message").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("run", "passage"))), lambda x: x["passage"]), "\n").alias("own"))
    clean = F.regexp_replace(F.regexp_replace(F.coalesce("own", F.lit("")), r"\n{3,}", "\n\n"), r"^\s+|\s+$", "")
    out = rows.join(own, ["conv", "message"], "left").join(reply, ["conv", "message"], "left")
    return out.select("conv", "conv_id", "turn", "role", "message", F.coalesce("answered", F.when(F.col("message") > 1, F.col("message") - 1)).cast("int").alias("reply_to"), F.coalesce("quotes", F.lit(0)).cast("long").alias("quotes"), clean.alias("text"))


def places(rows: DataFrame) -> DataFrame | None:
    """conv, run, path: for each run of messages that a quote began, where it stands in the tree; none if there is no such run.

    ``rows``: conv, message, run (its first message), reply_to. A step of a path is (1, less the answered message, first message of the run): what
    answers later messages of a run stands before what answers earlier ones.
    """
    at = rows.select("conv", F.col("message").alias("reply_to"), F.col("run").alias("under"))
    begun = rows.where("run = message and message > 1").select("conv", "run", "reply_to")
    if begun.isEmpty():
        return None
    begun = stored(begun.join(at, ["conv", "reply_to"]).select("conv", "run", "under", F.array(F.struct(F.lit(1).alias("kind"), (-F.col("reply_to")).alias("after"), F.col("run").alias("first"))).alias("path")))
    out = newest = begun.where("under = 1").select("conv", "run", "path")
    while True:
        newest = stored(begun.withColumnRenamed("path", "step").join(newest.select("conv", F.col("run").alias("under"), "path"), ["conv", "under"]).select("conv", "run", F.concat("path", "step").alias("path")))
        if newest.isEmpty():
            return out
        out = out.union(newest)


def conversations(messages: DataFrame) -> DataFrame:
    """One row per message in reply order: conv_id, position, turn, role, message, reply_to, quotes, text."""
    begins = F.when((F.col("message") == 1) | ((F.col("quotes") > 0) & (F.col("reply_to") < F.col("message") - 1)), F.col("message"))
    rows = linked(messages).withColumn("run", F.max(begins).over(Window.partitionBy("conv").orderBy("message")))
    found = places(rows)
    own = F.struct(F.lit(0).alias("kind"), F.col("message").alias("after"), F.lit(0).alias("first"))
    if found is None:
        place = rows.withColumn("path", F.array(own))
    else:
        place = rows.join(found, ["conv", "run"], "left").withColumn("path", F.concat(F.coalesce("path", F.array().cast("array<struct<kind:int,after:int,first:int>>")), F.array(own)))
    position = F.row_number().over(Window.partitionBy("conv").orderBy("path"))
    return place.withColumn("position", position).select("conv_id", "position", "turn", "role", "message", "reply_to", "quotes", "text")
