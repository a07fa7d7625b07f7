"""Rule-based knowledge graphs: statements, triples, nodes with a layout, edges and exports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.config import SETTINGS
from tidemark.functions import text as t
from tidemark.operators.ranges import positions
from tidemark.operators.small import small

#: Patterns with their predicates, in order of precedence, and the colours of nodes.
PATTERNS = (
    (r"(.{2,40}?)(?:的)?作用是(.{2,60})", "作用是"),
    (r"(.{2,40}?)(?:的)?定义是(.{2,60})", "定义是"),
    (r"(.{2,40}?)(?:主要)?包括(.{2,80})", "包括"),
    (r"(.{2,40}?)(?:主要)?用于(.{2,60})", "用于"),
    (r"(.{2,40}?)(?:可以|可)(?:用于|产生)(.{2,60})", "可用于"),
    (r"(.{2,40}?)[是为](.{2,60})", "是"),
)
PALETTE = ("#2563eb", "#059669", "#dc2626", "#7c3aed", "#ea580c", "#0891b2", "#be123c")


def statements(texts: DataFrame) -> DataFrame:
    """source_name, seq, statement: sentences of ``texts`` (source_name, text) of 4 to 160 characters, without bullets and numbers."""
    parts = F.split(F.regexp_replace(F.coalesce("text", F.lit("")), r"[ \t]+", " "), r"[\n。；;]")
    line = t.strip(F.regexp_replace(F.btrim(F.col("raw"), F.lit(" \t\r\n-•·")), r"^\d+[.、)]\s*", ""))
    rows = texts.select("source_name", F.posexplode(parts).alias("seq", "raw")).select("source_name", "seq", line.alias("statement"))
    return rows.where(F.length("statement").between(4, 160))


def _objects(subject: Column, whole: Column, predicate: str) -> Column:
    parts = F.filter(F.transform(F.split(whole, "[、,，/和及与]"), t.clean_entity), lambda x: x != "")
    named = F.slice(F.when(F.size(parts) > 0, parts).otherwise(F.array(whole)), 1, SETTINGS.statement_objects)
    return F.transform(F.filter(named, lambda x: x != subject), lambda x: F.struct(subject.alias("subject"), F.lit(predicate).alias("predicate"), x.alias("object")))


def triples_of(statement: Column) -> Column:
    """array<struct<subject, predicate, object>>: of the first pattern that gives any."""
    options = []
    for pattern, predicate in PATTERNS:
        subject, whole = (t.clean_entity(F.regexp_extract(statement, f"(?d){pattern}", k)) for k in (1, 2))
        made = _objects(subject, whole, predicate)
        options.append(F.when((subject != "") & (whole != "") & (subject != whole), made).otherwise(F.slice(made, 1, 0)))
    return F.coalesce(F.get(F.filter(F.array(*options), lambda x: F.size(x) > 0), F.lit(0)), F.slice(options[0], 1, 0))


def triples(found: DataFrame, limit: int = SETTINGS.graph_triples) -> DataFrame:
    """triple_index, subject, predicate, object, source_name, evidence: the first ``limit`` distinct triples of ``found`` (seq, source_name, statement), where a graph is shown."""
    rows = found.select("seq", "source_name", F.col("statement").alias("evidence"), F.posexplode(triples_of(F.col("statement"))).alias("part", "x")).select("seq", "part", "source_name", "evidence", "x.*")
    first = rows.groupBy("subject", "predicate", "object", "source_name").agg(F.min(F.struct("seq", "part", "evidence")).alias("at"))
    kept = first.orderBy("at.seq", "at.part", "source_name").limit(limit)
    index = F.row_number().over(Window.orderBy("at.seq", "at.part", "source_name")) - 1  # over at most ``limit`` rows
    return kept.select(index.alias("triple_index"), "subject", "predicate", "object", "source_name", F.col("at.evidence").alias("evidence"))


def numbered_triples(found: DataFrame) -> DataFrame:
    """triple_index, subject, predicate, object, source_name: all distinct triples of ``found`` (seq, part, subject, predicate, object, source_name) in order of first mention."""
    first = found.groupBy("subject", "predicate", "object", "source_name").agg(F.min(F.struct("seq", "part")).alias("at"))
    rows = first.select("subject", "predicate", "object", "source_name", F.col("at.seq").alias("seq"), F.col("at.part").alias("part"))
    return positions(rows, ["seq", "part", "source_name", "subject", "predicate", "object"], "triple_index").select("triple_index", "subject", "predicate", "object", "source_name")


def validated(candidates: DataFrame, names: DataFrame, limit: int = SETTINGS.graph_triples) -> DataFrame:
    """Triples (seq, subject, predicate, object, source_name, evidence) that are filled and whose source is asked for, up to ``limit``."""
    full = candidates.where(t.filled(F.col("subject")) & t.filled(F.col("predicate")) & t.filled(F.col("object")))
    return full.join(small(names), "source_name", "left_semi").orderBy("seq").limit(limit)


def nodes(graph: DataFrame) -> DataFrame:
    """id, label, degree, x, y, radius, color: entities by falling degree on a grid. ``graph``: triple_index, subject, object, ..."""
    full = graph.where(t.filled(F.col("subject")) & t.filled(F.col("object")))
    ends = full.select("triple_index", F.explode(F.array(t.strip(F.col("subject")), t.strip(F.col("object")))).alias("label"))
    per = ends.groupBy("label").agg(F.count("*").alias("degree"), F.min("triple_index").alias("first_seen"))
    ranked = positions(per, [F.desc("degree"), "first_seen", "label"], "i")
    n = F.lit(ranked.count())
    placed = ranked.withColumn("cols", F.greatest(F.lit(2), F.least(F.lit(14), F.ceil(F.sqrt(n * 1.8)))).cast("int"))
    row, col = F.floor(F.col("i") / F.col("cols")), F.col("i") % F.col("cols")
    color = F.element_at(F.array(*map(F.lit, PALETTE)), (F.col("i") % len(PALETTE) + 1).cast("int"))
    return placed.select(F.concat(F.lit("n"), "i").alias("id"), "label", "degree", (150 + 280 * col + 70 * (row % 2)).cast("long").alias("x"), (110 + 170 * row).cast("long").alias("y"), F.least(F.lit(36), 20 + 3 * F.col("degree")).cast("long").alias("radius"), color.alias("color"))


def edges(graph: DataFrame, found: DataFrame) -> DataFrame:
    """id, source, target, label, source_name, evidence between ``found`` (nodes)."""
    ids = found.select("id", F.col("label").alias("_label"))
    full = graph.where(t.filled(F.col("predicate"))).withColumns({"_s": t.strip(F.col("subject")), "_o": t.strip(F.col("object"))})
    a, b = ids.select(F.col("id").alias("source"), F.col("_label").alias("_s")), ids.select(F.col("id").alias("target"), F.col("_label").alias("_o"))
    return full.join(small(a), "_s").join(small(b), "_o").select(F.concat(F.lit("e"), "triple_index").alias("id"), "source", "target", t.strip(F.col("predicate")).alias("label"), "source_name", "evidence")


def entity_counts(graph: DataFrame) -> DataFrame:
    ends = graph.select("triple_index", F.explode(F.array("subject", "object")).alias("label")).where(t.filled(F.col("label")))
    return ends.agg(F.count_distinct("label").alias("n_entities"), F.count_distinct("triple_index").alias("n_relations"))


def _escaped(x: Column) -> Column:
    return F.replace(F.replace(F.replace(x, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit("\n"), F.lit(" "))


def dot(graph: DataFrame) -> DataFrame:
    """One row, dot: the graph in the DOT language, nodes in order of first mention. A displayed graph has few triples."""
    ends = graph.select("triple_index", F.posexplode(F.array(t.strip(F.coalesce("subject", F.lit(""))), t.strip(F.coalesce("object", F.lit(""))))).alias("side", "label")).where("label <> ''")
    first = ends.groupBy("label").agg(F.min(F.struct("triple_index", "side")).alias("at"))
    numbered = first.withColumn("i", F.row_number().over(Window.orderBy("at")) - 1)
    ids = numbered.select("label", F.concat(F.lit("n"), "i").alias("id"))
    node_lines = numbered.select(F.lit(0).alias("kind"), F.col("i").cast("long").alias("pos"), F.concat(F.lit("n"), "i", F.lit(' [label="'), _escaped(F.col("label")), F.lit('"];')).alias("line"))
    a, b = ids.select(F.col("label").alias("_s"), F.col("id").alias("a")), ids.select(F.col("label").alias("_o"), F.col("id").alias("b"))
    full = graph.where(t.filled(F.col("predicate"))).withColumns({"_s": t.strip(F.col("subject")), "_o": t.strip(F.col("object"))})
    edge_lines = full.join(a, "_s").join(b, "_o").select(F.lit(1).alias("kind"), F.col("triple_index").cast("long").alias("pos"), F.concat("a", F.lit(" -> "), "b", F.lit(' [label="'), _escaped(t.strip(F.col("predicate"))), F.lit('"];')).alias("line"))
    body = node_lines.union(edge_lines).agg(F.array_sort(F.collect_list(F.struct("kind", "pos", "line"))).alias("x"))
    head = ["digraph KnowledgeGraph {", "rankdir=LR;", 'node [shape=box, style="rounded,filled", fillcolor="#f8fafc", color="#94a3b8"];', 'edge [color="#64748b"];']
    return body.select(F.array_join(F.concat(F.array(*map(F.lit, head)), F.transform("x", lambda v: v["line"]), F.array(F.lit("}"))), "\n").alias("dot"))


def payload(found: DataFrame, linked: DataFrame) -> DataFrame:
    """One row, json: nodes and edges for a viewer."""
    n = found.agg(F.array_sort(F.collect_list(F.struct("*"))).alias("nodes"))
    e = linked.agg(F.array_sort(F.collect_list(F.struct("*"))).alias("edges"))
    return n.join(e).select(F.to_json(F.struct("nodes", "edges")).alias("json"))


def neighbours(linked: DataFrame) -> DataFrame:
    """id, neighbour: each node of an edge with itself and what edges join it with, in either direction."""
    pairs = F.explode(F.array(*(F.struct(F.col(a).alias("id"), F.col(b).alias("neighbour")) for a, b in (("source", "target"), ("target", "source"), ("source", "source"), ("target", "target")))))
    return linked.select(pairs.alias("p")).select("p.*").distinct()


def search(found: DataFrame, linked: DataFrame, needle: str, limit: int = 40) -> DataFrame:
    """kind, id, label: nodes by label, then edges by label, source and evidence, that hold the needle in any case."""
    low = needle.strip().lower()
    hit = lambda *cs: F.contains(F.lower(F.concat_ws(" ", *cs)), F.lit(low))
    n = found.where(hit("label")).select(F.lit("node").alias("kind"), "id", "label", F.substring("id", 2, 12).cast("long").alias("pos"))
    e = linked.where(hit("label", "source_name", "evidence")).select(F.lit("relation").alias("kind"), "id", "label", F.substring("id", 2, 12).cast("long").alias("pos"))
    return n.union(e).orderBy("kind", "pos").limit(limit).drop("pos")


def budgeted(texts: DataFrame, budget: int = SETTINGS.graph_text) -> DataFrame:
    """source_pos, text: as much of the sources' texts (source_pos, text) in order as the budget of characters allows.

    Each text adds a character, so only the first ``budget`` texts can matter. Their places and lengths alone are ordered first, to find the last place
    that counts; only texts up to there are gathered.
    """
    full = texts.where(t.filled(F.col("text")))
    running = Window.orderBy("source_pos").rowsBetween(Window.unboundedPreceding, -1)
    first = full.select("source_pos", F.length("text").alias("n")).orderBy("source_pos").limit(budget)
    last = first.withColumn("before", F.coalesce(F.sum("n").over(running), F.lit(0))).where(F.col("before") < budget).agg(F.max("source_pos")).first()[0]
    near = F.col("source_pos").isNull() if last is None else F.col("source_pos").isNull() | (F.col("source_pos") <= F.lit(last))
    head = full.where(near).orderBy("source_pos").limit(budget)
    before = F.coalesce(F.sum(F.length("text")).over(Window.orderBy("source_pos").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return head.withColumn("left", F.lit(budget) - before).where("left > 0").select("source_pos", F.substring("text", F.lit(1), F.col("left").cast("int")).alias("text"))
