"""What to do with a question: plans proposed by a model are validated, and rules plan without one. Batches of questions are rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPERATIONS = ("chat", "list_sources", "read_source", "search")
SCOPES = ("auto", "none", "selected", "active", "all")
READ_MODES = ("overview", "full_text")
NO_IDS = "array<string>"
#: Fixed wordings.
UNCLEAR = "无法确定你指的是哪份资料，请明确资料名称后再试。"
CHOOSE = "无法确定你指的是哪份资料，请选择：\n"


def _within(ids: Column, allowed: Column) -> Column:
    return F.array_distinct(F.filter(F.coalesce(ids, F.array().cast(NO_IDS)), lambda x: F.array_contains(allowed, x)))


def validated(plans: DataFrame) -> DataFrame:
    """question_id, valid, operation, scope, source_ids, query, read_mode, confidence, reason.

    ``plans``: question_id, question, catalog, candidates, resolved, active (arrays of ids) and the proposal: operation, scope,
    source_ids, query, read_mode, confidence (text), reason. A proposal can't bring in an id that is not a candidate.
    """
    c = {name: F.trim(F.coalesce(F.col(name), F.lit(""))) for name in ("operation", "scope", "query", "read_mode", "reason")}
    known = F.array_distinct("catalog")
    reads = c["operation"].isin("read_source", "search")
    chosen = _within(F.transform("source_ids", lambda x: F.trim(x)), F.col("candidates"))
    resolved = _within(F.col("resolved"), known)
    pick = F.when(F.size(resolved) > 0, resolved).otherwise(chosen)
    said = F.when(c["scope"].isin(*SCOPES), c["scope"]).otherwise("auto")
    unsure = (F.size("candidates") > 0) & (F.size(chosen) == 0)
    scope = F.when(~reads, "none").when((F.size(resolved) > 0) | unsure, "selected").otherwise(said)
    rows = plans.withColumns({"_pick": pick, "_scope": scope, "_known": known, "_active": _within(F.col("active"), known)})
    open_ = (F.size("_pick") == 0) & (F.size("candidates") == 0)
    scoped = F.when(~reads, F.array().cast(NO_IDS)).when(F.col("_scope") == "all", F.col("_known")).when(F.col("_scope") == "active", F.when(F.size("_active") > 0, F.col("_active")).otherwise(F.col("_known"))).when(open_, F.col("_known")).otherwise(F.col("_pick"))
    final = F.when(reads & ~F.col("_scope").isin("all", "active") & open_, "all").otherwise(F.col("_scope"))
    mode = F.when(c["operation"] == "read_source", F.when(c["read_mode"].isin(*READ_MODES), c["read_mode"]).otherwise("overview"))
    query = F.when((c["operation"] == "search") & (c["query"] != ""), c["query"]).otherwise(F.col("question"))
    sure = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.coalesce(F.col("confidence").try_cast("double"), F.lit(0.0))))
    return rows.select("question_id", c["operation"].isin(*OPERATIONS).alias("valid"), c["operation"].alias("operation"), final.alias("scope"), scoped.alias("source_ids"), query.alias("query"), mode.alias("read_mode"), sure.alias("confidence"), c["reason"].alias("reason"))


def fallback(plans: DataFrame) -> DataFrame:
    """question_id, operation, scope, source_ids, reason without a model. ``plans``: question_id, catalog, candidates, resolved, active."""
    known = F.array_distinct("catalog")
    resolved, active, unsure = (_within(F.col(x), known) for x in ("resolved", "active", "candidates"))
    none = F.array().cast(NO_IDS)
    case = lambda *v: F.when(F.size(known) == 0, v[0]).when(F.size(resolved) > 0, v[1]).when(F.size(unsure) > 0, v[2]).otherwise(v[3])
    lit = lambda *v: case(*map(F.lit, v))
    reasons = ("planner fallback without sources", "planner fallback on resolved sources", "planner fallback awaiting source selection", "planner fallback on available sources")
    return plans.select("question_id", lit("chat", "search", "search", "search").alias("operation"), lit("auto", "selected", "selected", "auto").alias("scope"), case(none, resolved, none, F.when(F.size(active) > 0, active).otherwise(known)).alias("source_ids"), lit(*reasons).alias("reason"))


def sources_in_use(planned: Column, active: Column, catalog: Column) -> Column:
    """Planned sources of the catalog, else active ones, else all."""
    a, b = _within(planned, catalog), _within(active, catalog)
    return F.when(F.size(a) > 0, a).when(F.size(b) > 0, b).otherwise(F.array_distinct(catalog))


def selection_answer(names: Column) -> Column:
    lines = F.array_join(F.transform(F.array_distinct(names), lambda n: F.concat(F.lit("- "), n)), "\n")
    return F.when(F.size(names) == 0, UNCLEAR).otherwise(F.concat(F.lit(CHOOSE), lines))
