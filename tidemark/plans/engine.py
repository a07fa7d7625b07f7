"""From a question to evidence: resolve, plan, dispatch. Language models, embedders and rerankers are passed in and have defaults that need none."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.config import SETTINGS
from tidemark.operators import chunking, graph, resolver, retrieval, sources
from tidemark.plans import planner

INSUFFICIENT = "当前资料依据不足"
#: Fixed wordings of the prompts.
EVIDENCE_PROMPT = "Answer from the excerpts below and from nothing else, in the language of the question and in Markdown. Name the excerpts you use by their labels. If they don't hold the answer, say: 当前资料依据不足\n\n{context}"
CHAT_PROMPT = "Talk to the user in the language of the question. No documents are needed for this one."


def prompt(system: str, history: list[tuple[str, str]], question: str) -> list[tuple[str, str]]:
    """A prompt's messages: the system's, the history's of users and assistants, and the question."""
    return [("system", system), *(m for m in history if m[0] in ("user", "assistant")), ("user", question)]


PLACE = ("source_key", "doc_pos", "chunk_index")


@dataclass
class Hooks:
    """What can be plugged in; None takes the default named in brackets."""

    plan: Callable[[str, list[str], list[tuple[str, str]]], dict] | None = None  # a proposed plan for a question, candidate ids and the last messages [rules]
    answer: Callable[[list[tuple[str, str]]], str] | None = None  # an answer to a prompt: (role, text) messages [the context]
    embed: Callable[[Column], Column] | None = None  # a vector of a text [no dense ranking]
    rerank: Callable[[DataFrame], DataFrame] | None = None  # adds a column rerank [fused order]
    keep: Callable[[DataFrame], DataFrame] | None = None  # those of the hits that a model finds relevant [all]
    summarise: Callable[[str, str], str] | None = None  # a summary of a batch [overview lines]


@dataclass
class Result:
    operation: str
    answer: str
    source_ids: list[str] = field(default_factory=list)
    citations: DataFrame | None = None
    evidence_level: str = "none"
    missing: bool = False


class Engine:
    """A catalog of documents with its sources, chunks and index. Postings and vectors are made once, or read from a written index, and every question joins them."""

    def __init__(self, docs: DataFrame, session: str = "", hooks: Hooks | None = None, index: str | None = None) -> None:
        """``docs``: doc_pos, source, source_name, source_type, page, page_content. Importing replaces all that was there.

        ``index``: a folder that ``sinks.write_index`` wrote for the same documents with their source ids as keys; without one the index is kept in memory and disk of the executors.
        """
        self.spark: SparkSession = docs.sparkSession
        self.hooks = hooks or Hooks()
        self.records = sources.source_records(docs, session).persist()
        self.docs = sources.attach_sources(docs, self.records)
        if index is None:
            self.chunks, self.parents = chunking.chunk_tables(self.docs.withColumn("source_key", F.col("source_id")))
            self.chunks = self.chunks.persist()
            self.postings = retrieval.postings(self.chunks, False, *PLACE).persist()
            self.lengths = retrieval.lengths(self.chunks, False, *PLACE).persist()
            embed = self.hooks.embed
            self.vectors = None if embed is None else self.chunks.select("chunk_id", "source_key", embed(F.col("text")).alias("embedding")).persist()
        else:
            read = lambda name: self.spark.read.parquet(f"{index.rstrip('/')}/{name}")
            self.chunks, self.parents = read("chunks"), read("parents")
            self.postings, self.lengths = read("postings"), read("lengths")
            self.vectors = None if self.hooks.embed is None else read("vectors")

    def close(self) -> None:
        for held in (self.records, self.chunks, self.postings, self.lengths, self.vectors):
            if held is not None and held.is_cached:
                held.unpersist()

    def catalog(self) -> list[str]:
        return [r.source_id for r in self.records.orderBy("source_pos").select("source_id").collect()]

    def context(self, questions: DataFrame, source_ids: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
        """(hits with their metadata, expanded context) for a batch of ``questions`` (query_id, text)."""
        within = lambda table: table.where(F.col("source_key").isin(source_ids)) if source_ids else table
        scoped = within(self.chunks).withColumn("source_id", F.col("source_key"))
        lengths, packed = within(self.lengths), "block" in self.postings.columns  # as written ones are
        found = retrieval.bm25_indexed(questions, self.postings if packed else within(self.postings), retrieval.totals(lengths), place=PLACE[1:], chunks=lengths.drop("source_key") if packed else None)
        ranked = found.select("query_id", F.lit(1).alias("ranking"), "rank", "chunk_id")
        if self.vectors is not None:
            asked = questions.select("query_id", self.hooks.embed(F.col("text")).alias("embedding"))
            near = retrieval.dense(asked, within(self.vectors).select("chunk_id", "embedding"))
            ranked = ranked.unionByName(near.select("query_id", F.lit(0).alias("ranking"), "rank", "chunk_id"))
        hits = retrieval.filtered(retrieval.reranked(retrieval.fused(ranked), self.hooks.rerank), self.hooks.keep).where(F.col("rank") <= SETTINGS.final_n)
        grown = retrieval.expanded(hits, scoped, parents=self.parents)
        names = self.records.select(F.col("source_id").alias("source_key"), "source_name")
        meta = scoped.select("chunk_id", "source_key", "source_id", "text", "parent_id", "page_start", "page_end", "parent_page_start", "parent_page_end").join(F.broadcast(names), "source_key")
        parent = F.col("role") == "parent"
        rows = grown.join(meta, "chunk_id").join(self.parents, "parent_id", "left").select("query_id", "seq", "chunk_id", "role", "cost", "source_id", "source_name", F.col("source_name").alias("source"), F.lit(None).cast("int").alias("page"), F.when(parent, F.coalesce("parent_page_start", "page_start")).otherwise(F.col("page_start")).alias("page_start"), F.when(parent, F.coalesce("parent_page_end", "page_end")).otherwise(F.col("page_end")).alias("page_end"), F.when(parent, F.col("parent_content")).otherwise(F.col("text")).alias("text"))
        return hits, rows

    def named(self, names: list[str]) -> list[str]:
        """Ids of the sources with these names, in the catalog's order."""
        return [r.source_id for r in self.records.where(F.col("source_name").isin(names)).orderBy("source_pos").select("source_id").collect()]

    def source_tool(self, question: str, route: str | None = None, source_ids: list[str] | None = None) -> str:
        """What a question about the sources themselves asks for, by its keywords or a given route: their list, an overview or full texts; empty for others."""
        if route is None:
            route = self.spark.createDataFrame([(question,)], "q string").select(resolver.route(F.col("q")).alias("r")).first().r
        if route == "inventory":
            docs = self.docs if not source_ids else self.docs.where(F.col("source_id").isin(source_ids))
            return sources.inventory(sources.source_names(docs)).first().text
        if route in ("overview", "full_text"):
            return self.read(source_ids or self.catalog(), route, question)
        return ""

    def ask(self, question: str, active: list[str] | None = None, history: list[tuple[str, str]] | None = None, names: list[str] | None = None) -> Result:
        """One question; lists and full texts never touch the ranking.

        ``history``: earlier messages (role, text), of which the planner and the answerer get the last ones, cut; ``names``: names of sources that
        count as active where no ids are given.
        """
        catalog = self.catalog()
        active = list(active or []) or (self.named(names) if names else [])
        said = lambda n, width: [(role, text[:width]) for role, text in (history or [])[-n:]]
        asked = self.spark.createDataFrame([("q", question, active)], "question_id string, question string, active array<string>")
        found = resolver.resolved(asked, self.records.select("source_pos", "source_id", "source_name")).first()
        row = {"question_id": "q", "question": question, "catalog": catalog, "candidates": list(found.candidates), "resolved": list(found.source_ids), "active": active}
        shape = "question_id string, question string, catalog array<string>, candidates array<string>, resolved array<string>, active array<string>"
        plan = None
        if self.hooks.plan is not None:
            try:
                proposal = self.hooks.plan(question, list(found.candidates), said(*SETTINGS.planner_tail))
                fields = {k: None if proposal.get(k) is None else str(proposal[k]) for k in ("operation", "scope", "query", "read_mode", "confidence", "reason")}
                given = self.spark.createDataFrame([row | fields | {"source_ids": [str(x) for x in proposal.get("source_ids") or []]}], f"{shape}, operation string, scope string, query string, read_mode string, confidence string, reason string, source_ids array<string>")
                plan = planner.validated(given).where("valid").first()
            except Exception:  # noqa: BLE001 - a planner that fails is replaced by the rules
                plan = None
        if plan is None:
            by_rule = planner.fallback(self.spark.createDataFrame([row], shape)).first()
            plan = type("Plan", (), by_rule.asDict() | {"query": question, "read_mode": None})
        names = {r.source_id: r.source_name for r in self.records.select("source_id", "source_name").collect()}
        if plan.operation == "list_sources":
            return Result("list_sources", sources.inventory(sources.source_names(self.docs)).first().text)
        if plan.operation == "chat":
            return Result("chat", self.hooks.answer(prompt(CHAT_PROMPT, said(*SETTINGS.chat_tail), question)) if self.hooks.answer else "")
        if plan.scope == "selected" and not plan.source_ids:
            listed = self.spark.createDataFrame([([names[c] for c in found.candidates if c in names],)], "names array<string>")
            return Result(plan.operation, listed.select(planner.selection_answer(F.col("names")).alias("a")).first().a)
        planned = self.spark.createDataFrame([(list(plan.source_ids), active, catalog)], "p array<string>, a array<string>, c array<string>")
        used = list(planned.select(planner.sources_in_use(F.col("p"), F.col("a"), F.col("c")).alias("ids")).first().ids)
        if plan.operation == "read_source":
            return Result("read_source", self.read(used, plan.read_mode or "overview", question), used)
        _, rows = self.context(self.spark.createDataFrame([("q", plan.query)], "query_id string, text string"), used)
        cited = retrieval.citations(rows)
        text = retrieval.formatted(rows).first()
        answer = INSUFFICIENT if text is None else self.hooks.answer(prompt(EVIDENCE_PROMPT.format(context=text.context), history or [], question)) if self.hooks.answer else text.context
        level = retrieval.evidence(self.spark.createDataFrame([("q", "search", answer, cited.count())], "query_id string, operation string, answer string, n_citations long")).first()
        return Result("search", answer, used, cited, level.evidence_level, level.missing)

    def read(self, source_ids: list[str], mode: str, question: str = "") -> str:
        """Full texts or an overview of some sources: what is shown to a person, so it comes to the driver."""
        chosen = self.spark.createDataFrame([(s, i) for i, s in enumerate(source_ids)], "source_key string, rank int")
        if mode == "full_text":
            blocks = sources.full_text_blocks(self.docs, chosen).orderBy("rank", "section").select("text").toLocalIterator()
            return f"以下为 {len(source_ids)} 个来源的完整正文：\n" + "\n".join(b.text for b in blocks)
        if self.hooks.summarise is not None:
            return self.reduced(sources.summary_units(self.docs).join(F.broadcast(chosen), "source_key"), question)
        lines = sources.overview_lines(sources.profiles(self.docs).join(F.broadcast(chosen), "source_key").orderBy("rank")).collect()
        return "\n".join(x.line for x in lines)

    def reduced(self, units: DataFrame, question: str) -> str:
        """Summaries of bounded batches, and of these, until one is left; rounds end also when summaries no longer shrink."""
        order = F.row_number().over(retrieval.Window.orderBy("rank", "section", "unit"))
        texts = [r.text for r in chunking.bounded_batches(units.select(F.lit("all").alias("key"), order.alias("pos"), "text")).orderBy("batch").toLocalIterator()]
        while True:
            parts = [self.hooks.summarise(question, x) for x in texts]
            if len(parts) <= 1:
                return parts[0] if parts else ""
            rows = self.spark.createDataFrame([("all", i, p) for i, p in enumerate(parts)], "key string, pos int, text string")
            packed = [r.text for r in chunking.bounded_batches(rows).orderBy("batch").collect()]
            if len(packed) >= len(texts):
                return "\n\n".join(parts)
            texts = packed

    def graph(self, names: list[str], propose: Callable[[str], list[dict]] | None = None) -> DataFrame:
        """Triples of some sources: proposed ones that hold, or those of the rules."""
        wanted = self.spark.createDataFrame([(n,) for n in names], "source_name string")
        docs = self.docs.join(F.broadcast(wanted), "source_name", "left_semi")
        if propose is not None:
            try:
                told = graph.budgeted(docs.select(F.col("doc_pos").alias("source_pos"), F.col("page_content").alias("text"))).orderBy("source_pos").collect()
                given = propose("\n\n".join(r.text for r in told))
                rows = self.spark.createDataFrame([(i, *(str(x.get(k) or "") for k in ("subject", "predicate", "object", "source_name", "evidence"))) for i, x in enumerate(given)], "seq int, subject string, predicate string, object string, source_name string, evidence string")
                return graph.validated(rows, wanted).withColumnRenamed("seq", "triple_index")
            except Exception:  # noqa: BLE001 - rules stand in for a model that fails
                pass
        texts = graph.statements(docs.select(F.concat_ws("\x1f", "source_name", F.format_string("%012d", "doc_pos")).alias("source_name"), F.col("page_content").alias("text")))
        rows = texts.select(F.element_at(F.split("source_name", "\x1f"), 1).alias("source_name"), F.concat(F.element_at(F.split("source_name", "\x1f"), 2), F.lit("/"), F.format_string("%012d", "seq")).alias("seq"), "statement")
        return graph.triples(rows)
