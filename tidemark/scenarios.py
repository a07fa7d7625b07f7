"""Queries that write what they read: files, an index, conversations and graphs in a folder of their own, and questions to an engine.

Three scans of small folders and addresses have rows worked out by hand as their SQL. The folder is made under ``spark.checkpoint.dir``, which all executors share; only where
that is unset, as in a local session, is it a temporary one.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.given import given, given_sql
from tidemark.operators import chunking, history, resolver, retrieval
from tidemark.operators.ranges import stored
from tidemark.plans import engine as engines
from tidemark.plans import planner
from tidemark.plans.engine import Engine, Hooks
from tidemark.queries import FUSED, LATIN, ORACLE, RANKINGS, as_documents, as_questions, hand_worked, kg_triples, query, rrf_fusion, table
from tidemark.sources import scans, sinks
from tidemark.table_queries import CHUNKS


def workspace(spark: SparkSession) -> str:
    """A new folder for one run."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root is None and spark.sparkContext.master.split("[")[0] != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return f"{(root or tempfile.mkdtemp(prefix='scenario-')).rstrip('/')}/{uuid.uuid4().hex}"


#: Documents of a file, and conversations of one.
TOGETHER = 200


def one_file_a_row(rows: DataFrame, at: str) -> None:
    """Writes each text (value) as a file of its own."""
    rows.write.option("maxRecordsPerFile", 1).text(at)


@query(f"select count(*) as n_documents, sha256(string_agg(text, chr(10) order by doc_id) || chr(10)) as content_sha256 from (select doc_id, coalesce(text, '') as text from documents) group by floor(doc_id / {TOGETHER})")
def scan_files(spark, sf_dir):
    """The documents as text files of ``TOGETHER`` each, written and read again."""
    at = workspace(spark)
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text")).groupBy(F.floor(F.col("doc_id") / TOGETHER).alias("g"))
    joined = docs.agg(F.array_sort(F.collect_list(F.struct("doc_id", "text"))).alias("x")).select(F.size("x").alias("n"), F.array_join(F.transform("x", lambda v: v["text"]), "\n").alias("value"))
    joined = stored(joined)
    one_file_a_row(joined.select("value"), at)
    read = scans.files(spark, at).select(F.sha2("page_content", 256).alias("content_sha256"))
    return read.join(joined.select(F.col("n").cast("long").alias("n_documents"), F.sha2(F.concat("value", F.lit("\n")), 256).alias("content_sha256")), "content_sha256", "left")


CODE = [("main.py", "文件: main.py\n\nx = 1\n"), ("sub/notes.md", "文件: sub/notes.md\n\nhi")]


@query(hand_worked(CODE, "source_name varchar, page_content varchar"))
def scan_code_folder(spark, sf_dir):
    at = workspace(spark)
    for folder, files in (("", {"main.py": b"x = 1\n", "tool.exe": b"no", "blank.py": b" \n", "large.sql": b"x" * 1_000_001}), ("/sub", {"notes.md": b"hi"}), ("/node_modules", {"dep.js": b"no"}), ("/sub/build", {"out.py": b"no"})):
        sinks.land_files(spark, files, at + folder, replace=False)
    return scans.code_folder(spark, at).select("source_name", "page_content")


ITEMS = [(0, "md", "# beta"), (1, "url", "Title\n page"), (2, "code", "文件: x.py\n\ny = 1\n"), (3, "txt", "alpha")]


def _fetch(url: str) -> str:
    if "/main/" in url:
        raise OSError("not there")
    return "<html><script>var x;</script><h1>Title</h1><p>page</p></html>"


@query(hand_worked(ITEMS, "part integer, source_type varchar, page_content varchar"))
def scan_mixed_items(spark, sf_dir):
    at = workspace(spark)
    a, b = sinks.land_files(spark, {"a.txt": b"alpha", "b.md": b"# beta"}, f"{at}/files")
    sinks.land_files(spark, {"x.py": b"y = 1\n"}, f"{at}/code")
    rows = scans.items(spark, [b, "  ", "https://e.org/p", f"{at}/code", a], _fetch)
    return rows.select(F.floor(F.col("doc_pos") / scans.PART).cast("int").alias("part"), "source_type", "page_content")


ADDRESSES = [(0, "https://github.com/o/r", "https://raw.githubusercontent.com/o/r/master/README.md"), (2, "https://e.org/x", "https://e.org/x")]


@query(hand_worked(ADDRESSES, "doc_pos bigint, source varchar, fetched_url varchar"))
def scan_addresses(spark, sf_dir):
    return scans.addresses(spark, [" https://github.com/o/r ", "", "https://e.org/x"], _fetch).select("doc_pos", "source", "fetched_url")


@query("select page_id % 7 as batch, count(*) as n_files, 0 as n_index from pages group by 1")
def upload_landing(spark, sf_dir):
    """The pages as uploads in seven batches, each in a folder of its own; a reset leaves an empty index."""
    at = workspace(spark)
    pages = table(spark, sf_dir, "pages").select((F.col("page_id") % 7).alias("batch"), F.coalesce("html", F.lit("")).alias("value"))
    pages.write.partitionBy("batch").option("maxRecordsPerFile", 1).text(f"{at}/up")
    pages.limit(1).write.parquet(f"{at}/index")
    sinks.reset_index(spark, f"{at}/index")
    found = spark.read.format("binaryFile").load(f"{at}/up").select(F.col("batch").cast("long").alias("batch"))
    n = spark.read.format("binaryFile").load(f"{at}/index").count()
    return found.groupBy("batch").agg(F.count("*").alias("n_files")).withColumn("n_index", F.lit(n))


@query("""with t as (select *, row_number() over (partition by conv_id order by turn) as n from conversations)
select 's' || conv_id as session_id, 'talk ' || conv_id as title, count(*)::int as n_messages, max(text) filter (n = 1) as first_message from t group by conv_id""")
def scan_saved_conversations(spark, sf_dir):
    """The conversations as files of saved ones, up to ``TOGETHER`` in a file, an older version of each and a broken file; the latest versions are read."""
    at = workspace(spark)
    message = F.struct("turn", "role", F.col("text").alias("content"))
    talks = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(message)).alias("m"))
    messages = F.transform("m", lambda x: F.struct(x["role"].alias("role"), x["content"].alias("content")))
    session = F.concat(F.lit("s"), "conv_id").alias("session_id")
    new = talks.select("conv_id", F.to_json(F.struct(session, F.concat(F.lit("talk "), "conv_id").alias("title"), F.lit("2026-01-02").alias("updated_at"), messages.alias("messages"))).alias("j"))
    old = talks.select("conv_id", F.to_json(F.struct(session, F.lit("older").alias("title"), F.lit("2026-01-01").alias("updated_at"))).alias("j"))
    files = new.union(old).groupBy(F.floor(F.col("conv_id") / TOGETHER)).agg(F.concat(F.lit("["), F.array_join(F.collect_list("j"), ","), F.lit("]")).alias("value"))
    one_file_a_row(files.select("value").union(spark.createDataFrame([("{broken",)], "value string")), at)
    rows = history.latest(scans.saved_conversations(spark, at))
    return rows.select("session_id", "title", F.size("messages").alias("n_messages"), F.get("messages", F.lit(0))["content"].alias("first_message"))


@query(f"""with v as (select *, coalesce(nullif(updated_at, ''), nullif(saved_at, ''), modified_at) as version from {given_sql("saved")} where session_id not in ('', 's1')),
c as (select session_id, min(coalesce(nullif(created_at, ''), saved_at)) as created_at from v group by 1)
select session_id, title, created_at from (select *, row_number() over (partition by session_id order by version desc, path) as n from v) join c using (session_id) where n = 1""".replace("select *, row", "select session_id, title, row"))
def conversation_store(spark, sf_dir):
    """Conversations saved in two parts, one of them deleted, what is left archived and read again."""
    at = workspace(spark)
    rows = given(spark, sf_dir, "saved").withColumns({"messages": F.array(F.struct(F.lit("user").alias("role"), F.lit("x").alias("content"))), "source_names": F.array().cast("array<string>")})
    sinks.save_conversations(spark, rows.where("path < 'c'"), f"{at}/table")
    sinks.save_conversations(spark, rows.where("path >= 'c'"), f"{at}/table")
    sinks.delete_conversation(spark, f"{at}/table", "s1")
    sinks.archive_conversations(spark.read.parquet(f"{at}/table"), f"{at}/archive")
    return spark.read.json(f"{at}/archive").select("session_id", "title", "created_at")


@query(ORACLE["kg_triples"])
def saved_graph(spark, sf_dir):
    at = workspace(spark)
    sinks.save_graph(kg_triples(spark, sf_dir), at)
    return scans.saved_graph(spark, at).select(F.col("triple_index").cast("long").alias("triple_index"), "subject", "predicate", "object", "source_name", "evidence")


def _index(spark: SparkSession, sf_dir: str, at: str, embed=None) -> None:
    sinks.write_index(as_documents(spark, sf_dir).withColumn("source_key", F.col("source")), at, embed)


INDEXED = f"with {CHUNKS}, d as (select chunk_id, {LATIN.format('nfc_normalize(text)')} as w from ch) "


@query(INDEXED + "select term, count(*) as df, sum(dl)::double as total_length from (select distinct chunk_id, len(w) as dl, unnest(w) as term from d) group by 1")
def index_postings(spark, sf_dir):
    """What a written index says of each term: chunks that have it, and their lengths."""
    at = workspace(spark)
    _index(spark, sf_dir, at)
    held = F.aggregate("dl", F.lit(0).cast("long"), lambda s, x: s + x)
    return spark.read.parquet(f"{at}/postings").groupBy("term").agg(F.sum(F.size("dl")).alias("df"), F.sum(held).cast("double").alias("total_length"))


@query(f"with {CHUNKS} select source_key, chunk_index, length(parent) as n_chars from ch")
def index_parents(spark, sf_dir):
    """How long the parent of each chunk of a written index is."""
    at = workspace(spark)
    _index(spark, sf_dir, at)
    rows = spark.read.parquet(f"{at}/chunks").join(spark.read.parquet(f"{at}/parents"), "parent_id")
    return rows.select("source_key", F.col("chunk_index").cast("long").alias("chunk_index"), F.char_length("parent_content").cast("long").alias("n_chars"))


@query(f"""with {CHUNKS}, c as (select chunk_id, length(text)::double as x from ch), q as (select item_id as query_id, length(text)::double as x from benchmark)
select query_id, chunk_id, score, rank from (select *, row_number() over (partition by query_id order by score desc, chunk_id) as rank from (select query_id, chunk_id, round((q.x * c.x + 36) / (sqrt(q.x * q.x + 36) * sqrt(c.x * c.x + 36)), 6) as score from q, c)) where rank <= 2""")
def index_vectors(spark, sf_dir):
    """The chunks of a written index nearest to each question, by vectors of lengths."""
    at = workspace(spark)
    embed = lambda c: F.array(F.char_length(c).cast("double"), F.lit(6.0))
    _index(spark, sf_dir, at, embed)
    return retrieval.dense(as_questions(spark, sf_dir).select("query_id", embed(F.col("text")).alias("embedding")), scans.vectors(spark, f"{at}/vectors").drop("source_key"), 2)


@query(RANKINGS + FUSED + """, h as (select query_id, chunk_id, rank from fused where rank <= 20),
k as (select query_id, chunk_id, row_number() over (partition by query_id order by rank) as rank from fused where chunk_id % 2 = 0)
select 'fails' as hook, query_id, chunk_id, rank from h where rank <= 2 union all select 'none', query_id, chunk_id, rank from h where rank <= 2
union all select 'turns', query_id, chunk_id, n from (select *, row_number() over (partition by query_id order by rank desc) as n from h) where n <= 2 union all select 'even', query_id, chunk_id, rank from k""")
def rerank_hooks(spark, sf_dir):
    """The fused hits of each question under a reranker that fails, one that finds nothing and one that turns the order; and under a filter."""
    hits = stored(rrf_fusion(spark, sf_dir))

    def broken(rows: DataFrame) -> DataFrame:
        raise OSError("no model")

    hooks = {"fails": broken, "none": lambda rows: rows.where("false").withColumn("rerank", F.lit(0.0)), "turns": lambda rows: rows.withColumn("rerank", F.col("rank").cast("double"))}
    out = retrieval.filtered(hits, lambda rows: rows.where("chunk_id % 2 = 0")).select(F.lit("even").alias("hook"), "query_id", "chunk_id", "rank")
    for name, hook in hooks.items():
        out = out.union(retrieval.reranked(hits, hook, n=2).select(F.lit(name), "query_id", "chunk_id", "rank"))
    return out


#: An answer that lists the sources, and one with a line on each.
LISTED, LINES = f"({ORACLE['source_inventory']})", f"(select string_agg(line, chr(10) order by p) as text from ({ORACLE['source_overview']}) join (select source as name, min(doc_id) as p from documents group by 1) using (name))"
ASKED = ("list", "overview", "chat", "which src", "zzzzqq xqxqxq")


@query(f"""select 'list' as question, 'list_sources' as operation, 'none' as evidence_level, sha256(text) as answer_sha256 from {LISTED}
union all select 'overview', 'read_source', 'none', sha256(text) from {LINES}
union all select 'chat', 'chat', 'none', sha256('system,user,assistant,user')
union all select 'which src', 'search', 'none', sha256('{planner.CHOOSE}' || string_agg('- ' || source, chr(10) order by p)) from (select source, min(doc_id) as p from documents group by 1 order by p limit 5)
union all select 'zzzzqq xqxqxq', 'search', 'low', sha256('{engines.INSUFFICIENT}')""")
def engine_answers(spark, sf_dir):
    """Questions to the engine over all documents: planned by a hook, by rules where the hook's plan is unusable, or ambiguous; whole answers are compared."""
    engine = Engine(as_documents(spark, sf_dir).drop("source_id"))
    plans = {"list": {"operation": "list_sources"}, "overview": {"operation": "read_source", "scope": "all", "read_mode": "overview"}, "chat": {"operation": "chat"}, "zzzzqq xqxqxq": {"operation": "drop tables"}}
    rows = []
    for question in ASKED:
        engine.hooks = Hooks(plan=(lambda q, ids, tail: plans[q]) if question in plans else None, answer=(lambda messages: ",".join(role for role, _ in messages)) if question == "chat" else None)
        found = engine.ask(question, None, [("user", "earlier"), ("assistant", "said")])
        rows.append((question, found.operation, found.evidence_level, found.answer))
    engine.close()
    return spark.createDataFrame(rows, "question string, operation string, evidence_level string, answer string").select("question", "operation", "evidence_level", F.sha2("answer", 256).alias("answer_sha256"))


@query(f"""select '哪些文件' as question, 'inventory' as route, sha256(text) as answer_sha256 from {LISTED} union all select '这些资料主要讲什么', 'overview', sha256(text) from {LINES} union all select 'hello', '', sha256('')""")
def source_tool(spark, sf_dir):
    """Questions about the sources themselves, by their keywords; whole answers are compared."""
    engine = Engine(as_documents(spark, sf_dir).drop("source_id"))
    rows = [(q, engine.source_tool(q)) for q in ("哪些文件", "这些资料主要讲什么", "hello")]
    engine.close()
    told = spark.createDataFrame(rows, "question string, answer string")
    return told.select("question", F.coalesce(resolver.route(F.col("question")), F.lit("")).alias("route"), F.sha2("answer", 256).alias("answer_sha256"))


@query(ORACLE["bounded_batches"].replace("12000", "700"))
def batches_by_limit(spark, sf_dir):
    """Batches of up to 700 characters: many a key, and parts that are longer themselves."""
    docs = table(spark, sf_dir, "documents").select(F.col("source").alias("key"), F.col("doc_id").alias("pos"), "text")
    return chunking.bounded_batches(docs, 700).select("key", "batch", F.length("text").alias("n_chars"), F.sha2("text", 256).alias("text_sha256"))
