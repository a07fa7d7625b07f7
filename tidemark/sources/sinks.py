"""Sinks: the index, conversations and graphs."""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import text as t
from tidemark.functions import tokens
from tidemark.operators import chunking, graph, history
from tidemark.sources import scans


def write_index(docs: DataFrame, path: str, embed=None) -> dict[str, str]:
    """Replace the index under ``path``: chunks, parents' texts and postings, and vectors if ``embed`` (Column -> Column) is given.

    No document with text raises an error before anything is replaced.
    """
    full = docs.where(t.filled(F.col("page_content")))
    if full.isEmpty():
        raise ValueError("there is no text to index")
    spark = docs.sparkSession
    chunks, parents = chunking.chunk_tables(full)
    staged = _staged(path)
    places = {name: f"{path.rstrip('/')}/{name}" for name in ("chunks", "parents", "postings", "lengths", *(["vectors"] if embed is not None else []))}
    # a number for each chunk: postings name it so
    chunks.withColumn("no", F.monotonically_increasing_id()).write.mode("overwrite").option("compression", "zstd").parquet(f"{staged}/chunks")
    written = spark.read.parquet(f"{staged}/chunks")
    parents.write.mode("overwrite").option("compression", "zstd").parquet(f"{staged}/parents")
    # each file is sorted by term, so that a query's terms are looked for in few of its pages; no posting is shuffled
    tokens.packed_postings(written).sortWithinPartitions("term", "block").write.mode("overwrite").option("compression", "zstd").parquet(f"{staged}/postings")
    lengths = tokens.known_counts(written, ("no", "chunk_id", "source_key", "doc_pos", "chunk_index"), F.col("text"), spark.sparkContext.broadcast({})).drop("ids", "tf")
    lengths.write.mode("overwrite").option("compression", "zstd").parquet(f"{staged}/lengths")
    if embed is not None:
        written.select("chunk_id", "source_key", embed(F.col("text")).alias("embedding")).write.mode("overwrite").option("compression", "zstd").parquet(f"{staged}/vectors")
    _swapped(spark, staged, path)
    return places


def _staged(path: str) -> str:
    return f"{path.rstrip('/')}.new"


def _swapped(spark: SparkSession, staged: str, path: str) -> None:
    """Puts a written folder in another's place by renames; what was there is kept aside until then, and a crash leaves one of the two whole (``recovered`` finds it)."""
    jvm, conf = spark._jvm.org.apache.hadoop.fs, spark._jsc.hadoopConfiguration()
    new, now, old = (jvm.Path(x) for x in (staged, path.rstrip("/"), f"{path.rstrip('/')}.old"))
    system = now.getFileSystem(conf)
    system.delete(old, True)
    if system.exists(now) and not system.rename(now, old):
        raise OSError(f"{path} can't be moved")
    if not system.rename(new, now):
        raise OSError(f"{staged} can't be moved")
    system.delete(old, True)


def recovered(spark: SparkSession, path: str) -> None:
    """After a crash between two renames: what was set aside goes back."""
    jvm, conf = spark._jvm.org.apache.hadoop.fs, spark._jsc.hadoopConfiguration()
    now, old = jvm.Path(path.rstrip("/")), jvm.Path(f"{path.rstrip('/')}.old")
    system = now.getFileSystem(conf)
    if system.exists(old) and not system.exists(now):
        system.rename(old, now)


def reset_index(spark: SparkSession, path: str) -> None:
    """Remove an index with all its tables, and leave an empty folder."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    system.delete(folder, True)
    system.mkdirs(folder)


def land_files(spark: SparkSession, given: dict[str, bytes], path: str, index: str | None = None, replace: bool = True) -> list[str]:
    """Write uploaded files (name, bytes) into a folder, by default in place of all that was there and of the ``index``; returns their paths."""
    jvm, conf = spark._jvm.org.apache.hadoop.fs, spark._jsc.hadoopConfiguration()
    folder = jvm.Path(path)
    system = folder.getFileSystem(conf)
    if replace:
        system.delete(folder, True)
        if index is not None:
            system.delete(jvm.Path(index), True)
    system.mkdirs(folder)
    for name, raw in given.items():
        out = system.create(jvm.Path(folder, name), True)
        try:
            out.write(bytearray(raw))
        finally:
            out.close()
    return [f"{path.rstrip('/')}/{name}" for name in given]


def save_conversations(spark: SparkSession, new: DataFrame, path: str) -> None:
    """Upsert into one Parquet table of the latest versions; the new table is written whole before it takes the old one's place."""
    recovered(spark, path)
    try:
        old = spark.read.parquet(path)
    except Exception as e:  # noqa: BLE001 - only a missing table counts as empty
        if "PATH_NOT_FOUND" not in str(e):
            raise
        old = new.limit(0)
    merged = history.upserted(old, new)
    merged.write.mode("overwrite").parquet(_staged(path))
    _swapped(spark, _staged(path), path)


def archive_conversations(saved: DataFrame, path: str) -> None:
    """Append conversations that have a source or a user message, as JSON lines."""
    stamp = datetime.datetime.now(datetime.timezone.utc).isoformat()
    history.archivable(saved).withColumn("saved_at", F.lit(stamp)).write.mode("append").json(path)


def delete_conversation(spark: SparkSession, path: str, session: str) -> int:
    """Delete all rows of a session; returns how many there were."""
    rest, gone = history.without(spark.read.parquet(path), session)
    n = gone.first().n
    if n:
        rest.write.mode("overwrite").parquet(_staged(path))
        _swapped(spark, _staged(path), path)
    return n


def save_graph(triples: DataFrame, path: str, mode: str = "fallback", error: str = "") -> None:
    """One JSON object with all triples of a displayed graph in order."""
    rows = triples.agg(F.array_sort(F.collect_list(F.struct("triple_index", "subject", "predicate", "object", "source_name", "evidence"))).alias("x"))
    bare = F.transform("x", lambda v: F.struct(v["subject"].alias("subject"), v["predicate"].alias("predicate"), v["object"].alias("object"), v["source_name"].alias("source_name"), v["evidence"].alias("evidence")))
    rows.select(F.lit(1).alias("schema_version"), F.current_timestamp().cast("string").alias("generated_at"), F.array_distinct(F.transform("x", lambda v: v["source_name"])).alias("source_names"), F.lit(mode).alias("extraction_mode"), F.lit(error).alias("error"), bare.alias("triples")).coalesce(1).write.mode("overwrite").json(path)


def graph_page(triples: DataFrame) -> str:
    """A page that draws the graph; it has no parts from elsewhere."""
    found = graph.nodes(triples)
    data = graph.payload(found, graph.edges(triples, found)).first().json.replace("</", "<\\/")
    return f"<!DOCTYPE html><meta charset='utf-8'><title>Graph</title><svg id='g' width='4200' height='2600'></svg><script>const d={data};{_DRAW}</script>"


_DRAW = "const s=document.getElementById('g'),p={};const add=(k,a,x)=>{const e=document.createElementNS('http://www.w3.org/2000/svg',k);for(const i in a)e.setAttribute(i,a[i]);if(x)e.textContent=x;s.append(e)};d.nodes.forEach(n=>p[n.id]=n);d.edges.forEach(e=>{const a=p[e.source],b=p[e.target];add('line',{x1:a.x,y1:a.y,x2:b.x,y2:b.y,stroke:'#64748b'});add('text',{x:(a.x+b.x)/2,y:(a.y+b.y)/2,'font-size':11},e.label)});d.nodes.forEach(n=>{add('circle',{cx:n.x,cy:n.y,r:n.radius,fill:n.color});add('text',{x:n.x,y:n.y+4,'text-anchor':'middle','font-size':12},n.label)});"

load_graph = scans.saved_graph
