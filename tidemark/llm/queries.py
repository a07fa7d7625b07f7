"""The queries that apply each operator to its whole table with production parameters, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import decontamination, html, jaccard, language, pieces, pii, pitman_yor, quality, quotations, survivorship, syncmers, toxicity, trie
from tidemark.llm.texts import fold

#: The model file's place; set it to where every executor has the file.
PIECES = "/opt/tokenizers/piece_bpe_32k.model"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = toxicity.train(toxicity.labelled_sample(docs, labels, "toxic", fold(5) == 0))
    scored = docs.select("doc_id", (fold(5) == 0).alias("held_out"), toxicity.toxicity(F.col("text"), model, spark).alias("r"))
    return scored.select("doc_id", "held_out", F.col("r.score").alias("score"), (F.col("r.score") >= 0.5).cast("int").alias("predicted"))


def op2_pitman_yor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pitman_yor.language_model(table(spark, sf_dir, "documents").select("doc_id", "text", (fold(7) == 2).alias("held_out")))


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = table(spark, sf_dir, "documents").select("doc_id", pieces.round_trip(F.col("text"), PIECES).alias("r"))
    return coded.select("doc_id", "r.n_pieces", "r.ids", F.sha2("r.decoded", 256).alias("decoded_sha256"), F.col("r.exact").alias("exact"))


def op4_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", html.main_text(F.col("html")).alias("r"))
    return pages.select("page_id", "url", "r.text", "r.n_chars", "r.n_lines", "r.n_kept")


def op5_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_components(table(spark, sf_dir, "documents"), size=4, percent=85)


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = language.train(docs.where(fold(4) != 2))
    found = docs.select("doc_id", (fold(4) == 2).alias("held_out"), language.language(F.col("text"), model, spark).alias("r"))
    return found.select("doc_id", "held_out", "r.lang_pred", "r.score", "r.rejected")


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return judged.select("doc_id", "lang", "_quality.n_tokens", "_quality.log10_probability", "_quality.perplexity", "_quality.limit", "_quality.keep")


def op8_syncmers(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows = syncmers.with_next(docs, ["text"], {"found": syncmers.anchors(F.col("text"))})
    n = F.char_length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), n - half), F.substring("next.text", F.lit(1), half))
    rows = rows.withColumn("edited", edited).withColumn("edited_found", syncmers.anchors(F.col("edited")))
    rows = rows.withColumns({"a": syncmers.values(F.col("found")), "b": syncmers.values(F.col("edited_found")), "c": syncmers.values(F.col("next.found"))})
    return rows.select("doc_id", n.cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"), syncmers.printed(F.col("a")).alias("fingerprint"), syncmers.printed(F.col("b")).alias("edited_fingerprint"), syncmers.likeness(F.col("a"), F.col("b")).alias("near_edited"), syncmers.likeness(F.col("a"), F.col("c")).alias("near_next"), syncmers.aligned(F.col("found"), F.col("edited_found")).alias("aligned_edited"))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontamination.contamination(F.col("text"), table(spark, sf_dir, "benchmark"))
    r = table(spark, sf_dir, "documents").select("doc_id", found.alias("r"))
    ids = F.array_join("r.item_ids", ",")
    return r.select("doc_id", "r.n_words", "r.n_hit", F.size("r.item_ids").cast("long").alias("n_items"), F.sha2(ids, 256).alias("items_sha256"), (F.col("r.n_hit") > 0).alias("contaminated"))


def op10_quotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quotations.conversations(table(spark, sf_dir, "conversations"))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = trie.turns(table(spark, sf_dir, "conversations"))
    c = F.col("conv_id")
    steps, lengths = trie.branched(placed, base=c - c % 20, shared=F.crc32(c.cast("string").cast("binary")) % 4, most=3)
    return trie.trie(steps, lengths)


def op12_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = pii.train(docs)
    found = docs.select("doc_id", pii.personal_data(F.col("text"), model, spark)["spans"].alias("all"))
    found = found.withColumn("own", F.filter("all", lambda s: s["base"]))
    kinds = F.transform("own", lambda s: s["kind"])
    counts = [(F.size("own") - F.size(F.array_remove(kinds, k))).cast("long").alias(f"n_{kind}") for k, kind in enumerate(pii.KINDS)]
    return found.select("doc_id", *counts, F.sha2(pii.printed(F.col("own")), 256).alias("base_sha256"), pii.printed(F.col("all")).alias("spans"), (F.size("all") - F.size("own")).cast("long").alias("n_added"))


def op13_survivorship(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = survivorship.golden_records(table(spark, sf_dir, "clients"))
    cents = F.floor(100 * F.col("balance") + 0.5).cast("long")
    return found.select("cluster_id", "n_records", "n_stale", "name", "email", "segment", "city", "nation_id", cents.alias("balance_cents"), "name_from", "email_from", "segment_from", "balance_from", "address_from")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_toxicity": op1_toxicity,
    "op2_pitman_yor": op2_pitman_yor,
    "op3_sentencepiece": op3_sentencepiece,
    "op4_html": op4_html,
    "op5_jaccard": op5_jaccard,
    "op6_language": op6_language,
    "op7_quality": op7_quality,
    "op8_syncmers": op8_syncmers,
    "op9_decontamination": op9_decontamination,
    "op10_quotations": op10_quotations,
    "op11_prefix_trie": op11_prefix_trie,
    "op12_pii": op12_pii,
    "op13_survivorship": op13_survivorship,
}

LOWERED = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
ORACLE: dict[str, str] = {
    "op9_decontamination": rf"""
with d as (select doc_id, regexp_extract_all({LOWERED.format("coalesce(text, '')")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents),
b as (select item_id, regexp_extract_all({LOWERED.format("coalesce(text, '')")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from benchmark),
bw as (select distinct item_id, least(10, len(w)) as n, unnest([w[i:i + least(10, len(w)) - 1] for i in range(1, len(w) - least(10, len(w)) + 2)]) as g from b where len(w) > 0),
sizes as (select distinct n from bw),
dw as (select doc_id, n, i, w[i:i + n - 1] as g from (select doc_id, w, n, unnest(range(1, len(w) - n + 2)) as i from d, sizes where len(w) >= n)),
h as (select dw.doc_id, dw.i, dw.n, bw.item_id from dw join bw on dw.n = bw.n and dw.g = bw.g),
hit as (select doc_id, count(distinct p) as n_hit from (select doc_id, unnest(range(i, i + n)) as p from h) group by 1),
its as (select doc_id, count(*) as n_items, string_agg(x, ',' order by x) as ids from (select distinct doc_id, cast(item_id as varchar) as x from h) group by 1)
select d.doc_id, len(w)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items, sha256(coalesce(ids, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from d left join hit using (doc_id) left join its using (doc_id)""",
    # crc32 bit by bit: each byte is mixed in at the first of its eight steps
    "op11_prefix_trie": r"""
with t as (select conv_id, row_number() over (partition by conv_id order by turn nulls first, sign) as pos, sign, words from (select conv_id, turn,
    md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) as sign, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) as words from conversations where conv_id is not null)),
c as (select conv_id, conv_id - conv_id % 20 as base, count(*) as n, conv_id::varchar as s from t group by 1),
h as (select conv_id, base, n, xor(list_reduce(list_concat([4294967295::bigint], flatten(list_transform(range(1, length(s) + 1), lambda i: [ascii(s[i])::bigint, 0, 0, 0, 0, 0, 0, 0]))),
    lambda a, b: xor(xor(a, b) >> 1, 3988292384 * (xor(a, b) & 1))), 4294967295) % 4 as h from c),
k as (select h.*, least(h.h, coalesce(b.n, 0)) as taken from h left join h b on b.conv_id = h.base),
steps as (select k.conv_id as c, t.pos as p, sign, words from k join t on t.conv_id = k.base and t.pos <= k.taken
    union all select k.conv_id, t.pos - k.h + k.taken, sign, words from k join t on t.conv_id = k.conv_id and t.pos > k.h),
members as (select c, p, string_agg(sign, '') over (partition by c order by p) as id, words from steps union all select conv_id, 0, '', 0 from c),
nodes as (select p as depth, id, min(c) as conv_id, count(*) as n_convs, max(words) as words from members group by 1, 2),
kids as (select depth - 1 as depth, left(id, 32 * (depth - 1)::int) as id, count(*) as n from nodes where depth > 0 group by 1, 2),
full_nodes as (select nodes.*, coalesce(kids.n, 0) as n_children from nodes left join kids using (depth, id)),
sums as (select n.depth, n.id, count(*) filter (m.n_children = 0) as n_leaves, sum((m.n_convs - 1) * m.words) as saved_tokens from full_nodes n join full_nodes m on m.depth >= n.depth and left(m.id, 32 * n.depth::int) = n.id group by 1, 2),
last as (select c, max(p) as depth from members group by 1),
ends as (select depth, id, string_agg(c::varchar, ',' order by c) as ids from (select m.c, m.id, m.p as depth from members m join last on last.c = m.c and last.depth = m.p) group by 1, 2)
select n.conv_id, n.depth::bigint as depth, p.conv_id as parent_conv_id, n.n_convs, n.n_children::bigint as n_children, s.n_leaves, s.saved_tokens::bigint as saved_tokens, sha256(coalesce(e.ids, '')) as ends_sha256
from full_nodes n join sums s using (depth, id) left join nodes p on p.depth = n.depth - 1 and p.id = left(n.id, 32 * greatest(n.depth - 1, 0)::int) left join ends e on e.depth = n.depth and e.id = n.id""",
    "op13_survivorship": r"""
with c as (select coalesce(master_id, client_id) as cluster_id, client_id, updated_at, case source when 'partner' then 0 when 'store' then 1 when 'web' then 2 when 'crm' then 3 else 4 end as trust, nation_id, balance,
    case when regexp_matches(name, '[^\x20\x09-\x0D]') then name end as name, case when regexp_matches(email, '[^\x20\x09-\x0D]') then email end as email,
    case when regexp_matches(city, '[^\x20\x09-\x0D]') then city end as city, case when regexp_matches(segment, '[^\x20\x09-\x0D]') then segment end as segment from clients),
s as (select *, coalesce(updated_at < max(updated_at) over (partition by cluster_id) - interval 720 hours, true) as stale,
    row_number() over (partition by cluster_id order by updated_at desc nulls last, trust, client_id nulls last, name nulls first, email nulls first, city nulls first, nation_id nulls first, segment nulls first, balance nulls first) as recent from c),
t as (select *, arg_min(segment, recent) over (partition by cluster_id) as chosen,
    row_number() over (partition by cluster_id order by stale, trust, recent) as trusted from s),
r as (select *, row_number() over (partition by cluster_id order by name is null, length(name) desc, trusted) as by_name, row_number() over (partition by cluster_id order by email is null, trusted) as by_email,
    row_number() over (partition by cluster_id order by segment is null, recent) as by_segment, row_number() over (partition by cluster_id order by balance is null, segment is distinct from chosen, recent) as by_balance,
    row_number() over (partition by cluster_id order by (city is null)::int + (nation_id is null)::int, trusted) as by_address from t)
select cluster_id, count(*) as n_records, count(*) filter (stale) as n_stale, max(name) filter (by_name = 1) as name, max(email) filter (by_email = 1) as email, max(segment) filter (by_segment = 1) as segment,
    max(city) filter (by_address = 1) as city, max(nation_id) filter (by_address = 1) as nation_id, max(floor(100 * balance + 0.5)) filter (by_balance = 1)::bigint as balance_cents,
    max(client_id) filter (by_name = 1 and name is not null) as name_from, max(client_id) filter (by_email = 1 and email is not null) as email_from, max(client_id) filter (by_segment = 1 and segment is not null) as segment_from,
    max(client_id) filter (by_balance = 1 and balance is not null) as balance_from, max(client_id) filter (by_address = 1 and (city is not null or nation_id is not null)) as address_from
from r group by 1""",
}
