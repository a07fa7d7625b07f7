"""Inputs of queries, made of the given tables: one SELECT each, which Spark and DuckDB both run, so that a query and its SQL see the same rows."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

#: The first words of a text.
W = [f"split_part(replace(coalesce(text, 'none'), chr(10), ' '), ' ', {k})" for k in range(1, 6)]
START = "substr(replace(coalesce(text, 'none'), chr(10), ' '), 1, {})"
QUOTES = "concat(chr(96), chr(96), chr(96))"


def listed(values: str) -> str:
    """An array of a comma-separated text without empty values."""
    return f"list_filter(split({values}, ','), lambda x: x <> '')"


GIVEN: dict[str, str] = {
    "mixed_text": f"select doc_id as id, case doc_id % 5 when 0 then {START.format(300)} when 1 then concat({START.format(40)}, '图像复原', {START.format(25)}, '单') when 2 then concat('图像', {W[0]}, '机器视觉系统、', {W[1]}) when 3 then concat('其中', {W[0]}, ' ：') else '' end as text from documents",
    "questions": f"""select conv_id * 1000 + turn as question_id, case (conv_id + turn) % 14
        when 0 then concat('第', cast(turn % 30 as string), '个文件说了什么 ', {W[0]}) when 1 then concat('请总结 src', cast(conv_id % 20 as string), '.pdf ', {W[0]}) when 2 then '第二十一份' when 3 then '看一下第３份资料' when 4 then '第　２　个文件'
        when 5 then concat('有哪些文件？', {W[0]}) when 6 then concat('请 输出 全文 ', {W[1]}) when 7 then concat('这些资料主要讲什么', {W[0]}) when 8 then concat('它里面还有', {W[0]}) when 9 then concat('把文档里的内容全部给我，不要省略', {W[2]})
        when 10 then concat('一个', {W[0]}, '的文件里讲了什么') when 11 then '' when 12 then concat('第十二个文件 ', {W[1]}) else {START.format(40)} end as question from conversations""",
    "catalog": """select cast(n - 1 as int) as source_pos, concat('s', cast(n as string)) as source_id, concat(case when n % 3 = 0 then cast(n as string) else '' end, case when n % 2 = 0 then ' 基础篇-' else '' end, source, case n % 4 when 0 then '.pdf' when 1 then '.MD' when 2 then ' 2.docx' else '' end) as source_name
        from (select source, row_number() over (order by source) as n from (select distinct source from documents where source is not null) as a) as b""",
    "notes": f"""select concat('n', cast(doc_id as string)) as source_name, case doc_id % 4 when 0 then concat('• ', {W[0]}, '图像增强主要包括', {W[1]}, '、', {W[2]}, '和空间滤波。', chr(10), '1. 中值滤波用于去除', {W[3]}, '；短')
        when 1 then concat({W[0]}, {W[1]}, '的作用是描述', {W[2]}, '；', {W[3]}, {W[4]}, '可以产生', {W[0]}) when 2 then concat('- 其中', {W[0]}, {W[1]}, '的定义是', {W[2]}, {W[3]}, chr(10), '2) ', {W[4]}, {W[4]}, '为', {W[0]}, {W[1]}) else {START.format(100)} end as text from documents""",
    "triples": f"select conv_id * 1000 + turn as triple_index, case when turn % 11 = 5 then '' else {W[0]} end as subject, case conv_id % 5 when 0 then '包括' when 1 then '用于' when 2 then ' 是 ' when 3 then 'A\"B' else '' end as predicate, case when turn % 7 = 3 then {W[0]} else {W[1]} end as object, concat(coalesce(role, ''), '.md') as source_name, {START.format(30)} as evidence from conversations",
    "proposed": f"select conv_id * 1000 + turn as seq, {W[0]} as subject, case when turn % 3 = 2 then ' ' else '包括' end as predicate, case when turn % 5 = 4 then '' else {W[1]} end as object, concat(coalesce(role, ''), '.md') as source_name, {START.format(30)} as evidence from conversations",
    "yaml": f"select doc_id, case doc_id % 3 when 0 then concat('preamble', chr(10), 'name: ', {W[0]}, chr(10), 'items:', chr(10), '  - ', {W[1]}, chr(10), 'nested.key: 1', chr(10)) when 1 then {START.format(60)} else concat('a:', chr(10), 'b_', cast(doc_id as string), ': ', {W[2]}, chr(10), ' c: not top', chr(10), 'd-e: x') end as text from documents",
    "markdown": f"select doc_id, case doc_id % 4 when 0 then concat('# ', {W[0]}, chr(10), {START.format(80)}, chr(10), chr(10), '## 使用', chr(10), {W[1]}) when 1 then concat('lead ', {W[0]}, chr(10), chr(10), '# One', chr(10), 'body', chr(10), '### ', {W[2]}, 'x', chr(10), 'more', chr(10)) when 2 then concat({W[0]}, ' no headings', chr(10), '#notone') else concat('#  Only ', {W[3]}, 'y', chr(10)) end as text from documents",
    "outline": f"select doc_id, case doc_id % 3 when 0 then concat('复习', {W[0]}, chr(10), '1. 第一项', {W[1]}, chr(10), '2、 第二项', chr(10), ' 3) ', {W[2]}, chr(10), '续行') when 1 then concat('第 1．甲', chr(10), '第2.', {W[0]}, 'x', chr(10), '10.丙') else concat('no markers ', {W[0]}, 'x') end as text from documents",
    "numbered_lines": "select doc_id, concat(" + ", chr(10), ".join(f"'{k}. ', substr(replace(coalesce(text, ''), chr(10), ' '), {120 * k - 119}, 120)" for k in range(1, 25)) + ") as text from documents",
    "paged": f"select source as source_key, doc_id as doc_pos, cast(row_number() over (partition by source order by doc_id) as int) as page, concat('p', {START.format(60)}, 'x') as page_content from documents",
    "routed_pages": f"""select source_key, doc_pos, case k % 7 when 0 then 'a.pdf' when 1 then 'b.pdf' when 2 then 'README.md' when 3 then 'm.py' when 4 then 'c.YAML' when 5 then 'notes.txt' else 'x.bin' end as source_name, case k % 7 when 0 then 'pdf' when 1 then 'PDF' when 2 then 'md' when 3 then 'code' when 4 then 'code' when 5 then 'txt' else 'json' end as source_type,
        page, case when k % 14 in (0, 1) then concat('1. ', {W[0]}, 'x', chr(10), '2. ', {W[1]}, 'x', chr(10), '3. y') else concat('p ', substr(coalesce(text, ''), 1, 1500)) end as page_content
        from (select concat('k', cast(k as string)) as source_key, k, doc_id as doc_pos, text, cast(row_number() over (partition by k order by doc_id) as int) as page from (select doc_id, text, case when doc_id % 2 = 0 then doc_id % 40 else 1000 + doc_id % 500 end as k from documents) as a) as b""",
    "urls": """select page_id as url_id, case page_id % 7 when 0 then concat('https://github.com/', split_part(url, '/', 4), '/r', cast(page_id as string)) when 1 then concat('https://www.GitHub.com/', split_part(url, '/', 4), '/r/tree/main') when 2 then concat('https://github.com/', split_part(url, '/', 4), '/r/blob/dev/docs/', cast(page_id as string), '.md')
        when 3 then concat('https://github.com/', split_part(url, '/', 4)) when 4 then concat('https://github.com//o//r', cast(page_id as string), '/') else url end as url from pages""",
    "saved": """select concat(case when turn % 2 = 0 then 'a' else 'd' end, cast(conv_id as string), '-', cast(turn as string), '.json') as path, case when conv_id % 17 = 0 then '' else concat('s', cast(conv_id as string)) end as session_id, concat('t', cast(turn as string)) as title, case when turn % 3 = 0 then cast(null as string) else concat('2026-01-', lpad(cast(turn as string), 4, '0')) end as created_at,
        case turn % 4 when 0 then cast(null as string) when 1 then '' else concat('2026-02-', lpad(cast(turn as string), 4, '0')) end as updated_at, case when turn % 5 = 2 then cast(null as string) else concat('2026-01-', lpad(cast(turn * 7 % 50 as string), 4, '0')) end as saved_at, concat('2026-03-', lpad(cast(turn as string), 4, '0')) as modified_at from conversations""",
    "hits": f"""select doc_id % 60 as query_id, doc_id as seq, case doc_id % 9 when 0 then cast(null as string) when 1 then '' else concat('chunk-', cast(cast(floor(doc_id / 180) as int) as string)) end as chunk_id, concat('s', cast(doc_id % 3 as string)) as source_id, case doc_id % 8 when 0 then '' when 1 then cast(null as string) else concat(source, '.pdf') end as source_name, case when doc_id % 16 = 1 then 'www.site.org/page' else cast(null as string) end as source,
        cast(case when doc_id % 5 = 0 then 7 else null end as int) as page, cast(case when doc_id % 5 in (1, 2) then 3 else null end as int) as page_start, cast(case doc_id % 5 when 1 then 5 when 2 then 3 else null end as int) as page_end, concat({START.format(40)}, ' https://x.y/', cast(doc_id as string), ' link') as text from documents""",
    "answers": f"select conv_id * 1000 + turn as query_id, case turn % 4 when 3 then 'chat' else 'search' end as operation, case conv_id % 4 when 0 then concat('抱歉，当前资料依据不足。', {W[0]}) when 1 then concat('INSUFFICIENT Evidence ', {W[0]}) else {START.format(60)} end as answer, cast(turn % 3 as int) as n_citations from conversations",
    "answers_json": f"""select conv_id * 1000 + turn as id, case turn % 5 when 0 then concat('Sure: ', {QUOTES}, 'json', chr(10), chr(123), '"operation": "search", "n": ', cast(conv_id as string), chr(125), chr(10), {QUOTES}, ' done') when 1 then {W[0]} when 2 then concat(chr(123), '"a": ', chr(123), '"b": ', cast(turn as string), chr(125), chr(125), ' tail')
        when 3 then concat(chr(123), 'broken ', cast(conv_id as string)) else concat('[', cast(conv_id as string), ', 2]') end as answer from conversations""",
    "ids": "select doc_id as id, case doc_id % 4 when 0 then concat(' chunk-', cast(doc_id as string), ' ') when 1 then '' when 2 then cast(null as string) else chr(9) end as chunk_id, coalesce(text, 'x') as content from documents",
    "files": "select page_id as id, url as name from pages",
    "turns": "select conv_id, turn, case when conv_id % 3 = 0 then 'assistant' else role end as role, text, case when conv_id % 5 = 0 then cast(null as string) else concat('notes', cast(conv_id % 7 as string), '.pdf') end as first_source from conversations",
    "plans": f"""select conv_id * 1000 + turn as question_id, {W[0]} as question, {listed("case conv_id % 6 when 0 then '' when 1 then 'a' when 2 then 'a,b' else 'a,b,c' end")} as catalog, {listed("case turn % 5 when 0 then '' when 1 then 'b' when 2 then 'a,b' when 3 then 'a' else 'z' end")} as candidates,
        {listed("case (conv_id + turn) % 7 when 0 then 'a' when 1 then 'b,z' else '' end")} as resolved, {listed("case (conv_id + 2 * turn) % 5 when 0 then 'a' when 1 then 'b,z' else '' end")} as active, case (conv_id + 3 * turn) % 6 when 0 then 'search' when 1 then 'read_source' when 2 then 'chat' when 3 then 'delete' when 4 then ' search ' else 'list_sources' end as operation,
        case turn % 6 when 0 then 'all' when 1 then 'selected' when 2 then 'active' when 3 then 'nonsense' when 4 then 'auto' else cast(null as string) end as scope, {listed("case (conv_id * 2 + turn) % 4 when 0 then 'b,x,b' when 1 then 'a' when 2 then '' else 'c,a' end")} as source_ids, case turn % 3 when 0 then concat(' ', {W[1]}, ' ') when 1 then '' else cast(null as string) end as query,
        case conv_id % 3 when 0 then 'full_text' when 1 then 'odd' else cast(null as string) end as read_mode, case turn % 4 when 0 then '0.8' when 1 then '7' when 2 then 'bad' else cast(null as string) end as confidence, case turn % 2 when 0 then 'r ' else cast(null as string) end as reason from conversations""",
}


def given(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The input over the tables of a folder."""
    sql = GIVEN[name].replace("list_filter", "filter").replace("lambda x:", "x ->")
    names = sorted(set(re.findall(r"\bfrom (documents|conversations|pages)\b", sql)))
    sql = re.sub(r"\bfrom (documents|conversations|pages)\b", r"from {\1}", sql)
    return spark.sql(sql, **{n: spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in names})


def given_sql(name: str) -> str:
    """The same as a table expression for DuckDB."""
    return f"({GIVEN[name]})"
