"""Queries over readers and sinks. File sources read copies of the given tables that Spark writes to the shared folder first."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from corpusmill.operators import graph as G
from corpusmill.operators import profile as P
from corpusmill.plans.base import CHUNKS, DOCS, chunks, docs, query, table
from corpusmill.plans.graph import GRAPH, graph
from corpusmill.plans.profiles import _TEXT
from corpusmill.plans.retrieval import _EVAL, _ROW, BM25, keyword
from corpusmill.operators import retrieve as R
from corpusmill.sources import readers as I
from corpusmill.sources import sinks as O


def place(spark, name):
    return f"{O.shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


@query("s1_csv", "SELECT c_custkey, c_name, c_mktsegment FROM customer")
def s1(spark, sf):
    path = place(spark, "csv")
    table(spark, sf, "customer").select("c_custkey", "c_name", "c_mktsegment").write.csv(path, header=True)
    return I.read_delimited(spark, path).select(F.col("c_custkey").cast("long").alias("c_custkey"), "c_name", "c_mktsegment")


@query("s2_tsv", "SELECT p_partkey, p_name FROM part")
def s2(spark, sf):
    path = place(spark, "tsv")
    table(spark, sf, "part").select("p_partkey", "p_name").write.csv(path, header=True, sep="\t")
    return I.read_delimited(spark, path, "\t").select(F.col("p_partkey").cast("long").alias("p_partkey"), "p_name")


@query("s3_json_records", "SELECT CAST(n_nationkey AS BIGINT) AS n_nationkey, n_name FROM nation")
def s3(spark, sf):
    path = place(spark, "json")
    table(spark, sf, "nation").select("n_nationkey", "n_name").write.json(path)
    return I.read_records(spark, path).select("n_nationkey", "n_name")


def _files(spark, sf, kind="html"):
    path = place(spark, "files")
    parts = table(spark, sf, "pages").select((F.col("page_id") % 20).alias("part"), F.replace("html", F.lit("\n"), F.lit(" ")).alias("value"))
    parts.repartition(20, "part").write.partitionBy("part").text(path)
    return path


@query("s4_whole_files")
def s4(spark, sf):
    rows = I.read_texts(spark, _files(spark, sf))
    return rows.select(F.regexp_extract("path", r"part=(\d+)/", 1).alias("part"), F.length("text").alias("n"), "size")


@query("s5_s6_file_listing", "SELECT CAST(page_id % 20 AS VARCHAR) AS part, CAST(sum(strlen(html) + 1) AS BIGINT) AS size FROM pages GROUP BY ALL")
def s5(spark, sf):
    rows = I.list_files(spark, _files(spark, sf))
    return rows.select(F.regexp_extract("path", r"part=(\d+)/", 1).alias("part"), "size").groupBy("part").agg(F.sum("size").alias("size"))


_SKIP = "script|style|nav|footer|header|aside|noscript"
_TEXT_SQL = f"regexp_replace(regexp_replace(regexp_replace(html, '(?is)<({_SKIP})[^>]*>.*?</({_SKIP})>', chr(10), 'g'), '(?s)<!--.*?-->', '', 'g'), '(?s)<[^>]*>', chr(10), 'g')"
for _a, _b in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&amp;", "&")):
    _TEXT_SQL = f"replace({_TEXT_SQL}, '{_a}', '{_b}')"
PAGE_TEXT = f"array_to_string(list_filter(list_transform(string_split({_TEXT_SQL}, chr(10)), lambda x: trim(x)), lambda x: x <> ''), chr(10))"
_INNER = lambda t: f"nullif(trim(regexp_replace(regexp_extract(html, '(?is)<{t}[^>]*>(.*?)</{t}>', 1), '<[^>]*>', '', 'g')), '')"
PAGE_TITLE = f"substring(coalesce({_INNER('title')}, {_INNER('h1')}, 'untitled'), 1, 100)"


@query("s7_page_markdown")
def s7(spark, sf):
    return I.pages_to_markdown(table(spark, sf, "pages").select("page_id", "html"))


@query("s8_page_text", f"SELECT page_id, md5({PAGE_TEXT}) AS text_md5 FROM pages")
def s8(spark, sf):
    return table(spark, sf, "pages").select("page_id", F.md5(I.page_text(F.col("html"))).alias("text_md5"))


@query("s9_page_title", f"SELECT page_id, {PAGE_TITLE} AS title FROM pages")
def s9(spark, sf):
    return table(spark, sf, "pages").select("page_id", I.page_title(F.col("html")).alias("title"))


@query("s10_captured", f"SELECT page_id, md5('source: ' || url || chr(10) || 'title: ' || {PAGE_TITLE} || chr(10) || chr(10) || {PAGE_TEXT}) AS captured_md5 FROM pages")
def s10(spark, sf):
    return table(spark, sf, "pages").select("page_id", F.md5(I.captured(F.col("url"), F.col("html"))).alias("captured_md5"))


@query("s11_row_lines", "SELECT '[part] doc=parts | p_partkey=' || p_partkey || CASE WHEN trim(p_name) <> '' THEN ' | p_name=' || p_name ELSE '' END AS line FROM part")
def s11(spark, sf):
    return O.row_lines(table(spark, sf, "part").select("p_partkey", "p_name"), "part", F.lit("parts"))


@query("s12_markdown_table", "SELECT '| n_nationkey | n_name |' || chr(10) || '| --- | --- |' || chr(10) || string_agg('| ' || n_nationkey || ' | ' || n_name || ' |', chr(10) ORDER BY n_nationkey) AS markdown FROM nation")
def s12(spark, sf):
    return O.markdown_rows(table(spark, sf, "nation").select("n_nationkey", "n_name"), ["n_nationkey"])


@query("s15_graph_round_trip", f"WITH {GRAPH} SELECT source, target, relation, doc_id FROM edges")
def s15(spark, sf):
    path = place(spark, "graph")
    nodes, edges = graph(spark, sf)
    O.write_graph(nodes, edges, path)
    return O.read_graph(spark, path)[1]


@query("s17_transcripts", "SELECT conv_id, md5('# session ' || conv_id || chr(10) || chr(10) || 'messages: ' || count(*) || chr(10) || chr(10) || string_agg('## ' || role || chr(10) || chr(10) || text, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY turn)) AS markdown_md5 FROM conversations GROUP BY conv_id")
def s17(spark, sf):
    return O.transcripts(table(spark, sf, "conversations")).select("conv_id", F.md5("markdown").alias("markdown_md5"))


@query("s18_profile_markdown")
def s18(spark, sf):
    o = table(spark, sf, "orders").select(*_TEXT)
    return O.profile_markdown(P.value_counts(o, _TEXT), P.missing(o))


@query("s19_fact_sheets", f"WITH {DOCS}, {CHUNKS}, b AS (SELECT doc_id, string_agg(content, chr(10) ORDER BY idx) AS body, count(*) AS n FROM chunks GROUP BY doc_id) SELECT docs.doc_id, md5('# ' || title || chr(10) || 'tags: ' || array_to_string(tags, ', ') || chr(10) || 'chunks: ' || coalesce(n, 0) || chr(10) || chr(10) || substring(coalesce(body, ''), 1, 8000) || chr(10) || chr(10) || '---' || chr(10)) AS sheet_md5 FROM docs LEFT JOIN b ON docs.doc_id = b.doc_id")
def s19(spark, sf):
    return O.fact_sheets(docs(spark, sf), chunks(spark, sf)).select("doc_id", F.md5("sheet").alias("sheet_md5"))


@query("s20_hit_lines", f"WITH {BM25}, {DOCS} SELECT query_id, rank, '[' || rank || '] ' || title || chr(10) || replace(substring(content, 1, 300), chr(10), ' ') AS line FROM keyword k JOIN chunks USING (chunk_id) JOIN docs ON k.doc_id = docs.doc_id WHERE rank <= 3")
def s20(spark, sf):
    return O.hit_lines(R.enrich(keyword(spark, sf, 3), chunks(spark, sf), docs(spark, sf)))


@query("s21_report", f"WITH {_EVAL}, c AS (SELECT * FROM m) SELECT 'summary' AS part, {_ROW} FROM c UNION ALL SELECT 'misses', count(*), 0, 0, 0 FROM c WHERE recall = 0")
def s21(spark, sf):
    from corpusmill.operators import evaluate as E
    from corpusmill.plans.retrieval import judged

    path = place(spark, "report")
    per_query = E.metrics(judged(spark, sf))
    E.save_report(per_query, E.summary(per_query), path, worst=1_000_000)
    summary = spark.read.schema("total long, recall double, mrr double, ndcg double").json(f"{path}/summary").select(F.lit("summary").alias("part"), "*")
    misses = spark.read.schema("query_id long").json(f"{path}/misses").agg(F.count("*").alias("total"))
    return summary.unionByName(misses.select(F.lit("misses").alias("part"), "total", *[F.lit(0.0).alias(c) for c in ("recall", "mrr", "ndcg")]))
