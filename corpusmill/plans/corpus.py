"""Queries over the catalogue and its chunks: lookups, joins, statistics, tags, facts, maintenance."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.operators import quality as Q
from corpusmill.operators import store as S
from corpusmill.operators import substring as N
from corpusmill.plans.base import CHUNKS, DOCS, chunks, docs, query, table
from corpusmill.plans.scalars import SIMHASH
from corpusmill.sources.sinks import shared_dir

IDS = f"{DOCS}, ids AS (SELECT *, substring(sha256(text), 1, 32) AS content_id FROM docs)"


def with_content_id(spark, sf):
    return docs(spark, sf).withColumn("content_id", F.substring(F.sha2("text", 256), 1, 32))


@query("f1_by_id_prefix", f"WITH {IDS} SELECT content_id, title FROM ids WHERE starts_with(content_id, 'a') ORDER BY content_id LIMIT 1")
def f1(spark, sf):
    return S.by_id(with_content_id(spark, sf), "a").select("content_id", "title")


@query("f2_keyword_scan", f"WITH {CHUNKS}, {DOCS} SELECT chunk_id, title FROM chunks JOIN docs USING (doc_id) WHERE contains(lower(content), 'the') ORDER BY doc_id DESC, idx LIMIT 20")
def f2(spark, sf):
    return S.keyword_scan(chunks(spark, sf), docs(spark, sf), "The").select("chunk_id", "title")


@query("f2_substring_index", f"WITH {CHUNKS}, {DOCS}, k AS (SELECT unnest(['tion the', 'ßt', 'ouch', 'no such words', 'e']) AS keyword) SELECT keyword, count(*) AS n, min(chunk_id) AS first, max(doc_id) AS newest FROM k JOIN chunks ON contains(lower(content), keyword) GROUP BY keyword")
def f2i(spark, sf):
    index = N.build(chunks(spark, sf), f"{shared_dir(spark)}/substring-index-{uuid.uuid4().hex}")
    hits = [N.search(index, k).select(F.lit(k).alias("keyword"), "chunk_id", "doc_id") for k in ("tion the", "ßt", "ouch", "no such words", "e")]
    return reduce(DataFrame.unionByName, hits).groupBy("keyword").agg(F.count("*").alias("n"), F.min("chunk_id").alias("first"), F.max("doc_id").alias("newest"))


@query("f3_with_tag", f"WITH {DOCS} SELECT doc_id, title FROM docs WHERE list_contains(tags, 'hq')")
def f3(spark, sf):
    return S.with_tag(docs(spark, sf), "hq").select("doc_id", "title")


@query("f4_with_tag_part", f"WITH {DOCS} SELECT doc_id FROM docs WHERE len(list_filter(tags, lambda t: contains(lower(t), 'src1'))) > 0")
def f4(spark, sf):
    return S.with_tag(docs(spark, sf), "SRC1", exact=False).select("doc_id")


@query("f6_with_tags", f"WITH {DOCS} SELECT doc_id, list_contains(tags, 'hq') AND list_contains(tags, 'en') AS every FROM docs WHERE list_contains(tags, 'hq') OR list_contains(tags, 'en')")
def f6(spark, sf):
    both = S.with_tags(docs(spark, sf), ["hq", "en"], every=True).select("doc_id", F.lit(True).alias("every"))
    return S.with_tags(docs(spark, sf), ["hq", "en"]).select("doc_id").join(both, "doc_id", "left").withColumn("every", F.coalesce("every", F.lit(False)))


@query("f7_chunk_range", f"WITH {CHUNKS} SELECT chunk_id, idx FROM chunks WHERE idx BETWEEN 1 AND 8")
def f7(spark, sf):
    return S.chunk_range(chunks(spark, sf), 2, 40).select("chunk_id", "idx")


@query("f8_assemble", f"WITH {CHUNKS} SELECT doc_id, md5(string_agg(content, chr(10) ORDER BY idx)) AS content_md5 FROM chunks GROUP BY doc_id")
def f8(spark, sf):
    return S.assemble(chunks(spark, sf)).select("doc_id", F.md5("content").alias("content_md5"))


@query("f9_untagged", f"WITH {DOCS} SELECT doc_id FROM docs WHERE NOT list_contains(tags, 'hq') AND NOT list_contains(tags, 'toxic')")
def f9(spark, sf):
    return docs(spark, sf).where(~F.arrays_overlap("tags", F.array(F.lit("hq"), F.lit("toxic")))).select("doc_id")


@query("f10_facts", "SELECT conv_id AS session, text AS fact, turn AS created FROM conversations WHERE role = 'user' AND contains(text, 'the') ORDER BY turn DESC, conv_id, text LIMIT 50")
def f10(spark, sf):
    return S.facts(_facts(spark, sf), keyword="the")


def _facts(spark, sf):
    return table(spark, sf, "conversations").where("role = 'user'").select(F.col("conv_id").alias("session"), F.col("text").alias("fact"), F.col("turn").alias("created"))


@query("f12_format_tag", f"WITH {DOCS} SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'pdf' WHEN 1 THEN 'excel' WHEN 2 THEN 'markdown' ELSE 'text' END AS format_tag FROM docs")
def f12(spark, sf):
    kind = F.element_at(F.array(F.lit("PDF"), F.lit("xls"), F.lit("md"), F.lit("odd")), (F.col("doc_id") % 4 + 1).cast("int"))
    return docs(spark, sf).select("doc_id", S.format_tag(kind).alias("format_tag"))


_BARE = "regexp_replace(regexp_replace(regexp_replace(text, '\\[\\d{1,3}\\]', '', 'g'), '\\s+', '', 'g'), '[，。！？、；：“”‘’\"''（）()【】,.!?;:—\\[\\]-]', '', 'g')"


@query("f14_substantive", f"SELECT conv_id, turn, length({_BARE}) >= 20 AS substantive FROM conversations")
def f14(spark, sf):
    from corpusmill.functions.text import substantive

    return table(spark, sf, "conversations").select("conv_id", "turn", substantive(F.col("text")).alias("substantive"))


@query("f16_page", f"WITH {DOCS} SELECT doc_id, title FROM docs ORDER BY doc_id DESC LIMIT 30 OFFSET 30")
def f16(spark, sf):
    return S.page(docs(spark, sf), 2).select("doc_id", "title")


@query("f17_facet_filter", f"WITH {DOCS} SELECT doc_id FROM docs WHERE file_type = 'src1' AND list_contains(tags, 'en') AND contains(title, '/1')")
def f17(spark, sf):
    return S.facet(docs(spark, sf), "SRC1", "EN", "/1").select("doc_id")


@query("j3_batch_metadata", f"WITH {DOCS} SELECT docs.doc_id, title, language FROM docs JOIN labels USING (doc_id)")
def j3(spark, sf):
    return docs(spark, sf).join(table(spark, sf, "labels").select("doc_id"), "doc_id").select("doc_id", "title", "language")


@query("j4_first_chunks", f"WITH {CHUNKS} SELECT doc_id, chunk_id, md5(content) AS content_md5 FROM chunks WHERE idx = 0")
def j4(spark, sf):
    return S.first_chunks(chunks(spark, sf)).select("doc_id", "chunk_id", F.md5("content").alias("content_md5"))


@query("a1_corpus_stats", f"WITH {DOCS}, {CHUNKS} SELECT (SELECT count(*) FROM docs) AS n_docs, (SELECT round(sum(octet_length(encode(text))) / 1048576.0, 2) FROM docs) AS size_mb, count(*) AS n_chunks, CAST(sum(token_count) AS BIGINT) AS n_tokens FROM chunks")
def a1(spark, sf):
    return S.stats(docs(spark, sf), chunks(spark, sf))


@query("a2_tag_counts", f"WITH {DOCS} SELECT tag, count(*) AS n FROM (SELECT unnest(tags) AS tag FROM docs) GROUP BY tag")
def a2(spark, sf):
    return S.tag_counts(docs(spark, sf))


@query("a21_sessions", """WITH e AS (SELECT user_id, max(ts) AS saved_at FROM events GROUP BY user_id)
SELECT 'session ' || conv_id AS name, any_value(saved_at) AS saved_at, count(*) AS n_messages, CAST(row_number() OVER (ORDER BY any_value(saved_at) DESC NULLS LAST, conv_id) AS INTEGER) AS position FROM conversations LEFT JOIN e ON user_id = conv_id GROUP BY conv_id QUALIFY position <= 1000""")
def a21(spark, sf):
    saved = table(spark, sf, "events").groupBy(F.col("user_id").alias("conv_id")).agg(F.max("ts").alias("saved_at"))
    return S.sessions(table(spark, sf, "conversations"), saved, 1000)


@query("a23_token_usage", "SELECT role, CAST(sum(length(text) // 2) AS BIGINT) AS tokens FROM conversations GROUP BY role UNION ALL SELECT 'total', CAST(sum(length(text) // 2) AS BIGINT) FROM conversations")
def a23(spark, sf):
    rows = table(spark, sf, "conversations").select("role", F.floor(F.length("text") / 2).alias("t"))
    return rows.rollup("role").agg(F.sum("t").alias("tokens")).select(F.coalesce("role", F.lit("total")).alias("role"), "tokens")


@query("a24_facet_tree", f"WITH {DOCS} SELECT file_type, NULL AS tag, count(*) AS n FROM docs GROUP BY file_type UNION ALL SELECT file_type, tag, count(*) FROM (SELECT file_type, unnest(tags) AS tag FROM docs) GROUP BY file_type, tag")
def a24(spark, sf):
    return S.facet_tree(docs(spark, sf))


@query("k2_newest", f"WITH {DOCS} SELECT doc_id, title FROM docs ORDER BY doc_id DESC LIMIT 20 OFFSET 10")
def k2(spark, sf):
    return docs(spark, sf).orderBy(F.desc("doc_id")).offset(10).limit(20).select("doc_id", "title")


@query("u5_distinct_in_order", "SELECT doc_id, md5(array_to_string(list_filter(l, lambda x, i: list_position(l, x) = i), chr(10))) AS lines_md5 FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)")
def u5(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.md5(F.array_join(F.array_distinct(F.split("text", "\n")), "\n")).alias("lines_md5"))


@query("u6_tag_union", f"WITH {DOCS} SELECT DISTINCT doc_id FROM (SELECT doc_id, unnest(tags) AS tag FROM docs) WHERE tag IN ('hq', 'fr')")
def u6(spark, sf):
    return docs(spark, sf).select("doc_id", F.explode("tags").alias("tag")).where(F.col("tag").isin("hq", "fr")).select("doc_id").distinct()


@query("c9_exact_duplicates", "SELECT doc_id, min(doc_id) OVER (PARTITION BY text) AS first_id, doc_id <> min(doc_id) OVER (PARTITION BY text) AS is_duplicate FROM documents")
def c9(spark, sf):
    return Q.exact_duplicates(table(spark, sf, "documents"))


CHECK_SQL = """checked AS (
  SELECT chunk_id, t, n, CASE WHEN n = 0 THEN ['empty'] ELSE list_filter([CASE WHEN n < 20 THEN 'too_short' END, CASE WHEN n - length(regexp_replace(t, '[\\x{4e00}-\\x{9fff}\\x{3400}-\\x{4dbf}a-zA-Z]', '', 'g')) < n * 0.3::DOUBLE THEN 'no_text_content' END,
    CASE WHEN (n - length(regexp_replace(t, '[□◇△▲▽▼☆★○●◎⊙¤§※]', '', 'g'))) / n > 0.3::DOUBLE THEN 'ocr_garbage' END, CASE WHEN (n - length(regexp_replace(t, '[^\\p{L}\\p{N}\\s]', '', 'g'))) / n > 0.5::DOUBLE THEN 'high_symbol_ratio' END], lambda x: x IS NOT NULL) END AS issues
  FROM (SELECT chunk_id, regexp_replace(content, '^\\s+|\\s+$', '', 'g') AS t, length(regexp_replace(content, '^\\s+|\\s+$', '', 'g')) AS n FROM chunks)
)"""


@query("d1_chunk_quality", f"WITH {CHUNKS}, {CHECK_SQL} SELECT chunk_id, array_to_string(issues, ',') AS issues, CASE WHEN list_contains(issues, 'empty') THEN 0 ELSE round(greatest(0, 1 - CAST(list_sum(list_transform(list_prepend('x', issues), lambda i: CASE i WHEN 'too_short' THEN 0.3 WHEN 'no_text_content' THEN 0.6 WHEN 'ocr_garbage' THEN 0.5 WHEN 'high_symbol_ratio' THEN 0.2 ELSE 0 END)) AS DOUBLE)), 6) END AS score, len(issues) > 0 AS is_low FROM checked")
def d1(spark, sf):
    return Q.check(chunks(spark, sf)).select("chunk_id", F.array_join("issues", ",").alias("issues"), "score", "is_low")


@query("a12_quality_report", f"""WITH {CHUNKS}, {CHECK_SQL} SELECT count(*) AS total, count(*) FILTER (len(issues) = 0) AS normal, count(*) FILTER (len(issues) > 0) AS low, count(*) FILTER (list_contains(issues, 'ocr_garbage')) AS ocr_poor,
  count(*) FILTER (list_contains(issues, 'empty')) AS n_empty, count(*) FILTER (list_contains(issues, 'too_short')) AS n_too_short, count(*) FILTER (list_contains(issues, 'no_text_content')) AS n_no_text_content, count(*) FILTER (list_contains(issues, 'ocr_garbage')) AS n_ocr_garbage, count(*) FILTER (list_contains(issues, 'high_symbol_ratio')) AS n_high_symbol_ratio,
  round(count(*) FILTER (len(issues) = 0) * 100.0 / count(*), 1)::DOUBLE AS normal_pct, round(count(*) FILTER (len(issues) = 0) * 100.0 / count(*), 1)::DOUBLE AS health FROM checked""")
def a12(spark, sf):
    return Q.report(Q.check(chunks(spark, sf))).withColumns({c: F.col(c).cast("double") for c in ("normal_pct", "health")})


_EDGES = """edges AS (
  SELECT DISTINCT source AS grp, doc_id, unnest([substring(regexp_replace(l[1], '\\s+', '', 'g'), 1, 50), substring(regexp_replace(l[-1], '\\s+', '', 'g'), 1, 50)]) AS line FROM (SELECT doc_id, source, list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '') AS l FROM documents) WHERE len(l) > 0
), sizes AS (SELECT source AS grp, count(*) AS n FROM documents WHERE trim(replace(text, chr(10), ' ')) <> '' GROUP BY source),
rules AS (SELECT grp, line, count(*) AS c FROM edges JOIN sizes USING (grp) WHERE n >= 3 GROUP BY grp, line, n HAVING count(*) >= greatest(3, n // 2) OR regexp_matches(line, '^.{0,10}\\d{1,3}$'))"""


@query("a22_repeated_edges", "WITH " + _EDGES + " SELECT grp, line, c FROM rules")
def a22(spark, sf):
    return Q.repeated_edges(table(spark, sf, "documents"), "source")


@query("x15_drop_edges", """WITH e AS (SELECT lang, list(line ORDER BY line) AS lines FROM (SELECT lang, substring(regexp_replace(l[1], '\\s+', '', 'g'), 1, 50) AS line, count(*) AS c FROM (SELECT lang, list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '') AS l FROM documents) WHERE len(l) > 0 GROUP BY ALL HAVING count(*) >= 2) GROUP BY lang)
SELECT doc_id, md5(array_to_string(list_filter(string_split(text, chr(10)), lambda x: regexp_replace(x, '\\s+', '', 'g') = '' OR len(list_filter(coalesce(lines, []), lambda y: regexp_replace(x, '\\s+', '', 'g') = y OR (length(y) >= 4 AND (starts_with(regexp_replace(x, '\\s+', '', 'g'), y) OR ends_with(regexp_replace(x, '\\s+', '', 'g'), y)) AND length(regexp_replace(x, '\\s+', '', 'g')) - length(y) <= 5))) = 0), chr(10))) AS kept_md5 FROM documents d LEFT JOIN e ON d.lang = e.lang""")
def x15(spark, sf):
    rows = table(spark, sf, "documents")
    lines = F.filter(F.split("text", "\n"), lambda x: F.trim(x) != "")
    first = rows.select("lang", lines.alias("l")).where(F.size("l") > 0).select(F.col("lang").alias("grp"), F.substring(F.regexp_replace(F.element_at("l", 1), r"\s+", ""), 1, 50).alias("line"))
    rules = first.groupBy("grp", "line").agg(F.count("*").alias("c")).where("c >= 2")
    return Q.drop_edges(rows, rules, "lang").select("doc_id", F.md5("text").alias("kept_md5"))


@query("d2_near_duplicates", f"""WITH s AS ({SIMHASH}), p AS (SELECT b.doc_id, a.doc_id AS other, CAST(bit_count(xor(a.hi, b.hi)) + bit_count(xor(a.lo, b.lo)) AS INTEGER) AS d FROM s a JOIN s b ON a.doc_id < b.doc_id AND bit_count(xor(a.hi, b.hi)) + bit_count(xor(a.lo, b.lo)) <= 9)
SELECT doc_id, arg_min(other, d::BIGINT * 1000000000 + other) AS duplicate_of, min(d) AS distance FROM p GROUP BY doc_id""")
def d2(spark, sf):
    return Q.near_duplicates(table(spark, sf, "documents"))


@query("d3_remove_chunk", f"WITH {CHUNKS} SELECT chunk_id FROM chunks WHERE chunk_id <> '0_0'")
def d3(spark, sf):
    return Q.resolve_and_remove(chunks(spark, sf), "0_0").select("chunk_id")


# Maintenance -----------------------------------------------------------------------------------------------------------

@query("s13_save_new", f"WITH {DOCS}, {CHUNKS} SELECT d.doc_id, language, count(c.chunk_id) AS chunk_count, CAST(coalesce(sum(token_count), 0) AS BIGINT) AS total_tokens FROM docs d LEFT JOIN chunks c ON d.doc_id = c.doc_id WHERE d.doc_id NOT IN (SELECT doc_id FROM labels) GROUP BY ALL")
def s13(spark, sf):
    return S.save_new(docs(spark, sf), chunks(spark, sf), table(spark, sf, "labels")).select("doc_id", "language", "chunk_count", "total_tokens")


@query("s14_ingest_log", """SELECT status, error_type, count(*) AS n FROM (SELECT CASE WHEN e = '' THEN 'success' WHEN e = 'duplicate' THEN 'skipped' ELSE 'failed' END AS status, e AS error_type FROM (
  SELECT CASE WHEN source = 'src9' THEN 'unsupported' WHEN trim(text) = '' THEN 'empty' WHEN row_number() OVER (PARTITION BY text ORDER BY doc_id) > 1 OR text IN (SELECT text FROM documents WHERE lang = 'es') THEN 'duplicate' ELSE '' END AS e FROM documents)) GROUP BY ALL""")
def s14(spark, sf):
    d = docs(spark, sf)
    known = d.where("language = 'es'").select(F.sha2("text", 256).alias("h"))
    types = [f"src{k}" for k in range(20) if k != 9]
    return S.ingest_log(d, known, types).groupBy("status", "error_type").agg(F.count("*").alias("n"))


@query("m1_cascade_delete", f"WITH {CHUNKS} SELECT doc_id, count(*) AS n FROM chunks WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1) GROUP BY doc_id")
def m1(spark, sf):
    gone = table(spark, sf, "labels").where("toxic = 1")
    left = S.cascade_delete({"docs": docs(spark, sf), "chunks": chunks(spark, sf)}, gone)
    return left["chunks"].groupBy("doc_id").agg(F.count("*").alias("n"))


@query("m2_update", f"WITH {DOCS} SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'new ' || doc_id ELSE title END AS title, array_to_string(CASE WHEN doc_id % 3 = 0 THEN ['t'] ELSE tags END, ',') AS tags FROM docs")
def m2(spark, sf):
    d = docs(spark, sf)
    changes = d.select("doc_id", F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("new "), F.col("doc_id").cast("string"))).otherwise(" ").alias("new_title"), F.when(F.col("doc_id") % 3 == 0, F.array(F.lit("t"))).alias("new_tags"))
    return S.update(d, changes).select("doc_id", "title", F.array_join("tags", ",").alias("tags"))


@query("m3_rename_tag", f"WITH {DOCS} SELECT doc_id, array_to_string(list_transform(tags, lambda t: CASE WHEN t = 'hq' THEN 'good' ELSE t END), ',') AS tags, list_contains(tags, 'hq') AS changed FROM docs")
def m3(spark, sf):
    return S.rename_tag(docs(spark, sf), "hq", "good").select("doc_id", F.array_join("tags", ",").alias("tags"), "changed")


@query("m4_merge_tag", f"WITH {DOCS} SELECT doc_id, array_to_string(CASE WHEN list_contains(tags, 'toxic') THEN list_concat(list_filter(tags, lambda t: t <> 'toxic'), CASE WHEN list_contains(tags, 'hq') THEN [] ELSE ['hq'] END) ELSE tags END, ',') AS tags, list_contains(tags, 'toxic') AS changed FROM docs")
def m4(spark, sf):
    return S.merge_tag(docs(spark, sf), "toxic", "hq").select("doc_id", F.array_join("tags", ",").alias("tags"), "changed")


@query("m5_add_facts", "SELECT session, md5(fact) AS fact_md5 FROM (SELECT conv_id AS session, text AS fact FROM conversations WHERE role = 'user' AND turn < 2 UNION SELECT conv_id, text FROM conversations WHERE role = 'user' AND turn >= 2)")
def m5(spark, sf):
    rows = _facts(spark, sf)
    old = rows.where("created < 2").dropDuplicates(["session", "fact"])
    return S.add_facts(old, rows).select("session", F.md5("fact").alias("fact_md5"))


@query("u4_merge_items", "SELECT DISTINCT user_id, event_type FROM events WHERE event_id % 2 = 1 EXCEPT SELECT user_id, event_type FROM events WHERE event_id % 2 = 0")
def u4(spark, sf):
    e = table(spark, sf, "events").select("event_id", "user_id", "event_type")
    return S.merge_items(e.where("event_id % 2 = 0"), e.where("event_id % 2 = 1"), ["user_id", "event_type"]).select("user_id", "event_type")
