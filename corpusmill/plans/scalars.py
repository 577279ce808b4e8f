"""Queries over the scalar functions, each applied to a whole table."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusmill.functions import parsing as P
from corpusmill.functions import segment as G
from corpusmill.functions import text as X
from corpusmill.functions import vectors as V
from corpusmill.operators import retrieve as R
from corpusmill.plans.base import CHUNKS, DOCS, chunks, docs, query, questions, table
from corpusmill.sources.sinks import written

STOPS = ", ".join(f"'{w}'" for w in X.STOP_WORDS)
#: Tokens of a text column in DuckDB (test texts have no CJK).
WORDS = f"list_filter(regexp_extract_all(lower({{0}}), '[\\p{{{{L}}}}]+|[\\p{{{{N}}}}]+'), lambda w: w NOT IN ({STOPS}))"


def words_sql(column: str) -> str:
    return WORDS.format(column)


def seen(expr: str) -> str:
    """A list without later repeats."""
    return f"list_filter({expr}, lambda x, i: list_position({expr}, x) = i)"


@query("x1_normalize", "SELECT doc_id, md5(lower(text)) AS normal_md5 FROM documents")
def x1(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.md5(X.normalize(F.col("text"))).alias("normal_md5"))


@query(
    "x2_tokenize",
    f"""WITH w AS (SELECT item_id, {words_sql('text')} AS w FROM benchmark),
    p AS (SELECT item_id, w, list_transform(range(1, CAST(greatest(len(w), 1) AS BIGINT)), lambda i: w[i] || '_' || w[i + 1]) AS b FROM w)
    SELECT item_id, array_to_string(list_concat({seen('w')}, {seen('b')}), ' ') AS tokens FROM p""",
)
def x2(spark, sf):
    return table(spark, sf, "benchmark").select("item_id", F.array_join(X.tokens(F.col("text")), " ").alias("tokens"))


@query("x2_segmented")
def x2s(spark, sf):
    """Tokens by a dictionary of the corpus' own words, which also cuts compounds and words that it does not hold."""
    words = table(spark, sf, "documents").select(X.word_run(F.col("text")).alias("w"))
    known = G.frequencies(written(words, "corpus-words").select(F.explode("w").alias("word")), 20_000, 5)
    return table(spark, sf, "benchmark").select("item_id", F.array_join(X.tokens(F.col("text"), segment=G.dictionary_segmenter(known)), " ").alias("tokens"))


@query("x3_token_estimates", "SELECT doc_id, length(text) // 2 AS tokens, CAST(floor(length(text) * 1.2) AS BIGINT) AS budget, md5(substring(text, 1, 833)) AS cut_md5 FROM documents")
def x3(spark, sf):
    t = F.col("text")
    return table(spark, sf, "documents").select("doc_id", X.estimate_tokens(t).alias("tokens"), X.budget_tokens(t).alias("budget"), F.md5(X.cut_to_tokens(t, 1000)).alias("cut_md5"))


@query("x4_content_ids", "SELECT doc_id, substring(sha256(text), 1, 32) AS content_id, sha256(lower(trim(title))) AS title_hash FROM (SELECT doc_id, text, source || '/' || doc_id AS title FROM documents)")
def x4(spark, sf):
    return docs(spark, sf).select("doc_id", X.content_id(F.col("text")).alias("content_id"), X.query_hash(F.col("title")).alias("title_hash"))


_VOTE = "list_sum(list_transform(w, lambda x: CASE WHEN (CAST(('0x' || substring(md5(x), {0}, 8)) AS BIGINT) >> {1}) & 1 = 1 THEN 1 ELSE -1 END))"
_HALF = lambda first: " + ".join(f"CASE WHEN {_VOTE.format(first, k)} > 0 THEN {1 << k} ELSE 0 END" for k in range(32))
SIMHASH = f"SELECT doc_id, CAST({_HALF(17)} AS BIGINT) AS hi, CAST({_HALF(25)} AS BIGINT) AS lo FROM (SELECT doc_id, regexp_extract_all(lower(text), '[a-z]+|[0-9]+') AS w FROM documents)"


@query("x5_simhash", SIMHASH)
def x5(spark, sf):
    return table(spark, sf, "documents").select("doc_id", V.simhash(F.col("text")).alias("h")).select("doc_id", "h.hi", "h.lo")


@query(
    "x6_hamming",
    f"""WITH s AS ({SIMHASH}), n AS (SELECT doc_id, hi, lo, lag(hi) OVER (PARTITION BY doc_id // 8 ORDER BY doc_id) AS phi, lag(lo) OVER (PARTITION BY doc_id // 8 ORDER BY doc_id) AS plo FROM s)
    SELECT doc_id, CAST(bit_count(xor(hi, phi)) + bit_count(xor(lo, plo)) AS INTEGER) AS distance, 1 - (bit_count(xor(hi, phi)) + bit_count(xor(lo, plo))) / 64.0::DOUBLE AS similarity FROM n WHERE phi IS NOT NULL""",
)
def x6(spark, sf):
    from pyspark.sql import Window

    rows = table(spark, sf, "documents").select("doc_id", V.simhash(F.col("text")).alias("h"))
    rows = rows.withColumn("p", F.lag("h").over(Window.partitionBy(F.floor(F.col("doc_id") / 8)).orderBy("doc_id"))).where("p is not null")
    d = V.hamming(F.col("h"), F.col("p"))
    return rows.select("doc_id", d.alias("distance"), V.similarity(d).alias("similarity"))


_COS = "list_sum(list_transform(range(1, 65), lambda i: e[i]::DOUBLE * q[i]::DOUBLE)) / (sqrt(list_sum(list_transform(e, lambda x: x::DOUBLE * x::DOUBLE))) * sqrt(list_sum(list_transform(q, lambda x: x::DOUBLE * x::DOUBLE))))"


@query("x7_cosine", f"WITH z AS (SELECT embedding AS q FROM embeddings WHERE vec_id = 0), v AS (SELECT vec_id, embedding AS e FROM embeddings) SELECT vec_id, round({_COS}, 6) + 0 AS cosine FROM v, z")
def x7(spark, sf):
    rows = table(spark, sf, "embeddings")
    zero = rows.where("vec_id = 0").select(F.col("embedding").alias("q"))  # one row
    return rows.join(F.broadcast(zero)).select("vec_id", (F.round(V.cosine(F.col("embedding"), F.col("q")), 6) + 0).alias("cosine"))


@query("x8_score_maps", f"WITH z AS (SELECT embedding AS q FROM embeddings WHERE vec_id = 0), v AS (SELECT vec_id, embedding AS e FROM embeddings), c AS (SELECT vec_id, {_COS} AS c FROM v, z) SELECT vec_id, round(greatest(0, 1 - (1 - c) / 2), 6) AS score, round(1 / (1 + exp(-c)), 6) AS sigmoid FROM c")
def x8(spark, sf):
    rows = table(spark, sf, "embeddings")
    zero = rows.where("vec_id = 0").select(F.col("embedding").alias("q"))  # one row
    c = rows.join(F.broadcast(zero)).select("vec_id", V.cosine(F.col("embedding"), F.col("q")).alias("c"))
    return c.select("vec_id", F.round(V.distance_score(1 - F.col("c")), 6).alias("score"), F.round(V.sigmoid(F.col("c")), 6).alias("sigmoid"))


@query("x9_compress", "SELECT doc_id, md5(CASE WHEN length(text) > 400 THEN substring(text, 1, 200) || chr(10) || '...' || chr(10) || right(text, 200) ELSE text END) AS compressed_md5 FROM documents")
def x9(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.md5(X.compress(F.col("text"), 400)).alias("compressed_md5"))


def _math_sql(t: str) -> str:
    for pattern in (r"(?s)\$\$(.*?)\$\$", r"(?s)\$(.*?)\$"):
        t = f"regexp_replace({t}, '{pattern}', '\\1', 'g')"
    for command, sign in X.LATEX:
        t = f"replace({t}, '{command}', '{sign}')"
    for pattern in (r"(?s)\\mathbf\{(.*?)\}", r"(?s)\\text\{(.*?)\}"):
        t = f"regexp_replace({t}, '{pattern}', '\\1', 'g')"
    return f"replace(replace({t}, '\\\\', chr(10)), '  ', ' ')"


_RAW_MATH = "'$$' || doc_id || ' \\times 2 = \\mathbf{' || n_chars || '}$$ and $x \\leq y \\\\ z$  ' || text"


@query("x10_plain_math", f"SELECT doc_id, {_math_sql(_RAW_MATH)} AS plain FROM documents")
def x10(spark, sf):
    raw = F.concat(F.lit("$$"), F.col("doc_id").cast("string"), F.lit(" \\times 2 = \\mathbf{"), F.col("n_chars").cast("string"), F.lit("}$$ and $x \\leq y \\\\ z$  "), "text")
    return table(spark, sf, "documents").select("doc_id", X.plain_math(raw).alias("plain"))


ANSWERS = "answers AS (SELECT conv_id, turn, text || ' [' || (turn % 4) || '] [' || (conv_id % 6) || ']' AS content, 3 AS n_sources FROM conversations WHERE role = 'assistant')"


def answers(spark, sf):
    rows = table(spark, sf, "conversations").where("role = 'assistant'")
    mark = F.concat(F.lit(" ["), (F.col("turn") % 4).cast("string"), F.lit("] ["), (F.col("conv_id") % 6).cast("string"), F.lit("]"))
    return rows.select("conv_id", "turn", F.concat("text", mark).alias("content"), F.lit(3).alias("n_sources"))


_CITED = seen("list_transform(regexp_extract_all(content, '\\[(\\d{1,3})\\]', 1), lambda x: CAST(x AS INTEGER))")
_BARE = "regexp_replace(regexp_replace(regexp_replace(content, '\\[\\d{1,3}\\]', '', 'g'), '\\s+', '', 'g'), '[，。！？、；：“”‘’\"''（）()【】,.!?;:—\\[\\]-]', '', 'g')"


@query(
    "x11_citations",
    f"""WITH {ANSWERS}, c AS (SELECT *, {_CITED} AS cited FROM answers), v AS (SELECT *, list_filter(cited, lambda x: x BETWEEN 1 AND 3) AS valid, list_filter(cited, lambda x: NOT x BETWEEN 1 AND 3) AS invalid, {_BARE} AS bare FROM c)
    SELECT conv_id, turn, array_to_string(cited, ',') AS cited, array_to_string(valid, ',') AS valid, array_to_string(invalid, ',') AS invalid, md5(list_reduce(list_prepend(content, list_transform(invalid, lambda x: CAST(x AS VARCHAR))), lambda t, n: replace(t, '[' || n || ']', ''))) AS kept_md5,
      length(bare) >= 20 AND len(valid) = 0 AS warning FROM v""",
)
def x11(spark, sf):
    t, n = F.col("content"), F.col("n_sources")
    wrong = X.invalid_citations(t, n)
    show = lambda a: F.array_join(F.transform(a, lambda x: x.cast("string")), ",")
    return answers(spark, sf).select("conv_id", "turn", show(X.citations(t)).alias("cited"), show(X.valid_citations(t, n)).alias("valid"), show(wrong).alias("invalid"), F.md5(X.drop_citations(t, wrong)).alias("kept_md5"), X.citation_warning(t, n).alias("warning"))


@query("x12_drop_labels", "SELECT conv_id, turn, md5(trim(replace(regexp_replace('[事实] ' || text || ' [偏好]', '\\s*\\[(偏好|身份|事实|主题|用户偏好|关键事实|关注主题|未解决问题)\\]', '', 'g'), '  ', ' '))) AS clean_md5 FROM conversations")
def x12(spark, sf):
    return table(spark, sf, "conversations").select("conv_id", "turn", F.md5(X.drop_labels(F.concat(F.lit("[事实] "), "text", F.lit(" [偏好]")))).alias("clean_md5"))


@query("x13_clean_symbols", "SELECT doc_id, md5(regexp_replace(regexp_replace('■ ' || text || ' ★', '[\\x{25A0}-\\x{25FF}\\x{2600}-\\x{27BF}\\x{2B00}-\\x{2BFF}]', '', 'g'), '[ \\t]{3,}', ' ', 'g')) AS clean_md5 FROM documents")
def x13(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.md5(X.clean_symbols(F.concat(F.lit("■ "), "text", F.lit(" ★")))).alias("clean_md5"))


@query("x14_join_lines")
def x14(spark, sf):
    t = X.join_lines(F.col("text"))
    return table(spark, sf, "documents").select("doc_id", F.md5(t).alias("joined_md5"), F.size(F.split(t, "\n")).alias("n_lines"))


@query(
    "x16_query_class",
    "WITH k AS (SELECT item_id, CASE WHEN regexp_matches(lower(text), 'what|how|why|que |was ') THEN 'fuzzy' WHEN regexp_matches(lower(text), 'street|number|straße') THEN 'precise' ELSE 'normal' END AS kind FROM benchmark) SELECT item_id, kind, CASE kind WHEN 'fuzzy' THEN 0.3::DOUBLE WHEN 'precise' THEN 0.5::DOUBLE ELSE 0.4::DOUBLE END AS w_keyword, CASE kind WHEN 'fuzzy' THEN 0.7::DOUBLE WHEN 'precise' THEN 0.5::DOUBLE ELSE 0.6::DOUBLE END AS w_vector FROM k",
)
def x16(spark, sf):
    rows = table(spark, sf, "benchmark").select("item_id", R.query_class(F.col("text"), FUZZY, PRECISE).alias("kind"))
    a, b = R.class_weights(F.col("kind"))
    return rows.select("item_id", "kind", a.alias("w_keyword"), b.alias("w_vector"))


FUZZY, PRECISE = ["what", "how", "why", "que ", "was "], ["street", "number", "straße"]

# Words of greetings and of questions, for texts in Latin script.
GREETING, KNOWLEDGE = ["hello", "hi", "hey", "thanks", "bye"], ["what", "how", "why", "when", "where", "who", "which"]


@query(
    "x17_intent",
    "SELECT conv_id, turn, intent, intent <> 'knowledge' AS skip_retrieval, intent = 'knowledge' AS use_cache FROM (SELECT conv_id, turn, CASE WHEN trim(text) = '' THEN 'chat' WHEN length(trim(text)) <= 15 AND regexp_matches(lower(text), 'hello|hi|hey|thanks|bye') THEN 'greeting' WHEN regexp_matches(text, 'what|how|why|when|where|who|which') THEN 'knowledge' WHEN trim(text) IN ('ok', 'yes', 'no') THEN 'chat' ELSE 'knowledge' END AS intent FROM conversations WHERE role = 'user')",
)
def x17(spark, sf):
    from corpusmill.operators.context import intent

    rows = table(spark, sf, "conversations").where("role = 'user'").select("conv_id", "turn", intent(F.col("text"), GREETING, KNOWLEDGE, ["ok", "yes", "no"]).alias("intent"))
    return rows.withColumns({"skip_retrieval": F.col("intent") != "knowledge", "use_cache": F.col("intent") == "knowledge"})


@query("x21_lenient_json", "SELECT event_id, CAST(json_extract_string(props, '$.' || k) AS VARCHAR) AS value FROM (SELECT event_id, props, json_keys(props)[1] AS k FROM events)")
def x21(spark, sf):
    raw = F.concat(F.lit("Answer:\n```json\n"), "props", F.lit("\n```\nend"))
    parsed = P.lenient_json(raw, "map<string,string>")
    rows = table(spark, sf, "events").select("event_id", parsed.alias("p"))
    return rows.select("event_id", F.element_at(F.map_values("p"), 1).alias("value"))


@query("x22_tag_list", "SELECT doc_id, array_to_string(tags, ';') AS tags FROM (SELECT doc_id, [lang, source] AS tags FROM documents)")
def x22(spark, sf):
    raw = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit('["'), "lang", F.lit('", "'), "source", F.lit('"]'))).when(F.col("doc_id") % 3 == 1, F.concat_ws("，", "lang", "source")).otherwise(F.concat(F.lit('tags: ["'), "lang", F.lit('","'), "source", F.lit('"] ok')))
    return table(spark, sf, "documents").select("doc_id", F.array_join(P.tag_list(raw), ";").alias("tags"))


@query("x23_sub_queries", "SELECT item_id, CASE WHEN len(l) > 1 THEN l[1:4] ELSE [] END AS parts FROM (SELECT item_id, list_filter(list_transform(string_split(replace(text, chr(10), ' '), '. '), lambda x: trim(x)), lambda x: x <> '') AS l FROM benchmark)")
def x23(spark, sf):
    sentences = F.split(F.replace("text", F.lit("\n"), F.lit(" ")), r"\. ")
    raw = F.array_join(F.transform(sentences, lambda s, k: F.concat((k + 1).cast("string"), F.lit(". "), s)), "\n")
    return table(spark, sf, "benchmark").select("item_id", P.sub_queries(raw).alias("parts"))


@query("x24_grounded", "SELECT doc_id, md5(string_agg(CASE WHEN length(s) % 2 = 0 THEN s ELSE s || ' [ungrounded]' END, '' ORDER BY i)) AS marked_md5 FROM (SELECT doc_id, unnest(l) AS s, generate_subscripts(l, 1) AS i FROM (SELECT doc_id, string_split(text, '. ') AS l FROM documents)) GROUP BY doc_id")
def x24(spark, sf):
    parts = F.transform(F.split("text", r"\. "), lambda s: F.struct(s.alias("text"), (F.length(s) % 2 == 0).alias("grounded")))
    return table(spark, sf, "documents").select("doc_id", F.md5(X.grounded(parts)).alias("marked_md5"))


@query("x25_should_retry", "SELECT doc_id, doc_id % 4 < 2 AND (toxic = 1 OR (quality = 0 AND doc_id % 10 / 10.0 >= 0.3)) AS retry FROM labels")
def x25(spark, sf):
    return table(spark, sf, "labels").select("doc_id", P.should_retry(F.col("doc_id") % 4, 2, F.col("toxic") == 1, F.col("quality") == 0, F.col("doc_id") % 10 / 10.0).alias("retry"))


@query("x26_highlight", f"WITH {CHUNKS} SELECT chunk_id, replace(replace(substring(content, 1, 200), chr(10), ' '), 'the', '**the**') AS shown FROM chunks WHERE contains(content, 'the')")
def x26(spark, sf):
    return chunks(spark, sf).where(F.contains("content", F.lit("the"))).select("chunk_id", X.highlight(F.col("content"), F.lit("the")).alias("shown"))


@query("x27_safe_name", f"WITH {DOCS} SELECT doc_id, regexp_replace(title, '[^0-9A-Za-z_-]', '_', 'g') AS name FROM docs")
def x27(spark, sf):
    return docs(spark, sf).select("doc_id", X.safe_name(F.col("title")).alias("name"))


@query("x28_activity_time", "SELECT event_id, date_trunc('minute', ts) AS at FROM events")
def x28(spark, sf):
    short = F.when(F.col("event_id") % 2 == 0, F.date_format("ts", "yyyy-MM-dd HH:mm")).otherwise(F.date_format("ts", "MM-dd HH:mm"))
    return table(spark, sf, "events").select("event_id", X.activity_time(short, F.year("ts")).alias("at"))


@query("x30_inject_title", f"WITH {DOCS} SELECT doc_id, '[t] doc=' || title || ' | lang=' || language AS line FROM docs")
def x30(spark, sf):
    line = F.concat(F.lit("[t] "), F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("doc="), "title", F.lit(" | "))).otherwise(F.lit("")), F.lit("lang="), "language")
    return docs(spark, sf).select("doc_id", X.inject_title(line, F.col("title")).alias("line"))
