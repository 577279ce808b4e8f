"""Inverted index, BM25, vectors, rank fusion, reranking and enrichment, for a table of queries at once.

Results are rows (query_id, chunk_id, doc_id, score, rank, ...). Ranks break ties by chunk_id. The query side is small next to the
index: query terms meet postings on the term, so only chunks with a query's terms are scored, and each chunk's score is
one sum. No operator compares every query with every chunk but exact vector search, which takes queries in blocks.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.functions import text as X
from corpusmill.operators.best import nearest
from corpusmill.sources.sinks import sized, written

K1, B = 1.5, 0.35
RRF_K = 30
#: Blocks of queries that are sent to the tasks to search vectors; more are met by shuffle.
MOST_BLOCKS = 40
#: Weights (keyword, vector) of each query class.
CLASS_WEIGHTS = {"fuzzy": (0.3, 0.7), "precise": (0.5, 0.5), "normal": (0.4, 0.6)}
# Marks of loosely worded queries and of queries that name a place or number.
FUZZY = "怎么 如何 哪些 哪种 在哪 哪里 哪儿 什么 为何 为什么 怎样 啥 多少 有没有 是不是 可以吗 好吗".split()
PRECISE = "街道 社区 镇 村 区 市 省 号 字 〔 【 第 照料中心 服务中心 服务站 管理站".split()


def postings(chunks: DataFrame, tf: str = "binary") -> DataFrame:
    """(token, chunk_id, doc_id, tf, length). binary: a token counts once per chunk, and length is the number of distinct tokens."""
    if tf == "binary":
        return spread_tokens(written(token_rows(chunks), "chunk-tokens"))  # exploded from a table: else the tokens would be worked out again
    rows = chunks.select("chunk_id", "doc_id", X.word_run(F.col("content")).alias("t"))
    every = rows.select("chunk_id", "doc_id", F.size("t").cast("long").alias("length"), F.explode("t").alias("token"))
    return every.groupBy("token", "chunk_id", "doc_id", "length").agg(F.count("*").alias("tf"))


def token_rows(chunks: DataFrame) -> DataFrame:
    """(chunk_id, doc_id, tokens): the distinct tokens of each chunk."""
    return chunks.select("chunk_id", "doc_id", X.tokens(F.col("content")).alias("tokens"))


def spread_tokens(rows: DataFrame) -> DataFrame:
    """Binary postings of token_rows()."""
    return rows.select(F.explode("tokens").alias("token"), "chunk_id", "doc_id", F.lit(1).cast("long").alias("tf"), F.size("tokens").cast("long").alias("length"))


def token_stats(index: DataFrame) -> DataFrame:
    return index.groupBy("token").agg(F.count("*").alias("df"))


def index_info(index: DataFrame) -> DataFrame:
    """Chunks, vocabulary, total tokens and average length in one row."""
    per_chunk = index.groupBy("chunk_id").agg(F.max("length").alias("length"))
    size = per_chunk.agg(F.count("*").alias("chunks"), F.coalesce(F.sum("length"), F.lit(0)).alias("total_tokens"))
    vocabulary = index.agg(F.count_distinct("token").alias("vocabulary"))
    return size.join(vocabulary).select("chunks", "vocabulary", "total_tokens", F.when(F.col("chunks") > 0, F.col("total_tokens") / F.col("chunks")).otherwise(0.0).alias("avg_length"))


def top_k(results: DataFrame, k: int, score: str = "score") -> DataFrame:
    """The k best results of each query by score rounded to six places, then chunk_id, with their rank."""
    order = Window.partitionBy("query_id").orderBy(F.round(score, 6).desc(), "chunk_id")
    return results.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def query_tokens(queries: DataFrame) -> DataFrame:
    return queries.select("query_id", F.explode(X.tokens(F.col("query"))).alias("token"))


def token_weight(n: Column) -> Column:
    """Weight of a token (token, df) among n chunks: single characters and very common pairs count less."""
    return F.when(F.length("token") == 1, 0.6).when((F.length("token") == 2) & ~F.contains("token", F.lit("_")) & (F.col("df") > n * F.lit(0.5)) & (n > 10), 0.8).otherwise(1.0)


def bm25(index: DataFrame, queries: DataFrame, k: int = 10, k1: float = K1, b: float = B, lengths: DataFrame | None = None) -> DataFrame:
    """BM25 of each query's tokens over the index, the k best chunks of each query. lengths: (chunk_id, length) of the index's chunks, where they are at hand."""
    lengths = index.select("chunk_id", "length").distinct() if lengths is None else lengths
    size = lengths.agg(F.count("*").cast("double").alias("n"), (F.sum("length") / F.count("*")).alias("avgdl"))
    asked = written(query_tokens(queries), "query-tokens")
    used = index.join(sized(written(asked.select("token").distinct(), "query-words"), 200_000), "token", "left_semi")
    df = used.groupBy("token").agg(F.count("*").alias("df")).join(F.broadcast(size))  # one row
    idf = F.greatest(F.lit(0.0), F.log((F.col("n") - F.col("df") + F.lit(0.5)) / (F.col("df") + F.lit(0.5)) + 1))
    terms = asked.join(df.select("token", (idf * token_weight(F.col("n"))).alias("idf"), "avgdl"), "token")
    part = F.col("idf") * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("length") / F.col("avgdl")))
    hits = terms.join(used, "token").groupBy("query_id", "chunk_id", "doc_id").agg(F.sum(part).alias("score"))
    return top_k(hits, k)


def vector_search(vectors: DataFrame, queries: DataFrame, k: int = 10, where: Column | None = None, block: int = 256) -> DataFrame:
    """The k nearest vectors (chunk_id, doc_id, embedding) of each query (query_id, embedding) by cosine, scored max(0, 1 - distance / 2).

    The queries are a stated set against all vectors, met as matrices inside the tasks. Up to MOST_BLOCKS blocks of queries the vectors are read once and stay where they
    are; only each task's best rows are shuffled."""
    rows = vectors if where is None else vectors.where(where)
    return top_k(nearest(rows.select("chunk_id", "doc_id", "embedding"), queries, k, lambda c: np.maximum(0.0, 1 - (1 - c) / 2), MOST_BLOCKS * block), k)


def query_class(query: Column, fuzzy: list[str] = FUZZY, precise: list[str] = PRECISE) -> Column:
    has = lambda marks: F.lower(query).rlike("|".join(map(_quoted, marks)))
    return F.when(query.isNull() | (query == ""), "normal").when(has(fuzzy), "fuzzy").when(has(precise), "precise").otherwise("normal")


def _quoted(mark: str) -> str:
    return "".join(c if c.isalnum() or c == " " else "\\" + c for c in mark)


def class_weights(kind: Column) -> tuple[Column, Column]:
    pick = lambda side: F.when(kind == "fuzzy", CLASS_WEIGHTS["fuzzy"][side]).when(kind == "precise", CLASS_WEIGHTS["precise"][side]).otherwise(CLASS_WEIGHTS["normal"][side])
    return pick(0), pick(1)


def fuse(keyword: DataFrame, vector: DataFrame, queries: DataFrame, k: int = 10, rrf_k: int = RRF_K, fuzzy: list[str] = FUZZY, precise: list[str] = PRECISE) -> DataFrame:
    """Weighted reciprocal ranks of two ranked lists, with the source of each hit."""
    left = keyword.select("query_id", "chunk_id", F.col("doc_id").alias("d1"), F.col("rank").alias("r1"))
    right = vector.select("query_id", "chunk_id", F.col("doc_id").alias("d2"), F.col("rank").alias("r2"))
    both = left.join(right, ["query_id", "chunk_id"], "full_outer").join(queries.select("query_id", query_class(F.col("query"), fuzzy, precise).alias("kind")), "query_id", "left")
    w1, w2 = class_weights(F.col("kind"))
    score = F.coalesce(w1 / (rrf_k + F.col("r1")), F.lit(0.0)) + F.coalesce(w2 / (rrf_k + F.col("r2")), F.lit(0.0))
    source = F.when(F.col("r1").isNotNull() & F.col("r2").isNotNull(), "both").when(F.col("r1").isNotNull(), "bm25").otherwise("vector")
    return top_k(both.select("query_id", "chunk_id", F.coalesce("d1", "d2").alias("doc_id"), score.alias("score"), source.alias("source")), k)


def enrich(results: DataFrame, chunks: DataFrame, docs: DataFrame, format_of: Column | None = None) -> DataFrame:
    """results with content, place, title and, where chunks have one, heading; hits whose chunk is gone disappear, a missing document leaves the title null."""
    rows = sized(written(results, "hits")).join(chunks.select("chunk_id", "content", "idx", *[c for c in chunks.columns if c == "heading"]), "chunk_id")
    rows = written(rows, "hit-chunks")
    told = docs.join(sized(written(rows.select("doc_id").distinct(), "hit-docs")), "doc_id", "left_semi")
    rows = rows.join(told.select("doc_id", F.col("title").alias("doc_title"), "file_type"), "doc_id", "left")
    return rows.withColumn("paragraph_num", F.col("idx") + 1).drop("idx")


def exact_match_rerank(results: DataFrame, queries: DataFrame) -> DataFrame:
    """Scores times 0.5 + the share of the query's distinctive tokens that a hit has in title, heading or content. Distinctive: over one
    character, and in some hits of the query but in fewer than seven tenths. Queries of one hit or one token keep their scores."""
    fields = [F.coalesce(c, F.lit("")) for c in ("doc_title", "heading", "content") if c in results.columns]
    hits = results.withColumn("own", X.tokens(F.concat_ws(" ", *fields)))
    asked = queries.select("query_id", X.tokens(F.col("query")).alias("asked"))
    hits = written(hits.join(asked, "query_id", "left").withColumn("found", F.array_intersect("asked", "own")), "rerank-hits")
    per_query = hits.groupBy("query_id").agg(F.count("*").alias("n"))
    seen = hits.select("query_id", F.explode("found").alias("token")).groupBy("query_id", "token").agg(F.count("*").alias("c")).join(per_query, "query_id")
    marks = seen.where((F.col("c") < F.col("n") * 0.7) & (F.length("token") > 1)).groupBy("query_id").agg(F.collect_set("token").alias("marks"))
    hits = hits.join(marks, "query_id", "left").join(per_query, "query_id")
    share = F.size(F.array_intersect("found", "marks")) / F.size("marks")
    use = F.col("marks").isNotNull() & (F.col("n") > 1) & (F.size("asked") >= 2)
    return hits.withColumn("score", F.when(use, F.col("score") * (0.5 + share)).otherwise(F.col("score"))).drop("own", "asked", "found", "marks", "n", "rank")


def rerank_by_scores(results: DataFrame, scores: DataFrame, k: int) -> DataFrame:
    """The k best by a table of scores (query_id, chunk_id, relevance); a missing score counts 0, equal ones keep their order."""
    rows = results.join(scores, ["query_id", "chunk_id"], "left").withColumn("relevance", F.coalesce("relevance", F.lit(0.0)))
    order = Window.partitionBy("query_id").orderBy(F.desc("relevance"), "rank")
    return rows.withColumn("new_rank", F.row_number().over(order)).where(F.col("new_rank") <= k).drop("rank").withColumnRenamed("new_rank", "rank")


def gate(results: DataFrame, reject: float = 0.15, low: float = 0.05, score: str = "score") -> DataFrame:
    """rejected: the query's best score is below reject; low_confidence: below low."""
    best = F.max(score).over(Window.partitionBy("query_id"))
    return results.withColumn("rejected", best < reject).withColumn("low_confidence", best < low)


def merge_sub_queries(results: DataFrame, k: int) -> DataFrame:
    """Results of sub-queries (query_id: the parent) with the best score of each chunk, at most 2k."""
    best = results.groupBy("query_id", "chunk_id").agg(F.max_by("doc_id", "score").alias("doc_id"), F.max("score").alias("score"))
    return top_k(best, 2 * k)


def small_to_big(results: DataFrame, table_format: str = "excel") -> DataFrame:
    """content replaced by a longer parent_content, but for table formats; else neighbours (context) appended after a separator."""
    longer = (F.col("format_tag") != table_format) & (F.length(F.coalesce("parent_content", F.lit(""))) > F.length("content"))
    appended = F.when(F.coalesce("context", F.lit("")) != "", F.concat("content", F.lit("\n\n---\n\n"), "context")).otherwise(F.col("content"))
    return results.withColumn("content", F.when(longer, F.trim("parent_content")).otherwise(appended))


def reconcile(index_ids: DataFrame, table_ids: DataFrame) -> DataFrame:
    """(id, status): expired ids are in the index alone, missing ones in the table alone."""
    a, b = index_ids.select("id", F.lit(1).alias("i")), table_ids.select("id", F.lit(1).alias("t"))
    status = F.when(F.col("t").isNull(), "expired").when(F.col("i").isNull(), "missing").otherwise("same")
    return a.join(b, "id", "full_outer").select("id", status.alias("status"))


def sync_plan(index_ids: DataFrame, table_ids: DataFrame) -> DataFrame:
    """One row: counts, and whether to do nothing, to repair or to rebuild the index (empty, or nothing in it is current)."""
    n = reconcile(index_ids, table_ids).agg(*[F.count_if(F.col("status") == s).alias(s) for s in ("same", "expired", "missing")])
    plan = F.when((F.col("expired") == 0) & (F.col("missing") == 0), "in_sync").when(F.col("same") == 0, "rebuild").otherwise("incremental")
    return n.withColumn("plan", plan)


def coarse_k(k: int) -> int:
    """Candidates of each retriever before fusion."""
    return max(5 * k, 50)


def hybrid_search(keyword: DataFrame, chunks: DataFrame, docs: DataFrame, queries: DataFrame, k: int = 10, vector: DataFrame | None = None, **marks: list[str]) -> DataFrame:
    """Two ranked lists at coarse_k(k), fused, enriched and reranked by exact matches; the keyword side alone where there is no vector side."""
    found = keyword.withColumn("source", F.lit("bm25")) if vector is None else fuse(keyword, vector, queries, coarse_k(k), **marks)
    return top_k(exact_match_rerank(enrich(found, chunks, docs), queries), k)


def restricted(rows: DataFrame, allowed: DataFrame) -> DataFrame:
    """Postings or vectors of the allowed documents (doc_id), so that they alone are scored."""
    return rows.join(allowed.select("doc_id").distinct(), "doc_id", "left_semi")


def _count_letters(texts: pa.Array) -> pa.Array:
    """How often a to z stand in each text, as lists of doubles; a null text has a list of nulls. In UTF-8 the bytes of these letters are no part of others."""
    texts = texts.cast(pa.large_string())
    ends = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    whole = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    counts = np.zeros((len(texts), 26))
    for k in range(0, len(texts), 1024):  # at once
        own = ends[k : k + 1025]
        data = whole[own[0] : own[-1]] - np.uint8(97)
        row = np.repeat(np.arange(len(own) - 1), np.diff(own))
        letters = data < 26
        counts[k : k + len(own) - 1] = np.bincount(row[letters] * 26 + data[letters], minlength=26 * (len(own) - 1)).reshape(-1, 26)
    gaps = np.repeat(texts.is_null().to_numpy(zero_copy_only=False), 26)
    return pa.ListArray.from_arrays(pa.array(np.arange(len(texts) + 1) * 26, pa.int32()), pa.array(counts.ravel(), mask=gaps))


def letter_embedding(text: Column) -> Column:
    """A stand-in for an embedding model: how often each ASCII letter stands in a text, in any case."""

    @F.arrow_udf("array<double>")
    def count(texts: pa.Array) -> pa.Array:
        return _count_letters(texts)

    return count(F.lower(text))
