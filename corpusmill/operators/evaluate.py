"""Metrics of retrieval and of judged answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def hits(results: DataFrame, expected: DataFrame) -> DataFrame:
    """results with hit: the content has an expected keyword, or the title an expected part, in any case. expected (query_id, keywords, titles)."""
    rows = results.join(expected, "query_id")
    inside = lambda c, words: F.exists(words, lambda k: F.contains(F.lower(F.coalesce(c, F.lit(""))), F.lower(k)))
    return rows.withColumn("hit", inside(F.col("content"), F.col("keywords")) | inside(F.col("doc_title"), F.col("titles")))


def metrics(judged: DataFrame, k: int = 5, log2: bool = False) -> DataFrame:
    """Recall (0 or 1), reciprocal rank and NDCG of each query from (query_id, rank, hit). The discount is 1 / (1 + rank), or by log2."""
    discount: Column = 1 / F.log2(F.col("rank") + 1) if log2 else 1 / (1 + F.col("rank")).cast("double")
    within = F.col("rank") <= k
    got = F.sum(F.when(within & F.col("hit"), discount).otherwise(0.0))
    return judged.groupBy("query_id").agg(F.max(F.when(within & F.col("hit"), 1).otherwise(0)).alias("recall"), F.max(F.when(F.col("hit"), 1 / F.col("rank")).otherwise(0.0)).alias("mrr"), (got / F.sum(F.when(within, discount).otherwise(0.0))).alias("ndcg"))


def summary(per_query: DataFrame, *by: str) -> DataFrame:
    """Means over all queries and over each value of each column in by, as (level, value, ...)."""
    rows = per_query.groupingSets([[], *[[F.col(c)] for c in by]], *[F.col(c) for c in by]).agg(F.count("*").alias("total"), F.round(F.avg("recall"), 4).alias("recall"), F.round(F.avg("mrr"), 4).alias("mrr"), F.round(F.avg("ndcg"), 4).alias("ndcg"), *[F.grouping(c).alias(f"g_{c}") for c in by])
    level, value = F.lit("all"), F.lit("all")
    for c in by:
        level, value = F.when(F.col(f"g_{c}") == 0, c).otherwise(level), F.when(F.col(f"g_{c}") == 0, F.col(c).cast("string")).otherwise(value)
    return rows.select(level.alias("level"), value.alias("value"), "total", "recall", "mrr", "ndcg")


def judged_answers(rows: DataFrame) -> DataFrame:
    """Mean score, accuracy (4 or more), hallucination and citation rates, in all (category null) and by category."""
    rate = lambda c: F.round(F.avg(F.when(c, 1.0).otherwise(0.0)), 4)
    return rows.rollup("category").agg(F.count("*").alias("total"), F.round(F.avg("score"), 2).alias("avg_score"), rate(F.col("score") >= 4).alias("accuracy"), rate(F.col("has_hallucination")).alias("hallucination_rate"), rate(F.col("has_citation")).alias("citation_rate"))


def source_counts(results: DataFrame) -> DataFrame:
    return results.groupBy("query_id").agg(*[F.count_if(F.col("source") == s).alias(s) for s in ("bm25", "vector", "both")])


def compare(left: DataFrame, right: DataFrame) -> DataFrame:
    """Two result lists side by side: both ranks of each hit, their difference, and the share of the left list that both have."""
    a, b = left.select("query_id", "chunk_id", F.col("rank").alias("rank_a")), right.select("query_id", "chunk_id", F.col("rank").alias("rank_b"))
    rows = a.join(b, ["query_id", "chunk_id"], "full_outer").withColumn("delta", F.col("rank_a") - F.col("rank_b"))
    share = rows.groupBy("query_id").agg(F.round(F.count_if(F.col("delta").isNotNull()) / F.greatest(F.count("rank_a"), F.lit(1)), 4).alias("overlap"))
    return rows.join(share, "query_id")


def save_report(per_query: DataFrame, overall: DataFrame, path: str, worst: int = 10) -> None:
    """Writes the report as JSON folders: summary, and the first misses."""
    overall.coalesce(1).write.mode("overwrite").json(f"{path}/summary")
    per_query.where("recall = 0").orderBy("query_id").limit(worst).coalesce(1).write.mode("overwrite").json(f"{path}/misses")
