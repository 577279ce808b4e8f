"""Registry of queries and the logical tables they share, as DataFrames and as SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.operators import chunk

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

SIZE, OVERLAP = 768, 96


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a query under its name, with the SQL that gives the same rows."""

    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as catalogued: title, type, language, tags."""
    labels = table(spark, sf_dir, "labels")
    rows = table(spark, sf_dir, "documents").join(labels, "doc_id", "left")
    tags = F.array_compact(F.array("lang", "source", F.when(F.col("quality") == 1, "hq"), F.when(F.col("toxic") == 1, "toxic")))
    return rows.select("doc_id", F.concat_ws("/", "source", F.col("doc_id").cast("string")).alias("title"), F.col("source").alias("file_type"), F.col("lang").alias("language"), tags.alias("tags"), "text", "n_chars")


DOCS = """docs AS (
  SELECT d.doc_id, source || '/' || d.doc_id AS title, source AS file_type, lang AS language,
    list_filter([lang, source, CASE WHEN quality = 1 THEN 'hq' END, CASE WHEN toxic = 1 THEN 'toxic' END], lambda x: x IS NOT NULL) AS tags, text, n_chars
  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id
)"""


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents cut into strides: (chunk_id, doc_id, idx, content, token_count, start_char, end_char)."""
    return chunk.stride_chunks(table(spark, sf_dir, "documents"), SIZE, OVERLAP)


CHUNKS = f"""chunks AS (
  SELECT doc_id || '_' || idx AS chunk_id, doc_id, CAST(idx AS INTEGER) AS idx, substring(text, idx * {SIZE - OVERLAP} + 1, {SIZE}) AS content,
    CAST(length(substring(text, idx * {SIZE - OVERLAP} + 1, {SIZE})) // 2 AS INTEGER) AS token_count, CAST(idx * {SIZE - OVERLAP} AS INTEGER) AS start_char,
    CAST(idx * {SIZE - OVERLAP} + length(substring(text, idx * {SIZE - OVERLAP} + 1, {SIZE})) AS INTEGER) AS end_char
  FROM (SELECT doc_id, text, unnest(range(0, CAST(greatest(1, ceil((length(text) - {OVERLAP}) / {SIZE - OVERLAP}.0)) AS BIGINT))) AS idx FROM documents WHERE length(text) > 0)
)"""


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """benchmark passages as queries (query_id, query)."""
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
