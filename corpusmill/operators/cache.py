"""A semantic answer cache and an embedding cache as tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusmill.functions import text as X
from corpusmill.operators.best import nearest
from corpusmill.operators.retrieve import MOST_BLOCKS
from corpusmill.sources.sinks import written


def empty(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], "key string, hash string, embedding array<double>, ts double")


def lookup(queries: DataFrame, cache: DataFrame, now: float, ttl: float = 1800.0, least: float = 0.92, fresh_first: bool = False) -> DataFrame:
    """(query_id, key, how): the entry of the same text within its time, else the single most similar entry if similar enough and fresh.

    By default the best entry is chosen first and then tested for age, so an old best hides a fresh second; fresh_first tests before.
    queries (query_id, query, embedding) meet all entries (key, hash, embedding, ts) as in retrieve.vector_search."""
    asked = queries.withColumn("hash", X.query_hash(F.col("query")))
    fresh = F.lit(now) - F.col("ts") < ttl
    exact = asked.join(cache.where(fresh), "hash").groupBy("query_id").agg(F.max_by("key", F.struct("ts", "key")).alias("key")).withColumn("how", F.lit("exact"))
    rest = asked.join(exact, "query_id", "left_anti").select("query_id", "embedding")
    entries = (cache.where(fresh) if fresh_first else cache).select("key", "ts", "embedding")
    scored = nearest(entries, rest, 1, lambda c: c, MOST_BLOCKS * 256, None, "descending")
    best = scored.groupBy("query_id").agg(F.max_by(F.struct("key", "ts", F.col("score").alias("c")), F.struct("score", "key")).alias("b"))
    near = best.where((F.col("b.c") >= least) & (F.lit(now) - F.col("b.ts") < ttl)).select("query_id", "b.key", F.lit("similar").alias("how"))
    return exact.unionByName(near)


def answer(queries: DataFrame, cache: DataFrame, results: DataFrame, search: Callable[[DataFrame], DataFrame], now: float, **lookup_options: float) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(answers, entries, stored): the results of all queries (query_id, query, embedding), with cached telling whether an entry of the cache gave them; the new
    entries (key, hash, embedding, ts) for write(); and the new queries' results by key.

    results (key, and the columns of a search but query_id) holds what was found for the cache's entries. Only queries without an entry are searched."""
    hits = written(lookup(queries, cache, now, **lookup_options), "cache-hits")
    new = written(queries.join(hits, "query_id", "left_anti"), "cache-new")
    found = written(search(new), "cache-found")
    old = hits.select("query_id", "key").join(results, "key").drop("key")
    every = old.withColumn("cached", F.lit(True)).unionByName(found.withColumn("cached", F.lit(False)))
    entries = new.select(X.query_hash(F.col("query")).alias("key"), X.query_hash(F.col("query")).alias("hash"), "embedding", F.lit(float(now)).alias("ts")).dropDuplicates(["key"])
    # Of queries of the same text one gives the entry's results.
    first = new.groupBy(X.query_hash(F.col("query")).alias("key")).agg(F.min("query_id").alias("query_id"))
    return every, entries, first.join(found, "query_id").drop("query_id")


def touch(cache: DataFrame, found: DataFrame, now: float) -> DataFrame:
    """The cache after the hits in found (key): counts and last access."""
    n = found.groupBy("key").agg(F.count("*").alias("new_hits"))
    rows = cache.join(n, "key", "left")
    return rows.withColumn("hit_count", F.col("hit_count") + F.coalesce("new_hits", F.lit(0))).withColumn("last_access", F.when(F.col("new_hits").isNotNull(), F.lit(now)).otherwise(F.col("last_access"))).drop("new_hits")


def write(cache: DataFrame, new: DataFrame, now: float, ttl: float = 1800.0, keep: int = 500) -> DataFrame:
    """The cache with new entries in the place of old ones of the same key, without expired ones, and at most the keep last used."""
    # A new entry holds whatever the old one's time; last_access decides between new ones of the same time.
    latest = Window.partitionBy("key").orderBy(F.desc("is_new"), F.desc("ts"), F.desc("last_access"))
    rows = cache.withColumn("is_new", F.lit(False)).unionByName(new.withColumn("is_new", F.lit(True)))
    rows = rows.withColumn("k", F.row_number().over(latest)).where("k = 1").drop("k", "is_new")
    return rows.where(F.lit(now) - F.col("ts") < ttl).orderBy(F.desc("last_access"), "key").limit(keep)


def stats(cache: DataFrame, now: float, ttl: float = 1800.0) -> DataFrame:
    return cache.agg(F.count("*").alias("size"), F.coalesce(F.sum("hit_count"), F.lit(0)).alias("hits"), F.count_if(F.lit(now) - F.col("ts") >= ttl).alias("expired"))


def embed_missing(texts: DataFrame, stored: DataFrame, embed: Callable[[Column], Column]) -> DataFrame:
    """(hash, embedding) of all texts: stored vectors where there are any, else the embed slot's, once for each distinct text."""
    hashed = texts.select(F.sha2("text", 256).alias("hash"), "text").dropDuplicates(["hash"])
    new = hashed.join(stored.select("hash"), "hash", "left_anti").select("hash", embed(F.col("text")).alias("embedding"))
    return stored.join(hashed.select("hash"), "hash", "left_semi").select("hash", "embedding").unionByName(new)
