"""Mixing sources to target weights by weighted random order.

A document's key is -ln(u) / weight, u a hash of its id and the seed in (0, 1): the documents of the least keys are a weighted
sample without replacement. Each source is taken whole as often as its target allows; the rest of the target is filled in order
of the keys, by prefix sums of sizes. The prefix sums run in two levels, sums of key ranges and then rows of one range, so a
source of any size is spread over many tasks.

Defined cases: null text has size 0; a null source is a source of its own, ordered last; a source of size 0 has target 0;
documents of equal keys go by doc_id and size, and identical rows are interchangeable; an empty table gives no rows; a null
weight counts 1. The document on the edge is taken if at least half of it is within the target.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.llm.common import WORD, materialize, sized

WEIGHTS = (3, 1, 2)


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, most: float = 2.0) -> DataFrame:
    """sources (source, source_size) with target. The target is least(most * size, level * weight); level is where the targets add
    up to share of all sizes, which is where resharing the excess by weight ends. One row per source goes through one task."""
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.lit(list(weights)), (F.row_number().over(by_name) - 1) % len(weights) + 1).cast("double")
    rows = sources.withColumn("weight", w).withColumn("cap", F.col("source_size") * float(most))
    by_level = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    every = Window.partitionBy()
    below = by_level.rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("total", F.least(F.lit(float(share)), F.lit(float(most))) * F.sum("source_size").over(every))
    rows = rows.withColumn("level", (F.col("total") - F.coalesce(F.sum("cap").over(below), F.lit(0.0))) / (F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(below), F.lit(0.0))))
    level = F.max(F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.col("level"))).over(every)
    return rows.withColumn("at", level).select("source", "source_size", F.least("cap", F.coalesce(F.col("at") * F.col("weight"), F.col("cap"))).alias("target"))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, most: float = 2.0, seed: int = 17, rows_per_range: int = 20_000, quality: DataFrame | None = None, row_key: str | None = None) -> DataFrame:
    """docs (doc_id, text, source) as (doc_id, source, size, source_size, target, taken). quality: rows (doc_id, weight); a document without one weighs 1.
    row_key: a string column of docs that tells rows of null or repeated doc_id apart; it is returned as well."""
    keys = [row_key] if row_key else []
    sizes = docs.select("doc_id", *keys, "source", n_words(F.col("text")).alias("size"))
    if quality is not None:
        sizes = sizes.join(quality.groupBy("doc_id").agg(F.max("weight").alias("weight")), "doc_id", "left")
    else:
        sizes = sizes.withColumn("weight", F.lit(1.0))
    sizes = materialize(sizes.withColumn("weight", F.greatest(F.coalesce("weight", F.lit(1.0)), F.lit(1e-9))), "mix-sizes")
    sources = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs"))
    sources = materialize(targets(sources, weights, share, most).join(sources.select(F.col("source").alias("s"), "n_docs"), F.col("source").eqNullSafe(F.col("s"))).drop("s"), "mix-sources")
    u = (F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), *keys))), 1, 13), 16, 10).cast("double") + 0.5) / F.lit(float(16**13))
    rows = sizes.withColumn("key", -F.log(u) / F.col("weight"))
    small = sized(sources.select(F.col("source").alias("s"), "source_size", "target", "n_docs"))
    rows = rows.join(small, F.col("source").eqNullSafe(F.col("s"))).drop("s")
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    rows = rows.withColumn("epochs", epochs.cast("long")).withColumn("rest", F.col("target") - F.col("epochs") * F.col("source_size"))
    ranges = F.greatest(F.lit(256), F.ceil(F.col("n_docs") / rows_per_range))
    rows = rows.withColumn("range", F.floor((1 - F.exp(-F.col("key"))) * ranges).cast("long"))
    sums = rows.groupBy("source", "range").agg(F.sum("size").alias("range_size"))
    before = Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select(F.col("source").alias("s"), F.col("range").alias("r"), F.coalesce(F.sum("range_size").over(before), F.lit(0)).alias("start"))
    rows = rows.join(starts, F.col("source").eqNullSafe(F.col("s")) & (F.col("range") == F.col("r"))).drop("s", "r")
    inside = Window.partitionBy("source", "range").orderBy("key", "doc_id", "size", *keys).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("before", F.col("start") + F.coalesce(F.sum("size").over(inside), F.lit(0)))
    more = (F.col("before") + F.col("size") / 2 <= F.col("rest")) & (F.col("rest") > 0)
    taken = F.col("size") * (F.col("epochs") + F.when(more, 1).otherwise(0))
    return rows.select("doc_id", *keys, "source", "size", "source_size", "target", taken.cast("long").alias("taken"))
