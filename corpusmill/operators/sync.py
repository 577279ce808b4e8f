"""Differences between file snapshots, and what to do about them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """(path, status) of two snapshots (path, hash, mtime): the same mtime is unchanged without a look at the hash."""
    a = old.select("path", F.col("hash").alias("h0"), F.col("mtime").alias("m0"))
    b = new.select("path", F.col("hash").alias("h1"), F.col("mtime").alias("m1"))
    status = F.when(F.col("m0").isNull(), "new").when(F.col("m1").isNull(), "deleted").when((F.col("m0") == F.col("m1")) | (F.col("h0") == F.col("h1")), "unchanged").otherwise("modified")
    return a.join(b, "path", "full_outer").select("path", status.alias("status"))


def totals(changes: DataFrame) -> DataFrame:
    n = changes.agg(F.count_if(F.col("status") == "new").alias("added"), F.count_if(F.col("status") == "modified").alias("updated"), F.count_if(F.col("status") == "deleted").alias("deleted"), F.count_if(F.col("status") == "unchanged").alias("skipped"), F.count("*").alias("total"))
    return n.withColumn("has_changes", F.col("added") + F.col("updated") + F.col("deleted") > 0)


def apply(stored: DataFrame, old: DataFrame, new: DataFrame, under: str | None = None) -> DataFrame:
    """The stored rows (path, ...) after a sync: deleted and modified paths go, new and modified rows come. under: only paths in this folder."""
    if under is not None:
        old, new = (x.where(F.startswith("path", F.lit(under.rstrip("/") + "/"))) for x in (old, new))
    changes = diff(old, new)
    gone = changes.where(F.col("status").isin("deleted", "modified")).select("path")
    come = new.join(changes.where(F.col("status").isin("new", "modified")).select("path"), "path", "left_semi")
    return stored.join(gone, "path", "left_anti").unionByName(come.select(*stored.columns))
