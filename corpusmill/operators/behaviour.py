"""Mining of command sequences, activity logs, work items and sessions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def pairs(commands: DataFrame) -> DataFrame:
    """Non-overlapping pairs of each session, (1, 2), (3, 4), ...: rows (session, a, b, ts) from (session, seq, cmd, ts)."""
    place = F.row_number().over(Window.partitionBy("session").orderBy("ts", "seq")) - 1
    rows = commands.withColumn("place", place).withColumn("pair", F.floor(F.col("place") / 2))
    both = rows.groupBy("session", "pair").agg(F.min_by("cmd", "place").alias("a"), F.max_by("cmd", "place").alias("b"), F.max("ts").alias("ts"), F.count("*").alias("n"))
    return both.where("n = 2").select("session", "pair", "a", "b", "ts")


def pair_counts(paired: DataFrame, keep: int | None = None) -> DataFrame:
    """Count and last use of each pair; at most the keep most used."""
    rows = paired.groupBy("a", "b").agg(F.count("*").alias("n"), F.max("ts").alias("last_used"))
    return rows if keep is None else rows.orderBy(F.desc("n"), F.desc("last_used"), "a", "b").limit(keep)


def suggestions(counts: DataFrame, least: int = 2) -> DataFrame:
    """The commonest follower of each command, if it was seen often enough."""
    return counts.where(F.col("n") >= least).groupBy("a").agg(F.max_by("b", F.struct("n", F.col("last_used"), "b")).alias("next"), F.max("n").alias("n"))


def inefficiencies(counts: DataFrame, batchable: list[str], least: int = 3) -> DataFrame:
    """(kind, a, b, n): repeats, ping-pong between two commands, and commands that could run in one batch."""
    many = counts.where(F.col("n") >= least)
    repeat = many.where("a = b").select(F.lit("repeat").alias("kind"), "a", "b", "n")
    back = many.select(F.col("a").alias("b"), F.col("b").alias("a"), F.col("n").alias("m"))
    ping = many.where("a < b").join(back, ["a", "b"]).select(F.lit("ping_pong").alias("kind"), "a", "b", (F.col("n") + F.col("m")).alias("n"))
    batch = many.where(F.col("a").isin(batchable) & (F.col("a") != F.col("b"))).select(F.lit("batchable").alias("kind"), "a", "b", "n")
    return repeat.unionByName(ping).unionByName(batch)


def activity_log(events: DataFrame, now: Column, days: int = 7, keep: int = 50) -> DataFrame:
    """The newest event of each session, type and description within the last days, the newest few of each session."""
    recent = events.where(F.col("ts") > now - F.expr(f"INTERVAL {days} DAYS"))
    newest = recent.groupBy("session", "type", "description").agg(F.max("ts").alias("ts"))
    order = Window.partitionBy("session").orderBy(F.desc("ts"), "type", "description")
    return newest.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= keep)


def lru(entries: DataFrame, keep: int = 500) -> DataFrame:
    """The most recently used entries."""
    return entries.orderBy(F.desc("last_access"), "key").limit(keep)


def day_rollup(items: DataFrame) -> DataFrame:
    n = items.groupBy("date").agg(F.count("*").alias("total"), *[F.count_if(F.col("status") == s).alias(s) for s in ("done", "pending", "cancelled")])
    return n.withColumn("rate", F.when(F.col("total") > 0, F.round(F.col("done") / F.col("total"), 4)).otherwise(0.0))


STATUS_ORDER, PRIORITY_ORDER = ["pending", "done", "cancelled"], ["high", "medium", "low"]


def _place(c: str, order: list[str]) -> Column:
    return F.coalesce(F.nullif(F.array_position(F.lit(order), F.col(c)), F.lit(0)), F.lit(len(order) + 1))


def day_order(items: DataFrame) -> DataFrame:
    """position of each item in its day: by status, priority, time and id."""
    order = Window.partitionBy("date").orderBy(_place("status", STATUS_ORDER), _place("priority", PRIORITY_ORDER), "created_at", "id")
    return items.withColumn("position", F.row_number().over(order))


def valid_priority(c: Column) -> Column:
    return F.when(F.lower(c).isin(PRIORITY_ORDER), F.lower(c)).otherwise("medium")


def pending_before(items: DataFrame, date: Column) -> DataFrame:
    return items.where((F.col("date") < date) & (F.col("status") == "pending"))


def carry_over(items: DataFrame, date: Column) -> DataFrame:
    """Open items of earlier days move to the date; moved and from_date tell which."""
    move = (F.col("date") < date) & (F.col("status") == "pending")
    return items.withColumn("moved", move).withColumn("from_date", F.when(move, F.col("date"))).withColumn("date", F.when(move, date).otherwise(F.col("date")))


def archive(items: DataFrame, date: Column) -> DataFrame:
    return items.withColumn("status", F.when((F.col("date") == date) & (F.col("status") == "pending"), "cancelled").otherwise(F.col("status")))


def drop_old(items: DataFrame, date: Column, days: int = 90) -> DataFrame:
    return items.where(F.col("date") >= F.date_sub(date, days))


def apply_commands(items: DataFrame, commands: DataFrame) -> DataFrame:
    """Items with the last command of each (date, position): status, priority, note. Done stamps completed_at, reopening clears it."""
    last = Window.partitionBy("date", "position").orderBy(F.desc("seq"))
    newest = commands.withColumn("k", F.row_number().over(last)).where("k = 1").drop("k", "seq").withColumnsRenamed({"status": "new_status", "priority": "new_priority", "note": "new_note"})
    rows = day_order(items).join(newest, ["date", "position"], "left")
    done = F.when(F.col("new_status") == "done", F.col("at")).when(F.col("new_status") == "pending", F.lit(None)).otherwise(F.col("completed_at"))
    rows = rows.withColumns({"status": F.coalesce("new_status", "status"), "priority": F.when(F.col("new_priority").isNotNull(), valid_priority(F.col("new_priority"))).otherwise(F.col("priority")), "note": F.coalesce("new_note", "note"), "completed_at": done})
    return rows.drop("new_status", "new_priority", "new_note", "at")


def keep_topics(topics: DataFrame, most: int = 10) -> DataFrame:
    """(user, topics): each user's topics in order, those left out that contain or are contained in one kept before; the last few. Per-user arrays are bounded by the user's distinct topics."""
    seen = topics.groupBy("user", "topic").agg(F.min("seq").alias("seq"))
    rows = seen.groupBy("user").agg(F.array_sort(F.collect_list(F.struct("seq", "topic"))).alias("t"))
    fold = F.aggregate("t", F.array().cast("array<string>"), lambda kept, x: F.when(F.exists(kept, lambda k: F.contains(k, x.topic) | F.contains(x.topic, k)), kept).otherwise(F.concat(kept, F.array(x.topic))))
    return rows.select("user", F.slice(fold, F.greatest(F.lit(1), F.size(fold) - most + 1), F.lit(most)).alias("topics"))
