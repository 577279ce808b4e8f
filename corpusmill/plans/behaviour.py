"""Queries over events as commands, orders as work items, and conversations as profiles."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusmill.functions.patterns import found_patterns
from corpusmill.operators import behaviour as B
from corpusmill.plans.base import query, table


def commands(spark, sf):
    return table(spark, sf, "events").select(F.col("user_id").alias("session"), F.col("event_id").alias("seq"), F.col("event_type").alias("cmd"), "ts")


PAIRS = "c AS (SELECT user_id AS session, event_type AS cmd, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS place FROM events), pairs AS (SELECT session, place // 2 AS pair, max(CASE WHEN place % 2 = 0 THEN cmd END) AS a, max(CASE WHEN place % 2 = 1 THEN cmd END) AS b, max(ts) AS ts FROM c GROUP BY ALL HAVING count(*) = 2), counts AS (SELECT a, b, count(*) AS n, max(ts) AS last_used FROM pairs GROUP BY ALL)"


@query("w12_pairs", f"WITH {PAIRS} SELECT * FROM pairs")
def w12(spark, sf):
    return B.pairs(commands(spark, sf))


@query("b1_pair_counts", f"WITH {PAIRS} SELECT * FROM counts")
def b1(spark, sf):
    return B.pair_counts(B.pairs(commands(spark, sf)))


@query("w14_kept_pairs", f"WITH {PAIRS} SELECT * FROM counts ORDER BY n DESC, last_used DESC, a, b LIMIT 10")
def w14(spark, sf):
    return B.pair_counts(B.pairs(commands(spark, sf)), 10)


@query("b2_suggestions", f"WITH {PAIRS} SELECT a, arg_max(b, (n, last_used, b)) AS next, max(n) AS n FROM counts WHERE n >= 2 GROUP BY a")
def b2(spark, sf):
    return B.suggestions(B.pair_counts(B.pairs(commands(spark, sf))))


@query("b3_inefficiencies", f"WITH {PAIRS}, m AS (SELECT * FROM counts WHERE n >= 3) SELECT 'repeat' AS kind, a, b, n FROM m WHERE a = b UNION ALL SELECT 'ping_pong', x.a, x.b, x.n + y.n FROM m x JOIN m y ON x.a = y.b AND x.b = y.a WHERE x.a < x.b UNION ALL SELECT 'batchable', a, b, n FROM m WHERE a IN ('view', 'click') AND a <> b")
def b3(spark, sf):
    return B.inefficiencies(B.pair_counts(B.pairs(commands(spark, sf))), ["view", "click"])


@query("w16_activity_log", "WITH t AS (SELECT max(ts) AS now FROM events), r AS (SELECT user_id AS session, event_type AS type, max(ts) AS ts FROM events, t WHERE ts > now - INTERVAL 7 DAY GROUP BY ALL) SELECT session, type, ts, rank FROM (SELECT *, CAST(row_number() OVER (PARTITION BY session ORDER BY ts DESC, type) AS INTEGER) AS rank FROM r) WHERE rank <= 3")
def w16(spark, sf):
    e = table(spark, sf, "events")
    rows = e.select(F.col("user_id").alias("session"), F.col("event_type").alias("type"), F.lit("").alias("description"), "ts")
    now = e.agg(F.max("ts").alias("now"))  # one row
    return B.activity_log(rows.join(F.broadcast(now)), F.col("now"), 7, 3).select("session", "type", "ts", "rank")


def items(spark, sf):
    o = table(spark, sf, "orders")
    status = F.when(F.col("o_orderstatus") == "O", "pending").when(F.col("o_orderstatus") == "F", "done").otherwise("cancelled")
    priority = F.when(F.col("o_orderpriority").rlike("^[12]"), "high").when(F.col("o_orderpriority").rlike("^3"), "medium").otherwise("low")
    return o.select(F.col("o_orderkey").alias("id"), F.to_date("o_orderdate").alias("date"), status.alias("status"), priority.alias("priority"), F.to_timestamp("o_orderdate").alias("created_at"), F.lit(None).cast("timestamp").alias("completed_at"), F.lit("").alias("note"))


ITEMS = "items AS (SELECT o_orderkey AS id, CAST(o_orderdate AS DATE) AS date, CASE o_orderstatus WHEN 'O' THEN 'pending' WHEN 'F' THEN 'done' ELSE 'cancelled' END AS status, CASE WHEN regexp_matches(o_orderpriority, '^[12]') THEN 'high' WHEN regexp_matches(o_orderpriority, '^3') THEN 'medium' ELSE 'low' END AS priority FROM orders), placed AS (SELECT *, CAST(row_number() OVER (PARTITION BY date ORDER BY CASE status WHEN 'pending' THEN 1 WHEN 'done' THEN 2 ELSE 3 END, CASE priority WHEN 'high' THEN 1 WHEN 'medium' THEN 2 ELSE 3 END, id) AS INTEGER) AS position FROM items)"
DAY = "DATE '1996-06-01'"


@query("a19_day_rollup", f"WITH {ITEMS} SELECT date, count(*) AS total, count(*) FILTER (status = 'done') AS done, count(*) FILTER (status = 'pending') AS pending, count(*) FILTER (status = 'cancelled') AS cancelled, round(count(*) FILTER (status = 'done') / count(*), 4) AS rate FROM items GROUP BY date")
def a19(spark, sf):
    return B.day_rollup(items(spark, sf))


@query("w15_day_order", f"WITH {ITEMS} SELECT id, position FROM placed")
def w15(spark, sf):
    return B.day_order(items(spark, sf)).select("id", "position")


@query("f15_pending_before", f"WITH {ITEMS} SELECT id, date FROM items WHERE date < {DAY} AND status = 'pending'")
def f15(spark, sf):
    return B.pending_before(items(spark, sf), F.expr(DAY)).select("id", "date")


@query("m6_carry_over", f"WITH {ITEMS} SELECT id, CASE WHEN date < {DAY} AND status = 'pending' THEN {DAY} ELSE date END AS date, CASE WHEN date = {DAY} AND status = 'pending' THEN 'cancelled' ELSE status END AS status FROM items WHERE date >= {DAY} - 90 OR (date < {DAY} AND status = 'pending')")
def m6(spark, sf):
    # Today's open items are archived first; then older ones move to today, and days older than 90 go.
    rows = B.archive(items(spark, sf), F.expr(DAY))
    return B.drop_old(B.carry_over(rows, F.expr(DAY)), F.expr(DAY)).select("id", "date", "status")


@query("m7_item_commands", f"WITH {ITEMS} SELECT id, CASE WHEN position = 1 THEN 'done' ELSE status END AS status, CASE WHEN position = 2 THEN 'high' ELSE priority END AS priority, position = 1 AS completed FROM placed")
def m7(spark, sf):
    rows = items(spark, sf)
    days = rows.select("date").distinct()
    blank = F.lit(None).cast("string")
    one = days.select("date", F.lit(1).alias("position"), F.explode(F.array(F.struct(F.lit(1).alias("seq"), F.lit("pending").alias("status")), F.struct(F.lit(2).alias("seq"), F.lit("done").alias("status")))).alias("x")).select("date", "position", "x.seq", "x.status", blank.alias("priority"), blank.alias("note"), F.to_timestamp(F.lit("2000-01-01")).alias("at"))
    two = days.select("date", F.lit(2).alias("position"), F.lit(1).alias("seq"), blank.alias("status"), F.lit("HIGH").alias("priority"), blank.alias("note"), F.lit(None).cast("timestamp").alias("at"))
    return B.apply_commands(rows, one.unionByName(two)).select("id", "status", "priority", F.col("completed_at").isNotNull().alias("completed"))


@query("m8_active_tasks", f"WITH {ITEMS} SELECT id, date, priority FROM items WHERE status = 'pending'")
def m8(spark, sf):
    return items(spark, sf).where("status = 'pending'").select("id", "date", "priority")


@query("k5_recent_days", f"WITH {ITEMS} SELECT date, count(*) AS n FROM items WHERE date <= {DAY} AND date > {DAY} - 7 GROUP BY date")
def k5(spark, sf):
    return items(spark, sf).where(F.col("date").between(F.date_sub(F.expr(DAY), 6), F.expr(DAY))).groupBy("date").agg(F.count("*").alias("n"))


@query("j13_topics", "SELECT user_id AS \"user\", string_agg(event_type, ',' ORDER BY first) AS topics FROM (SELECT user_id, event_type, min(event_id) AS first FROM events GROUP BY ALL) GROUP BY user_id")
def j13(spark, sf):
    rows = table(spark, sf, "events").select(F.col("user_id").alias("user"), F.col("event_type").alias("topic"), F.col("event_id").alias("seq"))
    return B.keep_topics(rows).withColumn("topics", F.array_join("topics", ","))


@query("x19_regions", "SELECT conv_id, turn, array_to_string(list_filter(['the', 'der', 'les', 'que'], lambda r: contains(text, r)), ',') AS regions FROM conversations")
def x19(spark, sf):
    return table(spark, sf, "conversations").select("conv_id", "turn", F.array_join(found_patterns(F.col("text"), ["the", "der", "les", "que"]), ",").alias("regions"))


@query("st8_windows_batch", "SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n FROM events GROUP BY ALL")
def st8(spark, sf):
    w = table(spark, sf, "events").groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n"))
    return w.select(F.col("w.start").alias("start"), "event_type", "n")


@query("st8_sessions_batch", "SELECT user_id, min(ts) AS first, count(*) AS n FROM (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events)) GROUP BY user_id, s")
def st8b(spark, sf):
    w = table(spark, sf, "events").groupBy(F.session_window("ts", "30 minutes").alias("w"), "user_id").agg(F.count("*").alias("n"))
    return w.select("user_id", F.col("w.start").alias("first"), "n")
