"""Streaming queries, run over the given tables as bounded streams until all is read; each result is a table read back."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from corpusmill.plans.base import CHUNKS, chunks, query, table
from corpusmill.plans.behaviour import PAIRS
from corpusmill.plans.corpus import CHECK_SQL
from corpusmill.plans.retrieval import _tokens
from corpusmill.plans.sources import place
from corpusmill.sources.sinks import shared_dir
from corpusmill.streaming import jobs as J

STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def stream(spark, df, name):
    """A table as a file stream."""
    path = place(spark, name)
    df = df.withColumns({c: F.col(c).cast("timestamp") for c, kind in df.dtypes if kind == "timestamp_ntz"})
    df.write.parquet(path)
    return spark.readStream.schema(df.schema).parquet(path)


def in_order(spark, parts, name):
    """Tables as the files of a stream, one a batch, in their order."""
    path = place(spark, name)
    for k, df in enumerate(parts):
        df = df.withColumns({c: F.col(c).cast("timestamp") for c, kind in df.dtypes if kind == "timestamp_ntz"})
        df.coalesce(1).write.option("compression", "zstd").parquet(f"{path}/part={k}")
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/*")


def drain(spark, df, mode="append", trigger=None):
    """Runs a stream to its end. Append results go to a Parquet table; others keep the last row of each batch in a table per batch."""
    out, check = place(spark, "stream-out"), place(spark, "stream-check")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    trigger = trigger or {"availableNow": True}
    if mode == "append":
        q = df.writeStream.format("parquet").option("checkpointLocation", check).trigger(**trigger).start(out)
    else:
        save = lambda batch, n: batch.withColumn("run", F.lit(n)).write.mode("overwrite").parquet(f"{out}/b={n}")
        q = df.writeStream.outputMode(mode).foreachBatch(save).option("checkpointLocation", check).trigger(**trigger).start()
    q.awaitTermination()
    return spark.read.schema(df.schema).parquet(out) if mode == "append" else spark.read.parquet(out)


@query("st1_folder_watch", "SELECT page_id, url FROM pages")
def st1(spark, sf):
    pages = table(spark, sf, "pages").select("page_id", "url")
    path, out, check = place(spark, "watched"), place(spark, "ingested"), place(spark, "watch-check")
    pages.repartition(4).write.parquet(path)
    files = J.watch_folder(spark, path, "page_id long, url string", per_trigger=2)
    J.ingest(files, out, check, "page_id").awaitTermination()
    return spark.read.parquet(out)


@query("st2_index_upkeep", f"WITH {CHUNKS}, {_tokens('post', 'chunk_id', 'content', 'chunks')} SELECT token, count(*) AS df FROM post WHERE chunk_id IN (SELECT chunk_id FROM chunks WHERE doc_id % 5 <> 0) GROUP BY token")
def st2(spark, sf):
    """All chunks in four batches, and a fifth that removes those of every fifth document: the first four runs are merged, and the last one's tombstones hold against the merged run."""
    c = chunks(spark, sf).select("chunk_id", "doc_id", "content")
    gone = c.where("doc_id % 5 = 0").withColumn("content", F.lit(None).cast("string"))
    path = place(spark, "index")
    files = in_order(spark, [c.where(f"doc_id % 4 = {k}") for k in range(4)] + [gone], "chunk-stream")
    J.index_upkeep(files, path, place(spark, "index-check")).awaitTermination()
    return J.read_index(spark, path).groupBy("token").agg(F.count("*").alias("df"))


@query("st3_command_pairs", f"""WITH {PAIRS}, l AS (SELECT session, list(cmd ORDER BY place) AS l FROM c GROUP BY session)
SELECT p.session, pair, a, b, ts, row_number() OVER (PARTITION BY p.session, a, b ORDER BY pair) AS n, array_to_string(l[CAST(greatest(1, 2 * pair - 7) AS BIGINT):CAST(2 * pair + 2 AS BIGINT)], ',') AS recent FROM pairs p JOIN l ON l.session = p.session""")
def st3(spark, sf):
    from corpusmill.plans.behaviour import commands

    rows = commands(spark, sf)
    some = F.row_number().over(Window.partitionBy("session").orderBy("ts", "seq"))
    rows = rows.withColumn("batch", some > 7)  # sessions go on in a second batch
    files = in_order(spark, [rows.where("not batch").drop("batch"), rows.where("batch").drop("batch")], "commands")
    pairs = drain(spark, J.command_pairs(files))
    return pairs.withColumns({"ts": F.col("ts").cast("timestamp_ntz"), "recent": F.array_join("recent", ",")})


_FIRSTS = "SELECT user_id, {0} AS item, min(event_id) AS first FROM events GROUP BY ALL"


@query("st4_running_profile", f"""WITH t AS ({_FIRSTS.format('event_type')}), r AS ({_FIRSTS.format("'r' || event_id % 4")}), n AS (SELECT user_id, count(*) AS n, max(ts) AS last_active FROM events GROUP BY user_id)
SELECT n.user_id AS "user", n.n, last_active, (SELECT string_agg(item, ',' ORDER BY first) FROM t WHERE t.user_id = n.user_id) AS topics, (SELECT string_agg(item, ',' ORDER BY first) FROM r WHERE r.user_id = n.user_id) AS regions FROM n""")
def st4(spark, sf):
    rows = table(spark, sf, "events").select(F.col("user_id").alias("user"), F.col("event_id").alias("seq"), "ts", F.col("event_type").alias("topic"), F.array(F.concat(F.lit("r"), (F.col("event_id") % 4).cast("string"))).alias("regions"))
    half = table(spark, sf, "events").agg(F.max("event_id")).first()[0] // 2
    out = drain(spark, J.running_profile(in_order(spark, [rows.where(F.col("seq") <= half), rows.where(F.col("seq") > half)], "profile")), "update")
    last = out.groupBy("user").agg(F.max_by(F.struct("n", "last_active", "topics", "regions"), "run").alias("x"))
    return last.select("user", "x.n", F.col("x.last_active").cast("timestamp_ntz").alias("last_active"), F.array_join("x.topics", ",").alias("topics"), F.array_join("x.regions", ",").alias("regions"))


@query("st5_answer_cache", """WITH RECURSIVE r AS (SELECT event_type || user_id % 10 AS hash, event_id AS seq, ts FROM events),
s AS (SELECT hash, min(ts) AS since FROM r GROUP BY hash UNION ALL SELECT s.hash, min(r.ts) FROM s JOIN r ON r.hash = s.hash AND r.ts >= s.since + INTERVAL 6 HOUR GROUP BY s.hash, s.since),
f AS (SELECT r.*, max(s.since) AS since FROM r JOIN s ON s.hash = r.hash AND s.since <= r.ts GROUP BY ALL)
SELECT hash, seq, first_value(seq) OVER w AS answer, row_number() OVER w > 1 AS hit FROM f WINDOW w AS (PARTITION BY hash, since ORDER BY ts, seq)""")
def st5(spark, sf):
    """Requests in order of time, in four batches; an answer is kept for six hours of event time."""
    rows = table(spark, sf, "events").select(F.concat("event_type", (F.col("user_id") % 10).cast("string")).alias("hash"), F.col("event_id").alias("seq"), "ts", F.col("event_id").cast("string").alias("answer"))
    out = drain(spark, J.answer_cache(in_order(spark, by_time(rows, 4), "requests"), 6 * 3_600_000, "10 minutes"))
    return out.select("hash", "seq", F.col("answer").cast("long").alias("answer"), "hit")


def by_time(rows, n):
    """rows (ts) cut into n tables of equal spans of time."""
    first, last = rows.agg(F.min("ts").cast("timestamp").cast("double"), F.max("ts").cast("timestamp").cast("double")).first()
    k = F.least(F.floor((F.col("ts").cast("timestamp").cast("double") - first) / max(last - first, 1.0) * n), F.lit(n - 1))
    return [rows.where(k == i) for i in range(n)]


@query("st6_activity_log", "SELECT user_id AS session, event_type AS type, max(ts) AS ts FROM events GROUP BY ALL")
def st6(spark, sf):
    rows = table(spark, sf, "events").select(F.col("user_id").alias("session"), F.col("event_type").alias("type"), "ts")
    out = drain(spark, J.activity_log(stream(spark, rows, "activity")), "update")
    return out.groupBy("session", "type").agg(F.max("ts").cast("timestamp_ntz").alias("ts"))


@query("st7_health", f"WITH {CHUNKS}, {CHECK_SQL} SELECT issue, count(*) AS n FROM (SELECT unnest(list_prepend('total', issues)) AS issue FROM checked) GROUP BY issue")
def st7(spark, sf):
    c = chunks(spark, sf).select("chunk_id", "content")
    out = drain(spark, J.health(stream(spark, c, "health")), "complete")
    return out.groupBy("issue").agg(F.max_by("n", "run").alias("n"))


# Every tenth event comes two batches late; rows of a batch are late by the watermark that the batches before the last one gave.
_LATE = """span AS (SELECT epoch(min(ts)) AS a, greatest(epoch(max(ts)) - epoch(min(ts)), 1) AS d FROM events),
e AS (SELECT event_id, event_type, ts, least(CAST(floor((epoch(ts) - a) / d * 4) AS INTEGER), 3) + CASE WHEN event_id % 10 = 0 THEN 2 ELSE 0 END AS batch FROM events, span),
m AS (SELECT e.batch, max(b.ts) - INTERVAL 1 HOUR AS mark FROM (SELECT DISTINCT batch FROM e) e LEFT JOIN e b ON b.batch < e.batch - 1 GROUP BY e.batch)"""


def late_events(spark, sf):
    rows = table(spark, sf, "events").select("event_id", "ts", "event_type")
    parts = by_time(rows, 4)
    late = [p.where("event_id % 10 = 0") for p in parts]
    parts = [p.where("event_id % 10 <> 0") for p in parts]
    return in_order(spark, [*parts[:2], *(p.unionByName(x) for p, x in zip(parts[2:], late[:2], strict=True)), *late[2:]], "windows")


def last_counts(out):
    return out.groupBy(F.col("start").cast("timestamp_ntz").alias("start"), "event_type").agg(F.max_by("n", "run").alias("n"))


@query("st8_windows", f"WITH {_LATE} SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n FROM e JOIN m USING (batch) WHERE mark IS NULL OR date_trunc('hour', ts) + INTERVAL 1 HOUR > mark GROUP BY ALL")
def st8(spark, sf):
    return last_counts(drain(spark, J.windows(late_events(spark, sf), "1 hour"), "update"))


@query("st8_sliding", f"WITH {_LATE}, w AS (SELECT *, unnest([date_trunc('hour', ts), date_trunc('hour', ts) - INTERVAL 1 HOUR]) AS start FROM e JOIN m USING (batch)) SELECT start, event_type, count(*) AS n FROM w WHERE mark IS NULL OR start + INTERVAL 2 HOUR > mark GROUP BY ALL")
def st8s(spark, sf):
    return last_counts(drain(spark, J.windows(late_events(spark, sf), "1 hour", "2 hours", "1 hour"), "update"))
