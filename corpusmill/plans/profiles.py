"""Queries that profile the star-schema tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusmill.operators import profile as P
from corpusmill.plans.base import query, table
from corpusmill.sources.sinks import written

_NUM = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
_DESC = lambda c: f"SELECT '{c}' AS \"column\", count({c})::DOUBLE AS count, round(avg({c}::DOUBLE), 6) AS mean, round(stddev_samp({c}::DOUBLE), 6) AS std, min({c})::DOUBLE AS min, quantile_cont({c}::DOUBLE, 0.25) AS q25, quantile_cont({c}::DOUBLE, 0.5) AS q50, quantile_cont({c}::DOUBLE, 0.75) AS q75, max({c})::DOUBLE AS max FROM lineitem"
DESCRIBE = " UNION ALL ".join(map(_DESC, _NUM))


def described(spark, sf):
    d = P.describe(table(spark, sf, "lineitem"), _NUM)
    return d.withColumns({c: F.round(c, 6) for c in ("mean", "std")})


@query("a4_describe", DESCRIBE)
def a4(spark, sf):
    return described(spark, sf)


_TEXT = ["o_orderstatus", "o_orderpriority"]
COUNTS = "counts AS (" + " UNION ALL ".join(f"SELECT '{c}' AS \"column\", {c} AS value, count(*) AS n FROM orders WHERE {c} IS NOT NULL GROUP BY {c}" for c in _TEXT) + "), top AS (SELECT *, CAST(row_number() OVER (PARTITION BY \"column\" ORDER BY n DESC, value) AS INTEGER) AS rank FROM counts)"


@query("a5_value_counts", f"WITH {COUNTS} SELECT *, round(n / sum(n) OVER (PARTITION BY \"column\"), 6) AS share FROM top WHERE rank <= 10")
def a5(spark, sf):
    return P.value_counts(table(spark, sf, "orders"), _TEXT).withColumn("share", F.round("share", 6))


@query("a6_missing", " UNION ALL ".join(f"SELECT '{c}' AS \"column\", count(*) FILTER ({x} IS NULL) AS missing, round(count(*) FILTER ({x} IS NULL) / count(*), 6) AS rate FROM customer" for c, x in [("c_custkey", "c_custkey"), ("c_acctbal", "CASE WHEN c_acctbal < 0 THEN NULL ELSE c_acctbal END"), ("c_mktsegment", "nullif(c_mktsegment, 'BUILDING')")]))
def a6(spark, sf):
    c = table(spark, sf, "customer")
    c = c.select("c_custkey", F.when(F.col("c_acctbal") >= 0, F.col("c_acctbal")).alias("c_acctbal"), F.nullif("c_mktsegment", F.lit("BUILDING")).alias("c_mktsegment"))
    return P.missing(c).withColumn("rate", F.round("rate", 6))


_CORR = " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}::DOUBLE, {b}::DOUBLE), 3) AS r FROM lineitem" for i, a in enumerate(_NUM) for b in _NUM[i + 1 :])


@query("a7_correlations", f"SELECT *, CASE WHEN abs(r) >= 0.7 THEN 'strong' WHEN abs(r) >= 0.4 THEN 'medium' ELSE 'weak' END AS strength FROM ({_CORR}) ORDER BY abs(r) DESC, a, b LIMIT 10")
def a7(spark, sf):
    return P.correlations(table(spark, sf, "lineitem"), _NUM)


@query("a8_shape", "SELECT (SELECT count(*) FROM nation) AS n_rows, CAST(count(*) OVER () AS INTEGER) AS n_columns, CAST(column_index - 1 AS INTEGER) AS place, column_name AS \"column\", CASE WHEN data_type LIKE '%INT%' OR data_type IN ('DOUBLE', 'FLOAT') OR data_type LIKE 'DECIMAL%' THEN 'numeric' WHEN data_type = 'VARCHAR' THEN 'text' ELSE 'other' END AS kind FROM (SELECT column_name, data_type, column_index FROM duckdb_columns() WHERE table_name = 'nation')")
def a8(spark, sf):
    return P.shape(table(spark, sf, "nation"))


@query("a9_describe_text", f"WITH {COUNTS} SELECT \"column\", CAST(sum(n) AS BIGINT) AS count, count(*) AS \"unique\", max(CASE WHEN rank = 1 THEN value END) AS top, max(CASE WHEN rank = 1 THEN n END) AS freq FROM top GROUP BY \"column\"")
def a9(spark, sf):
    return P.describe_text(table(spark, sf, "orders"), _TEXT)


@query("a10_canned_answer", "SELECT count(*) || ' rows, 3 columns' AS answer FROM part")
def a10(spark, sf):
    p = table(spark, sf, "part")
    return P.canned_answer(p.select(*p.columns[:3]), "How many rows are there?")


@query("a11_bars", f"WITH {COUNTS} SELECT \"column\", value, repeat('█', CAST(floor(n / max(n) OVER (PARTITION BY \"column\") * 30) AS BIGINT)) AS bar FROM top WHERE rank <= 10")
def a11(spark, sf):
    return P.bars(P.value_counts(table(spark, sf, "orders"), _TEXT)).select("column", "value", "bar")


@query("a11_strips", f"SELECT \"column\", CAST(floor((q25 - min) / (max - min) * 30) AS INTEGER) AS cell_q25, CAST(floor((q50 - min) / (max - min) * 30) AS INTEGER) AS cell_q50, CAST(floor((q75 - min) / (max - min) * 30) AS INTEGER) AS cell_q75 FROM ({DESCRIBE})")
def a11b(spark, sf):
    return P.strips(described(spark, sf))


_SHARES = [0.05, 0.25, 0.5, 0.75, 0.95]


@query("a4_sketched_quantiles", "SELECT c AS \"column\", count(*) AS count, CAST(min(v) AS DOUBLE) AS least, CAST(max(v) AS DOUBLE) AS most, unnest([0.05, 0.25, 0.5, 0.75, 0.95])::DOUBLE AS share, TRUE AS within FROM (" + " UNION ALL ".join(f"SELECT '{c}' AS c, {c}::DOUBLE AS v FROM lineitem" for c in _NUM) + ") GROUP BY c")
def a4s(spark, sf):
    """Quantiles by sketches of each return flag, stored and merged, and whether their true ranks are within the sketch's error."""
    rows = table(spark, sf, "lineitem")
    stored = written(P.quantile_sketches(rows, _NUM, "l_returnflag"), "sketches")
    told = P.sketched_quantiles(P.merge_sketches(stored), _SHARES).select("column", "count", "least", "most", F.explode("quantiles").alias("q"))
    told = written(told.select("column", "count", "least", "most", "q.share", "q.value"), "quantiles")
    values = rows.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("v")) for c in _NUM])).alias("x")).select("x.column", "x.v")
    ranks = values.join(F.broadcast(told.select("column", "share", "value")), "column").groupBy("column", "share").agg(F.avg((F.col("v") < F.col("value")).cast("double")).alias("below"), F.avg((F.col("v") <= F.col("value")).cast("double")).alias("upto"))
    within = (F.col("below") <= F.col("share") + 2 * P.RANK_ERROR) & (F.col("upto") >= F.col("share") - 2 * P.RANK_ERROR)
    return told.join(ranks, ["column", "share"]).select("column", "count", "least", "most", "share", within.alias("within"))
