"""Profiles of any table, as long-format rows. Each profile is one pass over the table, but for value counts, which unpivot it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, T.NumericType)]


def text_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, T.StringType)]


def _long(df: DataFrame, columns: list[str], stats: dict[str, Column], types: str) -> DataFrame:
    """One aggregate over the table, turned to a row per column."""
    row = df.agg(*[f(c).alias(f"{s}__{c}") for c in columns for s, f in stats.items()])
    each = [F.struct(F.lit(c).alias("column"), *[F.col(f"{s}__{c}").cast(types).alias(s) for s in stats]) for c in columns]
    return row.select(F.explode(F.array(*each)).alias("x")).select("x.*")


def describe(df: DataFrame, columns: list[str] | None = None, exact: bool = True) -> DataFrame:
    """count, mean, sample deviation, minimum, quartiles and maximum of each numeric column. exact=False estimates quartiles, for large tables."""
    quantile = (lambda p: lambda c: F.percentile(F.col(c).cast("double"), F.lit(p))) if exact else (lambda p: lambda c: F.percentile_approx(F.col(c).cast("double"), p, 10_000))
    stats = {"count": F.count, "mean": lambda c: F.avg(F.col(c).cast("double")), "std": lambda c: F.stddev_samp(F.col(c).cast("double")), "min": F.min, "q25": quantile(0.25), "q50": quantile(0.5), "q75": quantile(0.75), "max": F.max}
    return _long(df, columns or numeric_columns(df), stats, "double")


def describe_text(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """count, distinct values, commonest value and its frequency of each text column."""
    top = value_counts(df, columns, 1).select("column", F.col("value").alias("top"), F.col("n").alias("freq"))
    return _long(df, columns or text_columns(df), {"count": F.count, "unique": F.count_distinct}, "long").join(top, "column", "left")


def value_counts(df: DataFrame, columns: list[str] | None = None, k: int = 10) -> DataFrame:
    """The k commonest values of each column, with their share of those listed."""
    columns = columns or text_columns(df)[:8]
    long = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns])).alias("x")).select("x.*").where("value is not null")
    counted = long.groupBy("column", "value").agg(F.count("*").alias("n"))
    best = counted.withColumn("rank", F.row_number().over(Window.partitionBy("column").orderBy(F.desc("n"), "value"))).where(F.col("rank") <= k)
    return best.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("column")))


def missing(df: DataFrame) -> DataFrame:
    """Null or NaN count and rate of each column."""
    kinds = dict(df.dtypes)
    gap = lambda c: F.count_if(F.col(c).isNull() | F.isnan(c) if kinds[c] in ("double", "float") else F.col(c).isNull())
    return _long(df, df.columns, {"missing": gap, "rows": lambda c: F.count("*")}, "long").select("column", "missing", F.when(F.col("rows") > 0, F.col("missing") / F.col("rows")).otherwise(0.0).alias("rate"))


def correlations(df: DataFrame, columns: list[str] | None = None, k: int = 10) -> DataFrame:
    """The k strongest pairwise correlations, over rows where both columns have values, with a word for their strength."""
    columns = columns or numeric_columns(df)
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    row = df.agg(*[F.corr(F.col(a).cast("double"), F.col(b).cast("double")).alias(f"c{i}") for i, (a, b) in enumerate(pairs)])
    each = [F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.round(f"c{i}", 3).alias("r")) for i, (a, b) in enumerate(pairs)]
    rows = row.select(F.explode(F.array(*each)).alias("x")).select("x.*").where("r is not null and not isnan(r)")
    strength = F.when(F.abs("r") >= 0.7, "strong").when(F.abs("r") >= 0.4, "medium").otherwise("weak")
    return rows.withColumn("strength", strength).orderBy(F.desc(F.abs("r")), "a", "b").limit(k)


def shape(df: DataFrame) -> DataFrame:
    """A row per column with its type and group, and the table's rows and columns."""
    group = lambda f: "numeric" if isinstance(f.dataType, T.NumericType) else "text" if isinstance(f.dataType, T.StringType) else "other"
    each = [F.struct(F.lit(i).alias("place"), F.lit(f.name).alias("column"), F.lit(group(f)).alias("kind")) for i, f in enumerate(df.schema)]
    return df.agg(F.count("*").alias("n_rows")).select("n_rows", F.lit(len(each)).alias("n_columns"), F.explode(F.array(*each)).alias("x")).select("n_rows", "n_columns", "x.*")


def canned_answer(df: DataFrame, question: str) -> DataFrame:
    """One text row for questions on rows and columns, column names, or gaps; no row for others."""
    q = question.lower()
    if "column" in q and "how many" not in q:
        return df.agg(F.count("*")).select(F.lit(", ".join(df.columns)).alias("answer"))
    if "row" in q or "how many" in q:
        return df.agg(F.format_string(f"%d rows, {len(df.columns)} columns", F.count("*")).alias("answer"))
    if "missing" in q:
        gaps = missing(df).where("missing > 0").orderBy(F.desc("missing"), "column")
        line = F.concat("column", F.lit(": "), F.col("missing").cast("string"))
        return gaps.agg(F.coalesce(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("missing")).alias("m"), "column", line.alias("l")))), lambda x: x.l), "; "), F.lit("")).alias("answer"))
    return df.sparkSession.createDataFrame([], "answer string")


def bars(counts: DataFrame, width: int = 30) -> DataFrame:
    """value_counts rows with a bar scaled to the column's largest count."""
    cells = F.floor(F.col("n") / F.max("n").over(Window.partitionBy("column")) * width).cast("int")
    return counts.withColumn("bar", F.repeat(F.lit("█"), cells))


def strips(described: DataFrame, width: int = 30) -> DataFrame:
    """describe rows with the cells of the quartiles on a strip from minimum to maximum."""
    span = F.col("max") - F.col("min")
    cell = lambda c: F.when(span > 0, F.floor((F.col(c) - F.col("min")) / span * width)).otherwise(0).cast("int")
    return described.select("column", *[cell(c).alias(f"cell_{c}") for c in ("q25", "q50", "q75")])


# Sketches ----------------------------------------------------------------------------------------------------------------

#: Values that a sketch keeps at its widest. Ranks of quantiles are then right to within RANK_ERROR of the rows (with 99 % confidence).
SKETCH_SIZE, RANK_ERROR = 512, 0.006


def quantile_sketches(df: DataFrame, columns: list[str], *by: str) -> DataFrame:
    """(by columns, column, sketch, count, missing, least, most): a quantile sketch of each numeric column and group, of fixed size, to be stored and merged later."""
    value = F.col("cell.value")
    cells = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("value")) for c in columns]))
    rows = df.select(*by, cells.alias("cell")).select(*by, F.col("cell.column").alias("column"), value.alias("value"))
    facts = [F.count("value").alias("count"), F.count_if(F.col("value").isNull()).alias("missing"), F.min("value").alias("least"), F.max("value").alias("most")]
    return rows.groupBy(*by, "column").agg(F.kll_sketch_agg_double("value", SKETCH_SIZE).alias("sketch"), *facts)


def merge_sketches(sketches: DataFrame, *by: str) -> DataFrame:
    """Sketches of coarser groups from those of finer ones, as if their rows had been sketched at once."""
    facts = [F.sum("count").alias("count"), F.sum("missing").alias("missing"), F.min("least").alias("least"), F.max("most").alias("most")]
    return sketches.groupBy(*by, "column").agg(F.kll_merge_agg_double("sketch", SKETCH_SIZE).alias("sketch"), *facts)


def sketched_quantiles(sketches: DataFrame, shares: list[float]) -> DataFrame:
    """sketches with quantiles, an array of (share, value)."""
    told = F.kll_sketch_get_quantile_double(F.col("sketch"), F.array(*map(F.lit, shares)))
    pairs = F.zip_with(F.array(*map(F.lit, shares)), told, lambda s, v: F.struct(s.alias("share"), v.alias("value")))
    return sketches.withColumn("quantiles", F.when(F.col("count") > 0, pairs))
