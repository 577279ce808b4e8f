"""Sinks and renderings: Markdown, transcripts, reports, JSON graphs, plain listings."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The checkpoint folder that executors share; in local mode, where none is set, a temporary one."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="spark-checkpoint-"))
    return sc.getCheckpointDir()


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder, read back: what is used more than once is worked out once, and a lost executor costs a reread."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def sized(small: DataFrame, limit: int = 20_000) -> DataFrame:
    """A written table with a broadcast hint if a count shows at most limit rows, else as it is."""
    return F.broadcast(small) if small.limit(limit + 1).count() <= limit else small


def row_lines(df: DataFrame, name: str, title: Column) -> DataFrame:
    """Rows as text lines that tell their columns; blank cells are left out, and rows of blank cells."""
    cells = [F.when(F.trim(F.col(f"`{c}`").cast("string")) != "", F.concat(F.lit(f"{c or f'col{k + 1}'}="), F.col(f"`{c}`").cast("string"))) for k, c in enumerate(df.columns)]
    body = F.concat_ws(" | ", *cells)
    return df.select(F.when(body != "", F.concat(F.lit(f"[{name}] doc="), title, F.lit(" | "), body)).alias("line")).where("line is not null")


def markdown_rows(df: DataFrame, order: list[str], most: int = 30) -> DataFrame:
    """A table's first rows as one Markdown text, with a note if there are more."""
    cell = lambda c: F.replace(F.replace(F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit("\n"), F.lit(" ")), F.lit("|"), F.lit("\\|"))
    few = df.orderBy(*order).limit(most + 1)
    lines = few.select(F.row_number().over(Window.orderBy(*order)).alias("k"), F.concat(F.lit("| "), F.concat_ws(" | ", *[cell(c) for c in df.columns]), F.lit(" |")).alias("line"))
    head = "| " + " | ".join(df.columns) + " |\n|" + " --- |" * len(df.columns)
    whole = lines.agg(F.array_sort(F.collect_list(F.struct("k", "line"))).alias("l"))
    body = F.concat_ws("\n", F.lit(head), F.array_join(F.transform(F.slice("l", 1, most), lambda x: x.line), "\n"))
    return whole.select(F.concat(body, F.when(F.size("l") > most, F.lit("\n...")).otherwise("")).alias("markdown"))


def transcripts(conversations: DataFrame) -> DataFrame:
    """(conv_id, markdown): header, message count, a heading per role, separators."""
    line = F.concat(F.lit("## "), "role", F.lit("\n\n"), "text")
    rows = conversations.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", line.alias("l")))).alias("t"))
    head = F.concat(F.lit("# session "), F.col("conv_id").cast("string"), F.lit("\n\nmessages: "), F.size("t").cast("string"), F.lit("\n\n"))
    return rows.select("conv_id", F.concat(head, F.array_join(F.transform("t", lambda x: x.l), "\n\n---\n\n")).alias("markdown"))


def fact_sheets(docs: DataFrame, chunks: DataFrame, width: int = 8000) -> DataFrame:
    """(doc_id, sheet): title, tags, counts, the start of the body, a footer."""
    body = chunks.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("idx", "content"))).alias("c"), F.count("*").alias("n"))
    text = F.substring(F.array_join(F.transform("c", lambda x: x.content), "\n"), 1, width)
    sheet = F.concat(F.lit("# "), "title", F.lit("\ntags: "), F.array_join("tags", ", "), F.lit("\nchunks: "), F.coalesce("n", F.lit(0)).cast("string"), F.lit("\n\n"), F.coalesce(text, F.lit("")), F.lit("\n\n---\n"))
    return docs.join(body, "doc_id", "left").select("doc_id", sheet.alias("sheet"))


def hit_lines(results: DataFrame, width: int = 300) -> DataFrame:
    """Search hits as plain text, for piping."""
    line = F.concat(F.lit("["), F.col("rank").cast("string"), F.lit("] "), F.coalesce("doc_title", F.lit("")), F.lit("\n"), F.replace(F.substring("content", 1, width), F.lit("\n"), F.lit(" ")))
    return results.select("query_id", "rank", line.alias("line"))


def profile_markdown(counts: DataFrame, missing: DataFrame) -> DataFrame:
    """A profile's value counts and gaps as a Markdown text per column."""
    lines = counts.groupBy("column").agg(F.array_sort(F.collect_list(F.struct("rank", F.concat(F.lit("- "), "value", F.lit(": "), F.col("n").cast("string")).alias("l")))).alias("t"))
    rows = missing.join(lines, "column", "left")
    listed = F.coalesce(F.array_join(F.transform("t", lambda x: x.l), "\n"), F.lit(""))
    return rows.select("column", F.concat(F.lit("## "), "column", F.lit("\nmissing: "), F.col("missing").cast("string"), F.lit("\n"), listed).alias("markdown"))


def write_graph(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    nodes.write.mode("overwrite").json(f"{path}/nodes")
    edges.write.mode("overwrite").json(f"{path}/edges")


def read_graph(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """A written graph; missing fields get defaults."""
    nodes = spark.read.schema("id string, label string, type string, doc_count long, first_doc long").json(f"{path}/nodes")
    edges = spark.read.schema("source string, target string, relation string, doc_id long").json(f"{path}/edges")
    return nodes.withColumns({"label": F.coalesce("label", "id"), "type": F.coalesce("type", F.lit("topic")), "doc_count": F.coalesce("doc_count", F.lit(0))}), edges.withColumn("relation", F.coalesce("relation", F.lit("related")))
