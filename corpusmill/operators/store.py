"""The corpus as tables: catalogue lookups, facets, tags, facts, sinks and maintenance. Changes give new tables; nothing is updated in place."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Format tag of each file type.
FORMATS = {"pdf": "pdf", "docx": "docx", "doc": "docx", "xlsx": "excel", "xls": "excel", "csv": "excel", "pptx": "ppt", "ppt": "ppt", "md": "markdown", "markdown": "markdown", "html": "html", "htm": "html", "txt": "text", "json": "text"}


def by_id(docs: DataFrame, doc_id: str, key: str = "content_id") -> DataFrame:
    """The document of a full 32-character id, or of the least id with a shorter prefix."""
    if len(doc_id) == 32:
        return docs.where(F.col(key) == doc_id)
    return docs.where(F.startswith(key, F.lit(doc_id))).orderBy(key).limit(1)


def keyword_scan(chunks: DataFrame, docs: DataFrame, keyword: str, limit: int = 20) -> DataFrame:
    """Chunks with the keyword in any ASCII case, of the newest documents first."""
    hits = chunks.where(F.contains(F.lower("content"), F.lit(keyword.lower())))
    return hits.join(docs.select("doc_id", "title"), "doc_id").orderBy(F.desc("doc_id"), "idx").limit(limit)


def with_tag(docs: DataFrame, tag: str, exact: bool = True) -> DataFrame:
    return docs.where(F.array_contains("tags", tag) if exact else F.exists("tags", lambda t: F.contains(F.lower(t), F.lit(tag.lower()))))


def with_tags(docs: DataFrame, tags: list[str], every: bool = False) -> DataFrame:
    """Documents with any of the tags, or with every one."""
    have = F.lit(tags)
    return docs.where(F.size(F.array_intersect("tags", have)) == len(set(tags)) if every else F.arrays_overlap("tags", have))


def restrict(results: DataFrame, docs: DataFrame, k: int, prefilter: bool = True) -> DataFrame:
    """Ranked results of the given documents: ranked anew before the cut (prefilter), or filtered after the cut at k, so fewer may remain."""
    if not prefilter:
        results = results.where(F.col("rank") <= k)
    kept = results.join(docs.select("doc_id").distinct(), "doc_id", "left_semi")
    order = Window.partitionBy("query_id").orderBy("rank")
    return kept.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def chunk_range(chunks: DataFrame, first: int, last: int, most: int = 8) -> DataFrame:
    """Chunks first to last of each document, counted from 1, at most so many."""
    a = max(1, first)
    return chunks.where(F.col("idx").between(a - 1, min(last, a + most - 1) - 1))


def assemble(chunks: DataFrame, glue: str = "\n") -> DataFrame:
    """Each document's chunks in order as one text."""
    rows = chunks.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("idx", "content"))).alias("c"))
    return rows.select("doc_id", F.array_join(F.transform("c", lambda x: x.content), glue).alias("content"))


def first_chunks(chunks: DataFrame) -> DataFrame:
    return chunks.groupBy("doc_id").agg(F.min_by(F.struct("chunk_id", "idx", "content"), "idx").alias("c")).select("doc_id", "c.*")


def page(docs: DataFrame, number: int, size: int = 30, key: str = "doc_id") -> DataFrame:
    """A page of the newest documents; the number is kept within the pages there are."""
    pages = max(1, -(-docs.count() // size))
    return docs.orderBy(F.desc(key)).offset((min(max(1, number), pages) - 1) * size).limit(size)


def facet(docs: DataFrame, file_type: str | None = None, tag: str | None = None, part: str | None = None) -> DataFrame:
    """Documents of a type, with a tag, with a part in their title, in any case; each may be left out."""
    if file_type:
        docs = docs.where(F.lower("file_type") == file_type.lower())
    if tag:
        docs = docs.where(F.exists("tags", lambda t: F.lower(t) == tag.lower()))
    return docs.where(F.contains(F.lower("title"), F.lit(part.lower()))) if part else docs


def format_tag(file_type: Column) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(v) for kv in FORMATS.items() for v in kv]), F.lower(file_type)), F.lit("text"))


def facts(rows: DataFrame, session: object = None, keyword: str | None = None, limit: int = 50) -> DataFrame:
    """Facts (session, fact, created) of a session, with a keyword, newest first."""
    if session is not None:
        rows = rows.where(F.col("session") == session)
    if keyword:
        rows = rows.where(F.contains("fact", F.lit(keyword)))
    return rows.orderBy(F.desc("created"), "session", "fact").limit(limit)


def add_facts(rows: DataFrame, new: DataFrame) -> DataFrame:
    """Facts that are not there yet, once each, added."""
    fresh = new.dropDuplicates(["session", "fact"]).join(rows, ["session", "fact"], "left_anti")
    return rows.unionByName(fresh)


def stats(docs: DataFrame, chunks: DataFrame) -> DataFrame:
    """One row: documents, chunks, tokens, megabytes."""
    d = docs.agg(F.count("*").alias("n_docs"), F.round(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)) / 1048576.0, 2).alias("size_mb"))
    c = chunks.agg(F.count("*").alias("n_chunks"), F.coalesce(F.sum("token_count"), F.lit(0)).alias("n_tokens"))
    return d.join(c)  # one row each


def tag_counts(docs: DataFrame) -> DataFrame:
    tags = docs.select("doc_id", F.explode(F.array_distinct(F.filter(F.transform("tags", lambda t: F.trim(t)), lambda t: t != ""))).alias("tag"))
    return tags.groupBy("tag").agg(F.count("*").alias("n"))


def facet_tree(docs: DataFrame) -> DataFrame:
    """Documents of each type (tag null) and of each type and tag."""
    rows = docs.select("file_type", F.explode_outer(F.array_distinct("tags")).alias("tag"))
    per_tag = rows.where("tag is not null").groupBy("file_type", "tag").agg(F.count("*").alias("n"))
    per_type = docs.groupBy("file_type").agg(F.count("*").alias("n")).select("file_type", F.lit(None).cast("string").alias("tag"), "n")
    return per_type.unionByName(per_tag)


def ingest_log(batch: DataFrame, known: DataFrame, types: list[str]) -> DataFrame:
    """batch (doc_id, text, file_type) with status and error_type: unsupported, empty or duplicate (in the store, or of an earlier row of the batch)."""
    rows = batch.withColumn("h", F.sha2(F.coalesce("text", F.lit("")), 256))
    first = rows.where(F.trim("text") != "").groupBy("h").agg(F.min("doc_id").alias("first_id"))
    rows = rows.join(first, "h", "left").join(known.select("h", F.lit(True).alias("stored")).distinct(), "h", "left")
    error = F.when(~F.col("file_type").isin(types), "unsupported").when(F.trim(F.coalesce("text", F.lit(""))) == "", "empty").when(F.coalesce("stored", F.lit(False)) | (F.col("doc_id") != F.col("first_id")), "duplicate")
    status = F.when(F.col("error").isNull(), "success").when(F.col("error") == "duplicate", "skipped").otherwise("failed")
    return rows.withColumn("error", error).select("doc_id", status.alias("status"), F.coalesce("error", F.lit("")).alias("error_type"))


def save_new(docs: DataFrame, chunks: DataFrame, stored: DataFrame) -> DataFrame:
    """Documents not stored yet, with their chunk and token counts: what an append writes."""
    per = chunks.groupBy("doc_id").agg(F.count("*").alias("chunk_count"), F.sum("token_count").alias("total_tokens"))
    return docs.join(stored.select("doc_id"), "doc_id", "left_anti").join(per, "doc_id", "left").withColumns({"chunk_count": F.coalesce("chunk_count", F.lit(0)), "total_tokens": F.coalesce("total_tokens", F.lit(0))})


def sessions(turns: DataFrame, saved: DataFrame, most: int) -> DataFrame:
    """(name, saved_at, n_messages, position): the most sessions last saved, newest first. turns (conv_id), saved (conv_id, saved_at); those never saved come last."""
    rows = turns.groupBy("conv_id").agg(F.count("*").alias("n_messages")).join(saved, "conv_id", "left")
    rows = rows.orderBy(F.desc_nulls_last("saved_at"), "conv_id").limit(most)
    place = F.row_number().over(Window.orderBy(F.desc_nulls_last("saved_at"), "conv_id"))  # over the most rows alone
    return rows.select(F.concat(F.lit("session "), F.col("conv_id").cast("string")).alias("name"), "saved_at", "n_messages", place.alias("position"))


def append(docs: DataFrame, path: str, partition: str = "language") -> None:
    docs.write.mode("append").partitionBy(partition).parquet(path)


# Maintenance -----------------------------------------------------------------------------------------------------------

def cascade_delete(tables: dict[str, DataFrame], gone: DataFrame) -> dict[str, DataFrame]:
    """Each table without the rows of the documents in gone (doc_id)."""
    return {name: t.join(gone.select("doc_id"), "doc_id", "left_anti") for name, t in tables.items()}


def update(docs: DataFrame, changes: DataFrame) -> DataFrame:
    """Titles and tags from changes (doc_id, new_title, new_tags); nulls and blank titles change nothing."""
    rows = docs.join(changes, "doc_id", "left")
    title = F.when(F.trim(F.coalesce("new_title", F.lit(""))) != "", F.col("new_title")).otherwise(F.col("title"))
    return rows.withColumn("title", title).withColumn("tags", F.coalesce("new_tags", "tags")).drop("new_title", "new_tags")


def rename_tag(docs: DataFrame, old: str, new: str) -> DataFrame:
    """old becomes new in its place, or goes where new is there already; changed tells the rows affected. Blank names change nothing."""
    if not old.strip() or not new.strip() or old == new:
        return docs.withColumn("changed", F.lit(False))
    has = F.array_contains("tags", old)
    renamed = F.array_distinct(F.transform("tags", lambda t: F.when(t == old, F.lit(new)).otherwise(t)))
    kept = F.when(F.array_contains("tags", new), F.array_remove("tags", old)).otherwise(renamed)
    return docs.withColumn("changed", has).withColumn("tags", F.when(has, kept).otherwise(F.col("tags")))


def merge_tag(docs: DataFrame, source: str, target: str) -> DataFrame:
    """source goes, and target is appended where it is missing."""
    if not source.strip() or not target.strip() or source == target:
        return docs.withColumn("changed", F.lit(False))
    has = F.array_contains("tags", source)
    return docs.withColumn("changed", has).withColumn("tags", F.when(has, F.array_union(F.array_remove("tags", source), F.array(F.lit(target)))).otherwise(F.col("tags")))


def merge_items(stored: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Only the new items that are not stored yet."""
    return new.dropDuplicates(keys).join(stored.select(*keys), keys, "left_anti")


def upsert(stored: DataFrame, new: DataFrame, keys: list[str], recency: str) -> DataFrame:
    """The latest row of each key."""
    latest = Window.partitionBy(*keys).orderBy(F.desc(recency))
    return stored.unionByName(new).withColumn("k", F.row_number().over(latest)).where("k = 1").drop("k")
