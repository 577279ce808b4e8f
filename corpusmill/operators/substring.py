"""Substring search over a written trigram index.

Tables: texts (folder, and the columns of the chunks), dealt to folders by a hash of chunk_id; postings (folder, segment, gram, rows), dealt to folders by a hash of the gram:
the chunks of a segment, which is a batch of a task, that hold the gram, as places in the segment; segments (segment, ids, homes), the chunks of each segment; grams (gram,
folder, df). A segment is inverted where it is read, so postings are written without a shuffle. A keyword of three characters or more is looked up by its rarest trigrams:
their folders alone are read, the chunks that hold all of them are candidates, and of the texts only the candidates' folders are read to verify them. Shorter keywords are found by a scan.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.sources.sinks import sized, written

#: Folders of postings and of texts, trigrams that a keyword is looked up by, the most chunks of a segment.
FOLDERS, GRAMS, ROWS = 64, 4, 4096


@dataclass(frozen=True)
class SubstringIndex:
    texts: DataFrame
    grams: DataFrame
    postings: DataFrame
    segments: DataFrame


def invert(texts: list[str | None]) -> Iterator[tuple[str, np.ndarray]]:
    """(gram, places): each run of three characters, and the places of the texts that hold it in ascending order. Null and short texts have none."""
    texts = [t or "" for t in texts]
    chars = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
    sizes = np.array([len(t) for t in texts], np.int64)
    row = np.repeat(np.arange(len(texts)), sizes)
    known = np.zeros(0x110000, bool)
    known[chars] = True
    alphabet = np.flatnonzero(known)
    bits, low = max(len(alphabet) - 1, 1).bit_length(), max(len(texts) - 1, 0).bit_length()
    if 3 * bits + low > 63 and len(texts) > 1:  # one number does not hold a gram and a place
        half = len(texts) // 2
        yield from invert(texts[:half])
        yield from ((gram, places + half) for gram, places in invert(texts[half:]))
        return
    code = (np.cumsum(known) - 1).astype(np.uint64)[chars]
    starts = np.flatnonzero(row[2:] == row[:-2])
    if not len(starts):
        return
    shift = lambda x, n: x << np.uint64(n)
    key = np.sort(shift(shift(code[starts], 2 * bits) | shift(code[starts + 1], bits) | code[starts + 2], low) | row[starts].astype(np.uint64))
    key = key[np.append(True, key[1:] != key[:-1])]
    gram, places = key >> np.uint64(low), (key & np.uint64((1 << low) - 1)).astype(np.int32)
    first = np.flatnonzero(np.append(True, gram[1:] != gram[:-1]))
    mask = np.uint64((1 << bits) - 1)
    own = np.stack([alphabet[(gram[first] >> np.uint64(k * bits) & mask).astype(np.int64)] for k in (2, 1, 0)], axis=1)
    names = own.astype("<u4").tobytes().decode("utf-32-le")
    for k, (a, b) in enumerate(zip(first, np.append(first[1:], len(key)), strict=True)):
        yield names[3 * k : 3 * k + 3], places[a:b]


def _folder(key: Column) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(FOLDERS)).cast("int")


def build(chunks: DataFrame, path: str) -> SubstringIndex:
    """Writes the index of chunks (chunk_id, doc_id, idx, content) under path."""
    spark = chunks.sparkSession
    rows = chunks.select("chunk_id", "doc_id", "idx", "content", _folder(F.col("chunk_id")).alias("folder"))
    rows.repartition("folder").write.partitionBy("folder").parquet(f"{path}/texts")
    kind = dict(rows.dtypes)["chunk_id"]

    def segment(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name = TaskContext.get().partitionId() << 32
        for batch in batches:
            for k in range(0, batch.num_rows, ROWS):
                own = batch.slice(k, ROWS)
                name += 1
                told = list(invert(own.column("content").to_pylist()))
                n = len(told) + 1  # the last row tells the segment's chunks
                empty = lambda values, n=n: pa.ListArray.from_arrays(pa.array([0] * n + [len(values)], pa.int32()), values)
                ends = np.cumsum([0, *(len(p) for _, p in told), 0])
                places = pa.array(np.concatenate([p for _, p in told]) if told else [], pa.int32())
                yield pa.record_batch({
                    "segment": pa.array([name] * n, pa.int64()), "gram": pa.array([*(g for g, _ in told), None], pa.string()), "rows": pa.ListArray.from_arrays(pa.array(ends, pa.int32()), places),
                    "ids": empty(own.column("chunk_id")), "homes": empty(own.column("home")),
                })

    schema = f"segment long, gram string, rows array<int>, ids array<{kind}>, homes array<int>"
    found = rows.select("chunk_id", F.lower("content").alias("content"), F.col("folder").alias("home")).mapInArrow(segment, schema)
    found = found.withColumn("folder", F.when(F.col("gram").isNull(), -1).otherwise(_folder(F.col("gram"))))
    found.sortWithinPartitions("folder", "gram").write.partitionBy("folder").option("compression", "zstd").parquet(f"{path}/postings")
    every = spark.read.schema(f"{schema}, folder int").parquet(f"{path}/postings")
    postings = every.where("folder >= 0").select("segment", "gram", "rows", "folder")
    postings.groupBy("gram", "folder").agg(F.sum(F.size("rows")).alias("df")).write.parquet(f"{path}/grams")
    texts = spark.read.schema(", ".join(f"{c} {t}" for c, t in rows.dtypes)).parquet(f"{path}/texts")
    return SubstringIndex(texts, spark.read.parquet(f"{path}/grams"), postings, every.where("folder = -1").select("segment", "ids", "homes"))


def candidates(index: SubstringIndex, keyword: str) -> DataFrame:
    """(chunk_id, home) of the chunks that hold the rarest trigrams of a keyword of three characters or more."""
    own = sorted({keyword.lower()[k : k + 3] for k in range(len(keyword) - 2)})
    rare = index.grams.where(F.col("gram").isin(own)).orderBy("df", "gram").limit(GRAMS).collect()  # at most GRAMS rows
    known = {r["gram"] for r in rare}
    chunks = index.segments.select("segment", F.arrays_zip(F.col("ids").alias("chunk_id"), F.col("homes").alias("home")).alias("own"))
    if len(known) < min(GRAMS, len(own)):  # a trigram that no text holds
        return chunks.where(F.lit(False)).select(F.explode("own").alias("x")).select("x.chunk_id", "x.home")
    folders = sorted({r["folder"] for r in rare})
    held = index.postings.where(F.col("folder").isin(folders) & F.col("gram").isin(sorted(known)))
    # A gram may have two rows of a segment (one that was halved), so a segment's rows of a gram are put together first.
    one = held.groupBy("segment", "gram").agg(F.flatten(F.collect_list("rows")).alias("rows")).groupBy("segment").agg(F.collect_list("rows").alias("l")).where(F.size("l") == len(known))
    both = F.aggregate(F.slice("l", 2, len(known)), F.element_at("l", 1), F.array_intersect)
    met = chunks.join(one.select("segment", both.alias("rows")), "segment")
    return met.select(F.explode(F.transform("rows", lambda k: F.get("own", k))).alias("x")).select("x.chunk_id", "x.home")


def search(index: SubstringIndex, keyword: str) -> DataFrame:
    """Chunks that hold the keyword in any case."""
    match = F.contains(F.lower("content"), F.lit(keyword.lower()))
    if len(keyword) < 3:
        return index.texts.where(match).drop("folder")
    found = written(candidates(index, keyword), "substring-candidates")
    folders = [r["home"] for r in found.select("home").distinct().collect()]  # at most FOLDERS
    texts = index.texts.where(F.col("folder").isin(folders)) if folders else index.texts.where(F.lit(False))
    return texts.join(sized(found, 200_000), "chunk_id", "left_semi").where(match).drop("folder")
