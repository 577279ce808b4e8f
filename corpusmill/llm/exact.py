"""Exact duplicates by an extendible-hash index on shared files.

Texts are equal when they are identical without ASCII blanks. A task collapses the equal texts of each block of rows and writes the rows, each
first one with its text. A key is 64 bits of the text's SHA-256. The directory has a slot for each value of the keys' first bits; while a
bucket holds more than capacity keys, the directory doubles and that bucket splits, so buckets of fewer keys keep several slots. Owner tasks take the
entries of their buckets in order of keys and chain them: an entry is compared byte by byte with the texts on its key's
chain and joins an equal one or becomes the next. Only the chain of one key is in memory. Directory and chains are Parquet tables in the shared folder.

A key with more than page entries (the same text in many blocks; splitting cannot part it) is dealt in pages to several owners,
whose chains' heads meet once more. Rows of a text never meet in one task, but for those of one block.

Defined cases: null text is empty; texts without anything but blanks are one group; of rows of equal length and doc_id one stays, the first as
read; a null doc_id is a document like others and comes last among rows of equal length; repeated rows are copies; whole texts are compared, however
long; an empty table gives no rows; other columns are not read but those named in keep, which may have any names but those of the result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusmill.llm.common import materialize, sized

#: Keys of a bucket, entries of a chain's page, and the most bits of the directory (its size stays below a million slots).
CAPACITY, PAGE, MOST_BITS = 100_000, 10_000, 18
#: Rows and bytes of texts that a task collapses at once.
ROWS, BLOCK = 4096, 1 << 23
BLANKS = b" \t\n\v\f\r"


def normalized(text: str | bytes) -> bytes:
    return (text.encode("utf-8", "surrogatepass") if isinstance(text, str) else text).translate(None, BLANKS)


def _collapsed(docs: DataFrame, keep: tuple[str, ...]) -> DataFrame:
    """A row for each document: its digest, key and address, and the address of the first equal one of its block (at). That one has size, best and text of them."""
    kept = {f"c{k}": name for k, name in enumerate(keep)}  # names of their own, so that none clashes
    kinds = [T.StructField(c, docs.schema[name].dataType) for c, name in kept.items()]
    schema = T.StructType.fromDDL("doc_id long, row long, at long, digest binary, key long, size long, best_chars long, best_id long, best_row long, text binary")
    schema = T.StructType([*kinds, *schema.fields])

    def block(table: pa.Table, texts: list[bytes], first_row: int) -> pa.RecordBatch:
        n = len(texts)
        chars = np.array(pc.fill_null(pc.utf8_length(table["text"]), 0).to_pylist(), np.int64)
        ids = table["doc_id"].to_pylist()
        digests = [hashlib.sha256(t).digest() for t in texts]
        keys = np.array([int.from_bytes(d[:8], "big", signed=True) for d in digests], np.int64)
        chains: dict[int, list[int]] = {}
        members: dict[int, list[int]] = {}
        for k, key in enumerate(keys.tolist()):
            chain = chains.setdefault(key, [])
            at = next((j for j in chain if texts[j] == texts[k]), k)
            if at == k:
                chain.append(k)
            members.setdefault(at, []).append(k)
        at, size, best = np.zeros(n, np.int64), [None] * n, [None] * n
        for head, rows in members.items():
            at[rows] = head
            size[head] = len(rows)
            best[head] = min(rows, key=lambda r: (-chars[r], ids[r] is None, ids[r], r))
        of_best = lambda values: pa.array([None if b is None else values[b] for b in best], pa.int64())
        columns = [
            pa.array(ids, pa.int64()), pa.array(first_row + np.arange(n)), pa.array(first_row + at), pa.array(digests, pa.binary()), pa.array(keys), pa.array(size, pa.int64()),
            of_best(chars.tolist()), of_best(ids), of_best((first_row + np.arange(n)).tolist()), pa.array([None if s is None else t for s, t in zip(size, texts, strict=True)], pa.binary()),
        ]
        return pa.RecordBatch.from_arrays([*(table[c].combine_chunks() for c in kept), *columns], names=schema.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first_row = TaskContext.get().partitionId() << 36
        rows, texts, held = [], [], 0

        def close() -> pa.RecordBatch:
            return block(pa.Table.from_batches(rows), texts, first_row)

        for batch in (b.slice(k, 256) for b in batches for k in range(0, len(b), 256)):
            start = 0
            for k, text in enumerate(batch["text"].cast(pa.binary()).to_pylist()):
                texts.append(normalized(text or b""))
                held += len(texts[-1])
                if len(texts) >= ROWS or held >= BLOCK:
                    rows.append(batch.slice(start, k + 1 - start))
                    yield close()
                    first_row += len(texts)
                    rows, texts, held, start = [], [], 0, k + 1
            if start < len(batch):
                rows.append(batch.slice(start))
        if texts:
            yield close()

    return docs.select(*[F.col(f"`{name}`").alias(c) for c, name in kept.items()], F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema)


def grow(counts: np.ndarray, capacity: int) -> tuple[int, np.ndarray, np.ndarray]:
    """Directory over keys by their number for each value of their first bits: its depth, and for each slot its bucket (the bucket's first slot) and the bucket's depth."""
    depth, own = 0, np.zeros(1, np.int64)
    while True:
        # A bucket of less depth than the directory has been small enough before.
        full = (own == depth) & (counts.reshape(1 << depth, -1).sum(axis=1) > capacity)
        if not full.any() or 1 << depth == len(counts):
            slots = np.arange(1 << depth)
            return depth, slots >> (depth - own) << (depth - own), own
        own = np.repeat(own, 2) + np.repeat(full, 2)
        depth += 1


def directory(keys: DataFrame, capacity: int = CAPACITY) -> tuple[int, DataFrame]:
    """Depth, and a written table (slot, bucket, depth), for distinct keys (key). Its size is below 2 ** MOST_BITS rows."""
    few = keys.groupBy(F.shiftrightunsigned("key", 64 - MOST_BITS).alias("cell")).agg(F.count("*").alias("n"))
    counts = np.zeros(1 << MOST_BITS, np.int64)
    found = few.toPandas()
    counts[found["cell"].to_numpy(np.int64)] = found["n"]
    depth, bucket, own = grow(counts, capacity)
    frame = pd.DataFrame({"slot": np.arange(1 << depth), "bucket": bucket, "depth": own})
    return depth, materialize(keys.sparkSession.createDataFrame(frame, "slot long, bucket long, depth long"), "exact-directory")


def _chained(entries: DataFrame) -> DataFrame:
    """entries (bucket, page, key, at, n_pages, text, ...) with link, their place on their key's chain; the text stays at the heads of links of several pages."""
    others = [c for c in entries.columns if c != "text"]
    schema = T.StructType([*(entries.schema[c] for c in others), T.StructField("link", T.LongType()), T.StructField("head", T.BooleanType()), T.StructField("text", T.BinaryType())])

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, chain = None, []
        for batch in batches:
            link, heads, texts = [], [], []
            for me, pages, text in zip(zip(batch["page"].to_pylist(), batch["key"].to_pylist(), strict=True), batch["n_pages"].to_pylist(), batch["text"], strict=True):
                if me != now:
                    now, chain = me, []
                text = text.as_py()
                k = next((k for k, other in enumerate(chain) if other == text), len(chain))
                link.append(k)
                heads.append(k == len(chain))
                if heads[-1]:
                    chain.append(text)
                texts.append(text if heads[-1] and pages > 1 else None)
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in others), pa.array(link, pa.int64()), pa.array(heads, pa.bool_()), pa.array(texts, pa.binary())], names=schema.names)

    dealt = entries.repartition("bucket", "page").sortWithinPartitions("page", "key", "at")
    return dealt.mapInArrow(own, schema)


def exact_duplicates(docs: DataFrame, keep: tuple[str, ...] = (), capacity: int = CAPACITY, page: int = PAGE) -> DataFrame:
    """docs (doc_id, text, and the columns named in keep) as (doc_id, keep_id, group_size, kept, text_sha256): of equal texts the row of most code points, then of the least doc_id, is kept."""
    rows = materialize(_collapsed(docs, keep), "exact-rows", "zstd")
    entries = rows.where("size is not null").select("key", "at", "size", "best_chars", "best_id", "best_row", "text")
    keys = materialize(entries.groupBy("key").agg(F.count("*").alias("n")), "exact-keys")
    depth, slots = directory(keys, capacity)
    slot = F.shiftrightunsigned("key", 64 - depth) if depth else F.lit(0).cast("long")
    entries = entries.withColumn("slot", slot).join(F.broadcast(slots.select("slot", "bucket")), "slot").drop("slot")
    long_ = materialize(keys.where(F.col("n") > page).select("key", F.ceil(F.col("n") / page).alias("n_pages")), "exact-long")
    entries = entries.join(sized(long_), "key", "left").withColumn("n_pages", F.coalesce("n_pages", F.lit(1)))
    entries = entries.withColumn("page", F.pmod(F.xxhash64("at"), F.col("n_pages")))
    chained = materialize(_chained(entries), "exact-chains")
    heads = chained.where("head and n_pages > 1").select("bucket", F.lit(0).cast("long").alias("page"), "key", "at", F.lit(1).cast("long").alias("n_pages"), F.col("page").alias("of"), F.col("link").alias("old"), "text")
    whole = materialize(_chained(heads).select(F.col("key").alias("k"), "of", "old", F.col("link").alias("whole")), "exact-heads")
    same = (F.col("key") == F.col("k")) & (F.col("page") == F.col("of")) & (F.col("link") == F.col("old"))
    links = chained.join(sized(whole), same, "left").withColumn("link", F.coalesce("whole", "link"))
    best = F.min(F.struct((-F.col("best_chars")).alias("c"), F.col("best_id").isNull().alias("none"), F.col("best_id").alias("id"), F.col("best_row").alias("row")))
    groups = materialize(links.groupBy("bucket", "key", "link").agg(F.sum("size").alias("group_size"), best.alias("b")), "exact-groups")
    told = links.select("at", "key", "link").join(groups.select("key", "link", F.col("b.id").alias("keep_id"), F.col("b.row").alias("keep_row"), "group_size"), ["key", "link"])
    out = rows.drop("size", "best_chars", "best_id", "best_row", "text", "key").join(told.select("at", "keep_id", "keep_row", "group_size"), "at")
    return out.select("doc_id", *[F.col(f"c{k}").alias(name) for k, name in enumerate(keep)], "keep_id", "group_size", (F.col("row") == F.col("keep_row")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))
