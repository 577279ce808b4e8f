"""Document fingerprints by one-permutation MinHash.

The hashes of a text's five-word shingles are dealt once into bins by their high bits, and each bin keeps its least hash. An empty
bin borrows from another that a fixed sequence of hashes of (bin, attempt) picks, the same for all texts (optimal
densification). The low bits of each bin are packed; two fingerprints agree in (1 - c) * J + c of the bins, c = 2 ** -bits, which
likeness() corrects.

Defined cases: null text is empty; texts of fewer than five words are one shingle, texts without words share the fingerprint of
no shingle, which is like itself and, up to chance, like no other; equal texts have equal fingerprints; rows of one doc_id are ordered by
their texts' hashes; a null doc_id comes last in descending order; the only document follows itself; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.llm.common import materialize
from corpusmill.llm.hashing import blocks, mix64, shingle_hashes

BINS, BITS = 256, 4
_U = np.uint64


def fingerprints(texts: list[str], bins: int = BINS, bits: int = BITS) -> np.ndarray:
    """The low bits of each text's bins, a row of bins bytes each."""
    data = [t.encode("utf-8", "surrogatepass") for t in texts]
    out = np.empty((len(texts), bins), np.uint8)
    for part in blocks([len(t) for t in data]):
        h, n = shingle_hashes(data[part])
        low = np.full((len(n), bins), ~_U(0))
        shift = _U(64 - (bins - 1).bit_length())
        np.minimum.at(low.ravel(), np.repeat(np.arange(len(n)), n) * bins + (h >> shift).astype(np.int64), h)
        full = low != ~_U(0)
        low[n == 0] = mix64(np.arange(1, bins + 1, dtype=_U))
        full[n == 0] = True
        rows, at = np.nonzero(~full)
        attempt = 0
        while len(rows):
            attempt += 1
            with np.errstate(over="ignore"):
                pick = (mix64(at.astype(_U) * _U(0x9E3779B97F4A7C15) + _U(attempt) * _U(0xC2B2AE3D27D4EB4F)) % _U(bins)).astype(np.int64)
            good = full[rows, pick]
            low[rows[good], at[good]] = low[rows[good], pick[good]]
            rows, at = rows[~good], at[~good]
        out[part] = (low & _U(2**bits - 1)).astype(np.uint8)
    return out


def pack(low: np.ndarray, bits: int = BITS) -> list[str]:
    """Hex of each row's low bits, one after the other."""
    each = np.unpackbits(low[:, :, None], axis=2)[:, :, 8 - bits :].reshape(len(low), low.shape[1] * bits)
    return [row.tobytes().hex() for row in np.packbits(each, axis=1)]


def likeness(a: np.ndarray, b: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Estimated Jaccard likeness of each pair of rows, corrected for chance agreement, within 0 and 1."""
    chance = 2.0**-bits
    return np.clip(((a == b).mean(axis=1) - chance) / (1 - chance), 0, 1)


def edited(text: str, following: str) -> str:
    """text with its last third replaced by as much of the start of following."""
    k = len(text) // 3
    return text[: len(text) - k] + following[:k]


RESULT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
_NAMES = [c.split()[0] for c in RESULT.split(", ")]


def _compare(ids: pa.Array, texts: list[str], following: list[str], bins: int, bits: int) -> list[pa.Array]:
    changed = [edited(t, f) for t, f in zip(texts, following, strict=True)]
    a, e, f = (fingerprints(x, bins, bits) for x in (texts, changed, following))
    digests = [hashlib.sha256(x.encode("utf-8", "surrogatepass")).hexdigest() for x in changed]
    return [ids, pa.array(map(len, texts), pa.int64()), pa.array(digests, pa.string()), pa.array(pack(a, bits), pa.string()), pa.array(pack(e, bits), pa.string()), pa.array(likeness(a, e, bits)), pa.array(likeness(a, f, bits))]


def compare_with_next(docs: DataFrame, bins: int = BINS, bits: int = BITS, partitions: int | None = None) -> DataFrame:
    """For each of docs (doc_id, text): its fingerprint, that of its edited text, and their likeness to it and to the next document, by descending doc_id.

    Documents are range-partitioned once, by doc_id and the text's hash (whose sample goes to the driver, no text does), so all but a
    partition's last document find the next one in the same task. The first and last document of each partition are written aside and
    paired in a second, small step."""
    spark = docs.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    # Equal rows can change places; numbering them lets many of them be dealt to several tasks.
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), F.monotonically_increasing_id().alias("k"))
    rows = rows.withColumn("h", F.xxhash64("text"))
    order = [F.col("doc_id").desc_nulls_last(), F.col("h")]
    rows = rows.repartitionByRange(n, *order, "k").sortWithinPartitions(*order, "text", "k").select("doc_id", "text", F.spark_partition_id().alias("part"))

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
        names = [*_NAMES, "edge", "part", "text"]

        def edge(which: str, doc_id: pa.Array, text: str) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([doc_id, *(pa.nulls(1, k) for k in kinds[1:]), pa.array([which]), pa.array([part], pa.int32()), pa.array([text])], names)

        part = held = None
        for batch in batches:
            ids, texts = batch["doc_id"], batch["text"].to_pylist()
            if not texts:
                continue
            if part is None:
                part = batch["part"][0].as_py()
                yield edge("first", ids.slice(0, 1), texts[0])
            else:
                ids, texts = pa.concat_arrays([held[0], ids]), [held[1], *texts]
            held = (ids.slice(len(texts) - 1), texts[-1])
            for cut in blocks([4 * len(t) for t in texts[:-1]]):
                n = cut.stop - cut.start
                done = _compare(ids.slice(cut.start, n), texts[cut], texts[cut.start + 1 : cut.stop + 1], bins, bits)
                yield pa.RecordBatch.from_arrays([*done, pa.nulls(n, pa.string()), pa.array([part] * n, pa.int32()), pa.nulls(n, pa.string())], names)
        if held is not None:
            yield edge("last", *held)

    done = materialize(rows.mapInArrow(walk, RESULT + ", edge string, part int, text string"), "fingerprints", "zstd")  # hex is halved
    firsts = done.where("edge = 'first'").select("part", F.col("text").alias("following"))
    # One row for each partition: the next partition that has rows, and after the last the first again.
    whole = Window.orderBy("part")
    after = firsts.select("part", F.coalesce(F.lead("part").over(whole), F.first("part").over(whole.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).alias("next_part"))
    pairs = done.where("edge = 'last'").select("doc_id", "text", "part").join(after, "part").join(firsts.withColumnRenamed("part", "next_part"), "next_part")

    def close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                yield pa.RecordBatch.from_arrays(_compare(batch["doc_id"], batch["text"].to_pylist(), batch["following"].to_pylist(), bins, bits), _NAMES)

    return done.where("edge is null").select(*_NAMES).unionByName(pairs.select("doc_id", "text", "following").mapInArrow(close, RESULT))
