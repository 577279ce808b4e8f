"""Sharding by a permutation-filled lookup table.

Each shard has its own order of the slots, from two hashes of its name; shards take turns, each claiming the first slot of its
order that is free, until the prime-sized table is full. The table has a fixed size, so it is a literal in the plan, and placing
a row is a hash, a modulus and one array access: no shuffle. When a shard leaves, few rows of the others move.

Defined cases: a null key hashes as the empty string; rows of equal keys share a shard; an empty table gives no rows; other
columns are kept.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TABLE_SIZE = 16_381
SHARDS = [f"shard-{k:03d}" for k in range(96)]


def lookup_table(shards: list[str], size: int = TABLE_SIZE) -> list[int]:
    """For each slot the index of its shard. size must be prime and at least the number of shards."""
    if len(set(shards)) != len(shards) or not 0 < len(shards) <= size or any(size % d == 0 for d in range(2, int(size**0.5) + 1)):
        raise ValueError("shards must be distinct, and the size a prime not below their number")
    halves = [hashlib.sha256(name.encode()).digest() for name in shards]
    offset = [int.from_bytes(h[:8], "big") % size for h in halves]
    skip = [int.from_bytes(h[8:16], "big") % (size - 1) + 1 for h in halves]
    slots, tried, left = [-1] * size, [0] * len(shards), size
    while left:
        for k in range(len(shards)):
            while slots[at := (offset[k] + skip[k] * tried[k]) % size] >= 0:
                tried[k] += 1
            slots[at] = k
            tried[k] += 1
            left -= 1
            if not left:
                break
    return slots


def slot_of(key: Column, size: int = TABLE_SIZE) -> Column:
    """The first 32 bits of the key's MD5, modulo the table's size."""
    return (F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit(""))), 1, 8), 16, 10).cast("long") % size).cast("int")


def place(rows: DataFrame, key: str, shards: list[str] = SHARDS, size: int = TABLE_SIZE, lost: str | None = None) -> DataFrame:
    """rows with slot and shard, and if a shard is named lost, shard_without: the shard after it has left."""
    out = rows.withColumn("slot", slot_of(F.col(key), size)).withColumn("shard", F.get(_names(shards, size), F.col("slot")))
    if lost is not None:
        out = out.withColumn("shard_without", F.get(_names([s for s in shards if s != lost], size), F.col("slot")))
    return out


def _names(shards: list[str], size: int) -> Column:
    """The table's shards by slot, an array that is folded to a literal."""
    if any("\n" in s for s in shards):
        raise ValueError("a shard's name holds no line break")
    return F.split(F.lit("\n".join(shards[k] for k in lookup_table(shards, size))), "\n")


def write_shards(rows: DataFrame, key: str, path: str, shards: list[str] = SHARDS, files_per_shard: int = 8) -> None:
    """Writes one folder for each shard; a shard's rows are dealt by slot to several tasks, so no shard is one task."""
    placed = place(rows, key, shards)
    placed.repartition(len(shards) * files_per_shard, "shard", F.col("slot") % files_per_shard).drop("slot").write.partitionBy("shard").parquet(path)
