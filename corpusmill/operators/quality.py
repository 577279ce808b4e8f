"""Chunk quality, repeated lines, exact and near duplicates by SimHash."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import combinations
from math import comb

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.functions import vectors as V
from corpusmill.sources.sinks import sized, written

# Signs that stand for unread characters, and the penalty of each issue.
GARBLED = "□◇△▲▽▼☆★○●◎⊙¤§※"
PENALTIES = {"too_short": 0.3, "no_text_content": 0.6, "ocr_garbage": 0.5, "high_symbol_ratio": 0.2}


def _count(text: Column, pattern: str) -> Column:
    """Characters of a class, as the length lost when they go."""
    return F.length(text) - F.length(F.regexp_replace(text, pattern, ""))


def check(chunks: DataFrame, letters: str = r"[一-鿿㐀-䶿a-zA-Z]") -> DataFrame:
    """chunks with issues, score and is_low. letters: what counts as text."""
    rows = chunks.withColumn("t", F.regexp_replace("content", r"^\s+|\s+$", "")).withColumn("n", F.length("t"))
    t, n = F.col("t"), F.col("n")
    symbols = _count(t, r"[^\p{L}\p{N}\s]")
    found = F.when(n == 0, F.array(F.lit("empty"))).otherwise(
        F.array_compact(F.array(F.when(n < 20, "too_short"), F.when(_count(t, letters) < n * F.lit(0.3), "no_text_content"), F.when(_count(t, f"[{GARBLED}]") / n > F.lit(0.3), "ocr_garbage"), F.when(symbols / n > F.lit(0.5), "high_symbol_ratio")))
    )
    rows = rows.withColumn("issues", found)
    lost = reduce(lambda a, b: a + b, [F.when(F.array_contains("issues", i), F.lit(p)).otherwise(F.lit(0.0)) for i, p in PENALTIES.items()])
    score = F.when(F.array_contains("issues", "empty"), 0.0).otherwise(F.greatest(F.lit(0.0), 1 - lost))
    return rows.withColumn("score", F.round(score, 6)).withColumn("is_low", F.size("issues") > 0).drop("t", "n")


def report(checked: DataFrame) -> DataFrame:
    """One row: totals, share of normal chunks, health score, and counts of each issue."""
    issues = ["empty", *PENALTIES]
    n = checked.agg(F.count("*").alias("total"), F.count_if(~F.col("is_low")).alias("normal"), F.count_if("is_low").alias("low"), F.count_if(F.array_contains("issues", "ocr_garbage")).alias("ocr_poor"), *[F.count_if(F.array_contains("issues", i)).alias(f"n_{i}") for i in issues])
    share = F.round(F.col("normal") * 100.0 / F.nullif("total", F.lit(0)), 1)
    return n.withColumns({"normal_pct": F.coalesce(share, F.lit(0.0)), "health": F.coalesce(share, F.lit(100.0))})


def exact_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, first_id, is_duplicate): the first document with the same text. A text's group is reduced before it is joined back."""
    rows = docs.select("doc_id", F.sha2("text", 256).alias("h"))
    first = rows.groupBy("h").agg(F.min("doc_id").alias("first_id"))
    return rows.join(first, "h").select("doc_id", "first_id", (F.col("doc_id") != F.col("first_id")).alias("is_duplicate"))


def repeated_edges(docs: DataFrame, group: str, least: int = 3) -> DataFrame:
    """(group, line): first and last lines, without blanks and cut to 50 characters, that stand in max(least, half) of a group's documents, or look like page numbers."""
    lines = F.filter(F.split("text", "\n"), lambda x: F.trim(x) != "")
    bare = lambda c: F.substring(F.regexp_replace(c, r"\s+", ""), 1, 50)
    rows = docs.select(F.col(group).alias("grp"), lines.alias("l")).where(F.size("l") > 0)
    edge = rows.select("grp", F.explode(F.array_distinct(F.array(bare(F.element_at("l", 1)), bare(F.element_at("l", -1))))).alias("line"))
    sizes = rows.groupBy("grp").agg(F.count("*").alias("n"))
    counted = edge.groupBy("grp", "line").agg(F.count("*").alias("c")).join(sizes, "grp").where("n >= 3")
    number = F.col("line").rlike(r"^.{0,10}\d{1,3}$")  # bare, or after a few characters
    return counted.where((F.col("c") >= F.greatest(F.lit(least), F.floor(F.col("n") / 2))) | number).select("grp", "line", "c")


def drop_edges(docs: DataFrame, rules: DataFrame, group: str, most: int = 50, longer: int = 5, least: int = 4) -> DataFrame:
    """(doc_id, text): texts of docs without the lines that a rule (grp, line) of their group names. Blanks aside, such a line equals a rule's, or begins or ends with one of
    least characters or more and is at most longer characters longer. Rules have at most most characters.

    A line that is short enough meets the rules by its own beginnings and ends, so no document meets all rules of its group."""
    lines = docs.select("doc_id", F.col(group).alias("grp"), F.posexplode(F.split("text", "\n")).alias("at", "line"))
    lines = lines.select("doc_id", "grp", "at", F.regexp_replace("line", r"\s+", "").alias("bare")).where(F.length("bare").between(1, most + longer))
    n = F.length("bare")
    parts = [F.when(n - d >= least, side("bare", n - d)) for d in range(longer + 1) for side in (F.left, F.right)]
    keys = lines.select("doc_id", "grp", "at", F.explode(F.array_distinct(F.array_compact(F.array(F.col("bare"), *parts)))).alias("line"))
    known = sized(written(rules.select("grp", "line").distinct(), "edge-rules"))
    hits = keys.join(known, ["grp", "line"], "left_semi").groupBy("doc_id").agg(F.collect_set("at").alias("gone"))
    rows = docs.select("doc_id", "text").join(sized(written(hits, "edge-hits")), "doc_id", "left")
    left = F.filter(F.split("text", "\n"), lambda _, k: ~F.array_contains("gone", k))
    return rows.select("doc_id", F.when(F.col("gone").isNull(), F.col("text")).otherwise(F.array_join(left, "\n")).alias("text"))


#: The most blocks of a fingerprint, which is the most keys that are stored of one.
MOST_BLOCKS = 10


def hamming_blocks(most: int, blocks: int) -> list[tuple[int, int, int]]:
    """(first bit, bits, radius) of each block. If every block differed in more bits than its radius, over most bits would differ in all."""
    edge = [round(V.BITS * k / blocks) for k in range(blocks + 1)]
    radius = [(most + 1) // blocks - 1 + (k < (most + 1) % blocks) for k in range(blocks)]
    return [(a, b - a, r) for a, b, r in zip(edge[:-1], edge[1:], radius, strict=True)]


def _flips(bits: int, radius: int) -> int:
    return sum(comb(bits, k) for k in range(radius + 1))


def _plan(n: int, most: int) -> int:
    """The number of blocks for which probes and chance pairs are fewest."""

    def cost(blocks: int) -> float:
        flips = [(_flips(bits, r), bits) for _, bits, r in hamming_blocks(most, blocks)]
        return n * sum(f for f, _ in flips) + n * n / 2 * sum(f / 2**bits for f, bits in flips)

    return min(range(2 if most > 3 else 1, min(MOST_BLOCKS, most + 1) + 1), key=cost)


#: Fingerprints of a tile, distances worked out at once, and the most fingerprints that are compared by tiles if the number of blocks is not given.
TILE, CELLS, MOST_TILED = 32_768, 1 << 18, 20_000_000


def _near_pairs(left: np.ndarray, right: np.ndarray, most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places (x, y) of the pairs of left and right (64-bit numbers) that differ in at most most bits, a few rows of left at a time, in buffers that stay."""
    wide = np.concatenate((right, np.zeros(-len(right) % 8, np.uint64)))
    step = max(1, CELLS // max(len(wide), 1))
    bits, n, near = (np.empty((step, len(wide)), t) for t in (np.uint64, np.uint8, np.bool_))
    for k in range(0, len(left), step):
        a = left[k : k + step]
        np.bitwise_xor(a[:, None], wide, out=bits[: len(a)])
        np.bitwise_count(bits[: len(a)], out=n[: len(a)])
        np.less_equal(n[: len(a)], most, out=near[: len(a)])
        some = np.flatnonzero(near[: len(a)].reshape(-1).view(np.uint64))  # eight pairs at once, as few are near
        if len(some):
            at, inside = np.nonzero(near[: len(a)].reshape(-1, 8)[some])
            x, y = np.divmod(some[at] * 8 + inside, len(wide))
            real = y < len(right)
            yield x[real] + k, y[real]


def _near_in_tiles(groups: DataFrame, n: int, most: int, tile: int) -> DataFrame:
    """(doc_id, other, d): for the first row of each of n groups (first, whole) the best earlier first row within most bits, by pairs of tiles.

    Every two tiles meet in one task, which holds these two and no list of pairs, so memory and shuffle do not depend on how many fingerprints are alike. A
    comparison is one operation on 64 bits: all of them cost less than the probes and chance pairs of blocks do as rows."""
    tiles = max(1, -(-n // tile))
    own = groups.where("first is not null").withColumn("t", F.pmod(F.xxhash64("whole"), F.lit(tiles)).cast("int"))
    both = own.withColumn("u", F.explode(F.sequence(F.lit(0), F.lit(tiles - 1)))).withColumns({"i": F.least("t", "u"), "j": F.greatest("t", "u")}).drop("u")
    dealt = both.repartition(min(tiles * (tiles + 1) // 2, 2_000), "i", "j")
    kind = dict(groups.dtypes)["first"]

    def compare(key: tuple, rows: pa.Table) -> pa.Table:
        rank = pc.rank(rows["first"], tiebreaker="dense").to_numpy().astype(np.int64)
        place = np.argsort(rank, kind="stable")
        rank, bits = rank[place], rows["whole"].to_numpy().view(np.uint64)[place]
        left, right = (np.flatnonzero(rows["t"].to_numpy()[place] == k.as_py()) for k in key)
        # The least of distance and rank, as one number.
        best = np.full(len(place), np.iinfo(np.int64).max)
        for x, y in _near_pairs(bits[left], bits[right], most):
            x, y = left[x], right[y]
            d = np.bitwise_count(bits[x] ^ bits[y]).astype(np.int64) << 32
            for late, early in ((x, y), (y, x)):
                told = rank[early] < rank[late]
                np.minimum.at(best, late[told], d[told] | early[told])
        found = np.flatnonzero(best < np.iinfo(np.int64).max)
        first = rows["first"].combine_chunks()
        return pa.table({"doc_id": first.take(pa.array(place[found])), "other": first.take(pa.array(place[best[found] & 0xFFFFFFFF])), "d": pa.array((best[found] >> 32).astype(np.int32))})

    return dealt.select("i", "j", "t", "first", "whole").groupBy("i", "j").applyInArrow(compare, f"doc_id {kind}, other {kind}, d int")


def near_duplicates(docs: DataFrame, similarity: float = 0.85, blocks: int | None = None, tile: int = TILE) -> DataFrame:
    """(doc_id, duplicate_of, distance): for each row the best earlier row by SimHash, ties to the earliest.

    Equal fingerprints collapse first. By default all pairs of fingerprints are compared by tiles. With blocks, or beyond MOST_TILED fingerprints: at most
    k = floor((1 - similarity) * 64) bits may differ, so with radii that add up to k + 1 - blocks, two near fingerprints differ within its radius in some block.
    Each fingerprint is stored under its own blocks (at most MOST_BLOCKS keys), and asks for those within the radius of its blocks; pairs are verified. Neither way misses a pair."""
    most = int((1 - similarity) * V.BITS + 1e-9)
    rows = written(docs.select("doc_id", V.simhash(F.col("text")).alias("h")), "simhash")
    groups = written(rows.groupBy("h").agg(F.min("doc_id").alias("first")), "simhash-groups")
    n = groups.count()
    whole = F.shiftleft("h.hi", 32).bitwiseOR(F.col("h.lo"))
    own = rows.join(groups.select("h", "first"), "h").where("doc_id <> first").select("doc_id", F.col("first").alias("other"), F.lit(0).alias("d"))
    # Of a group's rows the first alone may have its best match elsewhere; a later copy has the first at distance 0.
    far = _near_in_tiles(groups.select("first", whole.alias("whole")), n, most, tile) if blocks is None and n <= MOST_TILED else _near_in_blocks(groups, whole, most, blocks or _plan(n, most))
    best = own.unionByName(far).groupBy("doc_id").agg(F.min(F.struct("d", "other")).alias("m"))
    return best.select("doc_id", F.col("m.other").alias("duplicate_of"), F.col("m.d").cast("int").alias("distance"))


def _near_in_blocks(groups: DataFrame, whole: Column, most: int, blocks: int) -> DataFrame:
    """The pairs (doc_id, other, d) of first rows whose fingerprints are near, found by blocks."""
    cuts = hamming_blocks(most, blocks)
    if min(r for _, _, r in cuts) < 0:
        raise ValueError("fewer blocks are needed for this similarity")
    parts = F.array(*[F.struct(F.lit(k).alias("block"), F.shiftrightunsigned(whole, first).bitwiseAND(F.lit((1 << bits) - 1 if bits < V.BITS else -1).cast("long")).alias("part")) for k, (first, bits, _) in enumerate(cuts)])
    stored = groups.select("h", "first", F.explode(parts).alias("x")).select("h", "first", "x.block", "x.part")
    # The flips of a block are a short table whose size the radii fix.
    flips = [(k, sum(1 << b for b in bits)) for k, (_, n, r) in enumerate(cuts) for size in range(r + 1) for bits in combinations(range(n), size)]
    masks = groups.sparkSession.createDataFrame(pd.DataFrame(flips, columns=["block", "mask"]), "block int, mask long")
    asked = stored.join(F.broadcast(masks), "block").select(F.col("h").alias("ha"), F.col("first").alias("fa"), "block", F.col("part").bitwiseXOR(F.col("mask")).alias("part"))
    found = stored.select(F.col("h").alias("hb"), F.col("first").alias("fb"), "block", "part")
    d = V.hamming(F.col("ha"), F.col("hb"))
    return asked.join(found, ["block", "part"]).where((F.col("fb") < F.col("fa")) & (d <= most)).select(F.col("fa").alias("doc_id"), F.col("fb").alias("other"), d.alias("d"))


def resolve_and_remove(chunks: DataFrame, prefix: str) -> DataFrame:
    """chunks without the one whose id has the prefix; an ambiguous or unknown prefix removes nothing."""
    hit = chunks.where(F.startswith("chunk_id", F.lit(prefix))).limit(2).agg(F.count("*").alias("n"), F.min("chunk_id").alias("chunk_id")).where("n = 1").select("chunk_id")
    return chunks.join(F.broadcast(hit), "chunk_id", "left_anti")


