"""Near-duplicates by BagMinHash signatures, banding and verified multiset overlap.

A document is the multiset of its five-word shingles. Each shingle, copy level by copy level ([0,1), [1,2), [2,4), [4,8), ...), has its own
Poisson process of points (time, height, component); a document uses the points below its shingle's count. Component i of the
signature is the earliest point labelled i, so two signatures agree in a component with the weighted Jaccard likeness of the
multisets. Points are made in order of time and only until no later one can matter, so a signature costs about
n + m log m points.

Texts with the same words collapse to one class first. Signatures are cut into bands; documents that share a band are candidates.
Each bucket links its members to one of them, the one that shares most buckets with most texts, never all pairs; links are verified by exact
multiset overlap and joined into classes. Where a bucket still holds several classes, its members are joined across classes on
their rarest shingles, with bounds under which no pair that could reach the likeness is lost. With m = 125 and bands of 5 a pair at likeness
0.8 shares a band with probability 0.99995.

Defined cases: null text is empty; texts of the same words in the same order are one class, among them all texts without words;
texts of fewer than five words are one shingle; repeated rows are copies; a null doc_id is a document like others, its class id the
least doc_id of the class, if any; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.llm.common import WORD, materialize
from corpusmill.llm.hashing import blocks, mix64, shingle_hashes

COMPONENTS, ROWS_PER_BAND, WIDTH, LIKENESS = 125, 5, 5, 0.8
#: UTF-8 bytes of text that are hashed at once; bounds the memory of a task, which is some 50 times as much.
HASHED = 1 << 20
_U = np.uint64


def _uniform(h: np.ndarray) -> np.ndarray:
    return ((h >> _U(11)).astype(np.float64) + 0.5) * 2.0**-53


def _multisets(texts: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text index, shingle hash and count of each distinct shingle of each text."""
    h, n = shingle_hashes(texts, width)
    owner = np.repeat(np.arange(len(texts)), n)
    order = np.lexsort((h, owner))
    h, owner = h[order], owner[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])
    at = np.flatnonzero(new)
    return owner[at], h[at], np.diff(np.concatenate((at, [len(h)])))


def signatures(texts: list[str], m: int = COMPONENTS, width: int = WIDTH) -> np.ndarray:
    """BagMinHash signatures, a row of m times for each text; a text without words has infinities."""
    out = np.full((len(texts), m), np.inf)
    data = [t.encode("utf-8", "surrogatepass") for t in texts]
    for part in blocks([len(t) for t in data], HASHED):
        out[part] = _signatures(data[part], m, width)
    return out


def _signatures(data: list[bytes], m: int, width: int) -> np.ndarray:
    owner, h, count = _multisets(data, width)
    sig = np.full((len(data), m), np.inf)
    parts = []  # processes: text, count, lower end and length of the level, state
    low, size = 0, 1
    with np.errstate(over="ignore"):
        while True:
            use = count > low
            if not use.any():
                break
            parts.append((owner[use], count[use].astype(np.float64), np.full(use.sum(), float(low)), np.full(use.sum(), float(size)), mix64(h[use] + _U(low + 1) * _U(0x9E3779B97F4A7C15))))
            low, size = low + size, low + size
        if not parts:
            return sig
        text, count, low, size, state = (np.concatenate(x) for x in zip(*parts, strict=True))
        time = np.zeros(len(text))
        step = 0
        while len(text):
            step += 1
            r = mix64(state + _U(step) * _U(0xD1B54A32D192ED03))
            time = time - np.log(_uniform(r)) / size
            r = mix64(r ^ _U(0xA0761D6478BD642F))
            component = ((r >> _U(32)) % _U(m)).astype(np.int64)
            height = low + size * ((r & _U(0xFFFFFFFF)).astype(np.float64) * 2.0**-32)
            most = sig.max(axis=1)
            live = time <= most[text]
            use = live & (height < count)
            np.minimum.at(sig.ravel(), text[use] * m + component[use], time[use])
            text, count, low, size, state, time = (x[live] for x in (text, count, low, size, state, time))
    return sig


def band_keys(sig: np.ndarray, rows: int = ROWS_PER_BAND) -> np.ndarray:
    """A 64-bit key for each band of each signature, which tells the band too."""
    bits = np.ascontiguousarray(sig).view(_U)
    keys = np.zeros((len(sig), sig.shape[1] // rows), _U)
    with np.errstate(over="ignore"):
        for k in range(rows):
            keys = mix64(keys * _U(0x9E3779B97F4A7C15) + bits[:, k::rows][:, : keys.shape[1]])
        keys = mix64(keys + np.arange(keys.shape[1], dtype=_U))
    return keys.view(np.int64)


def elements(texts: list[str], width: int = WIDTH) -> list[np.ndarray]:
    """The multiset of each text as a set: a hash for each copy of each shingle."""
    out: list[np.ndarray] = []
    data = [t.encode("utf-8", "surrogatepass") for t in texts]
    for part in blocks([len(t) for t in data], HASHED):
        owner, h, count = _multisets(data[part], width)
        own, each = np.repeat(owner, count), np.repeat(h, count)
        copy = np.arange(len(own)) - np.repeat(np.cumsum(count) - count, count)
        with np.errstate(over="ignore"):
            e = mix64(each + copy.astype(_U) * _U(0x9E3779B97F4A7C15)).view(np.int64)
        out += np.split(e, np.cumsum(np.bincount(own, minlength=part.stop - part.start))[:-1])
    return out


def text_key() -> Column:
    """MD5 of the text, of the empty one if it has no word."""
    return F.unhex(F.md5(F.when(F.col("text").rlike(WORD), F.col("text")).otherwise("")))


def _sketch(docs: DataFrame, m: int, rows: int, width: int) -> DataFrame:
    """(doc_id, id, bands) of every document; id: the key of its text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(k, 500) for b in batches for k in range(0, len(b), 500)):  # bounds the texts that are decoded at once
            texts = ["" if t is None else t for t in batch["text"].to_pylist()]
            for part in blocks([len(t) for t in texts], 1 << 22):
                keys = band_keys(signatures(texts[part], m, width), rows)
                own, ends = batch.slice(part.start, len(keys)), np.arange(len(keys) + 1) * keys.shape[1]
                bands = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(keys.ravel()))
                yield pa.RecordBatch.from_arrays([own["doc_id"], own["id"], bands], ["doc_id", "id", "bands"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_key().alias("id"), "text").mapInArrow(run, "doc_id long, id binary, bands array<long>")


def _elements_of(docs: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """(id, set) of the texts in wanted (id, doc_id), each read from the document named."""

    @F.pandas_udf("array<long>")
    def hashed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(elements(["" if t is None else t for t in texts], width))

    texts = docs.select(F.col("doc_id").cast("long").alias("d"), text_key().alias("k"), "text")
    texts = texts.join(wanted, (F.col("k") == F.col("id")) & F.col("d").eqNullSafe(F.col("doc_id")), "left_semi")
    return texts.select(F.col("k").alias("id"), hashed("text").alias("set")).groupBy("id").agg(F.min_by("set", F.size("set")).alias("set"))


def classes(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """(id, label): the least id that each node of nodes (id) reaches by links (a, b). Labels move along links and then jump to their label's label."""
    spread = materialize(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "dup-links")
    linked = spread.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("least")).select("id", F.least("id", "least").alias("label"))
    labels = materialize(linked, "dup-labels")
    while True:
        near = spread.join(labels.withColumnRenamed("id", "b"), "b").groupBy(F.col("a").alias("id")).agg(F.min("label").alias("seen"))
        told = labels.join(near, "id").select("id", F.least("label", "seen").alias("label"), F.col("label").alias("old"))
        jump = labels.select(F.col("id").alias("label"), F.col("label").alias("further"))
        told = told.join(jump, "label").select("id", F.least("label", "further").alias("label"), "old")
        told = materialize(told, "dup-labels")
        if told.where("label < old").isEmpty():
            return nodes.join(told.select("id", "label"), "id", "left").select("id", F.coalesce("label", "id").alias("label"))
        labels = told.select("id", "label")


def _verified(pairs: DataFrame, sets: DataFrame, likeness: float) -> DataFrame:
    both = pairs.join(sets.select(F.col("id").alias("a"), F.col("set").alias("x")), "a").join(sets.select(F.col("id").alias("b"), F.col("set").alias("y")), "b")
    common = F.size(F.array_intersect("x", "y"))
    return both.where(common >= likeness * (F.size("x") + F.size("y") - common)).select("a", "b")


def _may_link(open_: DataFrame, sets: DataFrame, likeness: float) -> DataFrame:
    """Pairs (a, b) of texts of different classes that may reach likeness, without comparing a bucket's members pairwise.

    Elements are ordered from rare to common. Two sets of sizes m and n need an overlap of likeness / (1 + likeness) * (m + n), so they share
    an element among the first few of both, and the first one that they share, at places i and j, leaves room for as much:
    min(m - i, n - j). Nothing that could reach likeness is lost. An element's commonest class is not compared with itself."""
    rows = open_.join(sets, "id").withColumn("m", F.size("set"))
    spread = rows.select("id", F.explode("set").alias("e"))
    common = spread.groupBy("e").agg(F.count("*").alias("f")).where("f > 1")
    # Elements that one set alone has come first in any order and are only counted.
    found = spread.join(common, "e").groupBy("id").agg(F.array_sort(F.collect_list(F.struct("f", "e"))).alias("es"))
    room = (F.col("m") - F.ceil(likeness * F.col("m") - 1e-9) + 1) - (F.col("m") - F.size("es"))
    heads = rows.select("id", "label", "m").join(found, "id").where(room > 0)
    heads = heads.select("id", "label", "m", (F.col("m") - F.size("es")).alias("alone"), F.posexplode(F.slice("es", F.lit(1), room.cast("int"))).alias("k", "x"))
    heads = materialize(heads.select("id", "label", "m", (F.col("alone") + F.col("k")).alias("p"), F.col("x.e").alias("e")), "dup-heads")
    sizes = heads.groupBy("e", "label").agg(F.count("*").alias("c"))
    main = sizes.groupBy("e").agg(F.max_by("label", F.struct("c", "label")).alias("main"), F.count("*").alias("n")).where("n > 1")
    other = heads.join(main.select("e", "main"), "e").where("label <> main").drop("main")
    x, y = other.alias("x"), heads.alias("y")
    enough = F.least(F.col("x.m") - F.col("x.p"), F.col("y.m") - F.col("y.p")) >= likeness / (1 + likeness) * (F.col("x.m") + F.col("y.m")) - 1e-9
    pairs = x.join(y, (F.col("x.e") == F.col("y.e")) & (F.col("x.label") != F.col("y.label")) & enough)
    return pairs.select(F.least("x.id", "y.id").alias("a"), F.greatest("x.id", "y.id").alias("b")).distinct()


def near_duplicates(docs: DataFrame, likeness: float = LIKENESS, m: int = COMPONENTS, rows: int = ROWS_PER_BAND, width: int = WIDTH) -> DataFrame:
    """(doc_id, class_id, n_links): class_id is the least doc_id of the class, n_links the verified links of the document's text to other texts.

    docs (doc_id, text). Classes are the connected components of texts whose multiset likeness is at least likeness."""
    sketch, known = text_classes(docs, likeness, m, rows, width)
    least = known.groupBy("label").agg(F.min("doc_id").alias("class_id"))
    named = materialize(known.join(least, "label").select("id", "class_id", "n_links"), "dup-named")
    return sketch.select("doc_id", "id").join(named, "id").select("doc_id", "class_id", "n_links")


def text_classes(docs: DataFrame, likeness: float = LIKENESS, m: int = COMPONENTS, rows: int = ROWS_PER_BAND, width: int = WIDTH) -> tuple[DataFrame, DataFrame]:
    """The sketch (doc_id, id, bands) of every document, id being its text_key, and (id, doc_id, label, n_links) of every text: its least doc_id, if any, and the label of its class."""
    sketch = materialize(_sketch(docs, m, rows, width), "dup-sketch")
    texts = materialize(sketch.groupBy("id").agg(F.min("doc_id").alias("doc_id"), F.first("bands").alias("bands")), "dup-texts")
    buckets = texts.where(F.hex("id") != hashlib.md5(b"").hexdigest().upper()).select("id", F.explode("bands").alias("band"))
    shared = buckets.groupBy("band").agg(F.count("*").alias("n")).where("n > 1")
    members = materialize(buckets.join(shared, "band"), "dup-members")
    # A text that shares many buckets with many others is near the middle of its group: as centre it links the most.
    popular = members.groupBy("id").agg(F.sum("n").alias("weight"))
    nodes = popular.select("id")
    sets = materialize(_elements_of(docs, texts.select("id", "doc_id").join(nodes, "id", "left_semi"), width), "dup-sets")
    ranked = members.join(popular, "id")
    centres = ranked.groupBy("band").agg(F.max_by("id", F.struct("weight", "id")).alias("c"))
    stars = members.join(centres, "band").where("id <> c")
    first = stars.select(F.least("id", "c").alias("a"), F.greatest("id", "c").alias("b")).distinct()
    links = materialize(_verified(first, sets, likeness), "dup-links")
    label = materialize(classes(nodes, links), "dup-classes")
    told = members.select("band", "id").join(label, "id")
    mixed = told.groupBy("band").agg(F.min("label").alias("l0"), F.max("label").alias("l1")).where("l0 <> l1").select("band")
    open_ = materialize(told.join(mixed, "band", "left_semi").select("id", "label").distinct(), "dup-open")
    links = materialize(links.unionByName(_verified(_may_link(open_, sets, likeness), sets, likeness)).distinct(), "dup-links")
    degree = links.select(F.explode(F.array("a", "b")).alias("id")).groupBy("id").agg(F.count("*").alias("n_links"))
    known = texts.select("id", "doc_id").join(classes(nodes, links), "id", "left").join(degree, "id", "left")
    return sketch, materialize(known.select("id", "doc_id", F.coalesce("label", "id").alias("label"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links")), "dup-known")
