"""SentencePiece encoding and decoding by a relational lattice.

A text's blanks become the mark U+2581, one more is put before it, and it is cut into words where no piece can reach across.
Words are encoded by relations: the substrings of a word up to the longest piece's length are exploded and joined to the piece table, the
matches are grouped by word, and a fold over them in order of their ends keeps the best path to each place (Viterbi). Of equal
costs the path with the longer last piece wins. A word of over LONG characters has its lattice in windows by the places where edges end; a window takes over
the costs of the last places before it, so time grows with the word's length and not with its square. A character without a piece becomes its UTF-8 bytes' pieces (byte fallback).

Texts are read once. A task packs blocks of texts, of BLOCK characters or PARTS distinct parts: the numbers of each text's parts, the words of each
part, and the distinct words. These blocks are written, bucketed by block; the words that the commonest words of a sample (about SAMPLE documents, at most
HEAD words, encoded beforehand in the same way) do not hold are dealt evenly, encoded, each once, and meet their blocks again, so that neither texts
nor packed texts are shuffled. Which words are common affects the speed alone.

A model whose scores are merge ranks (BPE) has no probabilities; load() gives its pieces the logarithm of a Zipf law over the ranks,
under which nine tenths of words get the pieces that the merges give. Scores are added as whole numbers, at a resolution of 2 ** -19 of the worst.

Defined cases: null and empty texts have no piece and decode to the empty text; U+2581 in a text decodes to a blank, as the
tokenizer's own decoder has it; any other text decodes to itself; repeated rows are encoded alike; a null doc_id is a document like
others; texts and words are encoded whole, however long; an empty table gives no rows; kept columns may have any names but ids and round_trip.
"""

from __future__ import annotations

import hashlib
import math
import re
import uuid
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusmill.llm.common import materialize, shared_dir

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
HEAD, SAMPLE, MARK = 200_000, 10_000, "▁"
#: Characters and distinct parts of the texts that are packed together; both bound the memory of a task.
BLOCK, PARTS = 1 << 25, 600_000
#: Words that a task encodes, and parts that are unpacked at once. Rows of a batch whose texts a task decodes at once.
WORDS, UNPACKED = 50_000, 100_000
#: Characters of a word whose lattice is one window, and of the windows of longer words.
LONG, WINDOW = 512, 1024
#: The last place that an edge may have in a lattice or window.
LAST = (1 << 12) - 1
ROWS = 500


@dataclass(frozen=True)
class Pieces:
    """A piece table: text and score of each normal piece by id, and the ids of the byte pieces."""

    normal: dict[int, tuple[str, float]]
    byte_ids: tuple[int, ...]
    unknown: int

    @cached_property
    def longest(self) -> int:
        return max(len(p) for p, _ in self.normal.values())

    @cached_property
    def unknown_score(self) -> float:
        return min(s for _, s in self.normal.values()) - 10.0

    @cached_property
    def words(self) -> re.Pattern[str]:
        """Cuts a marked text where no piece has both neighbours: before marks, and between letters and others if no piece mixes them."""
        texts = [p.lstrip(MARK) for p, _ in self.normal.values()]
        if any(MARK in t for t in texts):
            return re.compile(r"(?s).+")
        odd = "".join(sorted({c for t in texts for c in t if re.match(r"[^\W\d_]", c) and not c.isalpha()}))
        letter = re.compile(rf"[^\W\d_{re.escape(odd)}]")
        mixed = any(bool(letter.match(a)) != bool(letter.match(b)) for t in texts for a, b in zip(t, t[1:]))
        line = "" if any("\n" in t for t in texts) else "\n"
        if mixed:
            return re.compile(rf"{MARK}*[^{MARK}{line}]+|{MARK}+|\n")
        return re.compile(rf"{MARK}*{letter.pattern}+|{MARK}*(?:[^\w{MARK}{line}]|[\d_{re.escape(odd)}])+|{MARK}+|\n")

    @cached_property
    def scale(self) -> float:
        """Costs are scores times this, as whole numbers below 2 ** 19."""
        if self.longest > 63 or max(self.normal) >= (1 << 18) - 1 or max(s for _, s in self.normal.values()) > 0:
            raise ValueError("pieces of at most 63 characters, of ids below 2 ** 18 and with scores of at most 0 are needed")
        return 2.0 ** math.floor(math.log2(((1 << 19) - 1) / -self.unknown_score))

    def cost(self, score: float) -> int:
        return round(-score * self.scale)

    def cut(self, text: str | None) -> list[str]:
        return self.words.findall(MARK + text.replace(" ", MARK)) if text else []

    def parts(self, text: str | None) -> list[str] | list[bytes]:
        """The parts of a text between single blanks, each of which cut() cuts for itself; if there are other blanks or marks, its words as bytes."""
        parts = text.split(" ") if text else []
        return [w.encode() for w in self.cut(text)] if "" in parts or (text and MARK in text) else parts

    def words_of(self, part: str | bytes) -> list[str]:
        if isinstance(part, bytes):
            return [part.decode()]
        return [MARK + part] if part.isalpha() else self.cut(part)

    def spelled(self, word: str, ids: list[int]) -> list[int]:
        """ids of a word, the unknown (-1) as byte pieces."""
        out, at = [], 0
        for i in ids:
            out += [i] if i >= 0 else [self.byte_ids[b] for b in word[at].encode("utf-8", "surrogatepass")] if self.byte_ids else [self.unknown]
            at += len(self.normal[i][0]) if i >= 0 else 1
        return out

    def decode(self, ids: np.ndarray) -> str:
        data, _ = gather(*self.piece_bytes, np.asarray(ids, np.int64))
        return data.tobytes().decode("utf-8", "replace")[1:]

    @cached_property
    def piece_bytes(self) -> tuple[np.ndarray, np.ndarray]:
        """The bytes of all pieces by id, one after the other, and the number of bytes of each."""
        table = {i: p.replace(MARK, " ").encode() for i, (p, _) in self.normal.items()} | {i: bytes([b]) for b, i in enumerate(self.byte_ids)} | {self.unknown: " ⁇ ".encode()}
        each = [table.get(i, b"") for i in range(max(table) + 1)]
        return np.frombuffer(b"".join(each), np.uint8), np.array([len(x) for x in each])


def gather(flat: np.ndarray, sizes: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The runs of flat, which have sizes, that are numbered in which, one after the other, and their sizes."""
    taken = sizes[which]
    shift = (np.cumsum(sizes) - sizes)[which] - (np.cumsum(taken) - taken)
    return flat[np.repeat(shift, taken) + np.arange(taken.sum())], taken


def runs(sizes: np.ndarray, of: np.ndarray) -> np.ndarray:
    """Sums of sizes over runs of them; of: the length of each run."""
    return np.diff(np.concatenate(([0], np.cumsum(sizes)))[np.concatenate(([0], np.cumsum(of)))])


def load(path: str = MODEL) -> Pieces:
    """Reads a piece table from a model file."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    every = range(sp.get_piece_size())
    other = {i for i in every if sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i)}
    scores = {i: sp.get_score(i) for i in every if i not in other}
    if all(s == int(s) for s in scores.values()):  # merge ranks
        scores = {i: -math.log(100 + min(-s, len(scores))) for i, s in scores.items()}
    return Pieces({i: (sp.id_to_piece(i), s) for i, s in scores.items()}, tuple(i for i in every if sp.is_byte(i)), sp.unk_id())


def piece_table(spark: SparkSession, model: Pieces) -> DataFrame:
    """(piece, id, cost) of the normal pieces, written once; its size is that of the model file."""
    rows = pd.DataFrame([(p, i, model.cost(s)) for i, (p, s) in model.normal.items()], columns=["piece", "id", "cost"])
    return materialize(spark.createDataFrame(rows, "piece string, id int, cost long"), "pieces-table")


def _long(value: int) -> Column:
    return F.lit(value).cast("long")


def _edge(e: Column, k: Column, cost: Column, id_: Column) -> Column:
    """LAST - end, cost, start and id + 1 of an edge as one number: 12, 19, 12 and 18 bits. In descending order ends rise, and dear edges, mostly the longer ones, come first at each."""
    return F.shiftleft((LAST - e).cast("long"), 49) + F.shiftleft(cost, 30) + F.shiftleft((e - k).cast("long"), 18) + (id_ + 1).cast("long")


def _in_order(edges: Column) -> Column:
    return F.sort_array(edges, asc=False)


def _start(x: Column) -> Column:
    """Where the last edge of a place, or an edge, starts."""
    return F.shiftright(x, 18).bitwiseAND(_long(LAST)).cast("int")


def best_path(edges: Column) -> Column:
    """Ids of the cheapest path over edges in order, which have one into every place; -1 for a character without a piece.

    The fold's state has a number for each place: the cost of the best path to it, and start and id + 1 of its last edge. The least of them is the best: of equal costs the longer edge."""

    def back(best: Column) -> Column:
        def one(path: Column, _: Column) -> Column:
            last = F.get(best, path.at)
            ids = F.array_append(path.ids, last.bitwiseAND(_long(0x3FFFF)).cast("int") - 1)
            return F.when(path.at > 0, F.struct(_start(last).alias("at"), ids.alias("ids"))).otherwise(path)

        start = F.struct((F.size(best) - 1).alias("at"), F.array().cast("array<int>").alias("ids"))
        return F.reverse(F.aggregate(best, start, one, lambda path: path.ids))

    return F.aggregate(edges, F.array(_long(0)), _step, back)


def _step(best: Column, x: Column) -> Column:
    """The best paths to all places, of which the last may be new, after one more edge."""
    new = F.get(best, _start(x)).bitwiseAND(_long(-1 << 30)) + x.bitwiseAND(_long((1 << 49) - 1))
    further = F.size(best) + F.shiftright(x, 49).cast("int") == LAST
    return F.when(further, F.array_append(best, new)).when(F.element_at(best, -1) <= new, best).otherwise(F.array_append(F.slice(best, F.lit(1), F.size(best) - 1), new))


def _named(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value), with value worked out once."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def best_path_of_windows(windows: Column, longest: int) -> Column:
    """Ids of the cheapest path over windows, an array of edges in order for each WINDOW places in order. In a window the first places are the last `longest` (or all) before it.

    State and results stay as short as a window, so no step copies the whole word."""

    def across(state: Column, edges: Column) -> Column:
        def carried(best: Column, tail: Column, low: Column) -> Column:
            # Of the window's own places 63 - length and id + 1 of their last edges are kept.
            back = lambda x, k: F.shiftleft((63 - F.size(state.carry) - k + _start(x)).cast("long"), 18) + x.bitwiseAND(_long(0x3FFFF))
            own = F.transform(F.slice(best, F.size(state.carry) + 1, F.size(best)), back)
            return F.struct(F.transform(tail, lambda x: x - low).alias("carry"), F.array_append(state.places, own).alias("places"))

        last = lambda best: F.slice(best, F.greatest(F.size(best) - longest, F.lit(1)), F.lit(longest + 1))
        low = lambda tail: F.shiftleft(F.shiftright(F.array_min(tail), 30), 30)
        return _named(F.aggregate(edges, state.carry, _step), lambda best: _named(last(best), lambda tail: _named(low(tail), lambda least: carried(best, tail, least))))

    def inside(path: Column, places: Column) -> Column:
        def one(path: Column, _: Column) -> Column:
            last = F.get(places, path.at - 1)
            ids = F.array_append(path.ids, last.bitwiseAND(_long(0x3FFFF)).cast("int") - 1)
            return F.when(path.at > 0, F.struct((path.at - 63 + F.shiftright(last, 18).cast("int")).alias("at"), ids.alias("ids"))).otherwise(path)

        # The path comes from at places beyond the window's last one; before the first window it has ended.
        start = F.struct((path.at + F.size(places)).alias("at"), F.array().cast("array<int>").alias("ids"))
        walked = F.aggregate(places, start, one)
        return F.aggregate(F.array(walked), path, lambda path, w: F.struct(w.at.alias("at"), F.array_append(path.ids, F.reverse(w.ids)).alias("ids")))

    start = F.struct(F.array(_long(0)).alias("carry"), F.array().cast("array<array<bigint>>").alias("places"))
    places = F.aggregate(windows, start, across, lambda state: F.reverse(state.places))
    begin = F.struct(F.lit(0).alias("at"), F.array().cast("array<array<int>>").alias("ids"))
    return F.aggregate(places, begin, inside, lambda path: F.flatten(F.reverse(path.ids)))


def encode_long_words(words: DataFrame, table: DataFrame, model: Pieces, *key: str) -> DataFrame:
    """As encode_words(), for words of any length: a lattice by windows."""
    most = F.length("word")
    cut = words.select(*key, "word", F.explode(F.sequence(F.lit(0), F.floor((most - 1) / WINDOW).cast("int"))).alias("w"))
    carry = F.least(F.col("w") * WINDOW, F.lit(model.longest))
    cut = cut.select(*key, "w", carry.alias("carry"), F.substr("word", F.col("w") * WINDOW - carry + 1, carry + WINDOW).alias("part"))
    # By number, as the windows are few bytes but many substrings.
    dealt = cut.repartition(int(words.sparkSession.conf.get("spark.sql.shuffle.partitions")), *key, "w")
    ends = dealt.select(*key, "w", "part", F.explode(F.sequence(F.col("carry") + 1, F.length("part"))).alias("e"))
    spread = ends.select(*key, "w", "part", "e", F.explode(F.sequence(F.lit(1), F.least(F.lit(model.longest), F.col("e")))).alias("k"))
    spread = spread.select(*key, "w", "e", "k", F.substr("part", F.col("e") - F.col("k") + 1, F.col("k")).alias("piece"))
    found = _edges(spread, table, model, *key, "w").groupBy(*key, "w").agg(_in_order(F.collect_list("edge")).alias("edges"))
    whole = found.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("w", "edges"))).alias("windows"))
    return whole.select(*key, best_path_of_windows(F.transform("windows", lambda x: x.edges), model.longest).alias("ids"))


def _edges(spread: DataFrame, table: DataFrame, model: Pieces, *key: str) -> DataFrame:
    """(key columns, edge) of the substrings (key columns, e, k, piece) that are pieces or single characters."""
    met = spread.join(F.broadcast(table), "piece", "left").where(F.col("id").isNotNull() | (F.col("k") == 1))
    edge = _edge(F.col("e"), F.col("k"), F.coalesce("cost", _long(model.cost(model.unknown_score))), F.coalesce("id", F.lit(-1)))
    return met.select(*key, edge.alias("edge"))


def encode_words(words: DataFrame, table: DataFrame, model: Pieces, *key: str) -> DataFrame:
    """words (word, and key columns that tell words apart) as (key columns, ids); a character without a piece has the id -1. Rows that are dealt by key stay where they are. For words of at most LONG characters."""
    starts = words.select(*key, "word", F.explode(F.sequence(F.lit(0), F.length("word") - 1)).alias("s"))
    # Two explodes, first of starts and then of lengths, stay in generated code.
    spread = starts.select(*key, "word", "s", F.explode(F.sequence(F.lit(1), F.least(F.lit(model.longest), F.length("word") - F.col("s")))).alias("k"))
    spread = spread.select(*key, (F.col("s") + F.col("k")).alias("e"), "k", F.substr("word", F.col("s") + 1, F.col("k")).alias("piece"))
    return _edges(spread, table, model, *key).groupBy(*key).agg(F.collect_list("edge").alias("edges")).select(*key, best_path(_in_order(F.col("edges"))).alias("ids"))


def _common_words(docs: DataFrame, table: DataFrame, model: Pieces, head: int, sample: int) -> DataFrame:
    """(word, ids) of the commonest words of about sample documents, at most head of them."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[str] = Counter()
        for batch in (b.slice(k, ROWS) for b in batches for k in range(0, len(b), ROWS)):
            for text in batch["text"].to_pylist():
                seen.update(model.cut(text))
            if len(seen) > PARTS:
                yield pa.record_batch([pa.array(seen.keys(), pa.string()), pa.array(seen.values(), pa.int64())], ["word", "n"])
                seen.clear()
        yield pa.record_batch([pa.array(seen.keys(), pa.string()), pa.array(seen.values(), pa.int64())], ["word", "n"])

    few = docs.select("text").sample(min(1.0, sample / max(1, docs.count())), 7)
    counted = materialize(few.mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")), "pieces-counts")
    level = F.floor(F.log2("n")).cast("int")
    total, cut = 0, 64
    for k, n in sorted(counted.groupBy(level.alias("k")).count().collect(), reverse=True):  # at most 64 rows
        total += n
        if total > head:
            break
        cut = k
    return encode_words(counted.where((level >= cut) & (F.length("word") <= LONG)).select("word").repartition(max(8, head // 20_000), "word"), table, model, "word")


class _Numbers(dict):
    """Numbers for keys, in order of their first use."""

    def __missing__(self, key: str | bytes) -> int:
        self[key] = n = len(self)
        return n


def _packed(arrays: dict[str, np.ndarray]) -> bytes:
    batch = pa.record_batch([pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), pa.array(x)) for x in arrays.values()], list(arrays))
    out = pa.BufferOutputStream()
    with pa.ipc.new_stream(out, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as stream:
        stream.write_batch(batch)
    return out.getvalue().to_pybytes()


def _unpacked(data: bytes) -> dict[str, np.ndarray]:
    batch = pa.ipc.open_stream(data).read_next_batch()
    return {name: batch[name].flatten().to_numpy(zero_copy_only=False) for name in batch.schema.names}


def _spelled(words: pa.Array, ids: pa.Array, model: Pieces) -> tuple[np.ndarray, np.ndarray]:
    """The ids of words, one after the other, and the number of ids of each, with byte pieces for characters without a piece."""
    sizes = pc.list_value_length(ids).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = ids.flatten().to_numpy(zero_copy_only=False).astype(np.int32)
    ends = np.cumsum(sizes)
    odd = np.unique(np.searchsorted(ends, np.flatnonzero(flat < 0), "right"))
    out, done = [], 0
    for k in odd:
        own = model.spelled(words[int(k)].as_py(), flat[ends[k] - sizes[k] : ends[k]].tolist())
        out += [flat[done : ends[k] - sizes[k]], np.array(own, np.int32)]
        done, sizes[k] = ends[k], len(own)
    return np.concatenate([*out, flat[done:]]), sizes


def _first_uses(numbers: np.ndarray) -> np.ndarray:
    """Whether a number of 0 or more is larger than all before it."""
    return numbers > np.maximum.accumulate(np.concatenate(([-1], numbers)))[:-1]


def _planes(name: str, numbers: np.ndarray) -> dict[str, np.ndarray]:
    """The first, second and third bytes of numbers below 2 ** 24, which are packed better apart."""
    return {f"{name}{k}": (numbers >> (8 * k)).astype(np.uint8) for k in range(3)}


def _numbers(name: str, planes: dict[str, np.ndarray]) -> np.ndarray:
    out = planes[f"{name}0"].astype(np.int32)
    for k in (1, 2):
        out |= planes[f"{name}{k}"].astype(np.int32) << (8 * k)
    return out


def _pack(parts: _Numbers, codes: list[np.ndarray], known: dict[str, int], known_ids: np.ndarray, known_sizes: np.ndarray, model: Pieces) -> tuple[bytes, list[str]]:
    """The packed parts of a block's texts, numbered by frequency, with what is known of their words; and the words that are not known."""
    numbers = np.concatenate([np.zeros(0, np.uint32), *codes])
    order = np.argsort(-np.bincount(numbers, minlength=len(parts)), kind="stable")
    rank = np.empty(len(parts), np.uint32)
    rank[order] = np.arange(len(parts))
    numbers, keys = rank[numbers], list(parts)
    rare, met = _Numbers(), _Numbers()
    flat, sizes = [], np.zeros(len(keys), np.int32)
    for k, at in enumerate(order):
        words = model.words_of(keys[at])
        sizes[k] = len(words)
        flat += [~met[known[w]] if w in known else rare[w] for w in words]
    flat = np.array(flat, np.int64)
    # Words are numbered by first use, so 0 and 1 stand for the next rare and the next known word; others are referred to.
    own = np.where(flat < 0, len(rare) + ~flat, flat)
    flat = np.where(_first_uses(flat), 0, np.where(_first_uses(~flat), 1, own + 2))
    own_ids, own_sizes = gather(known_ids, known_sizes, np.fromiter(met, np.int64, len(met)))
    return _packed(_planes("part", numbers) | _planes("word", flat) | {"sizes": sizes, "known_ids": own_ids.astype(np.int32), "known_sizes": own_sizes.astype(np.int32)}), list(rare)


def encode(docs: DataFrame, model: Pieces, head: int = HEAD, sample: int = SAMPLE, keep: tuple[str, ...] = (), check: bool = False) -> DataFrame:
    """docs (doc_id, text, and the columns named in keep) with ids, the pieces of the text, and if check is set, round_trip: whether they decode to it."""
    spark: SparkSession = docs.sparkSession
    table = piece_table(spark, model)
    common = _common_words(docs, table, model, head, sample).toArrow()  # at most head rows, some MB
    ids, sizes = _spelled(common["word"].combine_chunks(), common["ids"].combine_chunks(), model)
    at_hand = spark.sparkContext.broadcast((_packed({"words": common["word"].combine_chunks(), "ids": ids, "sizes": sizes})))
    # Columns travel under names of their own, so that no name clashes.
    kept = {f"c{k}": name for k, name in enumerate(["doc_id", *keep])}
    kinds = {c: docs.schema[name].dataType for c, name in kept.items()}
    block_type = T.StructType([T.StructField(c, t) for c, t in kinds.items()] + [T.StructField("block", T.LongType()), T.StructField("at", T.IntegerType()), T.StructField("n_parts", T.IntegerType()), T.StructField("digest", T.BinaryType()), T.StructField("packed", T.BinaryType()), T.StructField("rare", T.ArrayType(T.StringType())), T.StructField("n_long", T.IntegerType())])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common = _unpacked(at_hand.value)
        known = {w: k for k, w in enumerate(common["words"])}
        block = TaskContext.get().partitionId() << 32
        parts, codes, digests, rows, chars = _Numbers(), [], [], [], 0

        def close() -> pa.RecordBatch:
            packed, rare = _pack(parts, codes, known, common["ids"], common["sizes"], model)
            n = len(codes)
            table = pa.Table.from_batches(rows).combine_chunks()
            more = [pa.array([block] * n, pa.int64()), pa.array(range(n), pa.int32()), pa.array(map(len, codes), pa.int32()), pa.array(digests, pa.binary()), pa.array([packed] + [None] * (n - 1), pa.binary()), pa.array([rare] + [None] * (n - 1), pa.list_(pa.string())), pa.array([sum(len(w) > LONG for w in rare)] + [0] * (n - 1), pa.int32())]
            return pa.RecordBatch.from_arrays([*(table[c].chunk(0) for c in kept), *more], names=block_type.names)

        for batch in batches:
            start = 0
            only = batch.select(list(kept))
            texts = (text for k in range(0, len(batch), ROWS) for text in batch["text"].slice(k, ROWS).to_pylist())
            for k, text in enumerate(texts):
                own = model.parts(text)
                codes.append(np.fromiter(map(parts.__getitem__, own), np.uint32, len(own)))
                digests.append(hashlib.md5((text or "").encode()).digest() if check else None)
                chars += len(text or "")
                if chars > BLOCK or len(parts) > PARTS:
                    rows.append(only.slice(start, k + 1 - start))
                    yield close()
                    start, block, chars = k + 1, block + 1, 0
                    parts, codes, digests, rows = _Numbers(), [], [], []
            if start < len(batch):
                rows.append(only.slice(start))
        if codes:
            yield close()

    packed = docs.select(*[F.col(name).alias(c) for c, name in kept.items()], "text").mapInArrow(pack, block_type)
    name = _bucketed(packed, "pieces_blocks", "block")
    at_hand.destroy()
    rare = spark.table(name).where("rare is not null").select(F.col("block").alias("of"), F.posexplode("rare").alias("no", "word"))
    n_rare, n_long = spark.table(name).agg(F.coalesce(F.sum(F.size("rare")), F.lit(0)), F.coalesce(F.sum("n_long"), F.lit(0))).first()
    # Each word is encoded once, in however many blocks it is. The least block and number are not used: with them both readers of dealt have its columns and share its shuffle.
    dealt = (rare.where(F.length("word") <= LONG) if n_long else rare).repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1 + n_rare // WORDS), "word")
    words = dealt.groupBy("word").agg(F.min("of").alias("of"), F.min("no").alias("no")).where("of >= 0 and no >= 0")
    coded = dealt.join(encode_words(words, table, model, "word").hint("shuffle_hash"), "word").select("of", "no", "ids")
    if n_long:
        coded = coded.unionByName(encode_long_words(rare.where(F.length("word") > LONG), table, model, "of", "no"))
    if max(model.normal) < 1 << 15:  # half as much to shuffle
        coded = coded.withColumn("ids", F.col("ids").cast("array<smallint>"))
    names = [*kept, "ids", *["round_trip"] * check]
    result = T.StructType([*(T.StructField(c, t) for c, t in kinds.items()), T.StructField("ids", T.ArrayType(T.IntegerType())), *[T.StructField("round_trip", T.BooleanType())] * check])

    def spell(texts: pa.Table, words: pa.Table) -> pa.Table:
        texts, words = texts.sort_by("at"), words.sort_by("no")
        packed, rare = (texts[c].drop_null()[0] for c in ("packed", "rare"))
        packed = _unpacked(packed.as_py())
        ids = words["ids"].combine_chunks() if len(words) else pa.array([], pa.list_(pa.int16()))
        ids, sizes = _spelled(rare.values, ids, model)
        # From words to parts, and from parts to texts.
        numbers, n_rare = _numbers("word", packed), len(sizes)
        which = np.where(numbers == 0, np.cumsum(numbers == 0) - 1, np.where(numbers == 1, n_rare - 1 + np.cumsum(numbers == 1), numbers - 2))
        ids, sizes = np.concatenate((ids, packed["known_ids"])), np.concatenate((sizes, packed["known_sizes"]))
        ids, sizes = gather(ids, sizes, which)[0], runs(sizes[which], packed["sizes"])
        codes = _numbers("part", packed)
        n_parts = texts["n_parts"].to_numpy().astype(np.int64)
        ends, out, start = np.cumsum(n_parts), [], 0
        while start < len(texts):
            first = ends[start] - n_parts[start]
            stop = max(start + 1, int(np.searchsorted(ends, first + UNPACKED, "right")))
            own, of_part = gather(ids, sizes, codes[first : ends[stop - 1]])
            of_text = runs(of_part, n_parts[start:stop])
            rows = texts.slice(start, stop - start)
            more = [pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(of_text))), pa.int32()), pa.array(own, pa.int32()))]
            if check:
                data, of_id = gather(*model.piece_bytes, own)
                cuts = np.concatenate(([0], np.cumsum(runs(of_id, of_text))))
                more.append(pa.array([hashlib.md5(data[a + 1 : b].tobytes()).digest() == d for a, b, d in zip(cuts, cuts[1:], rows["digest"].to_pylist(), strict=False)], pa.bool_()))
            out.append(pa.table([*(rows[c].combine_chunks() for c in kept), *more], names=names))
            start = stop
        return pa.concat_tables(out)

    rows = spark.table(name).groupBy("block").cogroup(coded.groupBy("of")).applyInArrow(spell, result)
    spark.sql(f"DROP TABLE {name}")  # an external table: its files stay, and rows reads them
    return rows.select(*[F.col(c).alias(name) for c, name in kept.items()], *names[len(kept) :])


def _bucketed(df: DataFrame, name: str, key: str) -> str:
    """Writes df in the shared folder, bucketed by key: its rows need not be shuffled to meet others of the key. The table's name."""
    spark = df.sparkSession
    name = f"{name}_{uuid.uuid4().hex}"
    df.write.bucketBy(int(spark.conf.get("spark.sql.shuffle.partitions")), key).option("path", f"{shared_dir(spark)}/{name}").option("compression", "zstd").saveAsTable(name)
    return name


def decode(ids: Column, model: Pieces) -> Column:
    """The text of an array of piece ids."""

    @F.pandas_udf("string")
    def spell(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for rows in batches:
            yield pd.Series([None if i is None else model.decode(np.asarray(i)) for i in rows])

    return spell(ids)
