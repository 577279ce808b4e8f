"""Cross-tokenizer alignment: which tokens of a byte-level BPE (A) and of a piece model (B) cover the same bytes.

Both tokenizers' cumulative ends are keys of dictionaries from end to index; the keys that both have, sorted, cut the two id lists into
groups, and the links are all pairs of tokens within a group. Tokens never cover a blank and what is before it, so a text whose parts between single blanks
have no other white space at their ends is aligned part by part, and a part that occurs again is looked up; any other text is aligned whole.

A task packs blocks of texts: the distinct id pairs of a block with their number of documents, and the pairs of each document by number. Counts over
the corpus are sums over blocks; they go back to each block, not to each document, so a pair that most documents hold is no hot key.

Defined cases: null and empty texts have no token, nor have texts whose tokens do not spell them (such as those that hold U+2581); special tokens' strings inside
texts are plain text; repeated rows count as documents each; a null doc_id is a document like others; whole texts are aligned, however
long; an empty table gives no rows; other columns are not read but those named in keep, which may have any names but those of the result.
"""

from __future__ import annotations

import functools
import hashlib
import json
import re
from array import array
from collections.abc import Callable, Iterable, Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusmill.llm.common import materialize

BYTE_BPE, PIECES = "/opt/tokenizers/byte_bpe_50k.json", "/opt/tokenizers/piece_bpe_32k.model"
#: Characters and documents of a block, parts that a task remembers, links that are expanded at once.
BLOCK, ROWS, PARTS, LINKS = 1 << 22, 10_000, 900_000, 1 << 20
#: Characters of a part that is remembered.
LONGEST = 1000
#: Characters of a text up to which the faster encoder of A is used.
FAST = 50_000
#: Marks at the end of a part that are aligned apart from the word before them.
TAILS = ".,;:!?)\""
# Fixed value: the pattern by which byte-level tokenizers cut texts.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Bits of an id of B in a pair.
SHIFT = 32
_NUMBERS = ("n_a", "n_b", "n_groups", "n_links")


def byte_letters() -> dict[str, int]:
    """The byte that each letter of a byte-level vocabulary stands for: printable Latin-1 bytes stand for themselves, the others follow from U+0100 on."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(rest)}


def _ranked(table: dict) -> Callable[[str], list[int]] | None:
    """A faster encoder of the same vocabulary, where ids are in the order of merges and texts are cut by the pattern of byte-level tokenizers; else None."""
    model, cut, letters = table["model"], table.get("pre_tokenizer") or {}, byte_letters()
    special = {t["id"] for t in table.get("added_tokens", ())}
    merges = [m.replace(" ", "") if isinstance(m, str) else "".join(m) for m in model["merges"]]
    vocab = {t: i for t, i in model["vocab"].items() if i not in special}
    plain = cut.get("type") == "ByteLevel" and not cut.get("add_prefix_space") and cut.get("use_regex", True) and not table.get("normalizer") and not model.get("ignore_merges")
    if not plain or [vocab.get(t) for t in merges] != list(range(256, 256 + len(merges))) or len(vocab) != 256 + len(merges):
        return None
    import tiktoken

    ranks = {bytes(letters[c] for c in t): i for t, i in vocab.items()}
    return tiktoken.Encoding("byte-level", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary


@functools.lru_cache(maxsize=1)
def _known(byte_bpe: str, pieces: bytes) -> _Parts:
    """What a worker knows, which outlives its tasks."""
    return _Parts(Aligner(byte_bpe, pieces))


class Aligner:
    """Both tokenizers, made from the contents of their files, and what is known of parts."""

    def __init__(self, byte_bpe: str, pieces: bytes) -> None:
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_str(byte_bpe)
        self.a.encode_special_tokens = True
        self.fast = _ranked(json.loads(byte_bpe))
        self.b = sentencepiece.SentencePieceProcessor(model_proto=pieces)
        letters = byte_letters()
        table = {i: bytes(letters[c] for c in t) if all(c in letters for c in t) else t.encode() for t, i in json.loads(byte_bpe)["model"]["vocab"].items()}
        self.bytes_a = [table.get(i, b"") for i in range(max(table) + 1)]
        special = {i for i in range(self.b.get_piece_size()) if self.b.is_control(i) or self.b.is_unknown(i)}
        spelled = lambda i: bytes([int(self.b.id_to_piece(i)[3:-1], 16)]) if self.b.is_byte(i) else self.b.id_to_piece(i).replace("▁", " ").encode()
        self.bytes_b = [b"" if i in special else spelled(i) for i in range(self.b.get_piece_size())]
        self.size_a, self.size_b = (list(map(len, table)) for table in (self.bytes_a, self.bytes_b))
        # Whether no piece has both letters and marks that end words, so that B cuts between them, as A does.
        self.cuts = not any(any(c in TAILS for c in t) and any(c.isalpha() for c in t) for t in (b.decode("utf-8", "replace") for b in self.bytes_b))

    def tokens(self, texts: list[str]) -> Iterator[tuple[list[int], list[int]] | None]:
        """Ids of each text by A and B, which spell a blank and the text; None if they do not."""
        spelled_a, spelled_b = self.bytes_a.__getitem__, self.bytes_b.__getitem__
        fast = self.fast if max(map(len, texts), default=0) <= FAST else None
        coded = (fast(" " + t) for t in texts) if fast else (x.ids for x in self.a.encode_batch_fast([" " + t for t in texts], add_special_tokens=False))
        for text, a, b in zip(texts, coded, self.b.encode(texts, num_threads=1), strict=True):
            want = b" " + text.encode("utf-8", "surrogatepass")
            yield (a, b) if b"".join(map(spelled_a, a)) == want == b"".join(map(spelled_b, b)) else None

    def groups(self, a: list[int], b: list[int]) -> list[tuple[list[int], list[int]]]:
        """The id lists cut where tokens of both end."""
        index_a = dict(zip(accumulate(map(self.size_a.__getitem__, a)), range(1, len(a) + 1)))  # noqa: B905
        index_b = dict(zip(accumulate(map(self.size_b.__getitem__, b)), range(1, len(b) + 1)))  # noqa: B905
        out, at, bt = [], 0, 0
        for end, m in index_b.items():  # in order, so the common ends are sorted
            if end in index_a:
                k = index_a[end]
                out.append((a[at:k], b[bt:m]))
                at, bt = k, m
        return out


class _Names(dict):
    """Ids as text."""

    def __missing__(self, key: int) -> str:
        self[key] = out = str(key)
        return out


_NAMES = _Names()


def written(groups: list[tuple[list[int], list[int]]]) -> str:
    return ";".join([f"{_NAMES[a[0]] if len(a) == 1 else ','.join(map(str, a))}|{_NAMES[b[0]] if len(b) == 1 else ','.join(map(str, b))}" for a, b in groups])


def links(groups: list[tuple[list[int], list[int]]]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (A id << SHIFT | B id) of the links and their number, in runs of about LINKS; pairs may come again in another run."""
    held, n = [], 0
    for a, b in groups:
        if len(a) * len(b) > LINKS:  # such a group has few ids for its size: their numbers are multiplied
            (x, nx), (y, ny) = (np.unique(np.array(ids, np.int64), return_counts=True) for ids in (a, b))
            for i, times in zip(x.tolist(), nx.tolist(), strict=True):
                yield i << SHIFT | y, times * ny
        else:
            held += [i << SHIFT | j for i in a for j in b]
            n += len(a) * len(b)
            if n > LINKS:
                yield np.unique(np.array(held, np.int64), return_counts=True)
                held, n = [], 0
    if held:
        yield np.unique(np.array(held, np.int64), return_counts=True)


def summed(runs: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys of runs (keys, numbers) and the sums of their numbers."""
    if len(runs) == 1:
        return runs[0]
    keys, which = np.unique(np.concatenate([np.zeros(0, np.int64), *(k for k, _ in runs)]), return_inverse=True)
    totals = np.zeros(len(keys), np.int64)
    np.add.at(totals, which, np.concatenate([np.zeros(0, np.int64), *(n for _, n in runs)]))
    return keys, totals


class _Parts:
    """What is known of parts, by number: ids and groups counted, the groups written (None: no tokens), and the pairs of their links, one after the other."""

    def __init__(self, aligner: Aligner) -> None:
        self.aligner = aligner
        self.clear()

    def clear(self) -> None:
        self.number: dict[str, int] = {}
        self.text: list[str | None] = []
        self.counts, self.pairs, self.starts = array("q"), array("q"), array("q")  # four numbers a part; pairs, and where a part's begin
        self.tails: dict[str, tuple[str, tuple[int, ...], list[int]] | None] = {}

    def _put(self, part: str, text: str | None, counts: Iterable[int], pairs: Iterable[int]) -> None:
        self.number[part] = len(self.text)
        self.text.append(text)
        self.counts.extend(counts)
        self.starts.append(len(self.pairs))
        self.pairs.extend(pairs)

    def _groups(self, ids: tuple[list[int], list[int]]) -> tuple[str, tuple[int, ...], list[int]]:
        groups = [ids] if len(ids[0]) == 1 or len(ids[1]) == 1 else self.aligner.groups(*ids)
        pairs = [i << SHIFT | j for x, y in groups for i in x for j in y]
        return written(groups), (len(ids[0]), len(ids[1]), len(groups), len(pairs)), pairs

    def _tail(self, tail: str) -> tuple[str, tuple[int, ...], list[int]] | None:
        """What marks after a word add, told by a word of one letter before them."""
        if tail not in self.tails:
            alone, both = self.aligner.tokens(["a", "a" + tail])
            fits = alone and both and all(len(x) == 1 and y[: len(x)] == x for x, y in zip(alone, both, strict=True))
            self.tails[tail] = self._groups((both[0][1:], both[1][1:])) if fits else None
        return self.tails[tail]

    def learn(self, parts: list[str]) -> None:
        """Parts that are a word and marks are put together of both."""
        joined = [(p, word) for p in parts if self.aligner.cuts and (word := p.rstrip(TAILS)) != p and word.isalpha() and self._tail(p[len(word) :])]
        whole = set(parts).difference(p for p, _ in joined).union(w for _, w in joined if w not in self.number)
        whole = list(whole)
        for part, ids in zip(whole, self.aligner.tokens(whole), strict=True):
            self._put(part, *(self._groups(ids) if ids else (None, (0, 0, 0, 0), ())))
        for part, word in joined:
            k, (text, counts, pairs) = self.number[word], self.tails[part[len(word) :]]
            if self.text[k] is None:
                self._put(part, None, (0, 0, 0, 0), ())
                continue
            own = self.counts[4 * k : 4 * k + 4]
            first = self.starts[k]
            self._put(part, f"{self.text[k]};{text}", (a + b for a, b in zip(own, counts, strict=True)), self.pairs[first : first + own[3]] + array("q", pairs))


#: White space at an end of a part.
_LOOSE = re.compile(r"\A\s| \s|\s |\s\Z")


def _conforms(text: str) -> list[str] | None:
    """The parts of a text between single blanks if each stands for itself, else None."""
    if _LOOSE.search(text):
        return None
    parts = text.split(" ")
    return parts if max(map(len, parts)) <= LONGEST else None


def align(texts: list[str | None], known: _Parts) -> Iterator[tuple[tuple[int, ...], str | None, np.ndarray, np.ndarray]]:
    """Counts, groups_sha256 (None without tokens), pairs and their numbers of each text."""
    cut = [_conforms(t) if t else None for t in texts]
    if len(known.text) > PARTS:
        known.clear()
    number = known.number
    known.learn([p for p in set().union(*filter(None, cut)) if p not in number])  # a set less the keys would walk through all that is known
    # Views, which are gone when more is learned.
    counts, flat, begins = (np.frombuffer(x, np.int64) if len(x) else np.zeros(0, np.int64) for x in (known.counts, known.pairs, known.starts))
    counts = counts.reshape(-1, 4)
    for text, parts in zip(texts, cut, strict=True):
        numbers = list(map(number.__getitem__, parts or ()))
        told = list(map(known.text.__getitem__, numbers))
        if parts and None not in told:
            at = np.array(numbers, np.int64)
            own, first = counts[at], begins[at]
            n = own[:, 3]
            ends = np.cumsum(n)
            pairs = flat[np.repeat(first - ends + n, n) + np.arange(ends[-1])]
            yield tuple(own.sum(axis=0).tolist()), hashlib.sha256(";".join(told).encode()).hexdigest(), *np.unique(pairs, return_counts=True)
            continue
        ids = next(known.aligner.tokens([text])) if text else None
        groups = known.aligner.groups(*ids) if ids else []
        keys, each = summed(list(links(groups)))
        yield (*map(len, ids or ([], [])), len(groups), int(each.sum())), hashlib.sha256(written(groups).encode()).hexdigest() if ids else None, keys, each


def alignments(docs: DataFrame, byte_bpe: str = BYTE_BPE, pieces: str = PIECES, keep: tuple[str, ...] = ()) -> DataFrame:
    """docs (doc_id, text, and the columns named in keep) with n_a, n_b, n_groups, n_links, groups_sha256, n_best (links whose id pair is in as many documents as
    any pair of its A id) and count_sum (the number of documents of each link's pair, summed)."""
    spark = docs.sparkSession
    with open(byte_bpe, encoding="utf-8") as a, open(pieces, "rb") as b:
        files = spark.sparkContext.broadcast((a.read(), b.read()))  # some MB, whatever the input
    kept = {f"c{k}": name for k, name in enumerate(["doc_id", *keep])}  # names of their own, so that none clashes
    kinds = [T.StructField(c, docs.schema[name].dataType) for c, name in kept.items()]
    own = T.StructType.fromDDL("block long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, which binary, times binary, pairs array<long>, docs array<int>")
    schema = T.StructType([*kinds, *own.fields])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _known(*files.value)
        block = TaskContext.get().partitionId() << 32
        rows, found, held = [], [], 0

        def close() -> pa.RecordBatch:
            every = np.concatenate([np.zeros(0, np.int64), *(keys for _, _, keys, _ in found)])
            pairs, numbers = np.unique(every, return_inverse=True)
            n_docs = np.bincount(numbers, minlength=len(pairs)).astype(np.int32)
            ends = np.cumsum([len(keys) for _, _, keys, _ in found])
            which = [x.astype(np.int32).tobytes() for x in np.split(numbers, ends[:-1])]
            n = len(found)
            table = pa.Table.from_batches(rows).combine_chunks()
            columns = [pa.array([block] * n, pa.int64()), *(pa.array([f[0][k] for f in found], pa.int64()) for k in range(4)), pa.array([f[1] or "" for f in found], pa.string())]
            columns += [pa.array(which, pa.binary()), pa.array([f[3].astype(np.int32).tobytes() for f in found], pa.binary())]
            columns += [pa.array([pairs] + [None] * (n - 1), pa.list_(pa.int64())), pa.array([n_docs] + [None] * (n - 1), pa.list_(pa.int32()))]
            return pa.RecordBatch.from_arrays([*(table[c].combine_chunks() for c in kept), *columns], names=schema.names)

        # Texts are decoded and encoded some hundred at once.
        for batch in (b.slice(k, 200) for b in batches for k in range(0, len(b), 200)):
            texts = batch["text"].to_pylist()
            for part in _runs(texts):
                rows.append(batch.select(list(kept)).slice(part.start, part.stop - part.start))
                found += align(texts[part], known)
                held += sum(len(t or "") for t in texts[part])
                if held > BLOCK or len(found) >= ROWS:
                    yield close()
                    block, rows, found, held = block + 1, [], [], 0
        if found:
            yield close()

    packed = docs.select(*[F.col(f"`{name}`").alias(c) for c, name in kept.items()], "text").mapInArrow(pack, schema)
    packed = materialize(packed, "align-blocks", "zstd")
    spread = packed.where("pairs is not null").select("block", F.explode(F.arrays_zip("pairs", "docs")).alias("p")).select("block", F.col("p.pairs").alias("pair"), F.col("p.docs").alias("docs"))
    counts = materialize(spread.groupBy("pair").agg(F.sum("docs").alias("n")), "align-counts")
    a = F.shiftright("pair", SHIFT)
    top = materialize(counts.groupBy(a.alias("a")).agg(F.max("n").alias("top")), "align-top")  # a row for each id of A
    told = counts.join(F.broadcast(top), a == F.col("a")).select("pair", "n", (F.col("n") == F.col("top")).alias("best"))
    told = spread.select(F.col("block").alias("of"), "pair").join(told, "pair")
    result = T.StructType([*kinds, *T.StructType.fromDDL("n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string").fields])

    def score(rows: pa.Table, told: pa.Table) -> pa.Table:
        told = told.sort_by("pair")
        n, best = (told[c].to_numpy().astype(np.int64) for c in ("n", "best"))
        sums, bests = [], []
        for which, times in zip(rows["which"], rows["times"], strict=True):
            w, t = (np.frombuffer(x.as_py(), np.int32) for x in (which, times))
            sums.append(int((n[w] * t).sum()))
            bests.append(int((best[w] * t).sum()))
        out = [rows[c] for c in (*kept, *_NUMBERS)] + [pa.array(bests, pa.int64()), pa.array(sums, pa.int64()), rows["groups_sha256"]]
        return pa.Table.from_arrays(out, names=result.names)

    out = packed.drop("pairs", "docs").groupBy("block").cogroup(told.groupBy("of")).applyInArrow(score, result)
    return out.select(*[F.col(c).alias(name) for c, name in kept.items()], *result.names[len(kept) :])


def _runs(texts: list[str | None]) -> Iterator[slice]:
    """Runs of texts of about BLOCK / 8 characters, or single texts."""
    start = held = 0
    for k, t in enumerate(texts):
        if held and held + len(t or "") > BLOCK // 8:
            yield slice(start, k)
            start, held = k, 0
        held += len(t or "")
    if start < len(texts):
        yield slice(start, len(texts))
