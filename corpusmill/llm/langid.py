"""Language identification by bit-sliced Bloom filters of character n-grams.

One table of SLOTS words for every 63 languages holds a filter for each: a bit of a slot belongs to a language, so ANDing an n-gram's slots
returns the languages that contain it, all at once. A text's n-grams are looked up, the bits of each language are counted, the
counts are corrected for the filter's false positives, and the language of the largest count wins. The table (8 MB for every 63 languages,
MOST_LANGS at the most) is broadcast.

Learning reads a bounded sample: about docs_per_lang documents of each language, those whose doc_id hashes below the share wanted. An n-gram
belongs to a language if its rate there is at least min_share of its highest rate in any.

Defined cases: null text and text without letters is `und` with score 0; a text none of whose n-grams is known gets the most
frequent learned language with score 0; ties go to the first language by code point; with nothing to learn from all is `und`;
a text has evidence if the n-grams known in its language are more than the filter's false positives explain, by CHANCE standard deviations; documents of null doc_id or lang are never learned from, but are judged; repeated rows are judged alike; whole texts are read,
however long; an empty table gives no rows; more than MOST_LANGS values of lang are refused by a ValueError; kept columns may have any names
but those of the result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.llm.common import materialize
from corpusmill.llm.hashing import blocks, mix64

SLOTS, HASHES, SIZES = 1 << 20, 3, (3, 4)
#: Languages that share a word of a slot, and the most languages.
BITS, MOST_LANGS = 63, 1008
#: Standard deviations above the expected false positives from which n-grams are taken as known.
CHANCE = 4.0
#: Characters that are learned from at once, and that are looked up at once; both bound the memory of a task.
BLOCK, LOOKED_UP = 1 << 19, 1 << 17
_U = np.uint64
_LETTER = re.compile(r"[^\W\d_]")
_IS_LETTER: list[np.ndarray] = []


def _letters(cp: np.ndarray) -> np.ndarray:
    if not _IS_LETTER:
        _IS_LETTER.append(np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000))
    return _IS_LETTER[0][cp]


def has_letter(text: str | None) -> bool:
    """Whether a text has a letter; the pattern also finds numerals such as superscripts, so its find is looked at."""
    found = _LETTER.search(text) if text else None
    return found is not None and (found[0].isalpha() or any(map(str.isalpha, text)))


def ngram_hashes(texts: list[str], sizes: tuple[int, ...] = SIZES) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each lower-cased n-gram of letters, of which the first and last may be a word's edge, and the index of its text."""
    lower = [t.lower() for t in texts]
    cp = np.frombuffer(" ".join(["", *lower, ""]).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
    ends = np.cumsum(np.fromiter((len(t) + 1 for t in lower), np.int64, len(lower)))
    letter = _letters(cp)
    x = np.where(letter, cp, 32).astype(_U)
    found, owner = [], []
    for n in sizes:
        ok = np.ones(max(0, len(x) - n + 1), bool)
        for k in range(1, n - 1):
            ok &= letter[k : len(ok) + k]
        at = np.flatnonzero(ok)
        h = np.full(len(at), n, _U)
        with np.errstate(over="ignore"):
            for k in range(n):
                h = h * _U(0x100000001B3) + x[at + k]
            found.append(mix64(h * _U(0x9E3779B97F4A7C15)))
        owner.append(np.searchsorted(ends, at + 1))
    return np.concatenate(found), np.minimum(np.concatenate(owner), len(texts) - 1)


def slots_of(h: np.ndarray) -> list[np.ndarray]:
    return [((h >> _U(20 * k)) & _U(SLOTS - 1)).astype(np.int64) for k in range(HASHES)]


def learn(docs: DataFrame, docs_per_lang: int = 1000, min_share: float = 0.125) -> tuple[list[str], np.ndarray, str]:
    """Languages, table (a row of SLOTS words for every BITS languages) and most frequent language from docs (doc_id, text, lang), without the held-out fifth."""
    spark = docs.sparkSession
    may = docs.where(F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & ~held_out())
    sizes = {r[0]: r[1] for r in may.groupBy("lang").count().limit(MOST_LANGS + 1).collect()}
    if len(sizes) > MOST_LANGS:
        raise ValueError(f"more than {MOST_LANGS} languages")
    if not sizes:
        return [], np.zeros((1, SLOTS), _U), "und"
    langs = sorted(sizes)
    usual = min(langs, key=lambda x: -sizes[x])
    # A row for each language: its number, and the share of hashes that are in the sample.
    known = materialize(spark.createDataFrame([(x, k, docs_per_lang / sizes[x]) for k, x in enumerate(langs)], "lang string, bit int, share double"), "lang-names")
    place = F.xxhash64("doc_id").bitwiseAND(F.lit((1 << 30) - 1)) / F.lit(float(1 << 30))
    sample = may.where(F.col("text").isNotNull()).select("doc_id", "lang", "text").join(F.broadcast(known), "lang").where(place < F.col("share"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bits, texts = batch["bit"].to_numpy(), batch["text"].to_pylist()
            for bit in np.unique(bits):
                own = [texts[k] for k in np.flatnonzero(bits == bit)]
                for cut in blocks([len(t) for t in own], BLOCK):
                    h, n = np.unique(ngram_hashes(own[cut])[0], return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array([bit] * len(h), pa.int32()), pa.array(n)], ["h", "bit", "n"])

    grams = sample.select("bit", "text").mapInArrow(count, "h long, bit int, n long").groupBy("h", "bit").agg(F.sum("n").alias("n"))
    grams = materialize(grams, "lang-grams")
    totals = F.broadcast(grams.groupBy("bit").agg(F.sum("n").alias("total")))  # a row for each language
    rates = grams.join(totals, "bit").select("h", F.struct((F.col("n") / F.col("total")).alias("rate"), "bit").alias("r"))
    kept = rates.groupBy("h").agg(F.collect_list("r").alias("r")).withColumn("most", F.array_max(F.transform("r", lambda r: r.rate)))
    kept = kept.select("h", F.explode(F.filter("r", lambda r: r.rate >= min_share * F.col("most"))).alias("r"))
    slot = [F.shiftrightunsigned("h", 20 * k).bitwiseAND(F.lit(SLOTS - 1).cast("long")) for k in range(HASHES)]
    set_ = kept.select((F.col("r.bit") / BITS).cast("int").alias("word"), F.expr(f"shiftleft(1L, r.bit % {BITS})").alias("m"), F.explode(F.array(*slot)).alias("slot"))
    filled = set_.groupBy("word", "slot").agg(F.bit_or("m").alias("m")).toArrow()  # at most SLOTS rows for every BITS languages
    out = np.zeros((-(-len(langs) // BITS), SLOTS), _U)
    out[filled["word"].to_numpy(), filled["slot"].to_numpy()] = filled["m"].to_numpy().view(_U)
    return langs, out, usual


def held_out() -> F.Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))


def judge(texts: list[str | None], langs: list[str], masks: np.ndarray, wrong: np.ndarray, usual: str) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Language and score of each text, and whether it has evidence. wrong: each language's rate of false positives."""
    told, score, sure = ["und"] * len(texts), np.zeros(len(texts)), np.zeros(len(texts), bool)
    rows = [k for k, t in enumerate(texts) if has_letter(t)] if langs else []
    for part in blocks([len(texts[k]) for k in rows], LOOKED_UP):
        own = rows[part]
        h, owner = ngram_hashes([texts[k] for k in own])
        n = np.bincount(owner, minlength=len(own))
        columns: list[np.ndarray] = []
        for word in masks:
            m = word[(s := slots_of(h))[0]]
            for x in s[1:]:
                m = m & word[x]
            columns += [np.bincount(owner[((m >> _U(b)) & _U(1)).astype(bool)], minlength=len(own)) for b in range(min(BITS, len(langs) - len(columns)))]
        hits = np.stack(columns, axis=1)
        true = np.clip((hits - wrong * n[:, None]) / np.maximum(1 - wrong, 1e-9), 0, None)
        best, total = true.argmax(axis=1), true.sum(axis=1)
        chance = wrong * n[:, None] + CHANCE * np.sqrt(wrong * (1 - wrong) * n[:, None])
        enough = (hits > chance)[np.arange(len(own)), best]
        for k, row in enumerate(own):
            sure[row] = enough[k]
            told[row] = langs[best[k]] if total[k] > 0 else usual
            score[row] = true[k, best[k]] / total[k] if total[k] > 0 else 0.0
    return told, score, sure


def identify(docs: DataFrame, docs_per_lang: int = 1000, keep: tuple[str, ...] = (), evidence: bool = False) -> DataFrame:
    """docs (doc_id, text, and the columns named in keep) with held_out, lang_pred and score, and evidence if it is asked for."""
    langs, masks, usual = learn(docs, docs_per_lang)
    wrong = np.array([float(((masks[b // BITS] >> _U(b % BITS)) & _U(1)).mean()) ** HASHES for b in range(len(langs))])
    table = docs.sparkSession.sparkContext.broadcast(masks)

    @F.pandas_udf("lang_pred string, score double, evidence boolean")
    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            told, score, sure = judge(list(texts), langs, table.value, wrong, usual)
            yield pd.DataFrame({"lang_pred": told, "score": score, "evidence": sure})

    own = "language of the text"
    rows = docs.select("doc_id", *keep, predict("text").alias(own), held_out().alias("held_out"))
    return rows.select("doc_id", *keep, "held_out", *[F.col(f"`{own}`.{c}") for c in ("lang_pred", "score", *["evidence"] * evidence)])
