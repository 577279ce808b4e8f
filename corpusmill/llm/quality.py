"""Quality rules with risk-controlled thresholds.

Base counts are taken over every whole text. Beyond the base rule, a document is rejected if one of RULES' measures is above a
cutoff, chosen for each stratum (lang) from labelled good documents so that, at confidence 1 - delta over all strata, at most the share alpha of
a stratum's good documents is rejected. Cutoffs are tested by the exact binomial test from loose to tight, and the first that fails ends
the sequence, so the number of cutoffs costs no confidence; delta is divided among the strata. By its number of good documents alone a stratum takes
one of three ways:
- enough for alpha / 4: each rule has a sequence of its own, alpha and delta being divided among the rules;
- enough for alpha: one sequence tightens all rules in turn, and the documents that any of them rejects are counted;
- fewer (than needed() tells): it has no cutoffs, as no bound of its own could hold; others' cutoffs tell nothing of it.

Cutoffs are fitted on all labelled good documents, however many. Texts are counted once: the counts are written, met by the labels by doc_id,
and judged. What the driver gets are numbers of documents: for each stratum at most one for each combination of cutoffs.

Defined cases: null text has no words and fails the base rule; a null lang is a stratum of its own; a stratum without labels has no
cutoffs; a document with several labels is good only if all are; a measure equal to a cutoff passes; a null doc_id has no label; repeated rows
are judged alike; whole texts are counted, however long; an empty table gives no rows; kept columns may have any names but those of the result.
"""

from __future__ import annotations

import functools
import math
import operator
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.llm.common import materialize, sized

SYMBOLS = "#*$%&|<>"
#: Measure and its cutoffs. A measure above the cutoff rejects.
RULES = {
    "symbols_per_char": (0.02, 0.04, 0.06, 0.08, 0.1, 0.15, 0.2),
    "dup_line_share": (0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7),
    "repeat_word_share": (0.05, 0.1, 0.2, 0.3, 0.4),
    "chars_per_word": (8, 10, 12, 15, 20, 30),
}
_COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def counts(text: str | None) -> tuple[int, int, int, int, int, int]:
    """_COUNTS, and the number of lines with a word."""
    if not text:
        return 0, 0, 0, 0, 0, 0
    data = text.encode("utf-8", "surrogatepass")
    words = data.split()  # at ASCII blanks alone
    blanks = sum(map(text.count, " \t\n\v\f\r"))
    symbols = sum(map(text.count, SYMBOLS))
    lines = [x for x in data.split(b"\n") if x.strip()]
    n = len(words)
    repeated = 0
    if n > 3:
        seen: dict[bytes, int] = {}
        ids = np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, n)
        if len(seen) < n:
            v = len(seen)
            pairs = ids[:-2] * v + ids[1:-1]
            if v > 2_000_000:  # else a window's number fits 64 bits
                pairs = np.unique(pairs, return_inverse=True)[1]
            _, which, times = np.unique(pairs * v + ids[2:], return_inverse=True, return_counts=True)
            twice = times[which] > 1
            inside = np.zeros(n, bool)
            for k in range(3):
                inside[k : n - 2 + k] |= twice
            repeated = int(inside.sum())
    return n, len(text) - blanks, symbols, len(lines) - len(set(lines)), repeated, len(lines)


def measures(c: tuple[int, int, int, int, int, int]) -> dict[str, float]:
    n, chars, symbols, dup, repeated, lines = c
    return {"symbols_per_char": symbols / max(chars, 1), "dup_line_share": dup / max(lines, 1), "repeat_word_share": repeated / max(n, 1), "chars_per_word": chars / max(n, 1)}


def base_failed(c: tuple[int, ...]) -> bool:
    return c[0] < 50 or 100 * c[4] > 50 * c[0]


def binomial_cdf(k: int, n: int, p: float) -> float:
    """P(X <= k) of a binomial distribution, summed in logarithms; terms 40 standard deviations below the largest do not change the sum."""
    if k >= n:
        return 1.0
    lead = math.lgamma(n + 1)
    first = max(0, min(k, math.floor(n * p)) - 100 - math.ceil(40 * math.sqrt(n * p * (1 - p))))
    last = min(k, math.ceil(n * p) + 100 + math.ceil(40 * math.sqrt(n * p * (1 - p))))
    terms = [lead - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log1p(-p) for i in range(first, last + 1)]
    top = max(terms)
    return min(1.0, math.exp(top) * math.fsum(math.exp(t - top) for t in terms))


def _passes(over: Counter, tight: dict[str, int], alpha: float, level: float) -> bool:
    """Whether the good documents counted in over may be rejected by the rules at their tightness: "more than alpha are" is rejected at level."""
    return binomial_cdf(_rejected(over, tight), sum(over.values()), alpha) <= level


def _rejected(over: Counter, tight: dict[str, int]) -> int:
    """How many documents some rule rejects. over: documents by the number of cutoffs, from the tightest, that each measure is above."""
    return sum(n for above, n in over.items() if any(len(cuts) - a < tight.get(rule, 0) for (rule, cuts), a in zip(RULES.items(), above, strict=True)))


def needed(alpha: float, delta: float, strata: int = 1) -> int:
    """Good documents that a stratum must have for any cutoff, if none of them is rejected."""
    return math.ceil(math.log(delta / strata) / math.log1p(-alpha))


def _enough(n: int, alpha: float, level: float) -> bool:
    return binomial_cdf(0, n, alpha) <= level


def _tighten(over: Counter, alpha: float, level: float) -> dict[str, int]:
    """Tightness of each rule: 1 is its loosest cutoff."""
    n, out = sum(over.values()), {}
    if _enough(n, alpha / len(RULES), level / len(RULES)):
        for rule, cuts in RULES.items():
            for k in range(1, len(cuts) + 1):
                if not _passes(over, {rule: k}, alpha / len(RULES), level / len(RULES)):
                    break
                out[rule] = k
    elif _enough(n, alpha, level):
        for _, rule, k in sorted((k / len(cuts), rule, k) for rule, cuts in RULES.items() for k in range(1, len(cuts) + 1)):
            if not _passes(over, out | {rule: k}, alpha, level):
                break
            out[rule] = k
    return out


def _counted(docs: DataFrame, *columns: Column) -> DataFrame:
    """The columns, and of text its counts, base_failed, and above: of how many of its cutoffs each of RULES' measures is above."""
    kinds = ", ".join(f"{c} long" for c in _COUNTS)

    @F.pandas_udf(f"{kinds}, base_failed boolean, above array<int>")
    def look(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            rows = []
            for text in texts:
                m = measures(c := counts(text))
                rows.append((*c[:5], base_failed(c), [sum(m[rule] > cut for cut in cuts) for rule, cuts in RULES.items()]))
            yield pd.DataFrame(rows, columns=[*_COUNTS, "base_failed", "above"])

    own = "quality of the text"
    return docs.select(*columns, look("text").alias(own)).select("*", f"`{own}`.*").drop(own)


def _fitted(good: DataFrame, alpha: float, delta: float) -> dict[str | None, dict[str, int]]:
    """Tightness of each stratum's rules from counted good documents (lang, base_failed, above), of which those that pass the base rule count."""
    strata: dict[str | None, Counter] = {}
    for row in good.where("not base_failed").groupBy("lang", "above").count().collect():  # for each stratum at most a row for each combination of cutoffs
        strata.setdefault(row["lang"], Counter())[tuple(row["above"])] += row["count"]
    level = delta / max(len(strata), 1)
    return {lang: _tighten(over, alpha, level) for lang, over in strata.items()}


def choose_cutoffs(good: DataFrame, alpha: float, delta: float) -> dict[str | None, dict[str, float]]:
    """Cutoffs of each stratum from good documents (lang, text), of which those that pass the base rule count."""
    tight = _fitted(_counted(good, F.col("lang")), alpha, delta)
    return {lang: {rule: RULES[rule][-k] for rule, k in own.items()} for lang, own in tight.items()}


def assess(docs: DataFrame, labels: DataFrame, alpha: float = 0.02, delta: float = 0.05, keep: tuple[str, ...] = ()) -> DataFrame:
    """docs (doc_id, text, lang, and the columns named in keep) with the base counts, base_failed and kept."""
    kept = {f"c{k}": name for k, name in enumerate(["doc_id", *keep])}  # names of their own, so that none clashes
    counted = materialize(_counted(docs, *[F.col(f"`{name}`").alias(c) for c, name in kept.items()], F.col("lang")), "quality-counts")
    good = labels.groupBy("doc_id").agg(F.min("quality").alias("quality")).where("quality = 1").select(F.col("doc_id").alias("id"))
    tight = _fitted(counted.join(good, F.col("c0") == F.col("id"), "left_semi"), alpha, delta)
    # A row for each stratum that has cutoffs: how many of them each measure may be above.
    rows = [(lang, [len(cuts) - own.get(rule, 0) for rule, cuts in RULES.items()]) for lang, own in tight.items() if own]
    most = sized(docs.sparkSession.createDataFrame(rows, "stratum string, most array<int>"))
    within = functools.reduce(operator.and_, [F.get("above", F.lit(k)) <= F.get("most", F.lit(k)) for k in range(len(RULES))])
    judged = counted.join(most, F.col("lang").eqNullSafe(F.col("stratum")), "left").withColumn("kept", ~F.col("base_failed") & F.coalesce(within, F.lit(True)))
    return judged.select(*[F.col(c).alias(name) for c, name in kept.items()], *_COUNTS, "base_failed", "kept")
