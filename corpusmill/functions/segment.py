"""The segment slot of the tokeniser: how runs of letters are cut into words.

A segmenter takes an array of runs (letters or CJK characters without a break) and gives the array of their words, as columns. dictionary_segmenter() is its first filling:
the best path over the graph of a dictionary's words in a run, by their logarithmic frequencies. Index and queries must go through the same segmenter.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Segmenter = Callable[[Column], Column]
#: Words of a dictionary, which goes to every task.
MOST_WORDS = 1_000_000


def best_words(run: str, weights: dict[str, float], longest: int, unknown: float) -> list[str]:
    """The cut of a run with the greatest sum of weights; a character of no word weighs unknown. Of equal sums the one whose last word is longest is taken, and so on before it."""
    best: list[tuple[float, int]] = [(0.0, 0)]
    for end in range(1, len(run) + 1):
        options = [(best[start][0] + w, start) for start in range(max(0, end - longest), end) if (w := weights.get(run[start:end])) is not None]
        if run[end - 1] not in weights:
            options.append((best[end - 1][0] + unknown, end - 1))
        best.append(max(options, key=lambda o: (round(o[0], 9), -o[1])))
    cuts = [len(run)]
    while cuts[-1]:
        cuts.append(best[cuts[-1]][1])
    cuts.reverse()
    return [run[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


def dictionary_segmenter(frequencies: dict[str, float], user: dict[str, float] | None = None, most: int = MOST_WORDS) -> Segmenter:
    """A segmenter over a dictionary of words and frequencies. user: further words, whose frequencies come in the place of the dictionary's; without one (0) a word is as frequent as the commonest."""
    table = {w: f for w, f in frequencies.items() if w and f > 0}
    top = max(table.values(), default=1.0)
    table |= {w: f or top for w, f in (user or {}).items() if w}
    if len(table) > most:
        raise ValueError(f"a dictionary of more than {most} words")
    total = math.log(sum(table.values()) or 1.0)
    weights = {w: math.log(f) - total for w, f in table.items()}
    longest, unknown = max(map(len, weights), default=1), min(weights.values(), default=0.0) - 2.0

    @F.pandas_udf("array<string>")
    def cut(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        known: dict[str, list[str]] = {}
        for rows in batches:
            if len(known) > 200_000:
                known.clear()
            out = []
            for runs in rows:
                if runs is None:
                    out.append(None)
                    continue
                words = []
                for run in runs:
                    if run not in known:
                        known[run] = best_words(run, weights, longest, unknown)
                    words += known[run]
                out.append(words)
            yield pd.Series(out)

    return cut


def frequencies(words: DataFrame, most: int, least: int = 2) -> dict[str, float]:
    """The most commonest words of a table (word), seen least times or more, as a dictionary: a bounded collection."""
    counted = words.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    return {r["word"]: float(r["n"]) for r in counted.orderBy(F.desc("n"), "word").limit(most).collect()}
