"""Many fixed patterns at once: an Aho-Corasick automaton that reads each text once."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Characters of all patterns together: the automaton goes to every task.
MOST_CHARS = 5_000_000


def found_patterns(text: Column, patterns: list[str]) -> Column:
    """The patterns that a text contains, in the order of the list, each once; none for a null text. An empty pattern is in every text."""
    import ahocorasick

    distinct = list(dict.fromkeys(patterns))
    if sum(map(len, distinct)) > MOST_CHARS:
        raise ValueError(f"patterns of more than {MOST_CHARS} characters")
    always = [k for k, p in enumerate(distinct) if not p]

    @F.pandas_udf("array<int>")
    def numbers(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        automaton = ahocorasick.Automaton()
        for k, p in enumerate(distinct):
            if p:
                automaton.add_word(p, k)
        automaton.make_automaton()
        usable = len(automaton) > 0
        for texts in batches:
            yield pd.Series([[] if t is None else sorted({*always, *((k for _, k in automaton.iter(t)) if usable else ())}) for t in texts])

    listed = F.array(*map(F.lit, distinct)) if distinct else F.array().cast("array<string>")
    return F.transform(numbers(text), lambda k: F.get(listed, k))
