"""Functions for SQL: temporary SQL functions, and a table function that cuts texts."""

from __future__ import annotations

import unicodedata

import pandas as pd
import regex
from pyspark.sql import SparkSession
from pyspark.sql.functions import pandas_udf, udtf

from corpusmill.functions.text import STOP_WORDS
from corpusmill.functions.vectors import simhash_numbers
from corpusmill.operators.chunk import cut_long

_WORDS = regex.compile(r"(?V1)[一-鿿㐀-䶿]|[\p{L}--[一-鿿㐀-䶿]]+|\p{N}+")
_PAIRS = regex.compile("[一-鿿㐀-䶿]{2}")


def token_list(text: str | None) -> list[str] | None:
    """functions.text.tokens of one text."""
    if text is None:
        return None
    normal = unicodedata.normalize("NFKC", text).lower()
    words = [w for w in _WORDS.findall(normal) if w not in STOP_WORDS]
    pairs = [p for p in _PAIRS.findall(normal, overlapped=True) if p not in STOP_WORDS]
    return list(dict.fromkeys([*words, *pairs, *map("_".join, zip(words, words[1:], strict=False))]))


SQL_FUNCTIONS = {
    "hamming64(a BIGINT, b BIGINT)": "INT RETURN bit_count(a ^ b)",
    "cosine(a ARRAY<DOUBLE>, b ARRAY<DOUBLE>)": "DOUBLE RETURN CASE WHEN size(a) = size(b) AND aggregate(a, 0D, (s, x) -> s + x * x) > 0 AND aggregate(b, 0D, (s, x) -> s + x * x) > 0 THEN aggregate(zip_with(a, b, (x, y) -> x * y), 0D, (s, x) -> s + x) / sqrt(aggregate(a, 0D, (s, x) -> s + x * x) * aggregate(b, 0D, (s, x) -> s + x * x)) ELSE 0D END",
    "citation_indices(t STRING)": r"ARRAY<INT> RETURN array_distinct(transform(regexp_extract_all(t, r'\[(\d{1,3})\]', 1), x -> int(x)))",
    "clean_text(t STRING)": "STRING RETURN regexp_replace(regexp_replace(regexp_replace(t, '[■-◿☀-➿⬀-⯿]', ''), r'(?<=[一-鿿])\\s+(?=[一-鿿])', ''), r'[ \\t]{3,}', ' ')",
    "describe_long(s BINARY)": "STRUCT<count: BIGINT, p05: DOUBLE, p25: DOUBLE, p50: DOUBLE, p75: DOUBLE, p95: DOUBLE> RETURN named_struct('count', kll_sketch_get_n_double(s), 'p05', kll_sketch_get_quantile_double(s, 0.05D), 'p25', kll_sketch_get_quantile_double(s, 0.25D), 'p50', kll_sketch_get_quantile_double(s, 0.5D), 'p75', kll_sketch_get_quantile_double(s, 0.75D), 'p95', kll_sketch_get_quantile_double(s, 0.95D))",
    "content_id(t STRING)": "STRING RETURN substring(sha2(t, 256), 1, 32)",
}


def register(spark: SparkSession) -> None:
    """Makes the functions known to the session's SQL."""
    for head, body in SQL_FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURNS {body}")

    @pandas_udf("long")
    def simhash64(texts: pd.Series) -> pd.Series:
        halves = simhash_numbers([None if t is None else t.lower() for t in texts], {})
        return pd.Series((halves[:, 0] << 32 | halves[:, 1]))

    spark.udf.register("simhash64", simhash64)

    @pandas_udf("array<string>")
    def tokenize_text(texts: pd.Series) -> pd.Series:
        return texts.map(token_list)

    spark.udf.register("tokenize_text", tokenize_text)

    @udtf(returnType="idx int, start_char int, end_char int, content string")
    class SplitChunks:
        def eval(self, text: str, size: int, overlap: int):
            for k, (a, b) in enumerate(cut_long(text or "", size, overlap)):
                yield k, a, b, text[a:b]

    spark.udtf.register("split_chunks", SplitChunks)
