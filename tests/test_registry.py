"""Registered queries equal their SQL at the smallest scale."""

import math

import duckdb
import pytest

from corpusmill import registry

SF = "/root/testdata/sf0.001"
SAMPLE = ["j1_enriched_bm25", "r3_fusion", "r6_exact_match", "r9_multi_query", "a4_describe", "a14_r14_evaluation", "b3_inefficiencies", "d1_chunk_quality", "g1_g3_edges", "j10_snapshot_diff", "m7_item_commands", "s8_page_text", "w4_heading_runs", "x11_citations", "st3_command_pairs", "st8_windows"]


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6) + 0.0
    if type(v).__name__ == "Decimal":
        return round(float(v), 6)
    return tuple(plain(x) for x in v) if isinstance(v, (list, tuple)) else v


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted((tuple(plain(r[k]) for k in order) for r in rows), key=repr)


@pytest.mark.parametrize("name", SAMPLE)
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = registry.queries()[name](spark, SF)
    cur = con.execute(registry.oracle_sql()[name])
    names = [d[0] for d in cur.description]
    assert sorted(df.columns) == sorted(names)
    assert rows_of(df.columns, df.collect()) == rows_of(names, cur.fetchall())


def test_entry_works_without_the_training_data_operators(monkeypatch):
    import importlib
    import os

    import __spark_entry__

    there = os.path.isfile
    monkeypatch.setattr(os.path, "isfile", lambda p: "llm" not in str(p) and there(p))
    without = importlib.reload(__spark_entry__)
    assert "r2_bm25" in without.queries() and not any(q.startswith("op") for q in without.queries())
    monkeypatch.undo()
    importlib.reload(__spark_entry__)
