"""Substring index, pattern automaton, segmenter, quantile sketches, SQL functions, communities."""

import itertools
import math
import random
from functools import partial

import pytest
from pyspark.sql import functions as F

from corpusmill.functions import patterns, segment
from corpusmill.functions import text as X
from corpusmill.operators import graph as G
from corpusmill.operators import index as I
from corpusmill.operators import profile as P
from corpusmill.operators import substring as S


def test_substring_index(spark, tmp_path):
    rows = [("a", 1, 0, "The Cat sat"), ("b", 1, 1, "concatenate\nÉTÉ"), ("c", 2, 0, None), ("d", 2, 1, ""), ("e", 3, 0, "ca t"), ("f", 3, 1, "x" * 50_000 + "needle"), ("g", 4, 0, "cat cat cat")]
    chunks = spark.createDataFrame(rows, "chunk_id string, doc_id long, idx int, content string")
    index = S.build(chunks, str(tmp_path / "grams"))
    for keyword in ("cat", "CAT", "at", "é", "été", "needle", "xxxxx", "caterpillar", "e\nÉ", "", "zzz", "at s"):
        want = {r[0] for r in rows if r[3] is not None and keyword.lower() in r[3].lower()}
        assert {r["chunk_id"] for r in S.search(index, keyword).collect()} == want, keyword
    assert {r["chunk_id"] for r in S.candidates(index, "needle").collect()} == {"f"}
    plan = S.search(index, "needle")._jdf.queryExecution().executedPlan().toString()
    assert "folder" in plan.split("PartitionFilters: [")[1].split("]")[0]
    empty = S.build(chunks.limit(0), str(tmp_path / "empty"))
    assert S.search(empty, "cat").count() == 0 and S.search(empty, "a").count() == 0


def test_a_segment_is_inverted_where_it_is_read(spark, tmp_path, monkeypatch):
    rnd = random.Random(8)
    texts = [None, "", "ab", "aaa", "\x00\x00\x00b", "养老服务 😀😀😀", *("".join(rnd.choices("ab日é ", k=rnd.randrange(40))) for _ in range(60))]
    want = {}
    for k, t in enumerate(texts):
        for g in {(t or "")[i : i + 3] for i in range(len(t or "") - 2)}:
            want.setdefault(g, []).append(k)
    assert {g: p.tolist() for g, p in S.invert(texts)} == want and not list(S.invert([])) and not list(S.invert([None]))
    wide = ["".join(map(chr, range(0x10000 + 70_000 * k, 0x10000 + 70_000 * (k + 1)))) for k in range(3)]  # more signs than a number has room for
    assert {g: p.tolist() for g, p in S.invert([*wide, wide[0]]) if g == wide[2][:3]} == {wide[2][:3]: [2]}
    monkeypatch.setattr(S, "ROWS", 7)
    chunks = spark.createDataFrame([(f"c{k}", k, 0, t) for k, t in enumerate(texts)], "chunk_id string, doc_id long, idx int, content string")
    index = S.build(chunks, str(tmp_path / "grams"))
    assert index.grams.agg(F.sum("df")).first()[0] == sum(map(len, want.values())) > index.postings.count()
    for keyword in ("ab日", "é a", "aab日", "😀😀", "服务 😀", "b"):
        assert {r["chunk_id"] for r in S.search(index, keyword).collect()} == {f"c{k}" for k, t in enumerate(texts) if keyword in (t or "")}, keyword


def test_patterns_equal_a_scan(spark):
    rnd = random.Random(6)
    words = ["".join(rnd.choices("ab日é", k=rnd.randrange(1, 5))) for _ in range(300)] + ["", "ab", "ab"]
    texts = [None, "", "abab日", *("".join(rnd.choices("ab日é", k=200)) for _ in range(20))]
    got = spark.createDataFrame(list(enumerate(texts)), "k int, t string").select("k", patterns.found_patterns(F.col("t"), words).alias("f")).collect()
    distinct = list(dict.fromkeys(words))
    for r in got:
        assert r["f"] == ([w for w in distinct if w in texts[r["k"]]] if texts[r["k"]] is not None else [])
    assert [r["f"] for r in spark.createDataFrame([("a",)], "t string").select(patterns.found_patterns(F.col("t"), []).alias("f")).collect()] == [[]]


def test_many_patterns(spark):
    words = [f"p{k}q" for k in range(10_000)]
    row = spark.createDataFrame([("p9999q p3q p17",)], "t string").select(patterns.found_patterns(F.col("t"), words).alias("f")).first()
    assert row["f"] == ["p3q", "p9999q"]


def every_cut(run):
    for marks in itertools.product((0, 1), repeat=len(run) - 1):
        cuts = [0, *(k + 1 for k, m in enumerate(marks) if m), len(run)]
        yield [run[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]


def test_segmenter_takes_the_best_path(spark):
    table = {"a": 5.0, "ab": 9.0, "abc": 2.0, "bc": 8.0, "c": 4.0, "ca": 3.0, "养老": 9.0, "养老服务": 4.0, "服务": 7.0, "中心": 5.0}
    total = math.log(sum(table.values()))
    weights = {w: math.log(f) - total for w, f in table.items()}
    unknown = min(weights.values()) - 2
    runs = ["abcab", "cab", "xabx", "b", "abcabcab", "养老服务中心", "新养老"]
    cut = segment.dictionary_segmenter(table)
    got = spark.createDataFrame([(runs,)], "r array<string>").select(cut(F.col("r")).alias("w")).first()["w"]
    want = []
    for run in runs:
        score = lambda words: sum(weights.get(w, unknown if len(w) == 1 else -1e9) for w in words)
        best = max(map(score, every_cut(run)))
        words = segment.best_words(run, weights, 4, unknown)
        assert score(words) == pytest.approx(best) and "".join(words) == run
        want += words
    assert got == want
    user = segment.dictionary_segmenter(table, {"养老服务中心": 0})
    assert spark.createDataFrame([(["养老服务中心"],)], "r array<string>").select(user(F.col("r")).alias("w")).first()["w"] == ["养老服务中心"]
    with pytest.raises(ValueError, match="more than 3 words"):
        segment.dictionary_segmenter(table, most=3)


def test_index_and_queries_take_the_same_segmenter(spark, tmp_path):
    cut = segment.dictionary_segmenter({"养老": 9.0, "服务": 7.0, "中心": 5.0, "社区": 5.0})
    chunks = spark.createDataFrame([("a", 1, "社区养老服务"), ("b", 2, "老服社区"), ("c", 3, "中心中心")], "chunk_id string, doc_id long, content string")
    index = I.build(chunks, str(tmp_path / "index"), tokenizer=partial(X.tokens, segment=cut))
    assert {r["token"] for r in index.terms.collect()} >= {"养老", "服务", "社区_养老"}
    found = I.search(index, spark.createDataFrame([(1, "养老中心")], "query_id long, query string"), 5).collect()
    assert {r["chunk_id"] for r in found} == {"a", "c"}
    plain = spark.createDataFrame([("a 社区 b",)], "t string")
    assert plain.select(X.tokens(F.col("t")).alias("w")).first()["w"][:3] == ["社", "区", "b"]


def test_sketches_merge(spark):
    rows = [(d, float(d * 1000 + k), None if k % 10 == 0 else float((k * 37) % 1000)) for d in range(5) for k in range(1000)] + [(9, None, None)]
    df = spark.createDataFrame(rows, "day int, x double, y double")
    merged = {r["column"]: r for r in P.sketched_quantiles(P.merge_sketches(P.quantile_sketches(df, ["x", "y"], "day")), [0.0, 0.1, 0.5, 0.9]).collect()}
    for c, at in (("x", 1), ("y", 2)):
        values = sorted(r[at] for r in rows if r[at] is not None)
        assert (merged[c]["count"], merged[c]["missing"], merged[c]["least"], merged[c]["most"]) == (len(values), len(rows) - len(values), values[0], values[-1])
        for q in merged[c]["quantiles"]:
            below, upto = sum(v < q["value"] for v in values) / len(values), sum(v <= q["value"] for v in values) / len(values)
            assert below - 2 * P.RANK_ERROR <= q["share"] <= upto + 2 * P.RANK_ERROR
    assert P.sketched_quantiles(P.quantile_sketches(df.where("day = 9"), ["x"]), [0.5]).first()["quantiles"] is None


def test_sql_functions_equal_the_columns(spark):
    from corpusmill.functions.register import register

    register(spark)
    texts = ["The Cat and the Ｆｕｌｌ width ①養老 养老服务中心", "a ■ b    c 养 老", "", "été 12 34 été été 12", None, "社区 服务　中心", "ﬁne ﬂat"]
    spark.createDataFrame(list(enumerate(texts)), "k int, t string").createOrReplaceTempView("texts")
    for r in spark.table("texts").select("k", X.tokens(F.col("t")).alias("w"), X.clean_symbols(F.col("t")).alias("c"), F.expr("tokenize_text(t)").alias("ws"), F.expr("clean_text(t)").alias("cs")).collect():
        assert r["w"] == r["ws"] and r["c"] == r["cs"], texts[r["k"]]
    spark.range(1000).selectExpr("cast(id as double) x").createOrReplaceTempView("numbers")
    told = spark.sql("SELECT describe_long(kll_sketch_agg_double(x, 512)) d FROM numbers").first()["d"]
    assert told["count"] == 1000 and abs(told["p50"] - 500) < 15 and told["p05"] < told["p25"] < told["p75"] < told["p95"]


def test_parts_of_communities_are_connected(spark):
    links = [(1, 2), (2, 3), (4, 5), (6, 7), (7, 8), (3, 4)]
    both = spark.createDataFrame([e for a, b in links for e in ((f"n{a}", f"n{b}", 1.0), (f"n{b}", f"n{a}", 1.0))], "a string, b string, w double")
    labels = spark.createDataFrame([(f"n{k}", "x" if k in (1, 2, 3, 6, 7, 8) else "y") for k in range(1, 9)], "a string, c string")
    got = {r["a"]: r["part"] for r in G.connected_parts(both, labels).collect()}
    assert got == {"n1": "n1", "n2": "n1", "n3": "n1", "n4": "n4", "n5": "n4", "n6": "n6", "n7": "n6", "n8": "n6"}


def test_every_community_is_connected(spark):
    rnd = random.Random(12)
    edges = {tuple(sorted(rnd.sample(range(40 * g, 40 * g + 40), 2))) for g in range(4) for _ in range(90)} | {tuple(sorted(rnd.sample(range(160), 2))) for _ in range(25)}
    frame = spark.createDataFrame([(f"{a:03d}", f"{b:03d}", "r", 1) for a, b in edges], "source string, target string, relation string, doc_id long")
    nodes = spark.createDataFrame([(f"{k:03d}",) for k in range(160)], "id string")
    found = {r["id"]: r["cluster"] for r in G.communities(nodes, frame).collect()}
    for cluster in set(found.values()):
        members = {int(k) for k, c in found.items() if c == cluster}
        seen, todo = set(), [min(members)]
        while todo:
            v = todo.pop()
            if v not in seen:
                seen.add(v)
                todo += [b if a == v else a for a, b in edges if v in (a, b) and {a, b} <= members]
        assert seen == members
    assert G.modularity(frame, spark.createDataFrame(list(found.items()), "id string, cluster string")).first()["q"] > 0.5
