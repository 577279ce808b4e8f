"""Table operators on small fixtures."""

import pytest
from pyspark.sql import functions as F

from corpusmill.operators import behaviour as B
from corpusmill.operators import chunk as C
from corpusmill.operators import context as T
from corpusmill.operators import evaluate as E
from corpusmill.operators import graph as G
from corpusmill.operators import quality as Q
from corpusmill.operators import retrieve as R
from corpusmill.operators import store as S
from corpusmill.operators import sync as Y


def test_chunk_offsets(spark):
    text = "这是第一段内容。\n\n这是第二段内容。\n\n这是第三段内容，比较长一些用来测试切分。"
    paged = f"--- Page 1 ---\n{text}\n--- Page 2 ---\n\n\n1. 标题\n{text}"
    rows = [(1, text, "text"), (2, paged, "paged"), (3, "# A\n\nbody\n\n```\n# no heading\n```\n# B\nmore", "headed"), (4, "[s] a=1\nb\n[t] c", "table"), (5, None, "text"), (6, "  ", "text")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, format string")
    got = C.chunk_documents(docs, 50, 10).collect()
    source = {r[0]: r[1] for r in rows}
    assert got and {r["doc_id"] for r in got} == {1, 2, 3, 4}
    for r in got:
        assert source[r["doc_id"]][r["start_char"] : r["end_char"]] == r["content"]
    assert {r["page_num"] for r in got if r["doc_id"] == 2} == {1, 2}
    assert [r["content"] for r in got if r["doc_id"] == 4] == ["[s] a=1\nb", "[t] c"]


def test_cut_long_ends_after_separators():
    text = "word " * 30 + "end. " + "more " * 30
    spans = C.cut_long(text, 170, 20)
    assert text[: spans[0][1]].endswith("end. ") and spans[-1][1] == len(text)
    assert all(b[0] <= a[1] for a, b in zip(spans, spans[1:], strict=False))


def test_neighbours(spark):
    rows = spark.createDataFrame([("d_0", "d", 0, "a"), ("d_1", "d", 1, "b"), ("d_2", "d", 2, "c")], "chunk_id string, doc_id string, idx int, content string")
    got = {r["chunk_id"]: r["context"] for r in C.neighbours(rows).collect()}
    assert got == {"d_0": "b", "d_1": "a\n\nc", "d_2": "b"}
    assert {r["context"] for r in C.neighbours(rows, 0).collect()} == {""}


def ranked(spark, rows):
    return spark.createDataFrame(rows, "query_id string, chunk_id string, doc_id string, score double, rank int")


def test_fusion(spark):
    q = spark.createDataFrame([("q", "养老服务")], "query_id string, query string")
    got = {r["chunk_id"]: (r["source"], r["score"]) for r in R.fuse(ranked(spark, [("q", "c1", "d", 2.0, 1), ("q", "c2", "d", 1.0, 2)]), ranked(spark, [("q", "c1", "d", 0.9, 1), ("q", "c3", "d", 0.8, 2)]), q).collect()}
    assert got["c1"] == ("both", pytest.approx(0.4 / 31 + 0.6 / 31))
    assert got["c2"] == ("bm25", pytest.approx(0.4 / 32)) and got["c3"] == ("vector", pytest.approx(0.6 / 32))


def test_exact_match_rerank(spark):
    q = spark.createDataFrame([("q", "养老中心")], "query_id string, query string")
    hits = spark.createDataFrame([("q", "r1", 5.0, 1, "居家养老服务中心服务", "", ""), ("q", "r2", 5.0, 2, "中中中管理知识库", "", "")], "query_id string, chunk_id string, score double, rank int, content string, doc_title string, heading string")
    got = {r["chunk_id"]: r["score"] for r in R.exact_match_rerank(hits, q).collect()}
    assert got["r1"] > got["r2"]


@pytest.mark.parametrize(("n", "order"), [(1, [0]), (2, [0, 1]), (3, [0, 2, 1]), (5, [0, 2, 4, 3, 1]), (6, [0, 2, 4, 5, 3, 1])])
def test_lost_in_middle(spark, n, order):
    rows = spark.createDataFrame([("q", k + 1) for k in range(n)], "query_id string, rank int")
    assert [r["rank"] - 1 for r in T.lost_in_middle(rows).orderBy("position").collect()] == order


def test_budget(spark):
    rows = spark.createDataFrame([("q", 1, 0.9, "x" * 200), ("q", 2, 0.5, "x" * 200), ("q", 3, 0.3, "x" * 200)], "query_id string, rank int, score double, content string")
    got = T.fit_budget(rows, 300).orderBy("rank").collect()
    assert [(r["rank"], r["was_cut"]) for r in got] == [(1, False), (2, True)] and len(got[1]["content"]) == 50
    assert T.fit_budget(rows, 4096).count() == 3


def test_quality(spark):
    texts = {"good": "骨灰安置是指将骨灰安放在骨灰堂、骨灰墙、骨灰塔等设施中的过程。", "short": "详见附件", "garbled": "□□□□◇◇◇◇△△△△☆☆☆☆□□□□◇◇◇◇" * 3, "digits": "12345678901234567890", "blank": " \n "}
    got = {r["chunk_id"]: r for r in Q.check(spark.createDataFrame(list(texts.items()), "chunk_id string, content string")).collect()}
    assert got["good"]["issues"] == [] and got["good"]["score"] == 1
    assert "too_short" in got["short"]["issues"] and "ocr_garbage" in got["garbled"]["issues"] and "no_text_content" in got["digits"]["issues"]
    assert got["blank"]["issues"] == ["empty"] and got["blank"]["score"] == 0


def test_near_duplicates_equal_brute_force(spark):
    from corpusmill.functions import vectors as V

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = {r["doc_id"]: (r["duplicate_of"], r["distance"]) for r in Q.near_duplicates(docs).collect()}
    prints = [(r["doc_id"], (r["h"]["hi"] << 32) | r["h"]["lo"]) for r in docs.select("doc_id", V.simhash(F.col("text")).alias("h")).collect()]
    want = {}
    for i, a in prints:
        near = [((a ^ b).bit_count(), j) for j, b in prints if j < i and (a ^ b).bit_count() <= 9]
        if near:
            want[i] = (min(near)[1], min(near)[0])
    assert got == want


def test_metrics(spark):
    rows = spark.createDataFrame([("a", 1, False), ("a", 2, True), ("a", 3, False), ("b", 1, True), ("b", 2, False), ("b", 3, False), ("c", 1, False)], "query_id string, rank int, hit boolean")
    got = {r["query_id"]: r for r in E.metrics(rows).collect()}
    assert got["a"]["recall"] == 1 and got["a"]["mrr"] == 0.5
    assert got["b"]["ndcg"] == pytest.approx(0.5 / (1 / 2 + 1 / 3 + 1 / 4)) and got["c"]["recall"] == 0 and got["c"]["ndcg"] == 0
    assert {r["query_id"]: r["recall"] for r in E.metrics(rows, 1).collect()} == {"a": 0, "b": 1, "c": 0}


def test_tags(spark):
    d = spark.createDataFrame([(1, ["a", "p"]), (2, ["a", "q"]), (3, ["b", "a"])], "doc_id int, tags array<string>")
    got = {r["doc_id"]: (r["tags"], r["changed"]) for r in S.rename_tag(d, "a", "b").collect()}
    assert got == {1: (["b", "p"], True), 2: (["b", "q"], True), 3: (["b"], True)}
    assert not any(r["changed"] for r in S.rename_tag(d, " ", "b").collect() + S.rename_tag(d, "zz", "b").collect())
    merged = {r["doc_id"]: r["tags"] for r in S.merge_tag(d, "p", "t").collect()}
    assert merged == {1: ["a", "t"], 2: ["a", "q"], 3: ["b", "a"]}


def test_graph(spark):
    rows = [(1, "1", "title", [("r", "region"), ("g", "agency"), ("t", "topic")], [("title", "r", "x"), ("title", "g", "y"), ("g", "t", "z")])]
    nodes, edges = G.build(spark.createDataFrame(rows, "seq long, doc_id string, doc_title string, entities array<struct<name:string,type:string>>, relations array<struct<source:string,target:string,relation:string>>"))
    assert nodes.count() == 4 and edges.count() == 3
    n, e = G.delete_node(nodes, edges, "r")
    assert n.count() == 3 and e.count() == 2
    assert G.rename_node(nodes, edges, "g", "r")[2] is False and G.rename_node(nodes, edges, "g", "g")[2] is True
    assert G.rename_node(nodes, edges, "g", "new")[1].count() == 3


def test_sync(spark):
    schema = "path string, hash string, mtime long"
    old = spark.createDataFrame([("a", "1", 1), ("b", "1", 1), ("c", "1", 1), ("d", "1", 1)], schema)
    new = spark.createDataFrame([("a", "1", 1), ("b", "2", 2), ("c", "1", 2), ("e", "1", 1)], schema)
    changes = Y.diff(old, new)
    assert {r["path"]: r["status"] for r in changes.collect()} == {"a": "unchanged", "b": "modified", "c": "unchanged", "d": "deleted", "e": "new"}
    assert Y.totals(changes).first().asDict() == {"added": 1, "updated": 1, "deleted": 1, "skipped": 2, "total": 5, "has_changes": True}
    assert {r["path"] for r in Y.apply(old, old, new).collect()} == {"a", "b", "c", "e"}


def test_behaviour(spark):
    rows = [("s", k, c, k) for k, c in enumerate(["ingest", "analyze"] * 3 + ["odd"])]
    commands = spark.createDataFrame(rows, "session string, seq long, cmd string, ts long")
    counts = B.pair_counts(B.pairs(commands))
    assert [(r["a"], r["b"], r["n"]) for r in counts.collect()] == [("ingest", "analyze", 3)]
    assert B.suggestions(counts).first()["next"] == "analyze" and B.suggestions(counts, 4).count() == 0


def test_items(spark):
    rows = spark.createDataFrame([(1, "2020-01-01", "pending"), (2, "2020-01-05", "done"), (3, "2020-01-05", "pending")], "id int, date string, status string").withColumn("date", F.to_date("date"))
    day = F.to_date(F.lit("2020-01-05"))
    moved = B.carry_over(rows, day)
    assert moved.where("moved").count() == 1 and B.carry_over(moved.select("id", "date", "status"), day).where("moved").count() == 0


def test_gate_and_plan(spark):
    ids = lambda *x: spark.createDataFrame([(i,) for i in x], "id string")
    assert R.sync_plan(ids("a", "b"), ids("a", "b")).first()["plan"] == "in_sync"
    assert R.sync_plan(ids("a", "b"), ids("b", "c")).first()["plan"] == "incremental"
    assert R.sync_plan(ids("a"), ids("b")).first()["plan"] == "rebuild"


def brute_cuts(text, size, overlap):
    """Windows by trying every place: the first separator with a place in the last three tenths, at its last such place."""
    spans, start = [], 0
    while text and (not spans or spans[-1][1] < len(text)):
        end = min(start + size, len(text))
        if end < len(text):
            for sep in C.SEPARATORS:
                places = [k for k in range(start + int(size * 0.7) + 1, end - len(sep) + 1) if text.startswith(sep, k)]
                if places:
                    end = places[-1] + len(sep)
                    break
        spans.append((start, end))
        start = max(end - overlap, start + 1)
    return spans


def test_cut_long_equals_brute_force(spark):
    import random

    rnd = random.Random(2)
    for n in (0, 1, 49, 50, 51, 400):
        text = "".join(rnd.choice("abc 。\n.!? ；") for _ in range(n))
        for size, overlap in ((50, 10), (20, 0), (7, 6)):
            assert C.cut_long(text, size, overlap) == brute_cuts(text, size, overlap)
    docs = [r["text"] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(40).collect()]
    assert all(C.cut_long(t, 300, 40) == brute_cuts(t, 300, 40) for t in docs)


@pytest.mark.parametrize("kind", ["text", "table", "headed", "paged", "slides"])
def test_chunks_of_documents(spark, kind):
    """Every chunk is a span of its text within its size (or one line or a cut of a longer one), chunks are in order, and no word is lost."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", F.lit(kind).alias("format"))
    source = {r["doc_id"]: r["text"] for r in docs.collect()}
    got = {}
    for r in C.chunk_documents(docs, 300, 40).orderBy("doc_id", "idx").collect():
        text = source[r["doc_id"]]
        assert r["content"] == text[r["start_char"] : r["end_char"]] and r["content"].strip()
        assert kind == "table" or len(r["content"]) <= 300 or kind == "slides"
        got.setdefault(r["doc_id"], []).append((r["start_char"], r["end_char"]))
    for i, text in source.items():
        spans = got.get(i, [])
        assert spans == sorted(spans)
        covered = set().union(*[range(a, b) for a, b in spans]) if spans else set()
        assert not [k for k, c in enumerate(text or "") if not c.isspace() and k not in covered]


def test_drop_edges_equals_lines_compared_with_all_rules(spark):
    from corpusmill.functions.text import drop_matching_lines

    rules = [("g", "Head"), ("g", "Page1"), ("g", "ab"), ("h", "Head")]
    texts = ["Head\nbody\nPage 1 of 9", "ab\nabc\nx Head", "He ad\n\n" + "Head" + "x" * 6, "", None, "my Head", "\n", "Head" + "x" * 5]
    docs = spark.createDataFrame([(k, "g", t) for k, t in enumerate(texts)] + [(99, None, "Head"), (98, "h", "Page1\nHead")], "doc_id long, lang string, text string")
    table = spark.createDataFrame(rules, "grp string, line string")
    got = {r["doc_id"]: r["text"] for r in Q.drop_edges(docs, table, "lang").collect()}
    for i, group, text in docs.collect():
        own = F.array(*[F.lit(line) for g, line in rules if g == group]).cast("array<string>")
        want = spark.createDataFrame([(text,)], "t string").select(drop_matching_lines(F.col("t"), own)).first()[0]
        assert got[i] == want


def test_vector_search_by_broadcast_and_by_shuffle(spark, monkeypatch):
    e = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").select(F.col("vec_id").cast("string").alias("chunk_id"), F.col("vec_id").alias("doc_id"), "embedding")
    q = e.where("doc_id % 10 = 0").select(F.col("doc_id").alias("query_id"), "embedding")
    rows = lambda: sorted((r["query_id"], r["chunk_id"], r["rank"]) for r in R.vector_search(e, q, 3, block=4).collect())
    first = rows()
    monkeypatch.setattr(R, "MOST_BLOCKS", 1)
    assert rows() == first


def test_communities_beat_label_propagation(spark):
    """Two cliques with a bridge, a ring of triangles, a lone node: as good as the best partition that is known, and settled."""
    clique = lambda names: [(a, b) for a in names for b in names if a < b]
    pairs = clique("abcde") + clique("fghij") + [("e", "f")]
    pairs += [p for k in range(6) for p in clique([f"t{k}x", f"t{k}y", f"t{k}z"])] + [tuple(sorted((f"t{k}z", f"t{(k + 1) % 6}x"))) for k in range(6)]
    edges = spark.createDataFrame(pairs, "source string, target string")
    nodes = spark.createDataFrame([(i,) for i in sorted({x for p in pairs for x in p} | {"lone"})], "id string")
    found = G.communities(nodes, edges)
    got = {r["id"]: r["cluster"] for r in found.collect()}
    assert {got[x] for x in "abcde"} == {"a"} and {got[x] for x in "fghij"} == {"f"} and got["lone"] == "lone"
    assert all(len({got[f"t{k}{x}"] for x in "xyz"}) == 1 for k in range(6))
    assert G.modularity(edges, found).first()["q"] > 0.7
    assert G.communities(nodes.where("id = 'lone'"), edges.limit(0)).collect()[0]["cluster"] == "lone"
