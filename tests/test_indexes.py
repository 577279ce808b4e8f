"""Written indexes: BM25 with a threshold, vector cells, Hamming blocks, cached answers."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from corpusmill.functions import vectors as V
from corpusmill.operators import best
from corpusmill.operators import cache as H
from corpusmill.operators import forward as W
from corpusmill.operators import index as I
from corpusmill.operators import nearest as N
from corpusmill.operators import quality as Q
from corpusmill.operators import retrieve as R


@pytest.fixture(scope="module")
def corpus(spark):
    rnd = random.Random(1)
    words = [f"w{k}" for k in range(200)]
    text = lambda n: " ".join(rnd.choices(words, [1 / (k + 1) for k in range(200)], k=n))
    rows = [(f"c{k:04d}", k // 3, text(rnd.choice([3, 10, 40, 90]))) for k in range(900)]
    rows += [("x1", 900, None), ("x2", 900, ""), ("x3", 901, "the of"), *((f"y{k}", 902, rows[0][2]) for k in range(15))]
    chunks = spark.createDataFrame(rows, "chunk_id string, doc_id long, content string")
    asked = [(1, text(8)), (2, rows[5][2]), (3, "w0 w1"), (4, "unknown words"), (5, ""), (6, None), (7, rows[0][2]), (8, "w150 w0 w0"), (9, "w199")]
    return chunks, spark.createDataFrame(asked, "query_id long, query string")


def hits(found):
    return sorted((r["query_id"], r["rank"], r["chunk_id"], r["doc_id"], round(r["score"], 5)) for r in found.collect())


def test_search_gives_the_rows_of_bm25(corpus, tmp_path):
    chunks, asked = corpus
    index = I.build(chunks, str(tmp_path / "index"), buckets=5, hot=40)
    assert index.terms.where("parts > 1").count() > 5 and index.blocks.where("n > 300").isEmpty()
    assert index.blocks.agg(F.sum("n")).first()[0] == index.postings().count()
    for k in (1, 4, 10):
        assert hits(I.search(index, asked, k)) == hits(R.bm25(R.postings(chunks), asked, k))
    assert I.search(index, asked.limit(0)).count() == 0
    empty = I.build(chunks.limit(0), str(tmp_path / "empty"))
    assert I.search(empty, asked).count() == 0


def test_forward_index_gives_the_rows_of_bm25(spark, corpus, tmp_path, monkeypatch):
    chunks, asked = corpus
    more = [("z1", 1, "养老服务中心 w1 w2 社区"), ("z2", 2, "老服 服务 w1 and w2 w1 w2 12 ab12"), ("z3", 3, "ﬁne Ｆｕｌｌ é été"), ("z4", 4, "w0 " * 900)]
    chunks = chunks.unionByName(spark.createDataFrame(more, chunks.schema))
    asked = asked.unionByName(spark.createDataFrame([(10, "养老 服务中心 w1 w2"), (11, "fine full ÉTÉ"), (12, "w0 w0 w1 w0"), (13, "老服")], asked.schema))
    index = W.build(chunks, str(tmp_path / "words"))
    postings = R.postings(chunks)
    assert sorted(map(tuple, index.terms().collect())) == sorted(map(tuple, R.token_stats(postings).collect()))
    assert index.info().collect() == R.index_info(postings).collect()
    for k in (1, 4, 10):
        assert hits(W.search(index, asked, k)) == hits(R.bm25(postings, asked, k))
    want = hits(R.bm25(postings, asked, 3))
    monkeypatch.setattr(W, "MOST_ASKED", 30)  # several passes
    monkeypatch.setattr(W, "ROWS", 50)
    monkeypatch.setattr(W, "CELLS", 100)
    assert hits(W.search(index, asked, 3)) == want
    assert W.search(index, asked.limit(0)).count() == 0
    assert W.search(W.build(chunks.limit(0), str(tmp_path / "empty")), asked).count() == 0
    plan = index.chunks._jdf.queryExecution().optimizedPlan().toString()
    assert "words" in plan and "embedding" not in plan


def test_search_scores_fewer_postings(spark, tmp_path):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select(F.col("doc_id").cast("string").alias("chunk_id"), "doc_id", F.col("text").alias("content"))
    asked = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    index = I.build(docs, str(tmp_path / "index"))
    run = I.Search(index, asked, 3)
    every = run.terms.agg(F.sum("df")).first()[0]
    assert run.candidates().count() < every / 8
    assert hits(run.run()) == hits(R.bm25(R.postings(docs), asked, 3))


def test_vector_index(spark, tmp_path):
    rnd = np.random.default_rng(4)
    centres = rnd.normal(size=(12, 16))
    rows = [(str(k), k, (centres[k % 12] + 0.4 * rnd.normal(size=16)).tolist()) for k in range(1500)] + [("zero", -1, [0.0] * 16), ("short", -2, [1.0, 2.0]), ("none", -3, None)]
    vectors = spark.createDataFrame(rows, "chunk_id string, doc_id long, embedding array<double>")
    queries = vectors.where("doc_id between 0 and 1499 and doc_id % 20 = 0").select(F.col("doc_id").alias("query_id"), "embedding")
    index = N.build(vectors, str(tmp_path / "cells"))
    assert index.cells.count() == 1503 and index.probes < len(index.centres) / 2
    exact = R.vector_search(vectors, queries)
    assert N.recall(N.search(index, queries), exact).agg(F.avg("recall")).first()[0] >= 0.9
    # All cells probed: the exact rows.
    whole = N.search(index, queries, probes=len(index.centres))
    key = ["query_id", "rank", "chunk_id"]
    assert sorted(map(tuple, whole.select(*key).collect())) == sorted(map(tuple, exact.select(*key).collect()))


def test_vector_index_of_the_given_table(spark, tmp_path):
    e = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    vectors = e.select(F.col("vec_id").cast("string").alias("chunk_id"), F.col("vec_id").alias("doc_id"), "embedding")
    queries = e.where("vec_id % 10 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    index = N.build(vectors, str(tmp_path / "cells"))
    assert N.recall(N.search(index, queries), R.vector_search(vectors, queries)).agg(F.avg("recall")).first()[0] >= 0.9


def test_vectors_of_any_form_meet_as_before(spark, monkeypatch):
    """Copies, zero, short, null and gapped vectors, by both ways, against the cosine as a column."""
    rnd = random.Random(3)
    own = [[float(rnd.randrange(5)) for _ in range(4)] for _ in range(60)] + [[1.0, 2.0, 0.0, 1.0]] * 300 + [[0.0] * 4, [1.0], [], None, [1.0, None, 2.0, 0.0]]
    vectors = spark.createDataFrame([(f"c{k:04d}", k, v) for k, v in enumerate(own)], "chunk_id string, doc_id long, embedding array<float>").repartition(3)
    queries = vectors.where("doc_id % 9 = 0 or doc_id > 358").select(F.col("doc_id").alias("query_id"), F.col("embedding").alias("q"))
    score = V.distance_score(1 - V.cosine(F.col("embedding"), F.col("q")))
    want = hits(R.top_k(vectors.crossJoin(queries).withColumn("score", score), 7))
    queries = queries.withColumnRenamed("q", "embedding")
    assert hits(R.vector_search(vectors, queries, 7)) == want
    monkeypatch.setattr(R, "MOST_BLOCKS", 1)
    monkeypatch.setattr(best, "GROUP", 100)
    assert hits(R.vector_search(vectors, queries, 7, block=10)) == want
    monkeypatch.setattr(best, "CELLS", 50)
    assert hits(R.vector_search(vectors, queries, 7)) == want


def test_salted_cells(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(N, "PART", 10)
    vectors = spark.createDataFrame([(str(k), k, [1.0, float(k % 2)]) for k in range(100)], "chunk_id string, doc_id long, embedding array<double>")
    index = N.build(vectors, str(tmp_path / "cells"), cells=2)
    assert index.cells.groupBy("cell", "part").count().agg(F.max("count")).first()[0] < 40
    assert N.search(index, spark.createDataFrame([(1, [1.0, 0.0])], "query_id long, embedding array<double>"), 50).count() == 50


@pytest.mark.parametrize(("similarity", "blocks"), [(0.85, 2), (0.85, 3), (0.85, 4), (0.85, 7), (0.92, None), (1.0, None)])
def test_hamming_search_misses_nothing(spark, similarity, blocks):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where("doc_id < 120")
    docs = docs.unionByName(docs.limit(5).withColumn("doc_id", F.col("doc_id") + 1000))
    most = int((1 - similarity) * 64 + 1e-9)
    if blocks == 2:  # tens of thousands of flips a fingerprint
        docs = docs.where("doc_id < 25")
    got = {r["doc_id"]: (r["duplicate_of"], r["distance"]) for r in Q.near_duplicates(docs, similarity, blocks).collect()}
    prints = [(r["doc_id"], (r["h"]["hi"] << 32) | r["h"]["lo"]) for r in docs.select("doc_id", V.simhash(F.col("text")).alias("h")).collect()]
    want = {}
    for i, a in prints:
        near = [((a ^ b).bit_count(), j) for j, b in prints if j < i and (a ^ b).bit_count() <= most]
        if near:
            want[i] = (min(near)[1], min(near)[0])
    assert got == want


def test_tiles_give_the_rows_of_blocks_without_probes(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where("doc_id < 150").select("doc_id", "text")
    docs = docs.unionByName(docs.limit(5).withColumn("doc_id", F.col("doc_id") + 1000))
    rows = lambda found: sorted(map(tuple, found.collect()))
    want = rows(Q.near_duplicates(docs, blocks=4))
    assert want and rows(Q.near_duplicates(docs, tile=20)) == want == rows(Q.near_duplicates(docs))
    named = docs.withColumn("doc_id", F.format_string("d%05d", "doc_id"))
    assert [r[0] for r in rows(Q.near_duplicates(named, tile=20))] == [f"d{r[0]:05d}" for r in want]
    plan = Q.near_duplicates(docs)._jdf.queryExecution().optimizedPlan().toString()
    assert "mask" not in plan and Q.near_duplicates(docs.limit(0)).count() == 0


def test_keys_of_a_fingerprint_stay_few():
    for n in (1, 1000, 10**6, 10**9, 10**12):
        for most in (0, 3, 9, 15):
            cuts = Q.hamming_blocks(most, Q._plan(n, most))
            assert len(cuts) <= 10 and sum(r + 1 for _, _, r in cuts) == most + 1 and sum(b for _, b, _ in cuts) == 64


def test_answers_of_the_cache(spark):
    asked = spark.createDataFrame([(1, "a b", [1.0, 0.0]), (2, "c", [0.0, 1.0]), (3, "c", [0.0, 1.0])], "query_id long, query string, embedding array<double>")
    searched = []

    def search(q):
        searched.append(q.count())
        return q.select("query_id", F.concat(F.lit("c"), "query").alias("chunk_id"))

    nothing = spark.createDataFrame([], "key string, chunk_id string")
    every, entries, found = H.answer(asked.where("query_id = 2"), H.empty(spark), nothing, search, 0.0)
    assert [tuple(r) for r in every.collect()] == [(2, "cc", False)]
    again, new, _ = H.answer(asked, entries, found, search, 10.0)
    assert sorted(map(tuple, again.collect())) == [(1, "ca b", False), (2, "cc", True), (3, "cc", True)]
    assert searched == [1, 1] and new.count() == 1
    late, _, _ = H.answer(asked.where("query_id = 2"), entries, found, search, 5000.0)
    assert late.collect()[0]["cached"] is False


def test_new_entries_replace_old_ones_of_any_time(spark):
    kinds = "key string, ts double, last_access double"
    old = spark.createDataFrame([("a", 6000.0, 1.0), ("b", 7000.0, 2.0), ("c", 5000.0, 3.0), ("d", 1.0, 4.0)], kinds)
    new = spark.createDataFrame([("a", 6000.0, 9.0), ("b", 6000.0, 9.0)], kinds)
    for cache in (old, old.orderBy(F.desc("key")).coalesce(1)):
        assert [tuple(r) for r in H.write(cache, new, 6000.0).collect()] == [("a", 6000.0, 9.0), ("b", 6000.0, 9.0), ("c", 5000.0, 3.0)]


def test_letters_are_counted_in_batches(spark):
    texts = ["abc Zz\n{`", None, "", "İK ÉTÉ ß a\u0301 ａb", "养老a", "z" * 3000, *(chr(97 + k % 26) * k for k in range(1500))]
    rows = spark.createDataFrame(list(enumerate(texts)), "k int, t string").coalesce(1)
    own = F.lower("t")
    slow = F.array(*[(F.length(own) - F.length(F.replace(own, F.lit(c), F.lit("")))).cast("double") for c in "abcdefghijklmnopqrstuvwxyz"])
    for r in rows.select("k", R.letter_embedding(F.col("t")).alias("got"), slow.alias("want")).where("k > -1").collect():
        assert r["got"] == r["want"], texts[r["k"]]
    assert "replace" not in rows.select(R.letter_embedding(F.col("t")))._jdf.queryExecution().optimizedPlan().toString()
    assert R._count_letters(pa.array(["x", "ab", None, "b"]).slice(1)).to_pylist()[0][:3] == [1.0, 1.0, 0.0]
