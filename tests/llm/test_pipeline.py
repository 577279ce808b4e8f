"""The pipeline on the smallest tables: each stage against a brute-force version of its decision."""

import collections

from pyspark.sql import functions as F

import corpus_pipeline as P
from corpusmill.llm import queries

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = P.identify_language(spark, docs, SF)
    assert kept.columns == P.COLUMNS and kept.count() == sum(any(c.isalpha() for c in r["text"] or "") for r in docs.collect())
    good = P.check_quality(spark, kept, SF)
    assert {r["doc_id"] for r in good.collect()} == {r["doc_id"] for r in queries.op9_quality_rules(spark, SF).where("kept").collect()}
    single = P.drop_near_duplicates(spark, good, SF)
    rows = single.collect()
    texts = [r["text"] for r in rows]
    assert len(set(texts)) == len(texts)

    def bag(t):
        w = t.split()
        return collections.Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))

    bags = [bag(t) for t in texts]
    shared = collections.defaultdict(list)
    for k, b in enumerate(bags):
        for e in b:
            shared[e].append(k)
    close = {(i, j) for own in shared.values() if len(own) < 50 for i in own for j in own if i < j}
    assert not [p for p in close if sum((bags[p[0]] & bags[p[1]]).values()) >= 0.8 * sum((bags[p[0]] | bags[p[1]]).values())]
    mixed = P.mix_sources(spark, single, SF)
    size = {r["doc_id"]: len(r["text"].split()) for r in rows}
    n = collections.Counter(r["doc_id"] for r in mixed.collect())
    assert set(n) <= set(size) and max(n.values()) <= 2
    total, got = sum(size.values()), sum(size[i] * k for i, k in n.items())
    assert abs(got - 1.5 * total) < 0.12 * total
    coded = P.tokenize(spark, mixed, SF)
    assert coded.count() == sum(n.values()) and coded.where("n_pieces = 0").count() == 0


def test_run_gives_the_last_stage(spark):
    assert P.run(spark, SF).columns == ["doc_id", "lang", "source", "ids", "n_pieces"]


KINDS = "doc_id long, text string, lang string, source string, n_chars long"


def prose(k, n=60):
    return " ".join(f"word{k}x{i}" for i in range(n))


def odd_rows(spark):
    """A class with a copy of null and one of repeated doc_id, texts that share a doc_id or have none, repeated rows, and clashing columns."""
    near = prose(1) + " end"
    rows = [(1, prose(1)), (None, prose(1)), (1, near), (7, prose(2)), (7, prose(3)), (None, prose(4)), (None, prose(5)), (None, prose(5)), (8, prose(6)), (8, prose(6))]
    frame = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], KINDS)
    return frame.selectExpr("*", "'clash' as id", "'clash' as label", "'clash' as key", "'clash' as k", "'clash' as text_key", "'clash' as row_key", "'clash' as times")


def test_near_duplicates_and_mixing_keep_odd_rows(spark):
    odd = odd_rows(spark)
    kept = P.drop_near_duplicates(spark, odd, SF)
    rows = [(r["doc_id"], r["text"]) for r in kept.collect()]
    assert kept.columns == P.COLUMNS and len(rows) == 6
    assert collections.Counter(i for i, _ in rows) == {1: 1, 7: 2, None: 2, 8: 1}
    assert {t for i, t in rows if i != 1} == {prose(k) for k in (2, 3, 4, 5, 6)}
    mixed = P.mix_sources(spark, kept, SF)
    taken = collections.Counter((r["doc_id"], r["text"]) for r in mixed.collect())
    assert mixed.columns == P.COLUMNS and set(taken) == set(rows) and max(taken.values()) <= 2 and sum(taken.values()) == 9
    again = collections.Counter(r["text"] for r in P.mix_sources(spark, odd, SF).collect())
    assert sum(again.values()) == 15 and again[prose(5)] >= 2 and again[prose(2)] >= 1
    for stage in (P.drop_near_duplicates, P.mix_sources):
        assert stage(spark, odd.limit(0), SF).count() == 0


def test_language_decides(spark):
    """A text of no given language in an unlearned script goes, and the predicted language replaces a wrong or missing one."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").select(*P.COLUMNS)
    text = docs.where("lang = 'de'").orderBy(F.desc(F.length("text")), "doc_id").first()["text"]
    unknown = " ".join(chr(0x10D0 + (7 * i + i * i) % 33) + chr(0x10D0 + 5 * i % 33) + chr(0x10D0 + i * i * i % 33) + chr(0x10D0 + i % 31) for i in range(400))
    more = spark.createDataFrame([(-1, text, "en", "s", 0), (-2, text, None, "s", 0), (-3, unknown, None, "s", 0), (-4, "12 34", "en", "s", 0)], KINDS)
    more = more.union(spark.createDataFrame([(None, unknown + " " + unknown, None, "s", 0)], KINDS))
    kept = P.identify_language(spark, docs.unionByName(more), SF)
    assert kept.columns == P.COLUMNS
    assert {r["doc_id"]: r["lang"] for r in kept.where("doc_id < 0").collect()} == {-1: "de", -2: "de"}
    assert kept.where("doc_id is null").count() == 0
    assert kept.where("doc_id >= 0").count() == docs.where(F.col("text").rlike(r"\p{L}")).count()


def test_quality_stage_uses_every_labelled_document(spark, tmp_path):
    """30,000 labelled documents, of which a third, told by a hash of the id, have symbols: the stage keeps them."""
    text = " ".join(f"word{k}" for k in range(60))
    place = F.xxhash64("doc_id").bitwiseAND(F.lit((1 << 30) - 1)) / F.lit(float(1 << 30))
    docs = spark.range(30_000, numPartitions=8).select(F.col("id").alias("doc_id"), F.lit("en").alias("lang"), F.lit("a").alias("source"), F.lit(0).alias("n_chars"))
    docs = docs.withColumn("text", F.concat(F.lit(text), F.when(place >= 0.67, " #" * 30).otherwise("")))
    docs.select("doc_id", F.lit(1).alias("quality")).write.parquet(f"{tmp_path}/labels.parquet")
    kept = P.check_quality(spark, docs, str(tmp_path))
    assert kept.columns == P.COLUMNS and kept.count() >= 0.98 * 30_000
