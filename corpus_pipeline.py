"""A corpus pipeline: language ID, quality rules, near-duplicate removal, mixing, tokenisation.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before kept; its result is written as Parquet and read again.
All stages but the last return the columns of documents.

Defined cases, for every stage: an empty table gives no rows; extra columns are dropped, whatever their names; whole texts are read, however long; a null or
repeated doc_id is carried and decides nothing but order; repeated rows are judged alike. Nulls: a null text goes with language ID; in the
later stages it has no word, so it fails the base rule, is a copy of other texts without words, has size 0 and is never taken, and has no piece. A null
source is a source of its own, a null lang a stratum of its own, a null n_chars is only carried. Ties: the first language by code point, a measure equal to its cutoff
passes, the least doc_id and then the least text key stands for its class, equal sampling keys go by doc_id, size and row key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusmill.llm import langid, mixing, neardup, pieces, quality
from corpusmill.llm.common import materialize, table
from corpusmill.llm.queries import label_weights

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a language go: those of null text or without a letter, and those whose n-grams are no more known than by chance.

    lang becomes the predicted language, by which the quality rules are stratified. If nothing could be learned, all documents go."""
    rows = langid.identify(docs.select(*COLUMNS), keep=("text", "source", "n_chars"), evidence=True)
    return rows.where("lang_pred <> 'und' and evidence").withColumnRenamed("lang_pred", "lang").select(*COLUMNS)


def check_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rule or a calibrated rule go."""
    rows = quality.assess(docs.select(*COLUMNS), table(spark, sf_dir, "labels"), keep=("text", "lang", "source", "n_chars"))
    return rows.where("kept").select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near-duplicate texts one row stays: that of the least doc_id, a null one counting last, and of the least text key.

    Texts of other classes stay, whether their doc_id is null or repeated."""
    _, texts = neardup.text_classes(docs.select("doc_id", "text"))
    told = texts.groupBy("label").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("least"), F.col("id").alias("key"))).alias("t")).select("t.key", "t.least")
    told = materialize(told, "dup-kept")
    keyed = docs.select(*COLUMNS, neardup.text_key().alias("text_key"))
    kept = keyed.join(told, (F.col("text_key") == F.col("key")) & F.col("doc_id").cast("long").eqNullSafe(F.col("least")), "left_semi")
    first = Window.partitionBy("text_key").orderBy("doc_id", "text", "lang", "source", "n_chars")
    return kept.withColumn("k", F.row_number().over(first)).where("k = 1").select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row as often as the mix takes it; rows are told apart by all their columns, so that null and repeated ids do not meet."""
    keyed = docs.select(*COLUMNS, F.md5(F.to_json(F.struct("doc_id", "lang", "source", "n_chars", F.md5("text").alias("text")))).alias("row_key"))
    told = mixing.mix(keyed.select("doc_id", "text", "source", "row_key"), quality=label_weights(table(spark, sf_dir, "labels")), row_key="row_key")
    times = told.where("taken > 0").groupBy("row_key").agg(F.sum(F.col("taken") / F.col("size")).cast("int").alias("times"))  # identical rows together
    times = materialize(times, "mix-times")
    return keyed.join(times, "row_key").dropDuplicates(["row_key"]).select(*COLUMNS, F.explode(F.sequence(F.lit(1), F.col("times"))).alias("k")).select(*COLUMNS)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as ids of pieces."""
    rows = pieces.encode(docs.select(*COLUMNS), pieces.load(), keep=("lang", "source"))
    return rows.select("doc_id", "lang", "source", "ids", F.size("ids").cast("long").alias("n_pieces"))


STAGES = [
    ("language ID", identify_language),
    ("quality rules", check_quality),
    ("MinHash near-dedup", drop_near_duplicates),
    ("mixing sources", mix_sources),
    ("SentencePiece encoding", tokenize),
]

#: SQL can express neither the calibrated rules nor the signatures; the pipeline is tested against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
