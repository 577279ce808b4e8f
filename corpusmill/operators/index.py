"""A written inverted index, and BM25 over it that skips what cannot reach the k best.

Tables of the index: blocks (bucket, token, class, part, least, n, postings), dealt to folders by bucket, a hash of the token; terms (token, bucket, df, least, parts);
chunks (chunk_id, doc_id, length, tokens). A block holds a token's postings of one class of chunk lengths; a token of more than
HOT postings is salted into parts by chunk. A chunk's score is part(length) times the summed idf of the query's tokens in it, as a token counts once
a chunk, so with a query's tokens ordered from rare to common and `rest` the idf of a token and all after it, a chunk whose first token is t has at most
part(length) * rest(t). search() finds a threshold from the rarest tokens' chunks, and then reads only blocks, and of these only postings, that may reach it.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusmill.functions import text as X
from corpusmill.operators.retrieve import K1, B, spread_tokens, token_weight, top_k
from corpusmill.sources.sinks import sized, written

#: Folders of blocks, width of a class of lengths, postings of a token beyond which it is salted, files that a bucket's parts are dealt to.
BUCKETS, CLASS, HOT, SALTS = 32, 16, 50_000, 4
#: Scores are ranked at six places.
SLACK = 1e-5

Tokenizer = Callable[[Column], Column]


@dataclass(frozen=True)
class TextIndex:
    blocks: DataFrame
    terms: DataFrame
    chunks: DataFrame
    tokenizer: Tokenizer

    def postings(self) -> DataFrame:
        """All postings as (token, chunk_id, doc_id, tf, length)."""
        return spread_tokens(self.chunks)

    def lengths(self) -> DataFrame:
        return self.chunks.where("length > 0").select("chunk_id", "length")


def build(chunks: DataFrame, path: str, tokenizer: Tokenizer = X.tokens, buckets: int = BUCKETS, hot: int = HOT) -> TextIndex:
    """Writes the index of chunks (chunk_id, doc_id, content) under path. tokenizer: a text column's distinct tokens; queries go through the same one."""
    rows = chunks.select("chunk_id", "doc_id", tokenizer(F.col("content")).alias("tokens"))
    rows.withColumn("length", F.coalesce(F.size("tokens"), F.lit(0)).cast("long")).write.parquet(f"{path}/chunks")
    every = chunks.sparkSession.read.parquet(f"{path}/chunks")
    # The tokens are read from a table, so that exploding them does not work them out again.
    spread = every.select(F.explode("tokens").alias("token"), "chunk_id", "doc_id", "length")
    counted = spread.groupBy("token").agg(F.count("*").alias("df"), F.min("length").alias("least"))
    counted.withColumns({"parts": F.ceil(F.col("df") / hot), "bucket": _bucket(buckets)}).write.parquet(f"{path}/terms")
    terms = chunks.sparkSession.read.parquet(f"{path}/terms")
    salted = sized(written(terms.where("parts > 1").select("token", "parts"), "index-hot"), 200_000)
    keyed = spread.join(salted, "token", "left").withColumns({"bucket": _bucket(buckets)} | block_keys(F.coalesce("parts", F.lit(1))))
    # Dealt once by what the blocks' keys determine, so grouping shuffles no more.
    dealt = keyed.withColumn("salt", F.pmod(F.hash("class", "part"), F.lit(SALTS))).repartition("bucket", "salt")
    blocks = dealt.groupBy("bucket", "salt", "token", "class", "part").agg(F.min("length").alias("least"), F.count("*").alias("n"), F.collect_list(F.struct("chunk_id", "doc_id", "length")).alias("postings"))
    blocks.drop("salt").sortWithinPartitions("bucket", "token", "least").write.partitionBy("bucket").parquet(f"{path}/blocks")
    return open_index(chunks.sparkSession, path, tokenizer)


def open_index(spark: SparkSession, path: str, tokenizer: Tokenizer = X.tokens) -> TextIndex:
    terms, chunks = (spark.read.parquet(f"{path}/{t}") for t in ("terms", "chunks"))
    kinds = dict(chunks.dtypes)
    # Named, as an empty table of folders tells none.
    blocks = f"token string, class long, part long, least long, n long, postings array<struct<chunk_id: {kinds['chunk_id']}, doc_id: {kinds['doc_id']}, length: long>>, bucket int"
    return TextIndex(spark.read.schema(blocks).parquet(f"{path}/blocks"), terms, chunks, tokenizer)


def _bucket(buckets: int) -> Column:
    return F.pmod(F.xxhash64("token"), F.lit(buckets)).cast("int")


def block_keys(parts: Column) -> dict[str, Column]:
    """Columns that tell, beside the token, the block of a posting (chunk_id, length)."""
    return {"class": F.floor(F.col("length") / CLASS), "part": F.pmod(F.xxhash64("chunk_id"), parts)}


def search(index: TextIndex, queries: DataFrame, k: int = 10, k1: float = K1, b: float = B) -> DataFrame:
    """The k best chunks of each query, as retrieve.bm25 over all postings gives them."""
    return Search(index, queries, k, k1, b).run()


class Search:
    """One run of search(): its steps as tables, so that what was read can be counted."""

    def __init__(self, index: TextIndex, queries: DataFrame, k: int, k1: float = K1, b: float = B) -> None:
        self.index, self.k = index, k
        self.n, mean = index.lengths().agg(F.count("*"), F.avg("length")).first()
        self.part = lambda length: F.lit(k1 + 1.0) / (1 + k1 * (1 - b + b * length / F.lit(mean or 1.0)))
        asked = queries.select("query_id", F.explode_outer(index.tokenizer(F.col("query"))).alias("token")).where("token is not null")
        asked = written(asked, "asked-tokens")
        words = sized(written(asked.select("token").distinct(), "asked-words"), 200_000)
        known = index.terms.join(words, "token", "left_semi")
        idf = F.greatest(F.lit(0.0), F.log((F.lit(float(self.n)) - F.col("df") + F.lit(0.5)) / (F.col("df") + F.lit(0.5)) + 1)) * token_weight(F.lit(float(self.n)))
        known = written(known.select("token", "bucket", "df", "least", "parts", idf.alias("idf")), "asked-terms")
        order = Window.partitionBy("query_id").orderBy(F.desc("idf"), "token")
        rest, before = F.sum("idf").over(order.rowsBetween(0, Window.unboundedFollowing)), F.sum("df").over(order.rowsBetween(Window.unboundedPreceding, -1))
        terms = asked.join(known, "token").withColumns({"rest": rest, "before": F.coalesce(before, F.lit(0))})
        self.terms = written(terms, "asked-ranked")

    def _met(self, terms: DataFrame, may: Column) -> DataFrame:
        """(query_id, chunk_id, doc_id, length, idf) of the postings of terms for which may holds, tested on whole blocks (least) before their postings (length)."""
        blocks = self.index.blocks.withColumnRenamed("least", "length")
        met = sized(terms, 200_000).join(blocks.select("bucket", "token", "length", "postings"), ["bucket", "token"]).where(may)
        return met.drop("length").withColumn("p", F.explode("postings")).select("*", "p.chunk_id", "p.doc_id", "p.length").where(may).select("query_id", "chunk_id", "doc_id", "length", "idf")

    def _scored(self, found: DataFrame) -> DataFrame:
        """Whole scores of found (query_id, chunk_id, doc_id, length), read from those blocks alone that may hold one of them."""
        keys = block_keys(F.col("parts"))
        wanted = found.join(self.terms.select("query_id", "token", "bucket", "idf", "parts"), "query_id").withColumns(keys)
        wanted = written(wanted.select("query_id", "chunk_id", "doc_id", "length", "token", "bucket", "idf", *keys), "asked-pairs")
        places = written(wanted.select("bucket", "token", "class", "part").distinct(), "asked-blocks")
        held = self.index.blocks.join(sized(places, 500_000), ["bucket", "token", "class", "part"], "left_semi").select("token", F.explode("postings.chunk_id").alias("chunk_id"))
        hits = held.join(wanted, ["token", "chunk_id"])
        return hits.groupBy("query_id", "chunk_id", "doc_id").agg((F.sum("idf") * F.first(self.part(F.col("length")))).alias("score"))

    def threshold(self) -> DataFrame:
        """(query_id, bound): a score that the k-th best chunk has at least. It is that of the best of the chunks with the rarest tokens."""
        heads = written(self.terms.where(F.col("before") < max(20 * self.k, 200)), "asked-heads")
        first = self._met(heads, F.lit(True)).groupBy("query_id", "chunk_id", "doc_id", "length").agg((F.sum("idf") * F.first(self.part(F.col("length")))).alias("score"))
        best = written(top_k(first, self.k).select("query_id", "chunk_id", "doc_id", "length"), "asked-first")
        return self._scored(best).groupBy("query_id").agg(F.when(F.count("*") >= self.k, F.min("score")).otherwise(0.0).alias("bound"))

    def candidates(self) -> DataFrame:
        """(query_id, chunk_id, doc_id, length) of the chunks that may reach the threshold."""
        told = sized(written(self.threshold(), "asked-bound"), 200_000)
        terms = self.terms.join(told, "query_id", "left").withColumn("low", F.coalesce("bound", F.lit(0.0)) - F.lit(SLACK))
        may = self.part(F.col("least")) * F.col("rest") >= F.col("low")
        terms = written(terms.where(may).select("query_id", "bucket", "token", "idf", "rest", "low"), "asked-essential")
        return self._met(terms, self.part(F.col("length")) * F.col("rest") >= F.col("low")).select("query_id", "chunk_id", "doc_id", "length").distinct()

    def run(self) -> DataFrame:
        return top_k(self._scored(written(self.candidates(), "asked-candidates")), self.k)
