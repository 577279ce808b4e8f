"""From results to a context: ordering, budgets, assembly, and the audit of answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.functions import text as X
from corpusmill.functions import vectors as V


def intent(query: Column, greeting: list[str], knowledge: list[str], short: list[str], meta: list[str] = ()) -> Column:
    """greeting, chat or knowledge by ordered rules."""
    q, low = F.trim(query), F.lower(F.trim(query))
    has = lambda c, words: F.lit(False) if not words else c.rlike("|".join(words))
    return F.when(q == "", "chat").when((F.length(q) <= 15) & has(low, greeting), "greeting").when(has(low, list(meta)), "chat").when(has(q, knowledge), "knowledge").when(q.isin(*short), "chat").otherwise("knowledge")


def route_by_prototype(queries: DataFrame, prototypes: DataFrame, strong: Column, least: float = 0.55) -> DataFrame:
    """queries (query_id, intent, embedding) with the intent of the nearest prototype (intent, embedding), if it is near enough and no strong word decides.
    Prototypes are a short fixed list, one row of arrays."""
    few = prototypes.agg(F.collect_list(F.struct(F.col("intent").alias("i"), F.col("embedding").alias("e"))).alias("ps"))
    near = F.array_max(F.transform("ps", lambda p: F.struct(V.cosine(F.col("embedding"), p.e).alias("c"), p.i.alias("i"))))
    rows = queries.join(F.broadcast(few)).withColumn("near", near)
    return rows.withColumn("intent", F.when((F.col("near.c") >= least) & ~strong, F.col("near.i")).otherwise(F.col("intent"))).withColumn("similarity", F.col("near.c")).drop("ps", "near")


def lost_in_middle(results: DataFrame) -> DataFrame:
    """position: ranks 0, 2, 4, ... and then ..., 5, 3, 1 of each query; unchanged for two rows or fewer."""
    n = F.count("*").over(Window.partitionBy("query_id"))
    r = F.col("rank") - 1
    key = F.when((n <= 2) | (r % 2 == 0), r).otherwise(2 * n - r)
    return results.withColumn("position", F.row_number().over(Window.partitionBy("query_id").orderBy(key)))


def fit_budget(results: DataFrame, budget: int, least: int = 50, content: str = "content") -> DataFrame:
    """Rows by score while their tokens fit the budget; the first that does not is cut if over least tokens remain; the rest go."""
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "rank")
    rows = results.withColumn("tokens", X.budget_tokens(F.col(content)))
    rows = rows.withColumn("upto", F.sum("tokens").over(order.rowsBetween(Window.unboundedPreceding, 0))).withColumn("before", F.col("upto") - F.col("tokens"))
    room = F.lit(budget) - F.col("before")
    # Sums only grow, so the first row over the budget is the one whose predecessors fit.
    cut = (F.col("upto") > budget) & (F.col("before") <= budget) & (room > least)
    rows = rows.where((F.col("upto") <= budget) | cut)
    short = F.substring(F.col(content), F.lit(1), F.floor(room / 1.2).cast("int"))
    return rows.withColumn(content, F.when(cut, short).otherwise(F.col(content))).withColumn("was_cut", cut).drop("upto", "before")


def fit_history(turns: DataFrame, budget: int) -> DataFrame:
    """Turns of each conversation from the newest backwards while their tokens fit the budget."""
    back = Window.partitionBy("conv_id").orderBy(F.desc("turn")).rowsBetween(Window.unboundedPreceding, 0)
    rows = turns.withColumn("tokens", X.budget_tokens(F.col("text")))
    return rows.withColumn("upto", F.sum("tokens").over(back)).where(F.col("upto") <= budget).drop("upto")


def compaction(turns: DataFrame, most: int = 24, keep: int = 16, width: int = 300) -> DataFrame:
    """bucket: when a conversation has over most turns, its last keep stay verbatim and the others, cut to width, are to be summarised."""
    w = Window.partitionBy("conv_id")
    old = (F.count("*").over(w) > most) & (F.row_number().over(w.orderBy(F.desc("turn"))) > keep)
    rows = turns.withColumn("bucket", F.when(old, "summary").otherwise("verbatim"))
    return rows.withColumn("text", F.when(F.col("bucket") == "summary", F.substring("text", 1, width)).otherwise(F.col("text")))


def guard_tools(turns: DataFrame, limit: int, marker: str, width: int = 300, notice: str = "\n[cut]") -> DataFrame:
    """In conversations of limit characters or more, long turns with the marker after the first two are cut."""
    total = F.sum(F.length("text")).over(Window.partitionBy("conv_id"))
    place = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn"))
    rows = turns.withColumn("total", total).withColumn("place", place)
    cut = (F.col("total") >= limit) & (F.col("place") > 2) & F.contains("text", F.lit(marker)) & (F.length("text") > width)
    return rows.withColumn("text", F.when(cut, F.concat(F.substring("text", 1, width), F.lit(notice))).otherwise(F.col("text"))).drop("total", "place")


def context_block(results: DataFrame, queries: DataFrame, width: int = 500, hints: dict[str, str] | None = None) -> DataFrame:
    """One text per query: numbered sources with titles and format hints, a notice if confidence is low, and the question."""
    hint = F.coalesce(F.try_element_at(F.create_map(*[F.lit(v) for kv in (hints or {"": ""}).items() for v in kv]), F.col("file_type")), F.lit(""))
    line = F.concat(F.lit("["), F.col("position").cast("string"), F.lit("] source: "), F.coalesce("doc_title", F.lit("")), hint, F.lit("\n"), F.substring("content", 1, width))
    blocks = results.withColumn("line", line).groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("position", "line"))).alias("ls"), F.max("low_confidence").alias("low"))
    body = F.array_join(F.transform("ls", lambda x: x.line), "\n\n")
    notice = F.when(F.col("low"), F.lit("\n\n(low confidence)")).otherwise(F.lit(""))
    return blocks.join(queries, "query_id").select("query_id", F.concat(body, notice, F.lit("\n\nquestion: "), "query").alias("prompt"), F.size("ls").alias("n_sources"))


def audit_answers(answers: DataFrame, sources: DataFrame) -> DataFrame:
    """answers (answer_id, content, n_sources) with kept text, cited sources, confidence and warning; sources (answer_id, n, title, snippet, score)."""
    rows = answers.withColumn("valid", X.valid_citations(F.col("content"), F.col("n_sources"))).withColumn("invalid", X.invalid_citations(F.col("content"), F.col("n_sources")))
    cited = rows.select("answer_id", F.explode("valid").alias("n")).join(sources, ["answer_id", "n"])
    per = cited.groupBy("answer_id").agg(F.count("*").alias("n_cited"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", F.substring("snippet", 1, 150).alias("s")))), lambda x: x.s), " | ").alias("previews"))
    best = sources.groupBy("answer_id").agg(F.max("score").alias("confidence"))
    out = rows.join(per, "answer_id", "left").join(best, "answer_id", "left")
    return out.select("answer_id", X.drop_citations(F.col("content"), F.col("invalid")).alias("content"), F.coalesce("n_cited", F.lit(0)).alias("n_cited"), F.coalesce("previews", F.lit("")).alias("previews"), F.coalesce("confidence", F.lit(0.0)).alias("confidence"), X.citation_warning(F.col("content"), F.col("n_sources")).alias("warning"))


def expand_queries(turns: DataFrame, short: int = 15) -> DataFrame:
    """Short user turns get the end of the last assistant turn; history: the last three turns before, cut and joined."""
    before = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    said = F.last(F.when(F.col("role") == "assistant", F.col("text")), ignorenulls=True).over(before)
    three = F.collect_list(F.substring("text", 1, 120)).over(Window.partitionBy("conv_id").orderBy("turn").rowsBetween(-3, -1))
    rows = turns.withColumn("said", said).withColumn("history", F.array_join(three, " | "))
    expanded = F.when((F.length("text") <= short) & F.col("said").isNotNull(), F.concat_ws(" ", "text", F.right("said", F.lit(60)))).otherwise(F.col("text"))
    return rows.where("role = 'user'").select("conv_id", "turn", expanded.alias("expanded"), "history")
