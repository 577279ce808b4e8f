"""Chat formatting: reply trees to paths, ranked branches, one formatted conversation for each chosen path.

A message is a row (tree, node, parent, role, text, score). Ancestors are found by self-joins that double the distance each
round, so a path of n messages takes log2(n) rounds, and only leaves gather rows: the work grows with the output.

Defined cases: null role or text is empty; a parent that is null or not in its tree makes a root; null score counts 0; of rows
with the same (tree, node) the least (parent, role, text, score) is kept; messages that reach no root (cycles) have no path;
branches of equal score rank by leaf; an empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.llm.common import materialize

OPEN, CLOSE, END = "<|", "|>\n", "</s>\n"


def escape(text: Column) -> Column:
    """Breaks the template's control strings by a backslash; backslashes are doubled, so unescape() gives the text back."""
    text = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    text = F.regexp_replace(text, r"<(\||/?s>)", r"<\\$1")
    text = F.regexp_replace(text, r"\|>", r"|\\>")
    return F.regexp_replace(text, r"\[(/?INST\])", r"[\\$1")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def reply_paths(messages: DataFrame, top_k: int | None = 1) -> DataFrame:
    """(tree, leaf, node, depth): the messages of the top_k root-to-leaf paths of each tree by mean score; None: of all paths. depth: 0 at the root."""
    key = ["tree", "node"]
    nodes = messages.where("node is not null").groupBy(*key).agg(F.min(F.struct("parent", F.coalesce("role", F.lit("")), F.coalesce("text", F.lit("")), F.coalesce("score", F.lit(0.0)).alias("score"))).alias("m"))
    nodes = nodes.select(*key, F.col("m.parent").alias("parent"), F.col("m.score").cast("double").alias("score"))
    known = nodes.select("tree", F.col("node").alias("parent"), F.lit(True).alias("known"))
    nodes = materialize(nodes.join(known, ["tree", "parent"], "left").select(*key, F.when(F.col("known"), F.col("parent")).alias("parent"), "score"), "chat-nodes")
    parents = nodes.where("parent is not null").select("tree", F.col("parent").alias("node")).distinct()
    reach = nodes.join(parents, key, "left_anti").select("tree", F.col("node").alias("leaf"), "node", F.lit(0).cast("long").alias("up"))
    jump = nodes.where("parent is not null").select(*key, F.col("parent").alias("to"))
    longest = nodes.groupBy("tree").count().agg(F.max("count")).first()[0] or 0
    step = 1
    while step < longest:
        further = reach.join(jump, key).select("tree", "leaf", F.col("to").alias("node"), (F.col("up") + step).alias("up"))
        reach = materialize(reach.unionByName(further), "chat-reach")
        step *= 2
        if step < longest:
            ahead = jump.select("tree", F.col("node").alias("to"), F.col("to").alias("next"))
            jump = materialize(jump.join(ahead, ["tree", "to"]).select(*key, F.col("next").alias("to")), "chat-jump")
            if jump.isEmpty():
                break
    along = reach.join(nodes, key)
    rank = Window.partitionBy("tree").orderBy(F.desc("mean_score"), "leaf")
    best = along.groupBy("tree", "leaf").agg(F.avg("score").alias("mean_score"), F.max("up").alias("top"), F.max(F.col("parent").isNull()).alias("rooted")).where("rooted")
    best = best.withColumn("rank", F.row_number().over(rank))
    best = best.where(F.col("rank") <= top_k) if top_k else best
    return reach.join(best, ["tree", "leaf"]).select("tree", "leaf", "rank", "mean_score", "node", (F.col("top") - F.col("up")).alias("depth"))


def format_chats(messages: DataFrame, top_k: int | None = 1, loss_role: str = "assistant") -> DataFrame:
    """(tree, leaf, rank, n_turns, formatted, loss_spans): each chosen path as one text; loss_spans: 0-based start and length, in code points of the escaped text, of each turn of loss_role."""
    body = messages.where("node is not null").groupBy("tree", "node").agg(F.min(F.struct("parent", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))).alias("m"))
    head, said = F.concat(F.lit(OPEN), escape(F.col("m.role")), F.lit(CLOSE)), escape(F.col("m.text"))
    turns = reply_paths(messages, top_k).join(body.select("tree", "node", head.alias("head"), said.alias("said"), (F.col("m.role") == loss_role).alias("loss")), ["tree", "node"])
    turns = turns.withColumn("line", F.concat("head", "said", F.lit(END)))
    path = ["tree", "leaf", "rank"]
    before = Window.partitionBy(*path).orderBy("depth").rowsBetween(Window.unboundedPreceding, -1)
    turns = turns.withColumn("start", F.coalesce(F.sum(F.length("line")).over(before), F.lit(0)) + F.length("head"))
    whole = turns.groupBy(*path).agg(F.array_sort(F.collect_list(F.struct("depth", "line", "start", F.length("said").alias("n"), "loss"))).alias("turns"))
    masked = F.transform(F.filter("turns", lambda t: t.loss), lambda t: F.struct(t.start.cast("long").alias("start"), t.n.cast("long").alias("n")))
    return whole.select(*path, F.size("turns").cast("long").alias("n_turns"), F.array_join(F.transform("turns", lambda t: t.line), "").alias("formatted"), masked.alias("loss_spans"))


def read_turns(formatted: Column) -> Column:
    """Array of (role, text) read back from a formatted conversation."""
    turn = r"(?s)<\|(.*?)\|>\n(.*?)</s>\n"
    roles, texts = (F.regexp_extract_all(formatted, F.lit(turn), F.lit(k)) for k in (1, 2))
    return F.zip_with(roles, texts, lambda r, t: F.struct(unescape(r).alias("role"), unescape(t).alias("text")))


def under_mask(formatted: Column, spans: Column) -> Column:
    """The unescaped texts under the loss mask, one after the other."""
    return F.array_join(F.transform(spans, lambda s: unescape(F.substring(formatted, s.start.cast("int") + 1, s.n.cast("int")))), "")


def turns_as_messages(conversations: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text) as reply chains: turns by turn, role and text, each the parent of the next, so repeated turns stay."""
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), F.col("role").asc_nulls_first(), F.col("text").asc_nulls_first())
    rows = conversations.select("conv_id", "turn", "role", "text").withColumn("node", F.row_number().over(order).cast("long"))
    tree = F.coalesce(F.concat(F.lit("c"), F.col("conv_id").cast("string")), F.lit("null"))
    return rows.select(tree.alias("tree"), "conv_id", "node", F.when(F.col("node") > 1, F.col("node") - 1).alias("parent"), "role", "text", F.lit(0.0).alias("score"))
