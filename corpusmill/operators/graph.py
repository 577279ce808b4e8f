"""An undirected entity graph as two tables: nodes (id, label, type, doc_count, doc_ids) and edges (source, target, relation, doc_id)."""

from __future__ import annotations

from itertools import count

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.sources.sinks import written

ENTITY_TYPES = ["document", "region", "agency", "topic"]


def build(extractions: DataFrame, types: list[str] = ENTITY_TYPES, relations: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """From rows (seq, doc_id, doc_title, entities array<name, type>, relations array<source, target, relation>): a node's type is the first it
    was given, endpoints without an entity are topics; of an edge's relations the last holds. Groups keep sets of documents by first and count, not lists."""
    rows = extractions.where("doc_title is not null")
    named = rows.select("seq", "doc_id", F.col("doc_title").alias("id"), F.lit("document").alias("type"), F.lit(0).alias("rank"))
    entities = rows.select("seq", "doc_id", F.explode("entities").alias("e")).select("seq", "doc_id", F.col("e.name").alias("id"), F.col("e.type").alias("type"), F.lit(1).alias("rank")).where(F.col("type").isin(types))
    links = rows.select("seq", "doc_id", F.posexplode("relations").alias("pos", "r")).select("seq", "pos", "doc_id", "r.*")
    links = links if relations is None else links.where(F.col("relation").isin(relations))
    ends = links.select("seq", "doc_id", F.explode(F.array("source", "target")).alias("id"), F.lit("topic").alias("type"), F.lit(2).alias("rank"))
    seen = named.unionByName(entities).unionByName(ends).where("id is not null and id <> ''")
    nodes = seen.groupBy("id").agg(F.min_by("type", F.struct("rank", "seq")).alias("type"), F.count_distinct("doc_id").alias("doc_count"), F.min("doc_id").alias("first_doc"))
    edges = links.where("source <> target").groupBy(F.least("source", "target").alias("source"), F.greatest("source", "target").alias("target")).agg(F.max_by(F.struct("relation", "doc_id"), F.struct("seq", "pos")).alias("r"))
    return nodes.withColumn("label", F.col("id")), edges.select("source", "target", "r.relation", "r.doc_id")


def degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    ends = edges.select(F.explode(F.array("source", "target")).alias("id")).groupBy("id").agg(F.count("*").alias("degree"))
    return nodes.join(ends, "id", "left").withColumn("degree", F.coalesce("degree", F.lit(0)))


def search_nodes(nodes: DataFrame, edges: DataFrame, keyword: str = "", kind: str | None = None) -> DataFrame:
    """Nodes of a type whose id or label has the keyword in any case, with their degree."""
    hits = nodes.where(F.contains(F.lower("id"), F.lit(keyword.lower())) | F.contains(F.lower("label"), F.lit(keyword.lower())))
    return degrees(hits if kind is None else hits.where(F.col("type") == kind), edges)


def neighbours(nodes: DataFrame, edges: DataFrame, name: str) -> DataFrame:
    """Nodes that share an edge with the named one, with the relation."""
    out = edges.where(F.col("source") == name).select(F.col("target").alias("id"), "relation")
    back = edges.where(F.col("target") == name).select(F.col("source").alias("id"), "relation")
    return out.unionByName(back).join(nodes, "id").select("id", "type", "relation")


def similar_names(nodes: DataFrame, name: str, limit: int = 10) -> DataFrame:
    """What to offer when a name is unknown."""
    return nodes.where(F.contains(F.lower("id"), F.lit(name.lower()))).orderBy("id").limit(limit)


def stats(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(kind, name, n): totals, nodes by type, edges by relation."""
    count = lambda df, kind, name: df.groupBy(name.alias("name")).agg(F.count("*").alias("n")).select(F.lit(kind).alias("kind"), "name", "n")
    return count(nodes, "nodes", F.lit("all")).unionByName(count(edges, "edges", F.lit("all"))).unionByName(count(nodes, "type", F.col("type"))).unionByName(count(edges, "relation", F.col("relation")))


def delete_node(nodes: DataFrame, edges: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
    return nodes.where(F.col("id") != name), edges.where((F.col("source") != name) & (F.col("target") != name))


def rename_node(nodes: DataFrame, edges: DataFrame, old: str, new: str) -> tuple[DataFrame, DataFrame, bool]:
    """Both tables with the new name, and whether it was free; the same name is accepted and changes nothing."""
    if old == new:
        return nodes, edges, True
    if nodes.where(F.col("id").isin(new)).limit(1).count() or not nodes.where(F.col("id") == old).limit(1).count():
        return nodes, edges, False
    to = lambda c: F.when(F.col(c) == old, F.lit(new)).otherwise(F.col(c))
    renamed = edges.withColumns({"source": to("source"), "target": to("target")})
    renamed = renamed.withColumns({"source": F.least("source", "target"), "target": F.greatest("source", "target")})
    return nodes.withColumns({"id": to("id"), "label": to("label")}), renamed, True


def not_in_graph(docs: DataFrame, edges: DataFrame, key: str = "doc_id") -> DataFrame:
    """Documents from which no edge comes."""
    return docs.join(edges.select(F.col("doc_id").alias(key)).distinct(), key, "left_anti")


def connected_parts(links: DataFrame, labels: DataFrame) -> DataFrame:
    """(a, part): the parts of each community of labels (a, c) that links (a, b), in both directions, hold together; part is the least node in it."""
    to = labels.select(F.col("a").alias("b"), F.col("c").alias("d"))
    inside = written(links.where("a <> b").join(labels.select("a", "c"), "a").join(to, "b").where("c = d").select("a", "b"), "graph-inside")
    parts = written(labels.select("a", F.col("a").alias("part")), "graph-parts")
    while True:
        near = inside.join(parts.select(F.col("a").alias("b"), "part"), "b").groupBy("a").agg(F.min("part").alias("seen"))
        told = parts.join(near, "a", "left").select("a", F.least("part", F.coalesce("seen", "part")).alias("part"), F.col("part").alias("old"))
        jump = told.select(F.col("a").alias("part"), F.col("part").alias("further"))
        told = written(told.join(jump, "part").select("a", F.least("part", "further").alias("part"), "old"), "graph-parts")
        parts = told.select("a", "part")
        if told.where("part < old").isEmpty():
            return parts


def communities(nodes: DataFrame, edges: DataFrame, enough: float = 1e-4) -> DataFrame:
    """(id, cluster): communities of high modularity by local moves, cluster being the least id in it.

    In each round the half of the groups that a hash picks move to the neighbouring community where modularity gains most, if it gains at all
    (of two single groups, one to the other alone), all at once. When a round gains less than enough, communities that are not connected are split
    (which never lowers modularity), each becomes one group with the sums of its edges, and the moves go on among these until none gains. Nodes without
    edges stay alone. The best state seen is kept.
    Each round's labels are a written table; a hub's edges are summed by community before they meet."""
    both = edges.where("source <> target").select(F.col("source").alias("a"), F.col("target").alias("b"))
    links = written(both.unionByName(both.select(F.col("b").alias("a"), F.col("a").alias("b"))).groupBy("a", "b").agg(F.count("*").cast("double").alias("w")), "graph-links")
    total = links.agg(F.sum("w")).first()[0]
    belongs = nodes.select("id", F.col("id").alias("group"))
    while total:
        weight = written(links.groupBy("a").agg(F.sum("w").alias("k")), "graph-weights")
        labels, best, found = weight.select("a", F.col("a").alias("c"), "k"), _quality(links, weight.select("a", F.col("a").alias("c"), "k"), total), None
        for turn in count():
            sums = labels.groupBy("c").agg(F.sum("k").alias("sum"), F.count("*").alias("n"))
            toward = links.where("a <> b").join(labels.select(F.col("a").alias("b"), "c"), "b").groupBy("a", "c").agg(F.sum("w").alias("w"))
            toward = toward.unionByName(labels.select("a", "c", F.lit(0.0).alias("w"))).groupBy("a", "c").agg(F.sum("w").alias("w"))
            own = labels.join(sums.select("c", F.col("n").alias("size")), "c").select("a", F.col("c").alias("own"), "k", "size")
            options = toward.join(own, "a").join(sums, "c")
            gain = F.col("w") - F.col("k") * (F.col("sum") - F.when(F.col("c") == F.col("own"), F.col("k")).otherwise(0.0)) / total
            may = (F.col("c") == F.col("own")) | ((F.pmod(F.xxhash64("a", F.lit(turn)), F.lit(2)) == 0) & ~((F.col("size") == 1) & (F.col("n") == 1) & (F.col("c") > F.col("own"))))
            rank = F.struct((-F.round(gain, 9)).alias("loss"), (F.col("c") != F.col("own")).alias("other"), "c")
            moved = options.where(may).groupBy("a", "k").agg(F.min_by("c", rank).alias("c"))
            labels = written(moved.select("a", "c", "k"), "graph-labels")
            now = _quality(links, labels, total)
            done = now < best + enough and turn > 0
            if now > best:
                best, found = now, labels
            if done:
                break
        if found is None:
            break
        to = connected_parts(links, found).select(F.col("a").alias("group"), F.col("part").alias("c"))
        belongs = written(belongs.join(to, "group", "left").select("id", F.coalesce("c", "group").alias("group")), "graph-groups")
        ends = links.join(to.select(F.col("group").alias("a"), F.col("c").alias("x")), "a").join(to.select(F.col("group").alias("b"), F.col("c").alias("y")), "b")
        links = written(ends.groupBy(F.col("x").alias("a"), F.col("y").alias("b")).agg(F.sum("w").alias("w")), "graph-links")
    return belongs.join(belongs.groupBy("group").agg(F.min("id").alias("cluster")), "group").select("id", "cluster")


def _quality(links: DataFrame, labels: DataFrame, total: float) -> float:
    """Modularity of labels (a, c, k) over links (a, b, w) in both directions."""
    ends = links.join(labels.select("a", F.col("c").alias("x")), "a").join(labels.select(F.col("a").alias("b"), F.col("c").alias("y")), "b")
    inside = ends.where("x = y").agg(F.coalesce(F.sum("w"), F.lit(0.0))).first()[0]
    squares = labels.groupBy("c").agg(F.sum("k").alias("s")).agg(F.sum(F.pow("s", F.lit(2.0)))).first()[0]
    return inside / total - squares / total**2


def modularity(edges: DataFrame, clusters: DataFrame) -> DataFrame:
    """One row with Q = sum over clusters of inside / m - (degree / 2m)^2."""
    a, b = clusters.select(F.col("id").alias("source"), F.col("cluster").alias("ca")), clusters.select(F.col("id").alias("target"), F.col("cluster").alias("cb"))
    e = edges.join(a, "source").join(b, "target")
    inside = e.groupBy(F.col("ca").alias("cluster")).agg(F.count_if(F.col("ca") == F.col("cb")).alias("inside"))
    degree = e.select(F.explode(F.array("ca", "cb")).alias("cluster")).groupBy("cluster").agg(F.count("*").alias("degree"))
    m = edges.agg(F.count("*").cast("double").alias("m"))
    rows = degree.join(inside, "cluster", "left").join(F.broadcast(m))  # one row
    return rows.agg(F.round(F.sum(F.coalesce("inside", F.lit(0)) / F.col("m") - F.pow(F.col("degree") / (2 * F.col("m")), F.lit(2))), 6).alias("q"))


def elements(nodes: DataFrame, edges: DataFrame, colours: dict[str, str]) -> DataFrame:
    """What a drawing needs of each node: colour by type, size and font by degree."""
    d = degrees(nodes, edges)
    colour = F.coalesce(F.try_element_at(F.create_map(*[F.lit(v) for kv in colours.items() for v in kv]), F.col("type")), F.lit("#888888"))
    ln: Column = F.log(F.col("degree") + 1)
    return d.select("id", "type", "degree", colour.alias("colour"), F.round(8 + 12 * ln, 6).alias("size"), F.least(F.lit(24), F.greatest(F.lit(10), 10 + F.floor(5 * ln))).cast("int").alias("font"))
