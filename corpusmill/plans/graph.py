"""Queries over the entity graph of documents, and over file snapshots."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusmill.operators import graph as G
from corpusmill.operators import quality as Q
from corpusmill.operators import store as S
from corpusmill.operators import sync as Y
from corpusmill.plans.base import CHUNKS, DOCS, chunks, docs, query, table
from corpusmill.plans.corpus import CHECK_SQL


def graph(spark, sf):
    """Documents with a region (language) and an agency (source)."""
    entity = lambda name, kind: F.struct(F.col(name).alias("name"), F.lit(kind).alias("type"))
    link = lambda a, b, r: F.struct(a.alias("source"), b.alias("target"), F.lit(r).alias("relation"))
    title = F.concat(F.lit("doc"), F.col("doc_id").cast("string"))
    rows = table(spark, sf, "documents").select(F.col("doc_id").alias("seq"), "doc_id", title.alias("doc_title"), F.array(entity("lang", "region"), entity("source", "agency")).alias("entities"), F.array(link(title, F.col("lang"), "published_in"), link(title, F.col("source"), "published_by"), link(F.col("source"), F.col("lang"), "works_in")).alias("relations"))
    return G.build(rows)


GRAPH = """nodes AS (SELECT 'doc' || doc_id AS id, 'document' AS type, CAST(1 AS BIGINT) AS doc_count, doc_id AS first_doc FROM documents UNION ALL SELECT lang, 'region', count(*), min(doc_id) FROM documents GROUP BY lang UNION ALL SELECT source, 'agency', count(*), min(doc_id) FROM documents GROUP BY source),
e0 AS (SELECT doc_id AS seq, 0 AS pos, 'doc' || doc_id AS a, lang AS b, 'published_in' AS relation FROM documents UNION ALL SELECT doc_id, 1, 'doc' || doc_id, source, 'published_by' FROM documents UNION ALL SELECT doc_id, 2, source, lang, 'works_in' FROM documents),
edges AS (SELECT least(a, b) AS source, greatest(a, b) AS target, arg_max(relation, seq * 10 + pos) AS relation, arg_max(seq, seq * 10 + pos) AS doc_id FROM e0 GROUP BY ALL),
degree AS (SELECT id, count(*) AS degree FROM (SELECT source AS id FROM edges UNION ALL SELECT target FROM edges) GROUP BY id)"""


@query("g1_nodes", f"WITH {GRAPH} SELECT id, type, doc_count, first_doc FROM nodes")
def g1(spark, sf):
    return graph(spark, sf)[0].select("id", "type", "doc_count", "first_doc")


@query("g1_g3_edges", f"WITH {GRAPH} SELECT * FROM edges")
def g3(spark, sf):
    return graph(spark, sf)[1]


@query("g2_delete_and_rename", f"WITH {GRAPH} SELECT least(CASE source WHEN 'en' THEN 'english' ELSE source END, CASE target WHEN 'en' THEN 'english' ELSE target END) AS source, greatest(CASE source WHEN 'en' THEN 'english' ELSE source END, CASE target WHEN 'en' THEN 'english' ELSE target END) AS target, relation FROM edges WHERE source <> 'src0' AND target <> 'src0'")
def g2(spark, sf):
    nodes, edges = G.delete_node(*graph(spark, sf), "src0")
    return G.rename_node(nodes, edges, "en", "english")[1].select("source", "target", "relation")


@query("f11_search_nodes", f"WITH {GRAPH} SELECT id, type, coalesce(degree, 0) AS degree FROM nodes LEFT JOIN degree USING (id) WHERE contains(id, 'src1') AND type = 'agency'")
def f11(spark, sf):
    return G.search_nodes(*graph(spark, sf), "SRC1", "agency").select("id", "type", "degree")


@query("j11_neighbours", f"WITH {GRAPH} SELECT id, type, relation FROM (SELECT target AS id, relation FROM edges WHERE source = 'src3' UNION ALL SELECT source, relation FROM edges WHERE target = 'src3') JOIN nodes USING (id)")
def j11(spark, sf):
    return G.neighbours(*graph(spark, sf), "src3")


@query("j12_not_in_graph", "SELECT doc_id FROM documents WHERE lang = 'es'")
def j12(spark, sf):
    edges = table(spark, sf, "documents").where("lang <> 'es'").select("doc_id")
    return G.not_in_graph(table(spark, sf, "documents").select("doc_id"), edges)


@query("a17_graph_stats", f"WITH {GRAPH} SELECT 'nodes' AS kind, 'all' AS name, count(*) AS n FROM nodes UNION ALL SELECT 'edges', 'all', count(*) FROM edges UNION ALL SELECT 'type', type, count(*) FROM nodes GROUP BY type UNION ALL SELECT 'relation', relation, count(*) FROM edges GROUP BY relation")
def a17(spark, sf):
    return G.stats(*graph(spark, sf))


@query("s16_elements", f"WITH {GRAPH} SELECT id, type, degree, CASE type WHEN 'document' THEN '#1f77b4' WHEN 'region' THEN '#2ca02c' ELSE '#888888' END AS colour, round(8 + 12 * ln(degree + 1), 6) AS size, CAST(least(24, greatest(10, 10 + floor(5 * ln(degree + 1)))) AS INTEGER) AS font FROM nodes JOIN degree USING (id)")
def s16(spark, sf):
    return G.elements(*graph(spark, sf), {"document": "#1f77b4", "region": "#2ca02c"})


def _communities(spark, sf):
    return G.communities(*graph(spark, sf))


@query("g4_communities")
def g4(spark, sf):
    """Communities, with the modularity of the result in each row."""
    found = _communities(spark, sf)
    return found.join(F.broadcast(G.modularity(graph(spark, sf)[1], found)))  # one row


@query("g5_cluster_sizes")
def g5(spark, sf):
    return _communities(spark, sf).groupBy("cluster").agg(F.count("*").alias("n"))


def snapshots(spark, sf):
    p = table(spark, sf, "pages")
    path = F.concat("url", F.lit("#"), F.col("page_id").cast("string")).alias("path")
    old = p.where("page_id % 10 <> 0").select(path, F.sha2("html", 256).alias("hash"), F.col("page_id").alias("mtime"))
    html = F.concat("html", F.when(F.col("page_id") % 5 == 0, "<!--v2-->").otherwise(""))
    new = p.where("page_id % 7 <> 0").select(path, F.sha2(html, 256).alias("hash"), (F.col("page_id") + F.when(F.col("page_id") % 3 == 0, 1).otherwise(0)).alias("mtime"))
    return old, new


SNAP = """o AS (SELECT url || '#' || page_id AS path, page_id, html AS h, page_id AS m FROM pages WHERE page_id % 10 <> 0), n AS (SELECT url || '#' || page_id AS path, page_id, html || CASE WHEN page_id % 5 = 0 THEN '<!--v2-->' ELSE '' END AS h, page_id + CASE WHEN page_id % 3 = 0 THEN 1 ELSE 0 END AS m FROM pages WHERE page_id % 7 <> 0),
d AS (SELECT coalesce(o.path, n.path) AS path, CASE WHEN o.path IS NULL THEN 'new' WHEN n.path IS NULL THEN 'deleted' WHEN o.m = n.m OR o.h = n.h THEN 'unchanged' ELSE 'modified' END AS status FROM o FULL JOIN n ON o.path = n.path)"""


@query("j10_snapshot_diff", f"WITH {SNAP} SELECT * FROM d")
def j10(spark, sf):
    return Y.diff(*snapshots(spark, sf))


@query("a20_sync_totals", f"WITH {SNAP} SELECT count(*) FILTER (status = 'new') AS added, count(*) FILTER (status = 'modified') AS updated, count(*) FILTER (status = 'deleted') AS deleted, count(*) FILTER (status = 'unchanged') AS skipped, count(*) AS total, true AS has_changes FROM d")
def a20(spark, sf):
    return Y.totals(Y.diff(*snapshots(spark, sf)))


@query("m9_sync_apply", f"WITH {SNAP} SELECT path, sha256(h) AS hash FROM (SELECT o.path, h FROM o JOIN d USING (path) WHERE status = 'unchanged' UNION ALL SELECT n.path, h FROM n JOIN d USING (path) WHERE status IN ('new', 'modified'))")
def m9(spark, sf):
    old, new = snapshots(spark, sf)
    return Y.apply(old, old, new).select("path", "hash")


@query("a3_dashboard", f"""WITH {DOCS}, {CHUNKS}, {CHECK_SQL}, {GRAPH}, t AS (SELECT tag, count(*) AS n FROM (SELECT unnest(tags) AS tag FROM docs) GROUP BY tag)
SELECT 'count' AS kind, 'docs' AS name, count(*) AS n FROM docs UNION ALL SELECT 'count', 'chunks', count(*) FROM chunks UNION ALL (SELECT 'tag', tag, n FROM t ORDER BY n DESC, tag LIMIT 10) UNION ALL (SELECT 'newest', title, doc_id FROM docs ORDER BY doc_id DESC LIMIT 5)
UNION ALL SELECT 'alert', issue, count(*) FROM (SELECT unnest(issues) AS issue FROM checked) GROUP BY issue UNION ALL SELECT 'graph', 'nodes', count(*) FROM nodes UNION ALL SELECT 'graph', 'edges', count(*) FROM edges""")
def a3(spark, sf):
    d, c = docs(spark, sf), chunks(spark, sf)
    nodes, edges = graph(spark, sf)
    count = lambda df, kind, name: df.agg(F.count("*").alias("n")).select(F.lit(kind).alias("kind"), F.lit(name).alias("name"), "n")
    tags = S.tag_counts(d).orderBy(F.desc("n"), "tag").limit(10).select(F.lit("tag").alias("kind"), F.col("tag").alias("name"), "n")
    newest = d.orderBy(F.desc("doc_id")).limit(5).select(F.lit("newest").alias("kind"), F.col("title").alias("name"), F.col("doc_id").alias("n"))
    alerts = Q.check(c).select(F.explode("issues").alias("name")).groupBy("name").agg(F.count("*").alias("n")).select(F.lit("alert").alias("kind"), "name", "n")
    out = count(d, "count", "docs")
    for more in (count(c, "count", "chunks"), tags, newest, alerts, count(nodes, "graph", "nodes"), count(edges, "graph", "edges")):
        out = out.unionByName(more)
    return out
