"""Storage queries (I rows of the inventory)."""

from __future__ import annotations

from pyspark.sql import functions as F

from evigraph.operators.graph import valid_edges
from evigraph.queries.registry import query
from evigraph.sources.nodelink import graph_merge_edges, graph_merge_nodes, graph_snapshot
from evigraph.sources.star import edges, nodes, table


@query("graph_nodes", "g_nodes", "SELECT id, type, name, date, country, price_musd, discount_pct FROM g_nodes")
def _(spark, d):
    return nodes(spark, d).drop("attrs_num")


@query("graph_edges", "g_edges", "SELECT source, target, type FROM g_edges")
def _(spark, d):
    return edges(spark, d)


def _snapshot(spark, d):
    """Incoming: everything but topics, every CONTRADICTS renamed to a type outside the vocabulary.
    Serving: labelled publications, those of quality 1 own uploaded chunks and one is renamed."""
    n = nodes(spark, d).select("id", "type", "name")
    incoming = n.filter("type <> 'topic'").join(
        table(spark, d, "labels").filter("toxic = 1").select(F.concat(F.lit("pub_"), F.col("doc_id").cast("string")).alias("id")), "id", "left_anti"
    )
    e = edges(spark, d).withColumn("type", F.when(F.col("type") == "CONTRADICTS", "DISPUTES").otherwise(F.col("type")))
    serving = table(spark, d, "labels").select(
        F.concat(F.lit("pub_"), F.col("doc_id").cast("string")).alias("id"), F.lit("publication").alias("type"),
        F.concat(F.lit("Upload "), F.col("doc_id").cast("string")).alias("name"), (F.col("quality") == 1).alias("has_chunks"),
    )
    return graph_snapshot(incoming, e, serving)


SNAP = """WITH inc AS (SELECT id, type, name FROM g_nodes WHERE type <> 'topic' AND id NOT IN (SELECT 'pub_' || CAST(doc_id AS VARCHAR) FROM labels WHERE toxic = 1)),
    snap AS (SELECT *, 'snapshot' AS origin FROM inc UNION ALL
      SELECT 'pub_' || CAST(doc_id AS VARCHAR), 'publication', 'Upload ' || CAST(doc_id AS VARCHAR), 'upload' FROM labels
      WHERE quality = 1 AND 'pub_' || CAST(doc_id AS VARCHAR) NOT IN (SELECT id FROM inc))"""


@query("graph_snapshot", "g_nodes", SNAP + " SELECT id, type, name, origin FROM snap")
def _(spark, d):
    return _snapshot(spark, d)[0]


@query("graph_snapshot_edges", "g_nodes g_edges",
       SNAP + " SELECT source, target, type FROM g_edges WHERE type <> 'CONTRADICTS' AND source IN (SELECT id FROM snap) AND target IN (SELECT id FROM snap)")
def _(spark, d):
    return _snapshot(spark, d)[1]


@query("graph_merge", "g_nodes",
       "SELECT id, type, CASE WHEN country = 'EU' THEN upper(name) ELSE name END AS name FROM g_nodes WHERE type IN ('experiment', 'facility', 'material')")
def _(spark, d):
    """First: materials and all experiments; second: facilities, and European nodes with a new name."""
    n = nodes(spark, d).select("id", "type", "name", "country")
    first = n.filter("type IN ('experiment', 'material')").drop("country")
    second = n.filter("type = 'facility' OR country = 'EU'").select("id", "type", F.when(F.col("country") == "EU", F.upper("name")).otherwise(F.col("name")).alias("name"))
    return graph_merge_nodes(first, second)


@query("graph_merge_edges", "g_edges", "SELECT source, target, type FROM g_edges WHERE type IN ('AT_FACILITY', 'AT_CONDITION', 'CONDUCTED_BY')")
def _(spark, d):
    e = edges(spark, d)
    return graph_merge_edges(e.filter("type IN ('AT_FACILITY', 'AT_CONDITION')"), e.filter("type IN ('AT_CONDITION', 'CONDUCTED_BY')"))


@query("valid_edges", "g_edges", "SELECT source, target, type FROM g_edges WHERE type <> 'TAGGED_AS'")
def _(spark, d):
    return valid_edges(nodes(spark, d).filter("type <> 'topic'"), edges(spark, d))
