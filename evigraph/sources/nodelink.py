"""Graph storage: node-link JSON import and export, Parquet tables, snapshot and merge."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evigraph.functions.text import typed_attributes
from evigraph.operators.graph import valid_edges

_FIXED = ("id", "type", "name", "date", "country", "confidence", "source_file", "sources")


def _attributes(row: str) -> tuple[Column, Column]:
    """Open attributes of a JSON object, numbers apart from texts."""
    return tuple(F.map_filter(m, lambda k, v: ~k.isin(*_FIXED)) for m in typed_attributes(F.col(row)))


def load_node_link(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of node-link JSON documents (``nodes[]``, ``links[]``) under ``path``.

    A single JSON document is one task by nature; a folder of documents is read in parallel.
    The elements stay JSON text until they are exploded, so open attributes need no schema.
    """
    docs = spark.read.schema("nodes array<string>, links array<string>").option("multiLine", True).json(path)
    nums, strs = _attributes("n")
    nodes = docs.select(F.explode("nodes").alias("n")).select(
        *[F.get_json_object("n", f"$.{c}").alias(c) for c in _FIXED if c != "sources"],
        F.from_json(F.get_json_object("n", "$.sources"), "array<string>").alias("sources"),
        nums.alias("attrs_num"), strs.alias("attrs_str"),
    )
    bag = F.from_json("l", "map<string,string>")
    edges = docs.select(F.explode("links").alias("l")).select(
        F.get_json_object("l", "$.source").alias("source"),
        F.get_json_object("l", "$.target").alias("target"),
        F.get_json_object("l", "$.type").alias("type"),
        F.map_filter(bag, lambda k, v: ~k.isin("source", "target", "type", "key")).alias("attrs_str"),
    )
    return nodes, edges


def save_graph(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """Canonical storage: Parquet partitioned by type, so a type filter prunes files."""
    nodes.write.mode("overwrite").partitionBy("type").parquet(f"{path}/nodes")
    edges.write.mode("overwrite").partitionBy("type").parquet(f"{path}/edges")


def load_graph(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.parquet(f"{path}/nodes"), spark.read.parquet(f"{path}/edges")


def export_node_link(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """JSON lines, one object per node and link, written by all tasks."""
    flat = [c for c in nodes.columns if c not in ("attrs_num", "attrs_str")]
    nodes.select(*flat, *[c for c in ("attrs_num", "attrs_str") if c in nodes.columns]).write.mode("overwrite").json(f"{path}/nodes")
    edges.withColumn("key", F.col("type")).write.mode("overwrite").json(f"{path}/links")


def graph_snapshot(incoming_nodes: DataFrame, incoming_edges: DataFrame, serving_nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Full replacement of the serving graph that keeps nodes owning uploaded chunks.

    ``serving_nodes`` carries ``has_chunks``. An id on both sides takes the incoming attributes.
    """
    kept = serving_nodes.filter("has_chunks").drop("has_chunks").join(incoming_nodes.select("id"), "id", "left_anti")
    nodes = incoming_nodes.withColumn("origin", F.lit("snapshot")).unionByName(
        kept.withColumn("origin", F.lit("upload")), allowMissingColumns=True
    )
    return nodes, valid_edges(nodes, incoming_edges)


def write_snapshot(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """Replace only the ``origin`` partitions that are being written; uploads of others survive."""
    for df, name in ((nodes, "nodes"), (edges.withColumn("origin", F.lit("snapshot")), "edges")):
        df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("origin").parquet(f"{path}/{name}")


def graph_merge_nodes(first: DataFrame, second: DataFrame) -> DataFrame:
    """Upsert by id: the later side wins."""
    cols = [c for c in first.columns if c != "id"]
    tagged = first.withColumn("_seq", F.lit(0)).unionByName(second.withColumn("_seq", F.lit(1)))
    return (
        tagged.groupBy("id").agg(F.max_by(F.struct(*cols), "_seq").alias("n"))
        .select("id", *[F.col(f"n.{c}").alias(c) for c in cols])
    )


def graph_merge_edges(first: DataFrame, second: DataFrame) -> DataFrame:
    return first.unionByName(second).dropDuplicates(["source", "target", "type"])
