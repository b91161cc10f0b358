"""Connected components of a table of links, by rounds of contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evigraph.session import cut_to_table


def components(links: DataFrame) -> DataFrame:
    """node, label for every node of ``links(a, b)``; equal labels mean one component.

    Each round every node joins the neighbour that comes first in an order drawn anew for the round, and the
    links are contracted. A node survives only if it comes before all its neighbours, so each round leaves half
    of them or fewer on average, on chains as on stars. Null ends and loops link nothing.
    """
    edges = cut_to_table(links.filter("a <> b").select("a", "b").distinct())
    moves: list[DataFrame] = []
    while not edges.isEmpty():
        turn = F.lit(len(moves))
        both = edges.union(edges.select("b", "a"))
        first = both.groupBy("a").agg(
            F.min(F.struct(F.xxhash64(turn, "b").alias("draw"), F.col("b").alias("node"))).alias("low")
        )
        own = F.struct(F.xxhash64(turn, "a").alias("draw"), F.col("a").alias("node"))
        step = cut_to_table(first.select(F.col("a").alias("node"), F.least("low", own)["node"].alias("label")))
        # A neighbour may move as well: follow it once.
        onward = step.select(F.col("node").alias("label"), F.col("label").alias("then"))
        move = cut_to_table(step.join(onward, "label").select("node", F.col("then").alias("label")))
        moves.append(move)
        at = lambda end: move.select(F.col("node").alias(end), F.col("label").alias("to_" + end))  # noqa: B023, E731
        edges = cut_to_table(
            edges.join(at("a"), "a").join(at("b"), "b").filter("to_a <> to_b")
            .select(F.least("to_a", "to_b").alias("a"), F.greatest("to_a", "to_b").alias("b")).distinct()
        )
    if not moves:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("label"))
    labels = moves.pop()
    for move in reversed(moves):
        onward = labels.select(F.col("node").alias("label"), F.col("label").alias("then"))
        labels = cut_to_table(move.join(onward, "label", "left").select("node", F.coalesce("then", "label").alias("label")))
    return labels
