"""Connected components of an edge table by alternating star contraction.

Each round relinks every node's larger neighbours to its smallest one, then
every node's smaller neighbours likewise (Kiveris et al., "Connected Components
in MapReduce and Beyond", 2014). Rounds grow with the logarithm of the chain
length, edges never multiply, and a hub with a huge degree only ever meets a
partial aggregate or ``attach``, so it is not gathered in one task. While there are fewer
edges than a group needs to be heavy, a round is one plan and one written table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize
from .skew import MIN_HEAVY_ROWS, attach

MAX_ROUNDS = 60


def connected_components(
    edges: DataFrame, floor: int = MIN_HEAVY_ROWS, max_rounds: int = MAX_ROUNDS
) -> DataFrame:
    """Label every node of ``edges(a, b)`` with the smallest node it reaches.

    Returns ``(row_id, group_id)`` for nodes of at least one edge. Raises when
    the round limit is hit instead of returning partial labels.
    """
    links = materialize(
        edges.select(F.greatest("a", "b").alias("big"), F.least("a", "b").alias("small"))
        .where("big <> small").distinct(), "edges")
    for _ in range(max_rounds):
        both = links.select(F.col("big").alias("node"), F.col("small").alias("near")).unionByName(
            links.select(F.col("small").alias("node"), F.col("big").alias("near")))
        nodes = both.groupBy("node").agg(
            F.min("near").alias("lowest"), F.max("near").alias("highest"),
            F.count_if(F.col("near") > F.col("node")).alias("above"))
        light = links.count() <= floor  # no node can be heavy
        if not light:
            nodes = materialize(nodes, "nodes")
        # Finished when every node is a root or has one neighbour, its root.
        unfinished = nodes.where("lowest < node and highest <> lowest").limit(1)
        if unfinished.isEmpty():
            roots = nodes.where("lowest > node").select(
                F.col("node").alias("row_id"), F.col("node").alias("group_id"))
            return links.select(
                F.col("big").alias("row_id"), F.col("small").alias("group_id")
            ).unionByName(roots)
        links = materialize(
            _light_round(links, nodes) if light else
            _small_star(_large_star(links, nodes, floor), floor), "edges")
    raise RuntimeError("Connected components did not settle within the round limit.")


def _light_round(links: DataFrame, nodes: DataFrame) -> DataFrame:
    """Both stars in one plan, for so few edges that no node's circle is too large for a task."""
    centre = nodes.where("above > 0").select(
        F.col("node").alias("small"), F.least("node", "lowest").alias("root"))
    moved = links.join(centre, "small").select("big", F.col("root").alias("small"))
    lowest = moved.withColumn("root", F.min("small").over(Window.partitionBy("big")))
    return lowest.select(F.explode(F.array("big", "small")).alias("big"),
                         F.col("root").alias("small")).where("big <> small").distinct()


def _large_star(links: DataFrame, nodes: DataFrame, floor: int) -> DataFrame:
    """Larger neighbours of each node point at the smallest node of its circle."""
    centre = nodes.where("above > 0").select(
        F.col("node").alias("small"), F.least("node", "lowest").alias("root"), "above")
    moved = attach(links, centre, ["small"], "above", floor)
    return materialize(moved.select("big", F.col("root").alias("small")), "large-star")


def _small_star(links: DataFrame, floor: int) -> DataFrame:
    """Smaller neighbours of each node, and the node itself, point at the smallest."""
    centre = materialize(
        links.groupBy("big").agg(F.min("small").alias("root"), F.count("*").alias("n")),
        "small-star")
    moved = attach(links, centre.where("n > 1"), ["big"], "n", floor)
    return (
        moved.select(F.col("small").alias("big"), F.col("root").alias("small"))
        .unionByName(centre.select("big", F.col("root").alias("small")))
        .where("big <> small").distinct()
    )
