"""Connected components by contraction: every node points to its least neighbour."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.session import cut_lineage


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``(node, root)`` for every node of ``edges``; ``root`` is the least node of its component.

    Each round points every node to its least neighbour if that is smaller, follows the pointers
    to their ends by doubling, and joins the remaining edges between the ends. The nodes that
    still have edges at least halve in each round. Every table is written to the shared
    checkpoint folder, so a lost executor costs a read. Only emptiness checks reach the driver.
    Self-edges give components of one node; NULL ends are ignored.
    """
    pairs = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).filter("a IS NOT NULL AND b IS NOT NULL")
    both = pairs.union(pairs.select("b", "a")).distinct()
    both = cut_lineage(both)
    labels = both.select(F.col("a").alias("node")).distinct().withColumn("root", F.col("node"))
    open_edges = both.filter("a != b")
    while not open_edges.isEmpty():
        ends = _ends(cut_lineage(open_edges.groupBy("a").agg(F.min("b").alias("least")).select("a", F.least("a", "least").alias("to"))))
        moved = ends.select(F.col("a").alias("root"), "to")
        labels = cut_lineage(labels.join(moved, "root", "left").select("node", F.coalesce("to", "root").alias("root")))
        first = open_edges.join(ends, "a").select(F.col("to").alias("x"), F.col("b").alias("a"))
        second = first.join(ends, "a").select(F.col("x").alias("a"), F.col("to").alias("b"))
        open_edges = cut_lineage(second.filter("a != b").distinct())
    # Local minima may not be least: the last label is an end, so take the least node per label.
    # Written first, so that both sides of the join are plain shuffles and a hot root can be split.
    least = cut_lineage(labels.groupBy("root").agg(F.min("node").alias("least")))
    return labels.join(least, "root").select("node", F.col("least").alias("root"))


def _ends(pointers: DataFrame) -> DataFrame:
    """``(a, to)`` with ``to`` at the end of each chain of decreasing pointers."""
    while True:
        further = pointers.select(F.col("a").alias("to"), F.col("to").alias("next"))
        jumped = cut_lineage(
            pointers.join(further, "to", "left").select("a", F.coalesce("next", "to").alias("to"), (F.col("next") != F.col("to")).alias("moved"))
        )
        pointers = jumped.select("a", "to")
        if jumped.filter("moved").isEmpty():
            return pointers
