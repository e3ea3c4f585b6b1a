"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusgauge.functions.joins import spread_join
from corpusgauge.session import written_once


def _hooked(edges: DataFrame, node: str, other: str, larger_only: bool) -> DataFrame:
    """Joins every neighbour of a node to the least of its neighbours and itself."""
    least = edges.groupBy(node).agg(F.least(F.min(other), F.first(node)).alias("m"))
    rows = spread_join(edges, least, [node], "inner", spread_by=[other], bounded=True)
    moved = rows.where(F.col(other) > F.col(node)) if larger_only else rows
    return moved.select(F.col(other).alias("a"), F.col("m").alias("b"))


def components(links: DataFrame) -> DataFrame:
    """(node, label) of all nodes of ``links`` (a, b); the label is the least node of the component.

    Stars are moved in turn to the least neighbour among larger and among smaller nodes, until nothing
    changes; that takes a number of rounds that grows with the logarithm of the longest path.  Each round is
    written to the shared folder.  A node with many links is aggregated first and its links are
    spread over tasks.
    """
    edges = written_once(
        links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct()
    )
    state = None
    while True:
        both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = written_once(_hooked(both, "a", "b", larger_only=True).where("a <> b").distinct())
        downs = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        small = _hooked(downs, "a", "b", larger_only=False)
        own = downs.groupBy("a").agg(F.min("b").alias("b"))
        edges = written_once(small.unionByName(own).where("a <> b").distinct())
        seen = edges.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("x")).first()
        if (seen["n"], seen["x"]) == state:
            break
        state = (seen["n"], seen["x"])
    leaves = edges.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("label"))
    roots = leaves.select(F.col("label").alias("node"), "label").distinct()
    return leaves.unionByName(roots)
