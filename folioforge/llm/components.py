"""Connected components of a table of links, as joins and aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioforge.llm.util import materialize


def components(links: DataFrame) -> DataFrame:
    """(node, component) for each node of ``links`` (a, b): the smallest node reachable.

    Each round every node and its parent take the smallest grandparent among their neighbours, and
    paths are halved, so the number of rounds grows with the logarithm of the longest path. Both
    sides of the joins are written tables, so that a node with very many links is split over
    tasks; the minima are combined before the shuffle.
    """
    edges = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).filter("a <> b").distinct()
    edges = materialize(edges)
    start = edges.groupBy(F.col("a").alias("node")).agg(F.min(F.least("a", "b")).alias("parent"))
    state, before = _grand(materialize(start)), None
    while True:
        now = state.agg(F.sum(F.col("parent").cast("decimal(38,0)")), F.sum(F.col("grand").cast("decimal(38,0)"))).first()
        if now == before:
            return state.select("node", F.col("parent").alias("component"))
        before = now
        near = edges.join(state.select(F.col("node").alias("a"), "grand"), "a").groupBy(F.col("b").alias("node")).agg(F.min("grand").alias("least"))
        moved = state.join(near, "node").select("node", "parent", F.least("grand", "least").alias("to"))
        both = moved.select("node", "to").unionByName(moved.select(F.col("parent").alias("node"), "to"))
        state = _grand(materialize(both.groupBy("node").agg(F.min("to").alias("parent"))))


def _grand(parents: DataFrame) -> DataFrame:
    up = parents.select(F.col("node").alias("parent"), F.col("parent").alias("grand"))
    return materialize(parents.join(up, "parent").select("node", "parent", "grand"))
