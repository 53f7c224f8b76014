"""Connected components of an edge table, by least labels and shortcuts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chalkline.llm.scratch import Scratch


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, comp) for every node of edges (a, b): comp is the least node that it is connected with.

    A round takes the least label among neighbours, then that label's own
    label, so distances halve. A node's neighbours are reduced by a partial
    aggregation, never gathered. Labels are tables in the shared folder; an
    edge table without rows gives none.
    """
    both = scratch.keep(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    state = scratch.keep(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("comp")), "labels")
    while True:
        near = both.join(state.drop("moved"), both["b"] == state["node"]).groupBy(F.col("a").alias("node")).agg(F.min("comp").alias("near"))
        lower = state.join(near, "node").select("node", "comp", F.least("comp", "near").alias("low"))
        jump = state.select(F.col("node").alias("low"), F.col("comp").alias("far"))
        moved = lower.join(jump, "low").select("node", F.least("low", "far").alias("new"), (F.least("low", "far") != F.col("comp")).alias("moved"))
        moved = scratch.keep(moved.select("node", F.col("new").alias("comp"), "moved"), "labels")
        scratch.drop(state)
        state = moved
        if moved.where("moved").isEmpty():
            scratch.drop(both)
            return scratch.stand_in(state, state.select("node", "comp"))
