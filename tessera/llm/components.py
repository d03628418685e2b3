"""Connected components over a table of links, by contraction in Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.scratch import materialise


def connected_components(links: DataFrame) -> DataFrame:
    """(node, label) for every node of ``links`` (a, b): nodes get the same label if a path of links joins them.

    In each round every node points to the least node beside it, pointers are followed twice, and links whose ends
    meet are dropped; rounds grow with the logarithm of the longest chain. Tables between rounds are in the shared
    folder; nothing is collected but whether links are left.
    """
    edges = materialise(links.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    labels = None
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        to = materialise(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("p")).select(F.col("a").alias("v"), "p"), "pointers")
        for _ in range(2):
            next_ = to.select(F.col("v").alias("v_"), F.col("p").alias("q"))
            to = to.join(next_, to["p"] == next_["v_"]).select("v", F.col("q").alias("p"))
        to = materialise(to, "pointers")
        if labels is None:
            labels = to.select(F.col("v").alias("node"), F.col("p").alias("label"))
        else:
            moved = labels.join(to, labels["label"] == to["v"], "left")
            labels = materialise(moved.select("node", F.coalesce("p", "label").alias("label")), "labels")
        a, b = to.select(F.col("v").alias("va"), F.col("p").alias("pa")), to.select(F.col("v").alias("vb"), F.col("p").alias("pb"))
        left = edges.join(a, F.col("a") == F.col("va")).join(b, F.col("b") == F.col("vb")).filter("pa <> pb")
        edges = materialise(left.select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b")).distinct(), "edges")
    if labels is None:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("label"))
    return labels
