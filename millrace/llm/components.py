"""Connected components of a distributed edge list."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.session import materialize


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, comp) of every node of the edges (a, b): comp is the least node that it is connected to.

    Each step takes the least label among neighbours and then that label's own label, so chains halve;
    labels are written between steps. Nothing is collected but a count.
    """
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    both = materialize(both.where("a <> b").distinct(), "edges")
    labels = materialize(
        both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("n")).select("node", F.least("node", "n").alias("comp")),
        "labels",
    )
    while True:
        near = both.join(labels.withColumnsRenamed({"node": "b"}), "b").groupBy("a").agg(F.min("comp").alias("near"))
        lower = labels.join(near.withColumnRenamed("a", "node"), "node").select(
            "node", F.col("comp").alias("old"), F.least("comp", "near").alias("via")
        )
        heads = labels.select(F.col("node").alias("via"), F.col("comp").alias("head"))
        stepped = materialize(
            lower.join(heads, "via").select("node", F.least("via", "head").alias("comp"), (F.least("via", "head") != F.col("old")).alias("moved")),
            "labels",
        )
        labels = stepped.select("node", "comp")
        if stepped.where("moved").isEmpty():
            return labels


def merged_components(comps: DataFrame, links: DataFrame) -> DataFrame:
    """The components of the edges so far, given as ``comps``, and of ``links`` together."""
    label = lambda end: comps.select(F.col("node").alias(end), F.col("comp").alias(f"_{end}"))
    ends = links.join(label("a"), "a", "left").join(label("b"), "b", "left").select(
        F.coalesce("_a", "a").alias("a"), F.coalesce("_b", "b").alias("b")
    )
    joined = connected_components(ends).withColumnsRenamed({"node": "was", "comp": "now"})
    # Single nodes that the links add have no label yet; joined has all of them and the labels that changed.
    kept = comps.join(joined, comps["comp"] == joined["was"], "left").select("node", F.coalesce("now", "comp").alias("comp"))
    added = joined.select(F.col("was").alias("node"), F.col("now").alias("comp")).join(comps, "node", "left_anti")
    return materialize(kept.union(added), "labels")
