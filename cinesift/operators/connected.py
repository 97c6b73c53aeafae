"""Connected components of links that no single machine has to hold."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..lineage import Scratch


def components(links: DataFrame, most_rounds: int = 64, merged: bool = False) -> DataFrame:
    """node, label for every node of links (columns u, v: longs); nodes have one label
    if and only if links connect them.

    Each round hooks every node to its smallest neighbour, jumps to where those
    lead, and contracts the links to what is left between labels, so at least half
    of the nodes that still have links go. Links are made distinct and self links
    dropped after each contraction; a node with many links is met only in sums and
    joins. Rounds are cut by written tables; those of past rounds are deleted. merged: no
    table of nodes is broadcast, however small its files are.
    """
    kept = (lambda df: df.hint("merge")) if merged else (lambda df: df)
    with Scratch(links.sparkSession) as scratch:
        edges = scratch.keep(links.where("u <> v").distinct(), "links")
        nodes = edges.select(F.explode(F.array("u", "v")).alias("node")).distinct()
        labels = scratch.keep(nodes.select("node", F.col("node").alias("label")), "labels")
        for _ in range(most_rounds):
            both = edges.select("u", "v").union(edges.select("v", "u"))
            hook = scratch.keep(both.groupBy("u").agg(F.min("v").alias("to")).where("to < u"), "hooks")
            if hook.isEmpty():
                break
            for _ in range(2):  # chains of hooks shorten to a quarter
                onward = hook.select(F.col("u").alias("to"), F.col("to").alias("next"))
                hook = hook.join(kept(onward), "to", "left").select("u", F.coalesce("next", "to").alias("to"))
            hook = scratch.keep(hook, "hooks")
            up = hook.select(F.col("u").alias("label"), "to")
            labels = scratch.keep(labels.join(kept(up), "label", "left").select("node", F.coalesce("to", "label").alias("label")), "labels")
            for end in ("u", "v"):
                edges = edges.join(kept(hook.select(F.col("u").alias(end), "to")), end, "left").withColumn(end, F.coalesce("to", end)).drop("to")
            edges = scratch.keep(edges.where("u <> v").distinct(), "links")
            scratch.drop(2)
        else:
            raise RuntimeError("links are not contracted")
        return scratch.result(labels, "components")
