"""Connected components of an undirected graph as a DataFrame loop."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from planwalk.sources.scratch import written


def connected_components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, label) of every node that has a link to another; label is the smallest node of its component.

    Each round hooks every label to its smallest neighbour, follows two more hops of the
    hooks, and carries on with the links between labels that still differ, so a round at
    least halves the labels of a long chain.  Rounds are cut by tables in the shared folder.
    Links with a null end, and loops, are ignored; no links give no rows.
    """
    links = links.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    links = written(links, "links")
    labels = None
    while not links.isEmpty():
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hooks = written(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("p")), "hooks")
        for _ in range(2):
            up = hooks.select(F.col("a").alias("p"), F.col("p").alias("q"))
            hooks = hooks.join(up, "p").select("a", F.col("q").alias("p"))
        hooks = written(hooks, "hooks")
        if labels is None:
            labels = hooks.select(F.col("a").alias("node"), F.col("p").alias("label"))
        else:
            up = hooks.select(F.col("a").alias("label"), "p")
            labels = written(labels.join(up, "label", "left").select("node", F.coalesce("p", "label").alias("label")), "labels")
        left, right = hooks.select("a", F.col("p").alias("x")), hooks.select(F.col("a").alias("b"), F.col("p").alias("y"))
        links = links.join(left, "a").join(right, "b").where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
        links = written(links, "links")
    if labels is None:
        return links.select(F.col("a").alias("node"), F.col("b").alias("label"))
    return labels
