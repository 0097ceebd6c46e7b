"""Connected components of an edge table, by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def components(edges: DataFrame, tables) -> DataFrame:
    """(node, root) for every node of ``edges`` (a long, b long): root is the least node of its component.

    Each round hooks every node to its least neighbour if that is smaller, follows the hooks to
    their ends by doubling, and goes on with the edges between what is left, so that both the
    rounds and the hops in each are about logarithmic. All tables are written to the shared folder.
    """
    edges = tables.save(edges.where("a <> b").distinct())
    labels = tables.save(
        edges.select(F.explode(F.array("a", "b")).alias("node")).distinct().withColumn("root", F.col("node"))
    )
    while edges.limit(1).count():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hooks = both.groupBy(F.col("a").alias("x")).agg(F.least(F.col("a"), F.min("b")).alias("to"))
        hooks = tables.save(hooks)
        while True:
            step = hooks.select(F.col("x").alias("to"), F.col("to").alias("next"))
            jumped = tables.save(hooks.join(step, "to").select("x", F.col("next").alias("to"), (F.col("to") != F.col("next")).alias("moved")))
            hooks = jumped.select("x", "to")
            if not jumped.where("moved").limit(1).count():
                break
        to = hooks.select(F.col("x").alias("root"), F.col("to").alias("new"))
        labels = tables.save(labels.join(to, "root", "left").select("node", F.coalesce("new", "root").alias("root")))
        a, b = hooks.toDF("a", "new_a"), hooks.toDF("b", "new_b")
        edges = edges.join(a, "a").join(b, "b").select(F.col("new_a").alias("a"), F.col("new_b").alias("b"))
        edges = tables.save(edges.where("a <> b").distinct())
    return labels
