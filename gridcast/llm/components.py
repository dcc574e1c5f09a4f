"""Connected components of a link table, by contraction: no vertex's links meet in one task."""
from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from gridcast.llm.common import stored


def components(links: DataFrame) -> DataFrame:
    """(v, comp): every vertex of the links (a, b) with the smallest vertex of its component.

    A round points each vertex at its smallest neighbour, follows the pointer once more and contracts the links;
    it ends when none is left, after about as many rounds as the logarithm of the longest path.
    """
    links = stored(links.select("a", "b").where("a <> b").distinct(), "links")
    both = links.select("a").union(links.select(F.col("b").alias("a"))).distinct()
    labels = stored(both.select(F.col("a").alias("v"), F.col("a").alias("comp")), "labels")
    while not links.isEmpty():
        near = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).groupBy("a").agg(F.min("b").alias("t"))
        step = near.select(F.col("a").alias("v"), F.least("a", "t").alias("t"))
        over = step.select(F.col("v").alias("t"), F.col("t").alias("t2"))
        step = stored(step.join(over, "t", "left").select("v", F.coalesce("t2", "t").alias("t")), "step")
        on = lambda df, c: df.join(step.select(F.col("v").alias(c), F.col("t").alias(f"{c}_t")), c, "left").withColumn(c, F.coalesce(f"{c}_t", c)).drop(f"{c}_t")
        labels = stored(on(labels, "comp").select("v", "comp"), "labels")
        links = stored(on(on(links, "a"), "b").where("a <> b").select("a", "b").distinct(), "links")
    return labels
