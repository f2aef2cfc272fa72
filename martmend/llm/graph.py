"""Connected components of a link table, by contraction: DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, dropped


def components(links: DataFrame, name: str = "components") -> DataFrame:
    """(v, c) for each vertex of links (a, b): c is the smallest vertex reachable.

    Each round hooks every vertex to its smallest neighbour, follows these parents to their roots by pointer jumping, and
    contracts the links to the roots. The number of links at least halves with each round in which links remain, as each
    vertex that has a smaller neighbour vanishes. Every vertex's links are reduced to minima before the shuffle, so a hub
    costs no more than the tasks that hold its links. Tables of former rounds are dropped when nothing reads them any more.
    """
    links = cut(links.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), name)
    spark, labels, held = links.sparkSession, None, None  # held: the table that labels are read from
    while not links.isEmpty():
        both = links.select(F.col("a").alias("v"), F.col("b").alias("w")).union(links.select("b", "a"))
        table = cut(both.groupBy("v").agg(F.min("w").alias("w")).select("v", F.least("v", "w").alias("p")), name)
        parent = table
        while True:
            up = parent.select(F.col("v").alias("p"), F.col("p").alias("q"))
            higher = cut(parent.join(up, "p").select("v", F.col("q").alias("p"), (F.col("q") != F.col("p")).alias("moved")), name)
            dropped(spark, table)
            table, parent = higher, higher.select("v", "p")
            if higher.where("moved").isEmpty():
                break
        if labels is None:
            labels, held = parent.select("v", F.col("p").alias("c")), table
        else:
            fresh = cut(labels.join(parent.select(F.col("v").alias("c"), "p"), "c", "left").select("v", F.coalesce("p", "c").alias("c")), name)
            dropped(spark, held)
            labels = held = fresh
        a, b = (parent.select(F.col("v").alias(x), F.col("p").alias(f"p{x}")) for x in "ab")
        left = links.join(a, "a").join(b, "b").where("pa <> pb").select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b")).distinct()
        left = cut(left, name)
        dropped(spark, links)
        if table is not held:
            dropped(spark, table)
        links = left
    return labels if labels is not None else links.select(F.col("a").alias("v"), F.col("b").alias("c"))
