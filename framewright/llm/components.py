"""Connected components of an edge table, in rounds of two star operations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framewright.session import cut_lineage


def _with_least(edges: DataFrame) -> DataFrame:
    """Each edge u, v with ``least``: the smallest of u and its neighbours."""
    least = edges.groupBy("u").agg(F.min("v").alias("least"))
    return edges.join(least, "u").withColumn("least", F.least("u", "least"))


def components(edges: DataFrame) -> DataFrame:
    """node, label (the smallest node of its component) for every node of ``edges`` (u, v).

    Large stars hang every larger neighbour on the smallest one, small stars the smaller neighbours; the number of
    rounds grows with the logarithm of the longest path. Every round is two grouped minima joined to the edges, and
    is checkpointed. Loops and repeated edges do no harm; no edges give no rows.
    """
    stars = cut_lineage(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    state = None
    while True:
        both = stars.unionByName(stars.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _with_least(both).where("v > u").select(F.col("v").alias("u"), F.col("least").alias("v")).distinct()
        small = _with_least(large)
        stars = cut_lineage(
            small.select(F.col("v").alias("u"), F.col("least").alias("v")).where("u <> v")
            .unionByName(small.select("u", F.col("least").alias("v")))
            .distinct()
        )
        row = stars.agg(F.count(F.lit(1)), F.sum(F.hash("u", "v").cast("long"))).first()
        if tuple(row) == state:
            break
        state = tuple(row)
    return stars.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(stars.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct())
