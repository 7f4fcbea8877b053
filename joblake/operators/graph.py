"""Connected components of a link table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from joblake.session import drop_scratch, scratch_table


def components(edges: DataFrame) -> DataFrame:
    """Connected components of the links ``(a, b)`` (longs), as ``(node, label)``
    with the smallest node of the component as its label, for every node that
    has a link.

    Alternating large-star and small-star steps: every step is one grouped
    minimum and one join, so links stay on the executors, a node with very many
    links is pre-aggregated, and a path shortens geometrically. Each step's
    links are written to the shared scratch folder, which cuts the lineage.
    """
    e = scratch_table(edges.where("a <> b").select("a", "b").distinct(), "links")
    seen = None
    while True:
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        low = down.groupBy("a").agg(F.min("b").alias("m"))
        small = (down.join(low, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
                 .unionByName(low.select("a", F.col("m").alias("b"))).distinct())
        old, e = e, scratch_table(small, "links")
        drop_scratch(old)
        now = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(now) == seen:
            break
        seen = tuple(now)
    return (e.select(F.col("a").alias("node"), F.col("b").alias("label"))
            .unionByName(e.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct()))
