"""Connected components by alternating stars; links never leave the cluster."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexstrata.llm.common import cut_lineage, in_few_tasks


def connected_components(links: DataFrame, left: str = "a", right: str = "b") -> DataFrame:
    """``node, component``: the smallest node reachable from each node that has a link.

    Each round hangs the larger neighbours of every node, and then the node
    itself, on the smallest node in sight; rounds grow with the logarithm of
    the longest path.  Joins are plain, so that Spark itself splits the
    partition of a node with very many neighbours.
    """
    pairs = cut_lineage(
        links.select(F.greatest(left, right).alias("u"), F.least(left, right).alias("v")).filter("u is not null and v is not null and u <> v").distinct()
    )
    while True:
        n = pairs.count()
        few = lambda df: in_few_tasks(df, 2 * n)  # noqa: B023, E731
        both = few(pairs).unionByName(few(pairs).select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = few(both.groupBy("u").agg(F.min("v").alias("m"))).withColumn("m", F.least("m", "u"))
        large = few(both.join(least, "u")).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = few(large.filter("u <> v").distinct())
        low = few(large.groupBy("u").agg(F.min("v").alias("m")))
        small = few(large.join(low, "u"))
        new = small.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
        new = cut_lineage(few(new.filter("u <> v").distinct()))
        # Done when every node hangs on a node that hangs on none.
        twice = few(new.groupBy("u").agg(F.count("*").alias("n"))).filter("n > 1")
        settled = twice.isEmpty() and few(new.join(few(new.select(F.col("u").alias("v")).distinct()), "v", "left_semi")).isEmpty()
        pairs = new
        if settled:
            break
    stars = pairs.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return stars.unionByName(stars.select(F.col("component").alias("node"), "component").distinct())
