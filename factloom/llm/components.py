"""Connected components of a link table, without gathering any component."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.operators.skew import hot_join
from factloom.session import cut


def components(links: DataFrame, a: str, b: str, least_hot: int = 20_000) -> DataFrame:
    """(node, root): for every node of a link the least node it is connected with, itself included.

    Alternates large-star and small-star steps (each node's larger neighbours, then all others, are linked to
    its least neighbour) until nothing changes; the rounds grow with the logarithm of the nodes.  Each step is an
    aggregation combined before the shuffle and a join in which the links of a hub are dealt over several tasks.  Links
    with a null are none.
    """
    edges = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u > v").distinct()
    edges = cut(edges)
    state = lambda: edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    before = state()
    while True:
        total = before[0]
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("c")).withColumn("m", F.least("u", "m"))
        near = hot_join(both.where("v > u"), least.drop("c"), ["u"], counts=least.select("u", "c"), total=2 * total, least_hot=least_hot)
        large = near.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v").distinct()
        large = cut(large)
        low = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("c"))
        small = hot_join(large, low.drop("c"), ["u"], counts=low.select("u", "c"), total=total, least_hot=least_hot).select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        edges = cut(small.where("u > v").distinct())
        now = state()
        if now == before:
            break
        before = now
    stars = edges.groupBy("u").agg(F.min("v").alias("root"))
    return stars.select(F.col("u").alias("node"), "root").unionByName(stars.select(F.col("root").alias("node"), "root").distinct())
