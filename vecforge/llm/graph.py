"""Connected components of an edge table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, meet, release


def components(edges: DataFrame) -> DataFrame:
    """node and root, the least node that it reaches, for every node of edges a - b.

    Both steps need only each node's least neighbour, a pre-aggregated minimum, and a join; nodes with more than a
    thousandth of all edges, such as the root of a large component, meet their edges by a broadcast. Rounds end when a
    round changes nothing; their number grows with the logarithm of the longest path.
    """
    now = cut(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct())
    mark, n = None, now.count()
    while True:
        both = now.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(now.select(F.col("b").alias("u"), F.col("a").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("rows")).select("u", F.least("u", "m").alias("m"), "rows")
        large = cut(meet(both.where("v > u"), least, ["u"], 2 * n).select(F.col("v").alias("a"), F.col("m").alias("b")).where("a <> b").distinct())
        least = large.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("rows"))
        joined = meet(large, least, ["a"], large.count())
        least = least.drop("rows")
        small = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
        now = cut(small.where("a <> b").distinct())
        new = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")).first()
        # The round's frames go, and their files with them.
        both = least = large = joined = small = None
        release(now.sparkSession)
        if new == mark:
            break
        mark, n = new, new["n"]
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
