"""Recall, agreement, percentiles and sweeps."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vecforge.operators.table import bucket_of, order_edges


def recall(result: DataFrame, truth: DataFrame, queries: int, k: int) -> DataFrame:
    """Share of the k true neighbours of each query that the result has; a short result counts as missing."""
    hits = result.join(truth.select("query_id", "id"), ["query_id", "id"], "left_semi")
    return hits.agg(F.count("*").alias("hits")).select("hits", F.round(F.col("hits") / F.lit(queries * k), 6).alias("recall"))


def agreement(one: DataFrame, two: DataFrame) -> DataFrame:
    """Rows of one that two has too, of the rows compared, and whether that is 95 % at least."""
    both = one.select("query_id", "id").join(two.select("query_id", "id", F.lit(1).alias("also")), ["query_id", "id"], "left")
    ratio = F.sum(F.coalesce("also", F.lit(0))) / F.count("*")
    return both.agg(F.count("*").alias("compared"), F.round(ratio, 6).alias("agreement"), (ratio >= 0.95).alias("passes"))


def percentiles(values: DataFrame, column: str, points: tuple[float, ...] = (0.5, 0.95, 0.99)) -> DataFrame:
    """Nearest-rank percentiles: the value at index floor(p * n) of the sorted ones.

    The few ranks are looked up in counts of equal values, never in one sorted list of all.
    """
    counts = values.groupBy(F.col(column).alias("x")).agg(F.count("*").alias("c"))
    # Buckets of the value range keep the running sum from passing through one task.
    dealt = counts.withColumn("b", bucket_of("x", order_edges(values, column)))
    sums = dealt.groupBy("b").agg(F.sum("c").alias("n"))
    before = sums.select("b", (F.sum("n").over(Window.orderBy("b")) - F.col("n")).alias("before"))
    n = values.count()
    ranked = dealt.join(F.broadcast(before), "b").withColumn("upto", F.col("before") + F.sum("c").over(Window.partitionBy("b").orderBy("x")))
    wanted = F.explode(F.array(*(F.struct(F.lit(p).alias("p"), F.lit(int(p * n)).alias("at")) for p in points)))
    return ranked.withColumn("w", wanted).where((F.col("w.at") < F.col("upto")) & (F.col("w.at") >= F.col("upto") - F.col("c"))).select(F.col("w.p").alias("p"), F.col("x").alias("value"))


def sweep_values(k: int) -> list[int]:
    """ef from k to 29 by 1, 30 to 90 by 10, 100 to 460 by 40."""
    return [*range(k, 30), *range(30, 100, 10), *range(100, 500, 40)]
