"""An index as a table: insert, upsert, soft delete, slot reuse and the rest as set operations.

A state has the columns id, v, deleted and slot. Every operation gives a new state; what the operation requires is checked
before, by an action that reads ids alone.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


#: Rows of a bucket of an ordered column; buckets at least and at most (their counts are broadcast).
BUCKET_ROWS, LEAST_BUCKETS, MOST_BUCKETS = 1_000_000, 32, 4096


class TableError(ValueError):
    """An operation whose requirements the table or its input doesn't meet."""


def require(problem: DataFrame, says: str) -> None:
    row = problem.limit(1).collect()
    if row:
        raise TableError(f"{says}: {row[0].asDict()}")


def new(rows: DataFrame, dim: int | None = None) -> DataFrame:
    """A state of rows (id, v), in slots by ascending id. Slots are numbered within range partitions, so that no task sorts all."""
    if dim is not None:
        require(rows.where(F.size("v") != dim).select("id"), f"a vector doesn't have {dim} dimensions")
    require(rows.groupBy("id").count().where("count > 1"), "an id occurs twice")
    return numbered(rows.select("id", "v", F.lit(False).alias("deleted")), "id", "slot")


def order_edges(rows: DataFrame, by: str) -> list:
    """Values of a column that cut rows into buckets of about BUCKET_ROWS, between LEAST_BUCKETS and MOST_BUCKETS of them."""

    def edges(buckets: int) -> tuple[int, list]:
        n, found = rows.agg(F.count(by), F.percentile_approx(by, [i / buckets for i in range(1, buckets)], 20_000)).first()
        return n, sorted({*(found or [])})

    n, found = edges(LEAST_BUCKETS)
    more = min(MOST_BUCKETS, n // BUCKET_ROWS)
    return edges(more)[1] if more > LEAST_BUCKETS else found


def bucket_of(by: str, edges: list) -> F.Column:
    """Number of a value's bucket: the edges below it, found by halves."""
    if not edges:
        return F.lit(0)

    def among(lo: int, hi: int) -> F.Column:
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(F.col(by) <= F.lit(edges[mid]), among(lo, mid)).otherwise(among(mid + 1, hi))

    return among(0, len(edges)) if len(edges) <= 64 else F.size(F.filter(F.array(*map(F.lit, edges)), lambda e: e < F.col(by)))


def numbered(rows: DataFrame, by: str, name: str) -> DataFrame:
    """Dense numbers from 0 in the order of a unique column: counts by bucket, then ranks within buckets.

    Buckets follow the number of rows; edges keep the column's own type, so that no order is lost beyond 2**53.
    """
    dealt = rows.withColumn("_bucket", bucket_of(by, order_edges(rows, by)))
    sizes = dealt.groupBy("_bucket").agg(F.count("*").alias("_n"))
    before = sizes.select("_bucket", (F.sum("_n").over(Window.orderBy("_bucket")) - F.col("_n")).alias("_before"))
    rank = F.row_number().over(Window.partitionBy("_bucket").orderBy(by)) - 1
    return dealt.withColumn("_rank", rank).join(F.broadcast(before), "_bucket").withColumn(name, F.col("_rank") + F.col("_before")).drop("_bucket", "_rank", "_before")


def insert(state: DataFrame, rows: DataFrame, capacity: int | None = None, repeats: bool = False) -> DataFrame:
    """Adds new ids after the last slot; a full table is an error, and so is a known id, unless repeats lets it have a row more."""
    if not repeats:
        require(rows.join(state, "id", "left_semi").select("id"), "an id is there already")
    used = state.agg(F.coalesce(F.max("slot") + 1, F.lit(0)).alias("n")).first()[0]
    if capacity is not None and used + rows.count() > capacity:
        raise TableError("more rows than the table's capacity")
    fresh = new(rows).withColumn("slot", F.col("slot") + used)
    return state.unionByName(fresh)


def upsert(state: DataFrame, rows: DataFrame, replacing: bool = False) -> DataFrame:
    """Replaces the vectors of known ids, which undeletes them, and inserts the rest."""
    if replacing:
        require(rows.join(state.where("deleted"), "id", "left_semi").select("id"), "a deleted id can't be updated while slots are reused")
    known = state.join(rows.select("id", F.col("v").alias("_v")), "id", "left")
    updated = known.select("id", F.coalesce("_v", "v").alias("v"), (F.col("deleted") & F.col("_v").isNull()).alias("deleted"), "slot")
    fresh = rows.join(state, "id", "left_anti")
    return insert(updated, fresh) if not fresh.isEmpty() else updated


def mark_deleted(state: DataFrame, ids: DataFrame) -> DataFrame:
    require(ids.join(state, "id", "left_anti"), "an unknown id")
    require(ids.join(state.where("deleted"), "id", "left_semi"), "an id is deleted already")
    hit = ids.select("id", F.lit(True).alias("_hit")).distinct()
    return state.join(hit, "id", "left").select("id", "v", (F.col("deleted") | F.col("_hit").isNotNull()).alias("deleted"), "slot")


def unmark_deleted(state: DataFrame, ids: DataFrame) -> DataFrame:
    require(ids.join(state, "id", "left_anti"), "an unknown id")
    require(ids.join(state.where(~F.col("deleted")), "id", "left_semi"), "an id isn't deleted")
    hit = ids.select("id", F.lit(True).alias("_hit")).distinct()
    return state.join(hit, "id", "left").select("id", "v", (F.col("deleted") & F.col("_hit").isNull()).alias("deleted"), "slot")


def replace_deleted(state: DataFrame, rows: DataFrame, repeats: bool = False) -> DataFrame:
    """New rows, by ascending id, take the least slots of deleted ones, whose ids vanish; the rest are inserted.

    A known id is an error, unless repeats lets it have a row more.
    """
    if not repeats:
        require(rows.join(state, "id", "left_semi").select("id"), "an id is there already")
    vacant = numbered(state.where("deleted").select("slot"), "slot", "_k")
    fresh = numbered(rows.select("id", "v"), "id", "_k")
    placed = fresh.join(vacant, "_k").select("id", "v", F.lit(False).alias("deleted"), "slot")
    kept = state.join(placed.select("slot"), "slot", "left_anti").select("id", "v", "deleted", "slot")
    rest = fresh.join(vacant, "_k", "left_anti").select("id", "v")
    out = kept.unionByName(placed)
    return insert(out, rest, repeats=repeats) if not rest.isEmpty() else out


def remove(state: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows go for good; unknown ids are ignored."""
    return state.join(ids, "id", "left_anti")


def resize(state: DataFrame, capacity: int) -> int:
    used = state.count()
    if capacity < used:
        raise TableError(f"{used} rows don't fit a capacity of {capacity}")
    return capacity


def get(state: DataFrame, ids: DataFrame) -> DataFrame:
    """id and v of each id; an unknown or deleted one is an error."""
    live = state.where(~F.col("deleted"))
    require(ids.join(live, "id", "left_anti"), "an id is unknown or deleted")
    return live.join(ids, "id", "left_semi").select("id", "v")


def searchable(state: DataFrame) -> DataFrame:
    return state.where(~F.col("deleted")).select("id", "v")


def properties(state: DataFrame) -> DataFrame:
    """Counts as an index reports them: elements and ids include the deleted."""
    return state.agg(F.count("*").alias("element_count"), F.sum(F.col("deleted").cast("long")).alias("deleted_count"), F.max(F.size("v")).cast("long").alias("dim"), F.max("slot").cast("long").alias("last_slot"))
