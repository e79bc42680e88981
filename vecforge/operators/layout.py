"""Mapping of vectors to blocks and pages."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vecforge.operators.graph import uniform

#: Sizes of headers in bytes: of a block of vectors, of one with neighbour lists, of a file; of a page; of a node's entry.
VECTOR_HEADER, BLOCK_HEADER, FILE_HEADER, PAGE, NODE_ID, LIST_HEADER = 16, 24, 4096, 4096, 4, 2


def vector_capacity(block_bytes: int, dim: int) -> int:
    """Vectors of a block that holds nothing else."""
    n = (block_bytes - VECTOR_HEADER) // (NODE_ID + 4 * dim)
    if n < 1:
        raise ValueError("a block can't hold one vector")
    return n


def vector_blocks(order: DataFrame, block_bytes: int, dim: int) -> DataFrame:
    """node_id, block_id and slot of consecutive nodes (new_id)."""
    n = vector_capacity(block_bytes, dim)
    return order.select(F.col("new_id").alias("node_id"), F.floor(F.col("new_id") / n).alias("block_id"), (F.col("new_id") % n).alias("slot"))


def greedy_blocks(sizes: DataFrame, block_bytes: int, header: int = BLOCK_HEADER) -> DataFrame:
    """node_id, nbytes and block_id: nodes in order, a block taking nodes while they fit, one at least.

    Where a block ends depends on all before it, so the fill walks the nodes in order, one Arrow batch at a time and
    with two numbers of state; only ids and sizes pass through that task.
    """

    def run(batches):
        block, used = -1, block_bytes
        for batch in batches:
            out = []
            for n in batch.column(1).to_pylist():
                if block < 0 or used + n > block_bytes:
                    block, used = block + 1, header
                used += n
                out.append(block)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.int64())], ["node_id", "nbytes", "block_id"])

    ordered = sizes.select("node_id", F.col("nbytes").cast("long").alias("nbytes")).coalesce(1).sortWithinPartitions("node_id")
    return ordered.mapInArrow(run, "node_id long, nbytes long, block_id long")


def node_bytes(dim: int, list_bytes: Column, vectors: bool = True) -> Column:
    """Bytes of a node's entry with its neighbour list, with or without its vector."""
    return F.lit(NODE_ID + LIST_HEADER + (4 * dim if vectors else 0)) + list_bytes


def fill(blocks: DataFrame, block_bytes: int, header: int = BLOCK_HEADER) -> DataFrame:
    """Blocks, mean fill, least and greatest number of nodes."""
    per = blocks.groupBy("block_id").agg(F.count("*").alias("n"), (F.sum("nbytes") + header).alias("used"))
    return per.agg(F.count("*").alias("blocks"), F.round(F.avg(F.col("used") / block_bytes), 6).alias("avg_fill"), F.min("n").alias("min_nodes"), F.max("n").alias("max_nodes"))


def routes(block_lists: DataFrame) -> DataFrame:
    """node_id, block_id and slot from lists of nodes (block_id, node_ids)."""
    return block_lists.select("block_id", F.posexplode("node_ids").alias("slot", "node_id")).select("node_id", "block_id", "slot")


def random_route(nodes: DataFrame, blocks: int, seed: int = 42) -> DataFrame:
    """A pseudo-random block for each node, from a hash."""
    return nodes.select("node_id", F.pmod(uniform(F.concat_ws(":", "node_id", F.lit(seed))), F.lit(blocks)).alias("block_id"))


def pages(placed: DataFrame, block_bytes: int, dim: int) -> DataFrame:
    """First page of each vector in a file of blocks, and whether it crosses into the next."""
    n = vector_capacity(block_bytes, dim)
    offset = FILE_HEADER + F.col("block_id") * block_bytes + VECTOR_HEADER + n * NODE_ID + F.col("slot") * (4 * dim)
    return placed.withColumn("byte_offset", offset.cast("long")).withColumn("page", F.shiftright("byte_offset", 12)).withColumn("crosses", F.shiftright(F.col("byte_offset") + 4 * dim - 1, 12) > F.col("page"))


def page_runs(wanted: DataFrame) -> DataFrame:
    """Runs of consecutive distinct pages of each query (query_id, page): first page and length."""
    w = Window.partitionBy("query_id").orderBy("page")
    island = wanted.select("query_id", "page").distinct().withColumn("island", F.col("page") - F.row_number().over(w))
    return island.groupBy("query_id", "island").agg(F.min("page").alias("first_page"), F.count("*").alias("pages")).drop("island")


def touched(candidates: DataFrame, placed: DataFrame) -> DataFrame:
    """Blocks that each query's candidates (query_id, node_id) lie in."""
    return candidates.join(placed.select("node_id", "block_id"), "node_id").groupBy("query_id").agg(F.array_sort(F.collect_set("block_id")).alias("blocks"))
