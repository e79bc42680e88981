"""Neighbour graphs as edge tables (src, dst, dist, pos): building, pruning, ordering, checking."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vecforge.functions import codec
from vecforge.functions.distance import KERNELS
from vecforge.operators import exact
from vecforge.operators.table import numbered
from vecforge.plans.lineage import cut


#: Buckets of sources whose offsets are broadcast, at most.
OFFSET_BUCKETS = 10_000
#: Edges of a graph that one task walks as arrays, at most (about 100 MB).
WALKED_EDGES = 4_000_000


def knn_graph(base: DataFrame, k: int, metric: str = "l2") -> DataFrame:
    """Edges from every vector to its k nearest others: every pair of blocks of the base is one group, so that it compares all pairs.

    For large bases, traverse.build_index gives an approximate graph in time that grows with the base alone.
    """
    found = exact.nearest_by_blocks(base, base.select(F.col("id").alias("query_id"), "v"), k + 1, metric).where("query_id <> id")
    pos = F.row_number().over(Window.partitionBy("query_id").orderBy("dist", "id"))
    return found.withColumn("pos", pos).where(F.col("pos") <= k).select(F.col("query_id").alias("src"), F.col("id").alias("dst"), "dist", "pos")


def select_neighbours(d_base: np.ndarray, among: np.ndarray, m: int) -> list[int]:
    """Indices kept of candidates in ascending distance: each is nearer to the base than to all kept before."""
    if len(d_base) < m:
        return list(range(len(d_base)))
    kept: list[int] = []
    for i in range(len(d_base)):
        if len(kept) == m:
            break
        if all(among[i, j] >= d_base[i] for j in kept):
            kept.append(i)
    return kept


def diversified(edges: DataFrame, vectors: DataFrame, most: int, least: int = 0, metric: str = "l2", over: int | None = None) -> DataFrame:
    """Edges that the selection rule keeps of each source, filled up to least by the nearest; sources of degree at most over stay.

    edges have dst vectors joined and are dealt by source, many sources to a step; each row is compared with at most so many kept ones.
    """
    rows = edges.join(vectors.select(F.col("id").alias("dst"), "v"), "dst").select("src", "dst", "dist", "v")

    def choose(batches: list) -> pa.RecordBatch:
        table = pa.Table.from_batches(batches)
        src = table.column("src").to_numpy()
        group = np.cumsum(np.diff(src, prepend=src[0]) != 0)
        kept = selected(group, table.column("dist").to_numpy(), exact.matrix(table.column("v").combine_chunks()), most, least, metric, over)
        got = table.select(["src", "dst", "dist"]).take(pa.array(kept)).combine_chunks()
        pos = pa.array(exact.by_row(group[kept], len(table)) + 1, pa.int32())
        return pa.RecordBatch.from_arrays([*(c.combine_chunks() for c in got.columns), pos], ["src", "dst", "dist", "pos"])

    def run(batches):
        held: list = []
        for batch in batches:
            src = batch.column(0).to_numpy()
            if not len(src):
                continue
            # The last source's list may go on in the next batch.
            last = int(np.searchsorted(src, src[-1]))
            if last:
                yield choose([*held, batch.slice(0, last)])
                held = []
            held.append(batch.slice(last))
        if held:
            yield choose(held)

    return rows.repartition("src").sortWithinPartitions("src", "dist", "dst").mapInArrow(run, "src long, dst long, dist double, pos int")


def selected(group: np.ndarray, dist: np.ndarray, v: np.ndarray, most: int, least: int, metric: str, over: int | None) -> np.ndarray:
    """Ascending numbers of the rows that the selection rule keeps of all groups at once; a group's rows ascend in distance.

    Every round keeps the first row left of each group and drops those that are nearer to it than to the source.
    """
    size, kernel = np.bincount(group), KERNELS[metric]
    kept = (size < most)[group] if over is None else ((size <= over) | (size < most))[group]
    left, at = np.flatnonzero(~kept), np.zeros(len(size), np.int64)
    for _ in range(most):
        first = np.diff(group[left], prepend=-1) != 0
        kept[left[first]], at[group[left[first]]] = True, left[first]
        left = left[~first]
        own = at[group[left]]
        if metric == "l2":
            d = exact.pair_distances(v, v, left, own)
        else:
            d = np.array([kernel(v[i : i + 1], v[j : j + 1])[0, 0] for i, j in zip(left, own, strict=True)])
        left = left[d >= dist[left]]
        if not len(left):
            break
    rest = np.flatnonzero(~kept)
    lacking = least - np.bincount(group[kept], minlength=len(size))
    kept[rest[exact.by_row(group[rest], len(size)) < lacking[group[rest]]]] = True
    return np.flatnonzero(kept)


def degree_cap(edges: DataFrame, most: int) -> DataFrame:
    """At most so many nearest edges of each source."""
    pos = F.row_number().over(Window.partitionBy("src").orderBy("dist", "dst"))
    return edges.withColumn("pos", pos).where(F.col("pos") <= most)


def mutual(edges: DataFrame, vectors: DataFrame, most: int, metric: str = "l2") -> DataFrame:
    """Both directions of every edge, lists over the limit pruned by the selection rule."""
    both = edges.select("src", "dst", "dist").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "dist")).dropDuplicates(["src", "dst"])
    return diversified(both, vectors, most, metric=metric, over=most)


def degree_histogram(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    degree = nodes.join(edges.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("degree")), "id", "left")
    return degree.groupBy(F.coalesce("degree", F.lit(0)).cast("long").alias("degree")).agg(F.count("*").alias("nodes"))


def statistics(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes, edges, least, greatest and mean out-degree."""
    degree = nodes.join(edges.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("d")), "id", "left").select(F.coalesce("d", F.lit(0)).alias("d"))
    return degree.agg(F.count("*").alias("nodes"), F.sum("d").alias("edges"), F.min("d").alias("min_degree"), F.max("d").alias("max_degree"), F.round(F.avg("d"), 6).alias("avg_degree"))


def uniform(text: F.Column) -> F.Column:
    """A number under 2**24 from the first six digits of a text's md5, which SQL engines share."""
    return F.conv(F.substring(F.md5(text), 1, 6), 16, 10).cast("long")


def level(id_column: str = "id", m: int = 16, seed: int = 100) -> F.Column:
    """Random level of a node, floor(-ln(u) / ln(m)) with u from a hash of its id, the same wherever it is computed."""
    u = (uniform(F.concat_ws(":", F.col(id_column), F.lit(seed))) + 1) / F.lit(float(1 << 24))
    return F.floor(-F.ln(u) / F.lit(float(np.log(m)))).cast("int")


def bfs_order(nodes: DataFrame, edges: DataFrame, start: int) -> DataFrame:
    """old_id and new_id: breadth-first from a node over neighbour lists in order, unreached nodes by id at the end.

    Up to WALKED_EDGES edges are walked as arrays by one task; beyond, every round is a join over the cluster.
    """
    links = edges.select("src", "dst", "pos")
    if 0 < links.count() <= WALKED_EDGES:
        order = cut(links.coalesce(1).mapInArrow(lambda batches: walk(batches, start), "old_id long, new_id long"))
        total = order.count()
    else:
        order, total = bfs_rounds(nodes, links, start)
    rest = nodes.select(F.col("id").alias("old_id")).join(order, "old_id", "left_anti")
    return order.unionByName(numbered(rest, "old_id", "k").select("old_id", (F.col("k") + total).alias("new_id")))


def walk(batches, start: int):
    """Nodes reached from a node and their numbers, in a queue's order, from all edges (src, dst, pos) as one list of batches."""
    src, dst, pos = (np.concatenate(c) for c in zip(*([b.column(i).to_numpy() for i in range(3)] for b in batches), strict=True))
    by = np.lexsort((pos, src))
    ids = np.unique(np.concatenate((src, dst, [start])))
    to = np.searchsorted(ids, dst[by])
    ends = np.searchsorted(src[by], ids, side="right")
    begins = np.searchsorted(src[by], ids)
    frontier, seen, order = np.searchsorted(ids, [start]), np.zeros(len(ids), bool), []
    while len(frontier):
        seen[frontier] = True
        order.append(frontier)
        n = ends[frontier] - begins[frontier]
        near = to[np.repeat(begins[frontier] - np.cumsum(n) + n, n) + np.arange(n.sum())]
        near = near[~seen[near]]
        frontier = near[np.sort(np.unique(near, return_index=True)[1])]
    reached = ids[np.concatenate(order)]
    yield pa.RecordBatch.from_arrays([pa.array(reached, pa.int64()), pa.array(np.arange(len(reached)), pa.int64())], ["old_id", "new_id"])


def bfs_rounds(nodes: DataFrame, edges: DataFrame, start: int) -> tuple[DataFrame, int]:
    """The nodes reached from a node with their numbers, and how many they are.

    Each round expands one frontier by a join: of several discoveries the one by the earliest parent and position counts,
    which is a queue's order. As many rounds as the graph is deep.
    """
    spark = nodes.sparkSession
    order = spark.createDataFrame([(start, 0)], "old_id long, new_id long")
    frontier, total = order, 1
    while True:
        found = frontier.join(edges, F.col("old_id") == F.col("src")).groupBy("dst").agg(F.min(F.struct("new_id", "pos")).alias("first"))
        fresh = found.join(order.select(F.col("old_id").alias("dst")), "dst", "left_anti")
        # A frontier's key is one number: the parent's place, then the position in its list.
        keyed = fresh.select("dst", (F.col("first.new_id") * F.lit(1 << 20) + F.col("first.pos")).alias("key"))
        frontier = numbered(keyed, "key", "k").select(F.col("dst").alias("old_id"), (F.col("k") + total).alias("new_id"))
        frontier = cut(frontier)
        n = frontier.count()
        if not n:
            break
        total += n
        order = order.unionByName(frontier)
    return order, total


def remap(edges: DataFrame, order: DataFrame) -> DataFrame:
    """Edges with both ends in new ids."""
    a, b = order.select(F.col("old_id").alias("src"), F.col("new_id").alias("new_src")), order.select(F.col("old_id").alias("dst"), F.col("new_id").alias("new_dst"))
    return edges.join(a, "src").join(b, "dst").select(F.col("new_src").alias("src"), F.col("new_dst").alias("dst"), *(c for c in edges.columns if c not in ("src", "dst")))


def locality(edges: DataFrame, order: DataFrame) -> DataFrame:
    """Mean distance of the ends of an edge in the new order, and that of a random order, N / 3."""
    n = order.agg(F.count("*").alias("n"))
    mean = remap(edges, order).agg(F.avg(F.abs(F.col("src") - F.col("dst"))).alias("mean"))
    return mean.join(F.broadcast(n)).select(F.round("mean", 6).alias("mean_gap"), F.round(F.col("n") / 3, 6).alias("random_gap"))


def adjacency(edges: DataFrame) -> DataFrame:
    """Neighbours of each source in ascending order; a list is as long as the degree allows."""
    return edges.groupBy("src").agg(F.array_sort(F.collect_list("dst")).alias("nbrs"))


def compressed(edges: DataFrame) -> DataFrame:
    """Per source: degree, bytes of its delta-coded list and where they start."""
    rows = adjacency(edges).select("src", F.size("nbrs").alias("degree"), codec.encoded_bytes(F.col("nbrs")).cast("long").alias("nbytes"))
    # Offsets are prefix sums over buckets of sources, then within each; there are at most OFFSET_BUCKETS of them.
    placed = cut(numbered(rows, "src", "row"))
    width = max(4096, -(-placed.count() // OFFSET_BUCKETS))
    placed = placed.withColumn("bucket", F.floor(F.col("row") / width))
    sums = placed.groupBy("bucket").agg(F.sum("nbytes").alias("n"))
    before = sums.select("bucket", (F.sum("n").over(Window.orderBy("bucket")) - F.col("n")).alias("before"))
    own = F.sum("nbytes").over(Window.partitionBy("bucket").orderBy("src")) - F.col("nbytes")
    return placed.withColumn("own", own).join(F.broadcast(before), "bucket").select("src", "degree", "nbytes", (F.col("own") + F.col("before")).alias("byte_start"))


def integrity(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row of counts: self loops, ends out of range, repeated edges, nodes without an edge in, least and greatest in-degree."""
    known = nodes.select(F.col("id").alias("dst"))
    inward = known.join(edges.groupBy("dst").agg(F.count("*").alias("d")), "dst", "left").select(F.coalesce("d", F.lit(0)).alias("d"))
    loops = edges.agg(F.sum((F.col("src") == F.col("dst")).cast("long")).alias("self_loops"), (F.count("*") - F.count_distinct("src", "dst")).alias("duplicates"))
    outside = edges.join(known, "dst", "left_anti").agg(F.count("*").alias("out_of_range"))
    degrees = inward.agg(F.sum((F.col("d") == 0).cast("long")).alias("unreferenced"), F.min("d").alias("min_in"), F.max("d").alias("max_in"))
    return loops.join(F.broadcast(outside)).join(F.broadcast(degrees))


def verify(base: DataFrame, edges: DataFrame, order: DataFrame, routes: DataFrame) -> DataFrame:
    """Named checks and the rows that fail each; 0 everywhere is a good index. routes: node_id, block_id."""
    ids, n = base.select("id"), order.count()
    checks = {
        "edge_range": edges.join(ids, edges["dst"] == ids["id"], "left_anti"),
        "nan_vectors": base.where(F.exists("v", lambda x: F.isnan(x) | x.isNull())),
        "label_unique": ids.groupBy("id").count().where("count > 1"),
        "order_unique": order.groupBy("new_id").count().where("count > 1"),
        "order_range": order.where((F.col("new_id") < 0) | (F.col("new_id") >= n)),
        "order_covers": ids.join(order, ids["id"] == order["old_id"], "left_anti"),
        "one_block": routes.groupBy("node_id").count().where("count > 1"),
        "route_covers": order.join(routes, order["new_id"] == routes["node_id"], "left_anti"),
    }
    rows = [d.agg(F.lit(name).alias("check"), F.count("*").alias("failures")) for name, d in checks.items()]
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out
