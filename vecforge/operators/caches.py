"""Cache policies over an access trace (cache_id, seq, block_id): simulated, or in closed form.

A cache's state follows from all accesses before, so each cache is one ordered group; caches are independent.
"""

from __future__ import annotations

import heapq
from collections import OrderedDict, deque

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vecforge.plans.lineage import cut

#: Factor by which heat decays at an access and at a query's end; heats above which a block is hot, warm, or counts at all.
DECAY, HOT, WARM, COLD = 0.995, 10.0, 1.0, 0.01
#: Accesses of a stretch of the trace that one group holds.
STRETCH = 50_000


class Lru:
    def __init__(self, slots: int) -> None:
        self.slots, self.held = slots, OrderedDict()

    def access(self, block: int, now: int) -> bool:
        if hit := block in self.held:
            self.held.move_to_end(block)
        else:
            if len(self.held) >= self.slots:
                self.held.popitem(last=False)
            self.held[block] = True
        return hit


class Lfu:
    """The victim has the least count, and of those came in first."""

    def __init__(self, slots: int) -> None:
        self.slots, self.held, self.heap = slots, {}, []

    def access(self, block: int, now: int) -> bool:
        if block in self.held:
            count, since = self.held[block]
            self.held[block] = (count + 1, since)
            heapq.heappush(self.heap, (count + 1, since, block))
            return True
        while len(self.held) >= self.slots:
            count, since, victim = heapq.heappop(self.heap)
            if self.held.get(victim) == (count, since):
                del self.held[victim]
        self.held[block] = (1, now)
        heapq.heappush(self.heap, (1, now, block))
        return False


class LruK:
    """Blocks with fewer than k accesses go first, the oldest of them first; then the one whose k-th last access is oldest."""

    def __init__(self, slots: int, k: int = 2) -> None:
        self.slots, self.k, self.held = slots, k, {}

    def access(self, block: int, now: int) -> bool:
        if hit := block in self.held:
            self.held[block].append(now)
        else:
            if len(self.held) >= self.slots:
                del self.held[min(self.held, key=lambda b: (len(self.held[b]) >= self.k, self.held[b][0]))]
            self.held[block] = deque([now], maxlen=self.k)
        return hit


POLICIES = {"lru": Lru, "lfu": Lfu, "lru2": LruK}


def simulate(trace: DataFrame, policy: str, slots: int) -> DataFrame:
    """cache_id, seq, block_id and hit of every access."""
    kind = POLICIES[policy]

    def run(group: pa.Table) -> pa.Table:
        group = group.sort_by("seq")
        cache = kind(slots)
        hits = [cache.access(b, i) for i, b in enumerate(group.column("block_id").to_pylist())]
        return group.append_column("hit", pa.array(hits, pa.bool_()))

    return trace.select("cache_id", "seq", "block_id").groupBy("cache_id").applyInArrow(run, "cache_id long, seq long, block_id long, hit boolean")


def counters(accesses: DataFrame, slots: int) -> DataFrame:
    """Accesses, hits, misses, evictions and hit rate of each cache."""
    per = accesses.groupBy("cache_id").agg(F.count("*").alias("accesses"), F.sum(F.col("hit").cast("long")).alias("hits"))
    misses = F.col("accesses") - F.col("hits")
    return per.select("cache_id", "accesses", "hits", misses.alias("misses"), F.greatest(misses - slots, F.lit(0)).alias("evictions"), F.round(F.col("hits") / F.col("accesses"), 6).alias("hit_rate"))


def direct_mapped(trace: DataFrame, slots: int) -> DataFrame:
    """Hits of a cache whose slot is the id modulo its size: the access before in the slot was of the same id."""
    w = Window.partitionBy("cache_id", F.col("block_id") % slots).orderBy("seq")
    return trace.withColumn("hit", F.coalesce(F.lag("block_id").over(w) == F.col("block_id"), F.lit(False)))


def heat(trace: DataFrame) -> DataFrame:
    """Heat of each block after its accesses, and its class: h = h * DECAY + 1 at an access, all by DECAY at each query's end.

    In closed form, an access weighs DECAY to the number of later accesses of its block and of query ends after it. trace has
    query_no, dense from 0.
    """
    last = trace.agg(F.max("query_no").alias("last"))
    w = Window.partitionBy("block_id").orderBy(F.desc("seq"))
    weighed = trace.join(F.broadcast(last)).withColumn("later", F.row_number().over(w) - 1)
    h = weighed.groupBy("block_id").agg(F.sum(F.pow(F.lit(DECAY), F.col("later") + F.col("last") - F.col("query_no") + 1)).alias("h"))
    kind = F.when(F.col("h") > HOT, "hot").when(F.col("h") > WARM, "warm").otherwise("cold")
    return h.select("block_id", F.round("h", 6).alias("heat"), kind.alias("class"))


def missing(batch: DataFrame, cached: DataFrame) -> DataFrame:
    """Blocks of a batch that the cache doesn't hold."""
    return batch.join(cached, "block_id", "left_anti")


def missing_by_batch(trace: DataFrame) -> DataFrame:
    """query_no and block_id of the blocks of each batch that the batch before doesn't hold; all of a batch without one before."""
    batches = trace.select("query_no", "block_id").distinct()
    held = batches.select((F.col("query_no") + 1).alias("query_no"), "block_id")
    return batches.join(held, ["query_no", "block_id"], "left_anti")


def recent(trace: DataFrame, n: int, most: int = 1024) -> DataFrame:
    """The last n accesses, at most so many."""
    return trace.orderBy(F.desc("seq")).limit(min(n, most))


def prefetch_report(trace: DataFrame, window: int) -> DataFrame:
    """Fate of a prefetch of block_id + 1 at every access: needed within so many accesses of its cache, later, or never."""
    need = trace.select("cache_id", F.col("block_id").alias("wanted"), F.col("seq").alias("used"))
    made = trace.select("cache_id", (F.col("block_id") + 1).alias("wanted"), F.col("seq").alias("made"))
    both = made.select("cache_id", "wanted", F.col("made").alias("seq"), F.lit(None).cast("long").alias("used")).unionByName(need.select("cache_id", "wanted", F.col("used").alias("seq"), "used"))
    # The next use is a running minimum from the trace's end; a frame that shrinks would be summed anew at every access.
    w = Window.partitionBy("cache_id", "wanted").orderBy(F.desc("seq")).rowsBetween(Window.unboundedPreceding, -1)
    fate = both.withColumn("next", F.min("used").over(w)).where("used is null")
    gap = F.col("next") - F.col("seq")
    return fate.groupBy(F.when(gap.isNull(), "wasted").when(gap <= window, "timely").otherwise("late").alias("fate")).agg(F.count("*").alias("n"))


def stack_distances(blocks: list[int]) -> np.ndarray:
    """Distinct blocks since each block's access before, -1 for the first; an LRU cache hits where it is below its slots."""
    out, stack = np.full(len(blocks), -1, np.int64), []
    for i, b in enumerate(blocks):
        if b in stack:
            at = stack.index(b)
            out[i] = len(stack) - 1 - at
            del stack[at]
        stack.append(b)
    return out


def followers(trace: DataFrame, window: int) -> DataFrame:
    """ahead, src, dst, n: accesses of node src, and of those before one of src if ahead, with dst among the next so many accesses.

    A null dst counts all accesses. Stretches of the trace are groups of bounded size, each with the accesses that its last
    ones look at; a node counts by its first access after each.
    """
    size = max(STRETCH, window)

    def run(key: tuple, group: pa.Table) -> pa.Table:
        at = group.column("seq").to_numpy() - key[0].as_py() * size
        nodes, own = np.unique(group.column("node").drop_null().to_numpy(), return_inverse=True)
        node, there = np.full(size + window, -1), np.zeros(size + window, bool)
        there[at], node[at[group.column("node").is_valid().to_numpy()]] = True, own
        before = np.full(len(node), -1)
        by = np.argsort(node, kind="stable")
        same = node[by][1:] == node[by][:-1]
        before[by[1:][same]] = by[:-1][same]
        owner, following = np.arange(size), [node, np.append(node[1:], -1)]
        held: list[list[np.ndarray]] = [[], []]
        for gap in range(1, window + 1):
            first = there[:size] & (node[gap : gap + size] >= 0) & (before[gap : gap + size] <= owner)
            for kind, keys in enumerate(held):
                met = first & (following[kind][:size] >= 0)
                keys.append(following[kind][:size][met] * len(nodes) + node[gap : gap + size][met])
        out = []
        for kind, keys in enumerate(held):
            code, n = np.unique(np.concatenate(keys), return_counts=True) if len(nodes) > 2000 else counted(np.concatenate(keys), len(nodes) ** 2)
            calls, m = counted(following[kind][:size][there[:size] & (following[kind][:size] >= 0)], len(nodes))
            src, dst = nodes[np.concatenate((code // max(1, len(nodes)), calls))], pa.array(nodes[code % max(1, len(nodes))], pa.int64())
            out.append(pa.table({"ahead": pa.array(np.full(len(src), kind == 1)), "src": pa.array(src, pa.int64()), "dst": pa.chunked_array([dst, pa.nulls(len(calls), pa.int64())]), "n": pa.array(np.concatenate((n, m)), pa.int64())}))
        return pa.concat_tables(out)

    part = F.floor(F.col("seq") / size)
    parts = F.explode(F.when(F.col("seq") % size < window, F.array(part, part - 1)).otherwise(F.array(part))).alias("part")
    return trace.select("seq", F.col("node").cast("long").alias("node"), parts).groupBy("part").applyInArrow(run, "ahead boolean, src long, dst long, n long").groupBy("ahead", "src", "dst").agg(F.sum("n").alias("n"))


def counted(keys: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Numbers under n that occur, and how often."""
    counts = np.bincount(keys, minlength=n)
    return np.flatnonzero(counts), counts[counts > 0]


def graph_prefetch(trace: DataFrame, edges: DataFrame, window: int, first: int = 8) -> DataFrame:
    """What prefetches along a graph would fetch at each access of a node, and how many of those are needed soon after.

    trace: seq (dense, from 0 or 1) and node; edges: src, dst, pos. one_hop fetches all neighbours, two_hop those of the first so many
    neighbours too, lookahead the neighbours of the node that is accessed next. Needed: accessed within so many accesses.

    What an access fetches follows from its node alone, so that nodes' sets meet counts of nodes and of pairs of them; no row
    is made for an access and what it fetches.
    """
    counts = cut(followers(trace, window))
    calls, pairs = counts.where("dst is null").drop("dst"), counts.where("dst is not null")
    own = edges.join(calls.select("src").distinct(), "src", "left_semi").select("src", "dst", "pos")
    one = own.select("src", "dst").distinct()
    near = own.where(F.col("pos") <= first).select("src", F.col("dst").alias("mid"))
    two = one.unionByName(near.join(edges.select(F.col("src").alias("mid"), "dst"), "mid").select("src", "dst")).distinct()
    kinds = [("one_hop", False, one), ("two_hop", False, two), ("lookahead", True, one)]
    wanted = None
    for kind, ahead, rows in kinds:
        rows = rows.select(F.lit(kind).alias("kind"), F.lit(ahead).alias("ahead"), "src", "dst")
        wanted = rows if wanted is None else wanted.unionByName(rows)
    fetched = wanted.groupBy("kind", "ahead", "src").agg(F.count("*").alias("size")).join(calls, ["ahead", "src"]).groupBy("kind").agg(F.sum(F.col("size") * F.col("n")).alias("fetched"))
    useful = wanted.join(pairs, ["ahead", "src", "dst"]).groupBy("kind").agg(F.sum("n").alias("useful"))
    return fetched.join(useful, "kind", "left").select("kind", "fetched", F.coalesce("useful", F.lit(0)).alias("useful"))
