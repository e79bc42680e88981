"""Layered proximity graphs: building and searching them shard by shard.

Base vectors are dealt to shards of bounded size; each shard is one group that builds or searches its own graph, and the
shards' best rows are merged by exact order. So no graph is ever broadcast, and more vectors mean more shards. The stated
query set travels in blocks of checked size.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vecforge.functions.distance import KERNELS
from vecforge.operators import exact
from vecforge.operators.graph import level, select_neighbours
from vecforge.plans.options import BuildOptions, SearchOptions


def fast(metric: str, q: np.ndarray, b: np.ndarray) -> np.ndarray:
    """All distances by matrix products; equal to the kernels' but for rounding."""
    if metric == "l2":
        return np.maximum((q * q).sum(axis=1)[:, None] - 2 * (q @ b.T) + (b * b).sum(axis=1)[None, :], 0)
    if metric == "ip":
        return 1 - q @ b.T
    return KERNELS[metric](q, b)


@dataclass
class Layers:
    """A graph in memory: vectors, levels, and neighbour lists by level."""

    ids: np.ndarray
    vectors: np.ndarray
    levels: np.ndarray
    links: list[dict[int, list[int]]] = field(default_factory=list)
    entry: int = -1
    metric: str = "l2"
    hops: int = 0
    computed: int = 0

    def distances(self, q: np.ndarray, to: list[int] | np.ndarray) -> np.ndarray:
        """For the walk alone, in whatever order of summation is fastest; results are computed anew."""
        self.computed += len(to)
        return fast(self.metric, q[None, :], self.vectors[to])[0]

    def descend(self, q: np.ndarray, start: int, top: int, bottom: int) -> int:
        """Greedy walk from level top down to the one above bottom, always to a strictly nearer neighbour."""
        at, best = start, float(self.distances(q, [start])[0])
        for lv in range(top, bottom, -1):
            moved = True
            while moved:
                moved = False
                near = self.links[lv].get(at, [])
                if near:
                    self.hops += 1
                    d = self.distances(q, near)
                    k = int(d.argmin())
                    if d[k] < best:
                        at, best, moved = near[k], float(d[k]), True
        return at

    def best_first(self, q: np.ndarray, start: int, ef: int, lv: int, allowed: np.ndarray | None = None, width: int = 1) -> list[tuple[float, int]]:
        """The ef nearest nodes found, nearest first. Nodes that aren't allowed are walked through but not returned.

        With a width over 1, that many candidates are expanded against one bound before it is renewed.
        """
        seen = np.zeros(len(self.ids), bool)
        seen[start] = True
        d = float(self.distances(q, [start])[0])
        frontier = [(d, start)]
        found = [(-d, -start)] if allowed is None or allowed[start] else []
        while frontier:
            full = len(found) >= ef
            if frontier[0][0] > (-found[0][0] if found else np.inf) and (full or allowed is None):
                break
            batch = [heapq.heappop(frontier) for _ in range(min(width, len(frontier)))]
            bound = -found[0][0] if found else np.inf
            for _, node in batch:
                near = [x for x in self.links[lv].get(node, []) if not seen[x]]
                self.hops += 1
                if not near:
                    continue
                seen[near] = True
                for dist, x in zip(self.distances(q, near).tolist(), near, strict=True):
                    if len(found) < ef or dist < bound:
                        heapq.heappush(frontier, (dist, x))
                        if allowed is None or allowed[x]:
                            heapq.heappush(found, (-dist, -x))
                            if len(found) > ef:
                                heapq.heappop(found)
                        if width == 1 and found:
                            bound = -found[0][0]
        return sorted((-a, -b) for a, b in found)

    def link(self, node: int, lv: int, near: list[tuple[float, int]], m: int, most: int) -> int:
        """Connects a node both ways to selected neighbours; lists over the limit are selected anew. Gives the nearest."""
        ids = [x for _, x in near]
        v = self.vectors[ids]
        kept = [ids[i] for i in select_neighbours(np.array([d for d, _ in near]), fast(self.metric, v, v), m)]
        self.links[lv][node] = kept
        for x in kept:
            back = self.links[lv].setdefault(x, [])
            back.append(node)
            if len(back) > most:
                d = self.distances(self.vectors[x], back)
                order = np.lexsort((np.array(back), d))
                ranked = [back[i] for i in order]
                v = self.vectors[ranked]
                self.links[lv][x] = [ranked[i] for i in select_neighbours(d[order], fast(self.metric, v, v), most)]
        return ids[0]

    def search_many(self, queries: np.ndarray, k: int, ef: int, width: int = 1) -> list[list[tuple[float, int]]]:
        """search() of many queries in lockstep: one array of distances serves a round of all of them."""
        if self.entry < 0:
            return [[] for _ in queries]
        starts = [self.descend(q, self.entry, int(self.levels[self.entry]), 0) for q in queries]
        first = self.pair_distances(queries, np.arange(len(queries)), np.array(starts, np.int64))
        seen = np.zeros((len(queries), len(self.ids)), bool)
        seen[np.arange(len(queries)), starts] = True
        frontier = [[(d, x)] for d, x in zip(first, starts, strict=True)]
        found = [[(-d, -x)] for d, x in zip(first, starts, strict=True)]
        ef, active = max(ef, k), list(range(len(queries)))
        while active:
            who, what, bounds = [], [], {}
            for i in active:
                heap = frontier[i]
                if not heap or heap[0][0] > -found[i][0][0]:
                    continue
                batch = [heapq.heappop(heap) for _ in range(min(width, len(heap)))]
                bounds[i] = -found[i][0][0]
                self.hops += len(batch)
                for _, node in batch:
                    near = [x for x in self.links[0].get(node, []) if not seen[i, x]]
                    seen[i, near] = True
                    who += [i] * len(near)
                    what += near
            distances = self.pair_distances(queries, np.array(who, np.int64), np.array(what, np.int64))
            for i, x, dist in zip(who, what, distances, strict=True):
                if len(found[i]) < ef or dist < bounds[i]:
                    heapq.heappush(frontier[i], (dist, x))
                    heapq.heappush(found[i], (-dist, -x))
                    if len(found[i]) > ef:
                        heapq.heappop(found[i])
                    if width == 1:
                        bounds[i] = -found[i][0][0]
            active = list(bounds)
        return [self.exact_best(q, [-x for _, x in f], k) for q, f in zip(queries, found, strict=True)]

    def pair_distances(self, queries: np.ndarray, who: np.ndarray, what: np.ndarray) -> list[float]:
        """Distance of query who[i] to node what[i], for the walk alone."""
        self.computed += len(who)
        a, b = queries[who], self.vectors[what]
        if self.metric == "l2":
            return ((a - b) ** 2).sum(axis=1).tolist()
        if self.metric == "ip":
            return (1 - (a * b).sum(axis=1)).tolist()
        return [float(KERNELS[self.metric](x[None, :], y[None, :])[0, 0]) for x, y in zip(a, b, strict=True)]

    def exact_best(self, q: np.ndarray, found: list[int], k: int) -> list[tuple[float, int]]:
        """The k nearest of the nodes found, by distances computed anew, ties to the smaller node."""
        if not found:
            return []
        d = KERNELS[self.metric](q[None, :], self.vectors[found])[0]
        return sorted(zip(d.tolist(), found, strict=True))[:k]

    def search(self, q: np.ndarray, k: int, ef: int, allowed: np.ndarray | None = None, width: int = 1) -> list[tuple[float, int]]:
        if self.entry < 0:
            return []
        start = self.descend(q, self.entry, int(self.levels[self.entry]), 0)
        return self.exact_best(q, [x for _, x in self.best_first(q, start, max(ef, k), 0, allowed, width)], k)


def build(ids: np.ndarray, vectors: np.ndarray, levels: np.ndarray, options: BuildOptions) -> Layers:
    """Inserts the vectors one by one in ascending id."""
    g = Layers(ids, vectors, levels, [{} for _ in range(int(levels.max(initial=-1)) + 1)], metric=options.metric)
    for node in range(len(ids)):
        own = int(levels[node])
        for lv in range(own + 1):
            g.links[lv].setdefault(node, [])
        if g.entry < 0:
            g.entry = node
            continue
        top = int(levels[g.entry])
        at = g.descend(vectors[node], g.entry, top, min(own, top)) if top > own else g.entry
        for lv in range(min(own, top), -1, -1):
            near = g.best_first(vectors[node], at, options.ef, lv)
            at = g.link(node, lv, near, options.m, 2 * options.m if lv == 0 else options.m)
        if own > top:
            g.entry = node
    return g


INDEX = "shard long, id long, level int, entry boolean, v array<double>, links array<array<long>>"


def build_index(base: DataFrame, options: BuildOptions | None = None) -> DataFrame:
    """A row per vector (id, v): its shard, level, vector, and neighbour ids by level."""
    options = options or BuildOptions()
    shards = -(-base.count() // options.shard) or 1
    dealt = base.select(F.pmod(F.xxhash64("id"), F.lit(shards)).alias("shard"), "id", "v", level("id", options.m, options.seed).alias("level"))

    def run(group: pa.Table) -> pa.Table:
        group = group.sort_by("id")
        ids, levels = group.column("id").to_numpy(), group.column("level").to_numpy()
        g = build(ids, exact.matrix(group.column("v").combine_chunks()), levels, options)
        links = [[[int(ids[x]) for x in g.links[lv].get(n, [])] for lv in range(levels[n] + 1)] for n in range(len(ids))]
        return pa.table({"shard": group.column("shard"), "id": ids, "level": levels, "entry": np.arange(len(ids)) == g.entry, "v": group.column("v"), "links": pa.array(links, pa.list_(pa.list_(pa.int64())))})

    return dealt.groupBy("shard").applyInArrow(run, INDEX)


def restored(group: pa.Table, metric: str) -> Layers:
    group = group.sort_by("id")
    ids, levels = group.column("id").to_numpy(), group.column("level").to_numpy()
    links: list[dict[int, list[int]]] = [{} for _ in range(int(levels.max(initial=0)) + 1)]
    for n, by_level in enumerate(group.column("links").to_pylist()):
        for lv, near in enumerate(by_level):
            links[lv][n] = np.searchsorted(ids, near).tolist()
    entry = np.flatnonzero(group.column("entry").to_numpy(zero_copy_only=False))
    return Layers(ids, exact.matrix(group.column("v").combine_chunks()), levels, links, int(entry[0]) if len(entry) else -1, metric)


def search_index(index: DataFrame, queries: DataFrame, options: SearchOptions | None = None, metric: str = "l2", allowed: DataFrame | None = None) -> DataFrame:
    """query_id, id, dist, rank, and the hops and distances computed in the row's shard.

    allowed: ids that may be returned; others, such as deleted ones, are still walked through.
    """
    o = options or SearchOptions()
    rows = index.withColumn("ok", F.lit(True))
    if allowed is not None:
        rows = index.join(allowed.select("id", F.lit(True).alias("ok")), "id", "left").withColumn("ok", F.coalesce("ok", F.lit(False)))

    def searcher(shared):
        def run(group: pa.Table) -> pa.Table:
            q_ids, q = shared.value
            g = restored(group, metric)
            ok = group.sort_by("id").column("ok").to_numpy(zero_copy_only=False).astype(bool)
            out: list[tuple] = []
            if o.lockstep and ok.all():
                # hops and computed are those of the whole batch.
                many = g.search_many(q, o.k, o.ef, o.width)
                out += [(int(q_ids[i]), int(g.ids[n]), d, g.hops, g.computed) for i, got in enumerate(many) for d, n in got]
            else:
                for i in range(len(q_ids)):
                    g.hops = g.computed = 0
                    got = g.search(q[i], o.k, o.ef, None if ok.all() else ok, o.width)
                    out += [(int(q_ids[i]), int(g.ids[n]), d, g.hops, g.computed) for d, n in got]
            kinds = [pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64()]
            return pa.table([pa.array([r[j] for r in out], t) for j, t in enumerate(kinds)], ["query_id", "id", "dist", "hops", "computed"])

        return run

    parts = []
    for block in exact.query_blocks(queries):
        shared = index.sparkSession.sparkContext.broadcast(block)
        parts.append(rows.groupBy("shard").applyInArrow(searcher(shared), "query_id long, id long, dist double, hops long, computed long"))
    if not parts:
        return index.sparkSession.createDataFrame([], "query_id long, id long, dist double, hops long, computed long, rank int")
    whole = parts[0]
    for p in parts[1:]:
        whole = whole.unionByName(p)
    out = exact.ranked(whole, o.k)
    if o.strict and not out.groupBy("query_id").count().where(F.col("count") < o.k).isEmpty():
        raise ValueError(f"a query has fewer than {o.k} results")
    return out


def entry_points(index: DataFrame, queries: DataFrame, metric: str = "l2") -> DataFrame:
    """Where each query's greedy walk through the upper levels of each shard ends: query_id, shard, id, dist, hops.

    Upper levels hold a node in m of those below, so that what travels is a small part of the index; a shard without upper
    levels ends at its entry.
    """
    upper = index.where("level > 0 or entry").select("shard", "id", "level", "entry", "v", F.transform("links", lambda x, i: F.when(i > 0, x).otherwise(F.array().cast("array<long>"))).alias("links"))

    def walker(shared):
        def run(group: pa.Table) -> pa.Table:
            q_ids, q = shared.value
            g = restored(group, metric)
            out = []
            for i in range(len(q_ids)):
                g.hops = 0
                node = g.descend(q[i], g.entry, int(g.levels[g.entry]), 0)
                dist = float(KERNELS[metric](q[i][None, :], g.vectors[node][None, :])[0, 0])
                out.append((int(q_ids[i]), group.column("shard")[0].as_py(), int(g.ids[node]), dist, g.hops))
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.int64()]
            return pa.table([pa.array([r[j] for r in out], t) for j, t in enumerate(kinds)], ["query_id", "shard", "id", "dist", "hops"])

        return run

    schema, whole = "query_id long, shard long, id long, dist double, hops long", None
    for block in exact.query_blocks(queries):
        part = upper.groupBy("shard").applyInArrow(walker(index.sparkSession.sparkContext.broadcast(block)), schema)
        whole = part if whole is None else whole.unionByName(part)
    return whole if whole is not None else index.sparkSession.createDataFrame([], schema)


def edges_of(index: DataFrame) -> DataFrame:
    """level, src, dst and pos of every link."""
    by_level = index.select("id", F.posexplode("links").alias("level", "near"))
    return by_level.select("level", F.col("id").alias("src"), F.posexplode("near").alias("at", "dst")).select("level", "src", "dst", (F.col("at") + 1).alias("pos"))
