"""Exact nearest-neighbour, radius and document search.

The stated query set travels to the base vectors in blocks of checked size; each partition of the base keeps its own best
k of every query, and only those meet in a shuffle. A query set beyond QUERY_BYTES, such as a base that is its own query
set, never passes through the driver: both sides are dealt to blocks, and every pair of blocks is one group. Ties go to
the smaller id everywhere.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vecforge.functions.distance import KERNELS
from vecforge.plans.lineage import cut

#: Bytes of query vectors that one block broadcasts at most, and of a query set that is broadcast at all; base rows that a kernel step holds.
BLOCK_BYTES, QUERY_BYTES, STEP = 32_000_000, 256_000_000, 2048
#: Vectors of a block of queries and of the base, at most, where both sides are dealt to blocks.
ASKED_ROWS, BLOCK_ROWS = 16384, 32768
#: Queries and base rows of one matrix product; base rows of the first one, from which first bounds come; pairs whose distance is summed at once.
ROWS, COLUMNS, FIRST, PAIRS = 1024, 2048, 512, 2048
#: Rounding unit of single precision, and the greatest squared norm that it is used for.
UNIT, LARGE = 2.0**-24, 1e37


def matrix(column: pa.Array) -> np.ndarray:
    """Rows of a list column as doubles; all must have one length."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    if len(column) and len(flat) % len(column):
        raise ValueError("vectors have different lengths")
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def pair_distances(q: np.ndarray, b: np.ndarray, rows: np.ndarray, cols: np.ndarray) -> np.ndarray:
    """Squared distances of pairs of rows, summed from the first dimension on as the kernel does."""
    out = np.empty(len(rows))
    for a in range(0, len(rows), PAIRS):
        d = q[rows[a : a + PAIRS]] - b[cols[a : a + PAIRS]]
        d *= d
        out[a : a + PAIRS] = np.add.accumulate(d, axis=1, out=d)[:, -1]
    return out


def first_copies(b: np.ndarray, k: int) -> np.ndarray:
    """Ascending numbers of rows of which fewer than k equal ones come before: no other can be among the k nearest."""
    _, kind = np.unique(np.ascontiguousarray(b).view(np.dtype((np.void, b.itemsize * b.shape[1]))).ravel(), return_inverse=True)
    order = np.argsort(kind, kind="stable")
    start = np.searchsorted(kind[order], kind[order])
    return np.sort(order[np.arange(len(order)) - start < k])


def by_row(rows: np.ndarray, n: int) -> np.ndarray:
    """Places within their row of ascending row numbers under n."""
    counts = np.bincount(rows, minlength=n)
    return np.arange(len(rows)) - np.repeat(np.cumsum(counts) - counts, counts)


def nearest_l2(q: np.ndarray, b: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Query numbers, ids and squared distances of the k nearest base rows of each query, ties to the smaller id.

    A product of matrices in single precision gives a lower bound of every distance: it is off by less than a share of both
    squared norms. Pairs whose bound is above the k-th distance that the query has seen can't be among its k nearest; the
    distances of all others are summed in doubles as everywhere, and they alone count. Norms that single precision can't
    hold, and NaN, go through the kernel.
    """
    qq, bb = (np.einsum("ij,ij->i", x, x) for x in (q, b))
    if not q.shape[1] or not (np.all(qq < LARGE) and np.all(bb < LARGE)):
        best = Best(k, len(q))
        for a in range(0, len(ids), STEP):
            best.add(ids[a : a + STEP], KERNELS["l2"](q, b[a : a + STEP]))
        return tuple(best.rows(np.arange(len(q))))
    order = np.argsort(ids, kind="stable")
    order = order[first_copies(b[order], k)]
    b, bb, ids = b[order], bb[order], ids[order]
    share = 4 * (q.shape[1] + 8) * UNIT
    left = np.hstack([-2 * q, np.ones((len(q), 1))]).astype(np.float32)
    right = np.ascontiguousarray(np.hstack([b, (bb * (1 - share))[:, None]]).astype(np.float32).T)
    edges = [0, *range(min(FIRST, len(ids)), len(ids), COLUMNS), len(ids)]
    room, parts = np.empty(ROWS * COLUMNS, np.float32), []
    for at in range(0, len(q), ROWS):
        own, n = q[at : at + ROWS], len(q[at : at + ROWS])
        base = qq[at : at + ROWS] * (1 - share)
        bound = np.full(n, np.inf)
        rows, cols, dist = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
        fresh, waiting = [], 0
        for a, e in zip(edges, edges[1:], strict=False):
            low = np.matmul(left[at : at + ROWS], right[:, a:e], out=room[: n * (e - a)].reshape(n, e - a))
            if a == 0 and e > k:
                near = np.argpartition(low, k - 1, axis=1)[:, :k]
                bound = pair_distances(own, b, np.repeat(np.arange(n), k), near.ravel()).reshape(n, k).max(axis=1)
            most = bound - base
            most = np.nextafter((most + 1e-30).astype(np.float32), np.float32(np.inf))
            hit = np.flatnonzero(low <= most[:, None])
            fresh.append((hit // (e - a), hit % (e - a) + a))
            waiting += len(hit)
            if waiting < n * k // 2 and e < len(ids):
                continue
            r, c = (np.concatenate(x) for x in zip(*fresh, strict=True))
            fresh, waiting = [], 0
            d = pair_distances(own, b, r, c)
            # Of equal distances the smaller id wins, and ids ascend: a bound that earlier rows have set must be undercut.
            new = d < bound[r] if len(rows) else d <= bound[r]
            rows, cols, dist = (np.concatenate((x, y[new])) for x, y in ((rows, r), (cols, c), (dist, d)))
            # Bounds need no order within a row; the end does, and so do ties beyond number.
            ordered = e == len(ids) or len(rows) > 4 * n * k
            by = np.lexsort((cols, dist, rows)) if ordered else np.argsort(rows.astype(np.uint16), kind="stable")
            rows, cols, dist = rows[by], cols[by], dist[by]
            place = by_row(rows, n)
            if ordered:
                last, keep = place == k - 1, place < k
                bound[rows[last]] = np.minimum(bound[rows[last]], dist[last])
            else:
                held = np.full((n, max(k, place.max(initial=0) + 1)), np.inf)
                held[rows, place] = dist
                held.partition(k - 1, axis=1)
                bound = np.minimum(bound, held[:, k - 1])
                keep = dist <= bound[rows]
            rows, cols, dist = rows[keep], cols[keep], dist[keep]
        parts.append((rows + at, ids[cols], dist))
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


def query_size(queries: DataFrame) -> tuple[int, int]:
    """Rows, and bytes of the vectors."""
    n, dim = queries.agg(F.count("*"), F.coalesce(F.max(F.size("v")), F.lit(0))).first()
    return n, n * dim * 8


def query_blocks(queries: DataFrame):
    """Ids and vectors of a stated query set, block by block of bounded size."""
    blocks = -(-query_size(queries)[1] // BLOCK_BYTES) or 1
    for k in range(blocks):
        part = queries if blocks == 1 else queries.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == k)
        got = part.select("query_id", "v").toArrow().combine_chunks()
        if len(got):
            yield got.column(0).to_numpy(), matrix(got.column(1).combine_chunks())


def spread(base: DataFrame) -> DataFrame:
    """The base over at least as many partitions as the session has cores: a small file scans as one."""
    n = base.sparkSession.sparkContext.defaultParallelism
    return base.repartition(n) if base.rdd.getNumPartitions() < n else base


CANDIDATES = "query_id long, id long, dist double"


def same_dimensions(q: np.ndarray, b: np.ndarray) -> None:
    if b.shape[1] != q.shape[1]:
        raise ValueError("queries and base have different dimensions")


class Best:
    """The k nearest rows of each query so far, as far as they have been seen."""

    def __init__(self, k: int, queries: int) -> None:
        self.keep = nearest(k)
        self.held = [(np.empty(0, np.int64), np.empty(0))] * queries

    def add(self, ids: np.ndarray, d: np.ndarray) -> None:
        for i, (own, dist) in enumerate(self.held):
            at = self.keep(d[i], ids)
            own, dist = np.concatenate((own, ids[at])), np.concatenate((dist, d[i][at]))
            best = self.keep(dist, own)
            self.held[i] = own[best], dist[best]

    def rows(self, query_ids: np.ndarray) -> list[np.ndarray]:
        """query_id, id and dist of all of them."""
        ids, dist = (np.concatenate([h[j] for h in self.held]) if self.held else np.empty(0) for j in (0, 1))
        return [np.repeat(query_ids, [len(h[0]) for h in self.held]), ids.astype(np.int64), dist]


def scan(base: DataFrame, queries: DataFrame, metric: str, step, schema: str = CANDIDATES, columns: tuple[str, ...] = ("id", "v"), end=None, state=None) -> DataFrame:
    """Runs over each partition of the base with each block of queries, on columns of the base, the vectors last.

    step(state, query ids, other columns, distances) gives arrays of rows or None; end(state, query ids) those left at a
    partition's end; state(number of queries) is made anew for every partition.
    """
    narrow, parts = spread(base.select(*columns)), []
    kernel = KERNELS[metric]
    names = [c.split()[0] for c in schema.split(", ")]
    for ids, vectors in query_blocks(queries):
        shared = base.sparkSession.sparkContext.broadcast((ids, vectors))

        def run(batches, shared=shared):
            q_ids, q = shared.value
            own = state(len(q_ids)) if state else None
            for batch in batches:
                others = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(len(columns) - 1)]
                for a in range(0, batch.num_rows, STEP):
                    b = matrix(batch.column(len(columns) - 1).slice(a, STEP))
                    same_dimensions(q, b)
                    rows = step(own, q_ids, [x[a : a + STEP] for x in others], kernel(q, b))
                    if rows is not None:
                        yield pa.RecordBatch.from_arrays([pa.array(c) for c in rows], names)
            if end:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in end(own, q_ids)], names)

        parts.append(narrow.mapInArrow(run, schema))
    if not parts:
        return base.sparkSession.createDataFrame([], schema)
    whole = parts[0]
    for p in parts[1:]:
        whole = whole.unionByName(p)
    return whole


def chosen_rows(keep):
    """A step that gives, of each query, the rows that keep(number of the query, distances, ids) chooses."""

    def step(_, q_ids, others, d):
        ids = others[0]
        picks = [keep(i, d[i], ids) for i in range(len(q_ids))]
        return [np.repeat(q_ids, [len(at) for at in picks]), np.concatenate([ids[at] for at in picks]), np.concatenate([d[i][at] for i, at in enumerate(picks)])]

    return step


def nearest_scan(base: DataFrame, queries: DataFrame, k: int, metric: str) -> DataFrame:
    """The k nearest rows of each partition and query."""
    return scan(base, queries, metric, lambda best, _, others, d: best.add(others[0], d), end=lambda best, q_ids: best.rows(q_ids), state=lambda n: Best(k, n))


def nearest_by_blocks(base: DataFrame, queries: DataFrame, k: int, metric: str) -> DataFrame:
    """The k nearest rows of each pair of blocks and query: both sides dealt to blocks of bounded size, no row through the driver."""
    cores, kernel = base.sparkSession.sparkContext.defaultParallelism, KERNELS[metric]
    (rows, wide), (asked, size) = query_size(base), query_size(queries)
    least = max(1, int((4 * cores) ** 0.5))
    # Blocks hold fewer rows of vectors so long that they would be over their bytes.
    blocks = lambda n, size, most: max(least, -(-n // most), -(-size // BLOCK_BYTES))
    across, down = blocks(asked, size, ASKED_ROWS), blocks(rows, wide, BLOCK_ROWS)
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    # Both sides' numbers must have one type: an int and a long of equal value are dealt to different partitions.
    block = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    left = queries.select("query_id", "v", block("query_id", across).alias("i"), every(down).alias("j"))
    right = base.select("id", "v", every(across).alias("i"), block("id", down).alias("j"))

    def meet(one: pa.Table, two: pa.Table) -> pa.Table:
        ids, own = two.column("id").to_numpy(), one.column("query_id").to_numpy()
        best = Best(k, len(own))
        out = best.rows(own)
        if len(ids) and len(own):
            q, b = (matrix(t.column("v").combine_chunks()) for t in (one, two))
            same_dimensions(q, b)
            if metric == "l2":
                at, found, dist = nearest_l2(q, b, ids, k)
                out = [own[at], found, dist]
            else:
                for a in range(0, len(ids), STEP):
                    best.add(ids[a : a + STEP], kernel(q, b[a : a + STEP]))
                out = best.rows(own)
        return pa.table(dict(zip(("query_id", "id", "dist"), (pa.array(c) for c in out), strict=True)))

    return left.groupBy("i", "j").cogroup(right.groupBy("i", "j")).applyInArrow(meet, CANDIDATES)


def ranked(candidates: DataFrame, most: int) -> DataFrame:
    """The nearest rows of each query, numbered from 1."""
    w = Window.partitionBy("query_id").orderBy("dist", "id")
    return candidates.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most)


def nearest(k: int):
    def keep(d: np.ndarray, ids: np.ndarray) -> np.ndarray:
        if len(d) > k:
            at = np.flatnonzero(d <= np.partition(d, k - 1)[k - 1])
        else:
            at = np.arange(len(d))
        return at[np.lexsort((ids[at], d[at]))[:k]]

    return keep


def knn(base: DataFrame, queries: DataFrame, k: int, metric: str = "l2", where: Column | None = None, strict: bool = False) -> DataFrame:
    """query_id, id, dist, rank of the k nearest base rows (id, v) of each query (query_id, v), after a filter on the base.

    A filter comes before ranking: the result is the best k of the rows allowed. Fewer than k rows is an error if strict.
    """
    allowed = base if where is None else base.where(where)
    by_blocks = query_size(queries)[1] > QUERY_BYTES
    out = ranked((nearest_by_blocks if by_blocks else nearest_scan)(allowed, queries, k, metric), k)
    if strict:
        full = queries.select("query_id").join(out.groupBy("query_id").count(), "query_id", "left").where(F.coalesce("count", F.lit(0)) < k)
        if not full.isEmpty():
            raise ValueError(f"a query has fewer than {k} results")
    return out


def radius(base: DataFrame, queries: DataFrame, eps: float, metric: str = "l2", most: int | None = None) -> DataFrame:
    """All base rows within eps (squared for l2), nearest first, at most so many of each query."""

    def keep(_: int, d: np.ndarray, ids: np.ndarray) -> np.ndarray:
        at = np.flatnonzero(d <= eps)
        return at if most is None or len(at) <= most else at[np.lexsort((ids[at], d[at]))[:most]]

    return ranked(scan(base, queries, metric, chosen_rows(keep)), most if most is not None else 2**31 - 1)


def before(d: np.ndarray, ids: np.ndarray, dist: float, x: int) -> np.ndarray:
    """Whether rows come before row x at a distance."""
    return (d < dist) | ((d == dist) & (ids < x))


def completed(found: DataFrame, base: DataFrame, queries: DataFrame, k: int, metric: str = "l2") -> DataFrame:
    """query_id, id, dist, rank: the rows that an approximate search found, with all that it missed: the k nearest of each query.

    An exact check after the search, which compares every query with all rows allowed (base) and gives those alone that come
    before the k-th row found and aren't among the found. Bounds are a row for each query of the stated set.
    """
    found = cut(found.select("query_id", "id", "dist", "rank"))
    bounds = {r["query_id"]: (r["dist"], r["id"]) for r in found.where(F.col("rank") == k).collect()}
    first = nearest(k)

    def missed(_, q_ids, others, d):
        ids, out = others[0], []
        for i, q in enumerate(q_ids.tolist()):
            at = np.flatnonzero(before(d[i], ids, *bounds[q])) if q in bounds else np.arange(len(ids))
            at = at[first(d[i][at], ids[at])]
            out.append((np.full(len(at), q), ids[at], d[i][at]))
        return [np.concatenate(c) for c in zip(*out, strict=True)]

    rest = scan(base, queries, metric, missed).join(found, ["query_id", "id"], "left_anti")
    return ranked(found.drop("rank").unionByName(rest), k)


def documents(base: DataFrame, queries: DataFrame, num_docs: int, metric: str = "l2") -> DataFrame:
    """The longest nearest prefix of each query with at most num_docs distinct doc_ids: base has id, v and doc_id.

    A document's place is its nearest vector; rows before the first vector of document num_docs + 1 are the result. Two
    scans: the first gives each document's nearest vector in each partition, from which the query's cut follows, the second
    the rows before the cut alone. Cuts are a row for each query of the stated set.
    """

    def nearest_of_each(held: list[dict], _, others, d):
        ids, docs = others
        for i, best in enumerate(held):
            order = np.lexsort((ids, d[i]))
            _, first = np.unique(docs[order], return_index=True)
            for at in order[np.sort(first)[: num_docs + 1]].tolist():
                own = (float(d[i][at]), int(ids[at]))
                best[int(docs[at])] = min(own, best.get(int(docs[at]), own))
            # No document beyond these can be one of the query's first num_docs + 1.
            held[i] = dict(sorted(best.items(), key=lambda x: x[1])[: num_docs + 1])

    def all_of_them(held: list[dict], q_ids):
        rows = [(q, doc, *own) for q, best in zip(q_ids.tolist(), held, strict=True) for doc, own in best.items()]
        return [np.array([r[j] for r in rows], kind) for j, kind in enumerate((np.int64, np.int64, np.float64, np.int64))]

    typed = base.withColumn("doc_id", F.col("doc_id").cast("long"))
    first = scan(typed, queries, metric, nearest_of_each, "query_id long, doc_id long, dist double, id long", ("id", "doc_id", "v"), all_of_them, lambda n: [{} for _ in range(n)])
    first = first.groupBy("query_id", "doc_id").agg(F.min(F.struct("dist", "id")).alias("first"))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("first"))
    cuts = first.withColumn("place", place).where(F.col("place") == num_docs + 1).select("query_id", "first.dist", "first.id")
    bounds = {r["query_id"]: (r["dist"], r["id"]) for r in cuts.collect()}

    def before_the_cut(_, q_ids, others, d):
        ids = others[0]
        out = []
        for i, q in enumerate(q_ids.tolist()):
            dist, x = bounds.get(q, (np.inf, 0))
            at = np.flatnonzero(before(d[i], ids, dist, x))
            out.append((np.full(len(at), q), ids[at], d[i][at]))
        return [np.concatenate(c) for c in zip(*out, strict=True)]

    kept = scan(base, queries, metric, before_the_cut).join(base.select("id", "doc_id"), "id")
    return kept.select("query_id", "id", "doc_id", "dist", F.row_number().over(Window.partitionBy("query_id").orderBy("dist", "id")).alias("rank"))
