"""Product quantization: training, codes, table distances, two-stage search.

Codes and candidates move as narrow rows; full vectors are joined only to candidates. A codebook has m times k rows of
dim / m numbers, a size fixed by its parameters, and is broadcast.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vecforge.functions.distance import l2_sq, np_l2
from vecforge.operators import exact


def auto_m(dim: int, wanted: int | None = None) -> int:
    """Subspaces for a dimension: a wanted number that divides it; 32 for large multiples of 32; 8 for multiples of 8; else the largest divisor up to a quarter."""
    divisors = [m for m in range(1, dim + 1) if not dim % m]
    if wanted:
        if wanted not in divisors:
            raise ValueError(f"{wanted} subspaces don't divide {dim} dimensions")
        return wanted
    preferred = {32: dim >= 128, 8: True}
    fits = [m for m, allowed in preferred.items() if allowed and m in divisors]
    return fits[0] if fits else max(m for m in divisors if m == 1 or 4 * m <= dim)


def subvectors(base: DataFrame, m: int, dim: int) -> DataFrame:
    """A row per vector and subspace: id, m, sub."""
    width = dim // m
    parts = F.transform(F.sequence(F.lit(0), F.lit(m - 1)), lambda i: F.struct(i.alias("m"), F.slice("v", i * width + 1, F.lit(width)).alias("sub")))
    return base.select("id", F.explode(parts).alias("p")).select("id", "p.m", "p.sub")


def seed_codebook(base: DataFrame, m: int, dim: int, k: int = 256) -> DataFrame:
    """m, k, centroid: the subvectors of the k least ids."""
    first = base.orderBy("id").limit(k)
    rank = F.row_number().over(Window.orderBy("id")) - 1
    return subvectors(first, m, dim).join(F.broadcast(first.select("id", rank.alias("k"))), "id").select("m", "k", F.col("sub").alias("centroid"))


def lloyd(base: DataFrame, codebook: DataFrame, m: int, dim: int, steps: int = 1) -> DataFrame:
    """Steps of k-means in every subspace; a centroid without members stays."""
    for _ in range(steps):
        codes = encode(base, codebook, m, dim)
        labelled = subvectors(base, m, dim).join(codes.select("id", F.posexplode("code").alias("m", "k")), ["id", "m"])
        means = labelled.select("m", "k", F.posexplode("sub").alias("i", "x")).groupBy("m", "k", "i").agg(F.avg("x").alias("x"))
        moved = means.groupBy("m", "k").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("new"))
        codebook = codebook.join(moved, ["m", "k"], "left").select("m", "k", F.coalesce("new", "centroid").alias("centroid"))
    return codebook


def loaded(codebook: DataFrame) -> np.ndarray:
    """Subspace x centroid x number; its size is fixed by the parameters."""
    rows = codebook.select("m", "k", "centroid").orderBy("m", "k").collect()
    m = rows[-1]["m"] + 1
    return np.array([r["centroid"] for r in rows], np.float64).reshape(m, len(rows) // m, -1)


def encode(base: DataFrame, codebook: DataFrame, m: int, dim: int) -> DataFrame:
    """id and code: the nearest centroid of each subvector, the least of equally near ones."""
    shared = base.sparkSession.sparkContext.broadcast(loaded(codebook))

    def run(batches):
        book = shared.value
        for batch in batches:
            v = exact.matrix(batch.column(1))
            codes = np.zeros((len(v), len(book)), np.int64)
            for j, c in enumerate(book if len(v) else ()):
                codes[:, j] = np_l2(v[:, j * c.shape[1] : (j + 1) * c.shape[1]], c).argmin(axis=1)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(codes.tolist(), pa.list_(pa.int32()))], ["id", "code"])

    return base.select("id", "v").mapInArrow(run, "id long, code array<int>")


def decode_error(base: DataFrame, codes: DataFrame, codebook: DataFrame, m: int, dim: int) -> DataFrame:
    """Mean squared error of the vectors put together from their centroids, and its share of their energy."""
    sub = subvectors(base, m, dim).join(codes.select("id", F.posexplode("code").alias("m", "k")), ["id", "m"]).join(F.broadcast(codebook), ["m", "k"])
    err = l2_sq(F.col("sub"), F.col("centroid"))
    energy = F.aggregate("sub", F.lit(0.0), lambda s, x: s + x * x)
    return sub.agg(F.round(F.sum(err) / F.count_distinct("id"), 6).alias("mse"), F.round(F.sum(err) / F.sum(energy), 6).alias("relative"))


def distance_table(queries: DataFrame, codebook: DataFrame, m: int, dim: int) -> DataFrame:
    """query_id, m, k and the squared distance of the query's subvector to the centroid."""
    sub = subvectors(queries.withColumnRenamed("query_id", "id"), m, dim).withColumnRenamed("id", "query_id")
    return sub.join(F.broadcast(codebook), "m").select("query_id", "m", "k", l2_sq(F.col("sub"), F.col("centroid"), dim // m).alias("d"))


def tables(q: np.ndarray, book: np.ndarray) -> np.ndarray:
    """Query x subspace x centroid: squared distances."""
    width = book.shape[2]
    return np.stack([np_l2(q[:, j * width : (j + 1) * width], c) for j, c in enumerate(book)], axis=1)


def coarse(t: np.ndarray, code: np.ndarray) -> np.ndarray:
    """Query x row: table distances, summed from the first subspace on."""
    d = np.zeros((len(t), len(code)))
    for j in range(code.shape[1]):
        d += t[:, j, :][:, code[:, j]]
    return d


def adc_scan(codes: DataFrame, queries: DataFrame, codebook: DataFrame, most: int) -> DataFrame:
    """query_id, id, dist, rank: the most nearest codes of each query by table distances, each partition keeping its own best."""
    book, parts = loaded(codebook), []
    for ids, q in exact.query_blocks(queries):
        shared = codes.sparkSession.sparkContext.broadcast((ids, tables(q, book)))

        def run(batches, shared=shared):
            q_ids, t = shared.value
            best = exact.Best(most, len(q_ids))
            for batch in batches:
                own, code = batch.column(0).to_numpy(), exact.matrix(batch.column(1)).astype(np.int64)
                for a in range(0, len(own), exact.STEP):
                    best.add(own[a : a + exact.STEP], coarse(t, code[a : a + exact.STEP]))
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in best.rows(q_ids)], ["query_id", "id", "dist"])

        parts.append(exact.spread(codes.select("id", "code")).mapInArrow(run, exact.CANDIDATES))
    if not parts:
        return exact.ranked(codes.sparkSession.createDataFrame([], exact.CANDIDATES), most)
    whole = parts[0]
    for p in parts[1:]:
        whole = whole.unionByName(p)
    return exact.ranked(whole, most)


def quality(base: DataFrame, codes: DataFrame, queries: DataFrame, codebook: DataFrame) -> DataFrame:
    """Mean and greatest difference between table and exact distances of each query, over the whole base, summed within the scan."""
    book, parts = loaded(codebook), []
    both = exact.spread(base.select("id", "v").join(codes, "id").select("code", "v"))
    for ids, q in exact.query_blocks(queries):
        shared = codes.sparkSession.sparkContext.broadcast((ids, q, tables(q, book)))

        def run(batches, shared=shared):
            q_ids, q, t = shared.value
            total, most, n = np.zeros(len(q_ids)), np.zeros(len(q_ids)), 0
            for batch in batches:
                code, v = exact.matrix(batch.column(0)).astype(np.int64), exact.matrix(batch.column(1))
                for a in range(0, len(v), exact.STEP):
                    gap = np.abs(coarse(t, code[a : a + exact.STEP]) - np_l2(q, v[a : a + exact.STEP]))
                    total, most, n = total + gap.sum(axis=1), np.maximum(most, gap.max(axis=1)), n + gap.shape[1]
            if n:
                yield pa.RecordBatch.from_arrays([pa.array(q_ids), pa.array(total), pa.array(most), pa.array(np.full(len(q_ids), n))], ["query_id", "total", "most", "n"])

        parts.append(both.mapInArrow(run, "query_id long, total double, most double, n long"))
    if not parts:
        return codes.sparkSession.createDataFrame([], "query_id long, mean_error double, max_error double")
    whole = parts[0]
    for p in parts[1:]:
        whole = whole.unionByName(p)
    return whole.groupBy("query_id").agg(F.round(F.sum("total") / F.sum("n"), 6).alias("mean_error"), F.round(F.max("most"), 6).alias("max_error"))


def rerank(candidates: DataFrame, base: DataFrame, queries: DataFrame, k: int, hot: Column | None = None) -> DataFrame:
    """The k nearest candidates by exact distance; with hot, only those get it and others keep their coarse one."""
    exact_d = l2_sq(F.col("qv"), F.col("v"))
    full = candidates.select("query_id", "id", F.col("dist").alias("coarse")).join(base.select("id", "v"), "id").join(queries.select("query_id", F.col("v").alias("qv")), "query_id")
    return exact.ranked(full.select("query_id", "id", (exact_d if hot is None else F.when(hot, exact_d).otherwise(F.col("coarse"))).alias("dist")), k)


def two_stage(base: DataFrame, codes: DataFrame, queries: DataFrame, codebook: DataFrame, k: int, coarse: int) -> DataFrame:
    """Coarse candidates by codes, then exact distances of those alone."""
    return rerank(adc_scan(codes, queries, codebook, coarse), base, queries, k)
