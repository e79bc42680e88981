"""Vector files: records of a 32-bit length and that many floats, bytes or integers (fvecs, bvecs, ivecs), and indexes.

Files are read and written through Spark, so that any path that it can open will do.
"""

from __future__ import annotations

import json

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Element type of a format, and the type of its column.
FORMATS = {"fvecs": ("<f4", "array<float>"), "bvecs": ("u1", "array<int>"), "ivecs": ("<i4", "array<int>")}


def parse(data: bytes, kind: str, strict: bool = False) -> np.ndarray:
    """Rows of a file. All have the first one's length; bytes of a part of a record at the end are ignored, or an error if strict."""
    dtype = np.dtype(FORMATS[kind][0])
    if len(data) < 4:
        return np.zeros((0, 0), dtype)
    dim = int(np.frombuffer(data, "<i4", 1)[0])
    size = 4 + dim * dtype.itemsize
    if dim < 1 or size < 5:
        raise ValueError("a record has no numbers")
    if strict and len(data) % size:
        raise ValueError("the file ends within a record")
    rows = np.frombuffer(data, np.uint8, len(data) // size * size).reshape(-1, size)
    if (rows[:, :4].copy().view("<i4") != dim).any():
        raise ValueError("records have different lengths")
    return rows[:, 4:].copy().view(dtype)


def pack(rows: np.ndarray, kind: str) -> bytes:
    rows = np.ascontiguousarray(rows, np.dtype(FORMATS[kind][0]))
    head = np.full((len(rows), 1), rows.shape[1], "<i4")
    return np.concatenate((head.view(np.uint8).reshape(len(rows), -1), rows.view(np.uint8).reshape(len(rows), -1)), axis=1).tobytes()


def read(spark: SparkSession, path: str, kind: str = "fvecs", strict: bool = False) -> DataFrame:
    """path, row and v of every record. A file is one task's work; large sets are kept as many files."""
    column = FORMATS[kind][1]
    arrow = pa.list_(pa.float32()) if kind == "fvecs" else pa.list_(pa.int32())

    def run(batches):
        for batch in batches:
            for name, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                rows = parse(data.as_py(), kind, strict)
                for a in range(0, len(rows), 10_000):
                    part = rows[a : a + 10_000]
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(part), pa.string()), pa.array(np.arange(a, a + len(part))), pa.array(list(part), arrow)], ["path", "row", "v"])

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(run, f"path string, row long, v {column}")


def packed(vectors: DataFrame, kind: str = "fvecs", order: str = "id", files: int | None = None) -> DataFrame:
    """part and content: the bytes of a file for each range of ids, the parts' order being that of the ids."""
    n = files or vectors.sparkSession.sparkContext.defaultParallelism

    def run(batches):
        from pyspark import TaskContext

        parts = []
        for batch in batches:
            if batch.num_rows:
                flat = batch.column(0).flatten().to_numpy(zero_copy_only=False)
                parts.append(pack(flat.reshape(batch.num_rows, -1), kind))
        if parts:
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int64()), pa.array([b"".join(parts)], pa.binary())], ["part", "content"])

    return vectors.repartitionByRange(n, order).sortWithinPartitions(order).select("v").mapInArrow(run, "part long, content binary")


def unpacked(parts: DataFrame, kind: str = "fvecs", strict: bool = True) -> DataFrame:
    """part, row and v of the files that packed() makes."""
    column = FORMATS[kind][1]
    arrow = pa.list_(pa.float32()) if kind == "fvecs" else pa.list_(pa.int32())

    def run(batches):
        for batch in batches:
            for part, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                rows = parse(data.as_py(), kind, strict)
                yield pa.RecordBatch.from_arrays([pa.array([part] * len(rows), pa.int64()), pa.array(np.arange(len(rows))), pa.array(list(rows), arrow)], ["part", "row", "v"])

    return parts.mapInArrow(run, f"part long, row long, v {column}")


def truth_bytes(ids: np.ndarray) -> bytes:
    """Ground truth: rows and columns as 32-bit numbers, then 64-bit ids."""
    return np.array(ids.shape, "<u4").tobytes() + np.ascontiguousarray(ids, "<u8").tobytes()


def truth(data: bytes, k: int | None = None) -> np.ndarray:
    """Ids of each query; a k that differs from the file's is an error, never a shift of the rows."""
    n, stored = np.frombuffer(data, "<u4", 2).tolist()
    if k is not None and k != stored:
        raise ValueError(f"the file has {stored} neighbours a query, not {k}")
    if len(data) != 8 + 8 * n * stored:
        raise ValueError("the file's size doesn't match its header")
    return np.frombuffer(data, "<u8", offset=8).reshape(n, stored).astype(np.int64)


def truth_parts(result: DataFrame, k: int, files: int | None = None) -> DataFrame:
    """part, query_ids and content of a ground-truth file for each range of queries: result has query_id, rank and id, k rows of each query."""
    n = files or result.sparkSession.sparkContext.defaultParallelism
    lists = result.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "id"))), lambda s: s["id"]).alias("ids"))

    def run(batches):
        from pyspark import TaskContext

        for number, batch in enumerate(batches):
            if batch.num_rows:
                flat = batch.column(1).flatten().to_numpy(zero_copy_only=False)
                if len(flat) != k * batch.num_rows:
                    raise ValueError(f"a query doesn't have {k} neighbours")
                part = (TaskContext.get().partitionId() << 32) + number
                yield pa.RecordBatch.from_arrays([pa.array([part], pa.int64()), pa.array([batch.column(0).to_pylist()], pa.list_(pa.int64())), pa.array([truth_bytes(flat.reshape(-1, k))], pa.binary())], ["part", "query_ids", "content"])

    return lists.repartitionByRange(n, "query_id").sortWithinPartitions("query_id").mapInArrow(run, "part long, query_ids array<long>, content binary")


def truth_rows(parts: DataFrame, k: int | None = None) -> DataFrame:
    """query_id, at (from 0) and id of every neighbour of truth_parts()."""

    def run(batches):
        for batch in batches:
            for query_ids, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = truth(content.as_py(), k)
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.array(query_ids, np.int64), ids.shape[1])), pa.array(np.tile(np.arange(ids.shape[1], dtype=np.int32), len(ids))), pa.array(ids.ravel())], ["query_id", "at", "id"])

    return parts.select("query_ids", "content").mapInArrow(run, "query_id long, at int, id long")


def save_index(index: DataFrame, meta: dict, path: str) -> None:
    """Nodes as Parquet in ranges of ids, which lets readers skip row groups, and one row of JSON."""
    index.repartitionByRange("id").sortWithinPartitions("id").write.mode("overwrite").parquet(f"{path}/nodes")
    index.sparkSession.createDataFrame([(json.dumps({"version": 1} | meta),)], "meta string").coalesce(1).write.mode("overwrite").text(f"{path}/meta")


def load_index(spark: SparkSession, path: str, max_elements: int | None = None) -> tuple[DataFrame, dict]:
    """Nodes and meta. The count stored must be there; ef is back to its default of 10."""
    meta = json.loads(spark.read.text(f"{path}/meta").first()[0])
    nodes = spark.read.parquet(f"{path}/nodes")
    count = nodes.count()
    if count != meta.get("count", count):
        raise ValueError("the index has another number of nodes than it says")
    if max_elements is not None and max_elements < count:
        raise ValueError("the index doesn't fit max_elements")
    return nodes, meta | {"ef": 10, "count": count}


def slim(index: DataFrame, links: bool = False) -> DataFrame:
    """Upper levels' nodes with vectors only, or ids and links of all: column pruning and a filter at the scan."""
    if links:
        return index.select("id", "level", F.element_at("links", 1).alias("nbrs"))
    return index.where("level > 0").select("id", "level", "v", "links")
