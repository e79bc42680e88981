"""Vector files as a Spark data source: read by ranges of records, written as one file for each partition.

Files lie on a path that all executors share as a file system; `vectors.read` serves any other path that Spark can open, a
file at a time. A split is a range of whole records, so that a file of any size is read by many tasks, none of which holds
more than CHUNK records at once.
"""

from __future__ import annotations

import os
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from vecforge.sources.vectors import FORMATS, pack, parse

#: Records of a split, and records that a task holds at once.
SPLIT, CHUNK = 1_000_000, 10_000


class Range(InputPartition):
    """Records first to last of a file."""

    def __init__(self, path: str, first: int, last: int, dim: int) -> None:
        self.path, self.first, self.last, self.dim = path, first, last, dim


class RecordReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.path, self.kind = options["path"], options.get("kind", "fvecs")
        self.strict, self.split = options.get("strict", "false") == "true", int(options.get("split", SPLIT))

    def files(self) -> list[str]:
        if os.path.isfile(self.path):
            return [self.path]
        return sorted(os.path.join(self.path, f) for f in os.listdir(self.path) if not f.startswith(("_", ".")))

    def partitions(self) -> list[InputPartition]:
        out: list[InputPartition] = []
        for path in self.files():
            size = os.path.getsize(path)
            if size < 4:
                continue
            with open(path, "rb") as f:
                dim = int(np.frombuffer(f.read(4), "<i4")[0])
            if dim < 1:
                raise ValueError(f"{path}: a record has no numbers")
            record = 4 + dim * np.dtype(FORMATS[self.kind][0]).itemsize
            if self.strict and size % record:
                raise ValueError(f"{path}: the file ends within a record")
            n = size // record
            out += [Range(path, a, min(a + self.split, n), dim) for a in range(0, n, self.split)]
        return out or [Range("", 0, 0, 0)]

    def read(self, partition: Range):
        record = 4 + partition.dim * np.dtype(FORMATS[self.kind][0]).itemsize
        for a in range(partition.first, partition.last, CHUNK):
            n = min(CHUNK, partition.last - a)
            with open(partition.path, "rb") as f:
                f.seek(a * record)
                rows = parse(f.read(n * record), self.kind, True)
            if rows.shape != (n, partition.dim):
                raise ValueError(f"{partition.path}: records have different lengths")
            values = pa.array(rows.ravel() if self.kind == "fvecs" else rows.ravel().astype(np.int32))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * partition.dim), values)
            yield pa.RecordBatch.from_arrays([pa.array([partition.path] * n, pa.string()), pa.array(np.arange(a, a + n)), lists], ["path", "row", "v"])


class Written(WriterCommitMessage):
    def __init__(self, made: str, name: str) -> None:
        self.made, self.name = made, name


class RecordWriter(DataSourceArrowWriter):
    """Writes under a name of its own first; files appear when all of them are there, those of failed attempts never do."""

    def __init__(self, options: dict, overwrite: bool) -> None:
        self.path, self.kind, self.overwrite, self.job = options["path"], options.get("kind", "fvecs"), overwrite, uuid.uuid4().hex

    def write(self, iterator) -> Written:
        from pyspark import TaskContext

        os.makedirs(self.path, exist_ok=True)
        context = TaskContext.get()
        made = os.path.join(self.path, f"_{self.job}-{context.partitionId()}-{context.taskAttemptId()}")
        dim = None
        with open(made, "wb") as f:
            for batch in iterator:
                column = batch.column(batch.schema.get_field_index("v"))
                if not len(column):
                    continue
                flat = column.flatten().to_numpy(zero_copy_only=False)
                sizes = {len(flat) // len(column)} if len(flat) % len(column) == 0 else {-1}
                dim = dim or next(iter(sizes))
                if sizes != {dim} or (np.diff(column.offsets.to_numpy()) != dim).any():
                    raise ValueError("vectors have different lengths")
                f.write(pack(flat.reshape(len(column), dim), self.kind))
        return Written(made, f"part-{context.partitionId():06d}.{self.kind}")

    def commit(self, messages: list) -> None:
        os.makedirs(self.path, exist_ok=True)
        if self.overwrite:
            for name in os.listdir(self.path):
                if name.endswith(f".{self.kind}"):
                    os.remove(os.path.join(self.path, name))
        for m in messages:
            if os.path.getsize(m.made):
                os.replace(m.made, os.path.join(self.path, m.name))
            else:
                os.remove(m.made)

    def abort(self, messages: list) -> None:
        for m in messages:
            if m is not None and os.path.exists(m.made):
                os.remove(m.made)


class RecordFiles(DataSource):
    """spark.read.format("vectorfile").option("kind", "fvecs" or "bvecs" or "ivecs").load(path)."""

    @classmethod
    def name(cls) -> str:
        return "vectorfile"

    def schema(self) -> str:
        return f"path string, row long, v {FORMATS[self.options.get('kind', 'fvecs')][1]}"

    def reader(self, schema) -> RecordReader:
        return RecordReader(dict(self.options))

    def writer(self, schema, overwrite: bool) -> RecordWriter:
        return RecordWriter(dict(self.options), overwrite)


def read(spark: SparkSession, path: str, kind: str = "fvecs", strict: bool = False, split: int = SPLIT) -> DataFrame:
    """path, row and v of every record of a file or of a folder's files."""
    spark.dataSource.register(RecordFiles)
    return spark.read.format("vectorfile").option("kind", kind).option("strict", str(strict).lower()).option("split", str(split)).load(path)


def write(vectors: DataFrame, path: str, kind: str = "fvecs", order: str = "id", files: int | None = None) -> None:
    """Writes the vectors (v) in the order of a column, the files' names in that order too."""
    spark = vectors.sparkSession
    spark.dataSource.register(RecordFiles)
    n = files or spark.sparkContext.defaultParallelism
    ordered = vectors.repartitionByRange(n, order).sortWithinPartitions(order).select("v")
    ordered.write.format("vectorfile").option("kind", kind).option("path", path).mode("overwrite").save()
