"""What the operators share: Arrow text buffers, word hashing, checkpoints, table reading."""

from __future__ import annotations

import ctypes
import gc
import hashlib
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that one vectorised step holds at most, a single longer document excepted.
CHUNK_BYTES = 2_000_000
#: Bytes of a batch of rows that Python is handed where small_batches() holds.
BATCH_BYTES = 4 << 20
BATCH_LIMIT = "spark.sql.execution.arrow.maxBytesPerBatch"
#: Keys that can each have more than one part in so many of a table's rows.
HEAVY = 1000
#: Odd multiplier of the prefix polynomial hashes modulo 2**64.
BASE = 0x9E3779B97F4A7C15 | 1


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the data directory, by whatever path Spark can read."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder for checkpoints and written tables that all executors share."""
    sc = spark.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        folder = sc.getConf().get("spark.checkpoint.dir")
        if not folder and not sc.master.startswith("local"):
            raise ValueError("a cluster must name its shared folder in spark.checkpoint.dir")
        # A local session that names none gets a folder of its own.
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="vecforge-ckpt-"))
    return sc._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """The same rows with their lineage cut by a checkpoint in the folder that all executors share."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def release(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files (and checkpoints, if the session asks for it) of frames that nothing refers to any more.

    It does so only after a garbage collection of the driver, which a small heap may never need; without it a loop keeps the files of all rounds.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Actions within it hand rows to Python in batches of BATCH_BYTES, a larger single row excepted.

    Spark's own bound is 64 MB; of each batch, a task holds copies in Arrow's memory, beside the heap, and in the Python
    worker. No result depends on it. It is the session's setting, and afterwards what it was; frames that are to be run later don't have it.
    """
    before = spark.conf.get(BATCH_LIMIT)
    spark.conf.set(BATCH_LIMIT, str(BATCH_BYTES))
    try:
        yield
    finally:
        spark.conf.set(BATCH_LIMIT, before)


def give_back() -> None:
    """Gives the system back what this process has freed and its allocators keep, Arrow's and the C library's."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError, TypeError):  # not glibc
        pass


def tidy(run: Callable) -> Callable:
    """A function of batches for mapInArrow that leaves little memory behind, as Spark keeps its worker for later tasks."""

    def tidied(batches):
        yield from run(batches)
        give_back()

    return tidied


def stored(df: DataFrame) -> DataFrame:
    """The same rows, written to and read from a compressed table in the shared folder: for tables that are read more than once."""
    path = f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def meet(rows: DataFrame, keys: DataFrame, on: list[str], total: int) -> DataFrame:
    """rows with the columns of keys, which has one row for each key and how many of the total rows it has (`rows`).

    Keys of more than one row in HEAVY, at most HEAVY of them, are broadcast; so no task gets the rows of a heavy key.
    """
    heavy = F.broadcast(keys.where(F.col("rows") > total / HEAVY).drop("rows"))
    light = rows.join(heavy.select(*on), on, "left_anti").join(keys.where(F.col("rows") <= total / HEAVY).drop("rows"), on)
    return rows.join(heavy, on).unionByName(light)


def tasks(spark: SparkSession, least: int = 1) -> int:
    """Shuffle partitions that the session asks for."""
    return max(least, int(spark.conf.get("spark.sql.shuffle.partitions")))


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a text column, end to end, and where each row starts; nulls count as empty."""
    column = pc.fill_null(column, "") if column.null_count else column
    wide = pa.types.is_large_string(column.type)
    offsets = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = column.buffers()[2]
    return (np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)), offsets


def chunks(offsets: np.ndarray, most: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most so many bytes each (one longer row stands alone)."""
    first, n = 0, len(offsets) - 1
    while first < n:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + most, "right")) - 1)
        yield first, min(last, n)
        first = min(last, n)


class Powers:
    """Powers of BASE and of its inverse modulo 2**64, as far as they have been asked for."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    def to(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, CHUNK_BYTES + 1)
            with np.errstate(over="ignore"):
                for name, base in (("up", BASE), ("down", pow(BASE, -1, 1 << 64))):
                    steps = np.full(size, base, np.uint64)
                    steps[0] = 1
                    setattr(self, name, np.multiply.accumulate(steps))
        return self.up[:n], self.down[:n]


def mixed(h: np.ndarray) -> np.ndarray:
    """Bits of 64-bit hashes spread over the whole word."""
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        h = (h ^ (h >> np.uint64(29))) * np.uint64(0xA0761D6478BD642F | 1)
    return h ^ (h >> np.uint64(32))


#: Multipliers of span_hashes, and the bytes beyond which a span goes through blake2b instead of rounds of 8 bytes.
MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], np.uint64)
LONG_SPAN = 256
MASKS = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)


def span_hashes(padded: np.ndarray, start: np.ndarray, end: np.ndarray, seed: int = 0) -> np.ndarray:
    """64-bit hashes of the bytes start..end of an array with 8 more bytes at its end.

    Every round of 8 bytes is mixed in by a multiplication and a shift, which no two values of a round survive alike, so
    that repetitive texts collide no more often than others do; a polynomial modulo 2**64 would let them.
    """
    words_ = np.ndarray((len(padded) - 7,), "<u8", padded.data, 0, (1,))
    size = end - start
    with np.errstate(over="ignore"):
        h = (size.astype(np.uint64) + np.uint64(seed)) * MIX[0]
        at, who, left = start, None, size
        while True:
            part = words_[at] & MASKS[np.minimum(left, 8)]
            old = h if who is None else h[who]
            new = (old ^ (old >> np.uint64(32)) ^ part) * MIX[1]
            new ^= new >> np.uint64(29)
            if who is None:
                h = new
            else:
                h[who] = new
            more = np.flatnonzero((left > 8) & (left <= LONG_SPAN))
            if not len(more):
                break
            who = more if who is None else who[more]
            # Spans under way are those with rounds to come; LONG_SPAN is compared with their whole size.
            at, left = at[more] + 8, left[more] - 8
        for i in np.flatnonzero(size > LONG_SPAN).tolist():
            digest = hashlib.blake2b(padded[start[i] : end[i]].tobytes(), digest_size=8, key=seed.to_bytes(8, "little"))
            h[i] = int.from_bytes(digest.digest(), "little")
        h = (h ^ (h >> np.uint64(32))) * MIX[2]
    return h ^ (h >> np.uint64(29))


def lower_table() -> np.ndarray:
    t = np.arange(256, dtype=np.uint8)
    t[65:91] += 32
    return t


LOWER = lower_table()


def byte_class(pattern: list[tuple[int, int]], outside: bool = False) -> np.ndarray:
    """A 256-entry mask of bytes in (or outside) the given inclusive ranges."""
    t = np.zeros(256, bool)
    for a, b in pattern:
        t[a : b + 1] = True
    return ~t if outside else t


#: Letters, digits and all beyond ASCII.
ALNUM = byte_class([(0x00, 0x2F), (0x3A, 0x60), (0x7B, 0x7F)], outside=True)
#: All but white space.
NONSPACE = byte_class([(0x20, 0x20), (0x09, 0x0D)], outside=True)


def words(data: np.ndarray, offsets: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words of the rows between offsets[0] and offsets[-1], ASCII lower-cased.

    kind marks the bytes that words consist of. Gives start and end of each word within the chunk, its 64-bit hash,
    and for each row the index of its first word (one entry more than rows).
    """
    base = int(offsets[0])
    n = int(offsets[-1]) - base
    padded = np.zeros(n + 8, np.uint8)
    low = padded[:n]
    np.take(LOWER, data[base : base + n], out=low)
    edge = np.unique(offsets - base)
    edge = edge[(edge > 0) & (edge < n)]
    inside = kind[low]
    begins = np.empty(n + 1, bool)
    begins[:n] = inside
    begins[n] = False
    ends = ~begins
    ends[0] = False
    ends[1:] &= inside
    begins[1:n] &= ~inside[:-1]
    begins[edge] |= inside[edge]
    ends[edge] |= inside[edge - 1]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends)
    return start, end, span_hashes(padded, start, end), np.searchsorted(start, offsets - base)


def thinned(df: DataFrame, h, rows: int) -> DataFrame:
    """About so many rows at most, those of least 64-bit hash h: a filter, so that no task gathers a sample of every other."""
    n = df.count()
    if n <= rows:
        return df
    return df.where(h < int(-(1 << 63) + (1 << 64) * (rows / n)))


def crc_mod(column: str, n: int):
    """crc32 of an id as text, modulo n."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % n
