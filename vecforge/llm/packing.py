"""Conflict-constrained best-fit packing of documents into sequences of fixed capacity.

Documents are cut into pieces of at most a capacity; whole pieces fill a bin alone, the rests are packed. Documents are
dealt to shards of bounded size by a hash, so that shards pack independently and a hot source spreads over all of them.
In a shard, pieces go longest first to the tightest bin that is compatible: bins are kept in order of their residual
space, and from the first that is large enough the search goes on to the next until one has no conflict. A bin carries
bitmaps of its sources and duplicate clusters: it takes no two pieces of one cluster, and at most SOURCE_LIMIT of one
source (one bitmap for each time a source may occur).

Lengths are those of the token files: the tokenizer's ids of the whole text and the end id. pack() without a count takes
a quarter of the bytes, an estimate that no registered query uses. sequences() puts the token files' ids into the bins.

A cluster is whatever the caller says, such as the group of near copies; without a word, equal texts are one.

Defined cases: null and empty texts have no pieces and no rows, not even for their end id. A null source is a source of
its own; a null cluster is that of the text alone. Rows that repeat id and text are pieces of one cluster and so lie in
different bins; they are dealt to shards by their place in the input, as nothing else tells them apart.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import neardup
from .common import give_back, small_batches, stored, table
from .substrings import keyed
from .token_files import encoder

#: Tokens of a bin, documents of a shard on average, pieces of one source in a bin.
CAPACITY, SHARD, SOURCE_LIMIT = 4096, 4096, 2
#: Bytes that stand for a token where no count is given.
BYTES_PER_TOKEN = 4


def estimated_tokens() -> Column:
    return F.ceil(F.octet_length("text") / BYTES_PER_TOKEN)


def counted_tokens(tokenizer: str, specials: list[str]) -> Column:
    """Ids of each whole text with its end id, 0 for null and empty texts."""

    def count(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        enc = encoder(tokenizer, specials)
        for texts in batches:
            out = [np.empty(0, np.int64)]
            for a in range(0, len(texts), 500):
                part = [t or "" for t in texts.slice(a, 500).to_pylist()]
                out.append(enc.encode(part)[1] * np.array([t != "" for t in part]))
            yield pa.array(np.concatenate(out))
        give_back()

    # As a deterministic function it would run twice: for the filter and for the rows.
    return F.arrow_udf(count, "long").asNondeterministic()("text")


def library_tokens() -> Column:
    """Counts by the tokenizer of the token files."""
    import public_tokenizers

    return counted_tokens(public_tokenizers.path("byte_bpe_50k.json"), ["<|endoftext|>"])


def best_fit(size: list[int], source: list[int], cluster: list[int], capacity: int, limit: int) -> tuple[list[int], list[int]]:
    """Bin and place of each piece; source and cluster are small numbers, the bits of the bitmaps."""
    order = sorted(range(len(size)), key=lambda i: (-size[i], i))
    space: list[tuple[int, int]] = []  # (residual, bin), ascending
    taken: list[list[int]] = []  # of each bin: a bitmap of clusters, then one of sources for each time they may occur
    bins, place = [0] * len(size), [0] * len(size)
    for i in order:
        n, s, c = size[i], 1 << source[i], 1 << cluster[i]
        at = bisect_left(space, (n, -1))
        while at < len(space) and (taken[space[at][1]][0] & c or taken[space[at][1]][limit] & s):
            at += 1
        if at < len(space):
            left, b = space.pop(at)
        else:
            left, b = capacity, len(taken)
            taken.append([0] * (limit + 1))
        bins[i], place[i] = b, capacity - left
        maps = taken[b]
        maps[0] |= c
        level = 1
        while level < limit and maps[level] & s:
            level += 1
        maps[level] |= s
        if left > n:
            insort(space, (left - n, b))
    return bins, place


def pack(documents: DataFrame, tokens: Column | None = None, capacity: int = CAPACITY, limit: int = SOURCE_LIMIT, shard: int = SHARD, cluster: Column | None = None) -> DataFrame:
    """A row per piece: doc_id, piece, first_token, n_tokens, bin (shard and number), bin_offset."""
    n = F.coalesce(tokens if tokens is not None else estimated_tokens(), F.lit(0)).cast("long")
    # Texts alone are counted, so that none is tokenized for the number of shards.
    some = documents.where(F.octet_length("text") > 0).count()
    return packed_rows(documents.select("doc_id", "source", named(cluster).alias("cluster"), n.alias("n")), some, capacity, limit, shard)


def named(cluster: Column | None) -> Column:
    """Number of a cluster; that of the text where the caller names none."""
    return F.xxhash64("text") if cluster is None else F.coalesce(F.when(cluster.isNotNull(), F.xxhash64(F.lit("cluster"), cluster)), F.xxhash64("text"))


def packed_rows(rows: DataFrame, some: int, capacity: int = CAPACITY, limit: int = SOURCE_LIMIT, shard: int = SHARD) -> DataFrame:
    """pack() of rows doc_id, source, cluster (a number) and n, about some of which have an n over 0."""
    shards = -(-some // shard) or 1
    rows = rows.select("doc_id", F.coalesce("source", F.lit("\0")).alias("source"), "cluster", "n", F.monotonically_increasing_id().alias("place")).where("n > 0")
    dealt = rows.withColumn("shard", F.pmod(F.xxhash64("doc_id", "cluster", "place", F.lit(29)), F.lit(shards))).drop("place")

    def run(group: pa.Table) -> pa.Table:
        group = group.sort_by([("n", "descending"), ("doc_id", "ascending"), ("cluster", "ascending")])
        n = group.column("n").to_numpy()
        whole = n // capacity
        rest = np.flatnonzero(n % capacity)
        numbered = [np.unique(group.column(c).to_numpy(zero_copy_only=False), return_inverse=True)[1][rest].tolist() for c in ("source", "cluster")]
        bins, place = best_fit((n[rest] % capacity).tolist(), *numbered, capacity, limit)
        first = max(bins, default=-1) + 1
        doc = np.concatenate((np.repeat(np.arange(len(n)), whole), rest))
        piece = np.concatenate((np.arange(whole.sum()) - np.repeat(np.cumsum(whole) - whole, whole), whole[rest]))
        size = np.concatenate((np.full(whole.sum(), capacity), n[rest] % capacity))
        bin_ = np.concatenate((first + np.arange(whole.sum()), np.array(bins, np.int64)))
        offset = np.concatenate((np.zeros(whole.sum(), np.int64), np.array(place, np.int64)))
        return pa.table({"doc_id": group.column("doc_id").take(pa.array(doc)), "piece": piece.astype(np.int64), "first_token": (piece * capacity).astype(np.int64), "n_tokens": size.astype(np.int64), "shard": group.column("shard").take(pa.array(doc)), "number": bin_.astype(np.int64), "bin_offset": offset.astype(np.int64)})

    packed = dealt.groupBy("shard").applyInArrow(run, "doc_id long, piece long, first_token long, n_tokens long, shard long, number long, bin_offset long")
    return packed.select("doc_id", "piece", "first_token", "n_tokens", F.concat_ws("-", "shard", "number").alias("bin"), "bin_offset")


def sequences(pieces: DataFrame, tokens: DataFrame) -> DataFrame:
    """bin, doc_ids of its pieces in order, and ids: the bin's token ids end to end, as the token files give them (32 bits each).

    tokens: doc_id and ids of each document, once each, null and empty texts left out. A bin is one row, no longer than its capacity.
    """
    part = F.expr("substring(ids, int(4 * first_token + 1), int(4 * n_tokens))")
    each = pieces.join(tokens.select("doc_id", "ids"), "doc_id").select("bin", F.struct("bin_offset", "doc_id", part.alias("part")).alias("x"))
    inside = each.groupBy("bin").agg(F.array_sort(F.collect_list("x")).alias("x"))
    return inside.select("bin", F.transform("x", lambda p: p["doc_id"]).alias("doc_ids"), F.aggregate("x", F.lit(b""), lambda all_, p: F.concat(all_, p["part"])).alias("ids"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clusters are op1's groups of near copies, of five words and 0.8; only counts and keys are shuffled to meet them."""
    docs = table(spark, sf_dir, "documents")
    groups = neardup.groups(docs).where("component_id is not null").select("k1", "k2", "component_id").dropDuplicates(["k1", "k2"])
    # Tokens are counted last, as the workers keep the encoder and the pieces that it has met.
    with small_batches(spark):
        counted = stored(keyed(docs.select("doc_id", "text", "source"), "source").select("k1", "k2", "doc_id", "source", F.xxhash64("text").alias("own"), library_tokens().alias("n")).where("n > 0"))
    cluster = F.coalesce(F.when(F.col("component_id").isNotNull(), F.xxhash64(F.lit("cluster"), "component_id")), F.col("own"))
    return packed_rows(counted.join(groups, ["k1", "k2"], "left").select("doc_id", "source", cluster.alias("cluster"), "n"), counted.count())
