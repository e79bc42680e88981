"""Near-duplicate groups: MinHash signatures, a multi-index Hamming join, exact confirmation on the full sets.

A document's set is that of the 64-bit hashes of its distinct word shingles. Equal sets become one class first, so that exact
copies cost nothing further; sets of one shingle are told apart by its bytes, and link with nothing but their own class,
as any other set shares half of its shingles with them at most. A larger class has a signature of CHUNKS x WIDTH symbols of 16 bits, each from one min-wise hash.

Pigeonhole: two signatures that differ in fewer than CHUNKS * 2 symbols agree in some chunk but for one symbol at most.
Each chunk gives one key for each symbol that may be wrong (that symbol left out), so every such pair shares a key. At
the least similarity of 0.8 to 0.85 a linked pair differs in more symbols with probability 1e-4 to 1e-7.

Keys with two or three classes give all their pairs by the least and greatest class, and pairs whose signatures are
too far apart go. Larger keys connect their classes to the least one, unconfirmed: they are too many for pairs. Both
kinds of edges form families, and no link leaves a family. Each family's full sets meet in blocks of bounded size,
where intersections are counted exactly by products of 0/1 matrices; families of more than a block are covered by pairs
of blocks. The links' components are the result. No pairs of a family are ever emitted.

Defined cases: null and empty texts have an empty set, are alone in their group and linked with nothing. Rows that
repeat a doc_id are separate documents. A null doc_id gets the least id of its group, null if there is none.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LOWER, NONSPACE, chunks, cut, mixed, release, small_batches, stored, table, tasks, text_buffer, tidy, words
from .graph import components
from .substrings import packed

#: Chunks of a signature, symbols of a chunk, wrong symbols allowed in the chunk that two signatures share.
CHUNKS, WIDTH = 14, 5
SYMBOLS = CHUNKS * WIDTH
#: Classes of a key whose pairs are enumerated; sets that a block holds, and sets of a bucket of small families.
FEW, BLOCK, BUCKET = 3, 1024, 2048
#: Classes whose keys one task makes on average: a task pre-aggregates SYMBOLS keys of each, hardly any of them equal, at some 130 bytes.
KEYED = 10_000
_RNG = np.random.default_rng(20240607)
FACTORS = _RNG.integers(1, 1 << 63, SYMBOLS, np.uint64) * np.uint64(2) + np.uint64(1)
FLIPS = _RNG.integers(0, 1 << 63, SYMBOLS, np.uint64)
STEPS = _RNG.integers(1, 1 << 63, 64, np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, k: int) -> tuple[list[np.ndarray], list[bytes]]:
    """Sorted distinct shingle hashes of each row between the offsets, and what tells equal sets: hashes, or the bytes of a lone shingle."""
    start, end, h, first = words(data, offsets, NONSPACE)
    base = int(offsets[0])
    with np.errstate(over="ignore"):
        n = max(0, len(h) - k + 1)
        whole = mixed(sum((h[j : j + n] * STEPS[j] for j in range(k)), np.zeros(n, np.uint64)))
        out, names = [], []
        for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
            if b - a >= k:
                out.append(np.unique(whole[a : b - k + 1]))
            elif b > a:
                out.append(mixed(np.array([(h[a:b] * STEPS[: b - a]).sum() + np.uint64(b - a)], np.uint64)))
            else:
                out.append(np.empty(0, np.uint64))
            if len(out[-1]) == 1:
                names.append(b"one " + b" ".join(LOWER[data[base + start[i] : base + end[i]]].tobytes() for i in range(a, min(b, a + k))))
            else:
                names.append(out[-1].tobytes())
    return out, names


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """A row of SYMBOLS 16-bit symbols for each set; none may be empty."""
    if not sets:
        return np.empty((0, SYMBOLS), np.uint16)
    flat = np.concatenate(sets)
    start = np.concatenate(([0], np.cumsum([len(s) for s in sets])))[:-1]
    out = np.empty((len(sets), SYMBOLS), np.uint16)
    with np.errstate(over="ignore"):
        for j in range(SYMBOLS):
            out[:, j] = (np.minimum.reduceat((flat ^ FLIPS[j]) * FACTORS[j], start) >> np.uint64(24)).astype(np.uint16)
    return out


def sketched(documents: DataFrame, k: int) -> DataFrame:
    """Per document: row key, set size, digest of the set and signature (null for sets of one and none)."""

    def run(batches):
        for batch in batches:
            data, offsets = text_buffer(batch.column(1))
            n, digest, sign = [], [], []
            for a, b in chunks(offsets):
                sets, names = shingle_sets(data, offsets[a : b + 1], k)
                n.extend(len(s) for s in sets)
                digest.extend(hashlib.blake2b(x, digest_size=16).digest() for x in names)
                rows = iter(signatures([s for s in sets if len(s) > 1]))
                sign.extend(next(rows).tobytes() if len(s) > 1 else None for s in sets)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), batch.column(3), pa.array(n, pa.int64()), pa.array(digest, pa.binary()), pa.array(sign, pa.binary())], ["doc_id", "k1", "k2", "n", "digest", "sign"])

    keyed = documents.select("doc_id", "text", F.coalesce(F.col("doc_id"), F.lit(0)).cast("long").alias("k1"), F.xxhash64("doc_id", "text", F.isnull("doc_id")).alias("k2"))
    return keyed.mapInArrow(tidy(run), "doc_id long, k1 long, k2 long, n long, digest binary, sign binary")


def chunk_keys(classes: DataFrame) -> DataFrame:
    """node and key: for each chunk, and each of its symbols left out."""

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            node = batch.column(0).to_numpy()
            s = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint16).reshape(-1, SYMBOLS).astype(np.uint64)
            keys = np.empty((len(node), CHUNKS, WIDTH), np.uint64)
            with np.errstate(over="ignore"):
                part = mixed((s + np.uint64(1)) * STEPS[:1] + np.arange(SYMBOLS, dtype=np.uint64) * STEPS[1]).reshape(-1, CHUNKS, WIDTH)
                total = part.sum(axis=2)
                for w in range(WIDTH):
                    keys[:, :, w] = mixed(total - part[:, :, w] + np.uint64(w + 1) * STEPS[2])
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(node, CHUNKS * WIDTH)), pa.array(keys.reshape(-1).view(np.int64))], ["node", "key"])

    return classes.select("node", "sign").mapInArrow(run, "node long, key long")


def spread(classes: DataFrame) -> DataFrame:
    """The classes in tasks of about KEYED rows; a checkpoint's tasks are made for its own bytes, a small part of what the keys take."""
    return classes.repartition(max(tasks(classes.sparkSession), -(-classes.count() // KEYED)))


def near_pairs(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """The pairs whose signatures differ in fewer than 2 * CHUNKS symbols."""

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            a, b = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint16).reshape(-1, SYMBOLS) for i in (2, 3))
            near = (a != b).sum(axis=1) < 2 * CHUNKS
            yield pa.RecordBatch.from_arrays([batch.column(i).filter(pa.array(near)) for i in (0, 1)], ["a", "b"])

    one = classes.select(F.col("node").alias("a"), F.col("sign").alias("sa"))
    two = classes.select(F.col("node").alias("b"), F.col("sign").alias("sb"))
    return pairs.join(one, "a").join(two, "b").select("a", "b", "sa", "sb").mapInArrow(run, "a long, b long")


def linked(sets: list[np.ndarray], num: int, den: int, slab: int = 4096) -> np.ndarray:
    """Least index that each set reaches by links of den * intersection >= num * union."""
    n = len(sets)
    size = np.array([len(s) for s in sets], np.int64)
    owner = np.repeat(np.arange(n), size)
    flat, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)[1:]
    shared = count[flat] > 1
    # A set in which too few hashes occur elsewhere in the family has no link.
    able = np.bincount(owner[shared], minlength=n) * den >= num * size
    use = shared & able[owner]
    who, what = owner[use], flat[use]
    index = np.flatnonzero(able)
    place = np.zeros(n, np.int64)
    place[index] = np.arange(len(index))
    root = np.arange(n)
    if len(index) < 2:
        return root
    what = np.unique(what, return_inverse=True)[1]
    order = np.argsort(what, kind="stable")
    who, what = place[who[order]], what[order]
    common = np.zeros((len(index), len(index)), np.int64)
    for first in range(0, int(what[-1]) + 1 if len(what) else 0, slab):
        a, b = np.searchsorted(what, (first, first + slab))
        m = np.zeros((len(index), min(slab, int(what[-1]) + 1 - first)), np.float32)
        m[who[a:b], what[a:b] - first] = 1
        common += (m @ m.T).astype(np.int64)  # exact: a slab's counts stay under 2**24
    sizes = size[index]
    links = common * (num + den) >= num * (sizes[:, None] + sizes[None, :])
    seen = np.zeros(len(index), bool)
    for i in range(len(index)):
        if seen[i]:
            continue
        seen[i], todo = True, [i]
        while todo:
            new = np.flatnonzero(links[todo.pop()] & ~seen)
            seen[new] = True
            root[index[new]] = index[i]
            todo.extend(new.tolist())
    return root


def family_links(members: DataFrame, documents: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """node and root in its block pair, from the full sets of the members (node, family, k1, k2, parts)."""
    total = members.agg(F.sum("parts")).first()[0] or 0
    buckets = -(-total // BUCKET) or 1
    i = F.pmod(F.xxhash64("node"), F.col("parts"))
    pairs = F.transform(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1), lambda j: F.struct(F.least(i, j).alias("i"), F.greatest(i, j).alias("j")))
    meet = packed(documents).join(members, ["k1", "k2"]).dropDuplicates(["node"])

    def to_sets(batches):
        codec = pa.Codec("zstd")
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                batch = whole.slice(at, 500)
                size, z = (batch.column(c).to_pylist() for c in (0, 1))
                texts = [codec.decompress(x, n, asbytes=True) if n else b"" for x, n in zip(z, size, strict=True)]
                offsets = np.concatenate(([0], np.cumsum([len(t) for t in texts]))).astype(np.int64)
                data = np.frombuffer(b"".join(texts), np.uint8)
                sets = [s.tobytes() for a, b in chunks(offsets) for s in shingle_sets(data, offsets[a : b + 1], k)[0]]
                yield pa.RecordBatch.from_arrays([batch.column(2), batch.column(3), batch.column(4), pa.array(sets, pa.binary())], ["node", "family", "parts", "hashes"])

    sets = meet.select("n_bytes", "z", "node", "family", "parts").mapInArrow(to_sets, "node long, family long, parts long, hashes binary")
    dealt = sets.withColumn("pair", F.explode(pairs)).select("node", "family", "hashes", "pair.i", "pair.j")

    def link(group: pa.Table) -> pa.Table:
        key = [group.column(c).to_numpy() for c in ("j", "i", "family")]
        node, hashes = group.column("node").to_numpy(), group.column("hashes").to_pylist()
        order = np.lexsort((node, *key))
        new = np.concatenate(([True], np.any([c[order][1:] != c[order][:-1] for c in key], axis=0)))
        first = np.flatnonzero(new)
        nodes, roots = [], []
        for a, b in zip(first.tolist(), [*first[1:].tolist(), len(order)], strict=True):
            own = order[a:b]
            root = linked([np.frombuffer(hashes[x], np.uint64) for x in own], num, den)
            nodes.append(node[own])
            roots.append(node[own][root])
        return pa.table({"node": np.concatenate(nodes), "root": np.concatenate(roots)})

    bucket = F.pmod(F.xxhash64("family", "i", "j"), F.lit(buckets))
    return dealt.withColumn("bucket", bucket).groupBy("bucket").applyInArrow(link, "node long, root long")


def groups(documents: DataFrame, k: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """Per document: doc_id, n_shingles, component_id and kept, and the row key k1, k2."""
    with small_batches(documents.sparkSession):
        sketch, classes, roots = linked_classes(documents, k, num, den)
    named = classes.join(roots, "node", "left").select("digest", "id", F.coalesce("root", "node").alias("root"))
    least = named.groupBy("root").agg(F.min("id").alias("component_id"))
    named = named.join(least, "root").select("digest", "component_id")
    out = sketch.select("doc_id", "k1", "k2", "n", "digest").join(named, "digest", "left")
    component = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(False)).alias("kept"), "k1", "k2")


def linked_classes(documents: DataFrame, k: int, num: int, den: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Sketches of the documents, their classes, and node and root of the classes that may have links; all of Python's work is done then."""
    sketch = stored(sketched(documents, k))
    classes = sketch.where("n > 0").groupBy("digest").agg(F.min("doc_id").alias("id"), F.min(F.struct("k1", "k2")).alias("one"), F.min("sign").alias("sign"))
    classes = cut(classes.withColumn("node", F.monotonically_increasing_id()))
    keys = chunk_keys(spread(classes.where("sign is not null")))
    shared = keys.groupBy("key").agg(F.count("*").alias("n"), F.min("node").alias("lo"), F.max("node").alias("hi")).where("n > 1")
    ends = F.when(F.col("n") <= FEW, F.array("lo", "hi")).otherwise(F.array("lo"))
    edges = keys.join(shared, "key").select("node", (F.col("n") <= FEW).alias("few"), F.explode(ends).alias("end")).where("node <> end")
    edges = cut(edges.groupBy(F.greatest("node", "end").alias("a"), F.least("node", "end").alias("b")).agg(F.min("few").alias("few")))
    keys = shared = None
    release(documents.sparkSession)
    near = near_pairs(edges.where("few").select("a", "b"), classes).unionByName(edges.where("not few").select("a", "b"))
    family = components(near).select("node", F.col("root").alias("family"))
    parts = family.groupBy("family").agg(F.ceil(F.count("*") / BLOCK).alias("parts"))
    members = cut(family.join(parts, "family").join(classes.select("node", "one.*"), "node").select("node", "family", "parts", "k1", "k2"))
    found = cut(family_links(members, documents, k, num, den))
    near = family = parts = None
    release(documents.sparkSession)
    if members.where("parts > 1").isEmpty():
        roots = found
    else:
        # Blocks of one family gave parts of its components; they are joined over all.
        roots = components(found.select(F.col("node").alias("a"), F.col("root").alias("b")))
    return sketch, classes, roots


def dedup(documents: DataFrame, k: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """One document of each group, with all columns; of rows that repeat a kept doc_id and text, one."""
    kept = groups(documents, k, num, den).where("kept or n_shingles = 0 or component_id is null").select(F.col("k1").alias("kept1"), F.col("k2").alias("kept2")).distinct()
    # The row is kept whole in a struct, so that no column's name can clash.
    rows = documents.select(F.struct("*").alias("row"), F.coalesce(F.col("doc_id"), F.lit(0)).cast("long").alias("key1"), F.xxhash64("doc_id", "text", F.isnull("doc_id")).alias("key2"))
    same = (F.col("key1") == F.col("kept1")) & (F.col("key2") == F.col("kept2"))
    return rows.join(kept, same, "left_semi").dropDuplicates(["key1", "key2"]).select("row.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return groups(table(spark, sf_dir, "documents"), 3, 85, 100).select("doc_id", "n_shingles", "component_id", "kept")
