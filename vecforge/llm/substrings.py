"""Exact removal of repeated long byte strings, by hash-compared suffix sorts.

A byte goes if a string of LEAST bytes that covers it starts anywhere else too. Three steps keep all of this local:

1. Each window of LEAST bytes is owned by an anchor: of the GRAM-byte strings in it, the one of least hash (leftmost of
   equal ones). Equal windows have equal anchors, so only anchors that occur twice can own repeated windows. An
   occurrence's windows and bytes form its context; occurrences with equal digests of it make a class. Occurrences of one
   class at even steps of a document, as in periodic text, are one row.
2. The windows of each class are suffix-sorted with those of the others that may be equal, two occurrences of a class if it
   has so many: a mergesort whose comparisons find common extensions by binary search over prefix polynomial hashes.
   Neighbours that agree in LEAST bytes are verified byte by byte; nothing counts as repeated without that. Contexts are cut
   in two halves of windows that share bytes on one side of the anchor; only classes that agree there are sorted together.
   Where very many agree, they are dealt to several sorts, each of which passes one representative of each window on by its
   digest, to meet those of the others in a pre-aggregated shuffle.
3. Repeated windows go back to all occurrences of their classes as byte ranges, which are united and cut out.

A key with more than a thousandth of all rows meets its rows by a broadcast of such keys, of which there are a thousand at
most; all others meet in a shuffle.

Defined cases: null and empty texts have no bytes and nothing removed. Rows that repeat id and text count as different
documents. Only id and text are read; other columns don't matter.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Powers, chunks, cut, meet, mixed, stored, table, text_buffer

#: Bytes of a repeated string, and of the grams whose least hash is a window's anchor.
LEAST, GRAM = 400, 200
#: Classes of a half that one sort takes, and classes of a bucket of sorts (about a megabyte of contexts).
SORTED_CLASSES, BUCKET_CLASSES = 512, 1500
#: Rows of two numbers that are broadcast at most; more of them meet in a shuffle.
BROADCAST_ROWS = 100_000
#: Modulus and bases of the prefix hashes: two of 31 bits, as products of such numbers fit 64 bits.
PRIME, BASES = np.uint64((1 << 31) - 1), (1_204_873_919, 1_731_060_037)


def prefix_hashes(x: np.ndarray, powers: Powers) -> tuple[np.ndarray, np.ndarray]:
    """Prefix polynomial hashes of bytes modulo 2**64, to choose anchors, and the inverse powers that align them."""
    up, down = powers.to(len(x) + 1)
    out = np.empty(len(x) + 1, np.uint64)
    out[0] = 0
    with np.errstate(over="ignore"):
        np.cumsum((x.astype(np.uint64) + np.uint64(1)) * up[: len(x)], out=out[1:])
    return out, down


def folded(v: np.ndarray) -> np.ndarray:
    """Numbers under 2**62 modulo PRIME."""
    v = (v & PRIME) + (v >> np.uint64(31))
    v = (v & PRIME) + (v >> np.uint64(31))
    return np.where(v >= PRIME, v - PRIME, v)


class Extensions:
    """Prefix polynomial hashes of a byte array by two bases, and the common extensions that they tell."""

    def __init__(self, x: np.ndarray) -> None:
        self.both = []
        for base in BASES:
            up, n = np.ones(1, np.uint64), len(x) + 1
            while len(up) < n:
                up = np.concatenate((up, folded(up * np.uint64(pow(base, len(up), int(PRIME))))))
            prefix = np.zeros(n, np.uint64)
            np.cumsum(folded((x.astype(np.uint64) + np.uint64(1)) * up[: len(x)]), out=prefix[1:])
            # Multiplied by the power that is missing to the array's end, equal strings agree wherever they start.
            self.both.append((prefix, up[:n][::-1].copy()))

    def same(self, a: np.ndarray, b: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Whether the strings of that size at a and b have equal hashes."""
        out, at = np.zeros(len(a), bool), np.arange(len(a))
        for prefix, rest in self.both:
            p, q, n = a[at], b[at], size[at]
            equal = folded(folded(prefix[p + n] - prefix[p]) * rest[p]) == folded(folded(prefix[q + n] - prefix[q]) * rest[q])
            at = at[equal]
        out[at] = True
        return out

    def common(self, a: np.ndarray, b: np.ndarray, most: int) -> np.ndarray:
        """Length, up to most, of the common extension of each pair of suffixes: a binary search over prefix hashes."""
        out = np.full(len(a), most, np.int64)
        part = np.flatnonzero(~self.same(a, b, out))  # those that differ within most bytes
        a, b = a[part], b[part]
        lo, hi = np.zeros(len(a), np.int64), np.full(len(a), most - 1, np.int64)
        for _ in range((most - 1).bit_length()):
            mid = (lo + hi + 1) >> 1
            same = self.same(a, b, mid)
            lo, hi = np.where(same, mid, lo), np.where(same, hi, mid - 1)
        out[part] = lo
        return out


def sliding_least(keys: np.ndarray, width: int) -> np.ndarray:
    """Least of each width consecutive keys, from running minima of blocks in both directions."""
    n = len(keys)
    blocks = np.full((-(-n // width), width), np.iinfo(np.uint64).max, np.uint64)
    blocks.ravel()[:n] = keys
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[: n - width + 1], ahead[width - 1 : n])


def anchors(data: np.ndarray, offsets: np.ndarray, powers: Powers, least: int, gram: int) -> tuple[np.ndarray, ...]:
    """Of the rows between the offsets: row, anchor hash, context digest, place, step, count, first and last window's distance before it.

    count occurrences of equal hash and digest at places step apart are one.
    """
    x = data[int(offsets[0]) : int(offsets[-1])]
    if len(x) < least:
        return tuple(np.empty(0, k) for k in (np.int64, np.uint64, np.int64, np.int64, np.int64, np.int64, np.int64, np.int64))
    prefix, down = prefix_hashes(x, powers)
    with np.errstate(over="ignore"):
        g = mixed((prefix[gram:] - prefix[:-gram]) * down[: len(prefix) - gram])
    key = (g & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(g), dtype=np.uint64)
    owner = sliding_least(key, least - gram + 1)
    edges = offsets - offsets[0]
    row = np.repeat(np.arange(len(edges) - 1), np.diff(edges))[: len(owner)]
    inside = np.arange(len(owner)) + least <= edges[row + 1]
    first = np.flatnonzero(np.concatenate(([True], (owner[1:] != owner[:-1]) | (inside[1:] != inside[:-1]) | (row[1:] != row[:-1]))))
    last = np.append(first[1:], len(owner)) - 1
    first, last = first[inside[first]], last[inside[first]]
    at = (owner[first] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    far, near, row, h = at - first, at - last, row[first], g[at]
    raw = memoryview(x)
    digest = [hashlib.blake2b(raw[a:b], digest_size=8, salt=d).digest() for a, b, d in zip(first.tolist(), (last + least).tolist(), map(bytes, np.stack((far, near), axis=1).astype("<u8")), strict=True)]
    c = np.frombuffer(b"".join(digest), np.int64)
    again = (row[1:] == row[:-1]) & (h[1:] == h[:-1]) & (c[1:] == c[:-1])
    step = np.diff(at)
    starts = ~again
    starts[1:] |= again[:-1] & (step[1:] != step[:-1])
    head = np.flatnonzero(np.concatenate(([True], starts))) if len(at) else np.empty(0, np.int64)
    count = np.diff(np.append(head, len(at)))
    step = np.where(count > 1, np.append(step, 0)[head], 0) if len(at) else step
    return row[head], h[head], c[head], at[head] - edges[row[head]], step, count, far[head], near[head]


def suffix_sort(x: np.ndarray, start: np.ndarray, group: np.ndarray, most: int) -> np.ndarray:
    """Order of the suffixes by group and then by their first most bytes: a bottom-up mergesort of all groups at once.

    Every suffix needs most bytes. In a merge, each suffix finds its rank in the neighbouring run by a binary search of
    hash comparisons; equal suffixes keep their order.
    """
    extensions = Extensions(x)
    order = np.argsort(group, kind="stable")
    g = group[order]
    head = np.flatnonzero(np.concatenate(([True], g[1:] != g[:-1]))) if len(g) else np.empty(0, np.int64)
    sizes = np.diff(np.append(head, len(g)))
    begin, size = np.repeat(head, sizes), np.repeat(sizes, sizes)
    place = np.arange(len(g)) - begin
    width, largest = 1, int(sizes.max(initial=0))
    while width < largest:
        run = place // width
        sibling = run ^ 1
        s0 = np.minimum(sibling * width, size)
        s1 = np.minimum(s0 + width, size)
        lo, hi = s0.copy(), s1.copy()
        active = np.flatnonzero(lo < hi)
        while len(active):
            mid = (lo[active] + hi[active]) >> 1
            a, b = start[order[active]], start[order[begin[active] + mid]]
            n = extensions.common(a, b, most)
            end = n >= most
            n = np.minimum(n, most - 1)
            # The sibling's suffix goes first if it is less, or equal and from the run before.
            before = np.where(end, sibling[active] < run[active], x[b + n] < x[a + n])
            lo[active] = np.where(before, mid + 1, lo[active])
            hi[active] = np.where(before, hi[active], mid)
            active = active[lo[active] < hi[active]]
        to = begin + np.minimum(run, sibling) * width + (place - run * width) + (lo - s0)
        moved = np.empty_like(order)
        moved[to] = order
        order = moved
        width *= 2
    return order


def equal_neighbours(x: np.ndarray, start: np.ndarray, group: np.ndarray, order: np.ndarray, most: int, step: int = 20_000) -> np.ndarray:
    """Whether each sorted suffix has the same group and bytes as the one before it; compares the bytes themselves."""
    same = np.zeros(len(order), bool)
    if len(order) < 2:
        return same
    view = np.lib.stride_tricks.sliding_window_view(x, most)
    pairs = np.flatnonzero(group[order[1:]] == group[order[:-1]]) + 1
    for i in range(0, len(pairs), step):
        p = pairs[i : i + step]
        a, b = start[order[p]], start[order[p - 1]]
        maybe = (x[a] == x[b]) & (x[a + most - 1] == x[b + most - 1]) & (x[a + most // 2] == x[b + most // 2])
        p, a, b = p[maybe], a[maybe], b[maybe]
        same[p] = (view[a] == view[b]).all(axis=1)
    return same


def runs(d: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Owner, least and greatest of each run of consecutive numbers of one owner."""
    order = np.lexsort((d, owner))
    d, owner = d[order], owner[order]
    new = np.concatenate(([True], (owner[1:] != owner[:-1]) | (d[1:] != d[:-1] + 1)))
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(d)) - 1
    return owner[first], d[first], d[last]


COMPARED = "h long, c long, d0 int, d1 int, w1 long, w2 long"


def compare_windows(least: int):
    """Function for a bucket of contexts: repeated windows as ranges d0..d1 of a class, and windows to be met by other sorts."""

    def run(contexts: pa.Table) -> pa.Table:
        # A context that shares its half with no other has no equal window.
        half = contexts.column("half").to_numpy()
        _, at, times = np.unique(half, return_inverse=True, return_counts=True)
        contexts = contexts.filter(pa.array((times[at] > 1) | contexts.column("hot").to_numpy(zero_copy_only=False).astype(bool)))
        if not len(contexts):
            return pa.table({n: pa.array([], pa.int32() if n in ("d0", "d1") else pa.int64()) for n in ("h", "c", "d0", "d1", "w1", "w2")})
        h, c, half = (np.array(contexts.column(k).to_numpy()) for k in ("h", "c", "half"))
        near, far = (contexts.column(k).to_numpy().astype(np.int64) for k in ("near", "far"))
        hot = contexts.column("hot").to_numpy(zero_copy_only=False).astype(bool)
        texts = contexts.column("context").to_pylist()
        x = np.frombuffer(b"".join(texts), np.uint8)
        at = np.concatenate(([0], np.cumsum([len(t) for t in texts])))[:-1]
        n = far - near + 1
        owner = np.repeat(np.arange(len(h)), n)
        d = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + near[owner]
        start = at[owner] + far[owner] - d
        # Equal windows have the same anchor at the same distance.
        group = np.unique(half, return_inverse=True)[1][owner] * (least + 1) + d
        order = suffix_sort(x, start, group, least)
        same = equal_neighbours(x, start, group, order, least)
        twice = same | np.append(same[1:], False)
        hit = order[twice]
        who, d0, d1 = runs(d[hit], owner[hit]) if len(hit) else (np.empty(0, np.int64),) * 3
        out = [pa.table({"h": h[who], "c": c[who], "d0": d0.astype(np.int32), "d1": d1.astype(np.int32), "w1": pa.nulls(len(who), pa.int64()), "w2": pa.nulls(len(who), pa.int64())})]
        on = order[hot[owner[order]] & ~same]
        if len(on):
            digests = np.frombuffer(b"".join(hashlib.blake2b(x[s : s + least].tobytes(), digest_size=16).digest() for s in start[on].tolist()), np.int64).reshape(-1, 2)
            k, e = owner[on], d[on].astype(np.int32)
            out.append(pa.table({"h": h[k], "c": c[k], "d0": e, "d1": e, "w1": digests[:, 0].copy(), "w2": digests[:, 1].copy()}))
        return pa.concat_tables(out)

    return run


def keyed(documents: DataFrame, *others: str) -> DataFrame:
    """doc_id, text, a two-part key of the row that is never null, and other columns."""
    return documents.select("doc_id", "text", *others, F.coalesce(F.col("doc_id"), F.lit(0)).cast("long").alias("k1"), F.xxhash64("doc_id", "text", F.isnull("doc_id")).alias("k2"))


OCCURRENCES = "k1 long, k2 long, h long, c long, place long, step int, count long, far int, near int"


def occurrences(documents: DataFrame, least: int, gram: int) -> DataFrame:
    def run(batches):
        powers = Powers()
        for batch in batches:
            data, offsets = text_buffer(batch.column(0))
            k1, k2 = batch.column(1).to_numpy(), batch.column(2).to_numpy()
            for a, b in chunks(offsets):
                row, h, c, place, step, count, far, near = anchors(data, offsets[a : b + 1], powers, least, gram)
                yield pa.RecordBatch.from_arrays([pa.array(v) for v in (k1[a + row], k2[a + row], h.view(np.int64), c, place, step.astype(np.int32), count, far.astype(np.int32), near.astype(np.int32))], ["k1", "k2", "h", "c", "place", "step", "count", "far", "near"])

    return keyed(documents).where(F.octet_length("text") >= least).select("text", "k1", "k2").mapInArrow(run, OCCURRENCES)


def packed(documents: DataFrame) -> DataFrame:
    """Row key and compressed text, to halve what a shuffle of texts moves."""

    def run(batches):
        codec = pa.Codec("zstd", compression_level=1)
        for batch in batches:
            data, offsets = text_buffer(batch.column(1))
            z = [codec.compress(data[a:b].tobytes(), asbytes=True) if b > a else b"" for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), batch.column(3), pa.array(np.diff(offsets)), pa.array(z, pa.binary())], ["doc_id", "k1", "k2", "n_bytes", "z"])

    return keyed(documents).mapInArrow(run, "doc_id long, k1 long, k2 long, n_bytes long, z binary")


CONTEXTS = "h long, c long, rep int, half long, far int, near int, context binary"


def contexts(documents: DataFrame, chosen: DataFrame, least: int, gram: int) -> DataFrame:
    """The bytes of the contexts chosen (h, c, rep: which of its class, and where), in two halves.

    Windows that start at most (least - gram) / 2 before the anchor all hold the same bytes behind its gram, the others
    the same bytes before it. half is a hash of those bytes: equal windows agree in it, so that only classes that do
    need to be compared.
    """
    fields = ("h", "c", "rep", "place", "far", "near")
    wanted = chosen.groupBy("k1", "k2").agg(F.collect_list(F.struct(*fields)).alias("own"))
    mid = (least - gram) // 2

    def halves(text: bytes, o: dict) -> list[tuple]:
        at, out = o["place"], []
        for side, far, near in ((0, min(o["far"], mid), o["near"]), (1, o["far"], max(o["near"], mid + 1))):
            if near <= far:
                shared = text[at - mid - 1 : at] if side else text[at + gram : at + least - mid]
                digest = hashlib.blake2b(shared, digest_size=8, key=o["h"].to_bytes(8, "little", signed=True), person=bytes([side])).digest()
                out.append((o["h"], o["c"], o["rep"], int.from_bytes(digest, "little", signed=True), far, near, text[at - far : at - near + least]))
        return out

    def run(batches):
        codec = pa.Codec("zstd")
        kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.binary())
        for batch in batches:
            for size, z, own in zip(*(batch.column(k).to_pylist() for k in (0, 1, 2)), strict=True):
                text = codec.decompress(z, size, asbytes=True)
                rows = [x for o in own for x in halves(text, o)]
                yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in rows], k) for i, k in enumerate(kinds)], ["h", "c", "rep", "half", "far", "near", "context"])

    # Rows that repeat id and text share a key; one of them will do.
    joined = packed(documents).join(wanted, ["k1", "k2"]).dropDuplicates(["k1", "k2"]).select("n_bytes", "z", "own")
    return joined.mapInArrow(run, CONTEXTS)


def repeated_ranges(documents: DataFrame, least: int = LEAST, gram: int = GRAM) -> DataFrame:
    """Row key and byte ranges, maybe overlapping, whose windows occur elsewhere too."""
    occ = stored(occurrences(documents, least, gram))
    total = occ.count()
    twice = stored(occ.groupBy("h").agg(F.sum("count").alias("n"), F.count("*").alias("rows")).where("n > 1").select("h", "rows"))
    occ = stored(meet(occ, twice, ["h"], total))
    place = F.struct("k1", "k2", "place", "far", "near")
    final = F.struct("k1", "k2", (F.col("place") + F.col("step") * (F.col("count") - 1)).alias("place"), "far", "near")
    classes = stored(occ.groupBy("h", "c").agg(F.sum("count").alias("n"), F.count("*").alias("rows"), F.min(place).alias("one"), F.max(final).alias("two")))
    both = F.when(F.col("one") == F.col("two"), F.array("one")).otherwise(F.array("one", "two"))
    halves = stored(contexts(documents, classes.select("h", "c", F.posexplode(both).alias("rep", "x")).select("h", "c", "rep", "x.*"), least, gram))
    # Contexts are shuffled once, to their bucket. Halves that are too many for one sort are dealt to several.
    large = stored(halves.groupBy("half").agg(F.count("*").alias("n")).where(F.col("n") > SORTED_CLASSES).select("half", F.ceil(F.col("n") / SORTED_CLASSES).alias("salts")))
    large = F.broadcast(large) if large.count() <= BROADCAST_ROWS else large
    salted = halves.join(large, "half", "left").select("*", F.pmod(F.xxhash64("c"), F.coalesce("salts", F.lit(1))).alias("salt"), F.col("salts").isNotNull().alias("hot")).drop("salts")
    buckets = -(-halves.count() // (2 * BUCKET_CLASSES)) or 1
    bucket = F.pmod(F.xxhash64("half", "salt"), F.lit(buckets)).alias("bucket")
    found = cut(salted.withColumn("bucket", bucket).groupBy("bucket").applyInArrow(compare_windows(least), COMPARED))
    open_ = found.where("w1 is not null")
    met = open_.groupBy("w1", "w2").agg(F.min("c").alias("c0"), F.max("c").alias("c1")).where("c0 <> c1").select("w1", "w2")
    windows = found.where("w1 is null").select("h", "c", "d0", "d1").unionByName(open_.join(met, ["w1", "w2"]).select("h", "c", "d0", "d1"))
    windows = windows.groupBy("h", "c").agg(F.collect_set(F.struct("d0", "d1")).alias("ranges"))
    # A class whose only place is there twice consists of rows that repeat id and text: it is repeated as a whole.
    whole = F.when((F.col("n") > 1) & (F.col("one") == F.col("two")), F.array(F.struct(F.col("one.near").alias("d0"), F.col("one.far").alias("d1"))))
    status = classes.join(windows, ["h", "c"], "left").select("h", "c", "rows", F.coalesce(whole, "ranges").alias("ranges")).where("ranges is not null")
    partly = meet(occ, stored(status), ["h", "c"], total)
    # Anchors that follow each other are less than a window apart, so that a row's windows unite.
    spans = F.transform("ranges", lambda r: F.struct((F.col("place") - r["d1"]).alias("a"), (F.col("place") + F.col("step") * (F.col("count") - 1) - r["d0"] + least).alias("b")))
    return partly.groupBy("k1", "k2").agg(F.flatten(F.collect_set(spans)).alias("spans"))


def removal(documents: DataFrame, least: int = LEAST, gram: int = GRAM, keep_text: bool = False) -> DataFrame:
    """Per document: n_bytes, n_removed, n_spans, kept_sha256, and with keep_text the spans and the remaining bytes."""
    joined = packed(documents).join(repeated_ranges(documents, least, gram), ["k1", "k2"], "left").select("doc_id", "n_bytes", "z", "spans")

    def run(batches):
        codec = pa.Codec("zstd")
        for batch in batches:
            rows: list[tuple] = []
            for size, z, spans in zip(*(batch.column(k).to_pylist() for k in (1, 2, 3)), strict=True):
                text = codec.decompress(z, size, asbytes=True) if size else b""
                merged: list[list[int]] = []
                for a, b in sorted({(s["a"], s["b"]) for s in spans or ()}):
                    if merged and a <= merged[-1][1]:
                        merged[-1][1] = max(b, merged[-1][1])
                    else:
                        merged.append([a, b])
                edges = [0, *(e for m in merged for e in m), size]
                kept = b"".join(text[edges[i] : edges[i + 1]] for i in range(0, len(edges), 2))
                rows.append((size - len(kept), len(merged), hashlib.sha256(kept).hexdigest(), *((merged, kept) if keep_text else ())))
            kinds = [pa.int64(), pa.int64(), pa.string(), *((pa.list_(pa.list_(pa.int64())), pa.binary()) if keep_text else ())]
            names = ["n_removed", "n_spans", "kept_sha256", *(("spans", "kept") if keep_text else ())]
            cols = [pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *cols], ["doc_id", "n_bytes", *names])

    return joined.mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + (", spans array<array<long>>, kept binary" if keep_text else ""))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return removal(table(spark, sf_dir, "documents"))
