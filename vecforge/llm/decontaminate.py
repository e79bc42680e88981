"""Benchmark decontamination by suffix arrays over the training text.

Each shard (a bounded chunk of whole documents) gets a suffix array of its words. Every suffix of every benchmark item
is binary-searched in each shard, suffixes that begin with the same window as one; the range that shares a window's words
is compared by whole 64-bit hashes of the words, and tells the places. Matches of neighbouring places unite to the longest
verbatim ones, whose locations mark the words hit. A place meets one window of each length, so that the matches of a
shard are bounded by its words however often words repeat. All is local to a document, so that nothing is shuffled while the benchmark fits
one block. A larger benchmark is dealt to blocks by a hash; one block at a time is collected, broadcast, searched and
given up, and the blocks' findings (hits only, without text) are merged by a 128-bit hash of id and text.

Defined cases: a null or empty text has no words and no hits. An item without words never matches. An item of fewer
words than the window is one window. An item is held whole, however long. Items with the same text are each reported. Items whose item_id is null
match like others; all of them count as one in n_items, and items_sha256 leaves them out. Each document row gives a row,
repeated and null doc_ids too, whatever the benchmark's size. Columns of documents beyond id and text are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ALNUM, chunks, cut, mixed, table, text_buffer, words

#: Words of a window.
WINDOW = 10
#: Bytes of benchmark text that one block holds at most; it bounds what is broadcast.
BLOCK_BYTES = 16_000_000
#: Bits of a word's hash in the suffix array's keys, and words in a key.
BITS, PER_KEY = 21, 3

SPANS, ITEMS = "array<struct<first: bigint, last: bigint>>", "array<string>"


def item_suffixes(rows: list[tuple[str | None, str]], window: int) -> dict:
    """Word hashes of the items end to end, a suffix for each distinct window that items hold, and the items of each."""
    ids, hashes = [], []
    for item_id, text in rows:
        data, offsets = text_buffer(pa.array([text], pa.string()))
        h = words(data, offsets, ALNUM)[2]
        if len(h):
            hashes.append(h)
            ids.append(item_id)
    h = np.concatenate(hashes) if hashes else np.empty(0, np.uint64)
    size = np.array([len(x) for x in hashes], np.int64)
    first, need = np.cumsum(size) - size, np.minimum(window, size)
    n = size - need + 1
    item = np.repeat(np.arange(len(size)), n)
    at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + first[item]
    need = need[item]
    # Equal windows have equal sums of their words' hashes, each times its place's factor: two sums tell them apart.
    factors = np.random.default_rng(20250901).integers(1, 1 << 63, (2, window + 1), np.uint64) * np.uint64(2) + np.uint64(1)
    sums = np.zeros((2, len(at)), np.uint64)
    with np.errstate(over="ignore"):
        for j in range(window):
            has = np.flatnonzero(need > j)
            for k in range(2):
                sums[k, has] += mixed(h[at[has] + j] + factors[k, j]) * factors[k, j + 1]
    order = np.lexsort((item, need, sums[1], sums[0]))
    same = (sums[:, order[1:]] == sums[:, order[:-1]]).all(axis=0) & (need[order[1:]] == need[order[:-1]])
    new = np.flatnonzero(np.concatenate(([True], ~same))) if len(order) else order
    items = np.split(item[order], new[1:]) if len(order) else []
    chosen = order[new]
    return {"ids": ids, "hashes": h, "at": at[chosen], "items": [np.unique(x) for x in items], "need": need[chosen], "window": window}


def short(h: np.ndarray) -> np.ndarray:
    return h >> np.uint64(64 - BITS)


def keys_at(h: np.ndarray, at: np.ndarray, end: np.ndarray, word: int, fill: int = 0) -> np.ndarray:
    """Key of the words word, word + 1, ... of the suffixes at; fill stands for words beyond end."""
    key = np.zeros(len(at), np.uint64)
    for j in range(word, word + PER_KEY):
        p = at + j
        inside = p < end
        part = short(h[np.where(inside, p, 0)]) if len(h) else np.zeros(len(at), np.uint64)
        key = (key << np.uint64(BITS)) | np.where(inside, part, np.uint64(fill))
    return key


def narrow(keys: np.ndarray, lo: np.ndarray, hi: np.ndarray, target: np.ndarray, right: bool) -> np.ndarray:
    """Binary search of each target within its own range of keys."""
    lo, hi = lo.copy(), hi.copy()
    while (open_ := lo < hi).any():
        mid = np.where(open_, (lo + hi) // 2, 0)
        k = keys[mid]
        less = open_ & ((k <= target) if right else (k < target))
        lo = np.where(less, mid + 1, lo)
        hi = np.where(open_ & ~less, mid, hi)
    return lo


def search(h: np.ndarray, first: np.ndarray, tests: dict, vocabulary: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Matches of the windows in a shard: word position, words matched, window."""
    none = np.empty(0, np.int64)
    if not len(tests["at"]) or not len(h):
        return none, none, none
    # A suffix whose first word is in no item matches nothing, so the suffix array leaves it out.
    at = np.flatnonzero(vocabulary[short(h).astype(np.int64)])
    row_end = first[1:]
    end = row_end[np.searchsorted(row_end, at, "right")]
    key = keys_at(h, at, end, 0)
    order = np.argsort(key, kind="stable")
    at, end, key = at[order], end[order], key[order]

    t_at, need = tests["at"], tests["need"]
    t_stop = t_at + need  # words of a suffix beyond its first window don't decide the range
    mask = (1 << BITS) - 1
    th = tests["hashes"]
    lo = np.searchsorted(key, keys_at(th, t_at, t_stop, 0), "left")
    hi = np.searchsorted(key, keys_at(th, t_at, t_stop, 0, mask), "right")
    found = np.flatnonzero(lo < hi)
    if not len(found):
        return none, none, none
    # Only the ranges that a test suffix hits are sorted by their further words.
    cover = np.zeros(len(at) + 1, np.int64)
    np.add.at(cover, lo[found], 1)
    np.add.at(cover, hi[found], -1)
    hit = np.flatnonzero(np.cumsum(cover[:-1]) > 0)
    at, end, key = at[hit], end[hit], key[hit]
    lo, hi = np.searchsorted(hit, lo[found]), np.searchsorted(hit, hi[found])
    deeper = [keys_at(h, at, end, w) for w in range(PER_KEY, tests["window"], PER_KEY)]
    order = np.lexsort((*deeper[::-1], key))
    at, end, deeper = at[order], end[order], [k[order] for k in deeper]
    for level, k in enumerate(deeper, 1):
        a, b = keys_at(th, t_at[found], t_stop[found], level * PER_KEY), keys_at(th, t_at[found], t_stop[found], level * PER_KEY, mask)
        lo, hi = narrow(k, lo, hi, a, False), narrow(k, lo, hi, b, True)
        keep = lo < hi
        found, lo, hi = found[keep], lo[keep], hi[keep]
    n = hi - lo
    if not n.sum():
        return none, none, none
    test = np.repeat(found, n)
    place = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo, n)
    pos, stop = at[place], end[place]
    whole = pos + need[test] <= stop
    for j in range(tests["window"]):  # by whole hashes, word by word
        more = np.flatnonzero(whole & (need[test] > j))
        whole[more] = h[pos[more] + j] == th[t_at[test[more]] + j]
    return pos[whole], need[test[whole]], test[whole]


def scan(documents: DataFrame, shared: Broadcast) -> DataFrame:
    """Per document (its last column is the text, the others stay): words, maximal runs of words hit, and items found."""
    kept = documents.columns[:-1]

    def run(batches):
        tests = shared.value
        vocabulary = np.zeros(1 << BITS, bool)
        vocabulary[short(tests["hashes"][tests["at"]]).astype(np.int64)] = True
        for batch in batches:
            data, offsets = text_buffer(batch.column(len(kept)))
            out: tuple[list, ...] = ([], [], [])
            for a, b in chunks(offsets):
                _, _, h, first = words(data, offsets[a : b + 1], ALNUM)
                pos, length, match = search(h, first, tests, vocabulary)
                spans: list = [[] for _ in range(b - a)]
                items: list = [set() for _ in range(b - a)]
                if len(pos):
                    edge = np.zeros(len(h) + 1, np.int64)
                    np.add.at(edge, pos, 1)
                    np.add.at(edge, pos + length, -1)
                    hit = np.concatenate(([0], (np.cumsum(edge[:-1]) > 0).astype(np.int8), [0]))
                    # Runs end where documents do: a match never leaves its document, but two may touch.
                    turn = np.diff(hit)
                    start, stop = np.flatnonzero(turn == 1), np.flatnonzero(turn == -1)
                    for s, e in zip(start.tolist(), stop.tolist(), strict=True):
                        row = int(np.searchsorted(first, s, "right")) - 1
                        while s < e:
                            to = min(e, int(first[row + 1]))
                            if s < to:
                                spans[row].append((s - int(first[row]), to - int(first[row])))
                            s, row = to, row + 1
                    pairs = np.unique(np.stack([np.searchsorted(first, pos, "right") - 1, match]), axis=1)
                    for row, k in pairs.T.tolist():
                        items[row].update(tests["ids"][i] for i in tests["items"][k].tolist())
                out[0].extend(np.diff(first).tolist())
                out[1].extend([{"first": s, "last": e} for s, e in x] for x in spans)
                out[2].extend(sorted(x, key=lambda i: (i is None, i or "")) for x in items)
            kinds = [pa.int64(), pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())])), pa.list_(pa.string())]
            found = [pa.array(x, k) for x, k in zip(out, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], *found], [*kept, "n_words", "spans", "items"])

    return documents.mapInArrow(run, ", ".join(f"{c} long" for c in [*kept, "n_words"]) + f", spans {SPANS}, items {ITEMS}")


def find(documents: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Verbatim benchmark matches by document: doc_id, n_words, spans of words hit, item ids."""
    spark = documents.sparkSession
    doc_id = F.col("doc_id").cast("long").alias("doc_id")
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), "text").where("text is not null")
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = -(-size // block_bytes) or 1

    def tests(k: int) -> Broadcast:
        # A block's size is bounded by block_bytes on average; the hash deals items evenly.
        rows = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k).collect()
        return spark.sparkContext.broadcast(item_suffixes([(r[0], r[1]) for r in rows], window))

    if blocks == 1:
        return scan(documents.select(doc_id, "text"), tests(0))
    # Rows of equal keys have equal text and so equal findings, so that each block gives one of them.
    keys = [F.xxhash64(F.lit(seed), "doc_id", "text", F.isnull("doc_id")).alias(name) for seed, name in ((17, "k1"), (23, "k2"))]
    keyed = documents.select(doc_id, *keys, "text")
    rows, hits = None, None
    for k in range(blocks):
        shared = tests(k)
        found = scan(keyed, shared)
        if rows is None:
            rows = found = cut(found)
        found = found.where(F.size("spans") > 0).select("k1", "k2", "spans", "items").dropDuplicates(["k1", "k2"])
        found = cut(found)
        shared.destroy()
        hits = found if hits is None else hits.unionByName(found)
    merged = hits.groupBy("k1", "k2").agg(F.array_sort(F.flatten(F.collect_list("spans"))).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    # Spans sorted by their first word are merged in one fold.
    union = F.aggregate(
        "spans",
        F.expr(f"cast(array() as {SPANS})"),
        lambda done, s: F.when(
            (F.size(done) > 0) & (F.element_at(done, -1)["last"] >= s["first"]),
            F.concat(F.slice(done, 1, F.size(done) - 1), F.array(F.struct(F.element_at(done, -1)["first"].alias("first"), F.greatest(F.element_at(done, -1)["last"], s["last"]).alias("last")))),
        ).otherwise(F.concat(done, F.array(s))),
    )
    whole = rows.select("doc_id", "k1", "k2", "n_words").join(merged.select("k1", "k2", union.alias("spans"), "items"), ["k1", "k2"], "left")
    return whole.select("doc_id", "n_words", *(F.coalesce(c, F.expr(f"cast(array() as {kind})")).alias(c) for c, kind in (("spans", SPANS), ("items", ITEMS))))


def decontaminate(documents: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The documents in which no window of the benchmark occurs, with all their columns."""
    key = F.xxhash64("doc_id", "text", F.isnull("doc_id"))
    marked = find(documents.select(key.alias("doc_id"), "text"), benchmark, window, block_bytes).where(F.size("spans") > 0).select(F.col("doc_id").alias("hit")).distinct()
    # The row is kept whole in a struct, so that no column's name can clash.
    rows = documents.select(F.struct("*").alias("row"), key.alias("key"))
    return rows.join(marked, F.col("key") == F.col("hit"), "left_anti").select("row.*")


def report(documents: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    found = find(documents, benchmark, window, block_bytes)
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["last"] - s["first"])
    return found.select("doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"), (hit > 0).alias("contaminated"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


ORACLE = r"""
with d as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') w from documents),
b as (select item_id::varchar item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') w from benchmark),
bl as (select item_id, w, least(10, len(w)) l from b where len(w) > 0),
bw as (select distinct item_id, l, array_to_string(w[i:i + l - 1], ' ') win from (select item_id, w, l, unnest(range(1, len(w) - l + 2)) i from bl)),
lens as (select distinct l from bw),
dw as (select doc_id, i, l, array_to_string(w[i:i + l - 1], ' ') win from (select doc_id, w, l, unnest(range(1, len(w) - l + 2)) i from d, lens where len(w) >= l)),
m as (select doc_id, item_id, i, dw.l from dw join bw on dw.l = bw.l and dw.win = bw.win),
h as (select doc_id, count(distinct p) n_hit from (select doc_id, unnest(range(i, i + l)) p from m) group by doc_id),
t as (select doc_id, count(*) n_items, string_agg(item_id, ',' order by item_id) s from (select distinct doc_id, item_id from m) group by doc_id)
select d.doc_id, len(w)::bigint n_words, coalesce(n_hit, 0)::bigint n_hit, coalesce(n_items, 0)::bigint n_items, sha256(coalesce(s, '')) items_sha256, coalesce(n_hit, 0) > 0 contaminated
from d left join h using (doc_id) left join t using (doc_id)
"""
