"""Token ids in binary frames, coded by an adaptive range coder over mixed order-0 to order-2 predictions.

A frame holds whole documents in ascending doc_id: their ids and lengths, and the token ids in blocks of BLOCK ids. Each
block starts from the frame's state and carries a crc32 of its ids, so that it is decoded and verified on its own. Frames
are rows of a Parquet store, so that Spark's committed writes, retries and any file system serve them.

Three predictions of the next id are mixed. Order 0 and order 1 are counts of all the frame's ids (`Counts`, kept with the
frame): how often an id occurs, and how often it follows another. Order 2 is learned within the block: the last
successor of the last two ids. A block's adaptive weights share the probability out: to order 2 by its confidence, what is
left to order 1 by how much its row has seen, the rest to order 0. The blocks of a frame are coded in lockstep, each
numpy operation serving one step of all of them; coder and decoder share every step of the model.

Defined cases: null and empty texts have the end id alone. Rows that repeat a doc_id are separate documents. Null doc_ids
come first. A special token's text stands for its id, as the library has it. A vocabulary of more than 65,536 ids is an error.
"""

from __future__ import annotations

import sys
import types
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import span_hashes, table, tasks

#: Ids of a block, and of a frame (a longer document has a frame of its own).
BLOCK, FRAME = 2048, 8_000_000
END = 0
VOCABULARY = 1 << 16
#: log2 of the total of the weights and of the entries of a block's table of order 2.
TOTAL, BITS2 = 16, 11
#: Least times that a successor must have been seen to be kept in a frame, and bounds of log2 of a row's total.
SEEN, LEAST_BITS, MOST_BITS = 3, 4, 12
#: Pieces that a worker process remembers at most.
REMEMBERED = 2_000_000
#: Blocks coded in lockstep at most: enough to make little of the cost of a numpy call, at some 8 kB of tables each.
LANES = 4096
#: Code points that are split into pieces at once, so that the arrays stay in a core's cache.
POINTS = 200_000
U = np.uint64


def shares(counts: np.ndarray, row: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """Whole shares of 2**bits in each row in proportion to counts, 1 at least, the row's largest taking what is left."""
    total, kinds = np.bincount(row, counts, len(bits)), np.bincount(row, minlength=len(bits))
    free = (1 << bits) - kinds
    size = 1 + (counts * free[row] // total[row]).astype(np.int64)
    left = (1 << bits) - np.bincount(row, size, len(bits)).astype(np.int64)
    order = np.lexsort((np.arange(len(row)), -counts, row))
    first = np.flatnonzero(np.concatenate(([True], row[order][1:] != row[order][:-1]))) if len(row) else order
    size[order[first]] += left[row[order[first]]]
    return size


class Counts:
    """A frame's counts: a row of shares for each id that has successors, and one of order 0.

    Ids are numbered by rank in `names`. Rows are those of the ids, then one without entries for a block's beginning, that of
    order 0 and one that codes nothing. entries: 8 bits of a row's total, first and size of the share, 20 bits each.
    """

    def __init__(self, names: np.ndarray, base: np.ndarray, row: np.ndarray, who: np.ndarray, size: np.ndarray, bits: np.ndarray) -> None:
        n = len(names)
        self.names, self.base, self.row, self.who, self.size, self.own_bits = names, base, row, who, size, bits
        base_bits = int(base.sum()).bit_length() - 1
        self.bits = np.concatenate((bits, [0, base_bits, 0])).astype(np.int64)
        self.start_row, self.base_row, self.no_row = n, n + 1, n + 2
        every_row = np.concatenate((row, np.full(n, self.base_row), [self.no_row]))
        every_who = np.concatenate((who, np.arange(n), [0])).astype(U)
        every_size = np.concatenate((size, base, [1]))
        ends = np.cumsum(every_size)
        per_row = np.bincount(every_row, every_size, n + 3).astype(np.int64)
        self.offset = np.cumsum(per_row) - per_row
        first = ends - every_size - self.offset[every_row]
        self.entries = (self.bits[every_row].astype(U) << U(40)) | (first.astype(U) << U(20)) | (every_size - 1).astype(U)
        self.pairs, self.every_who, self.every_size = len(row), every_who, every_size
        self.base_at, self.none_at = len(row), len(row) + n

    def slots(self) -> np.ndarray:
        """Of each place of each row: the id's rank (16 bits), and its entry's first and size."""
        return np.repeat((self.every_who << U(40)) | (self.entries & U((1 << 40) - 1)), self.every_size)

    @staticmethod
    def of(blocks: list[np.ndarray]) -> tuple[Counts, list[np.ndarray], list[np.ndarray]]:
        """Counts of the blocks, and for each block its ids' ranks and the entries that code them."""
        flat = np.concatenate(blocks) if blocks else np.empty(0, np.uint16)
        held = np.bincount(flat, minlength=VOCABULARY)
        names = np.flatnonzero(held)
        n = len(names)
        rank = np.zeros(VOCABULARY, np.uint32)
        rank[names] = np.arange(n)
        ranks = rank[flat]
        begins = np.cumsum([0, *(len(b) for b in blocks)])[:-1]
        # Every pair with its place behind it, sorted: equal pairs lie together, and know where they belong.
        pair = np.empty(len(ranks), U)
        pair[:1], pair[1:] = 0, ranks[:-1].astype(U) * U(n)
        pair += ranks
        pair[begins] = U(n) * U(n)  # no pair, at a block's first id
        pair <<= U(31)
        pair |= np.arange(len(pair), dtype=U)
        pair.sort()
        place = pair.astype(np.uint32) & np.uint32((1 << 31) - 1)
        pair >>= U(31)
        new = np.flatnonzero(np.concatenate(([True], pair[1:] != pair[:-1]))) if len(pair) else np.empty(0, np.int64)
        count, key = np.diff(np.append(new, len(pair))), pair[new].astype(np.int64)
        del pair
        kept = (count >= SEEN) & (key < n * n)
        number = np.repeat(np.where(kept, np.cumsum(kept) - 1, -1).astype(np.int32), count)
        entry = np.empty(len(ranks), np.int32)
        for a in range(0, len(place), 1 << 20):  # step by step, as an index is widened to 64 bits
            entry[place[a : a + (1 << 20)]] = number[a : a + (1 << 20)]
        del number, place
        kept = np.flatnonzero(kept)
        row, who = key[kept] // max(n, 1), key[kept] % max(n, 1)
        seen, kinds = np.bincount(row, count[kept], n), np.bincount(row, minlength=n)
        bits = np.where(kinds > 0, np.clip(np.ceil(np.log2(np.maximum(seen, 1))), LEAST_BITS, MOST_BITS), 0).astype(np.int64)
        bits = np.maximum(bits, np.where(kinds > 0, np.ceil(np.log2(np.maximum(kinds, 1))) + 1, 0).astype(np.int64))
        base_bits = max(12, int(n).bit_length() + 3)
        base = shares(held[names].astype(float), np.zeros(n, np.int64), np.array([base_bits]))
        counts = Counts(names, base, row, who, shares(count[kept].astype(float), row, bits), bits)
        missing = entry < 0
        entry[missing] = counts.base_at + ranks[missing]
        cuts = begins[1:]
        return counts, np.split(ranks, cuts) if blocks else [], np.split(entry, cuts) if blocks else []

    def packed(self) -> bytes:
        """All of it as numbers of 32 bits, those that ascend as differences, byte by byte, deflated."""
        gaps = np.diff(self.who, prepend=0)
        new = np.concatenate(([True], self.row[1:] != self.row[:-1])) if len(self.row) else np.empty(0, bool)
        gaps[new] = self.who[new]
        parts = [np.diff(self.names, prepend=0), self.base - 1, self.own_bits, np.bincount(self.row, minlength=len(self.names)), gaps, self.size - 1]
        body = np.concatenate([p.astype("<u4") for p in parts])
        return np.array([len(self.names), len(self.row)], "<u4").tobytes() + zlib.compress(body.view(np.uint8).reshape(-1, 4).T.tobytes(), 9)

    @staticmethod
    def unpacked(data: bytes) -> Counts:
        n, pairs = np.frombuffer(data, "<u4", 2).tolist()
        planes = np.frombuffer(zlib.decompress(data[8:]), np.uint8).reshape(4, -1)
        body = np.ascontiguousarray(planes.T).view("<u4").ravel().astype(np.int64)
        names, base, bits, kinds, gaps, size = np.split(body, np.cumsum([n, n, n, n, pairs]))
        row = np.repeat(np.arange(n), kinds)
        total = np.cumsum(gaps)
        first = (np.cumsum(kinds) - kinds)[row]
        who = total - (total[first] - gaps[first]) if pairs else total
        return Counts(np.cumsum(names), base + 1, row, who, size + 1, bits)


class Model:
    """All lanes' tables and weights, over ranks of ids. Weights have 16 bits; none of the three is ever 0 where it may code."""

    def __init__(self, lanes: int, counts: Counts) -> None:
        self.none = np.uint32(len(counts.names))
        self.bits, self.start_row = counts.bits, counts.start_row
        self.lane2, self.lane_sure, self.lane_row = ((np.arange(lanes, dtype=np.int64) << b) for b in (BITS2, 2, 5))
        # Rank times 4 and confidence.
        self.two = np.full(lanes << BITS2, self.none << 2, np.uint32)
        # Probability that order 2 is right by confidence, and that order 1 has the id by the bits of its row.
        self.right2 = np.tile(np.array([9000, 26000, 40000, 52000], np.int32), lanes)
        self.has1 = np.tile(np.where(np.arange(32) > 0, 60000, 0).astype(np.int32), lanes)
        self.before = np.full(lanes, self.start_row, np.int64)
        self.last = np.full(lanes, self.start_row, np.int64)

    def predict(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """For the first n lanes: the shares of order 2 and order 1 of 2**TOTAL."""
        last = self.last[:n]
        self.at2 = self.lane2[:n] + (((self.before[:n] * 40503 + last * 2654435761) >> 7) & ((1 << BITS2) - 1))
        entry = self.two[self.at2]
        self.id2 = entry >> 2
        self.sure = (entry & 3).astype(np.int64)
        self.known = self.id2 != self.none
        self.at_sure = self.lane_sure[:n] + self.sure
        self.p2 = self.right2[self.at_sure] * self.known
        self.at_row = self.lane_row[:n] + self.bits[last]
        self.q1 = self.has1[self.at_row]
        return self.p2, (((1 << TOTAL) - self.p2) * (self.q1 >> 2)) >> (TOTAL - 2)

    def update(self, ranks: np.ndarray, n: int, hit2: np.ndarray, hit1: np.ndarray) -> None:
        """hit2, hit1: whether order 2 and order 1 coded the rank."""
        self.right2[self.at_sure] += ((hit2 * 63400 + 600 - self.p2) >> 4) * self.known
        self.has1[self.at_row] += ((hit1 * 64800 + 300 - self.q1) >> 5) * (~hit2 & (self.q1 > 0))
        self.two[self.at2] = (ranks << 2) | (np.minimum(self.sure + 1, 3) * hit2)
        self.before[:n] = self.last[:n]
        self.last[:n] = ranks


class Lanes:
    """What the coder and the decoder have in common: the state low, range of each lane."""

    def __init__(self, lanes: int) -> None:
        self.low = np.zeros(lanes, U)
        self.range = np.full(lanes, 0xFFFFFFFFFFFFFFFF, U)

    def narrow(self, n: int, r: np.ndarray, first: np.ndarray, size: np.ndarray) -> None:
        self.low[:n] += r * first
        self.range[:n] = r * size

    def shifts(self, n: int):
        """Yields the lanes whose upper 16 bits leave, until none do."""
        low, range_ = self.low[:n], self.range[:n]
        out = (low ^ (low + range_)) < U(1 << 48)
        small = range_ < U(1 << 40)
        who = np.flatnonzero(out | small)
        while len(who):
            a, r = low[who], range_[who]
            tight = (r < U(1 << 40)) & ((a ^ (a + r)) >= U(1 << 48))
            if tight.any():
                cut = (~a[tight] + U(1)) & U((1 << 40) - 1)
                r[tight] = np.where(cut == 0, U(1 << 40), cut)
            yield who, a
            a, r = a << U(16), r << U(16)
            low[who], range_[who] = a, r
            who = who[((a ^ (a + r)) < U(1 << 48)) | (r < U(1 << 40))]


def pick(condition: np.ndarray, yes: np.ndarray, no: np.ndarray) -> np.ndarray:
    """np.where of integers without branches: quicker where conditions are hard to guess."""
    return no + condition * (yes - no)


def encode_blocks(blocks: list[np.ndarray]) -> tuple[bytes, list[bytes]]:
    """The blocks' counts, and each block of ids, as bytes. Lanes are ordered by length, so that finished ones drop off the end."""
    counts, ranks, entries = Counts.of(blocks)
    coded = [c for k in range(0, len(blocks), LANES) for c in encode_lanes(counts, ranks[k : k + LANES], entries[k : k + LANES])]
    return counts.packed(), coded


def lanes_of(arrays: list[np.ndarray], order: list[int], dtype) -> np.ndarray:
    """Steps x lanes."""
    out = np.zeros((len(arrays[order[0]]) if order else 0, len(order)), dtype)
    for k, i in enumerate(order):
        out[: len(arrays[i]), k] = arrays[i]
    return out


def encode_lanes(counts: Counts, ranks: list[np.ndarray], entries: list[np.ndarray]) -> list[bytes]:
    order = sorted(range(len(ranks)), key=lambda i: -len(ranks[i]))
    sizes = np.array([len(ranks[i]) for i in order])
    own, coded_by = lanes_of(ranks, order, np.uint32), lanes_of(entries, order, np.int32)
    model, state = Model(len(order), counts), Lanes(len(order))
    out, filled = np.zeros((len(order), len(own) // 2 + 256), ">u2"), np.zeros(len(order), np.int64)
    with np.errstate(over="ignore"):
        for step in range(len(own)):
            if step % 16 == 0 and int(filled.max()) + 128 > out.shape[1]:
                out = np.concatenate((out, np.zeros_like(out)), axis=1)
            n = int(np.searchsorted(-sizes, -step, "left"))
            x, at = own[step, :n], coded_by[step, :n]
            p2, p1 = model.predict(n)
            hit2 = model.id2 == x
            hit1 = (at < counts.pairs) & ~hit2
            first = pick(hit2, 0, pick(hit1, p2, p2 + p1))
            size = pick(hit2, p2, pick(hit1, p1, (1 << TOTAL) - p2 - p1))
            state.narrow(n, state.range[:n] >> U(TOTAL), first.astype(U), size.astype(U))
            entry = counts.entries[pick(hit2, counts.none_at, at)]
            state.narrow(n, state.range[:n] >> (entry >> U(40)), (entry >> U(20)) & U((1 << 20) - 1), (entry & U((1 << 20) - 1)) + U(1))
            for who, low in state.shifts(n):
                to = filled[who]
                out[who, to] = (low >> U(48)).astype(np.uint16)
                filled[who] = to + 1
            model.update(x, n, hit2, hit1)
        for shift in (48, 32, 16, 0):
            out[np.arange(len(order)), filled] = (state.low >> U(shift)).astype(np.uint16)
            filled += 1
    coded: list[bytes] = [b""] * len(ranks)
    for k, i in enumerate(order):
        coded[i] = out[k, : filled[k]].tobytes()
    return coded


def decode_blocks(counts: bytes, coded: list[bytes], sizes: list[int]) -> list[np.ndarray]:
    known = Counts.unpacked(counts)
    slots = known.slots()
    return [ids for k in range(0, len(coded), LANES) for ids in decode_lanes(known, slots, coded[k : k + LANES], sizes[k : k + LANES])]


def decode_lanes(counts: Counts, slots: np.ndarray, coded: list[bytes], sizes: list[int]) -> list[np.ndarray]:
    order = sorted(range(len(coded)), key=lambda i: -sizes[i])
    length = np.array([sizes[i] for i in order])
    words = np.zeros((len(order), max((len(c) for c in coded), default=0) // 2 + 4), np.uint16)
    for k, i in enumerate(order):
        words[k, : len(coded[i]) // 2] = np.frombuffer(coded[i], ">u2")
    code = np.zeros(len(order), U)
    for j in range(4):
        code = (code << U(16)) | words[:, j].astype(U)
    read = np.full(len(order), 4)
    model, state = Model(len(order), counts), Lanes(len(order))
    names, bits, offset = counts.names.astype(np.uint16), counts.bits, counts.offset
    ids = np.zeros((int(length[0]) if len(length) else 0, len(order)), np.uint16)
    most = np.uint32(max(len(names) - 1, 0))
    with np.errstate(over="ignore", divide="ignore"):
        for step in range(len(ids)):
            n = int(np.searchsorted(-length, -step, "left"))
            p2, p1 = model.predict(n)
            r = state.range[:n] >> U(TOTAL)
            target = np.minimum((code[:n] - state.low[:n]) // r, U((1 << TOTAL) - 1)).astype(np.int32)
            hit2 = target < p2
            hit1 = ~hit2 & (target < p2 + p1)
            first = pick(hit2, 0, pick(hit1, p2, p2 + p1))
            size = pick(hit2, p2, pick(hit1, p1, (1 << TOTAL) - p2 - p1))
            state.narrow(n, r, first.astype(U), size.astype(U))
            row = pick(hit1, model.last[:n], counts.base_row + hit2)
            b = bits[row].astype(U)
            r = state.range[:n] >> b
            # A damaged block may lead anywhere; its checksum tells.
            target = np.minimum((code[:n] - state.low[:n]) // r, (U(1) << b) - U(1)).astype(np.int64)
            slot = slots[offset[row] + target]
            state.narrow(n, r, (slot >> U(20)) & U((1 << 20) - 1), (slot & U((1 << 20) - 1)) + U(1))
            x = np.minimum(pick(hit2, model.id2, (slot >> U(40)).astype(np.uint32)), most)
            ids[step, :n] = names[x]
            for who, _ in state.shifts(n):
                at = read[who]
                code[who] = (code[who] << U(16)) | words[who, np.minimum(at, words.shape[1] - 1)]
                read[who] = at + 1
            model.update(x, n, hit2, hit1)
    out: list[np.ndarray] = [np.empty(0, np.uint16)] * len(coded)
    for k, i in enumerate(order):
        out[i] = ids[: sizes[i], k].copy()
    return out


class Numbers:
    """Number of each odd 64-bit key, in the order of coming: open addressing, all keys of a call at once."""

    def __init__(self, bits: int = 16) -> None:
        self.keys, self.values, self.mask, self.count = np.zeros(1 << bits, U), np.zeros(1 << bits, np.int32), (1 << bits) - 1, 0

    def slot(self, keys: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return ((keys * U(0x9E3779B97F4A7C15)) >> U(32) & U(self.mask)).astype(np.int64)

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Numbers, -1 of unknown keys; and the free slot at which the search for those ended."""
        slot = self.slot(keys)
        there = self.keys[slot]
        out = np.where(there == keys, self.values[slot], np.int32(-1)).astype(np.int64)
        open_ = np.flatnonzero((there != keys) & (there != 0))
        while len(open_):
            at = (slot[open_] + 1) & self.mask
            slot[open_] = at
            there = self.keys[at]
            same = there == keys[open_]
            out[open_[same]] = self.values[at[same]]
            open_ = open_[~same & (there != 0)]
        return out, slot

    def add(self, keys: np.ndarray) -> None:
        """Numbers new distinct keys; the table is never more than half full."""
        old, values = self.keys, self.values
        while 2 * (self.count + len(keys)) > self.mask:
            self.mask = 2 * self.mask + 1
        if self.mask >= len(old):
            used = old != 0
            self.keys, self.values = np.zeros(self.mask + 1, U), np.zeros(self.mask + 1, np.int32)
            self.put(old[used], values[used])
        self.put(keys, self.count + np.arange(len(keys), dtype=np.int32))
        self.count += len(keys)

    def put(self, keys: np.ndarray, values: np.ndarray) -> None:
        while len(keys):
            _, slot = self.find(keys)
            _, first = np.unique(slot, return_index=True)
            self.keys[slot[first]], self.values[slot[first]] = keys[first], values[first]
            rest = np.ones(len(keys), bool)
            rest[first] = False
            keys, values = keys[rest], values[rest]


class Encoder:
    """The tokenizer, run once for each distinct piece into which its own pattern splits texts.

    The pattern is that of byte-level vocabularies: runs of letters, of digits and of other signs, each with the space
    before it, and what white space is left. Pieces are found for many texts at once by the classes of their code points; a
    text with a special token or an apostrophe that may begin a contraction goes to the tokenizer as a whole. A piece is known
    by two hashes of its code points whose seeds are drawn anew for each process; where they don't agree on a
    piece, its texts go to the tokenizer too.
    """

    def __init__(self, path: str, specials: list[str]) -> None:
        import regex
        from tokenizers import Tokenizer

        self.tokenizer, self.specials = Tokenizer.from_file(path), specials
        if self.tokenizer.get_vocab_size() > VOCABULARY:
            raise ValueError(f"a vocabulary of more than {VOCABULARY} ids")
        self.contraction = regex.compile(r"'(?:[stmd]|re|ve|ll)").search
        # Class of each code point: 1 letters, 2 numbers, 3 white space, 0 others.
        self.kinds = np.zeros(0x110000, np.uint8)
        every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
        for kind, pattern in ((1, r"\p{L}+"), (2, r"\p{N}+"), (3, r"\s+")):
            for m in regex.finditer(pattern, every):
                a, b = (x + 0x800 * (x >= 0xD800) for x in m.span())
                self.kinds[a:b] = kind
        self.seeds = [int(x) for x in np.random.default_rng().integers(1, 1 << 62, 2)]
        # Fixed values of byte-level vocabularies: printable bytes stand for themselves, the others for code points from 256 on.
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        self.letters = {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(sorted({*range(256)} - {*plain}))}
        self.forget()

    def forget(self) -> None:
        self.numbers, self.held = Numbers(18), 0
        self.ids, self.start, self.checks = np.empty(1 << 16, np.uint16), np.zeros(1 << 14, np.int64), np.zeros(1 << 14, U)

    def learn(self, fresh: list[str]) -> None:
        """Ids of new pieces, from the library's model: a piece is what it would be handed by its own pattern."""
        split = self.tokenizer.model.tokenize
        got = [[token.id for token in split(x.encode().decode("latin-1").translate(self.letters))] for x in fresh]
        new = np.fromiter((i for ids in got for i in ids), np.uint16)
        if self.held + len(new) > len(self.ids):
            self.ids = np.concatenate((self.ids, np.empty(len(self.ids) + len(new), np.uint16)))
        self.ids[self.held : self.held + len(new)] = new
        n = self.numbers.count - len(fresh)
        if n + len(fresh) >= len(self.start):
            self.start = np.concatenate((self.start, np.zeros(len(self.start) + len(fresh), np.int64)))
            self.checks = np.concatenate((self.checks, np.zeros(len(self.checks) + len(fresh), U)))
        self.start[n + 1 : n + 1 + len(fresh)] = self.held + np.cumsum([len(ids) for ids in got])
        self.held += len(new)

    def pieces(self, points: np.ndarray, edges: np.ndarray) -> np.ndarray:
        """Where pieces begin, of texts end to end; edges: where each text begins, and the end."""
        kind = self.kinds[points]
        n = len(points)
        new = np.ones(n, bool)
        new[1:] = kind[1:] != kind[:-1]
        inner = edges[(edges > 0) & (edges < n)]
        new[inner] = True
        text_start = np.zeros(n + 1, bool)
        text_start[edges] = True
        first = np.flatnonzero(new)
        last = np.append(first[1:], n) - 1
        white = kind[first] == 3
        begins = np.zeros(n, bool)
        solid = first[~white]
        joined = ~text_start[solid] & (points[solid - 1] == 32)
        begins[solid - joined] = True
        a, b = first[white], last[white]
        begins[a] = True
        # White space before a sign leaves its last character, which stands alone unless it is a space.
        begins[b[~text_start[b + 1]]] = True
        return np.flatnonzero(begins)

    def known(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids end to end and number of ids of texts without special tokens and contractions; and the texts with a piece that isn't sure."""
        text = "".join(texts)
        points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        edges = np.cumsum([0, *map(len, texts)])
        if not len(points):
            return np.empty(0, np.uint16), np.zeros(len(texts), np.int64), np.empty(0, np.int64)
        begin = self.pieces(points, edges)
        end = np.append(begin[1:], len(points))
        # As narrow code points as these texts allow; a piece that is met in several widths is learned in each.
        width = 1 if (most := int(points.max())) < 1 << 8 else 2 if most < 1 << 16 else 4
        padded = np.zeros(width * len(points) + 8, np.uint8)
        padded[:-8].view(f"u{width}")[:] = points
        key, check = (span_hashes(padded, width * begin, width * end, seed + width) for seed in self.seeds)
        key |= U(1)
        number, _ = self.numbers.find(key)
        unknown = np.flatnonzero(number < 0)
        if len(unknown):
            keys, at = np.unique(key[unknown], return_index=True)
            at = unknown[at]
            self.numbers.add(keys)
            self.learn([text[x:y] for x, y in zip(begin[at].tolist(), end[at].tolist(), strict=True)])
            self.checks[self.numbers.count - len(keys) : self.numbers.count] = check[at]
            number[unknown], _ = self.numbers.find(key[unknown])
        size = self.start[number + 1] - self.start[number]
        total = np.concatenate(([0], np.cumsum(size)))
        flat = self.ids[np.repeat(self.start[number] - total[:-1], size) + np.arange(total[-1])]
        unsure = np.flatnonzero(self.checks[number] != check)
        return flat, np.diff(total[np.searchsorted(begin, edges)]), np.unique(np.searchsorted(edges, begin[unsure], "right") - 1)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the texts end to end, each with the end id, and the number of ids of each."""
        if self.numbers.count > REMEMBERED:
            self.forget()
        ids: list[np.ndarray | None] = [None] * len(texts)
        plain = [i for i, t in enumerate(texts) if not (any(s in t for s in self.specials) or ("'" in t and self.contraction(t) is not None))]
        at = 0
        while at < len(plain):
            to, points = at + 1, len(texts[plain[at]])
            while to < len(plain) and points + len(texts[plain[to]]) <= POINTS:
                points += len(texts[plain[to]])
                to += 1
            flat, n, unsure = self.known([texts[i] for i in plain[at:to]])
            ends = np.cumsum(n).tolist()
            for i, a, b in zip(plain[at:to], [0, *ends], ends, strict=False):
                ids[i] = flat[a:b]
            for k in unsure.tolist():
                ids[plain[at + k]] = None
            at = to
        out, stop = [], np.array([END], np.uint16)
        for t, x in zip(texts, ids, strict=True):
            out += [np.array(self.tokenizer.encode(t, add_special_tokens=False).ids, np.uint16) if x is None else x, stop]
        return np.concatenate(out) if out else np.empty(0, np.uint16), np.array([len(x) + 1 for x in out[::2]], np.int64)


def encoder(path: str, specials: list[str]) -> Encoder:
    """This process's encoder; what it remembers outlives a task."""
    kept = sys.modules.setdefault("_vecforge_kept", types.ModuleType("_vecforge_kept"))
    if getattr(kept, "path", None) != path:
        kept.path, kept.encoder = path, Encoder(path, specials)
    return kept.encoder


FRAMES = "part long, frame long, start long, total long, doc_ids array<long>, lengths array<long>, counts binary, blocks array<struct<size: int, crc: long, data: binary>>"


def frames(ids: list[np.ndarray], block: int) -> dict:
    """counts and blocks of a frame's ids."""
    flat = np.concatenate(ids)
    blocks = [flat[i : i + block] for i in range(0, len(flat), block)]
    counts, coded = encode_blocks(blocks)
    return {"counts": counts, "blocks": [{"size": len(b), "crc": zlib.crc32(b.astype("<u4").tobytes()), "data": c} for b, c in zip(blocks, coded, strict=True)]}


def write(documents: DataFrame, store: str, tokenizer: str, specials: list[str], block: int = BLOCK, frame: int = FRAME) -> None:
    """Writes the documents' token ids to a store, in ascending doc_id."""
    spark = documents.sparkSession
    ordered = documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).repartitionByRange(tasks(spark), "doc_id").sortWithinPartitions("doc_id", "text")

    def run(batches):
        part, number, start = TaskContext.get().partitionId(), 0, 0
        enc = encoder(tokenizer, specials)
        schema = pa.schema([("part", pa.int64()), ("frame", pa.int64()), ("start", pa.int64()), ("total", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int64())), ("counts", pa.binary()), ("blocks", pa.list_(pa.struct([("size", pa.int32()), ("crc", pa.int64()), ("data", pa.binary())])))])
        held: list[np.ndarray] = []
        docs: list = []
        lengths: list[int] = []

        def full():
            total = sum(lengths)
            return pa.RecordBatch.from_pylist([{"part": part, "frame": number, "start": start, "total": total, "doc_ids": docs, "lengths": lengths} | frames(held, block)], schema)

        for batch in batches:
            keys = batch.column(0).to_pylist()
            for a in range(0, batch.num_rows, 500):
                texts = batch.column(1).slice(a, 500).to_pylist()
                ids, n = enc.encode(texts)
                held.append(ids)
                docs += keys[a : a + 500]
                lengths += n.tolist()
                if sum(map(len, held)) >= frame:
                    yield full()
                    number, start = number + 1, start + sum(lengths)
                    held, docs, lengths = [], [], []
        if docs:
            yield full()

    ordered.mapInArrow(run, FRAMES).write.mode("error").parquet(store)


def read(spark: SparkSession, store: str) -> DataFrame:
    """doc_id, start, n_tokens and the ids (little-endian unsigned 32-bit) of each document of a store."""
    stored = spark.read.parquet(store)
    # One row for each part, as many as the range partitions of the write: a bound that the number of tasks gives.
    totals = stored.groupBy("part").agg(F.sum("total").alias("n"))
    before = F.broadcast(totals.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before")))

    def run(batches):
        for batch in batches:
            for row in range(batch.num_rows):
                start, docs, lengths, counts, blocks = (batch.column(i)[row].as_py() for i in range(1, 6))
                got = decode_blocks(counts, [b["data"] for b in blocks], [b["size"] for b in blocks])
                for b, ids in zip(blocks, got, strict=True):
                    if zlib.crc32(ids.astype("<u4").tobytes()) != b["crc"]:
                        raise ValueError("a block's checksum doesn't match its ids")
                flat = np.concatenate(got)
                ends = np.cumsum(lengths)
                starts = ends - lengths
                raw = [flat[a:b].astype("<u4").tobytes() for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
                part = pa.array([batch.column(0)[row].as_py()] * len(docs), pa.int64())
                yield pa.RecordBatch.from_arrays([part, pa.array(docs, pa.int64()), pa.array(starts + start), pa.array(lengths, pa.int64()), pa.array(raw, pa.binary())], ["part", "doc_id", "at", "n_tokens", "ids"])

    rows = stored.select("part", "start", "doc_ids", "lengths", "counts", "blocks").mapInArrow(run, "part long, doc_id long, at long, n_tokens long, ids binary")
    return rows.join(before, "part").select("doc_id", (F.col("at") + F.col("before")).alias("start"), "n_tokens", "ids")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .common import shared_folder

    store = f"{shared_folder(spark)}/tokens-{uuid.uuid4().hex}"
    write(table(spark, sf_dir, "documents"), store, public_tokenizers.path("byte_bpe_50k.json"), ["<|endoftext|>"])
    return read(spark, store).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
