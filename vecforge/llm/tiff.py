"""TIFF pages: a reader that walks image directories, and a writer that the query stores its payloads with.

The reader takes either byte order, follows the chain of image file directories, decodes PackBits, LZW or deflate strips
and tiles, undoes the horizontal predictor, crops tiles to the image and gives one row per page. The writer makes the
same kinds of pages.

Defined cases: a null or empty media value has no pages. A chain that comes back to a directory ends there. A value that
is no TIFF, or damaged, gives one row with page -1 and the error's text, so that one file can't stop a job: sizes are checked
before anything is allotted or unpacked, against PIXEL_BYTES a page. Of several samples to a pixel all are kept, pixel by
pixel, also where the file has them in planes. Columns of the input that share a name with the page's are left
out of the result, except for the key.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

#: Fixed values of the format: tags, compressions, sizes of field types.
WIDTH, HEIGHT, BITS, COMPRESSION, PHOTOMETRIC, OFFSETS, SAMPLES, ROWS, COUNTS, PREDICTOR, TILE_WIDTH, TILE_HEIGHT, TILE_OFFSETS, TILE_COUNTS, PLANAR = 256, 257, 258, 259, 262, 273, 277, 278, 279, 317, 322, 323, 324, 325, 284
PLAIN, LZW, DEFLATE, OLD_DEFLATE, PACKBITS = 1, 5, 8, 32946, 32773
TYPE_BYTES = {1: 1, 2: 1, 3: 2, 4: 4, 6: 1, 8: 2, 9: 4}
TYPE_CODES = {1: "B", 2: "B", 3: "H", 4: "I", 6: "b", 8: "h", 9: "i"}
CLEAR, STOP = 256, 257

#: Bytes of a page's pixels at most; directories of a file and values of a tag at most.
PIXEL_BYTES, MOST_PAGES, MOST_VALUES = 1 << 29, 1 << 16, 1 << 24

#: The query's layout: pixels of a row, rows of a page, of a strip and of a tile.
LINE, PAGE_ROWS, STRIP_ROWS, TILE = 64, 4096, 64, 32


def lzw_encode(data: bytes) -> bytes:
    """LZW with codes of 9 to 12 bits, the highest bit first, each width ending one code early."""
    out = bytearray()
    acc, held, width = CLEAR, 9, 9
    codes: dict[int, int] = {}
    free, prefix = 258, -1
    for byte in data:
        if prefix < 0:
            prefix = byte
            continue
        key = prefix << 8 | byte
        known = codes.get(key)
        if known is not None:
            prefix = known
            continue
        acc, held = acc << width | prefix, held + width
        codes[key] = free
        free += 1
        if free + 1 > 1 << width:
            if width < 12:
                width += 1
            else:
                acc, held, width, free = acc << width | CLEAR, held + width, 9, 258
                codes = {}
        prefix = byte
        if held >= 256:
            rest = held & 7
            out += (acc >> rest).to_bytes(held >> 3, "big")
            acc, held = acc & ((1 << rest) - 1), rest
    if prefix >= 0:
        acc, held = acc << width | prefix, held + width
        free += 1
        if free + 1 > 1 << width and width < 12:
            width += 1
    acc, held = acc << width | STOP, held + width
    rest = -held & 7
    return bytes(out) + (acc << rest).to_bytes((held + rest) >> 3, "big")


def lzw_decode(data: bytes, size: int | None = None) -> bytes:
    """All that the codes say, or as much as gives size bytes."""
    out: list[bytes] = []
    made = 0
    words: list[bytes] = [bytes([i]) for i in range(256)] + [b"", b""]
    width, last, at, acc, held = 9, b"", 0, 0, 0
    while True:
        if held < width:
            more = data[at : at + 64]
            if not more:
                break
            acc, held, at = (acc & ((1 << held) - 1)) << (8 * len(more)) | int.from_bytes(more, "big"), held + 8 * len(more), at + len(more)
            if held < width:
                break
        held -= width
        code = acc >> held & ((1 << width) - 1)
        if code == STOP:
            break
        if code == CLEAR:
            del words[258:]
            width, last = 9, b""
            continue
        if code < len(words):
            word = words[code]
        elif last and code == len(words):
            word = last + last[:1]
        else:
            raise ValueError("an LZW code that isn't defined")
        out.append(word)
        made += len(word)
        if size is not None and made >= size:
            break
        if last:
            words.append(last + word[:1])
            if len(words) + 1 >= 1 << width and width < 12:
                width += 1
        last = word
    return b"".join(out)


def packbits_encode(data: bytes) -> bytes:
    x = np.frombuffer(data, np.uint8)
    if not len(x):
        return b""
    first = np.flatnonzero(np.concatenate(([True], x[1:] != x[:-1])))
    size = np.diff(np.append(first, len(x)))
    out, literal = bytearray(), 0

    def flush(end: int) -> None:
        for a in range(literal, end, 128):
            b = min(a + 128, end)
            out.append(b - a - 1)
            out.extend(data[a:b])

    for a, n in zip(first[size > 2].tolist(), size[size > 2].tolist(), strict=True):
        flush(a)
        literal = a + n
        while n:
            k = min(n, 128)
            out.extend((257 - k, data[a]) if k > 1 else (0, data[a]))
            n -= k
    flush(len(data))
    return bytes(out)


def packbits_decode(data: bytes, size: int) -> bytes:
    out, at, made = [], 0, 0
    while at < len(data) and made < size:
        n = data[at]
        if n < 128:
            part = data[at + 1 : at + 2 + n]
            at += n + 2
        elif n > 128:
            part = data[at + 1 : at + 2] * (257 - n)
            at += 2
        else:
            part, at = b"", at + 1
        out.append(part)
        made += len(part)
    return b"".join(out)


ENCODE = {PLAIN: bytes, LZW: lzw_encode, DEFLATE: lambda b: zlib.compress(b, 6), PACKBITS: packbits_encode}


def unpack(data: bytes, compression: int, size: int) -> bytes:
    if compression == PLAIN:
        out = data
    elif compression == LZW:
        out = lzw_decode(data, size)
    elif compression in (DEFLATE, OLD_DEFLATE):
        out = zlib.decompressobj().decompress(data, size)
    elif compression == PACKBITS:
        out = packbits_decode(data, size)
    else:
        raise ValueError(f"compression {compression} isn't supported")
    if len(out) < size:
        raise ValueError("a strip or tile is too short")
    return out[:size]


@dataclass
class Page:
    width: int
    height: int
    bits: int
    samples: int
    compression: int
    predictor: int
    tiled: bool
    pixels: bytes


def directories(data: bytes):
    """Each image file directory as a dict of tag to values."""
    order = {b"II": "<", b"MM": ">"}.get(data[:2])
    if order is None or struct.unpack(order + "H", data[2:4])[0] != 42:
        raise ValueError("not a TIFF")
    at, seen = struct.unpack(order + "I", data[4:8])[0], set()
    while at and at not in seen:
        seen.add(at)
        if len(seen) > MOST_PAGES:
            raise ValueError("too many directories")
        n = struct.unpack_from(order + "H", data, at)[0]
        tags = {}
        for k in range(n):
            tag, kind, count = struct.unpack_from(order + "HHI", data, at + 2 + 12 * k)
            if kind in TYPE_BYTES and count:
                if count > MOST_VALUES:
                    raise ValueError("a tag with too many values")
                place = at + 10 + 12 * k
                if TYPE_BYTES[kind] * count > 4:
                    place = struct.unpack_from(order + "I", data, place)[0]
                tags[tag] = struct.unpack_from(f"{order}{count}{TYPE_CODES[kind]}", data, place)
        yield order, tags
        at = struct.unpack_from(order + "I", data, at + 2 + 12 * n)[0]


def difference(block: np.ndarray, undo: bool) -> np.ndarray:
    """The horizontal predictor over rows x pixels x samples of 8 or 16 bits."""
    if undo:
        return np.cumsum(block, axis=1, dtype=block.dtype)
    out = block.copy()
    out[:, 1:] -= block[:, :-1]
    return out


def read_pages(data: bytes):
    for order, tags in directories(data):
        one = lambda tag, default=None, tags=tags: tags[tag][0] if tag in tags else default
        width, height, samples, compression, predictor = one(WIDTH), one(HEIGHT), one(SAMPLES, 1), one(COMPRESSION, PLAIN), one(PREDICTOR, 1)
        bits, planes = one(BITS, 1), one(SAMPLES, 1) if one(PLANAR, 1) == 2 else 1
        if bits not in (8, 16) or any(b != bits for b in tags.get(BITS, ())):
            raise ValueError(f"{bits} bits to a sample aren't supported")
        if predictor not in (1, 2):
            raise ValueError(f"predictor {predictor} isn't supported")
        kind = np.dtype("u1") if bits == 8 else np.dtype(order + "u2")
        tiled = TILE_OFFSETS in tags
        if tiled:
            w, h, offsets, counts = one(TILE_WIDTH), one(TILE_HEIGHT), tags[TILE_OFFSETS], tags[TILE_COUNTS]
        else:
            w, h = width, min(one(ROWS, height), height)
            offsets, counts = tags[OFFSETS], tags[COUNTS]
        if min(width, height, samples, w, h) < 1:
            raise ValueError("a page or tile without pixels")
        if max(width * height, w * h) * samples * kind.itemsize > PIXEL_BYTES:
            raise ValueError(f"a page of more than {PIXEL_BYTES} bytes")
        across, down, inner = -(-width // w), -(-height // h), samples // planes
        if len(offsets) != len(counts) or len(offsets) != across * down * planes:
            raise ValueError("strips or tiles don't cover the page once")
        image = np.zeros((height, width, samples), kind)
        for k, (o, n) in enumerate(zip(offsets, counts, strict=True)):
            plane, k = divmod(k, across * down)
            y, x = k // across * h, k % across * w
            rows = h if tiled else min(h, height - y)
            raw = unpack(data[o : o + n], compression, rows * w * inner * kind.itemsize)
            block = np.frombuffer(raw, kind).reshape(rows, w, inner)
            if predictor == 2:
                block = difference(block, True)
            image[y : y + rows, x : x + w, plane * inner : (plane + 1) * inner] = block[: height - y, : width - x]
        yield Page(width, height, bits, samples, compression, predictor, tiled, image.tobytes())


def write_pages(pages: list[tuple[np.ndarray, int, int, bool]], strip_rows: int = STRIP_ROWS, tile: int = TILE) -> bytes:
    """Little-endian TIFF of 8-bit grey pages: (rows x pixels, compression, predictor, tiled) each."""
    out, link = bytearray(b"II*\0\0\0\0\0"), 4
    for image, compression, predictor, tiled in pages:
        height, width = image.shape
        blocks = [image[y : y + tile, x : x + tile] for y in range(0, height, tile) for x in range(0, width, tile)] if tiled else [image[y : y + strip_rows] for y in range(0, height, strip_rows)]
        offsets, counts = [], []
        for b in blocks:
            if tiled and b.shape != (tile, tile):
                b = np.pad(b, ((0, tile - b.shape[0]), (0, tile - b.shape[1])))
            coded = ENCODE[compression]((difference(b, False) if predictor == 2 else b).tobytes())
            offsets.append(len(out))
            counts.append(len(coded))
            out += coded
        out += b"\0" * (len(out) & 1)
        fields = {WIDTH: [width], HEIGHT: [height], BITS: [8], COMPRESSION: [compression], PHOTOMETRIC: [1], SAMPLES: [1], PREDICTOR: [predictor]}
        fields |= {TILE_WIDTH: [tile], TILE_HEIGHT: [tile], TILE_OFFSETS: offsets, TILE_COUNTS: counts} if tiled else {OFFSETS: offsets, ROWS: [strip_rows], COUNTS: counts}
        entries = b""
        for tag, values in sorted(fields.items()):
            packed = struct.pack(f"<{len(values)}I", *values)
            place = packed
            if len(values) > 1:
                place = struct.pack("<I", len(out))
                out += packed
            entries += struct.pack("<HHI", tag, 4, len(values)) + place
        struct.pack_into("<I", out, link, len(out))
        out += struct.pack("<H", len(fields)) + entries
        link = len(out)
        out += b"\0\0\0\0"
    return bytes(out)


PAGES = "page int, width int, height int, bits int, samples int, compression int, predictor int, tiled boolean, pixels binary, error string"


def pages(media: DataFrame, key: str, column: str = "media") -> DataFrame:
    """One row per page: the key, the page's number from 0, its properties and pixels."""

    def run(batches):
        names = ["width", "height", "bits", "samples", "compression", "predictor", "tiled", "pixels"]
        schema = pa.schema([("page", pa.int32()), *((n, pa.int32()) for n in names[:6]), ("tiled", pa.bool_()), ("pixels", pa.binary()), ("error", pa.string())])
        for batch in batches:
            for k, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                rows = []
                try:
                    if data.is_valid and len(raw := data.as_py()):
                        rows = [{"page": i} | {n: getattr(p, n) for n in names} for i, p in enumerate(read_pages(raw))]
                except (ValueError, KeyError, IndexError, TypeError, ArithmeticError, MemoryError, struct.error, zlib.error) as e:
                    rows = [{"page": -1, "error": f"{type(e).__name__}: {e}"}]
                if rows:
                    made = pa.RecordBatch.from_pylist(rows, schema)
                    yield pa.RecordBatch.from_arrays([pa.array([k] * len(rows), batch.schema.field(0).type), *made.columns], [key, *schema.names])

    kind = dict(media.dtypes)[key]
    return media.select(key, column).mapInArrow(run, f"{key} {kind}, {PAGES}")


def layout(payload: bytes) -> list[tuple[np.ndarray, int, int, bool]]:
    """The query's pages of a payload; compression and order follow from its checksum, so that equal texts agree."""
    image = np.frombuffer(payload, np.uint8).reshape(-1, LINE)
    kinds = [(DEFLATE, 2, False), (LZW, 1, False), (PACKBITS, 1, False), (DEFLATE, 1, True), (LZW, 2, True)]
    start = zlib.crc32(payload) % len(kinds)
    return [(image[y : y + PAGE_ROWS], *kinds[(start + i) % len(kinds)]) for i, y in enumerate(range(0, len(image), PAGE_ROWS))]


def feature(found: list[Page]) -> str:
    """Pages, mean, deviation, entropy in bits and mean step between neighbours, over all pixels."""
    x = np.frombuffer(b"".join(p.pixels for p in found), np.uint8)
    share = np.bincount(x, minlength=256) / len(x)
    used = share[share > 0]
    mean = float((share * np.arange(256)).sum())
    deviation = float(np.sqrt((share * (np.arange(256) - mean) ** 2).sum()))
    step = float(np.abs(np.diff(x.astype(np.int16))).mean()) if len(x) > 1 else 0.0
    return f"pages={len(found)};mean={mean:.4f};sd={deviation:.4f};entropy={-(used * np.log2(used)).sum():.4f};step={step:.4f}"


DIGEST = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    def run(batches):
        names = [x.split()[0] for x in DIGEST.split(", ")]
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                raw = (text.as_py() or "").encode()
                media = write_pages(layout(raw + b"\0" * (max(LINE, -(-len(raw) // LINE) * LINE) - len(raw))))
                found = list(read_pages(media))
                payload = b"".join(p.pixels for p in found)
                rows.append((doc_id, len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-LINE:]), len(media), hashlib.sha256(media).hexdigest(), feature(found)))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names)

    return table(spark, sf_dir, "documents").select("doc_id", "text").mapInArrow(run, DIGEST)
