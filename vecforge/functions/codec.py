"""Variable-length integers and delta-coded lists, as Column builders and as bytes in Python."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def varint_bytes(v: Column) -> Column:
    """Bytes that a 32-bit value takes at seven bits a byte: 1 to 5."""
    n = F.lit(1)
    for bits in (7, 14, 21, 28):
        n = n + (v >= (1 << bits)).cast("int")
    return n


def varint_hex(v: Column) -> Column:
    """The little-endian groups of seven bits, each but the last with its high bit set, as upper-case hex."""
    groups = F.transform(F.sequence(F.lit(0), varint_bytes(v) - 1), lambda i: F.lpad(F.hex(group(v, i)), 2, "0"))
    return F.array_join(groups, "")


def group(v: Column, i: Column) -> Column:
    part = (F.floor(v / F.pow(F.lit(128.0), i)) % 128).cast("long")
    return part + F.when(i < varint_bytes(v) - 1, 128).otherwise(0)


def deltas(ids: Column) -> Column:
    """Differences of an ascending list, the first from 0."""
    s = F.array_sort(ids)
    return F.transform(s, lambda x, i: x - F.when(i == 0, F.lit(0).cast("long")).otherwise(F.get(s, i - 1)))


def undeltas(d: Column) -> Column:
    """The ascending list back from its differences."""
    return F.transform(d, lambda x, i: F.aggregate(F.slice(d, F.lit(1), i + 1), F.lit(0).cast("long"), lambda a, y: a + y))


def encoded_bytes(ids: Column) -> Column:
    """Bytes of a delta-coded list."""
    return F.aggregate(deltas(ids), F.lit(0), lambda n, d: n + varint_bytes(d))


def encode(values: list[int]) -> bytes:
    """Ascending 32-bit values as delta varints."""
    out, last = bytearray(), 0
    for v in values:
        d, last = v - last, v
        if not 0 <= d < 1 << 32:
            raise ValueError("values must ascend and fit 32 bits")
        while d > 127:
            out.append(d & 127 | 128)
            d >>= 7
        out.append(d)
    return bytes(out)


def decode(data: bytes) -> list[int]:
    """The values back; a byte string that ends within a value, or one of over five bytes, is an error."""
    out, last, value, shift = [], 0, 0, 0
    for byte in data:
        value |= (byte & 127) << shift
        shift += 7
        if byte < 128:
            last += value
            out.append(last)
            value = shift = 0
        elif shift > 28:
            raise ValueError("a value has more than five bytes")
    if shift:
        raise ValueError("the bytes end within a value")
    return out
