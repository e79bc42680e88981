"""Distances between vectors as Column builders and numpy kernels that give the same bits.

All sum in double precision from the first dimension to the last, so that SQL, Catalyst and numpy agree exactly.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Up to this many dimensions a sum is unrolled into one generated expression; above, a fold is faster.
UNROLLED = 64
#: Added to a norm before dividing by it, so that a zero vector stays zero.
TINY = 1e-30


def doubles(v: Column | str) -> Column:
    return F.transform(v, lambda x: x.cast("double"))


def fold(a: Column, b: Column, term: Callable[[Column, Column], Column], dim: int | None) -> Column:
    if dim is not None and dim <= UNROLLED:
        total = F.lit(0.0)
        for i in range(dim):
            total = total + term(F.get(a, F.lit(i)), F.get(b, F.lit(i)))
        return total
    return F.aggregate(F.zip_with(a, b, term), F.lit(0.0), lambda s, x: s + x)


def l2_sq(a: Column, b: Column, dim: int | None = None) -> Column:
    """Squared Euclidean distance, not its root."""
    return fold(a, b, lambda x, y: (x - y) * (x - y), dim)


def dot(a: Column, b: Column, dim: int | None = None) -> Column:
    return fold(a, b, lambda x, y: x * y, dim)


def inner_product(a: Column, b: Column, dim: int | None = None) -> Column:
    """1 - dot product; negative for long vectors."""
    return F.lit(1.0) - dot(a, b, dim)


def normalized(v: Column, dim: int | None = None) -> Column:
    """The vector times 1 / (norm + TINY); a zero vector stays zero."""
    scale = F.lit(1.0) / (F.sqrt(dot(v, v, dim)) + F.lit(TINY))
    return F.transform(v, lambda x: x * scale)


def cosine(a: Column, b: Column, dim: int | None = None) -> Column:
    return inner_product(normalized(a, dim), normalized(b, dim), dim)


def int_l2(a: Column, b: Column) -> Column:
    """Squared distance of small unsigned integers, in integer arithmetic."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("int") - y.cast("int")) * (x.cast("int") - y.cast("int"))), F.lit(0), lambda s, x: s + x)


#: The metrics by name; register() adds others.
METRICS: dict[str, Callable[..., Column]] = {"l2": l2_sq, "ip": inner_product, "cosine": cosine}


def np_l2(q: np.ndarray, b: np.ndarray) -> np.ndarray:
    out = np.zeros((len(q), len(b)))
    for i in range(q.shape[1]):
        d = q[:, i, None] - b[None, :, i]
        out += d * d
    return out


def np_ip(q: np.ndarray, b: np.ndarray) -> np.ndarray:
    out = np.zeros((len(q), len(b)))
    for i in range(q.shape[1]):
        out += q[:, i, None] * b[None, :, i]
    return 1.0 - out


def np_normalized(x: np.ndarray) -> np.ndarray:
    s = np.zeros(len(x))
    for i in range(x.shape[1]):
        s += x[:, i] * x[:, i]
    return x * (1.0 / (np.sqrt(s) + TINY))[:, None]


def np_cosine(q: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np_ip(np_normalized(q), np_normalized(b))


KERNELS: dict[str, Callable[[np.ndarray, np.ndarray], np.ndarray]] = {"l2": np_l2, "ip": np_ip, "cosine": np_cosine}


def register(name: str, column: Callable[..., Column], kernel: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> None:
    """Adds a metric: a Column builder (a, b, dim) and a kernel of two matrices that agree."""
    METRICS[name], KERNELS[name] = column, kernel
