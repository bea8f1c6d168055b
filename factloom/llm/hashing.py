"""Vectorised hashing of the texts of an Arrow batch (numpy only; runs inside tasks)."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

_U = np.uint64
#: Odd multiplier of the polynomial hashes and its inverse modulo 2**64.
BASE = _U(0x9E3779B97F4A7C15)
INVERSE = _U(pow(0x9E3779B97F4A7C15, -1, 2**64))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values (the finaliser of the SplitMix64 generator)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> _U(30)
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


def powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    if n:
        out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


class Powers:
    """Powers of BASE and of its inverse, kept between batches and grown when needed."""

    def __init__(self) -> None:
        self.up = self.down = np.empty(0, np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            self.up, self.down = powers(BASE, 2 * n), powers(INVERSE, 2 * n)
        return self.up[:n], self.down[:n]


def prefix_sums(values: np.ndarray, kept: Powers) -> np.ndarray:
    """P with P[j] - P[i] = sum of values[k] * BASE**k for i <= k < j, modulo 2**64."""
    up, _ = kept.upto(len(values))
    out = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * up, out=out[1:])
    return out


def span_hashes(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray, kept: Powers) -> np.ndarray:
    """Hash of each values[start:end], equal for equal content wherever it stands."""
    _, down = kept.upto(len(sums))
    return mix((sums[ends] - sums[starts]) * down[starts])


def code_points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(the code points of all texts in a row, offsets of the texts in them)."""
    joined = "".join(texts)
    points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    return points, np.concatenate(([0], np.cumsum([len(t) for t in texts], dtype=np.int64)))


def window_minima(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of every w consecutive values, by prefix and suffix minima of blocks of w."""
    n = len(x)
    if n < w:
        return np.empty(0, x.dtype)
    if w == 1:
        return x
    top = np.iinfo(x.dtype).max
    padded = np.concatenate((x, np.full(-n % w, top, x.dtype))).reshape(-1, w)
    ahead = np.minimum.accumulate(padded, axis=1).ravel()
    back = np.minimum.accumulate(padded[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[: n - w + 1], ahead[w - 1 : n])


def batches_of(batch: pa.RecordBatch, column: int, limit: int):
    """Slices of the batch whose texts have about ``limit`` bytes together (a longer text comes alone)."""
    lengths = np.asarray(batch.column(column).fill_null("").cast(pa.large_binary()).to_numpy(zero_copy_only=False), dtype=object)
    total, start = 0, 0
    for i, t in enumerate(lengths):
        if total and total + len(t) > limit:
            yield batch.slice(start, i - start)
            total, start = 0, i
        total += len(t)
    if start < len(lengths):
        yield batch.slice(start)
