"""Vectorised text work inside a task: one Arrow batch of strings becomes byte, word and n-gram arrays.

Words are maximal runs of bytes outside 0x20 and 0x09-0x0D (UTF-8 continuation bytes are never separators).
A byte run's hash comes from prefix sums of byte codes times powers of an odd base, modulo 2**64, mixed at
the end; so every word, n-gram or line costs one subtraction.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
BASE = 0x9E3779B97F4A7C15
STEP = 8 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64: a bijection on 64 bits."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


@cache
def codes(lower: bool) -> np.ndarray:
    b = np.arange(256, dtype=np.uint64)
    if lower:
        b[65:91] += U(32)
    return mix((b + U(1)) * U(BASE))


_pow: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and its inverse, for i below n; kept for the worker's life up to 2**21 entries."""
    if "p" in _pow and len(_pow["p"]) >= n:
        return _pow["p"], _pow["q"]
    size = max(n, 1 << 16)
    size = 1 << (size - 1).bit_length()
    out = []
    for base in (BASE, pow(BASE, -1, 1 << 64)):
        p = np.full(size, base, np.uint64)
        p[0] = 1
        out.append(np.multiply.accumulate(p))
    if size <= 1 << 21:
        _pow["p"], _pow["q"] = out
    return out[0], out[1]


class Texts:
    """Some whole texts: their bytes in one array, text i from at[i] to at[i + 1]. Null counts as empty."""

    def __init__(self, column: pa.Array):
        column = column.fill_null("") if column.null_count else column
        column = column.cast(pa.binary()) if not pa.types.is_binary(column.type) else column
        offsets = np.frombuffer(column.buffers()[1], np.int32, len(column) + 1 + column.offset)[column.offset :].astype(np.int64)
        data = column.buffers()[2]
        self.bytes = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None and len(data) else np.zeros(0, np.uint8)
        self.at = offsets - offsets[0]
        self.n = len(column)

    @property
    def lengths(self) -> np.ndarray:
        return np.diff(self.at)

    def prefix(self, lower: bool = False) -> np.ndarray:
        """prefix[i]: hash sum of the first i bytes."""
        p, _ = powers(len(self.bytes) + 1)
        h = np.zeros(len(self.bytes) + 1, np.uint64)
        np.cumsum(codes(lower)[self.bytes] * p[: len(self.bytes)], out=h[1:])
        return h

    @staticmethod
    def runs(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hashes of the byte runs [start, end)."""
        _, q = powers(len(prefix))
        return mix((prefix[end] - prefix[start]) * q[start] + (end - start).astype(np.uint64))

    def spans(self, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Start and end of the maximal runs of inside within each text."""
        edge = np.zeros(len(inside) + 1, bool)
        if len(inside):
            edge[1:-1] = inside[1:] != inside[:-1]
            cut = self.at[(self.at > 0) & (self.at < len(inside))]
            first = np.zeros(len(inside) + 1, bool)
            first[:-1] = edge[:-1] & inside
            last = np.zeros(len(inside) + 1, bool)
            last[1:] = edge[1:] & inside
            first[0] = inside[0]
            last[-1] = inside[-1]
            first[cut] |= inside[cut]
            last[cut] |= inside[cut - 1]
            return np.flatnonzero(first), np.flatnonzero(last)
        return np.zeros(0, np.int64), np.zeros(0, np.int64)

    def owner(self, start: np.ndarray) -> np.ndarray:
        """First index in start of each text, and the total: text i holds own[i] to own[i + 1]."""
        return np.searchsorted(start, self.at)

    def words(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start and end of the words, and each text's range in them."""
        start, end = self.spans(~WHITE[self.bytes])
        return start, end, self.owner(start)


WHITE = np.zeros(256, bool)
WHITE[[9, 10, 11, 12, 13, 32]] = True


def of_text(own: np.ndarray) -> np.ndarray:
    """Text index of each element, from the texts' ranges."""
    return np.repeat(np.arange(len(own) - 1), np.diff(own))


def grams(words: np.ndarray, own: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the k-word windows that lie within a text, and their texts' ranges in the result."""
    total = len(words)
    if total < k:
        return np.zeros(0, np.uint64), np.zeros(len(own), np.int64)
    h = words[: total - k + 1].copy()
    for j in range(1, k):
        h *= U(BASE)
        h += words[j : total - k + 1 + j]
    count = np.maximum(np.diff(own) - k + 1, 0)
    keep = np.ones(total + 1, bool)
    first, last = own[:-1][np.diff(own) > 0], own[1:][np.diff(own) > 0]
    for j in range(1, k):  # the last k - 1 words of a text begin no window; of a shorter text none does
        keep[np.maximum(last - j, first)] = False
    keep = keep[: total - k + 1]
    return mix(h[keep]), np.concatenate(([0], np.cumsum(count)))


def pieces(batches: Iterator[pa.RecordBatch], column: str, most: int = 1 << 20) -> Iterator[tuple[pa.RecordBatch, Texts]]:
    """Cuts batches so that each holds about most bytes of text; a text is never cut."""
    for batch in batches:
        if not batch.num_rows:
            continue
        col = batch.column(batch.schema.get_field_index(column))
        ends = np.cumsum(np.asarray(pc.binary_length(col).fill_null(0), dtype=np.int64))
        i = 0
        while i < batch.num_rows:
            j = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + most, "right")))
            part = batch.slice(i, j - i)
            yield part, Texts(part.column(part.schema.get_field_index(column)))
            i = j


def packed(values: np.ndarray, cuts: np.ndarray) -> list[bytes]:
    """The slices of values between cuts, as bytes."""
    raw, w = np.ascontiguousarray(values).tobytes(), values.dtype.itemsize
    return [raw[a * w : b * w] for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist())]


def per_text_sum(values: np.ndarray, own: np.ndarray) -> np.ndarray:
    """Sums of values over each text's range."""
    c = np.concatenate(([0], np.cumsum(values)))
    return c[own[1:]] - c[own[:-1]]


def packed_by(frag: np.ndarray, pieces: int, *arrays: np.ndarray) -> list[tuple]:
    """(fragment, bytes of each array's part) of the fragments that have any."""
    by = np.argsort(frag, kind="stable")
    cut = np.searchsorted(frag[by], np.arange(pieces + 1))
    arrays = [a[by] for a in arrays]
    return [(k, *(a[cut[k] : cut[k + 1]].tobytes() for a in arrays)) for k in range(pieces) if cut[k + 1] > cut[k]]


def batch_of(rows: list[tuple], kinds: list[pa.DataType], names: list[str]) -> pa.RecordBatch:
    """Rows as a batch; none make an empty one."""
    return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows) if rows else [[]] * len(kinds), kinds)], names)
