"""Words, word hashes and shingles of whole texts, vectorised over Arrow batches.

A word is a run of characters other than ASCII white space (0x20, 0x09-0x0D). Texts are handled as
UTF-8 bytes; null counts as empty. Batches are cut into slices of about SLICE bytes of text, so that
memory follows the longest text and not the batch.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc

SLICE = 2_000_000
#: Bytes that are hashed at a time.
BLOCK = 1 << 18
_U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash (xor-shift and multiply)."""
    x = x.astype(_U, copy=True)
    x ^= x >> _U(30)
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


def seeds(n: int, salt: int = 0) -> np.ndarray:
    """n odd pseudo-random 64-bit numbers, the same in every process."""
    return mix(np.arange(1, n + 1, dtype=_U) * _U(0x9E3779B97F4A7C15) + _U(salt)) | _U(1)


_BYTES = seeds(256, 7)
_BASE = 0x9E3779B97F4A7C15 | 1
_powers: dict[str, np.ndarray] = {"up": np.ones(1, _U), "down": np.ones(1, _U)}


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers["up"]) < n:
        size = max(n, 2 * BLOCK)
        for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            steps = np.full(size, base, _U)
            steps[0] = 1
            _powers[name] = np.cumprod(steps, dtype=_U)
    return _powers["up"], _powers["down"]


@dataclass
class Words:
    """Words of some texts: word i is data[start[i]:end[i]]; those of text d are first[d] to first[d + 1]."""

    data: np.ndarray
    offsets: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    @property
    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.counts)), self.counts)

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word's bytes: a polynomial over random byte values, by prefix sums."""
        out = np.empty(len(self.start), _U)
        block = self.start // BLOCK
        cuts = [0, *(np.flatnonzero(np.diff(block)) + 1).tolist(), len(block)]
        for i, j in zip(cuts, cuts[1:], strict=False):
            if i < j:
                low, high = self.start[i], self.end[j - 1]
                up, down = _power(int(high - low) + 1)
                total = np.zeros(high - low + 1, _U)
                np.cumsum(_BYTES[self.data[low:high]] * up[: high - low], out=total[1:], dtype=_U)
                out[i:j] = mix((total[self.end[i:j] - low] - total[self.start[i:j] - low]) * down[self.start[i:j] - low])
        return out

    def text(self, i: int) -> bytes:
        return self.data[self.start[i] : self.end[i]].tobytes()


def raw(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and offsets of some texts; nulls are empty."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def words(texts: pa.Array, lower: bool = False) -> Words:
    """Words of the texts; lower maps A-Z to a-z first."""
    data, offsets = raw(texts)
    return split(lowered(data) if lower else data, offsets, SOLID)


def lowered(data: np.ndarray) -> np.ndarray:
    """UTF-8 bytes with A-Z mapped to a-z."""
    return np.where((data >= 65) & (data <= 90), data + 32, data).astype(np.uint8)


def but(*ranges: tuple[int, int]) -> np.ndarray:
    """For each byte, if it is in none of the ranges (both ends included)."""
    table = np.ones(256, bool)
    for a, b in ranges:
        table[a : b + 1] = False
    return table


#: Bytes of words.
SOLID = but((0x20, 0x20), (0x09, 0x0D))


def split(data: np.ndarray, offsets: np.ndarray, table: np.ndarray) -> Words:
    """Runs of the bytes that table marks, none of which goes beyond its text."""
    solid = table[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    before, after = np.ones(len(data), bool), np.ones(len(data), bool)
    before[1:], after[:-1] = ~solid[:-1], ~solid[1:]
    start = np.flatnonzero(solid & (before | edge[:-1]))
    end = np.flatnonzero(solid & (after | edge[1:])) + 1
    return Words(data, offsets, start, end, np.searchsorted(start, offsets))


def strings(w: Words, at: np.ndarray) -> pa.Array:
    """The words at these indexes as strings."""
    length = w.end[at] - w.start[at]
    ends = np.zeros(len(at) + 1, np.int64)
    np.cumsum(length, out=ends[1:])
    flat = np.ascontiguousarray(w.data[spread(w.start[at], length)])
    return pa.LargeStringArray.from_buffers(len(at), pa.py_buffer(ends), pa.py_buffer(flat)).cast(pa.string())


def slices(batches: Iterator[pa.RecordBatch], text: str, most: int = SLICE) -> Iterator[pa.RecordBatch]:
    """The batches again, cut so that each has about `most` bytes of text (binary, or lists of 4 bytes a value), or one row."""
    for batch in batches:
        if not batch.num_rows:
            continue
        column = batch.column(text)
        size = pc.multiply(pc.list_value_length(column), 4) if pa.types.is_list(column.type) else pc.binary_length(column)
        size = pc.fill_null(size, 0).to_numpy(zero_copy_only=False).astype(np.int64)
        part = np.cumsum(size) // most
        cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:], strict=False):
            yield batch.slice(a, b - a)


def windows(hashes: np.ndarray, w: Words, k: int, salt: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all k-word windows inside one text, and the index of each window's first word."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, _U), np.zeros(0, np.int64)
    keep = np.zeros(len(hashes), bool)
    keep[:n] = True
    for d in range(1, k):  # a window that begins in the last k - 1 words of a text leaves it
        keep[np.maximum(w.first[1:] - d, w.first[:-1])[w.counts > 0]] = False
    if n < len(hashes):
        keep[n:] = False
    at = np.flatnonzero(keep)
    total = np.zeros(n, _U)
    for m, j in zip(seeds(k, salt), range(k), strict=True):
        total += hashes[j : j + n] * m
    return mix(total[at]), at


def shingle_sets(texts: pa.Array, k: int) -> list[np.ndarray]:
    """Per text the sorted distinct hashes of its k-word shingles, A-Z lower-cased; a text of fewer words has one, of all of them."""
    w = words(texts, lower=True)
    hashes = w.hashes()
    shingles, at = windows(hashes, w, k)
    cut = np.searchsorted(at, w.first)
    out = []
    for d, n in enumerate(w.counts):
        if n >= k:
            out.append(np.unique(shingles[cut[d] : cut[d + 1]]))
        elif n:
            own = hashes[w.first[d] : w.first[d + 1]]
            out.append(mix(np.array([(own * seeds(n, 1_000 + n)).sum(dtype=_U)], _U)))
        else:
            out.append(np.zeros(0, _U))
    return out


def lists(parts: list[np.ndarray], kind: pa.DataType) -> pa.ListArray:
    """An Arrow list column from one array per row."""
    ends = np.zeros(len(parts) + 1, np.int32)
    np.cumsum([len(x) for x in parts], out=ends[1:])
    flat = np.concatenate(parts) if parts else np.zeros(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat.astype(kind.to_pandas_dtype(), copy=False), kind))


def distinct(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each hash the number of its kind, and for each kind the index of its first hash."""
    codes, kinds = pd.factorize(hashes)
    first = np.zeros(len(kinds), np.int64)
    first[codes[::-1]] = np.arange(len(hashes))[::-1]
    return codes, first


def spread(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The indexes start[i], start[i] + 1, ... of all ranges, one after another."""
    if not len(length):
        return np.zeros(0, np.int64)
    return np.repeat(start - (np.cumsum(length) - length), length) + np.arange(length.sum())
