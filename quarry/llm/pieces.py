"""SentencePiece encoding with seeded merge-dropout, and decoding.

The model is a BPE vocabulary with byte fallback. A text is cut into units where no piece can reach across: before the
spaces of each word and around other white space. In each occurrence of a unit, an agenda of adjacent pairs whose join
is a piece is worked off from the best piece, leftmost first. Each candidate that comes up (its place in the unit
and its piece) is skipped if a hash keyed by seed, doc_id, the unit's number in its text, place and piece falls under the
dropout rate. So every occurrence has draws of its own, which are the same on any machine; another seed gives
another segmentation, and rate 0 the model's own.

Occurrences of units of one length are worked off side by side, a row of a matrix each, one candidate of every row at a
time; units of over WIDE characters one by one with a heap. Both ways give the same pieces.

Decoding joins the pieces' bytes and drops the leading space that encoding adds, so every segmentation gives
back its text, byte for byte. The character U+2581, which stands for a space in pieces, is written as bytes.

Rows: null text gives null ids and null text again; an empty text has no ids. Rows of equal doc_id and text are cut
alike; null doc_id counts as 0. Extra columns are ignored. An empty table gives an empty table.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F, types as T

from quarry.llm.words import Words, distinct, mix, raw, seeds, slices, spread

NONE = np.int64(1 << 62)
SPACE, META = 32, "▁"
#: Characters of the longest unit that is worked off in a matrix; symbols of a matrix.
WIDE, HELD = 48, 60_000
DEAD = np.int64(-(1 << 40))
_PLACE, _PIECE, _ORDER = (int(x) for x in seeds(3, 29))
_MASK = (1 << 64) - 1


def _mix(x: int) -> int:
    """words.mix of one number."""
    x ^= x >> 30
    x = x * 0xBF58476D1CE4E5B9 & _MASK
    x ^= x >> 27
    x = x * 0x94D049BB133111EB & _MASK
    return x ^ x >> 31


def occurrence_keys(doc_id: np.ndarray, order: np.ndarray, seed: int) -> np.ndarray:
    """What keys the draws of each occurrence: seed, doc_id and the unit's number in its text."""
    return mix(mix(doc_id.astype(np.int64).view(np.uint64) + seeds(1, seed)[0]) + order.astype(np.uint64) * np.uint64(_ORDER))


class Merges:
    """A vocabulary's pieces by id, and the joins of two pieces as rank << 20 | piece; NONE if they make no piece."""

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.GetPieceSize()
        names = [sp.IdToPiece(i) for i in range(n)]
        plain = [i for i in range(n) if not (sp.IsByte(i) or sp.IsControl(i) or sp.IsUnknown(i) or sp.IsUnused(i))]
        ids = {names[i]: i for i in plain}
        self.n = n
        self.byte = np.zeros(256, np.int64)
        self.bytes = [b""] * n
        for i in plain:
            self.bytes[i] = names[i].replace(META, " ").encode()
        for i in range(n):
            if sp.IsByte(i):
                self.byte[int(names[i][3:5], 16)] = i
                self.bytes[i] = bytes([int(names[i][3:5], 16)])
        self.char = -1 - np.arange(0x110000, dtype=np.int64)  # below 0: a character without a piece
        for x, i in ids.items():
            if len(x) == 1:
                self.char[ord(x.replace(META, " "))] = i
        place = {i: r for r, i in enumerate(sorted(plain, key=lambda i: (-sp.GetScore(i), i)))}
        self.joins = {}
        for x, i in ids.items():
            for cut in range(1, len(x)):
                a, b = ids.get(x[:cut]), ids.get(x[cut:])
                if a is not None and b is not None:
                    self.joins[a * n + b] = place[i] << 20 | i
        self.bits = max(4, (4 * len(self.joins)).bit_length())
        self.keys, self.values = np.full(1 << self.bits, -1, np.int64), np.full(1 << self.bits, NONE, np.int64)
        keys, values = np.fromiter(self.joins, np.int64, len(self.joins)), np.fromiter(self.joins.values(), np.int64, len(self.joins))
        at = self._slot(keys)
        while len(keys):  # each round, one key takes each free slot; the others go one slot on
            first = np.zeros(len(keys), bool)
            first[np.unique(at, return_index=True)[1]] = True
            first &= self.keys[at] < 0
            self.keys[at[first]], self.values[at[first]] = keys[first], values[first]
            keys, values, at = keys[~first], values[~first], at[~first] + 1 & (1 << self.bits) - 1
        self.size = np.array([len(x) for x in self.bytes], np.int64)
        self.flat = np.frombuffer(b"".join(self.bytes), np.uint8)
        self.start = np.cumsum(self.size) - self.size

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - self.bits)).astype(np.int64)

    def join(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """rank << 20 | piece of each join of a and b."""
        keys = np.where((a >= 0) & (b >= 0), a * self.n + b, -2)
        at = self._slot(keys)
        found = self.keys[at]
        out = np.where(found == keys, self.values[at], NONE)
        open_ = np.flatnonzero((found != keys) & (found >= 0) & (keys >= 0))
        at = at[open_]
        while len(open_):
            at = at + 1 & (1 << self.bits) - 1
            found = self.keys[at]
            out[open_] = np.where(found == keys[open_], self.values[at], NONE)
            on = (found != keys[open_]) & (found >= 0)
            open_, at = open_[on], at[on]
        return out

    def spelled(self, symbols: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids, and their number to each run of `size` symbols: characters without a piece become bytes."""
        odd = symbols < 0
        if not odd.any():
            return symbols, size
        code = -1 - symbols[odd]
        count = np.ones(len(symbols), np.int64)
        count[odd] = 1 + (code >= 0x80) + (code >= 0x800) + (code >= 0x10000)
        out = np.repeat(symbols, count)
        out[out < 0] = self.byte[np.frombuffer("".join(map(chr, code.tolist())).encode(), np.uint8)]
        total = np.r_[0, np.cumsum(count)]
        ends = np.cumsum(size)
        return out, total[ends] - total[ends - size]

    def matrix(self, sym: np.ndarray, value: np.ndarray, keys: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray]:
        """Symbols left of each row of sym (units of one length), and their number in each row. value: each symbol's join with the next; keys: of the rows' draws."""
        n, width = sym.shape
        sym, value, row = sym.ravel(), value.ravel(), np.arange(n)
        after, before = np.arange(1, n * width + 1), np.arange(-1, n * width - 1)
        after[row * width + width - 1] = before[row * width] = -1
        while len(row):
            at = row * width + value.reshape(n, width)[row].argmin(1)
            best = value[at]
            live = best < NONE
            row, at, best = row[live], at[live], best[live]
            piece = best & (1 << 20) - 1
            if limit:
                skip = mix(keys[row] + (at - row * width).astype(np.uint64) * np.uint64(_PLACE) + piece.astype(np.uint64) * np.uint64(_PIECE)) < np.uint64(limit)
                value[at[skip]] = NONE
                at, piece = at[~skip], piece[~skip]
            gone = after[at]
            then, prior = after[gone], before[at]
            sym[at], sym[gone], value[gone] = piece, DEAD, NONE
            after[at] = then
            more = then >= 0
            before[then[more]] = at[more]
            value[at] = NONE
            value[at[more]] = self.join(piece[more], sym[then[more]])
            more = prior >= 0
            value[prior[more]] = self.join(sym[prior[more]], piece[more])
        left = sym != DEAD
        return sym[left], left.reshape(n, width).sum(1)

    def one(self, symbols: list[int], key: int, limit: int) -> list[int]:
        """Symbols left of one unit of any length, by a heap."""
        n, alive = len(symbols), [True] * len(symbols)
        after, before, heap = [*range(1, n), -1], [*range(-1, n - 1)], []

        def meet(a: int, b: int) -> None:
            if a >= 0 and b >= 0 and symbols[a] >= 0 and symbols[b] >= 0 and (value := self.joins.get(symbols[a] * self.n + symbols[b])) is not None:
                heapq.heappush(heap, (value >> 20, a, b, symbols[a], symbols[b], value & (1 << 20) - 1))

        for i in range(n - 1):
            meet(i, i + 1)
        while heap:
            _, a, b, x, y, piece = heapq.heappop(heap)
            if not (alive[a] and alive[b] and symbols[a] == x and symbols[b] == y and after[a] == b):
                continue
            if limit and _mix(key + a * _PLACE + piece * _PIECE & _MASK) < limit:
                continue
            symbols[a], alive[b], after[a] = piece, False, after[b]
            if after[a] >= 0:
                before[after[a]] = a
            meet(before[a], a)
            meet(a, after[a])
        return [x for x, ok in zip(symbols, alive, strict=True) if ok]

    def text_bytes(self, ids: np.ndarray) -> np.ndarray:
        return self.flat[spread(self.start[ids], self.size[ids])]


_models: dict[str, Merges] = {}


def merges(path: str) -> Merges:
    """The vocabulary, once to a worker."""
    if path not in _models:
        _models[path] = Merges(path)
    return _models[path]


def segment(model: Merges, units: list[str], codes: np.ndarray, keys: np.ndarray, rate: float, wide: int = WIDE) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all occurrences one after another, and the number of each one's. codes: the unit of each; keys: of its draws."""
    if not len(codes):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    limit = min(_MASK, int(rate * (1 << 64)))
    chars = model.char[np.frombuffer("".join(units).encode("utf-32-le"), np.uint32)]
    size = np.array([len(u) for u in units], np.int64)
    start = np.cumsum(size) - size
    value = model.join(chars, np.r_[chars[1:], -1])
    value[start + size - 1] = NONE
    order = np.argsort(size[codes], kind="stable")
    width = size[codes[order]]
    parts, counts = [], []
    for a in _steps(width):
        own, w = order[a], int(width[a.start])
        if w <= wide:
            at = start[codes[own]][:, None] + np.arange(w)
            left, n = model.matrix(chars[at], value[at], keys[own], limit)
        else:
            found = [model.one(chars[start[codes[i]] : start[codes[i]] + w].tolist(), int(keys[i]), limit) for i in own]
            left, n = np.array([x for f in found for x in f], np.int64), np.array([len(f) for f in found], np.int64)
        left, n = model.spelled(left, n)
        parts.append(left.astype(np.int32))
        counts.append(n)
    n = np.concatenate(counts)
    length, at = np.zeros(len(codes), np.int64), np.zeros(len(codes), np.int64)
    length[order], at[order] = n, np.cumsum(n) - n
    return np.concatenate(parts)[spread(at, length)], length


def _steps(width: np.ndarray) -> Iterator[slice]:
    """Runs of equal widths (sorted), of about HELD symbols."""
    cuts = np.r_[0, np.flatnonzero(np.diff(width)) + 1, len(width)]
    for a, b in zip(cuts, cuts[1:], strict=False):
        step = max(1, HELD // max(1, int(width[a]))) if b > a else 1
        for i in range(a, b, step):
            yield slice(i, min(i + step, b))


def units_of(texts: pa.Array) -> Words:
    """Units of each text with a space put first, as Words over its bytes."""
    data, offsets = raw(texts)
    n = np.diff(offsets)
    put = (offsets[:-1] + np.arange(len(n)))[n > 0]  # where the space goes
    whole = np.full(len(data) + len(put), SPACE, np.uint8)
    rest = np.ones(len(whole), bool)
    moved = offsets + np.r_[0, np.cumsum(n > 0)]
    put = moved[:-1][n > 0]
    rest[put] = False
    whole[rest] = data
    space, other = whole == SPACE, (whole >= 9) & (whole <= 13)
    begin = np.zeros(len(whole) + 1, bool)
    begin[put] = True
    if len(whole):
        begin[1:-1] |= (space[1:] & ~space[:-1]) | other[1:] | other[:-1]
    start = np.flatnonzero(begin[:-1])
    return Words(whole, moved, start, np.r_[start[1:], len(whole)][: len(start)], np.searchsorted(start, moved))


def encode(docs: DataFrame, model: str, rate: float = 0.1, seed: int = 0) -> DataFrame:
    """doc_id, text and ids of each row of docs (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = merges(model)
        for part in slices(batches, "text"):
            w = units_of(part.column("text"))
            codes, first = distinct(w.hashes())
            doc = pc.fill_null(part.column("doc_id"), 0).to_numpy()[w.doc]
            keys = occurrence_keys(doc, np.arange(len(codes)) - w.first[w.doc], seed)
            flat, size = segment(vocabulary, [w.text(i).decode() for i in first], codes, keys, rate)
            ends = np.r_[0, np.cumsum(size)][w.first].astype(np.int32)
            null = part.column("text").is_null()
            column = pa.ListArray.from_arrays(pa.array(ends), pa.array(flat), mask=null if null.true_count else None)
            yield pa.record_batch({"doc_id": part.column("doc_id"), "text": part.column("text").cast(pa.string()), "ids": column})

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, text string, ids array<int>")


def decode(encoded: DataFrame, model: str) -> DataFrame:
    """encoded (doc_id, ids, more) with a column `decoded`, the text of ids."""
    kind = T.StructType([*encoded.schema.fields, T.StructField("decoded", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = merges(model)
        for part in slices(batches, "ids"):
            ids = part.column("ids")
            ends = ids.offsets.to_numpy()
            values = ids.values.to_numpy()[ends[0] : ends[-1]]
            data, at = vocabulary.text_bytes(values), np.r_[0, np.cumsum(vocabulary.size[values])][ends - ends[0]]
            out = [data[a + 1 : b].tobytes().decode() if ok else None for a, b, ok in zip(at, at[1:], ids.is_valid().to_pylist(), strict=False)]
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(out, pa.string())], names=[*part.schema.names, "decoded"])

    return encoded.mapInArrow(run, kind)
