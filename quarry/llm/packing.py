"""Mixture-controlled packing by deficit round-robin over source queues.

Each source is a queue of tokens, and each window of WINDOW tokens takes from every queue its target share.
A queue's share of a window is rarely a whole number; what it is owed is carried to the next window. As the
carry depends only on the number of windows before, what all queues have given before window w is known in
closed form, floor(w * WINDOW * target) by cumulative targets, and no window has to wait for another: deficits
carry across windows and partitions without a sequential pass. Only the last window is not full.

Queue positions come from counts: each task numbers the tokens of each of its queues, and a prefix sum over
tasks, which are few, gives where they begin. By default targets are the queues' own token shares, so that
all end together. With other targets, queues that run dry drop out and the rest go on in proportion.

Sources whose share of a window would be under LEAST tokens form one queue; so at most WINDOW / LEAST queues
are known to the driver. In that queue documents go by the part of their source's tokens that lies before their middle, so that
each of these sources, however many there are, is spread evenly, to within a document. Documents are cut freely.

Rows: null text is empty and has the end id alone; null source is a source. Repeated rows are packed each.
Extra columns are ignored. An empty table has no piece.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from quarry.llm.scratch import Scratch
from quarry.llm.words import distinct, slices, spread, words

WINDOW, END_ID, LEAST = 2048, 1, 16
#: Documents that are cut at a time.
ROWS = 1_000


class WordBpe:
    """The ids of a lower-case word-end BPE vocabulary for single words.

    Words of plain letters, digits and signs are joined into one string and merged in bulk by byte-pair ranks, with
    byte 0 as the mark of a word's end; all others go to the tokeniser itself.
    """

    #: The vocabulary's own split pattern, for ASCII and Latin-1 characters after lower-casing.
    SPLIT = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^\sa-zß-öø-ÿ0-9]+")
    PLAIN = re.compile(r"[!-~¡-©«¬®-±´¶-¸»¿-ÿ]+")

    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.whole.encode_special_tokens = True
        with open(path, encoding="utf-8") as f:
            vocabulary = json.load(f)["model"]["vocab"]
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that stand for themselves in the file; the others follow from 256 on
        byte = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(shown))}
        ranks = {}
        for token, i in vocabulary.items():
            core, end = token.removesuffix("</w>"), token.endswith("</w>")
            if all(c in byte for c in core):
                ranks.setdefault(bytes(byte[c] for c in core) + b"\0" * end, i)
        self.fast = tiktoken.Encoding("words", pat_str=r"[^\x00]*\x00", mergeable_ranks=ranks, special_tokens={})
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        self.size = len(self.ends)

    def ids(self, found: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids one after another, and the number of each word's."""
        plain = np.array([self.PLAIN.fullmatch(x) is not None for x in found], bool)
        parts, count = [], []
        for x, ok in zip(found, plain, strict=True):
            if ok:
                x = x.lower()
                mine = [x] if x.isalpha() else self.SPLIT.findall(x)
                parts += mine
                count.append(len(mine))
        flat = np.array(self.fast.encode_ordinary("\0".join([*parts, ""])), np.int64)
        stop = np.flatnonzero(self.ends[flat]) + 1
        cut = np.r_[0, stop][np.r_[0, np.cumsum(count)].astype(np.int64)]
        size = np.zeros(len(found), np.int64)
        size[plain] = np.diff(cut)
        rest = [e.ids for e in self.whole.encode_batch([x for x, ok in zip(found, plain, strict=True) if not ok], add_special_tokens=False)]
        size[~plain] = [len(x) for x in rest]
        out = np.zeros(size.sum(), np.int64)
        start = np.cumsum(size) - size
        out[spread(start[plain], size[plain])] = flat
        out[spread(start[~plain], size[~plain])] = [i for x in rest for i in x]
        return out, size


_models: dict[str, WordBpe] = {}


def _tokeniser(path: str) -> WordBpe:
    """The tokeniser, once to a worker."""
    if path not in _models:
        _models[path] = WordBpe(path)
    return _models[path]


def tokenise(docs: DataFrame, tokenizer: str) -> DataFrame:
    """part, queue, small, doc_id, n, at, ids: each row's ids with the end id, and its place among its task's tokens of that queue and small source."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, part, given = _tokeniser(tokenizer), TaskContext.get().partitionId(), {}
        for rows in slices(batches, "text", 4_000_000):
            w = words(rows.column("text"))
            codes, first = distinct(w.hashes())
            flat, size = bpe.ids([w.text(i).decode() for i in first])
            start = np.cumsum(size) - size
            flat, start, size = np.r_[flat, END_ID], np.r_[start, len(flat)], np.r_[size, 1]  # the end id as one more word
            codes = np.insert(codes, w.first[1:], len(size) - 1)
            ids = flat[spread(start[codes], size[codes])].astype("<u4" if bpe.size > 65_536 else "<u2")
            ends = np.r_[0, np.cumsum(size[codes])][w.first + np.arange(len(w.first))]
            queues, n, at = zip(rows.column("queue").to_pylist(), rows.column("small").to_pylist(), strict=True), np.diff(ends), []
            for q, k in zip(queues, n.tolist(), strict=True):
                at.append(given.get(q, 0))
                given[q] = at[-1] + k
            yield pa.record_batch({
                "part": pa.array(np.full(len(n), part, np.int64)), "queue": rows.column("queue"), "small": rows.column("small"), "doc_id": rows.column("doc_id"), "n": pa.array(n), "at": pa.array(at, pa.int64()),
                "ids": pa.array([ids[a:b].tobytes() for a, b in zip(ends, ends[1:], strict=False)], pa.binary()),
            })

    return docs.mapInArrow(run, "part long, queue int, small string, doc_id long, n long, at long, ids binary")


def _spread(rows: DataFrame, lot: int = 100_000) -> DataFrame:
    """part, small, at, start of documents (part, small, at, n, begin) of small sources: their places in the queue of all of them.

    Documents are sorted by how much of their source lies before their middle, in ranges of about `lot`, and the tokens of the ranges before are added.
    """
    totals = rows.groupBy("small").agg(F.sum("n").alias("total"))
    ranges = rows.count() // lot + 1
    along = rows.join(totals, "small").withColumn("share", (F.col("begin") + F.col("at") + F.col("n") / 2) / F.col("total")).withColumn("range", F.floor(F.col("share") * ranges))
    before = along.groupBy("range").agg(F.sum("n").alias("m")).withColumn("first", F.sum("m").over(Window.partitionBy().orderBy("range")) - F.col("m"))  # a row to a range
    within = F.sum("n").over(Window.partitionBy("range").orderBy("share", "small", "part", "at").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("n")
    return along.withColumn("within", within).join(before, "range").select("part", "small", "at", (F.col("first") + F.col("within")).alias("start"))


class Mixture:
    """What queues have given when g tokens are packed. sizes: tokens of each queue; targets: shares, by default the sizes."""

    def __init__(self, sizes: list[int], targets: list[int] | None = None):
        self.total, left, given = sum(sizes), list(sizes), 0
        self.phases = []  # first token, what the queues before each one have given by then, cumulative weights
        while given < self.total:
            weights = [(t if n else 0) for t, n in zip(targets or left, left, strict=True)]
            if not sum(weights):
                weights = left
            whole = sum(weights)
            if weights == left:
                step = whole
            else:
                step = min((n - 1) * whole // t for n, t in zip(left, weights, strict=True) if t)
                if step <= 0:  # a queue at its last token gives it alone
                    q = min((q for q, t in enumerate(weights) if t), key=lambda q: Fraction(left[q], weights[q]))
                    weights = [int(i == q) for i in range(len(left))]
                    whole, step = 1, left[q]
            before = [sum(s - x for s, x in zip(sizes[:q], left[:q], strict=True)) for q in range(len(sizes) + 1)]
            cumulative = [sum(weights[:q]) for q in range(len(sizes) + 1)]
            self.phases.append((given, before, cumulative, whole))
            bounds = [b + step * c // whole for b, c in zip(before, cumulative, strict=True)]
            left = [s - (bounds[q + 1] - bounds[q]) for q, s in enumerate(sizes)]
            given += step

    def before(self, queue: int, g: int) -> int:
        """Tokens that the queues before this one have given among the first g."""
        g = min(g, self.total)
        first, before, cumulative, whole = next(p for p in reversed(self.phases) if p[0] <= g)
        return before[queue] + (g - first) * cumulative[queue] // whole

    def given(self, queue: int, window: int) -> int:
        return self.before(queue + 1, window * WINDOW) - self.before(queue, window * WINDOW)

    def window_of(self, queue: int, at: int) -> int:
        """The window that takes token `at` of the queue."""
        low, high = 0, -(-self.total // WINDOW)
        while high - low > 1:
            mid = (low + high) // 2
            low, high = (mid, high) if self.given(queue, mid) <= at else (low, mid)
        return low


def pack(docs: DataFrame, tokenizer: str, targets: dict[str, float] | None = None, with_ids: bool = True) -> DataFrame:
    """Pieces of all rows of docs (doc_id, text, source): doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset and, with_ids, ids.

    targets: weights of sources in each window; sources it doesn't name share what it leaves, or go last.
    """
    spark, scratch = docs.sparkSession, Scratch(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long"), "text", F.coalesce(F.col("source").cast("string"), F.lit("")).alias("source"))
    sizes = docs.groupBy("source").agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + 1).alias("bytes"))
    total = sizes.agg(F.sum("bytes")).first()[0] or 1
    # LEAST tokens of a window or more each, so these are at most WINDOW / LEAST
    known = sorted(r.source for r in sizes.where(F.col("bytes") * WINDOW >= LEAST * total).collect())
    known = sorted({*known, *(targets or {})})
    some_small = not sizes.where(~F.col("source").isin(*known)).isEmpty()
    queue = F.lit(len(known))
    for i, name in enumerate(known):
        queue = F.when(F.col("source") == name, i).otherwise(queue)
    small = F.when(queue == len(known), F.col("source")).otherwise("")
    tokens = scratch.table(tokenise(docs.select("doc_id", "text", queue.cast("int").alias("queue"), small.alias("small")), tokenizer), "tokens")
    counts = scratch.table(tokens.groupBy("part", "queue", "small").agg(F.sum("n").alias("n")), "counts")
    order = Window.partitionBy("queue", "small").orderBy("part")
    begins = counts.select("part", "queue", "small", (F.sum("n").over(order) - F.col("n")).alias("begin"))
    found = {r.queue: r.n for r in counts.groupBy("queue").agg(F.sum("n").alias("n")).collect()}
    lengths = [found.get(q, 0) for q in range(len(known) + 1)]
    weights = None if targets is None else [int(1e6 * targets.get(name, 0)) for name in known] + [max(0, int(1e6 * (1 - sum(targets.values()))))]
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    mixture = spark.sparkContext.broadcast(Mixture(lengths, weights))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mix = mixture.value
        for rows in (b.slice(i, ROWS) for b in batches for i in range(0, b.num_rows, ROWS)):
            out = []
            for doc_id, q, n, at, begin, ids in zip(*(rows.column(c).to_pylist() for c in ("doc_id", "queue", "n", "at", "begin", "ids")), strict=True):
                ids = np.frombuffer(ids, "<u4" if len(ids) == 4 * n else "<u2").astype("<u4")
                at, done = at + begin, 0
                window = mix.window_of(q, at)
                first, stop = mix.given(q, window), mix.given(q, window + 1)
                while done < n:
                    while stop <= at + done:
                        window, first = window + 1, stop
                        stop = mix.given(q, window + 1)
                    length = min(n - done, stop - at - done)
                    offset = mix.before(q, (window + 1) * WINDOW) - mix.before(q, window * WINDOW) + at + done - first
                    piece = ids[done : done + length]
                    out.append((doc_id, done, length, zlib.crc32(piece.tobytes()), n, window, offset, piece))
                    done += length
            if out:
                *cols, pieces = zip(*out, strict=True)
                found = [pa.array(c, pa.int64()) for c in cols]
                if not with_ids:
                    yield pa.RecordBatch.from_arrays(found, names=names)
                    continue
                lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(cols[2])].astype(np.int32)), pa.array(np.concatenate(pieces).astype(np.int32)))
                yield pa.RecordBatch.from_arrays([*found, lists], names=[*names, "ids"])

    placed = tokens.join(begins, ["part", "queue", "small"])
    if some_small:
        own = placed.where(F.col("queue") == len(known))
        starts = scratch.table(_spread(own.select("part", "small", "at", "n", "begin")), "starts")
        placed = placed.where(F.col("queue") < len(known)).unionByName(own.join(starts, ["part", "small", "at"]).withColumns({"at": F.lit(0).cast("long"), "begin": F.col("start")}).drop("start"))
    placed = placed.select("doc_id", "queue", "n", "at", "begin", "ids")
    return placed.mapInArrow(run, ", ".join(f"{x} long" for x in names) + ", ids array<int>" * with_ids)
