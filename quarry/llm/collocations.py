"""Phrases of 2 to 4 words that hold together, mined from count streams in prefix and suffix order.

Counting: one pass over the texts for each length. A phrase that is found LEAST times has only parts that are, so
the pass for a length counts those places only whose two phrases of one word less are in the filter of frequent ones (see bitset: of fixed size, it
lets all members through; the exact counts then decide). Each block of text gives a row for each distinct phrase, summed before the shuffle.

Streams: the frequent phrases of all lengths, sorted by their words, are the prefix stream; sorted by their words from
the last to the first, the suffix stream. There every phrase follows its own prefix (suffix) and stands before all its
extensions, so one pass in lockstep with the path of open prefixes gives each phrase the counts of all its first (last) parts
and the count of its most frequent extension. The stream is cut into ranges of equal size, even inside of one prefix: what a range
begins with lacks at most 3 prefixes, whose counts are looked up afterwards for each range. A merge join brings both streams together.
The extension by one word is at least as frequent as any longer phrase around it, so it decides alone.

Rows: null text is empty, null lang is `und`. Repeated rows count each time. Extra columns are ignored. A
language without phrases has no row; an empty table gives an empty table. Texts of any length are read in blocks that end where pieces do.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast, TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from quarry.llm.bitset import BITS, bitset, passes
from quarry.llm.scratch import Scratch
from quarry.llm.words import SLICE, Words, but, distinct, lowered, mix, raw, slices, split, strings, windows

LEAST, LONGEST, TOP, COVERED = 30, 4, 2000, 80
_STOPS = ~but(*[(ord(c), ord(c)) for c in ".,;:!?"], (0x0A, 0x0D))
_WORD = but((0x20, 0x20), (0x09, 0x09)) & ~_STOPS
_SORTED = "lang string, words array<string>, f long, parts array<long>, longer long, range int"


def _blocks(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(bytes, offsets, number of each text) of blocks; a single long text is cut at the ends of pieces."""
    if len(data) <= 2 * SLICE or len(offsets) > 2:
        yield data, offsets, np.arange(len(offsets) - 1)
        return
    at = 0
    while at < len(data):
        end = min(at + SLICE, len(data))
        while end < len(data) and not _STOPS[data[end]]:
            stop = np.flatnonzero(_STOPS[data[end : end + SLICE]])
            end = end + int(stop[0]) if len(stop) else min(end + SLICE, len(data))
        yield data[at:end], np.array([0, end - at]), np.zeros(1, np.int64)
        at = end


def pieces(data: np.ndarray, offsets: np.ndarray) -> tuple[Words, np.ndarray]:
    """Words whose `first` is by piece instead of by text, and the text of each word."""
    w = split(data, offsets, _WORD)
    doc = w.doc
    stops = np.zeros(len(data) + 1, np.int64)
    np.cumsum(_STOPS[data], out=stops[1:])
    piece = stops[w.start] + doc  # both only rise, so that equal sums are of one piece
    first = np.concatenate([np.zeros(min(len(piece), 1), np.int64), np.flatnonzero(np.diff(piece)) + 1, [len(piece)]])
    return Words(w.data, w.offsets, w.start, w.end, first), doc


def _keys(hashes: np.ndarray, w: Words, n: int, salt: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of each phrase of n words with its language, and its first word. salt: the language's hash for each word."""
    values, at = windows(hashes, w, n)
    return mix(values + salt[at]), at


def _counts(docs: DataFrame, n: int, frequent: Broadcast | None) -> DataFrame:
    """lang, phrase, f: phrases of n words by block of text, not yet summed up. For n = 1 the empty phrase counts all words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            langs, salts = part.column("lang"), part.column("salt").to_numpy(zero_copy_only=False).view(np.uint64)
            for data, offsets, texts in _blocks(*raw(part.column("text"))):
                w, doc = pieces(lowered(data), offsets)
                if not len(w.start):
                    continue
                doc, hashes = texts[doc], w.hashes()
                keys, at = _keys(hashes, w, n, salts[doc])
                if frequent is not None:
                    shorter, begin = _keys(hashes, w, n - 1, salts[doc])
                    good = np.zeros(len(hashes) + 1, bool)
                    good[begin[passes(shorter, frequent.value)]] = True
                    kept = good[at] & good[at + 1]
                    keys, at = keys[kept], at[kept]
                codes, first = distinct(keys)
                at = at[first]
                phrase = pc.binary_join_element_wise(*[strings(w, at + i) for i in range(n)], " ")
                yield pa.record_batch({"lang": langs.take(pa.array(doc[at])), "phrase": phrase, "f": pa.array(np.bincount(codes, minlength=len(at)))})
                if n == 1:
                    all_words = pa.table({"lang": langs.take(pa.array(np.unique(doc))), "f": np.unique(doc, return_counts=True)[1]}).group_by("lang").aggregate([("f", "sum")])
                    yield pa.record_batch({"lang": all_words["lang"].combine_chunks(), "phrase": pa.array([""] * len(all_words)), "f": all_words["f_sum"].combine_chunks()})

    return docs.mapInArrow(run, "lang string, phrase string, f long")


def _hashes(phrases: DataFrame, n: int) -> DataFrame:
    """The hashes of phrases (lang, phrase) of n words, as texts give them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "phrase"):
            w, doc = pieces(*raw(part.column("phrase")))
            keys, _ = _keys(w.hashes(), w, n, part.column("salt").to_numpy(zero_copy_only=False).view(np.uint64)[doc])
            yield pa.record_batch({"key": pa.array(keys.view(np.int64))})

    return phrases.select("phrase", F.xxhash64("lang").alias("salt")).mapInArrow(run, "key long")


def frequent_phrases(docs: DataFrame, scratch: Scratch, least: int = LEAST, longest: int = LONGEST, bits: int = BITS) -> tuple[DataFrame, DataFrame]:
    """(lang, words, f) of all phrases of up to `longest` words that are found `least` times, and (lang, n) of all words."""
    lang = F.coalesce(F.col("lang").cast("string"), F.lit("und"))
    docs = docs.select(lang.alias("lang"), F.xxhash64(lang).alias("salt"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    tables, frequent = [], None
    for n in range(1, longest + 1):
        summed = _counts(docs, n, frequent).groupBy("lang", "phrase").agg(F.sum("f").alias("f"))
        tables.append(scratch.table(summed.where((F.col("f") >= least) | (F.col("phrase") == "")), f"phrases-{n}"))
        if n < longest:
            frequent = bitset(_hashes(tables[-1].where("phrase <> ''"), n), bits)
    whole = tables[0]
    for t in tables[1:]:
        whole = whole.unionByName(t)
    return whole.where("phrase <> ''").select("lang", F.split("phrase", " ").alias("words"), "f"), tables[0].where("phrase = ''").select("lang", F.col("f").alias("n"))


def _lockstep(rows: Iterator[tuple], number: int) -> Iterator[tuple]:
    """Rows (lang, words, f) of a sorted stream as rows of _SORTED. A row with null f is a prefix that began in an earlier range."""
    path: list[list] = []  # of lang, words, f, parts, longer

    def closed(depth: int) -> Iterator[tuple]:
        while len(path) > depth:
            yield (*path.pop(), number)

    for lang, words, f in rows:
        depth = 0
        while depth < min(len(path), len(words) - 1) and path[depth][0] == lang and path[depth][1][-1] == words[depth]:
            depth += 1
        yield from closed(depth)
        while len(path) < len(words) - 1:
            path.append([lang, words[: len(path) + 1], None, [None] * len(path), None])
        if path:
            path[-1][4] = max(f, path[-1][4] or 0)
        path.append([lang, words, f, [p[2] for p in path], None])
    yield from closed(0)


def stream(phrases: DataFrame, scratch: Scratch, name: str, back: bool = False) -> DataFrame:
    """lang, words, f, parts, longer of each phrase, by one pass over the sorted phrases.

    parts: counts of its first 1, 2, ... words (last ones, if back) but itself; longer: the count of its most frequent
    extension by one word at the end (at the beginning, if back), or null.
    """
    kind = pa.schema([("lang", pa.string()), ("words", pa.list_(pa.string())), ("f", pa.int64()), ("parts", pa.list_(pa.int64())), ("longer", pa.int64()), ("range", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (r for b in batches for r in zip(*[b.column(c).to_pylist() for c in ("lang", "words", "f")], strict=True))
        out: list[tuple] = []
        for r in _lockstep(rows, TaskContext.get().partitionId()):
            out.append(r)
            if len(out) == 10_000:
                yield pa.record_batch([pa.array(c, t.type) for c, t in zip(zip(*out, strict=True), kind, strict=True)], schema=kind)
                out = []
        if out:
            yield pa.record_batch([pa.array(c, t.type) for c, t in zip(zip(*out, strict=True), kind, strict=True)], schema=kind)

    ordered = phrases.withColumn("words", F.reverse("words")) if back else phrases
    done = scratch.table(ordered.repartitionByRange("lang", "words").sortWithinPartitions("lang", "words").mapInArrow(run, _SORTED), name)
    # at most LONGEST - 1 open prefixes for each range
    opened = done.where("f is null").select("lang", "words", "longer", "range")
    counts = opened.select("lang", "words", "range").join(done.where("f is not null").select("lang", "words", "f"), ["lang", "words"])
    by_range = counts.groupBy("range").agg(F.map_from_entries(F.collect_list(F.struct(F.size("words"), "f"))).alias("before"))
    more = opened.groupBy("lang", "words").agg(F.max("longer").alias("more"))
    filled = F.transform("parts", lambda x, i: F.coalesce(x, F.col("before")[i + 1]))
    joined = done.where("f is not null").join(F.broadcast(by_range), "range", "left").join(F.broadcast(more), ["lang", "words"], "left")
    whole = joined.select("lang", "words", "f", filled.alias("parts"), F.greatest("longer", "more").alias("longer"))
    return whole.withColumn("words", F.reverse("words")) if back else whole


def collocations(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, top: int = TOP, bits: int = BITS) -> DataFrame:
    """lang, rank, words, phrase, a, l, r, n, score, cut (words before it): each language's `top` phrases that are no part of a longer one."""
    scratch = Scratch(docs.sparkSession)
    phrases, totals = frequent_phrases(docs, scratch, least, longest, bits)
    left = stream(phrases, scratch, "prefix").where(F.size("words") > 1)
    right = stream(phrases, scratch, "suffix", back=True).where(F.size("words") > 1)
    both = left.hint("merge").join(right.select("lang", "words", F.col("parts").alias("ends"), F.col("longer").alias("before")), ["lang", "words"])
    wide = lambda c: c.cast("decimal(38,0)")
    kept = both.where(F.coalesce(100 * wide(F.greatest("longer", "before")) < COVERED * wide(F.col("f")), F.lit(True)))
    cuts = F.expr("""array_min(transform(sequence(1, size(words) - 1), k -> named_struct('score', cast(2000000 as decimal(8,0)) * cast(f as decimal(20,0))
      div (cast(parts[k - 1] as decimal(20,0)) + cast(ends[size(words) - k - 1] as decimal(20,0))), 'k', k, 'l', parts[k - 1], 'r', ends[size(words) - k - 1])))""")
    scored = kept.select("lang", "words", F.array_join("words", " ").alias("phrase"), F.col("f").alias("a"), cuts.alias("c")).select("lang", "words", "phrase", "a", "c.l", "c.r", "c.score", F.col("c.k").alias("cut"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase"))
    ranked = scored.withColumn("rank", rank).where(F.col("rank") <= top)
    return ranked.join(totals, "lang").select("lang", F.col("rank").cast("long"), "words", "phrase", "a", "l", "r", "n", F.col("score").cast("long"), "cut")
