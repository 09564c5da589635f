"""Quality classifier: perplexity under an interpolated modified Kneser-Ney trigram model of trusted text.

The VOCABULARY most frequent words of trusted text are tokens of their own. Every other word, seen or new, is told in two steps: the shape of its
letters, digits and signs is a token, predicted in its context, and then its bytes are spelled to the end of the word, each after the two before it, the
first ones after the shape (counts of all such words of trusted text, interpolated by Witten and Bell). So each word has a probability of its own, and those of all words sum to 1.
`perplexities` has it stand by its shape as context of the words after it; the verdict does not: after two words of which one is outside of the vocabulary, counts of what
follows these very words (by Witten and Bell, over the trigram of shapes) decide, however rare they are, so that no context is merged with another but by a hash of 48 bits.
Perplexity is that of all symbols: tokens, bytes and ends of spelled words. Trusted text is that of all documents labelled good and not toxic.
Trigrams are counted and kept in shards by the hash of their first two words, so that a shard has all of a context. Each chunk of
texts (a run of a task's input) sends its distinct trigrams to the shards as sorted lists, which are merged there; continuation counts of
word pairs are an aggregate over the shards. To score, each chunk asks the shards for its trigrams, pairs and tokens after words in the same way, all chunks
of a lot in one join, and what the shards hold goes back to the chunks that asked. There are LOTS of rows, by a hash of id and text; each is tokenised anew, and its tokens, questions and
answers go before the next begins, so that disk holds the counts and a lot at a time. Only what is by single word, VOCABULARY rows at most, the hashes of BOOK more words and the counts of three
bytes in a row (valid UTF-8 has below 2 ** 23 such, at 16 bytes each; counted texts some 10 ** 5) are known everywhere. A document is rejected if its perplexity lies outside the quantiles LOW and HIGH of its language's trusted
documents. Text that was counted is easier to predict than new text, and the more so the less there is, so one of HELD_OUT
trusted documents, by the hash of its id, is not counted but only scored; the band goes from the lesser of the low
quantiles of both groups to the greater of the high ones. Each is drawn towards that of all languages, which counts as PRIOR
documents more, so that a language with few trusted documents, or none, has a band, too. Too low is as telling as too high: repeated or
listed words are easy to predict.

Rows: null text, and text without a word, have no perplexity and are rejected. Null lang is a language of its own. Rows that
share a doc_id are judged each by its own text. Labels may be missing, repeated (any bad label counts) or null; without any
trusted document, every document with a word is kept. Extra columns are ignored by `perplexities` and kept by `keep_good`.
"""

from __future__ import annotations

import functools
import sys
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from quarry.llm.scratch import Scratch, brief_shuffles
from quarry.llm.words import Words, distinct, mix, slices, spread, words

VOCABULARY = 2_000
LOW, HIGH, PRIOR, HELD_OUT = 0.002, 0.995, 30, 8
SHAPES = 16
BITS = 12
BEGIN, PAIR = (1 << BITS) - 1, (1 << 2 * BITS) - 1
SLICE_BYTES, SLICES = 2_500_000, 8
_SQUEEZER, _LIGHT, _UNSQUEEZER = zstandard.ZstdCompressor(level=3), zstandard.ZstdCompressor(level=1), zstandard.ZstdDecompressor()
_MARK = np.zeros(256, bool)
_MARK[list(b".,;:")] = True
#: Tokens that are looked at together; trigrams of a shard, at most, on average; keys that a shard is asked for at a time.
HELD, SHARD, ASKED = 250_000, 2_000_000, 4_000_000
#: Lots of rows that are scored one after another; less text than LOT bytes is one lot. Their number does not grow with the input, as each asks all counts. Bytes of text to a word, about.
LOTS, LOT, WORD = 6, 1 << 26, 8
#: Bytes of text to a shard of its words' counts.
VOCABULARY_SHARD = 1 << 28
LISTS = "shard int, keys binary, n binary"
#: Symbols of a spelled word: its bytes, END, and its shape from START on; bits of a symbol; shards of their counts.
END, START, SYMBOL, SPELLED = 256, 257, 9, 64
#: Keys of word pairs begin here, those of trigrams at 0, those of tokens after two words (a hash of CONTEXT bits) at WORDS.
PAIRS, WORDS, CONTEXT = 1 << 40, 1 << 60, 48
#: Bytes of a word's hash; words after the vocabulary that are kept as numbers of 16 bits in place of it.
WORD_BYTES, BOOK = 5, (1 << 16) - 1


def shape(word: str) -> int:
    """0 to SHAPES - 1: case (none, upper, capitalised, other), whether it has a digit, whether it has a sign."""
    letters = [c for c in word if c.isalpha()]
    case = 0 if not letters else 1 if len(letters) > 1 and all(c.isupper() for c in letters) else 2 if word[0].isupper() else 3
    return case * 4 + any(c.isdigit() for c in word) * 2 + any(not c.isalnum() for c in word)


#: Of each code point: 1 a letter, 2 a letter that is no capital, 4 a digit, 8 a sign, 16 a capital; _NEW until it is first seen.
_NEW = 255
_KINDS = np.full(sys.maxunicode + 1, _NEW, np.uint8)


def shapes(w: Words, at: np.ndarray) -> np.ndarray:
    """The shape of each of these words, all side by side."""
    if not len(at):
        return np.zeros(0, np.int64)
    length = w.end[at] - w.start[at]
    data, begin = w.data[spread(w.start[at], length)], np.cumsum(length) - length
    if data.max() > 127:
        leads = (data & 0xC0) != 0x80
        begin, data = (np.cumsum(leads) - leads)[begin], np.frombuffer(data.tobytes().decode().encode("utf-32-le"), "<u4")
    kinds = _KINDS[data]
    if (kinds == _NEW).any():
        for c in np.unique(data[kinds == _NEW]).tolist():
            x = chr(c)
            _KINDS[c] = x.isalpha() + 2 * (x.isalpha() and not x.isupper()) + 4 * x.isdigit() + 8 * (not x.isalnum()) + 16 * x.isupper()
        kinds = _KINDS[data]
    has, letters = np.bitwise_or.reduceat(kinds, begin), np.add.reduceat((kinds & 1).astype(np.int64), begin)
    case = np.select([letters == 0, (letters > 1) & (has & 2 == 0), kinds[begin] & 16 > 0], [0, 1, 2], 3)
    return case * 4 + (has & 4 > 0) * 2 + (has & 8 > 0)


def cores(w: Words) -> Words:
    """The words without commas, stops, colons and semicolons at their ends, unless they are nothing else."""
    end = w.end.copy()
    while True:
        mark = (end > w.start) & _MARK[w.data[end - 1]] if len(end) else np.zeros(0, bool)
        if not mark.any():
            return replace(w, end=np.where(end > w.start, end, w.end))
        end[mark] -= 1


def trusted_ids(labels: DataFrame) -> DataFrame:
    """doc_id of documents that all their labels call good."""
    return labels.where("doc_id is not null").groupBy("doc_id").agg(F.min("quality").alias("q"), F.max(F.coalesce("toxic", F.lit(0))).alias("t")).where("q = 1 and t = 0").select("doc_id")


def squeeze(values: np.ndarray) -> bytes:
    """Numbers compressed byte by byte: first the low bytes of all, then the next."""
    return _SQUEEZER.compress(values.view(np.uint8).reshape(-1, values.itemsize).T.tobytes())


def unsqueeze(data: bytes, kind: str) -> np.ndarray:
    return np.frombuffer(_UNSQUEEZER.decompress(data), np.uint8).reshape(np.dtype(kind).itemsize, -1).T.copy().view(kind).ravel()


def press(hashes: np.ndarray) -> bytes:
    """Rows of bytes compressed as they are, so that equal rows are found."""
    return _LIGHT.compress(np.ascontiguousarray(hashes).tobytes())


def pack(keys: np.ndarray) -> bytes:
    """Sorted distinct numbers as their steps."""
    return squeeze(np.diff(keys, prepend=0).astype("<u8"))


def unpack(data: bytes) -> np.ndarray:
    return np.cumsum(unsqueeze(data, "<u8").astype(np.int64))


def _coded(batches: Iterator[pa.RecordBatch], vocabulary: np.ndarray) -> Iterator[tuple[pa.RecordBatch, Words, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Slices with their words, the number of each one's distinct word, the token of each distinct word, and those outside of the vocabulary: their numbers, where they first are, and their hashes."""
    order = np.argsort(vocabulary)
    known = vocabulary[order]
    for part in slices(batches, "text", SLICE_BYTES):
        w = cores(words(part.column("text")))
        hashes = w.hashes()
        codes, first = distinct(hashes)
        at = np.minimum(np.searchsorted(known, hashes[first]), len(known) - 1)
        ids = np.where(known[at] == hashes[first], order[at], -1)
        rare = np.flatnonzero(ids < 0)
        ids[rare] = VOCABULARY + shapes(w, first[rare])
        yield part, w, codes, ids, rare, first[rare], hashes[first[rare]]


def spelled(w: Words, at: np.ndarray, shapes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each symbol of these words with the two before it, as one number, and the place in `at` of its word."""
    length = w.end[at] - w.start[at]
    size = length + 3
    begin = np.cumsum(size) - size
    x = np.full(size.sum(), END, np.int64)
    x[begin] = x[begin + 1] = START + shapes
    x[spread(begin + 2, length)] = w.data[spread(w.start[at], length)]
    ends = spread(begin + 2, length + 1)
    return (x[ends - 2] << 2 * SYMBOL) | (x[ends - 1] << SYMBOL) | x[ends], np.repeat(np.arange(len(at)), length + 1)


@dataclass
class Spelling:
    """keys, a: symbols after two others and their share of the counts; weight: what two symbols give to what is known by the last one; low: that, of a symbol after another."""

    keys: np.ndarray
    a: np.ndarray
    weight: np.ndarray
    low: np.ndarray

    def p(self, keys: np.ndarray) -> np.ndarray:
        place = np.searchsorted(self.keys, keys)
        place[place == len(self.keys)] = 0
        own = np.where(self.keys[place] == keys, self.a[place], 0) if len(self.keys) else 0
        return own + self.weight[keys >> SYMBOL] * self.low[keys & ((1 << 2 * SYMBOL) - 1)]


def spelling_of(keys: np.ndarray, n: np.ndarray) -> Spelling:
    """From the counts of sorted keys. Each order leaves to the one below it as much as it has different symbols; the lowest takes all symbols as equally likely."""
    size = 1 << SYMBOL
    one = np.bincount(keys & (size - 1), n, size)
    low = np.where(np.arange(size) <= END, (one + max((one > 0).sum(), 1) / (END + 1)) / (one.sum() + max((one > 0).sum(), 1)), 0)
    two = np.bincount(keys & (size * size - 1), n, size * size).reshape(size, size)
    kinds = np.maximum((two > 0).sum(1), 1)[:, None]
    low = (two + kinds * low) / (two.sum(1)[:, None] + kinds)
    context = keys >> SYMBOL
    total, kinds = np.bincount(context, n, size * size), np.maximum(np.bincount(context, minlength=size * size), 1)
    return Spelling(keys, n / (total + kinds)[context], kinds / (total + kinds), low.ravel())


def _spelling(texts: DataFrame, vocabulary) -> Spelling:
    """How the words of these texts that are outside of the vocabulary are spelled."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, count = [], []
        for _, w, codes, ids, rare, first, _ in _coded(batches, vocabulary.value):
            keys, word = spelled(w, first, ids[rare] - VOCABULARY)
            own, back = np.unique(keys, return_inverse=True)
            found.append(own)
            count.append(np.bincount(back, np.bincount(codes, minlength=len(ids))[rare][word], len(own)).astype(np.int64))
            if sum(map(len, found)) > 4 * HELD:
                found, count = ([x] for x in _merged(found, count))
        if found:
            found, n = _merged(found, count)
            yield from _dealt(found, n, shard_of(found, SPELLED))

    rows = _gathered(texts.select("text").mapInArrow(send, LISTS)).collect()  # SPELLED rows
    keys, n = (np.concatenate([np.zeros(0, np.int64), *x]) for x in ([unpack(r["keys"]) for r in rows], [unsqueeze(r["n"], "<i8") for r in rows]))
    order = np.argsort(keys)
    return spelling_of(keys[order], n[order])


def _numbers(hashes: np.ndarray, book: np.ndarray) -> np.ndarray:
    """The place of each word in the book, from 1, or 0."""
    if not len(book):
        return np.zeros(len(hashes), np.int64)
    order = np.argsort(book)
    at = order[np.minimum(np.searchsorted(book[order], hashes), len(book) - 1)]
    return np.where(book[at] == hashes, at + 1, 0)


def _tokens(docs: DataFrame, vocabulary, book, spelling) -> DataFrame:
    """chunk, doc_id, lang, digest (of the text), n_tokens, tokens (16-bit numbers), rare (numbers in the book of its words outside of the vocabulary, 0 for none), other (hashes of those with none), symbols (tokens and those of spelled words), spelling (nats of the latter; without the counts of spelling, 0) of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for k, (part, w, codes, ids, rare, first, hashes) in enumerate(_coded(batches, vocabulary.value)):
            size, cost = np.ones(len(ids)), np.zeros(len(ids))
            if spelling is not None:
                keys, word = spelled(w, first, ids[rare] - VOCABULARY)
                size[rare] += np.bincount(word, minlength=len(rare))
                cost[rare] = -np.bincount(word, np.log(spelling.value.p(keys)), len(rare))
            symbols, nats = (np.bincount(w.doc, x[codes], part.num_rows) for x in (size, cost))
            own, number = np.zeros((len(ids), 8), np.uint8), np.zeros(len(ids), "<u2")
            own[rare], number[rare] = hashes.astype("<u8").view(np.uint8).reshape(-1, 8), _numbers(hashes, book.value)
            at = np.flatnonzero(ids[codes] >= VOCABULARY)
            number = number[codes[at]]
            none = at[number == 0]
            own, (cut, left) = own[codes[none], :WORD_BYTES], (np.searchsorted(x, w.first) for x in (at, none))
            ids = ids[codes].astype("<u2")
            chunk = (TaskContext.get().partitionId() << 20) + k // SLICES
            yield pa.record_batch({"chunk": pa.array(np.full(part.num_rows, chunk)), "doc_id": part.column("doc_id"), "lang": part.column("lang"), "digest": part.column("digest"), "n_tokens": pa.array(w.counts, pa.int64()), "tokens": pa.array([squeeze(ids[a:b]) for a, b in zip(w.first, w.first[1:], strict=False)], pa.binary()), "rare": pa.array([squeeze(number[a:b]) for a, b in zip(cut, cut[1:], strict=False)], pa.binary()), "other": pa.array([press(own[a:b]) for a, b in zip(left, left[1:], strict=False)], pa.binary()), "symbols": pa.array(symbols.astype(np.int64)), "spelling": pa.array(nats.astype(np.float64))})

    return docs.select(F.col("doc_id").cast("long"), "text", F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.xxhash64("text").alias("digest")).mapInArrow(run, "chunk long, doc_id long, lang string, digest long, n_tokens long, tokens binary, rare binary, other binary, symbols long, spelling double")


def held(tokens: list[bytes], rare: list[bytes] | None = None, other: list[bytes] | None = None) -> Iterator[list[tuple[int, np.ndarray]]]:
    """Rows and their tokens with the two before them, in lists of about HELD tokens; longer rows are cut. So memory follows these and not the chunk.
    With rare and other, each token of a word outside of the vocabulary has that word's number or hash above its BITS."""
    out, size = [], 0
    for row, x in enumerate(tokens):
        own = unsqueeze(x, "<u2")
        x = np.full(len(own) + 2, BEGIN, np.int64)
        x[2:] = own
        if rare is not None:
            own, number = np.frombuffer(_UNSQUEEZER.decompress(other[row]), np.uint8).reshape(-1, WORD_BYTES), unsqueeze(rare[row], "<u2").astype(np.int64) << 1
            wide = np.zeros((len(own), 8), np.uint8)
            wide[:, :WORD_BYTES] = own
            number[number == 0] = wide.view("<i8").ravel() << 1 | 1
            x[(x >= VOCABULARY) & (x < BEGIN)] |= number << BITS
        for at in range(0, len(x) - 2, HELD):
            out.append((row, x[at : at + HELD + 2]))
            size += len(out[-1][1])
            if size >= HELD:
                yield out
                out, size = [], 0
    if out:
        yield out


def grams(parts: list[tuple[int, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """The trigrams that end at each token but the first two of every part, and the row that each is of."""
    flat, at = _places(parts)
    flat = flat & BEGIN
    return (flat[at - 2] << 2 * BITS) | (flat[at - 1] << BITS) | flat[at], np.repeat(np.array([row for row, _ in parts]), [len(x) - 2 for _, x in parts])


def _places(parts: list[tuple[int, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """All parts one after another, and where their tokens are but for the first two of each."""
    size = np.array([len(x) for _, x in parts], np.int64)
    begin = np.cumsum(size) - size
    keep = np.ones(size.sum(), bool)
    keep[begin] = keep[begin + 1] = False
    return np.concatenate([x for _, x in parts]), np.flatnonzero(keep)


def after_words(parts: list[tuple[int, np.ndarray]]) -> np.ndarray:
    """For each trigram of grams(parts), the token after the two words themselves, as one number; 0 where both are in the vocabulary, so that the trigram has them."""
    flat, at = _places(parts)
    a, b = flat[at - 2], flat[at - 1]
    context = mix(mix(a.view(np.uint64)) + b.view(np.uint64)) >> np.uint64(64 - CONTEXT)
    return np.where((a | b) >> BITS > 0, WORDS | (context.view(np.int64) << BITS) | (flat[at] & BEGIN), 0)


def _merged(found: list[np.ndarray], count: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The distinct values of sorted arrays, and their counts together."""
    values, back = np.unique(np.concatenate(found), return_inverse=True)
    return values, np.bincount(back, np.concatenate(count), len(values)).astype(np.int64)


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Each chunk of rows (chunk, tokens) with its distinct trigrams and their counts, and, of rows with rare, its distinct tokens after words. A chunk that is cut over batches comes in parts."""
    for part in batches:
        chunk = part.column("chunk").to_numpy()
        for c in np.unique(chunk):
            rows = part.filter(pa.array(chunk == c))
            tokens = rows.column("tokens").to_pylist()
            if "rare" in rows.schema.names:
                parts = held(tokens, rows.column("rare").to_pylist(), rows.column("other").to_pylist())
                found = (np.r_[grams(x)[0], worded[worded > 0]] for x in parts for worded in [after_words(x)])
            else:
                found = (grams(x)[0] for x in held(tokens))
            own = [np.unique(x, return_counts=True) for x in found]
            if own:
                yield c, *_merged(*zip(*own, strict=True))


def shard_of(pair: np.ndarray, shards: int) -> np.ndarray:
    return (mix(pair.view(np.uint64)) % np.uint64(shards)).astype(np.int32)


def _n_tokens(tokens: DataFrame) -> int:
    return tokens.agg(F.sum("n_tokens")).first()[0] or 0


def _dealt(found: np.ndarray, n: np.ndarray, shard: np.ndarray) -> Iterator[pa.RecordBatch]:
    for x in np.unique(shard):
        own = shard == x
        yield pa.record_batch({"shard": pa.array([x], pa.int32()), "keys": pa.array([pack(found[own])], pa.binary()), "n": pa.array([squeeze(n[own])], pa.binary())})


def _gathered(lists: DataFrame) -> DataFrame:
    """shard, keys, n: the lists (shard, keys, n) of each shard merged into one, a few at a time."""

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, found, count, size = None, [], [], 0
        for batch in batches:
            for shard, keys, n in zip(*(batch.column(c).to_pylist() for c in ("shard", "keys", "n")), strict=True):
                if found and (shard != now or size > 4 * SHARD):
                    found, count = ([x] for x in _merged(found, count))
                    size = 0
                if shard != now:
                    if found:
                        yield from _dealt(found[0], count[0], np.full(len(found[0]), now))
                    now, found, count, size = shard, [], [], 0
                found.append(unpack(keys))
                count.append(unsqueeze(n, "<i8"))
                size += len(found[-1])
        if found:
            found, n = _merged(found, count)
            yield from _dealt(found, n, np.full(len(found), now))

    return lists.repartition("shard").sortWithinPartitions("shard").mapInArrow(merge, LISTS)


def _trigrams(tokens: DataFrame, shards: int) -> DataFrame:
    """shard, keys, n: the tokens' distinct trigrams and their counts, one row to a shard."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, found, n in _chunks(batches):
            yield from _dealt(found, n, shard_of(found >> BITS, shards))

    return _gathered(tokens.select("chunk", "tokens").mapInArrow(send, LISTS))


def held_out() -> Column:
    return F.pmod(F.xxhash64(F.col("doc_id").cast("long")), F.lit(HELD_OUT)) == 0


def _vocabulary(texts: DataFrame) -> np.ndarray:
    """Hashes of the most frequent words, the most frequent first: the vocabulary and the book."""
    shards = (texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // VOCABULARY_SHARD + 1

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, count = [], []
        for part in slices(batches, "text"):
            own, n = np.unique(cores(words(part.column("text"))).hashes().view(np.int64), return_counts=True)
            found.append(own)
            count.append(n.astype(np.int64))
            if sum(map(len, found)) > 4 * HELD:
                found, count = ([x] for x in _merged(found, count))
                if len(found[0]) > 2 * HELD:
                    yield from _dealt(found[0], count[0], shard_of(found[0], shards))
                    found, count = [], []
        if found:
            found, n = _merged(found, count)
            yield from _dealt(found, n, shard_of(found, shards))

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for keys, n in zip(batch.column("keys").to_pylist(), batch.column("n").to_pylist(), strict=True):
                keys, n = unpack(keys), unsqueeze(n, "<i8")
                top = np.lexsort((keys, -n))[: VOCABULARY + BOOK]
                top = top[n[top] > 1]
                yield pa.record_batch({"word": pa.array(keys[top]), "n": pa.array(n[top])})

    counts = _gathered(texts.select("text").mapInArrow(send, LISTS)).mapInArrow(best, "word long, n long")
    return np.array([r.word for r in counts.orderBy(F.desc("n"), "word").limit(VOCABULARY + BOOK).collect()], np.int64).view(np.uint64)


def _discounts(n: list[int]) -> list[float]:
    """Chen and Goodman's three discounts from the numbers of counts 1 to 4; where those are empty, a single one."""
    if not all(n[:3]):
        return [0.5, 0.5, 0.5]
    y = n[0] / (n[0] + 2 * n[1])
    return [min(max(i - (i + 1) * y * n[i] / n[i - 1], 0.01), i - 0.01) for i in (1, 2, 3)]


def _order(counts: DataFrame, key: str, context) -> tuple[DataFrame, DataFrame]:
    """From counts (key, n) of one order: discounted probabilities (key, p) and weights of the order below (context, g)."""
    d = _discounts(list(counts.agg(*[F.count(F.when(F.col("n") == i, 1)) for i in (1, 2, 3, 4)]).first()))
    cut = F.when(F.col("n") == 1, d[0]).when(F.col("n") == 2, d[1]).otherwise(d[2])
    rows = counts.withColumn("context", context).withColumn("cut", cut)
    sums = rows.groupBy("context").agg(F.sum("n").alias("total"), F.sum("cut").alias("cuts"))
    return rows.join(sums, "context").select(key, ((F.col("n") - F.col("cut")) / F.col("total")).alias("p")), sums.select("context", (F.col("cuts") / F.col("total")).alias("g"))


@dataclass
class Model:
    """shards: shard, keys and n of its trigrams, pairs and p (discounted probabilities) of word pairs with that hash. discounts: of trigrams.
    weight: what pairs beginning with a word give to single words; single: their probability."""

    shards: DataFrame | None
    discounts: list[float]
    weight: np.ndarray
    single: np.ndarray

    def unfold(self, keys: bytes | None, n: bytes | None, pairs: bytes | None, p: bytes | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """key, a, b of a shard: of each trigram its discounted probability as a, of each word pair its own, and as b the weight that trigrams beginning with it give to lower orders."""
        none = np.zeros(0, np.int64)
        keys, n = (none, none) if keys is None else (unpack(keys), unsqueeze(n, "<i8"))
        pairs, p = (none, none.astype("<f4")) if pairs is None else (unpack(pairs), unsqueeze(p, "<f4"))
        cut = np.array([0.0, *self.discounts])[np.minimum(n, 3)]
        context, at, back = np.unique(keys >> BITS, return_index=True, return_inverse=True)
        total, cuts = (np.add.reduceat(x, at) if len(at) else none for x in (n, cut))
        known = np.union1d(context, pairs)
        a, b = np.zeros(len(known)), np.ones(len(known))
        a[np.searchsorted(known, pairs)], b[np.searchsorted(known, context)] = p, cuts / np.maximum(total, 1)
        return np.r_[keys, PAIRS + known], np.r_[(n - cut) / total[back], a].astype("<f4"), np.r_[np.ones(len(keys)), b].astype("<f4")

    def log_p(self, found: np.ndarray, keys: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The log probability of each trigram; keys, a, b: the model's rows that the trigrams need, sorted by key."""
        return np.log(self.both(found, np.zeros(len(found), np.int64), keys, a, b)[0])

    def both(self, found: np.ndarray, worded: np.ndarray, keys: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The probability of each trigram, and that of its token after the words themselves (worded, from after_words)."""
        keys, a, b = np.r_[keys, 1 << 62], np.r_[a, 0.0], np.r_[b, 1.0]

        def at(k: np.ndarray) -> np.ndarray:
            place = np.searchsorted(keys, k)
            return np.where(keys[place] == k, place, len(keys) - 1)

        # what is looked up is sorted, which is many times faster
        found, back = np.unique(found, return_inverse=True)
        pair, of = np.unique(found & PAIR, return_inverse=True)
        low = (a[at(PAIRS + pair)] + self.weight[pair >> BITS] * self.single[pair & BEGIN])[of]
        p = (a[at(found)] + b[at(PAIRS + (found >> BITS))] * low)[back]
        own, here = p.copy(), np.flatnonzero(worded)
        here = here[np.argsort(worded[here])]
        place = at(worded[here])
        own[here] = a[place] + b[place] * p[here]
        return p, own


def model_of(tokens: DataFrame, scratch: Scratch) -> Model:
    """The model of tokens (chunk, tokens, n_tokens)."""
    shards = min(_n_tokens(tokens), (VOCABULARY + SHAPES) ** 3) // SHARD + 1
    three = scratch.table(_trigrams(tokens, shards), "trigrams")

    def continued(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, n in ((unpack(k), unsqueeze(n, "<i8")) for b in batches for k, n in zip(b.column("keys").to_pylist(), b.column("n").to_pylist(), strict=True)):
            pair, times = np.unique(keys & PAIR, return_counts=True)
            of = np.bincount(np.minimum(n, 5), minlength=6)
            # counts of counts travel as rows of their own, below 0
            yield pa.record_batch({"pair": pa.array(np.r_[pair, -np.arange(1, 5)]), "n": pa.array(np.r_[times, of[1:5]].astype(np.int64))})

    found = scratch.table(three.select("keys", "n").mapInArrow(continued, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")), "pairs")
    of = {r.pair: r.n for r in found.where("pair < 0").collect()}  # four rows
    two = found.where("pair >= 0")
    one = two.groupBy(F.col("pair").bitwiseAND(BEGIN).alias("word")).agg(F.count("*").alias("n"))
    p2, g2 = _order(two, "pair", F.shiftright("pair", BITS))
    p1, g1 = _order(one, "word", F.lit(0))
    left = (g1.first() or {"g": 1.0})["g"] / (VOCABULARY + SHAPES)
    weight, single = np.ones(BEGIN + 1), np.full(BEGIN + 1, left)
    for r in g2.collect():  # a row to a word, as for p1
        weight[r["context"]] = r["g"]
    for r in p1.collect():
        single[r["word"]] += r["p"]

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            yield part.append_column("shard", pa.array(shard_of(part.column("pair").to_numpy(), shards)))

    def gather(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("pair")
        return pd.DataFrame({"shard": rows.shard.iloc[:1], "pairs": [pack(rows.pair.to_numpy())], "p": [squeeze(rows.p.to_numpy("<f4"))]})

    dealt = p2.select("pair", F.col("p").cast("float")).mapInArrow(deal, "pair long, p float, shard int").groupBy("shard").applyInPandas(gather, "shard int, pairs binary, p binary")
    return Model(scratch.table(three.join(dealt, "shard", "full").withColumn("of", F.lit(shards)), "model"), _discounts([of.get(-i, 0) for i in (1, 2, 3, 4)]), weight, single)


def _worded(counted: DataFrame, shards: int) -> DataFrame:
    """shard, keys, n: the distinct tokens after words of counted tokens and their counts, one row to a shard of contexts."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, found, n in _chunks(batches):
            own = found >= WORDS
            yield from _dealt(found[own], n[own], shard_of(found[own] >> BITS, shards))

    return _gathered(counted.select("chunk", "tokens", "rare", "other").mapInArrow(send, LISTS))


def _unfold_worded(keys: bytes, n: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """key, a, context, b of a shard of _worded: of each token after words its share of the counts, and of each context what it leaves to the trigram, by Witten and Bell."""
    keys, n = unpack(keys), unsqueeze(n, "<i8")
    context, at, back = np.unique(keys >> BITS, return_index=True, return_inverse=True)
    kinds = np.bincount(back)
    size = np.add.reduceat(n, at) + kinds
    return keys, (n / size[back]).astype("<f4"), context, (kinds / size).astype("<f4")


def _answers(tokens: DataFrame, model: Model, worded: DataFrame, of_words: int) -> DataFrame:
    """chunk, keys, a, b: for every chunk, in lists, the rows of the model (key, a, b) that its trigrams need, and its tokens after two words that counted tokens have, their share of the counts (a) and what the words leave to the trigram (b).
    All questions go out in one shuffle. worded: shards of _worded, of_words in all."""
    shards = model.shards.first()["of"]
    lots = _n_tokens(tokens) // (shards * ASKED) + 1
    small = tokens.sparkSession.sparkContext.broadcast(Model(None, model.discounts, model.weight, model.single))

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk, found, _ in _chunks(batches):
            found, own = np.split(found, [np.searchsorted(found, WORDS)])
            pairs = np.unique(np.r_[found >> BITS, found & PAIR])
            lot = int(mix(np.array([chunk], np.uint64))[0] % np.uint64(lots))
            whole = np.r_[found, PAIRS + pairs], np.r_[shard_of(found >> BITS, shards), shard_of(pairs, shards)], lot
            for words_, (keys, shard, lot) in enumerate((whole, (own, shard_of(own >> BITS, of_words), 0))):
                for x in np.unique(shard):
                    yield pa.record_batch({"words": pa.array([words_], pa.int32()), "shard": pa.array([x], pa.int32()), "lot": pa.array([lot], pa.int32()), "chunk": pa.array([int(chunk)], pa.int64()), "keys": pa.array([pack(keys[shard == x])], pa.binary())})

    def answer(asks: pd.DataFrame, shard: pd.DataFrame) -> pd.DataFrame:
        out = []
        for x in shard.itertuples():  # one row
            if x.words:
                keys, share, known, left = _unfold_worded(x.keys, x.n)
            else:
                known, a, b = small.value.unfold(x.keys, x.n, x.pairs, x.p)
            for chunk, found in zip(asks.chunk, asks["keys"], strict=True):
                found = unpack(found)
                wanted = found >> BITS if x.words else found
                at = np.minimum(np.searchsorted(known, wanted), len(known) - 1)
                seen = known[at] == wanted
                found, at = found[seen], at[seen]
                if not len(found):
                    continue
                if x.words:
                    own = np.minimum(np.searchsorted(keys, found), len(keys) - 1)
                    out.append((chunk, pack(found), squeeze(np.where(keys[own] == found, share[own], 0).astype("<f4")), squeeze(left[at])))
                else:
                    out.append((chunk, pack(found), squeeze(a[at]), squeeze(b[at])))
        return pd.DataFrame(out, columns=["chunk", "keys", "a", "b"])

    asks = tokens.select("chunk", "tokens", "rare", "other").mapInArrow(ask, "words int, shard int, lot int, chunk long, keys binary")
    each = model.shards.drop("of").withColumns({"lot": F.explode(F.sequence(F.lit(0), F.lit(lots - 1))), "words": F.lit(0)})
    each = each.unionByName(worded.withColumns({"lot": F.lit(0), "words": F.lit(1)}), allowMissingColumns=True)
    by = ("words", "shard", "lot")
    return asks.groupBy(*by).cogroup(each.groupBy(*by)).applyInPandas(answer, "chunk long, keys binary, a binary, b binary")


def perplexities(docs: DataFrame, labels: DataFrame, scratch: Scratch) -> DataFrame | None:
    """doc_id, lang, digest, n_tokens, perplexity (of tokens alone), symbols (tokens and those of spelled words), spelling (nats of the latter), nats (of tokens after the words themselves) of each row of docs (doc_id, text, lang); None if nothing is trusted.
    Rows are scored in lots, one after another, and what a lot sent goes before the next: so disk holds the counts and one lot."""
    with brief_shuffles(docs.sparkSession):
        good = scratch.table(trusted_ids(labels), "trusted")  # Spark broadcasts it if its file is small
        frequent = _vocabulary(docs.join(good, "doc_id", "left_semi"))
        vocabulary = frequent[:VOCABULARY]
        if not len(vocabulary):
            return None
        share = docs.sparkSession.sparkContext.broadcast
        shared, book = map(share, (vocabulary, frequent[VOCABULARY:]))
        counted = good.where(~held_out())
        if counted.isEmpty():  # a handful of trusted documents
            counted = good
        texts = docs.join(counted, "doc_id", "left_semi")
        spelling = share(_spelling(texts, shared))
        size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        lots = LOTS if size >= LOT else 1
        tokens = scratch.table(_tokens(texts, shared, book, None), "tokens")
        model = model_of(tokens, scratch)
        scratch.drop("trigrams", "pairs")
        shards = max(_n_tokens(tokens), size // WORD) // ASKED + 1
        worded = scratch.table(_worded(tokens, shards), "worded")
        scratch.drop("tokens")
        small = share(Model(None, model.discounts, model.weight, model.single))
        of = F.pmod(F.xxhash64("doc_id", "text"), F.lit(lots))
        scored = []
        for lot in range(lots):
            tokens = scratch.table(_tokens(docs.where(of == lot) if lots > 1 else docs, shared, book, spelling), "tokens")
            scored.append(scratch.table(_scored(tokens, _answers(tokens, model, worded, shards), small), "perplexities"))
            scratch.drop("tokens")
        scratch.drop("model", "worded", "trusted")
        return functools.reduce(DataFrame.unionByName, scored)


def _scored(tokens: DataFrame, known: DataFrame, small) -> DataFrame:
    """The rows of perplexities from tokens and what their chunks know (chunk, keys, a, b)."""

    def score(rows: pd.DataFrame, table: pd.DataFrame) -> pd.DataFrame:
        keys, by = np.unique(np.concatenate([np.zeros(0, np.int64), *map(unpack, table["keys"])]), return_index=True)
        a, b = (np.concatenate([np.zeros(0), *(unsqueeze(x, "<f4") for x in table[c])])[by] for c in ("a", "b"))
        n, total, nats = rows.n_tokens.to_numpy(), np.zeros(len(rows)), np.zeros(len(rows))
        for part in held(rows.tokens.tolist(), rows.rare.tolist(), rows.other.tolist()):
            found, row = grams(part)
            p, own = small.value.both(found, after_words(part), keys, a, b)
            total += np.bincount(row, np.log(p), len(rows))
            nats -= np.bincount(row, np.log(own), len(rows))
        return rows[["doc_id", "lang", "digest"]].assign(n_tokens=n, perplexity=np.where(n > 0, np.exp(-total / np.maximum(n, 1)), np.nan), symbols=rows.symbols, spelling=rows.spelling, nats=nats)

    return tokens.groupBy("chunk").cogroup(known.groupBy("chunk")).applyInPandas(score, "doc_id long, lang string, digest long, n_tokens long, perplexity double, symbols long, spelling double, nats double")


def _bands(good: DataFrame, low: float, high: float, scratch: Scratch) -> tuple[DataFrame, list[float]]:
    """lang, cuts of each language with trusted documents (good: lang, perplexity, held), and the cuts over all of them, for the others."""

    def cuts(*keys: str) -> DataFrame:
        each = good.groupBy(*keys, "held").agg(F.percentile_approx("perplexity", [low, high], 10_000).alias("c"), F.count("*").alias("n"))
        return each.groupBy(*keys).agg(F.array(F.min(F.col("c")[0]), F.max(F.col("c")[1])).alias("cuts"), F.sum("n").alias("n"))

    everywhere = (cuts().first() or {"cuts": None})["cuts"]
    everywhere = [0.0, float("inf")] if not everywhere or everywhere[0] is None else everywhere
    weighed = F.array(*[everywhere[i] + (F.col("cuts")[i] - everywhere[i]) * F.col("n") / (F.col("n") + PRIOR) for i in (0, 1)])
    return scratch.table(cuts("lang").select("lang", weighed.alias("cuts")), "bands"), everywhere


def _verdicts(docs: DataFrame, labels: DataFrame, low: float, high: float) -> DataFrame:
    """doc_id, lang, digest, n_tokens, perplexity, kept."""
    scratch = Scratch(docs.sparkSession)
    found = perplexities(docs, labels, scratch)
    if found is None:
        some = F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
        return docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.xxhash64("text").alias("digest"), F.lit(None).cast("long").alias("n_tokens"), F.lit(None).cast("double").alias("perplexity"), some.alias("kept"))
    whole = F.exp((F.col("nats") + F.col("spelling")) / F.col("symbols"))
    scored = scratch.table(found.withColumn("perplexity", F.when(F.col("n_tokens") > 0, whole)).drop("symbols", "spelling", "nats"), "scored")
    scratch.drop("perplexities")
    bands, everywhere = _bands(scored.where("n_tokens > 0").join(trusted_ids(labels), "doc_id", "left_semi").withColumn("held", held_out()), low, high, scratch)
    cut = F.coalesce("cuts", F.array(*map(F.lit, everywhere)))
    kept = (F.col("n_tokens") > 0) & F.col("perplexity").between(cut[0], cut[1])
    # Spark broadcasts the bands if their file is small
    return scored.join(bands, "lang", "left").select("doc_id", "lang", "digest", "n_tokens", "perplexity", F.coalesce(kept, F.lit(False)).alias("kept"))


def classify(docs: DataFrame, labels: DataFrame, low: float = LOW, high: float = HIGH) -> DataFrame:
    """Per row of docs: doc_id, lang, n_tokens, perplexity, kept."""
    return _verdicts(docs, labels, low, high).drop("digest")


def keep_good(docs: DataFrame, labels: DataFrame, low: float = LOW, high: float = HIGH) -> DataFrame:
    """docs without those that the classifier rejects."""
    kept = _verdicts(docs, labels, low, high).where("kept").select("doc_id", "lang", "digest").distinct()
    same = docs["doc_id"].cast("long").eqNullSafe(kept.doc_id) & F.coalesce(docs["lang"].cast("string"), F.lit("und")).eqNullSafe(kept.lang) & (F.xxhash64(docs["text"]) == kept.digest)
    return docs.join(kept, same, "left_semi")
