"""Quality rules on whole texts, and a verdict by tokeniser fertility.

Public vocabularies, one of pieces with byte fallback and one of bytes, encode every distinct word of a slice of texts once. Per
text and vocabulary: characters per token, the share of tokens that are bytes and no characters, and the entropy of its tokens as a part of
the most that so many tokens can have. For each language these have quartiles over its distinct texts that pass the base rules, and a text
far outside of them (REACH times the spread between the quartiles, which is LEAST_SPREAD at least) by any vocabulary is rejected;
however often a text is copied, it counts once. Figures of a text of under FULL tokens scatter more, as the root of their number says,
and its band is wider by as much.

Rows: null text has no word and fails the base rules. Null lang is a language of its own. Repeated rows and extra
columns make no difference; an empty table gives an empty table.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from quarry.llm.scratch import Scratch
from quarry.llm.words import distinct, mix, slices, spread, windows, words

REACH, FULL, WINDOW = 3.0, 50, 8
LEAST_SPREAD = {"chars_per_token": 0.1, "byte_share": 0.01, "entropy": 0.01}
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
RULES = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"
#: Measured by each vocabulary, after whose place in the list they are numbered.
MEASURES = ("chars_per_token", "byte_share", "entropy")

_SPACE = re.compile(r"\s")
_models: dict[str, tuple] = {}


def _flat(ids: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    return np.array([i for x in ids for i in x], np.int64), np.array([len(x) for x in ids], np.int64)


class _ByteVocabulary:
    """Words are encoded together, each after a space, where no token goes over: only a word with white space of its own (beyond ASCII) could join the next one's space, and goes alone."""

    def __init__(self, own, ranks: dict[bytes, int]):
        self.own, self.length = own, np.zeros(max(ranks.values()) + 1, np.int64)
        self.length[list(ranks.values())] = [len(t) for t in ranks]

    def __call__(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        alone = [i for i, w in enumerate(words) if _SPACE.search(w)]
        if alone:
            ids = {i: self.own.encode_ordinary(f" {words[i]}") for i in alone}
            flat, size = self([w for i, w in enumerate(words) if i not in ids]) if len(alone) < len(words) else _flat([])
            parts = iter(np.split(flat, np.cumsum(size)[:-1]) if len(size) else [])
            return _flat([ids[i] if i in ids else next(parts).tolist() for i in range(len(words))])
        text = "".join([f" {w}" for w in words])
        ids = np.array(self.own.encode_ordinary(text), np.int64)
        ends = np.cumsum([1 + len(w.encode()) for w in words])
        place = np.searchsorted(np.cumsum(self.length[ids]), ends) + 1
        return ids, np.diff(place, prepend=0)


def vocabulary(path: str) -> tuple:
    """A function from words to all of their ids in a row and how many each word has, and whether each id is of bytes that are no character. path: a SentencePiece model with byte fallback, or a list of byte tokens and their ranks (.tiktoken). Loaded once to a worker."""
    if path not in _models:
        if path.endswith(".tiktoken"):
            import base64

            import tiktoken

            with open(path, "rb") as f:
                ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
            # fixed value: how such vocabularies part letters, digits and signs
            parts = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
            own = tiktoken.Encoding("own", pat_str=parts, mergeable_ranks=ranks, special_tokens={})
            odd = np.zeros(max(ranks.values()) + 1, bool)
            for token, rank in ranks.items():
                odd[rank] = "\ufffd" in token.decode("utf-8", "replace") and token != "\ufffd".encode()
            _models[path] = _ByteVocabulary(own, ranks), odd
        else:
            import sentencepiece

            sp = sentencepiece.SentencePieceProcessor(model_file=path)
            _models[path] = lambda words: _flat(sp.encode(words, num_threads=1)), np.array([sp.IsByte(i) for i in range(sp.GetPieceSize())])
    return _models[path]


def _sums(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=total[1:])
    return total[offsets[1:]] - total[offsets[:-1]]


def duplicate_lines(text: str) -> int:
    """Lines with a word that equal an earlier line."""
    seen, n = set(), 0
    for line in text.split("\n"):
        if line.strip(" \t\n\v\f\r"):
            n += line in seen
            seen.add(line)
    return n


def repeated_words(hashes: np.ndarray, w) -> np.ndarray:
    """Per text: words in windows of WINDOW words that are found twice or more in it."""
    value, at = windows(hashes, w, WINDOW)
    doc = w.doc
    keys = mix(value + doc[at].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    _, back, n = np.unique(keys, return_inverse=True, return_counts=True)
    edge = np.zeros(len(hashes) + WINDOW + 1, np.int64)
    twice = at[n[back] > 1] if len(at) else at
    np.add.at(edge, twice, 1)
    np.add.at(edge, twice + WINDOW, -1)
    return np.bincount(doc, (np.cumsum(edge)[: len(hashes)] > 0), len(w.counts)).astype(np.int64)


def _measures(path: str, found: list[str], codes: np.ndarray, doc: np.ndarray, n: int, chars: np.ndarray) -> dict[str, np.ndarray]:
    """n_tokens and MEASURES of n texts by one vocabulary. found: distinct words; codes: the word at each place; doc: its text."""
    encode, odd = vocabulary(path)
    flat, size = encode(found) if found else (np.zeros(0, np.int64), np.zeros(0, np.int64))
    tokens = flat[spread((np.cumsum(size) - size)[codes], size[codes])]
    owner = np.repeat(doc, size[codes])
    n_tokens = np.bincount(owner, minlength=n)
    kinds, count = np.unique(owner * len(odd) + tokens, return_counts=True)
    share = count / n_tokens[kinds // len(odd)]
    bits = np.bincount(kinds // len(odd), -share * np.log2(share), n)
    some = np.maximum(n_tokens, 1)
    return {"n_tokens": n_tokens.astype(np.int64), "chars_per_token": chars / some, "byte_share": np.bincount(owner, odd[tokens], n) / some, "entropy": bits / np.log2(np.maximum(n_tokens, 2))}


def features(docs: DataFrame, models: list[str]) -> DataFrame:
    """doc_id, lang, digest (of the text), RULES, and n_tokens_i and MEASURES_i by each vocabulary i, of each row of docs (doc_id, text, lang)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            w = words(part.column("text"))
            hashes, doc, n = w.hashes(), w.doc, part.num_rows
            codes, first = distinct(hashes)
            found = [w.text(i).decode() for i in first]
            letters = (w.data & 0xC0) != 0x80
            solid = ~((w.data == 32) | ((w.data >= 9) & (w.data <= 13)))
            chars = _sums(letters & solid, w.offsets)
            measured = {f"{k}_{i}": pa.array(x) for i, path in enumerate(models) for k, x in _measures(path, found, codes, doc, n, chars).items()}
            yield pa.record_batch({
                "doc_id": part.column("doc_id"), "lang": part.column("lang"), "digest": part.column("digest"), "n_words": pa.array(w.counts, pa.int64()), "word_chars": pa.array(chars), "n_symbols": pa.array(_sums(_SYMBOL[w.data], w.offsets)),
                "n_dup_lines": pa.array([duplicate_lines(t or "") for t in part.column("text").to_pylist()], pa.int64()), "n_repeat_words": pa.array(repeated_words(hashes, w)), **measured,
            })

    kind = ", ".join([RULES, *(f"n_tokens_{i} long, " + ", ".join(f"{c}_{i} double" for c in MEASURES) for i in range(len(models)))])
    return docs.select(F.col("doc_id").cast("long"), "text", F.col("lang").cast("string"), F.xxhash64("text").alias("digest")).mapInArrow(run, f"doc_id long, lang string, digest long, {kind}")


def quality_rules(docs: DataFrame, models: list[str], reach: float = REACH) -> DataFrame:
    """Per row of docs: doc_id, RULES, base_failed, kept, and n_tokens_i and MEASURES_i by each vocabulary i."""
    scratch = Scratch(docs.sparkSession)
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    rows = scratch.table(features(docs, models), "fertility").withColumn("lang", F.coalesce("lang", F.lit("und"))).withColumn("base_failed", failed)
    names = [f"{c}_{i}" for i in range(len(models)) for c in MEASURES]
    texts = rows.where(~F.col("base_failed")).select("lang", "digest", *names).dropDuplicates(["lang", "digest"])
    quartiles = texts.groupBy("lang").agg(*[F.percentile_approx(c, [0.25, 0.75], 10_000).alias(f"q_{c}") for c in names])
    joined = rows.join(scratch.table(quartiles, "quartiles"), "lang", "left")  # Spark broadcasts it if its file is small
    odd = F.lit(False)
    for i in range(len(models)):
        wider = F.greatest(F.lit(1.0), F.sqrt(FULL / F.greatest(F.col(f"n_tokens_{i}"), F.lit(1))))
        beyond = {c: reach * wider * F.greatest(F.col(f"q_{c}_{i}")[1] - F.col(f"q_{c}_{i}")[0], F.lit(LEAST_SPREAD[c])) for c in MEASURES}
        low, high = ({c: F.col(f"q_{c}_{i}")[j] + sign * beyond[c] for c in MEASURES} for j, sign in ((0, -1), (1, 1)))
        chars, share, entropy = (F.col(f"{c}_{i}") for c in MEASURES)
        odd = odd | (chars < low["chars_per_token"]) | (chars > high["chars_per_token"]) | (share > high["byte_share"]) | (entropy < low["entropy"])
    shown = [x.split()[0] for x in RULES.split(", ")]
    return joined.select("doc_id", *shown, "base_failed", (~F.col("base_failed") & ~F.coalesce(odd, F.lit(False))).alias("kept"), *[c for c in rows.columns if c[:-2] in ("n_tokens", *MEASURES)])
