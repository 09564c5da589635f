"""Language identification by cross-parsing entropy.

For each language a suffix automaton holds labelled text as it runs. A text is parsed against each automaton into longest
matches, each phrase as long as the learned text has it anywhere; a symbol that it never has is a phrase of its own. With c phrases
for a text of n bytes, and m bytes learned, the cross-parsing entropy is c log2(m) / n bits a byte, and the language with the least wins.

What is parsed are letters, lower-cased, with one space before each word that has any. Long texts are parsed in blocks of
BLOCK bytes, side by side, so that the longest text is not one long chain of steps; a phrase ends with its block.

The automata are fitted on a bounded sample: for each language, of its LEARN_DOCS distinct texts of least hash, a passage of
PASSAGE characters at a place that the hash gives. No language is left out: what a task holds at a time are the automata of ROUND languages, and
where there are more, texts are parsed in as many rounds.

Rows: null text and text without a letter are `und` with score 0; so is every text if nothing is labelled.
Ties go to the language that sorts first. Null doc_id is kept. Repeated rows and extra columns make no difference;
an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from quarry.llm.scratch import Scratch
from quarry.llm.words import distinct, slices, spread, words

LEARN_DOCS, PASSAGE, ROUND, BLOCK = 200, 300, 12, 512
UNKNOWN = "und"


def suffix_automaton(text: list[int]) -> list[dict[int, int]]:
    """Transitions of the suffix automaton of a sequence of symbols (Blumer et al.); state 0 is the start."""
    follow, link, size, last = [{}], [-1], [0], 0
    for symbol in text:
        new = len(follow)
        follow.append({})
        link.append(0)
        size.append(size[last] + 1)
        at = last
        while at >= 0 and symbol not in follow[at]:
            follow[at][symbol] = new
            at = link[at]
        if at >= 0:
            old = follow[at][symbol]
            if size[old] == size[at] + 1:
                link[new] = old
            else:
                copy = len(follow)
                follow.append(dict(follow[old]))
                link.append(link[old])
                size.append(size[at] + 1)
                while at >= 0 and follow[at].get(symbol) == old:
                    follow[at][symbol] = copy
                    at = link[at]
                link[old] = link[new] = copy
        last = new
    return follow


def letters(word: str) -> str:
    """The word's letters, lower-cased; digits and signs are of no language."""
    return word.lower() if word.isalpha() else "".join(filter(str.isalpha, word.lower()))


def normal(text: str) -> str:
    """The letters of each word that has any, with a space before it."""
    return "".join(f" {x}" for x in map(letters, text.split()) if x)


class CrossParser:
    """Automata of several languages, each as a transition table over its own alphabet."""

    def __init__(self, samples: dict[str, list[str]]):
        self.languages = sorted(samples)
        self.codes, self.tables, self.bits = [], [], []
        for x in self.languages:
            passages = [normal(t).encode() for t in samples[x]]
            used = sorted({b for t in passages for b in t})
            code = np.zeros(256, np.uint8 if len(used) < 256 else np.int16)  # symbol 0: none of the alphabet
            code[used] = np.arange(1, len(used) + 1)
            text = [s for t in passages for s in (-1, *code[list(t)].tolist())]  # -1 parts passages and is never looked up
            follow, width = suffix_automaton(text), len(used) + 1
            table = np.zeros((len(follow), width), np.int32)
            for state, out in enumerate(follow):
                for symbol, to in out.items():
                    if symbol > 0:
                        table[state, symbol] = to * width  # where the next state's row begins; 0: no transition
            self.codes.append(code)
            self.tables.append(table.ravel())
            self.bits.append(float(np.log2(max(2, sum(map(len, passages))))))

    def phrases(self, data: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Phrases that each text needs in each language. data: the texts' bytes one after another."""
        blocks = -(-size // BLOCK)
        owner = np.repeat(np.arange(len(size)), blocks)
        number = np.arange(len(owner)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
        start = np.repeat(np.cumsum(size) - size, blocks) + number * BLOCK
        length = np.minimum(size[owner] - number * BLOCK, BLOCK)
        order = np.argsort(-length, kind="stable")
        start, length, owner = start[order], length[order], owner[order]
        steps = np.zeros((BLOCK, len(start)), np.uint8)
        at = np.arange(BLOCK)[:, None]
        inside = at < length
        steps[inside] = data[(start + at)[inside]]
        active = inside.sum(1)
        out = np.zeros((len(self.languages), len(size)), np.int64)
        for code, table, total in zip(self.codes, self.tables, out, strict=True):
            state, count = np.zeros(len(start), np.int32), np.zeros(len(start), np.int32)
            for n, row in zip(active.tolist(), steps, strict=True):
                if not n:
                    break
                symbol, now = code[row[:n]], state[:n]
                to = table[now + symbol]
                ends = to == 0
                count[:n] += ends | (now == 0)
                state[:n] = np.where(ends, table[symbol], to)
            total += np.bincount(owner, count, len(size)).astype(np.int64)
        return out


def learn(labelled: DataFrame) -> list[CrossParser]:
    """Parsers of labelled (text, lang), of ROUND languages each, in order."""
    labelled = labelled.where("lang is not null and text is not null").select(F.col("lang").cast("string"), "text", F.xxhash64("text").alias("draw"))
    order = Window.partitionBy("lang").orderBy("draw")
    # ranks are cut before the shuffle, so a language of very many texts is not sorted in one task
    drawn = labelled.select("lang", "draw").distinct().withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= LEARN_DOCS).select("lang", "draw")
    place = F.pmod("draw", F.greatest(F.char_length("text") - PASSAGE, F.lit(0)) + 1).cast("int")
    passage = labelled.join(drawn, ["lang", "draw"]).select("lang", "draw", F.substring("text", place + 1, F.lit(PASSAGE)).alias("passage"))
    samples: dict[str, list[str]] = {}
    for r in passage.distinct().orderBy("lang", "draw", "passage").collect():  # LEARN_DOCS short passages to a language
        samples.setdefault(r["lang"], []).append(r["passage"])
    names = sorted(samples)
    return [CrossParser({x: samples[x] for x in names[i : i + ROUND]}) for i in range(0, len(names), ROUND)]


def _round(docs: DataFrame, parser: CrossParser) -> DataFrame:
    """docs (doc_id, text, lang_pred, phrases, best, second) with what these languages change; best, second: the least entropies so far."""
    shared = docs.sparkSession.sparkContext.broadcast(parser)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for part in slices(batches, "text"):
            w = words(part.column("text"), lower=True)
            codes, first = distinct(w.hashes())
            found = [x.encode() for x in (normal(w.text(i).decode()) for i in first)]
            n = np.array([len(x) for x in found], np.int64)
            data = np.frombuffer(b"".join(found), np.uint8)[spread((np.cumsum(n) - n)[codes], n[codes])]
            size = np.bincount(w.doc, n[codes], part.num_rows).astype(np.int64) if len(codes) else np.zeros(part.num_rows, np.int64)
            phrases = model.phrases(data, size)
            bits = np.where(size > 0, phrases * np.array(model.bits)[:, None] / np.maximum(size, 1), np.inf)
            before = [part.column(c).to_numpy(zero_copy_only=False) for c in ("best", "second")]
            least = np.sort(np.vstack([before, bits]), 0)[:2]
            here = bits.argmin(0)
            won = bits.min(0) < before[0]
            names = part.column("lang_pred").to_pylist()
            yield pa.record_batch({
                "doc_id": part.column("doc_id"), "text": part.column("text"), "lang_pred": pa.array([model.languages[i] if ok else x for x, i, ok in zip(names, here, won, strict=True)], pa.string()),
                "phrases": pa.array(np.where(won, phrases[here, np.arange(len(here))], part.column("phrases").to_numpy())), "best": pa.array(least[0]), "second": pa.array(least[1]),
            })

    return docs.mapInArrow(run, docs.schema)


def identify(docs: DataFrame, parsers: list[CrossParser]) -> DataFrame:
    """Per row of docs (doc_id, text): doc_id, lang_pred, score (by how much the second language needs more bits; 1 if there is none), phrases."""
    scratch = Scratch(docs.sparkSession)
    never = F.lit(float("inf"))
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), F.lit(UNKNOWN).alias("lang_pred"), F.lit(0).cast("long").alias("phrases"), never.alias("best"), never.alias("second"))
    for i, parser in enumerate(parsers):
        docs = _round(docs if i == 0 else scratch.table(docs, "round"), parser)
    score = F.when(F.col("best") == never, 0.0).when(F.col("second") == never, 1.0).otherwise(1 - F.col("best") / F.col("second"))
    return docs.select("doc_id", "lang_pred", score.alias("score"), "phrases")
