"""Passages that repeat, by a sparse suffix array.

Only suffixes that begin at a minimiser are retained: of the GRAM-word grams that begin in a window, the
one of least hash. Every passage of MIN_WORDS words holds a minimiser that depends on its own words alone,
so equal passages retain suffixes at equal places. Suffixes whose gram is met once are dropped; those left are
sorted by gram and following words, each is compared with its neighbour in that order, and matches are extended to the left
and right, word by word, over all words that a window of MIN_WORDS around the suffix may have.

A comparison with the neighbour alone would miss a passage where a third text agrees further to the right but not to
the left. So for each place s of the suffix in the window, suffixes with a common prefix of MIN_WORDS - s
words, which are neighbours, are parted by the s words to their left, found one word at a time. Nothing else than words
decides (their 64-bit hashes, of which two would have to be equal by chance at one place between passages that are otherwise the same).

Suffixes with the same words all around are combined before they are sorted. A gram that still has over CROWD of them (a
passage that thousands of texts share has as many at either end) is not sorted in one task: its windows are grouped by a
128-bit hash, in an aggregate that is combined before the shuffle. Both ways give the same windows.

Words are runs without ASCII white space and are compared as they stand. Exact copies are found by
digest first, and only one of them is searched; a copied text of MIN_WORDS words or more is one passage.

Rows: a null text is empty. Texts under MIN_WORDS words have no passage. Rows are known by doc_id and text: rows that share a doc_id
but not a text are apart, those that share both are one. Null ids come last in the order that says which copy is the first.
Extra columns are ignored by repeated_passages and kept by cut_repeats.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from quarry.llm.scratch import Scratch
from quarry.llm.words import Words, lists, mix, seeds, slices, windows, words

MIN_WORDS, GRAM, CROWD = 50, 20, 2_000
SPANS = "array<struct<start:int,end:int>>"
#: Where a suffix begins; nulls are last.
PLACE = "struct<no_id:boolean,doc_id:long,blob:binary,pos:int>"
MET = f"array<struct<s:int,first:{PLACE}>>"


def _blob() -> Column:
    return F.unhex(F.md5("text"))


def anchors(w: Words, hashes: np.ndarray, min_words: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First word of each window of min_words words, the first word of its minimiser, and the hashes of grams by first word."""
    grams = np.zeros(len(hashes), np.uint64)
    value, at = windows(hashes, w, gram, salt=11)
    grams[at] = value
    _, starts = windows(hashes, w, min_words, salt=13)
    span = min_words - gram + 1
    if not len(starts):
        return starts, starts, grams
    least = np.lib.stride_tricks.sliding_window_view(grams, span)
    return starts, starts + np.concatenate([least[s].argmin(1) for s in np.array_split(starts, len(starts) // 20_000 + 1)]), grams


def _suffixes(docs: DataFrame, min_words: int, gram: int) -> DataFrame:
    """doc_id, blob, n_words, the distinct grams of retained suffixes, and those that are there again."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            w = words(part.column("text"))
            _, anchor, grams = anchors(w, w.hashes(), min_words, gram)
            anchor = np.unique(anchor)
            cut = np.searchsorted(anchor, w.first)
            own = [np.unique(grams[anchor[a:b]], return_counts=True) for a, b in zip(cut, cut[1:], strict=False)]
            yield pa.record_batch({
                "doc_id": part.column("doc_id"), "blob": part.column("blob"), "n_words": pa.array(w.counts, pa.int64()),
                "grams": lists([x.view(np.int64) for x, _ in own], pa.int64()),
                "again": lists([x[n > 1].view(np.int64) for x, n in own], pa.int64()),
            })

    return docs.mapInArrow(run, "doc_id long, blob binary, n_words long, grams array<long>, again array<long>")


def _contexts(docs: DataFrame, min_words: int, gram: int) -> DataFrame:
    """For each suffix of a text that begins with one of its wanted grams: where it is (doc_id, blob, pos), its gram, the places
    (low to high) that it has in windows whose minimiser it is, the words of these windows from it on (right) and, the nearest first, before it (left)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            w = words(part.column("text"))
            hashes = w.hashes()
            starts, anchor, grams = anchors(w, hashes, min_words, gram)
            at, first, n = np.unique(anchor, return_index=True, return_counts=True)
            high = at - starts[first]
            low = high - n + 1
            doc = np.searchsorted(w.first, at, "right") - 1
            wanted = [x.values.to_numpy() for x in part.column("grams")]
            cut = np.searchsorted(doc, np.arange(part.num_rows + 1))
            keep = np.concatenate([np.isin(grams[at[a:b]].view(np.int64), wanted[d]) for d, (a, b) in enumerate(zip(cut, cut[1:], strict=False))])
            at, low, high, doc = at[keep], low[keep], high[keep], doc[keep]
            big = hashes.astype(">u8")
            right = [big[a : a + min_words - x].tobytes() for a, x in zip(at.tolist(), low.tolist(), strict=True)]
            left = [big[a - x : a][::-1].tobytes() for a, x in zip(at.tolist(), high.tolist(), strict=True)]
            row = pa.array(doc)
            yield pa.record_batch({
                "doc_id": part.column("doc_id").take(row), "blob": part.column("blob").take(row), "pos": pa.array((at - w.first[doc]).astype(np.int32)), "gram": pa.array(grams[at].view(np.int64)),
                "low": pa.array(low.astype(np.int32)), "high": pa.array(high.astype(np.int32)), "right": pa.array(right, pa.binary()), "left": pa.array(left, pa.binary()),
            })

    return docs.mapInArrow(run, "doc_id long, blob binary, pos int, gram long, low int, high int, right binary, left binary")


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """Words of each row, filled up with 0."""
    n = pc.binary_length(column).to_numpy() // 8
    out = np.zeros((len(column), width), np.uint64)
    out[np.arange(width) < n[:, None]] = np.frombuffer(b"".join(column.to_pylist()), ">u8")
    return out


def _neighbours(rows: pa.Table, min_words: int) -> pa.RecordBatch:
    """ctx and met of the suffixes (sorted by gram and right) that share a window: for each place s of the suffix in such a window, the first suffix with it."""
    rows = rows.combine_chunks()
    column = lambda c: rows.column(c).chunk(0)
    low, high, times, gram = (column(c).to_numpy() for c in ("low", "high", "times", "gram"))
    right, left = _matrix(column("right"), min_words), _matrix(column("left"), int(high.max(initial=0)))
    n = len(low)
    same = np.c_[(right[1:] == right[:-1]) & (gram[1:] == gram[:-1])[:, None], np.zeros((max(n - 1, 0), 1), bool)]
    common = np.r_[0, same.argmin(1)]  # words that each suffix shares with the one before it
    firsts = column("first").to_pylist()
    order = sorted(range(n), key=lambda i: (firsts[i]["no_id"], firsts[i]["doc_id"] or 0, firsts[i]["blob"], firsts[i]["pos"]))
    rank = np.empty(n, np.int64)
    rank[order] = np.arange(n)
    before, found = np.zeros(n, np.int64), []  # before: a number for the s words before each suffix
    for s in range(left.shape[1] + 1):
        if s:
            _, word = np.unique(left[:, s - 1], return_inverse=True)
            _, before = np.unique(before * n + word, return_inverse=True)
        own = np.flatnonzero((low <= s) & (s <= high))
        if len(own):
            run = np.cumsum(common < min_words - s)  # suffixes that share the rest of the window are neighbours
            _, group = np.unique(run[own] * n + before[own], return_inverse=True)
            first = np.full(group.max() + 1, n)
            np.minimum.at(first, group, rank[own])
            again = np.bincount(group, times[own])[group] > 1
            found.append((own[again], np.full(again.sum(), s), np.array(order)[first[group[again]]]))
    row, s, first = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 3
    by = np.argsort(row, kind="stable")
    row, s, first = row[by], s[by], first[by]
    kinds, at = np.unique(row, return_index=True)
    met = pa.StructArray.from_arrays([pa.array(s.astype(np.int32)), column("first").take(pa.array(first))], names=["s", "first"])
    return pa.RecordBatch.from_arrays([column("ctx").take(pa.array(kinds)), pa.ListArray.from_arrays(pa.array(np.r_[at, len(row)].astype(np.int32)), met)], names=["ctx", "met"])


def _sorted(contexts: DataFrame, min_words: int) -> DataFrame:
    """ctx, met (MET) by sorting suffixes and comparing neighbours."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for part in batches:
            if not part.num_rows:
                continue
            rows = pa.Table.from_batches([part])
            rows = rows if rest is None else pa.concat_tables([rest, rows])
            gram = rows.column("gram").to_numpy()
            end = int(np.searchsorted(gram, gram[-1]))  # the last gram may go on in the next batch
            rest = rows.slice(end)
            if end:
                yield _neighbours(rows.slice(0, end), min_words)
        if rest is not None:
            yield _neighbours(rest, min_words)

    dealt = contexts.repartition("gram").sortWithinPartitions("gram", "right")
    return dealt.mapInArrow(run, f"ctx binary, met {MET}")


def _hashed(contexts: DataFrame, min_words: int) -> DataFrame:
    """The same for suffixes of crowded grams, by hashes of their windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (b.slice(i, 2_000) for b in batches for i in range(0, b.num_rows, 2_000)):
            low, high = (part.column(c).to_numpy() for c in ("low", "high"))
            around = np.c_[_matrix(part.column("left"), min_words)[:, ::-1], _matrix(part.column("right"), min_words)]  # the suffix begins at min_words
            row, s = np.nonzero((low[:, None] <= np.arange(min_words)) & (np.arange(min_words) <= high[:, None]))
            win = np.zeros((len(row), 2), np.uint64)
            for k, salt in enumerate((17, 19)):
                for j, m in enumerate(seeds(min_words, salt)):
                    win[:, k] += mix(around[row, min_words - s + j] + np.uint64(salt)) * m
            yield pa.RecordBatch.from_arrays(
                [part.column("ctx").take(pa.array(row)), pa.array(s.astype(np.int32)), pa.array([x.tobytes() for x in win], pa.binary()), part.column("times").take(pa.array(row)), part.column("first").take(pa.array(row))],
                names=["ctx", "s", "win", "times", "first"],
            )

    wins = contexts.mapInArrow(run, f"ctx binary, s int, win binary, times long, first {PLACE}")
    twice = wins.groupBy("win").agg(F.sum("times").alias("times"), F.min("first").alias("first")).where("times > 1").select("win", "first")
    return wins.select("ctx", "s", "win").join(twice, "win").groupBy("ctx").agg(F.collect_list(F.struct("s", "first")).alias("met"))


def _runs(starts: np.ndarray, length: int) -> list[dict]:
    """Maximal runs of words that windows beginning at the sorted starts cover."""
    if not len(starts):
        return []
    gap = np.flatnonzero(np.diff(starts) > length)
    return [{"start": int(a), "end": int(b) + length} for a, b in zip(starts[np.r_[0, gap + 1]], starts[np.r_[gap, len(starts) - 1]], strict=True)]


def _spans(found: DataFrame, min_words: int) -> DataFrame:
    """found: blob and all its lists of (pos, kept)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
        for part in batches:
            repeated, cut = [], []
            for row in part.column("at"):
                pos, kept = row.values.field("pos").to_numpy(), row.values.field("kept").to_numpy(zero_copy_only=False)
                repeated.append(_runs(np.unique(pos), min_words))
                cut.append(_runs(np.unique(pos[~kept]), min_words))
            yield pa.record_batch({"blob": part.column("blob"), "repeated": pa.array(repeated, kind), "cut": pa.array(cut, kind)})

    return found.mapInArrow(run, f"blob binary, repeated {SPANS}, cut {SPANS}")


def _by_text(docs: DataFrame, min_words: int, gram: int, crowd: int) -> DataFrame:
    """For each text (blob) that holds a repeated passage or has copies: rep, copies, n_words, repeated, cut; rep: its first doc_id."""
    scratch = Scratch(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long"), "text").where("text is not null").withColumn("blob", _blob())
    suffixes = _suffixes(docs, min_words, gram).where(f"n_words >= {min_words}")
    alone = (F.min("doc_id").eqNullSafe(F.max("doc_id"))) & ((F.count("doc_id") == 0) | (F.count("doc_id") == F.count("*")))
    texts = scratch.table(suffixes.groupBy("blob").agg(F.min("doc_id").alias("rep"), alone.alias("single"), *[F.first(c).alias(c) for c in ("n_words", "grams", "again")]), "texts")
    grams = texts.select("blob", F.explode("grams").alias("gram"))
    often = grams.groupBy("gram").agg(F.count("*").alias("n")).where("n > 1").select("gram")
    wanted = grams.join(often, "gram", "left_semi").unionByName(texts.select("blob", F.explode("again").alias("gram")))
    wanted = wanted.groupBy("blob").agg(F.collect_set("gram").alias("grams")).join(texts.select("blob", "rep"), "blob")
    one = docs.join(wanted, "blob").where(F.col("doc_id").eqNullSafe(F.col("rep"))).select("doc_id", "text", "blob", "grams")
    ctx = F.unhex(F.md5(F.concat("left", F.lit(b"|"), "right")))
    contexts = scratch.table(_contexts(one, min_words, gram).withColumn("ctx", ctx), "contexts")
    place = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "blob", "pos")
    # rows that share doc_id and text give the same places
    alike = scratch.table(contexts.groupBy("ctx").agg(F.min(place).alias("first"), F.max(place).alias("last"), *[F.first(c).alias(c) for c in ("gram", "low", "high", "right", "left")]), "alike")
    alike = alike.withColumn("times", F.when(F.col("first") == F.col("last"), 1).otherwise(2).cast("long")).drop("last")
    crowded = scratch.table(alike.groupBy("gram").agg(F.count("*").alias("n")).where(F.col("n") > crowd).select("gram"), "crowded")
    met = _sorted(alike.join(crowded, "gram", "left_anti"), min_words).unionByName(_hashed(alike.join(crowded, "gram", "left_semi"), min_words))
    own = F.struct(F.col("doc_id").isNull(), "doc_id", "blob", "pos")
    at = F.transform("met", lambda m: F.struct((F.col("pos") - m["s"]).alias("pos"), own.eqNullSafe(m["first"]).alias("kept")))
    found = contexts.select("ctx", "doc_id", "blob", "pos").join(met, "ctx").select("blob", at.alias("at")).groupBy("blob").agg(F.flatten(F.collect_list("at")).alias("at"))
    spans = scratch.table(_spans(found, min_words), "passages")
    scratch.drop("contexts", "alike", "crowded")
    whole, none = F.array(F.struct(F.lit(0).alias("start"), F.col("n_words").cast("int").alias("end"))), F.array().cast(SPANS)
    joined = texts.select("blob", "rep", "single", "n_words").join(spans, "blob", "left").where("repeated is not null or not single")
    return joined.select("blob", "rep", "n_words", F.when(F.col("single"), F.col("repeated")).otherwise(whole).alias("repeated"), F.coalesce("cut", none).alias("cut"))


def _by_row(docs: DataFrame, found: DataFrame) -> DataFrame:
    """Rows of docs (doc_id, blob, more) that have a passage, with repeated and cut; a later copy of a text is cut whole."""
    whole = F.array(F.struct(F.lit(0).alias("start"), F.col("n_words").cast("int").alias("end")))
    first = F.col("doc_id").cast("long").eqNullSafe(F.col("rep"))
    return docs.join(found, "blob", "left").withColumn("cut", F.when(first, F.col("cut")).when(F.col("repeated").isNotNull(), whole)).drop("rep", "n_words")


def repeated_passages(docs: DataFrame, min_words: int = MIN_WORDS, gram: int = GRAM, crowd: int = CROWD) -> DataFrame:
    """Per row of docs (doc_id, text) that holds a repeated passage: doc_id, repeated, cut.

    Both are lists of maximal runs of words (end exclusive). repeated: covered by windows of min_words words
    that are in the corpus twice or more. cut: covered by those that are not the first of their kind, by
    doc_id, text and place, so removing cut from all documents leaves one copy of each passage.
    """
    rows = docs.select(F.col("doc_id").cast("long"), _blob().alias("blob"))
    return _by_row(rows, _by_text(docs, min_words, gram, crowd)).where("repeated is not null").select("doc_id", "repeated", "cut")


def cut_repeats(docs: DataFrame, min_words: int = MIN_WORDS, gram: int = GRAM, crowd: int = CROWD) -> DataFrame:
    """docs without all but the first copy of each repeated passage; documents left without a word go."""
    kind, names = docs.schema, docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            w = words(part.column("text"))
            texts, keep = [], []
            for d, spans in enumerate(part.column("__cut")):
                spans, first, last = spans.as_py(), w.first[d], w.first[d + 1]
                text = part.column("text")[d].as_py()
                if spans:
                    at, pieces = w.offsets[d], []
                    for s in spans:
                        pieces.append(w.data[at : w.start[first + s["start"]]])
                        at = w.start[first + s["end"]] if first + s["end"] < last else w.offsets[d + 1]
                    text = np.concatenate([*pieces, w.data[at : w.offsets[d + 1]]]).tobytes().decode()
                texts.append(text)
                keep.append(not spans or bool(text.strip(" \t\n\v\f\r")))
            rows = part.drop_columns(["__cut"]).set_column(part.schema.get_field_index("text"), pa.field("text", pa.string()), pa.array(texts, pa.string()))
            yield rows.filter(pa.array(keep))

    found = _by_text(docs, min_words, gram, crowd)
    rows = _by_row(docs.select(F.struct(*names).alias("row"), F.col("doc_id"), _blob().alias("blob")), found).select("row.*", F.col("cut").alias("__cut"))
    return rows.mapInArrow(run, kind)
