"""The registered queries themselves, against their SQL or their contract, on the smallest tables."""

import hashlib
import os
import zlib
from collections import Counter

import duckdb
import pytest

from quarry.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
COLUMNS = {
    "op1_ngram_jaccard": "doc_id bigint, n_shingles bigint, component_id bigint",
    "op2_merge_dropout": "doc_id bigint, n_pieces bigint, ids_sha256 string, decoded_sha256 string, lossless boolean",
    "op3_language": "doc_id bigint, held_out boolean, lang_pred string, score double",
    "op4_sharding": "doc_id bigint, shard_id string, depth int, shard_bytes bigint, oversized boolean",
    "op5_secret_ledger": "doc_id bigint, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string",
    "op6_repeated_passages": "doc_id bigint, start_word int, end_word int, n_cut_words int",
    "op7_perplexity": "doc_id bigint, lang string, n_tokens bigint, perplexity double, kept boolean",
    "op8_fertility": "doc_id bigint, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, base_failed boolean, kept boolean",
    "op9_media": "doc_id bigint, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string",
    "op10_packing": "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint",
}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"create view {f.split('.')[0]} as select * from '{SF}/{f}'")
    return con


@pytest.fixture(scope="module")
def docs(spark):
    return {r.doc_id: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


@pytest.fixture(scope="module")
def result(spark):
    done = {}

    def run(name):
        if name not in done:
            df = QUERIES[name](spark, SF)
            done[name] = df.columns, [f"{f.name} {f.dataType.simpleString()}" for f in df.schema], df.collect()
        return done[name]

    return run


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_columns_and_documents(result, docs, name):
    _, kinds, rows = result(name)
    assert set(COLUMNS.get(name, "").split(", ")) - {""} <= set(kinds)
    if name in COLUMNS and name not in ("op6_repeated_passages", "op10_packing"):
        assert Counter(r.doc_id for r in rows) == Counter(list(docs))
    assert rows


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows_as_sql(result, duck, name):
    columns, _, rows = result(name)
    found = duck.execute(ORACLES[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == sorted(columns)
    assert Counter(tuple(r[c] for c in names) for r in rows) == Counter(found.fetchall())


def test_encoding_is_lossless(result, docs):
    for r in result("op2_merge_dropout")[2]:
        assert r.lossless and r.decoded_sha256 == hashlib.sha256(docs[r.doc_id].text.encode()).hexdigest() and r.n_pieces > 0


def test_held_out(result):
    for r in result("op3_language")[2]:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2)


def test_base_digest(result):
    for r in result("op5_secret_ledger")[2]:
        base = [x for x in r.spans.split(",") if x.split(":")[0] in ("assign", "access", "hex")]
        assert r.base_sha256 == hashlib.sha256(",".join(base).encode()).hexdigest()
        assert Counter(x.split(":")[0] for x in base) == Counter({k: n for k, n in (("assign", r.n_assign), ("access", r.n_access), ("hex", r.n_hex)) if n})


def test_passages_are_there_twice(result, docs):
    """Each span's first window of 50 words is in some other place, and what is cut lies in spans."""
    where = Counter()
    split = {i: (d.text or "").split() for i, d in docs.items()}
    for w in split.values():
        where.update(tuple(w[p : p + 50]) for p in range(len(w) - 49))
    for r in result("op6_repeated_passages")[2]:
        assert where[tuple(split[r.doc_id][r.start_word : r.start_word + 50])] > 1
        assert 0 <= r.n_cut_words <= r.end_word - r.start_word
