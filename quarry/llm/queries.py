"""The registered queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

WORD = r"[^\x20\x09-\x0D]+"


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quarry.llm.ngram_join import ngram_jaccard_join

    return ngram_jaccard_join(_documents(spark, sf_dir), k=4, pct=85).select("doc_id", "n_shingles", "component_id")


def op6_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quarry.llm.passages import repeated_passages

    spans = repeated_passages(_documents(spark, sf_dir))
    cut = F.aggregate("cut", F.lit(0), lambda n, c: n + F.greatest(F.lit(0), F.least(c["end"], F.col("span.end")) - F.greatest(c["start"], F.col("span.start"))))
    return spans.select("doc_id", F.explode("repeated").alias("span"), "cut").select(
        "doc_id", F.col("span.start").alias("start_word"), F.col("span.end").alias("end_word"), cut.alias("n_cut_words")
    )


def _vocabulary(name: str) -> str:
    """Where a public vocabulary's file is on this machine; QUARRY_TOKENIZERS names another folder."""
    import os

    if folder := os.environ.get("QUARRY_TOKENIZERS"):
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)


def WORD_BPE() -> str:  # noqa: N802
    return _vocabulary("word_bpe_49k.json")


def FERTILITY() -> list[str]:  # noqa: N802
    return [_vocabulary("piece_bpe_32k.model"), _vocabulary("byte_bpe_multi_50k.tiktoken")]


def op2_merge_dropout(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quarry.llm.pieces import decode, encode

    model = _vocabulary("piece_bpe_32k.model")
    both = decode(encode(_documents(spark, sf_dir).select("doc_id", "text"), model, rate=0.1, seed=1), model)
    return both.select(
        "doc_id", F.coalesce(F.size("ids"), F.lit(0)).cast("long").alias("n_pieces"), F.sha2(F.array_join("ids", " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"), F.col("decoded").eqNullSafe(F.col("text")).alias("lossless"),
    )


def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quarry.llm.language import identify, learn

    docs = _documents(spark, sf_dir)
    held_out = F.crc32(F.col("doc_id").cast("string")) % 4 == 2
    parsers = learn(docs.where(~held_out).select("text", "lang"))
    return identify(docs, parsers).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quarry.llm.sharding import shard_directory

    return shard_directory(_documents(spark, sf_dir), limit=1 << 20)


def op5_secret_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quarry.llm.scratch import Scratch
    from quarry.llm.secrets import RULES, scan, span_list, update_ledger, versions_of

    kinds, base = [r.kind for r in RULES], [r.kind for r in RULES if r.base]
    docs = _documents(spark, sf_dir)
    # an earlier state of the history: one half of the paths, scanned before one rule was there; the scan of all rows then takes unseen pairs only
    before = versions_of(docs.where(F.crc32(F.col("doc_id").cast("string")) % 2 == 0))
    ledger = Scratch(spark).table(update_ledger(before, rules=RULES[:-1]), "earlier")
    found, _ = scan(docs, ledger)
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select(
        "doc_id", *map(count, base), F.sha2(span_list(F.filter("spans", lambda s: s["kind"].isin(base)), kinds), 256).alias("base_sha256"), span_list(F.col("spans"), kinds).alias("spans")
    )


def op7_perplexity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quarry.llm.perplexity import classify

    return classify(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op8_fertility(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quarry.llm.fertility import quality_rules

    return quality_rules(_documents(spark, sf_dir), FERTILITY())


def op9_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quarry.llm.media import document_media

    return document_media(_documents(spark, sf_dir))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quarry.llm.packing import pack

    return pack(_documents(spark, sf_dir), WORD_BPE(), with_ids=False)


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quarry.llm.collocations import collocations

    return collocations(_documents(spark, sf_dir)).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op12_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quarry.llm.neighbours import build_index, search

    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return search(build_index(vectors), vectors.where(F.col("vec_id") % 50 == 0))


def op13_lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quarry.llm.lexical import rank

    return rank(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select("item_id", "rank", "doc_id", "score")


_ASCII_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP1_SQL = f"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({_ASCII_LOWER}, '{WORD}') AS w FROM documents),
g AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
        ELSE list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
b AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS o FROM g x JOIN g y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM b JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * o >= 85 * (x.n + y.n - o)),
r AS (SELECT doc_id, doc_id AS other FROM documents UNION SELECT r.doc_id, l.b FROM r JOIN l ON r.other = l.a)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id FROM documents d LEFT JOIN n USING (doc_id)
JOIN (SELECT doc_id, min(other) AS component_id FROM r GROUP BY doc_id) c USING (doc_id)
"""

OP4_SQL = f"""
WITH r AS (SELECT doc_id, ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT AS h, coalesce(strlen(text), 0) AS bytes FROM documents),
e AS (SELECT doc_id, bytes, d AS depth, h >> (32 - d) AS prefix FROM r, range(0, 33) t(d)),
s AS (SELECT depth, prefix, sum(bytes) AS shard_bytes FROM e GROUP BY ALL),
f AS (SELECT e.doc_id, e.depth, e.prefix, s.shard_bytes FROM e JOIN s USING (depth, prefix) WHERE s.shard_bytes <= {1 << 20} OR depth = 32
      QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY e.depth) = 1)
SELECT doc_id, CASE WHEN depth = 0 THEN 'root' ELSE right(bin(prefix + (1::BIGINT << depth::BIGINT)), depth::INT) END AS shard_id,
  depth::INT AS depth, shard_bytes::BIGINT AS shard_bytes, shard_bytes > {1 << 20} AS oversized FROM f
"""

OP11_SQL = f"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex({_ASCII_LOWER}, '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS w FROM p),
n AS (SELECT lang, sum(len(w))::BIGINT AS n FROM w GROUP BY lang),
o AS (SELECT lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) AS phrase FROM w, range(1, 5) t(k)),
g AS MATERIALIZED (SELECT lang, k, phrase, count(*) AS f FROM o GROUP BY ALL HAVING count(*) >= 30),
c AS (SELECT lang, phrase, f AS a, k, string_split(phrase, ' ') AS w FROM g WHERE k > 1),
u AS (SELECT lang, phrase, a, i, array_to_string(w[1:i], ' ') AS one, array_to_string(w[i + 1:], ' ') AS rest FROM (SELECT *, unnest(range(1, k)) AS i FROM c)),
s AS (SELECT u.*, x.f AS l, y.f AS r, (2000000::HUGEINT * u.a) // (x.f + y.f) AS score FROM u JOIN g x ON x.lang = u.lang AND x.phrase = u.one JOIN g y ON y.lang = u.lang AND y.phrase = u.rest),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, i) = 1),
h AS (SELECT lang, array_to_string(w[i:i + m - 1], ' ') AS phrase, max(a) AS around FROM (SELECT *, unnest(range(1, k - m + 2)) AS i FROM (SELECT *, unnest(range(2, k)) AS m FROM c)) GROUP BY ALL),
k AS (SELECT b.* FROM b LEFT JOIN h USING (lang, phrase) WHERE coalesce(100 * around < 80 * a, true)),
r AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM k)
SELECT lang, rank, phrase, a, l, r, n, score::BIGINT AS score FROM r JOIN n USING (lang) WHERE rank <= 2000
"""

_TERMS = r"regexp_extract_all(" + _ASCII_LOWER + r", '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"

OP13_SQL = f"""
WITH t AS (SELECT doc_id, unnest({_TERMS}) AS term FROM documents), d AS (SELECT doc_id, count(*) AS n FROM t GROUP BY doc_id),
f AS (SELECT term, doc_id, count(*) AS tf FROM t GROUP BY ALL), s AS (SELECT count(*) AS docs, sum(n)::BIGINT AS terms FROM d),
w AS (SELECT term, floor(1000 * ln((2 * docs + 2) / (2 * count(*) + 1)))::BIGINT AS w FROM f, s GROUP BY term, docs),
m AS (SELECT doc_id, 25 + (75 * n * docs) // terms AS m FROM d, s), q AS (SELECT item_id, unnest({_TERMS}) AS term FROM benchmark),
r AS (SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * m)))::BIGINT AS score FROM q JOIN w USING (term) JOIN f USING (term) JOIN m USING (doc_id) GROUP BY ALL HAVING score > 0)
SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INT AS rank, doc_id, score FROM r QUALIFY rank <= 10
"""


def _secret_sql() -> str:
    from quarry.llm.secrets import RULES

    parts = []
    for rank, r in enumerate(RULES):
        p = r.pattern.replace("'", "''")
        parts.append(f"""
        SELECT doc_id, '{r.kind}' AS kind, {rank} AS rank, {str(r.base).lower()} AS base, start, start + hit AS "end" FROM (
          SELECT doc_id, unnest(list_transform(range(1, len(h) + 1), lambda i: {{'start': list_sum(list_transform(g[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(h[1:i - 1], lambda x: length(x))), 0),
            'hit': length(h[i]), 'value': length(v[i])}}), recursive := true)
          FROM (SELECT doc_id, string_split_regex(t, '{p}') AS g, regexp_extract_all(t, '{p}') AS h, regexp_extract_all(t, '{p}', {r.value}) AS v FROM d)) WHERE value >= {r.least}""")
    return f"""
    WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), m AS ({' UNION ALL '.join(parts)}),
    a AS (SELECT doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
      coalesce(string_agg(kind || ':' || start::BIGINT || ':' || "end"::BIGINT, ',' ORDER BY start, rank) FILTER (base), '') AS b,
      string_agg(kind || ':' || start::BIGINT || ':' || "end"::BIGINT, ',' ORDER BY start, rank, "end") AS spans FROM m GROUP BY doc_id)
    SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(b, '')) AS base_sha256, coalesce(spans, '') AS spans
    FROM d LEFT JOIN a USING (doc_id)
    """


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_ngram_jaccard, op2_merge_dropout, op3_language, op4_sharding, op5_secret_ledger, op6_repeated_passages, op7_perplexity, op8_fertility, op9_media, op10_packing, op11_collocations, op12_neighbours, op13_lexical)
}
ORACLES: dict[str, str] = {"op1_ngram_jaccard": OP1_SQL, "op4_sharding": OP4_SQL, "op5_secret_ledger": _secret_sql(), "op11_collocations": OP11_SQL, "op13_lexical": OP13_SQL}
