"""Queries of parsers over the test tables, each with SQL that gives the same rows: parts and customers as statements, proofs, replies and diagnostics."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.functions import brackets, parse
from quarry.plans.queries import query
from quarry.plans.views import table

#: Fixed texts; {k} is a number of the row, {z} its remainder by 7.
_STATEMENTS = (
    "theorem t{k} (x y : ℕ) (h : x + {z} > (3 + y)) (g : (f (x) = 2)) : x > {z} := by simp",
    "lemma u{k} {a : ℤ} [Field R] (ha : a ∣ {k}) (unused : a ≠ 0) : a ∣ {k} * b := by exact ha",
    "theorem v{k} : {k} = {k} := by rfl",
)
_PROOFS = (
    "intro x\n-- a note\nhave h1 : a = b := by simp\nhave h2 : b = c := by rw [h1]; exact Nat.succ_le {k}\n/- have none -/\nlinarith [h1, h2]",
    "by omega",
    "sorry",
    "constructor\n· norm_num\n· exact Polynomial.degree_eq h{z}",
)
_LOGS = (
    "A.lean:{k}:3: error: unsolved goals\nx : ℕ\n⊢ x > 1\nA.lean:9:1: warning: unused",
    "B.lean:1:{z}: error: unknown identifier 'foo{k}'",
    "C.lean:2:2: info: all is well",
)
_REPLIES = (
    'I say {"decision": "drop", "level": "weak", "reason": "number {k}"} and no more',
    "no verdict\n```lean\ntheorem a{k} : 1 = 1\n```\nand\n```\nby simp\n```\n",
    "The answer is \\boxed{{z}} of {k}",
    "Sum of 3 and {z}\n#### {k}",
)
_ASKED = (
    "Find the greatest common divisor of {k} and 12.", "What is the units digit of 7^{k}?", "Find the sum of the divisors of {k}.", "What remainder does {k} leave on division by 9?",
    "How many nonnegative integer solutions has a + b = {k}?", "The arithmetic sequence has {k} terms.", "Nothing of note, {k}.",
)


def _filled(texts: tuple[str, ...]):
    k = F.col("p_partkey")
    one = F.element_at(F.array(*map(F.lit, texts)), (k % len(texts) + 1).cast("int"))
    return F.replace(F.replace(one, F.lit("{k}"), k.cast("string")), F.lit("{z}"), (k % 7).cast("string"))


def _sql(texts: tuple[str, ...]) -> str:
    quoted = ", ".join("'" + t.replace("'", "''") + "'" for t in texts)
    return f"replace(replace(([{quoted}])[p_partkey % {len(texts)} + 1], '{{k}}', p_partkey::VARCHAR), '{{z}}', (p_partkey % 7)::VARCHAR)"


def _parts(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey")


_Q = lambda p: "'" + p.replace("'", "''") + "'"
#: For SQL: a binder whose type has brackets up to two deep, as these templates have.
_NESTED = r"(?:[^(){}\[\]]|\((?:[^()]|\([^()]*\))*\))*"
_BINDER = rf"[({{\[]\s*([^(){{}}\[\]:]+?)\s*:\s*({_NESTED})\s*[)}}\]]"
_BARE = r"regexp_replace(regexp_replace({x}, '(?s)/-.*?-/', '', 'g'), '--[^\n]*', '', 'g')"


@query(rf"""WITH s AS (SELECT p_partkey, split_part({_sql(_STATEMENTS)}, ':=', 1) AS h, {_BARE.format(x=_sql(_PROOFS))} AS c FROM part),
b AS (SELECT *, list_zip(regexp_extract_all(h, {_Q(_BINDER)}, 1), list_transform(regexp_extract_all(h, {_Q(_BINDER)}, 2), lambda t: regexp_replace(trim(t), '\s+', ' ', 'g'))) AS b FROM s),
y AS (SELECT *, list_filter(b, lambda z: regexp_matches(z[2], {_Q(brackets.PROPOSITION)})) AS hyp, regexp_extract_all(concat_ws(' ', regexp_replace(h, {_Q(_BINDER)}, ' ', 'g'), c), '[A-Za-z_][A-Za-z0-9_'']*') AS w FROM b)
SELECT p_partkey, array_to_string(list_transform(b, lambda z: z[1] || ' : ' || z[2]), '; ') AS binders, array_to_string(list_transform(hyp, lambda z: z[1] || ' : ' || regexp_replace(z[2], '^\(([^()]*)\)$', '\1')), '; ') AS hypotheses,
array_to_string(list_filter(flatten(list_transform(hyp, lambda z: string_split_regex(z[1], '\s+'))), lambda n: NOT list_contains(w, n)), ',') AS idle FROM y""")
def statement_binders(spark, sf_dir):
    shown = lambda c: F.array_join(F.transform(c, lambda b: F.concat(F.array_join(b["names"], " "), F.lit(" : "), b["type"])), "; ")
    rows = _parts(spark, sf_dir).select("p_partkey", _filled(_STATEMENTS).alias("s"), _filled(_PROOFS).alias("c")).withColumn("x", brackets.parts("s"))
    idle = brackets.unmentioned(F.col("s"), F.col("x"), F.col("c"))
    return rows.select("p_partkey", shown(F.col("x.binders")).alias("binders"), shown(brackets.propositions(F.col("x"))).alias("hypotheses"), F.array_join(idle, ",").alias("idle"))


_LIST = lambda names: "[" + ", ".join(f"'{n}'" for n in names) + "]"


@query(rf"""WITH s AS (SELECT p_partkey, {_BARE.format(x=_sql(_PROOFS))} AS c FROM part),
t AS (SELECT *, list_filter(list_transform(string_split_regex(c, '\n|;|<;>'), lambda l: regexp_extract(l, '^[\s·]*(?:by\s+)?([a-z_]+)', 1)), lambda x: list_contains({_LIST(parse.TACTICS)}, x)) AS t,
trim(regexp_replace(c, '\s+', ' ', 'g')) AS bare, string_split_regex(c, '\bhave\s+')[2:] AS blocks FROM s),
n AS (SELECT *, list_transform(blocks, lambda b: regexp_extract(b, '^([A-Za-z_][A-Za-z0-9_'']*)', 1)) AS names FROM t)
SELECT p_partkey, array_to_string(list_filter(t, lambda x, i: list_position(t, x) = i), ',') AS tactics, bare = '' OR regexp_matches(bare, '^(:= )?(by )?(sorry|admit|trivial|rfl)$') OR regexp_matches(bare, ': True\b') AS stub,
array_to_string(list_transform(blocks, lambda b, i: names[i] || '<-' || array_to_string(list_filter(names, lambda m: m <> names[i] AND list_contains(regexp_extract_all(b, '[A-Za-z_][A-Za-z0-9_'']*'), m)), '+')), ',') AS graph,
array_to_string(list_sort(list_distinct(regexp_extract_all(c, '\b[A-Z][A-Za-z0-9_]*(?:\.[A-Za-z0-9_'']+)+'))), ',') AS premises FROM n""")
def proof_structure(spark, sf_dir):
    """Tactics, stubs, the graph of steps and library names of proofs."""
    c = _filled(_PROOFS)
    graph = F.transform(parse.proof_nodes(c), lambda n: F.concat(n["name"], F.lit("<-"), F.array_join(F.array_sort(n["uses"]), "+")))
    return _parts(spark, sf_dir).select("p_partkey", F.array_join(parse.tactics(c), ",").alias("tactics"), parse.is_stub(c).alias("stub"), F.array_join(graph, ",").alias("graph"), F.array_join(parse.premises(c), ",").alias("premises"))


@query(rf"""WITH s AS (SELECT p_partkey, {_sql(_LOGS)} AS l FROM part),
m AS (SELECT p_partkey, l, list_transform(string_split(regexp_replace(l, '(?m)^[^\s:]+:(\d+):(\d+): (error|warning|info): ', chr(1) || '\1' || chr(2) || '\2' || chr(2) || '\3' || chr(2), 'g'), chr(1))[2:], lambda p: string_split(p, chr(2))) AS m FROM s)
SELECT p_partkey, array_to_string(list_transform(m, lambda p: p[1] || ':' || p[2] || ' ' || p[3] || ' ' || trim(regexp_replace(p[4], '\n+$', ''))), '|') AS messages,
CASE WHEN len(list_filter(m, lambda p: p[3] = 'error')) = 0 THEN 'solved' WHEN len(list_filter(m, lambda p: p[3] = 'error' AND NOT starts_with(p[4], 'unsolved goals'))) = 0 THEN 'active' ELSE 'rejected' END AS state,
regexp_matches(lower(l), {_Q(parse.LOOK_UP)}) AS look_up FROM m""")
def diagnostics(spark, sf_dir):
    """Diagnostics folded into messages, the state that they leave, and whether premises should be looked for."""
    log = _filled(_LOGS)
    found = parse.messages(log)
    shown = F.transform(found, lambda m: F.concat(m["line"].cast("string"), F.lit(":"), m["column"].cast("string"), F.lit(" "), m["severity"], F.lit(" "), m["body"]))
    return _parts(spark, sf_dir).select("p_partkey", F.array_join(shown, "|").alias("messages"), parse.state_of(found).alias("state"), parse.wants_retrieval(log).alias("look_up"))


@query(rf"""WITH s AS (SELECT p_partkey, {_sql(_REPLIES)} AS r, (['boxed', 'hash', 'last_number'])[p_partkey % 3 + 1] AS how FROM part),
j AS (SELECT *, nullif(regexp_extract(r, '(?s)(\{{[^{{}}]*\}})', 1), '') AS j, regexp_extract_all(r, '```[a-z0-9]*\n([^`]*)```', 1) AS b, regexp_extract_all(r, '-?\d+') AS n, regexp_extract_all(r, 'boxed\{{([^{{}}]*)\}}', 1) AS x FROM s),
v AS (SELECT *, CASE WHEN json_valid(j) THEN j END AS o FROM j)
SELECT p_partkey, coalesce(o ->> '$.decision', 'keep') || '/' || coalesce(o ->> '$.level', 'acceptable') || '/' || left(coalesce(o ->> '$.reason', ''), 400) AS verdict,
CASE WHEN len(b) > 0 THEN trim(regexp_replace(b[-1], '\n+$', '')) ELSE trim(r) END AS block, coalesce(CASE how WHEN 'boxed' THEN x[-1] WHEN 'hash' THEN nullif(regexp_extract(r, '####\s*(\S+)', 1), '') END, n[-1]) AS answer FROM v""")
def replies(spark, sf_dir):
    """Verdicts, code blocks and answers in what models write."""
    r, how = _filled(_REPLIES), F.element_at(F.array(F.lit("boxed"), F.lit("hash"), F.lit("last_number")), (F.col("p_partkey") % 3 + 1).cast("int"))
    v = parse.verdict(r)
    return _parts(spark, sf_dir).select("p_partkey", F.concat_ws("/", v["decision"], v["level"], v["reason"]).alias("verdict"), parse.code_block(r).alias("block"), parse.answer(r, how).alias("answer"))


@query(f"WITH s AS (SELECT lower({_sql(_ASKED)}) AS s FROM part) SELECT CASE " + " ".join(f"WHEN regexp_matches(s, {_Q(p)}) THEN '{n}'" for n, p in parse.FAMILIES) + " END AS family, count(*) AS n FROM s GROUP BY 1")
def family_of_statement(spark, sf_dir):
    return _parts(spark, sf_dir).groupBy(parse.family(_filled(_ASKED)).alias("family")).agg(F.count("*").alias("n"))


@query(f"""WITH a AS (SELECT p_partkey, CASE WHEN p_size % 5 <> 0 THEN list_filter(['propext', CASE WHEN p_size % 2 = 0 THEN 'Quot.sound' END, CASE WHEN p_size % 3 = 0 THEN 'sorryAx' END], lambda x: x IS NOT NULL) END AS c FROM part)
SELECT c IS NOT NULL AS ran, len(list_filter(c, lambda x: NOT list_contains({_LIST(parse.ALLOWED_AXIOMS)}, x))) = 0 AS passed, count(*) AS n FROM a GROUP BY ALL""")
def axiom_audit(spark, sf_dir):
    size = F.col("p_size")
    closure = F.when(size % 5 != 0, F.array_compact(F.array(F.lit("propext"), F.when(size % 2 == 0, "Quot.sound"), F.when(size % 3 == 0, "sorryAx"))))
    ran, passed = parse.axiom_audit(closure)
    return table(spark, sf_dir, "part").groupBy(ran.alias("ran"), passed.alias("passed")).agg(F.count("*").alias("n"))


@query("""WITH x AS (SELECT p_partkey AS k, CASE WHEN p_partkey % 5 = 0 THEN 'gcd' ELSE 'sum' END AS fam, p_partkey % 7 = 0 AS lacks, CASE WHEN p_partkey % 3 = 0 THEN 9 ELSE 4 END AS a, p_partkey % 2 = 0 AS mixed, p_partkey % 11 < 6 AS said FROM part)
SELECT k AS p_partkey, CASE WHEN fam <> 'sum' THEN 'family' WHEN lacks THEN 'missing_param' WHEN a <> 4 THEN 'changed_param' WHEN mixed AND NOT said THEN 'no_evidence' END AS violation FROM x""")
def contract_violation(spark, sf_dir):
    k = F.col("p_partkey")
    parent = F.struct(F.lit("sum").alias("family"), F.create_map(F.lit("a"), F.lit(4), F.lit("b"), F.lit(1)).alias("params"))
    params = F.when(k % 7 == 0, F.create_map(F.lit("a"), F.lit(4))).when(k % 3 == 0, F.create_map(F.lit("a"), F.lit(9), F.lit("b"), F.lit(2))).otherwise(F.create_map(F.lit("a"), F.lit(4), F.lit("b"), F.lit(2)))
    said = F.when(k % 11 < 6, F.create_map(F.lit("p"), F.lit("taken"), F.lit("q"), F.lit("both"))).otherwise(F.create_map(F.lit("p"), F.lit("taken"), F.lit("q"), F.lit("")))
    child = F.struct(F.when(k % 5 == 0, "gcd").otherwise("sum").alias("family"), params.alias("params"), F.when(k % 2 == 0, "crossover").otherwise("mutation").alias("operator"), F.array(F.lit("p"), F.lit("q")).alias("parents"), said.alias("evidence"))
    rows = table(spark, sf_dir, "part").select("p_partkey", parent.alias("parent"), child.alias("child"))
    return rows.select("p_partkey", parse.violation(F.col("parent"), F.col("child"), ["a"]).alias("violation"))
