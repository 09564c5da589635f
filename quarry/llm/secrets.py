"""Secret scans with an incremental blob ledger, with DataFrame functions only.

Every version of every path is addressed by the SHA-256 of its text, its blob. The ledger has a row for each blob
and rule version that has been scanned, with its findings or none, and is kept as a table. A scan finds the blobs that
lack a rule by one anti-join of digests, fetches each of these texts once, however many paths and versions have the blob, scans it
for the rules that it lacks, and appends the new rows; findings are joined back to all paths. A rule whose pattern changes
gets a new version and is the only one that is scanned again.

Matches of a rule are leftmost and do not overlap; those that its least length drops are used up all the
same. Their places come from splitting the text at the matches: pieces and matches alternate. Offsets are
code points, ends exclusive.

Rows: null text is empty. Repeated rows and equal texts are one blob. A null path is kept. Extra columns are
ignored. An empty table gives an empty table.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from quarry.llm.scratch import Scratch


@dataclass(frozen=True)
class Rule:
    """pattern: with at most the group `value`, whose length counts; find: a cheap pattern that every text with a match has."""

    kind: str
    version: int
    pattern: str
    least: int
    value: int = 0
    base: bool = True
    find: str | None = None


ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
# No group repeats without a bound, as Java's matcher recurses once for each repeat; runs of one class it takes in a loop.
_KEY = "[A-Z0-9 ]*PRIVATE KEY(?: BLOCK)?-----"
_LINE = r"[\x20\t\r\n\\]+[A-Za-z0-9+/=]{16,}"
# through the END line (its head lines may have hyphens), or, where that is missing, the lines of base64 that follow and a word on the next line; after 62 lines all that can be base64 or between goes with them
PEM = rf"-----BEGIN {_KEY}(?:(?:[^-]*-[A-Za-z0-9]){{0,16}}[^-]*-----END {_KEY}|(?:{_LINE}){{62}}[\x20\t\r\n\\A-Za-z0-9+/=]*|(?:(?:{_LINE}){{1,61}}(?:[\r\n\\]+[A-Za-z0-9+/=]*)?)?)"
RULES = (
    Rule("assign", 1, ASSIGN, 12, 2, find=r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]"""),
    Rule("access", 1, "AKIA[A-Z0-9]{14,}", 18, find="AKIA"),
    Rule("hex", 1, "[0-9a-f]{16,}", 16, find="[0-9a-f]{16}"),
    # the method's own additions: key blocks, signed tokens and prefixed tokens of public services
    Rule("pem", 3, PEM, 20, base=False, find="PRIVATE KEY"),
    Rule("jwt", 1, r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 20, base=False, find="eyJ"),
    Rule("prefixed", 1, "(?:gh[pousr]_|sk_live_|xox[abprs]-)[A-Za-z0-9_-]+", 20, base=False, find="gh[pousr]_|sk_live_|xox[abprs]-"),
)
FOUND = "array<struct<start:int,end:int>>"
#: Matches, or spans, whose places are summed up together.
BLOCK = 256


def matches(text: Column, rule: Rule) -> Column:
    """Places (start, end) of the rule's matches that are long enough.

    Where pieces and matches begin are running sums of their lengths; the sums of one text are made in blocks of BLOCK
    matches, so that a text with very many takes time in proportion to their number, and not to its square.
    """
    pattern = F.lit(rule.pattern)
    pieces, hits = F.split(text, rule.pattern, -1), F.regexp_extract_all(text, pattern, F.lit(0))
    values = F.regexp_extract_all(text, pattern, F.lit(rule.value)) if rule.value else hits
    sizes = F.arrays_zip(F.transform(pieces, F.length).alias("gap"), F.transform(hits, F.length).alias("hit"), F.transform(values, F.length).alias("value"))
    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(sizes) - 1) / BLOCK).cast("int")), lambda i: F.slice(sizes, i * BLOCK + 1, F.lit(BLOCK)))
    begin = F.struct(F.lit(0).alias("at"), F.array().cast("array<array<struct<start:int,end:int>>>").alias("found"))
    start = lambda at: F.struct(at.alias("at"), F.array().cast(FOUND).alias("found"))

    def step(done: Column, x: Column) -> Column:
        begin = done["at"] + x["gap"]
        end = begin + F.coalesce(x["hit"], F.lit(0))
        kept = F.when(x["value"] >= rule.least, F.array(F.struct(begin.alias("start"), end.alias("end")))).otherwise(F.array().cast(FOUND))
        return F.struct(end.alias("at"), F.concat(done["found"], kept).alias("found"))

    def block(done: Column, own: Column) -> Column:
        part = F.aggregate(own, start(done["at"]), step)
        return F.struct(part["at"].alias("at"), F.concat(done["found"], F.array(part["found"])).alias("found"))

    places = F.flatten(F.aggregate(blocks, begin, block)["found"])
    return F.when(text.rlike(rule.find or rule.pattern), places).otherwise(F.array().cast(FOUND))


def scan_blobs(blobs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """blob, kind, version, places: a row for each blob and rule. blobs: blob, text and, if some rules are to be left out, known (array of kind:version)."""
    known = F.col("known") if "known" in blobs.columns else F.array().cast("array<string>")
    each = [F.when(~F.array_contains(known, _name(r)), F.struct(F.lit(r.kind).alias("kind"), F.lit(r.version).alias("version"), matches(F.col("text"), r).alias("places"))) for r in rules]
    return blobs.select("blob", F.explode(F.array(*each)).alias("x")).where("x is not null").select("blob", "x.*")


def _name(rule: Rule) -> str:
    return f"{rule.kind}:{rule.version}"


def update_ledger(versions: DataFrame, ledger: DataFrame | None = None, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The ledger's new rows: pairs of the versions' blobs and of rules that the ledger lacks. versions: path, text, blob.

    A blob's text comes from one of its rows, found by the least path of each blob, so that the ledger's
    joins carry digests and texts travel once.
    """
    first = versions.groupBy("blob").agg(F.min("path").alias("path"))
    if ledger is not None:
        mine = F.concat_ws(":", "kind", "version")
        seen = ledger.where(mine.isin(*map(_name, rules))).groupBy("blob").agg(F.collect_set(mine).alias("known"))
        first = first.join(seen, "blob", "left").where(F.coalesce(F.size("known"), F.lit(0)) < len(rules)).withColumn("known", F.coalesce("known", F.array().cast("array<string>")))
    return scan_blobs(versions.join(first, ["blob", "path"]).drop("path"), rules).distinct()  # rows that share path and text give equal rows


def span_list(spans: Column, order: list[str]) -> Column:
    """kind:start:end by start, then kind as listed, comma-joined."""
    ranked = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.array_position(F.array(*map(F.lit, order)), s["kind"]).alias("rank"), s["end"].alias("end"), s["kind"].alias("kind"))))
    return F.array_join(F.transform(ranked, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def versions_of(docs: DataFrame, path: str = "doc_id", text: str = "text") -> DataFrame:
    """path, text, blob of each row of docs."""
    return docs.select(F.coalesce(F.col(path).cast("string"), F.lit("")).alias("path"), F.coalesce(F.col(text), F.lit("")).alias("text")).withColumn("blob", F.sha2("text", 256))


def _blob_spans(ledger: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """blob, spans (array of kind, start, end): a row for each blob with a finding of these rules in the ledger."""
    found = ledger.where((F.size("places") > 0) & F.concat_ws(":", "kind", "version").isin(*map(_name, rules)))
    each = F.transform("places", lambda p: F.struct("kind", p["start"].alias("start"), p["end"].alias("end")))
    return found.groupBy("blob").agg(F.flatten(F.collect_list(each)).alias("spans"))


def scan(docs: DataFrame, ledger: DataFrame | None = None, rules: tuple[Rule, ...] = RULES, path: str = "doc_id", text: str = "text", scratch: Scratch | None = None) -> tuple[DataFrame, DataFrame]:
    """Per row of docs (path, text): path, blob, spans (array of kind, start, end); and the whole ledger, with what it lacked before."""
    new = (scratch or Scratch(docs.sparkSession)).table(update_ledger(versions_of(docs, path, text), ledger, rules), "ledger")
    whole = new if ledger is None else ledger.unionByName(new)
    rows = docs.select(F.col(path), F.sha2(F.coalesce(F.col(text), F.lit("")), 256).alias("blob"))
    return rows.join(_blob_spans(whole, rules), "blob", "left").select(F.col(path), "blob", F.coalesce("spans", F.array().cast("array<struct<kind:string,start:int,end:int>>")).alias("spans")), whole


def redact(docs: DataFrame, mask: str = "<secret>") -> DataFrame:
    """docs with the spans of every finding replaced by mask; overlapping spans are joined. Rows find their spans by their text's digest, whatever their doc_id."""
    ledger = Scratch(docs.sparkSession).table(update_ledger(versions_of(docs)), "ledger")
    found = _blob_spans(ledger, RULES).select(F.col("blob").alias("__blob"), F.array_sort(F.transform("spans", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end")))).alias("__spans"))
    # the text's parts between spans and the masks for these, in blocks as above; overlapping spans come as a part of no length and no mask
    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size("__spans") - 1) / BLOCK).cast("int")), lambda i: F.slice("__spans", i * BLOCK + 1, F.lit(BLOCK)))
    none = lambda kind: F.array().cast(kind)

    def step(done: Column, s: Column) -> Column:
        piece = F.when(s["start"] >= done["at"], F.concat(F.substring(done["part"], done["at"] - done["base"] + 1, s["start"] - done["at"]), F.lit(mask))).otherwise("")
        return F.struct(F.greatest(done["at"], s["end"]).alias("at"), done["base"].alias("base"), done["part"].alias("part"), F.concat(done["out"], F.array(piece)).alias("out"))

    def block(done: Column, own: Column) -> Column:
        # a block's own part of the text is cut out once, as finding a place in the whole text takes time in proportion to its length
        end = F.aggregate(own, done["at"], lambda n, s: F.greatest(n, s["end"]))
        begin = F.struct(done["at"].alias("at"), done["at"].alias("base"), F.substring(F.col("text"), done["at"] + 1, end - done["at"]).alias("part"), none("array<string>").alias("out"))
        return F.aggregate(own, begin, step, lambda x: F.struct(x["at"].alias("at"), F.concat(done["out"], F.array(F.array_join(x["out"], ""))).alias("out")))

    done = F.aggregate(blocks, F.struct(F.lit(0).alias("at"), none("array<string>").alias("out")), block)
    joined = docs.withColumn("__blob", F.sha2("text", 256)).join(found, "__blob", "left").withColumn("__done", F.when(F.col("__spans").isNotNull(), done))
    clean = F.concat(F.array_join("__done.out", ""), F.expr("substring(text, __done.at + 1)"))
    return joined.withColumn("text", F.when(F.col("__done").isNotNull(), clean).otherwise(F.col("text"))).select(*docs.columns)
