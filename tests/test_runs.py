"""Streams of cells, parts of campaigns, frozen bundles and premise payloads."""

import gzip
import json
import time

import pytest
from pyspark.sql import functions as F, types as T

from quarry.operators import partials
from quarry.sources import bundles, premises
from quarry.streaming import cells, online


def until(writer, seen):
    """Timers by the clock keep a query busy for ever: it is stopped when it has written what is waited for."""
    query = writer.start()
    try:
        end = time.time() + 90
        while not seen():
            assert time.time() < end and query.exception() is None
            time.sleep(0.3)
    finally:
        query.stop()


def put(path, name, rows):
    (path / name).write_text("".join(json.dumps(dict(zip(("cell", "id", "bad", "at"), r, strict=True))) + "\n" for r in rows))


def ran(writer):
    query = writer.trigger(availableNow=True).start()
    try:
        assert query.awaitTermination(120)
    finally:
        query.stop()


SCHEMA = T.StructType([T.StructField("cell", T.StringType()), T.StructField("id", T.StringType()), T.StructField("bad", T.BooleanType()), T.StructField("at", T.IntegerType())])


def test_a_restarted_run_gives_each_record_once(spark, tmp_path):
    (tmp_path / "in").mkdir()
    put(tmp_path / "in", "a.json", [("c", "x", False, 1), ("c", "y", True, 2), ("c", "x", False, 3)])
    start = lambda: cells.append_once(online.episode_stream(spark, str(tmp_path / "in"), SCHEMA, 1), str(tmp_path / "out"), str(tmp_path / "check"), ["cell", "id"])
    ran(start())
    put(tmp_path / "in", "b.json", [("c", "y", True, 4), ("c", "z", True, 5), ("d", "x", False, 6)])
    ran(start())
    ran(start())
    assert sorted((r.cell, r.id) for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [("c", "x"), ("c", "y"), ("c", "z"), ("d", "x")]


def test_cells_give_up_and_close(spark, tmp_path):
    cells.state_store(spark)
    try:
        (tmp_path / "in").mkdir()
        (tmp_path / "out").mkdir()
        start = lambda idle: cells.cell_runs(online.episode_stream(spark, str(tmp_path / "in"), SCHEMA, 1), "cell", "bad", "at", 3, idle).writeStream.format("json").outputMode("append").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "check"))
        result = lambda: [(r.cell, r.event, r.n, r.failures, r.streak) for r in spark.read.schema("cell string, event string, n long, failures long, streak long").json(str(tmp_path / "out")).collect()]
        put(tmp_path / "in", "a.json", [("c", "1", True, 2), ("c", "0", False, 1), ("c", "2", True, 3), ("d", "0", None, 1)])
        until(start(600_000), lambda: len(result()) == 2)
        assert set(result()) == {("c", "progress", 3, 2, 2), ("d", "progress", 1, 0, 0)}
        put(tmp_path / "in", "b.json", [("c", "3", True, 4), ("c", "4", True, 5)])
        until(start(1), lambda: ("c", "closed", 5, 4, 4) in result())  # goes on from the state of the first run
        assert set(result()) == {("c", "progress", 3, 2, 2), ("d", "progress", 1, 0, 0), ("c", "progress", 5, 4, 4), ("c", "abort", 5, 4, 4), ("c", "closed", 5, 4, 4)} and len(result()) == 5
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def test_parts_merge_to_the_whole(spark, tmp_path):
    rows = spark.range(5000).select((F.col("id") % 3).alias("g"), (F.col("id") % 2 == 0).alias("ok"), F.when(F.col("id") % 5 == 0, F.col("id") % 4 == 0).alias("seen"), (F.col("id") % 700).alias("seed"))
    of = lambda df: partials.partial(df, ["g"], ["ok", "seen"], "seed")
    path = str(tmp_path / "parts")
    for name, part in (("a", rows.where("seed < 100")), ("b", rows.where("seed >= 650")), ("b", rows.where("seed >= 100"))):
        partials.add_campaign(spark, path, name, of(part))
    got = partials.rates(partials.all_campaigns(spark, path, ["g"]), ["ok", "seen"]).orderBy("g").collect()
    want = partials.rates(of(rows), ["ok", "seen"]).orderBy("g").collect()
    assert [r.asDict() for r in got] == [r.asDict() for r in want] and all(abs(r.n_ids - 700) <= 14 for r in got)
    none = partials.rates(of(rows.withColumn("seen", F.lit(None).cast("boolean"))), ["ok", "seen"]).first()
    assert none.rate_seen is None and none.known_seen == 0


def test_damaged_bundles_have_no_rows(spark, tmp_path):
    path, rows = str(tmp_path / "frozen"), spark.createDataFrame([(c, i, f"v{i}") for c in ("a", "b", "c", "d") for i in range(50)], "cell string, n int, v string")
    bundles.freeze(rows, path, ["cell"])
    with pytest.raises(Exception, match="(?i)exists"):
        bundles.freeze(rows, path, ["cell"])
    expected = spark.createDataFrame(bundles.manifest(spark, path).collect())
    schema = T.StructType.fromDDL("n int, v string")
    found, state = bundles.read_frozen(spark, path, expected, schema)
    assert found.count() == 200 and {r.state for r in state.collect()} == {"ok"}
    for check in (tmp_path / "frozen").rglob("*.crc"):  # of this file system, which would see the damage first
        check.unlink()
    (b,), (c,) = ((tmp_path / "frozen" / f"cell={x}").glob("*.gz") for x in "bc")
    b.write_bytes(b.read_bytes()[:-9] + b"123456789")
    c.unlink()
    (tmp_path / "frozen" / "cell=e").mkdir()
    with gzip.open(tmp_path / "frozen" / "cell=e" / "new.json.gz", "wt") as f:
        f.write('{"n": 1}\n')
    found, state = bundles.read_frozen(spark, path, expected, schema)
    assert sorted({r._source_file.split("/")[0] for r in found.collect()}) == ["cell=a", "cell=d"] and found.count() == 100
    assert {r.file.split("/")[0][-1]: r.state for r in state.collect()} == {"a": "ok", "b": "changed", "c": "missing", "d": "ok", "e": "new"}


def test_bundles_of_several_members(monkeypatch):
    monkeypatch.setattr(bundles, "LINES", 3)
    content = gzip.compress(b"a\nb\n\nc") + gzip.compress(b"d\n" + b"x" * 200_000 + b"\nlast")
    assert [x for lines in bundles._lines(content) for x in lines] == ["a", "b", "", "cd", "x" * 200_000, "last"]
    assert [x for lines in bundles._lines(gzip.compress(b"a\nb\nc\n")[:-12]) for x in lines][:1] in ([], ["a"])


def test_premise_payloads(spark):
    item = {"name": ["Nat", " ", "succ_le"], "module_name": "M", "kind": "theorem", "docstring": "d", "value": None}
    payloads = [[item, {"result": {"name": " x "}}, {"result": None, "name": "y"}, {"name": ""}, 3, {"result": [1]}], [[item]], [[item], [item]], {"name": "a"}, []]
    rows = spark.createDataFrame([*[(i, json.dumps(p)) for i, p in enumerate(payloads)], (9, None), (10, "no json")], "id long, payload string")
    got = [(r.id, r.place, r.name, r.module_name, r.kind, r.informal_description, r.value) for r in premises.premises(rows, "id", "payload").orderBy("id", "place").collect()]
    first = ("Nat.succ_le", "M", "theorem", "d", "")
    assert got == [(0, 0, *first), (0, 1, "x", "", "", "", ""), (0, 2, "y", "", "", "", ""), (1, 0, *first)]
