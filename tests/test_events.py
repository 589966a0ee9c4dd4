import datetime

import pytest
from pyspark.sql import functions as F

from stratalog.operators import events as ev
from stratalog.operators import order, provenance
from stratalog.schemas import EVENTS

from .conftest import rows

T0 = datetime.datetime(2026, 1, 1)


def log(spark, *specs):
    """Events of (seq, layer, kind) and more columns by name."""
    out = []
    for seq, layer, kind, *more in specs:
        e = dict.fromkeys(f.split(" ")[0] for f in EVENTS.split(", ")) | {"seq": seq, "layer": layer, "kind": kind} | (more[0] if more else {})
        out.append(tuple(e.values()))
    return spark.createDataFrame(out, EVENTS)


def test_append_numbers_from_the_last(spark):
    new = log(spark, (None, "source.live", "FileChanged", {"payload": "{}"}), (None, "source.live", "FileParsed", {"tx": "t"}))
    one = ev.append(new, 0, ["kind"])
    assert rows(one.select("seq", "kind", "tx", F.col("ts").isNotNull())) == [(1, "FileChanged", "", True), (2, "FileParsed", "t", True)]
    assert ev.last_seq(one).first()[0] == 2
    assert [r[0] for r in ev.append(new, 2, ["kind"]).select("seq").orderBy("seq").collect()] == [3, 4]
    assert ev.append(log(spark), 5, ["kind"]).count() == 0 and ev.last_seq(log(spark)).first()[0] == 0


def test_as_of_and_filter(spark):
    e = log(spark, *[(i, "x", "Tick") for i in range(1, 6)], (6, "want", "Want"), (7, None, None))
    assert ev.as_of(e, 3).count() == 3
    assert rows(ev.matching(e, ["want"]).select("seq")) == [(6,)]
    assert ev.matching(e).count() == 7
    assert [r[0] for r in ev.read_all(e).select("seq").collect()] == list(range(1, 8))


def test_cursors(spark):
    w = spark.createDataFrame([("code.core", 42, 1), ("code.core", 100, 2), ("back", 9, 1), ("back", 3, 2)], "subscriber_id string, last_processed_seq long, at long")
    c = ev.write_cursors(w, "at")
    subs = spark.createDataFrame([("code.core",), ("back",), ("nobody",)], "subscriber_id string")
    assert rows(ev.read_cursors(subs, c)) == [("back", 3), ("code.core", 100), ("nobody", 0)]


def test_state_and_retention(spark):
    e = log(spark, *[(i, "a" if i % 3 else "b", f"k{i}", {"subject_layer": "s", "subject_id": "x", "ts": T0 + datetime.timedelta(days=i)}) for i in range(1, 10)], (10, None, "z"))
    assert rows(ev.state_as_of(e, 5, ["subject_layer", "subject_id"], "kind")) == [("s", "x", "k5", 5)]
    kept = ev.retain(e, 2, F.lit("2026-01-09").cast("timestamp"))
    assert rows(kept.select("seq")) == [(3 * 2,), (7,), (8,), (9,)]


def test_snapshots(spark, tmp_path):
    e = log(spark, *[(i, "a" if i % 2 else "b", "k") for i in range(1, 8)])
    name = ev.create_snapshot(e, str(tmp_path), 5, "a")
    assert ev.create_snapshot(e, str(tmp_path), 5, "a") == name  # the same again is no error
    assert [r[0] for r in ev.load_snapshot(spark, str(tmp_path), name).select("seq").collect()] == [1, 3, 5]
    assert ev.create_snapshot(e, str(tmp_path), 5) != name
    with pytest.raises(Exception):
        ev.load_snapshot(spark, str(tmp_path), "unknown").count()


def test_lineage(spark):
    e = log(spark, (1, "a", "one"), (2, "a", "two", {"causes": [1, 99]}), (2, "a", "two", {"causes": [1, 99]}))
    assert rows(ev.lineage(e)) == [(2, "two", 1, "one")]


def test_numbers_and_neighbours_across_ranges(spark):
    df = spark.createDataFrame([(i * 7 % 101, i % 3) for i in range(101)], "a int, b int")
    got = order.number_rows(df, ["a"], "n", 10, buckets=9).orderBy("a").collect()
    assert [r["n"] for r in got] == list(range(11, 112))
    prev = order.with_previous(df, ["a"], "a", buckets=9).orderBy("a").collect()
    assert [r["previous"] for r in prev] == [None, *range(100)]
    odd = spark.createDataFrame([(1, 5), (2, 6), (3, 6), (4, 2)], "o int, v int")
    assert rows(order.monotonic_violations(odd, ["o"], "v", buckets=3).select("o")) == [(3,), (4,)]


FACTS = "k string, ord int, confidence double, freshness string, source_class array<string>, inputs array<string>, produced_seq long"


def test_fold(spark):
    f = spark.createDataFrame(
        [("a", 1, 0.95, "live", ["extractor:tree_sitter"], ["e1"], 10), ("a", 2, 0.80, "dirty", ["extractor:lsp"], ["e2"], 25), ("t", 1, 0.5, "unknown", [], ["z"], 1), ("t", 2, 0.6, "building", [], ["z"], 1)], FACTS
    )
    got = {r["k"]: r for r in provenance.fold_nested(f, ["k"], "ord").collect()}
    a = got["a"]
    assert (a["confidence"], a["freshness"], a["source_class"], a["inputs"], a["produced_seq"], len(a["constituents"])) == (0.80, "dirty", ["extractor:lsp", "extractor:tree_sitter"], ["e1", "e2"], 25, 2)
    assert got["t"]["freshness"] == "unknown" and got["t"]["inputs"] == ["z"]  # of equal risks the first
    assert rows(provenance.fold(f, ["k"], "ord")) == [("a", 0.8, "dirty", 25, 2), ("t", 0.5, "unknown", 1, 2)]
    assert rows(provenance.fold_members(f, ["k"], "inputs")) == [("a", "e1"), ("a", "e2"), ("t", "z")]
    assert provenance.fold(f.limit(0), ["k"], "ord").count() == 0 and provenance.empty_fold()["constituents"] == []


def test_disagreement(spark):
    f = spark.createDataFrame([("a", "x"), ("a", "y"), ("b", "x"), ("b", "x"), ("c", None), ("c", "q")], "k string, v string")
    assert rows(provenance.disagreement(f, ["k"], "v")) == [("a", 2, "x", "y")]


def test_as_of_the_end_reads_the_whole_log(spark, tmp_path):
    from stratalog.plans import log_queries

    log = [(n, layer, "K", layer, f"s{n}", None, "p", None) for n in range(1, 6001) for layer in [("code.core", "semantic.overlay")[n % 2]]]
    df = spark.createDataFrame(log, "seq long, layer string, kind string, subject_layer string, subject_id string, payload string, produced_by string, tx string")
    df.write.parquet(f"{tmp_path}/kernel_events.parquet")
    q = lambda name: log_queries.QUERIES[name](spark, str(tmp_path))
    assert q("event_read_as_of_end").count() == 6000 and q("event_read_as_of").count() == 2400
    assert q("state_as_of_end").count() == 6000
    assert sorted(r["seq"] for r in q("snapshot_layer_end").collect()) == list(range(2, 6001, 2))
    assert sorted(r["seq"] for r in q("snapshot_roundtrip_end").collect()) == list(range(1, 6001, 2))
