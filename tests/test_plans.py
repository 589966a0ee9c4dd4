"""Shapes of plans that must hold whatever the size: what reaches the scan, what is shuffled, what is not joined by loops."""

import json

import pytest
from pyspark.sql import functions as F

from stratalog.functions import scalars
from stratalog.operators import entities, graph, orphans, patterns, provenance, validate, workspace
from stratalog.plans import log_queries, registry
from stratalog.session import cut_partitioned, parts, scratch, exists

from .conftest import rows

SF = "/root/testdata/sf0.001"


def physical(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_filters_of_the_log_reach_the_scan(spark, tmp_path):
    spark.createDataFrame([(1, None, None, "code.core", "EntityMaterialized", None, None, None, None, None, None, None)], log_queries.EVENTS).write.parquet(str(tmp_path / "kernel_events.parquet"))
    plan = physical(log_queries.event_filter_layer_kind(spark, str(tmp_path)))
    assert "In(layer" in plan and "In(kind" in plan
    assert "LessThanOrEqual(seq" in physical(log_queries.snapshot_layer(spark, str(tmp_path)))


def test_written_edges_are_not_shuffled_again(spark):
    e = spark.createDataFrame([("calls", f"a{i % 7}", f"b{i}") for i in range(50)], "relation string, from_id string, to_id string")
    kept = cut_partitioned(e, "from_id")
    f = spark.createDataFrame([("a1",)], "from_id string").distinct()
    assert physical(kept.join(f.hint("shuffle_hash"), "from_id")).count("Exchange hashpartitioning(from_id") == 1


def test_bfs_with_hot_sources(spark, monkeypatch):
    monkeypatch.setattr(graph, "HOT", 5)
    e = spark.createDataFrame([("calls", "hub", f"n{i}") for i in range(60)] + [("calls", f"n{i}", f"m{i % 4}") for i in range(30)] + [("calls", "m0", "hub"), ("refs", "m1", "z")], "relation string, from_id string, to_id string")
    near = graph.Adjacency(e)
    assert len(near.hot) >= 1
    got = rows(graph.bfs(e, spark.createDataFrame([("hub",)], "id string")))
    assert got == sorted([(f"n{i}", 1, "calls") for i in range(60)] + [(f"m{i}", 2, "calls") for i in range(4)] + [("z", 3, "refs")])
    assert rows(graph.bfs(e, spark.createDataFrame([("hub",)], "id string"), max_depth=0)) == []


def test_pattern_join_has_no_loop(spark):
    p = spark.createDataFrame([("a*.go", "a", ".go"), ("*x", "", "x"), ("pre*", "pre", "")], "p string, b string, e string")
    t = spark.createDataFrame([("ab.go",), ("zx",), ("prefix",), (None,), ("",)], "t string")
    j = patterns.literal_join(p, F.col("b"), F.col("e"), t, "t")
    assert rows(j.select("p", "t")) == [("*x", "prefix"), ("*x", "zx"), ("a*.go", "ab.go"), ("pre*", "prefix")]
    assert "NestedLoop" not in physical(j) and "Cartesian" not in physical(j)
    any_ = spark.createDataFrame([("*", "", ""), ("**", "", "")], "p string, b string, e string")
    assert patterns.literal_join(any_, F.col("b"), F.col("e"), t, "t").count() == 8
    with pytest.raises(ValueError, match="more than 1 "):
        patterns.literal_join(any_, F.col("b"), F.col("e"), t, "t", most_open=1)


def test_compat_names_with_wildcards(spark):
    e = spark.createDataFrame([("1", "Function", "p.Find_User"), ("2", "Function", "p.q.findXuser"), ("3", "Method", "other.get"), ("4", "TypeDecl", "a.b_")], "id string, kind string, qualified_name string")
    n = spark.createDataFrame([("find_user",), ("GET",), ("b_",), ("f%r",), ("none_",), (None,)], "name string")
    assert rows(entities.lookup_suffix(n, e, "compat")) == sorted([("GET", "other.get", "3"), ("b_", "a.b_", "4"), ("f%r", "p.Find_User", "1"), ("find_user", "p.Find_User", "1")])


def test_times(spark):
    texts = ["2026-01-02T03:04:05.123456789Z", "2026-01-02T05:04:05.5+02:00", "2026-01-02T03:04:05Z", "2026-01-01T22:04:05.000000001-05:00", "2026-01-02 03:04:05", "2026-13-02T03:04:05Z", "", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    base = 1767323045000000
    want = [(0, base + 123456, 789), (1, base + 500000, 0), (2, base, 0), (3, base, 1), (4, None, None), (5, None, None), (6, None, None), (7, None, None)]
    assert rows(df.select("i", scalars.decode_time("t").alias("x")).select("i", "x.*")) == want
    with pytest.raises(Exception, match="no time"):
        df.select(scalars.decode_time("t", strict=True)).collect()


def test_a_key_with_too_many_facts_is_an_error(spark):
    f = spark.range(5).select(F.lit("k").alias("k"), F.col("id").alias("ord"), F.lit(0.5).alias("confidence"), F.lit("live").alias("freshness"), F.array(F.lit("s")).alias("source_class"), F.array(F.lit("i")).alias("inputs"), F.col("id").alias("produced_seq"))
    assert provenance.fold_nested(f, ["k"], "ord").count() == 1
    with pytest.raises(ValueError, match="5 facts"):
        provenance.fold_nested(f, ["k"], "ord", most=4)


def test_masks_that_do_not_occur_cost_nothing(spark):
    r = spark.createDataFrame([("x", None, 1)], "a string, b string, n int")
    t = spark.createDataFrame([("x", "y")], "a string, b string")
    on = [("a", "a"), ("b", "b")]
    assert rows(orphans.find_orphans(r, t, on, "partial")) == [] and rows(orphans.find_orphans(r, t, on, "full")) == [("x", None, 1)]
    assert orphans.find_orphans(r.limit(0), t, on, "full", first="came").columns == ["a", "b", "n", "came"]


def test_parts_follow_the_input(spark, monkeypatch, tmp_path):
    spark.range(1000).write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    assert parts(df) == 4
    monkeypatch.setattr("stratalog.session.TASK_BYTES", 100)
    assert parts(df) > 20


def test_scratch_is_there_until_the_end(spark):
    assert exists(spark, scratch(spark, "x")) and not exists(spark, "/no/such/folder")


MANIFEST = {"apiVersion": "demo.kernel/v1", "kind": "Layer", "metadata": {"name": "b", "version": "0.2"}, "schema": {"entity_kinds": [{"name": "K", "attributes": {"a": {"type": "list<path>"}}}]}}


def test_manifests_of_a_folder(spark, tmp_path):
    (tmp_path / "b.json").write_text(json.dumps(MANIFEST | {"metadata": {"name": "b", "version": "0.2", "depends_on": ["a@^1"]}}))
    (tmp_path / "z.yaml").write_text("apiVersion: demo.kernel/v1\nkind: Layer\nmetadata: {name: a, version: '1'}\nmore: 1\n")
    (tmp_path / "readme.md").write_text("no manifest")
    found = registry.load_dir(str(tmp_path))
    assert [m.name for m in found] == ["a", "b"] and found[1].entity_kinds == {"K": {"a": "list<path>"}}
    events = spark.createDataFrame([("a", 1), ("a", 1), ("a", 4), ("zz", 9)], "layer string, seq long")
    assert rows(workspace.layers(registry.catalogue(spark, found), events)) == [("a", "1", "", 2, 4), ("b", "0.2", "a@^1", 0, None)]
    (tmp_path / "c.json").write_text(json.dumps(MANIFEST | {"metadata": {"name": "c", "version": "1", "depends_on": ["gone"]}}))
    with pytest.raises(ValueError, match="gone"):
        registry.load_dir(str(tmp_path))
    (tmp_path / "c.json").write_text(json.dumps(MANIFEST | {"kind": "Other"}))
    with pytest.raises(ValueError, match="c.json"):
        registry.load_dir(str(tmp_path))


def test_scenario(spark):
    none = spark.createDataFrame([], "diff_id long, text string")
    e = spark.createDataFrame([], "id string, kind string, qualified_name string")
    s = spark.createDataFrame([], "name string, unique boolean, anchors array<struct<ord:int,kind:string,str:string,int:long,float:double>>")
    f = spark.createDataFrame([("F", "S")], "name string, scope string")
    want = spark.createDataFrame([("flow_unreviewed", "F")], "kind string, flow string")
    found, score = validate.run_scenario("one", none, e, s, f, want)
    assert rows(found) == [] and rows(score) == [("one", 0.0, -1.0, -1.0, -1.0)]
    assert rows(validate.run_scenario("two", none, e, s, f, want.limit(0))[1]) == [("two", 1.0, -1.0, -1.0, -1.0)]
