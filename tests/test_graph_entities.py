import pytest

from stratalog.operators import entities as en
from stratalog.operators import graph
from stratalog.plans import registry
from stratalog.schemas import ENTITIES

from .conftest import rows


def ents(spark, *specs):
    return spark.createDataFrame([(i, kind, "go", qn, None, None, body, seq) for i, kind, qn, body, seq in specs], ENTITIES)


def test_upsert_keeps_first_seq(spark):
    e = ents(spark, ("1", "Function", "a.B", "old", 3), ("1", "Function", "a.B", "new", 9), ("1", "Function", "a.B", "new", 9), (None, "File", "x", "h", 1))
    assert rows(en.upsert(e).select("id", "body_hash", "created_seq")) == [("1", "new", 3)]


def test_lookups(spark):
    e = ents(spark, ("2", "Function", "pkg.Parse_foo", "", 1), ("1", "Method", "pkg.T.Go", "", 1), ("3", "File", "cmd/main.go", "", 1), ("0", "Function", "pkg.ParseXfoo", "", 1), ("5", "Function", "Go", "", 1))
    names = lambda *xs: spark.createDataFrame([(x,) for x in xs], "name string")
    assert rows(en.lookup_exact(names("pkg.T.Go", "no", None), e)) == [("pkg.T.Go", "pkg.T.Go", "1")]
    assert rows(en.lookup_suffix(names("Go", "T.Go", "Parse_foo"), e)) == [("Go", "Go", "5"), ("Parse_foo", "pkg.Parse_foo", "2"), ("T.Go", "pkg.T.Go", "1")]
    # compat: letter case does not count and _ is any character, so files and other names match as well
    assert rows(en.lookup_suffix(names("go"), e, "compat")) == [("go", "cmd/main.go", "3")]
    assert rows(en.lookup_suffix(names("Parse_foo"), e, "compat")) == [("Parse_foo", "pkg.ParseXfoo", "0")]
    with pytest.raises(ValueError):
        en.lookup_suffix(names("x"), e, "other")


def test_edges_as_a_set(spark):
    r = spark.createDataFrame([("calls", " A", "b"), ("calls", "a", "B"), ("calls", None, "b"), ("calls", "a", " "), ("references", "a", "b")], "relation string, from_id string, to_id string")
    assert rows(en.distinct_edges(r)) == [("calls", "a", "b"), ("references", "a", "b")]
    new = spark.createDataFrame([("calls", "a", "b"), ("calls", "a", "c"), ("calls", "a", "c")], r.schema)
    assert rows(en.insert_ignore(en.distinct_edges(r), new, ["relation", "from_id", "to_id"])) == [("calls", "a", "c")]


def test_attribute_filter(spark):
    e = spark.createDataFrame([("1", "a/b/x.go"), ("2", "a/x.go"), ("3", None)], "id string, path string")
    assert rows(en.attribute_filter(e, "path", "glob", "a/*.go").select("id")) == [("2",)]
    assert rows(en.attribute_filter(e, "path", "prefix", "a/b").select("id")) == [("1",)]
    with pytest.raises(ValueError):
        en.attribute_filter(e, "path", "like", "a")


def edges(spark, *pairs):
    return spark.createDataFrame([(r, a, b) for r, a, b in pairs], "relation string, from_id string, to_id string")


def start(spark, *xs):
    return spark.createDataFrame([(x,) for x in xs], "id string")


def test_bfs(spark):
    e = edges(spark, ("calls", "a", "b"), ("calls", "b", "c"), ("calls", "a", "c"), ("calls", "c", "a"), ("references", "c", "d"), ("calls", "a", "a"), ("calls", "a", "b"), ("calls", "x", "y"))
    depth = lambda *a, **k: rows(graph.bfs(*a, **k).select("id", "depth"))
    assert depth(e, start(spark, "a"), ["calls"]) == [("b", 1), ("c", 1)]  # the start is not in the result
    assert depth(e, start(spark, "a")) == [("b", 1), ("c", 1), ("d", 2)]
    assert depth(e, start(spark, "a"), max_depth=1) == [("b", 1), ("c", 1)]
    assert depth(e, start(spark, "a"), max_depth=0) == depth(e, start(spark, "zz")) == depth(e, start(spark, None)) == []
    assert depth(e, start(spark)) == [] and depth(edges(spark), start(spark, "a")) == []
    assert rows(graph.impacted(e, start(spark, "x")).select("id", "depth", "reason")) == [("x", 0, "direct_touch"), ("y", 1, "impacted_via")]


def test_topological_order(spark):
    order = registry.install_order(registry.STARTER)
    assert len(order) == 9 and all(order.index(d) < order.index(m.name) for m in registry.STARTER for d in m.depends_on)
    assert graph.topological({"b": [], "a": [], "c": ["b"]}) == ["a", "b", "c"]
    with pytest.raises(ValueError, match="cycle"):
        graph.topological({"a": ["b"], "b": ["a"]})
    with pytest.raises(ValueError, match="missing"):
        graph.topological({"a": ["zz"]})
    nodes = spark.createDataFrame([("a",), ("b",), ("c",), ("x",), ("y",)], "name string")
    deps = spark.createDataFrame([("b", "a"), ("c", "b"), ("x", "y"), ("y", "x")], "name string, on string")
    assert rows(graph.peel_levels(nodes, deps)) == [("a", 0), ("b", 1), ("c", 2), ("x", -1), ("y", -1)]


def doc(name="l", **attributes):
    return {"apiVersion": "some.kernel/v1", "kind": "Layer", "metadata": {"name": name, "version": "1"}, "schema": {"entity_kinds": [{"name": "K", "attributes": {k: {"type": v} for k, v in attributes.items()}}]}}


def test_manifests():
    m = registry.parse_manifest(doc(a="list<string>", b="map<string,int>", c="entity_ref(self)"))
    assert registry.spark_type(m.entity_kinds["K"]["b"]) == "map<string,bigint>"
    for bad, text in (({"a": "entity_ref(other)"}, "forbidden"), ({"a": "decimal"}, "is no type"), ({"a": "map<string>"}, "wanted before")):
        with pytest.raises(ValueError, match=text):
            registry.parse_manifest(doc(**bad))
    with pytest.raises(ValueError, match="metadata.name"):
        registry.parse_manifest(doc(name=""))
