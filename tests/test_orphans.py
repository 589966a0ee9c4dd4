import random

import pytest

from stratalog.operators import orphans

from .conftest import rows

REFS = "k string, a string, b string, at long"
TARGETS = "a string, b string, at long, k string"


def brute(refs, targets, match, ordered):
    out = []
    for k, a, b, at in refs:
        nulls = [x is None for x in (a, b)]
        if all(nulls) or match == "simple" and any(nulls):
            continue
        if match == "full" and any(nulls):
            out.append((k, a, b, at))
            continue
        hit = any((a is None or a == x) and (b is None or b == y) and (None not in (x if a is not None else 0, y if b is not None else 0)) and (not ordered or (z is not None and at is not None and z <= at)) for x, y, z, _ in targets)
        if not hit:
            out.append((k, a, b, at))
    return sorted(out, key=repr)


@pytest.mark.parametrize("match", ["simple", "partial", "full"])
@pytest.mark.parametrize("ordered", [False, True])
def test_against_brute_force(spark, match, ordered):
    rng = random.Random(3)
    pick = lambda xs: rng.choice(xs)
    refs = [(f"r{i}", pick(["x", "y", "z", None]), pick(["1", "2", None]), pick([1, 5, 9, None])) for i in range(120)]
    refs += refs[:5]  # repeated rows stay
    targets = [(pick(["x", "y", None]), pick(["1", "2", None]), pick([2, 6, None]), "clash") for _ in range(9)]
    r, t = spark.createDataFrame(refs, REFS), spark.createDataFrame(targets, TARGETS)
    order = {"ref_order": "at", "target_order": "at"} if ordered else {}
    got = orphans.find_orphans(r, t, [("a", "a"), ("b", "b")], match, heavy=2, **order)
    assert got.columns == r.columns
    assert rows(got) == brute(refs, targets, match, ordered)


def test_hot_key(spark):
    refs = [(str(i), "hot", "1", i) for i in range(600)] + [(str(i), f"c{i}", "1", i) for i in range(100)]
    r = spark.createDataFrame(refs, REFS)
    t = spark.createDataFrame([("hot", "1", 300, ""), ("c7", "1", 0, "")], TARGETS)
    got = orphans.find_orphans(r, t, [("a", "a"), ("b", "b")], ref_order="at", target_order="at", heavy=3)
    assert got.count() == 300 + 99


def test_empty_tables(spark):
    r, t = spark.createDataFrame([], REFS), spark.createDataFrame([], TARGETS)
    assert rows(orphans.find_orphans(r, t, [("a", "a")])) == []
    full = spark.createDataFrame([("r", "x", "1", 1), ("s", None, "1", 1)], REFS)
    assert rows(orphans.find_orphans(full, t, [("a", "a")])) == [("r", "x", "1", 1)]


def test_report(spark):
    r = spark.createDataFrame([("t", "p1", "1"), ("t", "p1", "2"), ("t", None, "3"), ("t", "p1", "1")], "tab string, period string, key string")
    o = r.where("key = '1'")
    assert rows(orphans.orphan_report(r, o, ["tab", "period"])) == [("t", "p1", 2, 1), ("t", None, 1, 0)]


def test_wrong_arguments(spark):
    r = spark.createDataFrame([], REFS)
    with pytest.raises(ValueError):
        orphans.find_orphans(r, r, [("a", "a")], "half")
    with pytest.raises(ValueError):
        orphans.find_orphans(r, r, [("a", "a")], ref_order="at")
