import random
from collections import defaultdict

from pyspark.sql import functions as F

from stratalog.operators import skew

from .conftest import rows


def data():
    rng = random.Random(1)
    out = [("calls", "hot", f"f{rng.randrange(50)}", i) for i in range(900)]
    out += [(rng.choice(["calls", "references"]), f"t{rng.randrange(40)}", rng.choice([f"f{rng.randrange(9)}", None]), i) for i in range(300)]
    out += [(None, "hot", "f1", 1), ("calls", None, "f1", 1)]
    return out + out[:40]


def test_two_stages_against_brute_force(spark):
    d = data()
    df = spark.createDataFrame(d, "relation string, to_id string, from_id string, seq long").withColumn("n_distinct", F.lit(0))
    want = defaultdict(list)
    for r, t, f, s in d:
        if r is not None and t is not None:
            want[r, t].append((f, s))
    got = skew.salted_aggregate(
        df.drop("n_distinct"),
        ["relation", "to_id"],
        {"n": F.count(F.lit(1)), "a": F.min("seq"), "z": F.max("seq")},
        {"n": F.sum("n"), "a": F.min("a"), "z": F.max("z")},
        distinct=["from_id", "seq"],
        heavy=9,
        salts=7,
    )
    assert got.columns == ["relation", "to_id", "n", "a", "z", "n_from_id", "n_seq"]
    assert rows(got) == sorted(((*k, len(v), min(s for _, s in v), max(s for _, s in v), len({f for f, _ in v} - {None}), len({s for _, s in v})) for k, v in want.items()), key=repr)
    plain = skew.salted_aggregate(df, ["relation", "to_id"], {"n": F.count(F.lit(1))}, {"n": F.sum("n")}, heavy=9, salts=7)
    assert rows(plain) == sorted(((*k, len(v)) for k, v in want.items()), key=repr)


def test_heavy_keys_are_spread_and_named(spark):
    df = spark.createDataFrame(data(), "relation string, to_id string, from_id string, seq long")
    assert rows(skew.heavy_keys(df, ["relation", "to_id"], heavy=10).select("to_id", "of")) == [("hot", 1240)]
    s, h = skew.salted(df, ["relation", "to_id"], heavy=10, salts=7)
    assert rows(s.select("to_id", "__salts").dropna().distinct()) == [("hot", 6)]
    assert rows(h.select("relation", "to_id")) == [("calls", "hot")]
    assert s.count() == df.count()


def test_small_tables_are_salted_too(spark):
    df = spark.createDataFrame([("a", i) for i in range(6)] + [("b", 1)], "k string, v int")
    assert rows(skew.heavy_keys(df, ["k"]).select("k", "n_rows")) == [("a", 6), ("b", 1)]


def test_the_sketch_misses_no_heavy_key(spark):
    """Many light keys around keys just above the share."""
    df = spark.range(200_000).select(F.when(F.col("id") % 5 == 0, F.concat(F.lit("h"), (F.col("id") / 5 % 100).cast("int"))).otherwise(F.concat(F.lit("l"), "id")).alias("k"))
    assert {r[0] for r in skew.heavy_keys(df, ["k"], heavy=600).select("k").collect()} == {f"h{i}" for i in range(100)}


def test_keys_go_once_through_the_shuffle(spark):
    """Rows of heavy keys are shuffled under a number, without the key's columns."""
    df = spark.createDataFrame(data(), "relation string, to_id string, from_id string, seq long")
    got = skew.salted_aggregate(df, ["relation", "to_id"], {"n": F.count(F.lit(1))}, {"n": F.sum("n")}, ["from_id"], heavy=10)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "RepartitionByExpression [relation" in plan and "Aggregate [__h" in plan
    # those of light keys once, whatever is counted
    two = skew.salted_aggregate(df, ["relation", "to_id"], {"n": F.count(F.lit(1))}, {"n": F.sum("n")}, ["from_id", "seq"], heavy=10)
    assert two._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning(relation") == 1


def test_empty(spark):
    df = spark.createDataFrame([], "k string, v string")
    assert rows(skew.salted_aggregate(df, ["k"], {"n": F.count(F.lit(1))}, {"n": F.sum("n")}, distinct=["v"])) == []


def test_hot_join_is_a_join(spark):
    left = spark.createDataFrame([("a", i) for i in range(50)] + [("b", 1), ("c", 2), (None, 3)], "k string, v int")
    side = spark.createDataFrame([("a", 50, "x"), ("b", 1, "y"), ("d", 9, "z")], "k string, w long, note string")
    assert rows(skew.hot_join(left, side, ["k"], "w", heavy=1)) == rows(left.join(side.drop("w"), "k"))
    assert rows(skew.hot_join(left, side, ["k"], "w", "left_semi", heavy=1)) == rows(left.join(side, "k", "left_semi"))
