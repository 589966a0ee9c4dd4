import random

from pyspark.sql import functions as F

from stratalog.operators import changefeed as cf

from .conftest import rows

SCHEMA = "k string, place long, op string, tx string"


def brute(changes):
    """One by one in the order of places."""
    state = {}
    for k, place, op, _ in sorted({c for c in changes if None not in c[:3]}, key=lambda c: c[1]):
        if op == "insert" or op == "update" and k in state:
            state[k] = place
        elif op == "delete":
            state.pop(k, None)
    return sorted(state.items())


def test_fold_against_replay_one_by_one(spark):
    rng = random.Random(5)
    for trial in range(4):
        changes = [(rng.choice("abcdef"), p, rng.choice(["insert", "update", "update", "delete"]), None) for p in range(1, 60)]
        sent = changes + rng.sample(changes, 20)
        rng.shuffle(sent)
        df = spark.createDataFrame(sent, SCHEMA).withColumn("last_place", F.lit("clash"))
        assert rows(cf.replay(df, ["k"], closed_log=True)) == brute(changes), trial


def test_nulls_and_empty(spark):
    df = spark.createDataFrame([(None, 1, "insert", None), ("a", None, "insert", None), ("b", 1, None, None), ("c", 2, "insert", "")], SCHEMA)
    assert rows(cf.replay(df, ["k"], closed_log=True)) == [("c", 2)]
    none = spark.createDataFrame([], SCHEMA)
    assert rows(cf.replay(none, ["k"], closed_log=True)) == rows(cf.replay(none, ["k"])) == []


def test_place_of_replayed_change(spark):
    payloads = ['{"replay_of": 7}', '{"replay_of":"8"}', '{"replay_of":" 9 "}', '{"replay_of":"x"}', '{"a":1}', '{"replay_of": 7', "", None]
    df = spark.createDataFrame([(100 + i, p) for i, p in enumerate(payloads)], "seq long, payload string")
    got = df.select("seq", cf.change_place(F.col("seq"), F.col("payload"))).orderBy("seq").collect()
    assert [r[1] for r in got] == [7, 8, 9, 103, 104, 105, 106, 107]


def test_watermark_and_gaps(spark):
    p = lambda xs: spark.createDataFrame([(x,) for x in xs], "place long")
    mark = lambda xs, **k: cf.watermark(p(xs), **k).first()[0]
    assert mark([3, 1, 2, 2, 5, None]) == 3
    assert mark([2, 3]) == 0
    assert mark([]) == 0
    assert mark([1, 2, 4, 5], closed=p([3])) == 5
    assert mark([10, 11, 13], start=10) == 11
    assert rows(cf.gaps(p([1, 2, 5, 9, 9, 10, None]))) == [(3, 4), (6, 8)]
    assert rows(cf.gaps(p([]))) == rows(cf.gaps(p([4]))) == []


def test_gaps_are_held_for_a_while(spark):
    p = spark.createDataFrame([(x,) for x in (1, 2, 4, 5, 6, 9, 10)], "place long")
    held = lambda df, n: cf.held_watermark(df, n).first()[0]
    assert (held(p, 100), held(p, 5), held(p, 2), held(p, 0)) == (2, 6, 10, 10)
    assert held(p.limit(0), 5) is None


def test_open_transactions_are_held(spark):
    changes = [("a", 1, "insert", "t1"), ("b", 2, "insert", "t2"), ("a", 3, "update", "t1"), ("c", 5, "insert", "t2"), ("d", 6, "insert", None)]
    df = spark.createDataFrame(changes, SCHEMA)
    # 4 is missing: t2 commits behind it and is not seen at all
    assert rows(cf.replay(df, ["k"])) == [("a", 3)]
    closed = spark.createDataFrame([(4,)], "place long")
    assert rows(cf.replay(df, ["k"], closed=closed)) == [("a", 3), ("b", 2), ("c", 5), ("d", 6)]
    assert rows(cf.transactions(df)) == [("t1", 1, 3, 2), ("t2", 2, 5, 2)]


def test_ends_of_transactions_are_those_of_the_log(spark):
    # t1 ends behind the gap at 3 with an event that changes nothing
    changes = spark.createDataFrame([("a", 1, "insert", "t1"), ("b", 2, "insert", None)], SCHEMA)
    log = changes.select("place", "tx").unionByName(spark.createDataFrame([(4, "t1")], "place long, tx string"))
    assert rows(cf.replay(changes, ["k"], log=log)) == [("b", 2)]
    closed = spark.createDataFrame([(3,)], "place long")
    assert rows(cf.replay(changes, ["k"], closed=closed, log=log)) == [("a", 1), ("b", 2)]


def test_state_of_a_growing_log_waits_for_every_gap(spark, tmp_path):
    from stratalog.plans import catalog

    event = lambda seq: (seq, "EntityMaterialized", "code.core", f"e{seq}", None, "")
    log = [event(n) for n in (1, 2, *range(4, 3000))]
    for d, sent, last in ((tmp_path / "early", log, 2), (tmp_path / "late", [*log, event(3)], 2999)):
        spark.createDataFrame(sent, "seq long, kind string, subject_layer string, subject_id string, payload string, tx string").write.parquet(f"{d}/kernel_events.parquet")
        got = catalog.queries()["p2_contiguous"](spark, str(d))
        assert rows(got.select("last_seq")) == [(n,) for n in sorted(range(1, last + 1), key=lambda n: repr((n,)))]


def test_closed_log_goes_by_its_watermark(spark, monkeypatch):
    p = lambda xs: spark.createDataFrame([(x,) for x in xs], "place long")
    ranges = lambda *xs: spark.createDataFrame(xs, "gap_from long, gap_to long")
    mark = lambda xs, **k: cf.watermark(p(xs), **k).first()[0]
    assert mark([1, 2, 5, 6, 1 << 60], closed_ranges=ranges((3, 4), (7, (1 << 60) - 1))) == 1 << 60
    assert mark([1, 2, 5, 6, 9], closed_ranges=ranges((3, 4))) == 6
    assert mark([5, 6], start=3, closed_ranges=ranges((1, 4))) == 6
    seen = []
    monkeypatch.setattr(cf, "watermark", lambda *a, was=cf.watermark: seen.append(was(*a)) or seen[-1])
    df = spark.createDataFrame([("a", -3, "insert", "t1"), ("b", 2, "insert", None), ("a", 9, "update", "t1")], SCHEMA)
    assert rows(cf.replay(df, ["k"], closed_log=True)) == [("a", 9), ("b", 2)]
    assert [w.first()[0] for w in seen] == [9]
