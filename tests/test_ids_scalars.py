import hashlib
import struct

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from stratalog.functions import ids, scalars
from stratalog.functions.keys import norm_id, trimmed

from .conftest import rows


def sha(*parts: bytes) -> str:
    return hashlib.sha256(b"\0".join(parts)).hexdigest()


def one(spark, column, **values):
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]).select(column).first()[0]


def test_ids_are_hashes_of_nul_joined_parts(spark):
    v = {"l": "go", "q": "checkout.Validate", "s": "(any) error", "r": "Validator", "n": "Validate"}
    assert one(spark, ids.function_id("l", "q", "s"), **v) == sha(b"go", b"checkout.Validate", b"(any) error")
    assert one(spark, ids.method_id("l", "r", "n", "s"), **v) == sha(b"go", b"Validator", b"Validate", b"(any) error")
    assert one(spark, ids.type_id("l", "q"), **v) == sha(b"go", b"checkout.Validate")
    assert one(spark, ids.finding_id("l", "q", "s"), **v) == "finding_" + sha(b"go", b"checkout.Validate", b"(any) error")[:8]
    assert one(spark, ids.proposal_id("l", "q", "s"), **v) == "prop_" + sha(b"go", b"checkout.Validate", b"(any) error")[:10]
    assert one(spark, ids.workspace_id("q"), **v) == sha(b"checkout.Validate")[:12]


def test_ids_differ_by_language_and_receiver(spark):
    v = {"a": "go", "b": "ts", "q": "x.Y", "s": "()", "r": "One", "t": "Two"}
    assert one(spark, ids.function_id("a", "q", "s") != ids.function_id("b", "q", "s"), **v)
    assert one(spark, ids.method_id("a", "r", "q", "s") != ids.method_id("a", "t", "q", "s"), **v)


def test_snapshot_id_takes_seq_as_bytes(spark):
    for seq in (0, 1, 258, 2**40 + 3):
        assert one(spark, ids.snapshot_id("l", F.lit(seq), "p"), l="code.core", p="[]") == sha(b"code.core", struct.pack("<Q", seq), b"[]")[:16]


def test_null_part_gives_null_id(spark):
    assert one(spark, ids.function_id("a", F.lit(None).cast("string"), "a"), a="x") is None


def test_signatures(spark):
    a, b = "(  a int,  b   string ) error", "(a int, b string) error"
    assert one(spark, scalars.normalize_signature("a"), a=a) == b == one(spark, scalars.normalize_signature("a"), a=b)
    # a vertical tab is no white space in RE2
    assert one(spark, scalars.normalize_signature("a"), a="(a\x0b b)") == "(a\x0b b)"
    assert one(spark, scalars.signature("p", "r"), p="(x)", r="") == "(x)"
    assert one(spark, scalars.signature("p", "r"), p="(x)", r="int") == "(x) int"
    assert one(spark, scalars.bare_receiver("p"), p="**T") == "*T"


def test_qualified_names(spark):
    for p, r, want in (("p", "r", "p.r.n"), ("", "r", "r.n"), ("p", "", "p.n"), ("", "", "n")):
        assert one(spark, scalars.qualified_name("p", "r", "n"), p=p, r=r, n="n") == want


def test_risk(spark):
    df = spark.createDataFrame([("live",), ("unresolved",), ("building",), (None,)], "f string")
    assert [r[0] for r in df.select(scalars.blocking_risk("f")).collect()] == [0, 6, 5, 5]


@settings(max_examples=15, deadline=None)
@given(st.lists(st.integers(0, 2**62), max_size=6))
def test_causes_round_trip(spark, causes):
    df = spark.createDataFrame([(causes,)], "c array<long>").select(scalars.encode_causes("c").alias("e"))
    got = df.select("e", scalars.decode_causes("e")).first()
    assert got[0] == (",".join(map(str, causes)) or None) and (got[1] or []) == causes


def test_causes_decode_is_tolerant(spark):
    assert one(spark, scalars.decode_causes("c"), c="1,,2x") == [1, 0, 2]
    assert one(spark, scalars.decode_causes("c"), c="") is None


def test_paths_and_globs(spark):
    assert one(spark, scalars.diff_path("c"), c="+++ b/a/b.go") == "a/b.go"
    assert one(spark, scalars.diff_path("c"), c="+++ b/b/x") == "b/x"
    assert one(spark, scalars.dependency_name("c"), c="code.core@^0.1.0") == "code.core"
    assert one(spark, scalars.glob_regex("a/**/x?*.go"), c="") == r"^a/.*/x[^/][^/]*\.go$"


def test_normal_ids(spark):
    df = spark.createDataFrame([(" AB\t",), (" ",), (None,), ("x",)], "i string")
    assert rows(df.select(norm_id("i"))) == sorted([("ab",), (None,), (None,), ("x",)], key=repr)
    assert [r[0] for r in df.select(trimmed("i")).collect()] == ["AB", None, None, "x"]
