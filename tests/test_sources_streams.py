import os

from stratalog.extract import golang
from stratalog.operators.entities import ingest
from stratalog.schemas import EVENTS
from stratalog.sources import tree
from stratalog.streaming import log

from .conftest import rows

GO = '''package checkout

type CheckoutValidator struct{}

// func Fake() {}
const s = `func Raw() {`

func (v *CheckoutValidator) Validate(ctx any, f func(int) error) (ok bool, err error) {
	if x := '{'; x == '"' { return }
	return
}

func helper[T any](a []T) map[string]interface{} { return nil }
func external(x int) int
'''


def test_extractor():
    f = golang.functions(GO.encode())
    assert [(x["qualified_name"], x["receiver"], x["signature"], x["start_line"], x["end_line"]) for x in f] == [
        ("checkout.CheckoutValidator.Validate", "CheckoutValidator", "(ctx any, f func(int) error) (ok bool, err error)", 8, 11),
        ("checkout.helper", "", "(a []T) map[string]interface{}", 13, 13),
        ("checkout.external", "", "(x int) int", 14, 14),
    ]
    assert golang.functions(b"") == []
    assert len(golang.functions(b"package p\nfunc Ok() {}\nfunc Bad( {{{")) >= 1
    assert golang.functions(GO.replace("\n", "\r\n").encode())[0]["start_line"] == 8


def test_extractor_over_tables(spark):
    df = spark.createDataFrame([("a.go", GO.encode()), ("b.go", b""), ("c.go", None)], "path string, content binary")
    p = golang.parsed(df)
    assert rows(p.selectExpr("path", "size(functions)")) == [("a.go", 3), ("b.go", 0)]
    kinds = rows(ingest(p, 5).groupBy("kind").count())
    assert kinds == [("File", 2), ("Function", 2), ("Method", 1)]
    golang.register_udtf(spark)
    df.where("path = 'a.go'").selectExpr("cast(content as string) as content").createOrReplaceTempView("src")
    assert spark.sql("SELECT f.name FROM src, LATERAL extract_go(content) f").count() == 3


def test_walk_and_read(spark, tmp_path, monkeypatch):
    for p in ("main.go", "_x/keep.go", ".hid/no.go", "vendor/no.go", "a/node_modules/no.go", "a/b_test.go", "a/readme.md", "o/one.gh"):
        os.makedirs(tmp_path / os.path.dirname(p), exist_ok=True)
        (tmp_path / p).write_text(f"// {p}")
    assert sorted(tree.walk(str(tmp_path))) == ["_x/keep.go", "a/b_test.go", "main.go"]
    monkeypatch.setattr(tree, "LISTED", 1)
    assert rows(tree.read_tree(spark, str(tmp_path)).selectExpr("path", "cast(content as string)"))[2] == ("main.go", "// main.go")
    assert rows(tree.read_overlay(spark, str(tmp_path))) == [("o/one.gh", "// o/one.gh")]
    assert tree.read_overlay(spark, str(tmp_path / "none")).count() == 0
    assert tree.find_workspace(str(tmp_path / "a"), "o") == str(tmp_path) and tree.find_workspace(str(tmp_path), "zzz") is None


def test_sequencer_and_follower(spark, tmp_path):
    new, stored, at = (str(tmp_path / x) for x in ("new", "log", "at"))
    schema = "layer string, kind string, produced_by string, key long"

    def deliver(*keys):
        spark.createDataFrame([("want" if k % 2 else "skip", "K", "p", k) for k in keys], schema).coalesce(1).write.mode("append").parquet(new)
        log.sequence(spark.readStream.schema(schema).parquet(new), stored, at, ["key"]).awaitTermination()

    deliver(3, 1, 2)
    deliver(5, 4)
    e = log.read_log(spark, stored)
    assert [r[0] for r in e.select("seq").orderBy("seq").collect()] == [1, 2, 3, 4, 5]
    out, seen = str(tmp_path / "out"), str(tmp_path / "seen")
    follow = lambda: log.follow(log.subscribe(spark, f"{stored}/batch=*", ["want"]), out, seen).awaitTermination()
    follow()
    assert spark.read.schema(EVENTS).parquet(out).count() == 3
    deliver(7)
    follow()
    assert spark.read.schema(EVENTS).parquet(out).count() == 4
