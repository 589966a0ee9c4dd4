from stratalog.llm import source_parse

from ..conftest import rows

SCHEMA = "file_id long, repo string, path string, language_id string, content string, n_errors string, language string"


def files(spark, *r):
    return spark.createDataFrame([(*x, "clash", "clash") for x in r], SCHEMA)


def test_rows_and_rates(spark):
    big = (1 << 60) + 1
    df = files(
        spark,
        (1, "r", "r/a.go", "GO", "package p\n"),
        (big, "r", "r/b.go", None, "package"),
        (big, "r", "r/b.go", None, "package"),
        (3, None, "x.json", "json", "{"),
        (4, "r", "r/c.rs", None, "nonsense ("),
        (5, "r", "r/d.py", "python", None),
        (None, None, None, None, None),
        (6, "r", "r/e.py", "", "def ("),
    )
    p = source_parse.parse_errors(df)
    assert rows(p.select("file_id", "language", "n_errors")) == sorted([(1, "go", 0), (big, "go", 1), (big, "go", 1), (3, "json", 1), (4, None, 0), (5, "python", 0), (None, None, 0), (6, None, 0)], key=repr)
    assert rows(source_parse.acceptance(p)) == sorted([("r", "go", 2, 1, 0.5), (None, "json", 1, 1, 0.0), ("r", "python", 1, 0, 1.0)], key=repr)
    assert p.where("n_errors > 0").select("first_line").first()[0] == 1


def test_empty_table(spark):
    assert source_parse.parse_errors(files(spark)).count() == 0


def test_every_error_is_given(spark, tmp_path):
    bad = "".join(f"x{n} = = {n}\n" for n in range(1500))
    files(spark, (1, "r", "r/a.py", "python", bad), (1, "r", "r/a.py", "python", bad), (2, "r", "r/b.py", "python", "x = 1\n"), (3, "r", "r/c.json", "json", "{")).write.parquet(f"{tmp_path}/parsed_files.parquet")
    got = source_parse.p4_errors(spark, str(tmp_path))
    assert sorted(r["line"] for r in got.where("file_id = 1").collect()) == list(range(1, 1501))
    assert rows(got.groupBy("file_id").agg({"ord": "max", "n_errors": "max"}).select("file_id", "max(ord)", "max(n_errors)")) == [(1, 1499, 1500), (3, 0, 1)]
