import random

from stratalog.llm import file_origin as fo

from ..conftest import rows

CODE = "package lib\n\nfunc Add(a int, b int) int {\n\treturn a + b\n}\n\nfunc Sub(a int, b int) int {\n\tif a > b {\n\t\treturn a - b\n\t}\n\treturn b - a\n}\n\nfunc Mul(a int, b int) int {\n\tout := a * b\n\treturn out\n}\n\nfunc Clamp(value int, least int, most int) int {\n\tif value < least {\n\t\treturn least\n\t}\n\treturn value\n}\n"
OWN = "package own\n\nfunc %s(in []byte, limit int) error {\n\tfor i, x := range in {\n\t\tif i > limit {\n\t\t\treturn fmt.Errorf(\"%%d\", x)\n\t\t}\n\t}\n\tlog.Printf(\"done %%d\", limit)\n\treturn nil\n}\n"


def test_declarations_count_only_as_such():
    for head in ("// Code generated by protoc-gen-go. DO NOT EDIT.", "# Generated by the protocol buffer compiler.  DO NOT EDIT!", "/*\n * @generated by x\n */", "// This file was automatically produced by x; manual changes are lost.", "// AUTOGENERATED FILE - do not modify"):
        assert fo.content_reason(head + "\n\n" + CODE) == "generated", head
    for head in ("// The generator in ./emit writes its own header into every file.", "// Do not edit the golden files by hand; run the target instead.", "// Package gen lists what was generated by others.", "// This file replaces the vendored copy that we dropped."):
        assert fo.content_reason(head + "\n\n" + CODE) is None, head
    assert fo.content_reason(CODE + '\nconst head = "// Code generated by x. DO NOT EDIT."\n') is None
    assert fo.content_reason("// Copied from example.org/x v1.2; keep in step.\n" + CODE) == "vendored"


def test_layouts():
    assert fo.content_reason("var a=1;" * 100) == "minified"
    assert fo.content_reason("T = [\n" + "    12, 4455, 667, 88, 9, 1024, 33,\n" * 20 + "]\n") == "data"
    assert fo.content_reason('X = (\n' + '    "f7571c834ec630992304119e7b5ed3a8edd927d9bd1a94b0466de305"\n' * 8 + ")\n") == "data"
    assert fo.content_reason('{"lockfileVersion": 3, "packages": {"a": "%s"}}' % ("x " * 90)) == "data"
    assert fo.content_reason(CODE) is None and fo.content_reason(CODE + "// " + "x" * 300 + "\n") is None
    assert fo.content_reason("x" * 10) is None


def test_no_text_is_too_short_or_too_well_wrapped():
    assert fo.content_reason("var a = [" + ", ".join(map(str, range(100, 120))) + "];\n") == "data"
    assert fo.content_reason("[1, 2, 3]\n") is None and fo.content_reason("x = 5\n") is None and fo.content_reason("") is None
    assert fo.content_reason('KEY = "QUJDREVGR0hJSktMTU5PUFFSU1RVVldYWVo0NTY3ODkwMTIzNDU2Nzg5"\n') == "data"
    bundle = "!function(e,t){var n={};function r(i){if(n[i])return n[i].exports;var o=n[i]={i:i,l:!1,exports:{}};return e[i].call(o.exports,o,o.exports,r),o.l=!0,o.exports}r.m=e,r.c=n}" * 8
    for width in (80, 100, 150, 199):
        assert fo.content_reason("\n".join(bundle[i : i + width] for i in range(0, len(bundle), width)) + "\n") == "minified", width
    long_names = "".join(f"\tresultOfTheLongestComputation{i} = computeTheLongestResult(firstArgument{i}, secondArgument{i})\n" for i in range(30))
    assert fo.content_reason("package p\n\nfunc f() {\n" + long_names + "}\n") is None


def brute(leaves):
    """Hashes of directories as nested sets of (name, child)."""
    out = {}
    for path, h in leaves.items():
        parts = path.split("/")
        for i in range(1, len(parts)):
            out.setdefault("/".join(parts[:i]), {})["/".join(parts[i:])] = h
    return {d: frozenset(x.items()) for d, x in out.items()}


def test_tree_against_brute_force(spark):
    rng = random.Random(5)
    leaves = {"/".join(["r%d" % rng.randrange(3), *[rng.choice("abc") for _ in range(rng.randrange(0, 7))], f"f{rng.randrange(3)}"]): rng.randrange(4) for _ in range(120)}
    leaves["alone"] = 1
    df = spark.createDataFrame([(p, p.split("/")[0], h, h, 10) for p, h in leaves.items()], "path string, repo string, h1 long, h2 long, code long")
    got = {r["node"]: r for r in fo.tree_of(df).where("is_dir").collect()}
    want = brute(leaves)
    assert set(got) == set(want)
    assert all((got[a]["h1"], got[a]["h2"]) == (got[b]["h1"], got[b]["h2"]) if want[a] == want[b] else got[a]["h1"] != got[b]["h1"] for a in want for b in want)
    assert all(got[d]["n_files"] == len(x) and got[d]["code"] == 10 * len(x) for d, x in want.items())
    assert all(r["up"] == (d.rpartition("/")[0] or None) for d, r in got.items())


def test_broken_files_of_any_length_are_no_evidence(spark):
    page = "<html>\n<body>\n" + "please sign in to go on\n" * 200 + "</body>\n</html>\n"
    r = [(f"r{k}/pkg/own{i}.go", "go", OWN % f"F{k}x{i}") for k in (1, 2) for i in range(3)] + [("r1/x/a.go", "go", page), ("r2/y/b.go", "go", page), ("r1/q.go", "go", CODE), ("r2/z.go", "go", CODE)]
    assert rows(fo.vendored_by_hash(fo.features(files(spark, *r)))) == [("r1/q.go",), ("r2/z.go",)]
    tiny = [(f"r{k}/pkg/own{i}.go", "go", OWN % f"F{k}x{i}") for k in (1, 2) for i in range(3)] + [("r1/a.go", "go", "package a\n\nvar X = 1\n"), ("r2/b.go", "go", "package a\n\nvar X = 1\n")]
    assert rows(fo.vendored_by_hash(fo.features(files(spark, *tiny)), least_code=1)) == [("r1/a.go",), ("r2/b.go",)]


def files(spark, *r):
    return spark.createDataFrame([(i, p, lang, c, "clash") for i, (p, lang, c) in enumerate(r)], "file_id long, path string, language_id string, content string, why string")


def entities(spark, *paths):
    return spark.createDataFrame([("File", p, None) for p in paths] + [("Function", "r/vendor/x.go", None)], "kind string, path string, repo string")


def test_copies_across_repositories(spark):
    own = [(f"r{k}/pkg/own{i}.go", "go", OWN % f"F{k}x{i}") for k in (1, 2, 3) for i in range(6)]
    page = "<html>\n<body>\n" + "please sign in to go on\n" * 12 + "</body>\n</html>\n"
    r = [
        *own,
        ("r1/util/add.go", "go", CODE),
        ("r2/other/deep/plus.go", "go", "// our copy\n" + CODE + "// local patch 7\n"),
        ("r3/a.go", "go", page),
        ("r1/b.go", "go", page),
        # a tree of small files that is the same in two places
        *[(f"{d}/t{i}.py", "python", f"X{i} = {i}\nY{i} = [a, b, c, d]\n" * 3) for d in ("r1/lib/tiny", "r2/x/y/tiny") for i in range(4)],
        ("r1/null.go", "go", None),
        (None, "go", CODE),
    ]
    got = rows(fo.not_handwritten(files(spark, *r), entities(spark, "r9/node_modules/a/index.js", "r9/src/a.js", None)))
    want = ["r1/util/add.go", "r2/other/deep/plus.go", "r9/node_modules/a/index.js", *[f"{d}/t{i}.py" for d in ("r1/lib/tiny", "r2/x/y/tiny") for i in range(4)]]
    assert got == sorted((p, "vendored") for p in want)


def test_forks_are_no_copies_of_parts(spark):
    small = [(f"{k}/m/t{i}.py", "python", f"X{i} = {i}\nY{i} = [a, b, c, d]\n" * 3) for k in ("r1", "fork") for i in range(4)]
    assert rows(fo.vendored_by_hash(fo.features(files(spark, *small)))) == []


def test_paths_decide_without_content(spark):
    marked = ["r/vendor/a/x.go", "r/web/node_modules/x/i.js", "r/third_party/y.py", "r/api/x.pb.go", "r/static/app.min.js", "r/gen/a.go", "r/package-lock.json", "r/x/mock_y.go", "r/p/z_pb2_grpc.py"]
    plain = ["r/internal/vendors/x.go", "r/vendor_sync.go", "r/svc/generated_reports/a.go", "r/generated_names.py", "r/internal/distance/min.go", "r/bundle_plan.js", "r/genes/a.go"]
    got = rows(fo.not_handwritten(files(spark, *[(p, None, None) for p in marked + plain]), entities(spark)))
    assert [p for p, _ in got] == sorted(marked)


def test_empty(spark):
    assert rows(fo.not_handwritten(files(spark), entities(spark).limit(0))) == []
