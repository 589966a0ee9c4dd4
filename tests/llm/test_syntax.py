import ast
import glob
import json
import os
import warnings

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from stratalog.llm.syntax import check_source, language_of

GOOD = {
    "go": [
        "package p\n\nimport (\n\t\"fmt\"\n\tm \"math\"\n)\n\ntype Set[T comparable] struct {\n\tmu, x int `json:\"x\"`\n\tEmbedded\n\t*pkg.Other\n}\n\nfunc (s *Set[T]) Add(v T, more ...T) (n int, err error) {\n\tfor i, x := range more {\n\t\tif x == (T{}) { continue }\n\t\tgo func() { fmt.Println(i) }()\n\t}\n\tswitch y := any(v).(type) {\n\tcase int, []string:\n\t\treturn y.(int), nil\n\tdefault:\n\t}\n\tselect {\n\tcase a := <-ch:\n\tcase ch <- 1:\n\t}\nL:\n\tfor { break L }\n\treturn\n}\n",
        "package p; var a, b = map[string][]int{\"x\": {1, 2}}, [...]T{{1}, {2}}; const ( A = iota; B ); func f(int, string) {}",
        "package p\nfunc f() {\n\tx := a[1:2:3]\n\tx = <-c\n\tif v, ok := m[k]; ok && !(v > 1) {\n\t} else if x {\n\t} else {\n\t}\n\ty := []struct{ A int }{{1}}\n\tdefer func() { recover() }()\n}\n",
        "package p\ntype I interface {\n\t~int | ~string\n\tM(a int) error\n}\nfunc G[K comparable, V I](m map[K]V) chan<- int { return Max[K, V](m) }\n",
    ],
    "python": [
        "def f(a, /, b=1, *args: int, c, **kw) -> int:\n    return (yield)\n\nasync def g():\n    async with a as b, c:\n        await x\n    return [i async for i in y if i]\n",
        "match x:\n    case {'a': 1, **rest} | [1, *_]:\n        pass\n    case Point(x=0) as p if p:\n        pass\nmatch = case = 1\nprint(match)\n",
        "x = f\"{a!r:>{w}} {'q'} {b=}\" rb'' if 0 else lambda *a, **k: (a, k)\n".replace(" rb''", ""),
        "try:\n    pass\nexcept* (A, B) as e:\n    raise X from e\nelse:\n    x: int = 3\nfinally:\n    del a[0], b.c\n",
        "if (n := 10) > 5: print(n); x = 1\nwith (open(a) as f, open(b) as g):\n    pass\n@dec(1)\nclass A[T](B, metaclass=M): ...\n",
    ],
    "javascript": [
        "import a, { b as c } from './x'; export default class A extends B { static #p = 1; get x() { return this.#p } static { f(); } async *g() { yield* await z } }",
        "const f = async ({ a, ...b }, [c = 1] = []) => { for await (const x of y) { if (/[/{]\\/x/g.test(x)) return `a${`b${c}`}` } }\nlet g = (a, b) => ({ ...a, [b]: 1 })\n",
        "var a=b?c:d,e=!0;for(;;)break;do{}while(0)\nlabel: for (const k in o) continue label\ntry { f?.(x)?.[0] } catch { } finally { }\nx ??= a || b; y = a ** -b\n",
        "a\n++b\nconst s = 'it\\'s', n = 1_000n, o = { if: 1, get: 2, async() {} }\nif (a) b(); else c()\n",
    ],
    "typescript": [
        "export interface A<T extends B = C> { readonly x?: T[]; [k: string]: any; m(a: number): asserts a is string; new (x: T): A<T> }\ntype M = { readonly [K in keyof T as `x${K}`]?: T[K] extends infer U ? U : never }\n",
        "enum E { A = 1, B }\nabstract class X<T> extends Y<Map<string, Array<T>>> implements I { private constructor(readonly a: string, public b?: number) { super() } abstract f(): void; x!: number; }\nfunction f(this: X, a: string): void;\nfunction f(a: any) { return (<T>(x: T) => x)(a as unknown as string)! }\n",
        "declare module 'x' { export function g(a: number): string; global { var y: number } }\nnamespace N.M { export type F = (a: number, ...b: string[]) => a is string }\nlet v = f<string>(x) satisfies T, w = a < b, t: [a: string, b?: number, ...c: any[]];\nimport type { Q } from './q';\n",
    ],
    "json": ['{"a": [1, -0.5e3, true, null, "\\u00e9"], "b": {}}', " [] ", '"x"', "0"],
}
BAD = {
    "go": ["package p\nfunc f() {\n", "func f() {}", "package p\nfunc f() { x := }", "package p\n<<<<<<< HEAD\n", "package p\nvar s = “x”", "package p\nfunc f(a int, string b c) {}", "package p\nvar x = 'ab'", 'package p\nvar s = "a\nb"', "package p\nfunc f() { if { } }", "package p\n/* open"],
    "python": ["def f(:\n  pass", "if x\n    y", "x = (1,\n", "  x = 1\n", "if x:\ny = 1\n", "f() = 1", "print 'x'", "class", "x = 'a\n", "def f():\n    pass\n  x = 1\n", "try:\n    pass\nx = 1\n", "else:\n    pass\n", "f(a=1, 2)", "x = 08", "a = f'{x'", "return = 1", "for x y:\n    pass", "x = b'é'"],
    "javascript": ["const a", "let x = ;", "function (", "if (a { }", "export const x = `a", "import x from y", "a b", "class A { x() }", "return 1", "1 = x", "const f = () => {\n", "interface A { }", "x = {a: 1, b 2}", "await = 1", "<div/>", "function f() { await x }", "a ?? b || c", "let package = 1"],
    "typescript": ["interface A { x: }", "let x: = 1", "type T = ", "class A { constructor(private) x }", "enum E { A B }", "function f(a: string {", "let a: Array<string;"],
    "json": ["{'a': 1}", '{"a": 1,}', "[1 2]", "{", "", "nul", "01", '"a\nb"', "// x\n{}", '{"a" 1}', "NaN", "[1]]", '"\\x"'],
}


@pytest.mark.parametrize("language,text", [(k, t) for k, v in GOOD.items() for t in v])
def test_valid(language, text):
    assert check_source(language, text).found == []


@pytest.mark.parametrize("language,text", [(k, t) for k, v in BAD.items() for t in v if t])
def test_invalid(language, text):
    assert check_source(language, text).found


def test_places_and_recovery():
    e = check_source("go", "package p\n\nfunc f() {\n\tx := \n\ty := 1\n\tz := )\n}\n").found
    assert [line for line, _ in e] == [4, 6] or [line for line, _ in e][0] in (4, 5)
    assert len(check_source("python", "x = )\ny = 1\nz = ]\n").found) == 2
    assert check_source("json", '{"a": 1,\n "b" 2}').found[0][0] == 2
    assert check_source("javascript", "let a = 1;\nlet b = ;\nlet c = 3;\n").found[0][0] == 2


def test_order_of_shapes_does_not_matter():
    # what was accepted for one file is not accepted where it does not fit
    assert not check_source("javascript", "async function f() { await x; }").found
    assert check_source("javascript", "function f() { await x; }").found
    assert not check_source("javascript", "if (a) b();\nif (a) b(); else c();").found
    assert not check_source("go", "package p\nfunc f() {\n\tif a := b(); a {\n\t}\n}\n").found


@pytest.mark.parametrize("language", ["javascript", "typescript"])
def test_line_ends_count_in_remembered_shapes(language):
    for good, bad in (("throw x;", "throw\nx;"), ("f((a) => b);", "f((a)\n=> b);"), ("a++;", "a\n++;")):
        assert not check_source(language, good).found
        assert check_source(language, bad).found, bad
        assert not check_source(language, good).found
    assert not check_source(language, "f(\n  a,\n  b);\nf(\n  a,\n  b);").found


def test_line_ends_marks_and_null():
    for text in ("def f():\r\n    return 1\r\n", "﻿x = 1\n", "x = 1\r\r\n"):
        assert not check_source("python", text).found
    assert not check_source("go", "﻿package p\r\n\r\nfunc f() {\r\n}\r\n").found
    assert not check_source("javascript", "#!/usr/bin/env x\nf()\n").found
    assert check_source("go", "package p // \0\n").found
    for language in GOOD:
        assert not check_source(language, None).found and not check_source(language, " \n\t").found


def test_deep_and_long():
    assert not check_source("json", "[" * 800 + "]" * 800).found
    assert not check_source("json", "[" * 200_000 + "]" * 200_000).found
    assert not check_source("javascript", "x = [" + "1," * 200_000 + "];").found
    assert check_source("python", "x = 1\n" * 20_000 + "y = (\n").found


def test_what_is_too_deep_never_passes():
    """Whatever is wrong with it; JSON is judged at any depth."""
    assert check_source("json", "[" * 200_000 + "1 1" + "]" * 200_000).found
    assert len(check_source("json", "[" * 200_000).found) == 1
    assert check_source("json", "[" * 30_000).found and check_source("javascript", "x=" + "(" * 4000 + "1" + ")" * 3999).found and check_source("python", "[" * 9000 + "]" * 8999).found
    for language, before, text in (("javascript", "let a = ;\n", "x = {};\n"), ("typescript", "let a = ;\n", "x = {};\n"), ("python", "a = )\n", "x = {}\n"), ("go", "package p\nvar a = )\n", "var x = {}\n")):
        start, n = "package p\n" if language == "go" else "", 12_000 if language == "go" else 4000
        for inner, close in (("1", n), ("1 +", n), ("1", n - 1)):
            e = check_source(language, start + text.format("(" * n + inner + ")" * close))
            assert e.too_deep and "nested too deeply" in {what for _, what in e.found}, language
        e = check_source(language, before + text.format("(" * n + "1" + ")" * n))
        assert e.too_deep and e.found[0][0] == before.count("\n") and (before.count("\n") + 1, "nested too deeply") in e.found, language
    assert not check_source("go", "package p\nvar x = " + "(" * 400 + "1" + ")" * 400 + "\n").found


def test_languages():
    assert language_of("Go", "x.py") == "go" and language_of(None, "a/x.PY") == "python" and language_of(None, "x") is None
    assert language_of("", "x.go") is None and language_of("rust", "x.go") is None and language_of(None, None) is None


def test_own_sources_and_the_standard_library_agree_with_the_compiler():
    warnings.simplefilter("ignore")
    files = sorted(glob.glob(os.path.dirname(os.__file__) + "/*.py"))[:80] + glob.glob(os.path.dirname(__file__) + "/*.py")
    for f in files:
        text = open(f, encoding="utf-8").read()
        try:
            ast.parse(text)
            ok = True
        except SyntaxError:
            ok = False
        assert (not check_source("python", text).found) == ok, f


@settings(max_examples=150, deadline=None)
@given(st.recursive(st.none() | st.booleans() | st.integers() | st.floats(allow_nan=False, allow_infinity=False) | st.text(), lambda x: st.lists(x, max_size=3) | st.dictionaries(st.text(max_size=3), x, max_size=3), max_leaves=8), st.integers(0, 60), st.sampled_from(["", ",", "}", "]", '"', "1", ":"]))
def test_json_agrees_with_the_standard_parser(value, at, extra):
    text = json.dumps(value, ensure_ascii=False)
    text = text[:at] + extra + text[at:]
    try:
        json.loads(text)
        ok = True
    except ValueError:
        ok = False
    if text.strip() and "NaN" not in text and "Infinity" not in text:
        assert (not check_source("json", text).found) == ok


@settings(max_examples=60, deadline=None)
@given(st.text(max_size=200), st.sampled_from(sorted(GOOD)))
def test_any_text_ends(text, language):
    check_source(language, text)
