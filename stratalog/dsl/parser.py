"""Source text to declarations: imports, selectors, flows, named queries. Rules are refused."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from .lexer import DslError, Token, tokens, unquote

#: Fixed value: the answer to a source with rules.
NO_RULES = "datalog rules deferred to P3; v0 supports selector/flow/query/import only"


@dataclass
class Lit:
    str: str | None = None
    int: int | None = None
    float: float | None = None


@dataclass
class Anchor:
    kind: str
    value: Lit | None = None


@dataclass
class Import:
    path: str
    alias: str


@dataclass
class Selector:
    name: str
    unique: bool = False
    anchors: list[Anchor] = field(default_factory=list)


@dataclass
class Step:
    name: str
    anchors: list[Anchor] = field(default_factory=list)


@dataclass
class Flow:
    name: str
    description: str = ""
    scope: str = ""
    risk: str = ""
    steps: list[Step] = field(default_factory=list)


@dataclass
class Query:
    name: str
    body: str


Decl = Import | Selector | Flow | Query


def has_rule(source: str) -> bool:
    """Is there a :- outside of strings and comments?"""
    bare = re.sub(r'"(?:\\.|[^"\\])*"|//[^\n]*|/\*.*?\*/', " ", source, flags=re.S)
    return ":-" in bare


class _Parser:
    def __init__(self, source: str):
        self.source, self.t, self.p = source, tokens(source), 0

    def peek(self) -> Token | None:
        return self.t[self.p] if self.p < len(self.t) else None

    def at(self, text: str) -> bool:
        return (t := self.peek()) is not None and t.kind in ("ident", "punct") and t.text == text

    def fail(self, want: str):
        t = self.peek()
        line = self.source.count("\n", 0, t.start if t else len(self.source)) + 1
        raise DslError(f"line {line}: unexpected {t.text if t else 'end'}, expected {want}")

    def word(self, text: str) -> None:
        if not self.at(text):
            self.fail(text)
        self.p += 1

    def take(self, kind: str) -> str:
        t = self.peek()
        if t is None or t.kind != kind:
            self.fail(kind)
        self.p += 1
        return unquote(t.text) if kind == "string" else t.text

    def literal(self) -> Lit | None:
        t = self.peek()
        if t is None or t.kind not in ("string", "int", "float"):
            return None
        self.p += 1
        return Lit(str=unquote(t.text)) if t.kind == "string" else Lit(int=int(t.text)) if t.kind == "int" else Lit(float=float(t.text))

    def file(self) -> list[Decl]:
        kinds = {"import": self.import_, "selector": self.selector, "flow": self.flow, "query": self.query}
        out = []
        while (t := self.peek()) is not None:
            if t.kind != "ident" or t.text not in kinds:
                self.fail("import, selector, flow or query")
            self.p += 1
            out.append(kinds[t.text]())
        return out

    def import_(self) -> Import:
        path = self.take("string")
        self.word("as")
        return Import(path, self.take("ident"))

    def selector(self) -> Selector:
        s = Selector(self.take("ident"))
        self.word("{")
        while not self.at("}"):
            if self.at("unique"):
                self.p += 1
                s.unique = True
            else:
                self.word("anchor")
                s.anchors.append(Anchor(self.take("ident"), self.literal()))
        self.p += 1
        return s

    def flow(self) -> Flow:
        f = Flow(self.take("ident"))
        self.word("{")
        for name, kind in (("description", "string"), ("scope", "ident"), ("risk", "ident")):
            if self.at(name):
                self.p += 1
                setattr(f, name, self.take(kind))
        while self.at("step"):
            self.p += 1
            step = Step(self.take("ident"))
            for w in ("targets", "selector", "{"):
                self.word(w)
            while not self.at("}"):
                kind = self.take("ident")
                value = self.literal()
                if value is None:
                    self.fail("a literal")
                step.anchors.append(Anchor(kind, value))
            if not step.anchors:
                self.fail("an anchor")
            self.p += 1
            f.steps.append(step)
        self.word("}")
        return f

    def query(self) -> Query:
        name = self.take("string")
        self.word("{")
        start = self.t[self.p - 1].end
        while not self.at("}"):
            if self.peek() is None:
                self.fail("}")
            self.p += 1
        self.p += 1
        return Query(name, self.source[start : self.t[self.p - 1].start].strip())


def parse(source: str) -> list[Decl]:
    """The declarations of a source text; DslError if it is none, with a message of its own for rules."""
    if has_rule(source):
        raise DslError(NO_RULES)
    return _Parser(source).file()
