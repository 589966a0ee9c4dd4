"""Declarations as canonical text, which parses to the same declarations."""

from __future__ import annotations

from .lexer import quote
from .parser import Anchor, Decl, Flow, Import, Lit, Query, Selector


def literal(v: Lit | None) -> str:
    if v is None:
        return ""
    if v.str is not None:
        return quote(v.str)
    if v.int is not None:
        return str(v.int)
    # with a decimal point, so that it stays a float
    text = f"{v.float:f}".rstrip("0")
    return text + "0" if text.endswith(".") else text


def _anchor(a: Anchor) -> str:
    return f"{a.kind} {literal(a.value)}".rstrip()


def declaration(d: Decl) -> str:
    if isinstance(d, Import):
        return f"import {quote(d.path)} as {d.alias}\n"
    if isinstance(d, Query):
        return f"query {quote(d.name)} {{\n{d.body.strip()}\n}}\n"
    if isinstance(d, Selector):
        lines = ["  unique"] * d.unique + [f"  anchor {_anchor(a)}" for a in d.anchors]
        return "\n".join([f"selector {d.name} {{", *lines, "}"]) + "\n"
    assert isinstance(d, Flow)
    lines = [f"  description {quote(d.description)}"] * bool(d.description) + [f"  scope {d.scope}"] * bool(d.scope) + [f"  risk {d.risk}"] * bool(d.risk)
    lines += [f"  step {s.name} targets selector {{ {' '.join(map(_anchor, s.anchors))} }}" for s in d.steps]
    return "\n".join([f"flow {d.name} {{", *lines, "}"]) + "\n"


def render(decls: list[Decl]) -> str:
    return "\n".join(map(declaration, decls))


def describe(source: str, seq: int) -> dict:
    """What the query command answers: the declarations' number and canonical text at a seq. Nothing is evaluated."""
    from .parser import parse

    decls = parse(source)
    return {"resolved_at_kernel_seq": seq, "declarations": len(decls), "canonical": render(decls)}
