"""Tokens of the declaration language: identifiers (with dots), strings, numbers, punctuation; comments fall away."""

from __future__ import annotations

import re
from dataclasses import dataclass

_TOKEN = re.compile(r'(?P<comment>//[^\n]*|/\*.*?\*/)|(?P<float>[-+]?\d+\.\d+)|(?P<int>[-+]?\d+)|(?P<ident>[a-zA-Z_][a-zA-Z0-9_.]*)|(?P<string>"(?:\\.|[^"\\])*")|(?P<punct>[{}()\[\],:=])|(?P<space>[ \t\r\n]+)', re.S)
_ESCAPES = {"n": "\n", "t": "\t", "r": "\r", '"': '"', "\\": "\\", "a": "\a", "b": "\b", "f": "\f", "v": "\v"}


class DslError(ValueError):
    """A text that is no valid source; the message names the line."""


@dataclass(frozen=True)
class Token:
    kind: str
    text: str
    start: int
    end: int


def unquote(s: str) -> str:
    return re.sub(r"\\(u[0-9a-fA-F]{4}|x[0-9a-fA-F]{2}|.)", lambda m: chr(int(m[1][1:], 16)) if len(m[1]) > 1 else _ESCAPES.get(m[1], m[1]), s[1:-1], flags=re.S)


def quote(s: str) -> str:
    back = {v: k for k, v in _ESCAPES.items()}
    return '"' + "".join("\\" + back[c] if c in back else c if c >= " " and c != "\x7f" else f"\\x{ord(c):02x}" for c in s) + '"'


def tokens(source: str) -> list[Token]:
    out, p = [], 0
    while p < len(source):
        m = _TOKEN.match(source, p)
        if not m:
            raise DslError(f"line {source.count(chr(10), 0, p) + 1}: invalid input {source[p : p + 10]!r}")
        if m.lastgroup not in ("comment", "space"):
            out.append(Token(m.lastgroup, m[0], m.start(), m.end()))
        p = m.end()
    return out
