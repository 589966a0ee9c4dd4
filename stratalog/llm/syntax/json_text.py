"""JSON as in RFC 8259."""

from __future__ import annotations

import re

from .base import END, WRONG, Bad, Kinds, Parser

TOKEN = re.compile(r'"(?:[^"\\\x00-\x1f]|\\(?:["\\/bfnrt]|u[0-9a-fA-F]{4}))*"|-?(?:0|[1-9]\d*)(?:\.\d+)?(?:[eE][+-]?\d+)?|[a-zA-Z_]+|[\[\]{},:]|[^ \t\r\n]', re.A)


def _other(t: str) -> str:
    if t[0] == '"' and len(t) > 1:
        return "S"
    return "N" if t[-1] in "0123456789" else WRONG


K = Kinds("", "[ ] { } , :", _other)
K.names |= {w: "W" for w in ("true", "false", "null")}
K.update(K.names)
# two values side by side without a separator are caught by the grammar, as 01 is lexed as 0 and 1


class Json(Parser):
    kinds = K

    def value(self) -> None:
        """With the brackets that are open on a stack of its own, so that any depth is judged."""
        s, stack = self.s, []
        while True:
            c = s[self.p]
            if c in "SNW":
                self.p += 1
            elif c == "{":
                self.p += 1
                if not self.eat("}"):
                    stack.append("}")
                    self.key()
                    continue
            elif c == "[":
                self.p += 1
                if not self.eat("]"):
                    stack.append("]")
                    continue
            else:
                self.fail("a value")
            while stack:
                if s[self.p] == ",":
                    self.p += 1
                    if stack[-1] == "}":
                        self.key()
                    break
                self.need(stack.pop())
            else:
                return

    def key(self) -> None:
        self.need("S")
        self.need(":")


def parse(text: str) -> list[tuple[int, str]]:
    p = Json("".join(map(K.__getitem__, TOKEN.findall(text))))
    while p.s[p.p] != END:
        try:
            if p.p and not p.errors:
                p.fail("the end")
            p.value()
        except Bad as e:
            p.record(e)
            p.p = max(p.p, e.at) + 1
            p.sync(",")
            if p.s[p.p] in ")]}":
                p.p += 1
    starts = [m.start() for m in TOKEN.finditer(text)] if p.errors else []
    found = [(text.count("\n", 0, starts[at] if at < len(starts) else len(text)) + 1, what) for at, what in p.errors]
    return found
