"""Token kinds, the parser's base and the entry point."""

from __future__ import annotations

import re
import sys
from dataclasses import dataclass, field

#: End of input, and a token that no language has.
END, WRONG = "\0", "\1"
#: Accepted statement shapes kept per language, and the longest kept, in tokens; the table is emptied when full.
MOST_SHAPES, LONGEST_SHAPE = 200_000, 400
#: Nesting that a parse may reach (Python frames).
DEPTH = 20_000


class Bad(Exception):
    """A syntax error: the token at which it shows and what is wrong."""

    def __init__(self, at: int, what: str):
        super().__init__(what)
        self.at, self.what = at, what


class TooDeep(Exception):
    """Nested deeper than DEPTH: the errors, as (line, cause), that were found all the same."""

    def __init__(self, found: list[tuple[int, str]]):
        super().__init__("nested too deeply")
        self.found = found


@dataclass
class Errors:
    """All errors of a text as (line, cause), in order. JSON is judged at any depth; too_deep: other text nested deeper than DEPTH, which is an
    error, as the languages' own parsers refuse it as well; besides it there are the errors before that place and those of brackets."""

    found: list[tuple[int, str]] = field(default_factory=list)
    too_deep: bool = False


class Kinds(dict):
    """Token text to its kind (one character, or more for joined tokens; '' for what is dropped).

    Words and operators have their own characters; other tokens are classified by ``other`` and remembered while short.
    """

    def __init__(self, words: str, ops: str, other):
        self.names = {}
        code = 0x100
        for w in (*words.split(), *ops.split()):
            self.names[w] = w if len(w) == 1 and not w.isalnum() else chr(code)
            code += 1
        super().__init__(self.names)
        self.other, self.fixed, self.text = other, len(self), {v: k for k, v in self.names.items()}

    def __missing__(self, token: str) -> str:
        kind = self.other(token)
        if len(token) < 40:
            if len(self) > self.fixed + MOST_SHAPES:
                self.clear()
                self.update(self.names)
            self[token] = kind
        return kind

    def chars(self, tokens: str) -> str:
        return "".join(self.names[t] for t in tokens.split())


class Shapes(set):
    def keep(self, shape: str) -> None:
        if len(shape) <= LONGEST_SHAPE:
            if len(self) > MOST_SHAPES:
                self.clear()
            self.add(shape)


def unbalanced(s: str) -> Bad | None:
    """The first token at which the brackets among the kinds ``s`` do not match, at any depth."""
    stack: list[str] = []
    for m in re.finditer(r"[()\[\]{}]", s):
        c = m[0]
        if c in Parser.open:
            stack.append(Parser.close[Parser.open.index(c)])
        elif not stack or stack.pop() != c:
            return Bad(m.start(), f"unexpected {c}")
    return Bad(len(s.rstrip(END)), f"unexpected the end, expected {stack[-1]}") if stack else None


class Parser:
    """s: kinds of the tokens, ended by END. p: the next token."""

    kinds: Kinds
    open, close = "([{", ")]}"

    def __init__(self, s: str):
        self.s, self.p, self.errors = s + END * 4, 0, []

    def name(self, c: str) -> str:
        fixed = {"I": "a name", "N": "a number", "S": "a string", "T": "a template", "R": "a regular expression", END: "the end", WRONG: "a character that is no token"}
        return fixed.get(c) or self.kinds.text.get(c, c)

    def fail(self, want: str = ""):
        raise Bad(self.p, f"unexpected {self.name(self.s[self.p])}" + (f", expected {want}" if want else ""))

    def need(self, c: str) -> None:
        if self.s[self.p] != c:
            self.fail(self.name(c))
        self.p += 1

    def eat(self, c: str) -> bool:
        if self.s[self.p] == c:
            self.p += 1
            return True
        return False

    def record(self, e: Bad) -> None:
        self.errors.append((e.at, e.what))

    def judged(self, run) -> bool:
        """Runs the parse; False if it got too deep. The brackets behind the errors found until then are judged without it."""
        try:
            run()
            return True
        except RecursionError:
            e = unbalanced(self.s)
            if e and all(at < e.at for at, _ in self.errors):
                self.record(e)
            return False

    def sync(self, semi: str) -> None:
        """Panic mode: skip to behind the next statement end on this level, or to the bracket that ends the level."""
        s, p, depth = self.s, self.p, 0
        while s[p] != END:
            c = s[p]
            if c in self.open:
                depth += 1
            elif c in self.close:
                if depth == 0:
                    break
                depth -= 1
                if depth == 0 and c == "}":
                    p += 1
                    break
            elif c == semi and depth == 0:
                p += 1
                break
            p += 1
        self.p = p


#: Extensions by which a file without a language is read.
EXTENSIONS = {"go": "go", "py": "python", "js": "javascript", "ts": "typescript", "json": "json"}
BLANK = re.compile(r"\s*\Z")


def language_of(language_id: str | None, path: str | None) -> str | None:
    """The language that is meant; None if it is none of the five. Only a null language_id leaves it to the path."""
    if language_id is not None:
        known = language_id.strip().lower()
        return known if known in EXTENSIONS.values() else None
    return EXTENSIONS.get((path or "").rpartition(".")[2].strip().lower()) if "." in (path or "") else None


def check_source(language: str, text: str | None) -> Errors:
    """Errors of ``text``. Null and blank texts have none."""
    from . import ecma, golang, json_text, python3

    if text is None or BLANK.match(text):
        return Errors()
    if sys.getrecursionlimit() < DEPTH:
        sys.setrecursionlimit(DEPTH)
    if "\0" in text and language in ("go", "python"):  # not allowed anywhere, be it in a comment
        return Errors([(text.count("\n", 0, text.index("\0")) + 1, "a null character")])
    parse = {"go": golang.parse, "python": python3.parse, "javascript": ecma.parse_js, "typescript": ecma.parse_ts, "json": json_text.parse}[language]
    try:
        return Errors(parse(text))
    except TooDeep as e:
        found = e.found
    except RecursionError:
        found = []
    return Errors(sorted([*found, (deepest_line(text), "nested too deeply")]), too_deep=True)


def deepest_line(text: str) -> int:
    """The line of the bracket that lies deepest, or 1."""
    depth = most = at = 0
    for m in re.finditer(r"[()\[\]{}]", text):
        depth += 1 if m[0] in Parser.open else -1
        if depth > most:
            most, at = depth, m.start()
    return text.count("\n", 0, at) + 1
