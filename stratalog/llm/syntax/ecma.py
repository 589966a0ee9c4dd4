"""JavaScript and TypeScript modules."""

from __future__ import annotations

import re
from itertools import accumulate

from .base import END, LONGEST_SHAPE, WRONG, Bad, Kinds, Parser, Shapes, TooDeep

# reserved words; the others (of, as, type, ...) are names that the grammar knows by context
_WORDS = "break case catch class const continue debugger default delete do else enum export extends false finally for function if import in instanceof new null return super switch this throw true try typeof var void while with yield await let static async of as from get set type interface namespace module declare abstract readonly public private protected override implements keyof infer is asserts satisfies unique accessor target meta constructor using package"
_OPS = ">>>= **= <<= >>= &&= ||= ??= === !== ... >>> ** ++ -- << >> <= >= == != => && || ?? ?. += -= *= /= %= &= |= ^= + - * / % & | ^ ! ~ < > ? : = ( ) [ ] { } , ; . @"
_RE = r"/(?![*/])(?:[^/\\\[\n]|\\[^\n]|\[(?:[^\]\\\n]|\\[^\n])*\])+/[a-zA-Z]*"
_BEFORE_RE = "|".join(re.escape(o) for o in _OPS.split() if o not in (")", "]", ".", "?.", "++", "--", "@", "/"))
_NAME = r"(?:[^\W\d]|[$])(?:[\w$\u200c\u200d]|\\u(?:[0-9a-fA-F]{4}|\{[0-9a-fA-F]+\}))*"
_ESC = r"\\(?:\r\n|x[0-9a-fA-F]{2}|u[0-9a-fA-F]{4}|u\{[0-9a-fA-F]+\}|0(?!\d)|[^xu\d\r])"
TOKEN = re.compile(
    r"\n|//[^\n\u2028\u2029]*|/\*.*?\*/|/\*"
    # a slash begins a regular expression behind these, which are matched together with it
    rf"|(?:{_BEFORE_RE}|\b(?:return|typeof|case|in|of|delete|void|throw|new|do|else|yield|await|instanceof)\b)\s*{_RE}"
    rf"|\#?{_NAME}"
    r"|(?:0[xX][\da-fA-F]+(?:_[\da-fA-F]+)*|0[bB][01]+(?:_[01]+)*|0[oO][0-7]+(?:_[0-7]+)*|(?:(?:0|[1-9]\d*(?:_\d+)*)(?:\.(?:\d+(?:_\d+)*)?)?|\.\d+(?:_\d+)*)(?:[eE][+-]?\d+)?)n?"
    rf"|\"(?:[^\"\\\n]|{_ESC})*\"|'(?:[^'\\\n]|{_ESC})*'|`(?:[^`\\]|\\.)*`|" + "|".join(re.escape(o) + r"(?!\d)" * (o == "?.") for o in _OPS.split()) + r"|[^\s\x1c-\x1f\x85]|[\x1c-\x1f\x85]",
    re.S,
)
_JOINED = re.compile(rf"(\S+?)\s*({_RE})\Z")
_FIELD = re.compile(r"\$\{[A-Za-z_$][\w$]*(?:\.[A-Za-z_$][\w$]*)*\}")


def _other(t: str) -> str:
    c = t[0]
    if c == "\n":
        return "\n"
    if t[:2] == "//":
        return ""
    if t[:2] == "/*":
        return WRONG if len(t) == 2 else "\n" if "\n" in t else ""
    if c in "\"'":
        return "S" if len(t) > 1 else WRONG
    if c == "`":
        return WRONG if len(t) == 1 else _template(t[1:-1])
    if c.isdigit() or c == "." and len(t) > 1:
        return "N"
    if c in "_$" or c.isalpha():
        m = _JOINED.match(t) if "/" in t else None
        return (K[m[1]] + "R") if m else "I"
    if c == "#":
        return "#" if len(t) > 1 else WRONG
    if c == "/" and len(t) > 1:
        return "R"
    m = _JOINED.match(t)
    return (K[m[1]] + ("\n" if "\n" in t[m.end(1) : m.start(2)] and m[1] in "})" else "") + "R") if m else WRONG


NESTED = "\2"  # a template that holds further ones, to be lexed with care


def _template(body: str) -> str:
    if "${" not in body:
        return "T"
    rest = _FIELD.sub("", body)
    if "${" not in rest:
        return "T"
    p = 0
    while (p := rest.find("${", p)) >= 0:
        if p and rest[p - 1] == "\\":
            p += 2
            continue
        end = close_of(rest, p + 2)
        if end < 0:
            return NESTED
        if not expression_ok(rest[p + 2 : end]):
            return WRONG
        p = end + 1
    return "T"


def close_of(t: str, p: int) -> int:
    """The place of the } that ends the field which begins at p, -1 if there is none."""
    depth, n = 0, len(t)
    while p < n:
        c = t[p]
        if c in "\"'":
            q = p + 1
            while q < n and t[q] != c:
                q += 2 if t[q] == "\\" else 1
            p = q
        elif c == "`":
            p = template_end(t, p + 1)
            if p < 0:
                return -1
        elif c == "{":
            depth += 1
        elif c == "}":
            if not depth:
                return p
            depth -= 1
        p += 1
    return -1


def template_end(t: str, p: int) -> int:
    """The place of the ` that ends the template whose text begins at p, -1 if there is none."""
    while p < len(t):
        if t[p] == "\\":
            p += 1
        elif t[p] == "`":
            return p
        elif t[p : p + 2] == "${":
            p = close_of(t, p + 2)
            if p < 0:
                return -1
        p += 1
    return -1


def expression_ok(text: str) -> bool:
    s, nl = kinds_of(text)
    if WRONG in s:
        return False
    for part in (Ecma.expression, Ecma.type):  # templates are types as well
        p = Ecma(s, nl, True)
        p.await_ok = p.yield_ok = True
        try:
            part(p)
            if p.s[p.p] == END:
                return True
        except Bad:
            pass
    return False


K = Kinds(_WORDS, _OPS, _other)
k = K.names


def _slow_tokens(text: str) -> list[str]:
    out, p = [], 0
    while m := TOKEN.search(text, p):
        t = m[0]
        if t[0] == "`" and len(t) > 1:
            end = template_end(text, m.start() + 1)
            if end < 0:
                out.append("`")
                p = m.start() + 1
                continue
            body = text[m.start() + 1 : end]
            ok, q = True, 0
            while (q := body.find("${", q)) >= 0:
                if q and body[q - 1] == "\\":
                    q += 2
                    continue
                e = close_of(body, q + 2)
                ok &= expression_ok(body[q + 2 : e])
                q = e + 1
            out.append("``" if ok else "`")
            p = end + 1
            continue
        out.append(t)
        p = m.end()
    return out


def kinds_of(text: str) -> tuple[str, set[int]]:
    """Kinds of all tokens, and which of them stand first on a line."""
    s = "".join(map(K.__getitem__, TOKEN.findall(text)))
    if NESTED in s:
        s = "".join(map(K.__getitem__, _slow_tokens(text)))
    parts = s.split("\n")
    return "".join(parts), set(accumulate(map(len, parts)))


(BREAK, CASE, CATCH, CLASS, CONST, CONTINUE, DEBUGGER, DEFAULT, DELETE, DO, ELSE, ENUM, EXPORT, EXTENDS, FALSE, FINALLY, FOR, FUNCTION, IF, IMPORT, IN, INSTANCEOF, NEW, NULL, RETURN, SUPER, SWITCH, THIS, THROW, TRUE, TRY, TYPEOF, VAR, VOID, WHILE, WITH, YIELD, AWAIT, LET, STATIC, ASYNC, OF, AS, FROM, GET, SET, TYPE, INTERFACE, NAMESPACE, MODULE, DECLARE, ABSTRACT, READONLY, PUBLIC, PRIVATE, PROTECTED, OVERRIDE, IMPLEMENTS, KEYOF, INFER, IS, ASSERTS, SATISFIES, UNIQUE, ACCESSOR, TARGET, META, CONSTRUCTOR, USING, PACKAGE) = (k[w] for w in _WORDS.split())
ARROW, SPREAD, OPT, INC, DEC, NULLISH, ANDAND, OROR, POW = (k[o] for o in "=> ... ?. ++ -- ?? && || **".split())
SHR, USHR, GE, SHRA, USHRA = (k[o] for o in ">> >>> >= >>= >>>=".split())
#: Reserved in modules; what follows YIELD in the list of words are names unless the grammar takes them otherwise.
RESERVED = set(K.chars(" ".join(_WORDS.split()[: _WORDS.split().index("yield")]))) | {YIELD, AWAIT, LET, STATIC, IMPLEMENTS, INTERFACE, PRIVATE, PROTECTED, PUBLIC, PACKAGE}
WORDS = set(K.chars(_WORDS)) | {"I"}
NAMES = (WORDS - RESERVED) | {"I"}
PREC = {k[o]: n for n, ops in enumerate(("??", "||", "&&", "|", "^", "&", "== != === !==", "< > <= >= instanceof in", "<< >> >>>", "+ -", "* / %", "**"), 1) for o in ops.split()}
ASSIGN = set(K.chars(">>>= **= <<= >>= &&= ||= ??= += -= *= /= %= &= |= ^= ="))
UNARY = set(K.chars("delete void typeof + - ~ !"))
MODIFIERS = {PUBLIC, PRIVATE, PROTECTED, READONLY, ABSTRACT, OVERRIDE, DECLARE, STATIC, ACCESSOR}
SHAPES = {False: Shapes(), True: Shapes()}


class Ecma(Parser):
    """Expressions return what they are: n name, m member, p pattern-like literal, u unary, l of && or ||, o other."""

    kinds = K

    def __init__(self, s: str, nl: set[int], ts: bool):
        super().__init__(s)
        self.nl, self.ts, self.shapes = nl, ts, SHAPES[ts]
        self.await_ok, self.in_ok, self.yield_ok, self.in_function, self.ambient = True, True, False, False, False
        self.no_cond = False  # within the extends part of a conditional type

    def ctx(self) -> str:
        return f"{self.await_ok:d}{self.yield_ok:d}{self.in_function:d}{self.ambient:d}"

    # statements ------------------------------------------------------------------------------------------------------
    def semi(self) -> None:
        c = self.s[self.p]
        if c == ";":
            self.p += 1
        elif c != "}" and c != END and self.p not in self.nl:
            self.fail("; or a new line")

    def file(self) -> None:
        while True:
            self.statements()
            if self.s[self.p] == END:
                return
            self.record(Bad(self.p, f"unexpected {self.name(self.s[self.p])}"))
            self.p += 1

    def statements(self) -> None:
        s, nl = self.s, self.nl
        ctx = self.ctx()
        while True:
            c = s[self.p]
            if c == "}" or c == END or c == CASE or c == DEFAULT:
                return
            start = self.p
            stop = s.find(";", start) + 1
            key = ctx + s[start:stop] if 0 < stop - start < LONGEST_SHAPE else ""
            if key and not nl.isdisjoint(range(start + 1, stop)):
                # a line end within may end a statement or be forbidden, so its place counts
                key += "".join([chr(i - start) for i in range(start + 1, stop) if i in nl])
            if key and key in self.shapes:
                self.p = stop
                continue
            try:
                self.statement()
                # whether an if ends here depends on what follows
                if key and self.p == stop and IF not in key:
                    self.shapes.keep(key)
            except Bad as e:
                self.record(e)
                self.in_ok = True
                self.await_ok, self.yield_ok, self.in_function, self.ambient = (x == "1" for x in ctx)
                if self.p < e.at:
                    self.p = e.at
                self.sync(";")
                if self.p == start or s[self.p] in ")]":
                    self.p += 1

    def block(self) -> None:
        self.need("{")
        self.statements()
        self.need("}")

    def statement(self) -> None:
        s, c = self.s, self.s[self.p]
        n = s[self.p + 1]
        if c == "{":
            self.block()
        elif c == ";":
            self.p += 1
        elif c == VAR or c == CONST or c == LET and (n in NAMES or n in "[{" or n in (YIELD, AWAIT)):
            if c == CONST and n == ENUM and self.ts:
                self.p += 1
                return self.enum()
            self.p += 1
            self.declarators(c == CONST)
            self.semi()
        elif self.ts and (c == USING and n in NAMES and s[self.p + 2] == "=" or c == AWAIT and n == USING and s[self.p + 2] in NAMES):
            self.p += 1 + (c == AWAIT)
            self.declarators(True)
            self.semi()
        elif c == FUNCTION:
            self.function(True)
        elif c == ASYNC and n == FUNCTION and self.p + 1 not in self.nl:
            self.function(True)
        elif c == CLASS or c == "@":
            self.class_(True)
        elif c == IF:
            self.p += 1
            self.condition()
            self.statement()
            if self.eat(ELSE):
                self.statement()
        elif c == FOR:
            self.for_()
        elif c == WHILE:
            self.p += 1
            self.condition()
            self.statement()
        elif c == DO:
            self.p += 1
            self.statement()
            self.need(WHILE)
            self.condition()
            self.eat(";")
        elif c == RETURN:
            if not self.in_function:
                self.fail("return only in a function")
            self.p += 1
            if s[self.p] not in ";}" + END and self.p not in self.nl:
                self.expression()
            self.semi()
        elif c == THROW:
            self.p += 1
            if self.p in self.nl:
                self.fail("an expression on the line of throw")
            self.expression()
            self.semi()
        elif c == BREAK or c == CONTINUE:
            self.p += 1
            if s[self.p] in NAMES and self.p not in self.nl:
                self.p += 1
            self.semi()
        elif c == SWITCH:
            self.p += 1
            self.condition()
            self.need("{")
            while not self.eat("}"):
                if self.eat(CASE):
                    self.expression()
                else:
                    self.need(DEFAULT)
                self.need(":")
                self.statements()
        elif c == TRY:
            self.p += 1
            self.block()
            if s[self.p] not in (CATCH, FINALLY):
                self.fail("catch or finally")
            if self.eat(CATCH):
                if self.eat("("):
                    self.binding()
                    if self.ts and self.eat(":"):
                        self.type()
                    self.need(")")
                self.block()
            if self.eat(FINALLY):
                self.block()
        elif c == DEBUGGER:
            self.p += 1
            self.semi()
        elif c == IMPORT and n != "(" and n != ".":
            self.import_()
        elif c == EXPORT:
            self.export()
        elif c in NAMES and n == ":":
            self.p += 2
            self.statement()
        elif self.ts and self.ts_statement(c, n):
            pass
        else:
            self.expression()
            self.semi()

    def ts_statement(self, c: str, n: str) -> bool:
        s = self.s
        same = self.p + 1 not in self.nl
        if c == TYPE and n in NAMES and same and s[self.p + 2] in "=<":
            self.p += 2
            self.type_params()
            self.need("=")
            self.type()
            self.semi()
        elif c == INTERFACE and n in NAMES and same:
            self.p += 2
            self.type_params()
            if self.eat(EXTENDS):
                self.type()
                while self.eat(","):
                    self.type()
            self.object_type()
        elif c == ENUM:
            self.enum()
        elif c in (NAMESPACE, MODULE) and (n in NAMES or n == "S") and same:
            self.p += 2
            while self.eat("."):
                self.word()
            if s[self.p] == "{":
                self.block()
            else:
                self.semi()
        elif c == ABSTRACT and n == CLASS:
            self.p += 1
            self.class_(True)
        elif c == DECLARE and same and (n in (VAR, CONST, LET, FUNCTION, CLASS, ENUM, NAMESPACE, MODULE, TYPE, INTERFACE, ABSTRACT, ASYNC) or s[self.p + 1 : self.p + 3] == "I{"):
            self.p += 1
            ambient, self.ambient = self.ambient, True
            if s[self.p] == "I":  # declare global
                self.p += 1
                self.block()
            else:
                self.statement()
            self.ambient = ambient
        elif self.ambient and c == "I" and n == "{":  # global, within a declared module
            self.p += 1
            self.block()
        else:
            return False
        return True

    def enum(self) -> None:
        self.need(ENUM)
        self.ident()
        self.need("{")
        while self.s[self.p] != "}":
            self.property_name()
            if self.eat("="):
                self.assignment()
            if not self.eat(","):
                break
        self.need("}")

    def word(self) -> None:
        if self.s[self.p] not in WORDS:
            self.fail("a name")
        self.p += 1

    def ident(self) -> None:
        c = self.s[self.p]
        if c not in NAMES:
            self.fail("a name")
        self.p += 1

    def condition(self) -> None:
        self.need("(")
        self.with_in(self.expression)
        self.need(")")

    def with_in(self, parse):
        in_ok, self.in_ok = self.in_ok, True
        what = parse()
        self.in_ok = in_ok
        return what

    def declarators(self, const: bool, for_head: bool = False) -> int:
        """How many; -1 if any has a value."""
        n, valued = 0, False
        while True:
            at = self.s[self.p]
            self.binding()
            n += 1
            if self.ts:
                if self.s[self.p] == "!":
                    self.p += 1
                if self.eat(":"):
                    self.type()
            if self.eat("="):
                self.assignment()
                valued = True
            elif not for_head and not self.ambient and (const or at in "[{"):
                self.fail("=")
            if not self.eat(","):
                return -1 if valued else n

    def binding(self) -> None:
        s, c = self.s, self.s[self.p]
        if c == "[":
            self.p += 1
            while s[self.p] != "]":
                if s[self.p] == ",":
                    self.p += 1
                    continue
                if self.eat(SPREAD):
                    self.binding()
                    break
                self.binding()
                if self.eat("="):
                    self.with_in(self.assignment)
                if s[self.p] != "]":
                    self.need(",")
            self.need("]")
        elif c == "{":
            self.p += 1
            while s[self.p] != "}":
                if self.eat(SPREAD):
                    self.binding()
                    break
                lone = s[self.p] in NAMES
                self.property_name()
                if self.eat(":"):
                    self.binding()
                elif not lone:
                    self.fail(":")
                if self.eat("="):
                    self.with_in(self.assignment)
                if not self.eat(","):
                    break
            self.need("}")
        else:
            self.ident()

    def property_name(self) -> None:
        c = self.s[self.p]
        if c in WORDS or c in "SN#":
            self.p += 1
        elif c == "[":
            self.p += 1
            self.with_in(self.assignment)
            self.need("]")
        else:
            self.fail("a property name")

    def for_(self) -> None:
        s = self.s
        self.p += 1
        awaited = self.eat(AWAIT)
        self.need("(")
        c = s[self.p]
        in_ok, self.in_ok = self.in_ok, False
        if c == ";":
            self.in_ok = in_ok
            return self.for_rest()
        if c in (VAR, CONST, LET):
            self.p += 1
            n = self.declarators(c == CONST, True)
            self.in_ok = in_ok
            if n == 1 and s[self.p] in (OF, IN):
                of = s[self.p] == OF
                self.p += 1
                self.assignment() if of else self.expression()
                self.need(")")
                return self.statement()
            if n > 0 and c == CONST and not self.ambient:
                self.fail("of or in")
        else:
            at = self.p
            what = self.expression()
            self.in_ok = in_ok
            if s[self.p] in (OF, IN):
                if what not in "nmp":
                    raise Bad(at, "cannot assign to this expression")
                of = s[self.p] == OF
                self.p += 1
                self.assignment() if of else self.expression()
                self.need(")")
                return self.statement()
        if awaited:
            self.fail("of")
        self.for_rest()

    def for_rest(self) -> None:
        s = self.s
        self.need(";")
        if s[self.p] != ";":
            self.expression()
        self.need(";")
        if s[self.p] != ")":
            self.expression()
        self.need(")")
        self.statement()

    def import_(self) -> None:
        s = self.s
        self.p += 1
        if self.eat("S"):
            self.attributes()
            return self.semi()
        if self.ts and s[self.p] == TYPE and (s[self.p + 1] in "{*" or s[self.p + 1] in WORDS and s[self.p + 1] != FROM or s[self.p + 1 : self.p + 3] == FROM + FROM):
            self.p += 1
        if s[self.p] in NAMES:
            self.p += 1
            if self.ts and self.eat("="):
                self.expression()
                return self.semi()
            if s[self.p] == ",":
                self.p += 1
                if s[self.p] not in "{*":
                    self.fail("{")
            else:
                return self.from_()
        if self.eat("*"):
            self.need(AS)
            self.ident()
        else:
            self.specifiers()
        self.from_()

    def from_(self) -> None:
        self.need(FROM)
        self.need("S")
        self.attributes()
        self.semi()

    def attributes(self) -> None:
        if self.s[self.p] == WITH or self.s[self.p] == "I" and self.p not in self.nl and self.s[self.p + 1] == "{":
            self.p += 1
            self.object_literal()

    def specifiers(self) -> None:
        s = self.s
        self.need("{")
        while s[self.p] != "}":
            if self.ts and s[self.p] == TYPE and s[self.p + 1] in WORDS and s[self.p + 1] != AS:
                self.p += 1
            if not self.eat("S"):
                self.word()
            if self.eat(AS):
                if not self.eat("S"):
                    self.word()
            if not self.eat(","):
                break
        self.need("}")

    def export(self) -> None:
        s = self.s
        self.p += 1
        c, n = s[self.p], s[self.p + 1]
        if c == DEFAULT:
            self.p += 1
            c, n = s[self.p], s[self.p + 1]
            if c == FUNCTION or c == ASYNC and n == FUNCTION and self.p + 1 not in self.nl:
                self.function(False)
            elif c == CLASS or c == "@":
                self.class_(False)
            elif self.ts and c == ABSTRACT and n == CLASS:
                self.p += 1
                self.class_(False)
            elif self.ts and c == INTERFACE:
                self.statement()
            else:
                self.assignment()
                self.semi()
        elif c == "*":
            self.p += 1
            if self.eat(AS):
                if not self.eat("S"):
                    self.word()
            self.from_()
        elif c == "{" or self.ts and c == TYPE and n in "{*":
            if c == TYPE:
                self.p += 1
                if self.eat("*"):
                    if self.eat(AS):
                        self.word()
                    return self.from_()
            self.specifiers()
            if s[self.p] == FROM:
                self.from_()
            else:
                self.semi()
        elif c in (VAR, CONST, LET, FUNCTION, CLASS, "@") or c == ASYNC and n == FUNCTION:
            self.statement()
        elif self.ts and self.eat("="):
            self.expression()
            self.semi()
        elif self.ts and c == AS and n == NAMESPACE:
            self.p += 2
            self.ident()
            self.semi()
        elif self.ts and c == IMPORT:
            self.import_()
        elif not (self.ts and self.ts_statement(c, n)):
            self.fail("a declaration")

    # functions and classes -------------------------------------------------------------------------------------------
    def function(self, named: bool) -> None:
        is_async = self.eat(ASYNC)
        self.need(FUNCTION)
        star = self.eat("*")
        if named or self.s[self.p] in WORDS:
            if self.s[self.p] not in NAMES and self.s[self.p] not in (AWAIT, YIELD):
                self.fail("a name")
            self.p += 1
        self.callable(is_async, star, True)

    def callable(self, is_async: bool, star: bool, bodiless: bool = False) -> None:
        """Type parameters, parameters, return type and body. TypeScript has functions without a body (overloads)."""
        old = self.await_ok, self.yield_ok, self.in_function, self.in_ok
        if self.ts:
            self.type_params()
        self.await_ok, self.yield_ok, self.in_function, self.in_ok = is_async, star, True, True
        self.params()
        if self.ts and self.eat(":"):
            self.return_type()
        if self.s[self.p] == "{" or not (self.ts and bodiless):
            ambient, self.ambient = self.ambient, False
            self.block()
            self.ambient = ambient
        else:
            self.semi()
        self.await_ok, self.yield_ok, self.in_function, self.in_ok = old

    def params(self) -> None:
        s = self.s
        self.need("(")
        while s[self.p] != ")":
            while s[self.p] == "@":
                self.decorator()
            if self.ts:
                while s[self.p] in MODIFIERS and (s[self.p + 1] in WORDS or s[self.p + 1] in "{["):
                    self.p += 1
                if s[self.p] == THIS:
                    self.p += 1
                    self.need(":")
                    self.type()
                    if not self.eat(","):
                        break
                    continue
            rest = self.eat(SPREAD)
            self.binding()
            if self.ts:
                self.eat("?")
                if self.eat(":"):
                    self.type()
            if not rest and self.eat("="):
                self.assignment()
            if rest:
                break
            if not self.eat(","):
                break
        self.need(")")

    def decorator(self) -> None:
        self.p += 1
        if self.s[self.p] == "(":
            self.condition()
        else:
            self.word()
            while self.eat("."):
                self.word()
            if self.ts and self.s[self.p] == "<":
                self.type_args()
            if self.s[self.p] == "(":
                self.arguments()

    def class_(self, named: bool) -> None:
        s = self.s
        while s[self.p] == "@":
            self.decorator()
        if s[self.p] == EXPORT:
            return self.export()
        if self.ts:
            self.eat(ABSTRACT)
        self.need(CLASS)
        if s[self.p] in NAMES and not (s[self.p] == IMPLEMENTS):
            self.p += 1
        elif named:
            self.fail("a name")
        if self.ts:
            self.type_params()
        if self.eat(EXTENDS):
            self.subscripts(self.primary())
            if self.ts and s[self.p] == "<":
                self.type_args()
        if self.ts and self.eat(IMPLEMENTS):
            self.type()
            while self.eat(","):
                self.type()
        self.need("{")
        while not self.eat("}"):
            if s[self.p] == END:
                self.fail("}")
            if not self.eat(";"):
                self.member()

    def member(self) -> None:
        s = self.s
        while s[self.p] == "@":
            self.decorator()
        ends = "(=;}:?!<"
        if s[self.p] == STATIC and s[self.p + 1] == "{":
            self.p += 1
            old = self.await_ok, self.in_function
            self.await_ok, self.in_function = False, False
            self.block()
            self.await_ok, self.in_function = old
            return
        mods = MODIFIERS if self.ts else {STATIC, ACCESSOR}
        while s[self.p] in mods and s[self.p + 1] not in ends and s[self.p + 1] != END:
            self.p += 1
        is_async = star = False
        if s[self.p] == ASYNC and s[self.p + 1] not in ends and self.p + 1 not in self.nl:
            self.p += 1
            is_async = True
        if self.eat("*"):
            star = True
        if s[self.p] in (GET, SET) and s[self.p + 1] not in ends and not star and not is_async and self.p + 1 not in self.nl:
            self.p += 1
        if self.ts and s[self.p] == "[" and s[self.p + 1] in WORDS and s[self.p + 2] == ":":
            self.index_signature()
            return self.semi()
        self.property_name()
        if self.ts and s[self.p] in "?!":
            self.p += 1
        if s[self.p] == "(" or self.ts and s[self.p] == "<":
            return self.callable(is_async, star, True)
        if is_async or star:
            self.fail("(")
        if self.ts and self.eat(":"):
            self.type()
        if self.eat("="):
            old = self.await_ok
            self.await_ok = False
            self.with_in(self.assignment)
            self.await_ok = old
        self.semi()

    # expressions -----------------------------------------------------------------------------------------------------
    def expression(self) -> str:
        what = self.assignment()
        while self.s[self.p] == ",":
            self.p += 1
            self.assignment()
            what = "o"
        return what

    def assignment(self) -> str:
        s, c = self.s, self.s[self.p]
        n = s[self.p + 1]
        if n == ARROW and (c in NAMES):
            self.p += 2
            self.arrow_body(False)
            return "o"
        if c == ASYNC and n in NAMES and s[self.p + 2] == ARROW and self.p + 1 not in self.nl:
            self.p += 3
            self.arrow_body(True)
            return "o"
        if c == "(" or c == ASYNC and n == "(" and self.p + 1 not in self.nl or self.ts and c == "<":
            if self.arrow():
                return "o"
        if c == YIELD and self.yield_ok:
            self.p += 1
            if self.eat("*"):
                self.assignment()
            elif self.p not in self.nl and s[self.p] not in ")]},;:" and s[self.p] != END:
                self.assignment()
            return "o"
        at = self.p
        what = self.conditional()
        if s[self.p] in ASSIGN:
            if what not in ("nmp" if s[self.p] == "=" else "nm"):
                raise Bad(at, "cannot assign to this expression")
            self.p += 1
            self.assignment()
            return "o"
        return what

    def arrow(self) -> bool:
        """An arrow function with parameters in brackets, if there is one here."""
        s, at = self.s, self.p
        q = at + (s[at] == ASYNC)
        if s[q] == "(":
            depth, e = 0, q
            while True:
                c = s[e]
                if c in "([{":
                    depth += 1
                elif c in ")]}":
                    depth -= 1
                    if not depth:
                        break
                elif c == END:
                    return False
                e += 1
            after = s[e + 1]
            if after != ARROW and not (self.ts and after == ":"):
                return False
        old, kinds = (self.await_ok, self.yield_ok, self.in_ok), self.s
        n = len(self.errors)
        try:
            is_async = self.eat(ASYNC)
            if s[self.p] == "<":
                self.type_params()
            self.await_ok = is_async
            self.params()
            if self.ts and self.eat(":"):
                self.return_type()
            if s[self.p] != ARROW or self.p in self.nl:
                self.fail("=>")
            self.p += 1
        except Bad:
            if s[q] == "(" and after == ARROW:
                raise
            self.p, self.s = at, kinds
            del self.errors[n:]
            self.await_ok, self.yield_ok, self.in_ok = old
            return False
        self.await_ok, self.yield_ok, self.in_ok = old
        self.arrow_body(is_async)
        return True

    def arrow_body(self, is_async: bool) -> None:
        old = self.await_ok, self.yield_ok, self.in_function
        self.await_ok, self.yield_ok = is_async, False
        if self.s[self.p] == "{":
            self.in_function = True
            in_ok, self.in_ok = self.in_ok, True
            self.block()
            self.in_ok = in_ok
        else:
            self.assignment()
        self.await_ok, self.yield_ok, self.in_function = old

    def conditional(self) -> str:
        s = self.s
        what = self.binary(1)
        if s[self.p] == "?":
            self.p += 1
            self.with_in(self.assignment)
            self.need(":")
            self.assignment()
            return "o"
        return what

    def binary(self, least: int) -> str:
        s = self.s
        if s[self.p] == "#" and s[self.p + 1] == IN:
            self.p += 1
            what = "o"
        else:
            what = self.unary()
        while True:
            c = s[self.p]
            n = PREC.get(c, 0)
            if self.ts and c in (AS, SATISFIES) and self.p not in self.nl and least <= 8:
                self.p += 1
                if s[self.p] == CONST:
                    self.p += 1
                else:
                    self.type()
                what = "m" if what in "nm" else "o"
                continue
            if n < least or not n or c == IN and not self.in_ok:
                return what
            if c == POW and what == "u":
                self.fail("brackets around the unary expression")
            self.p += 1
            right = self.binary(n if c == POW else n + 1)
            if c == NULLISH and "l" in (what, right):
                self.fail("brackets where ?? meets || or &&")
            what = "l" if c in (ANDAND, OROR) else "o"

    def unary(self) -> str:
        s, c = self.s, self.s[self.p]
        if c in UNARY:
            self.p += 1
            self.unary()
            return "u"
        if c in (INC, DEC):
            self.p += 1
            at = self.p
            if self.unary() not in "nm":
                raise Bad(at, "cannot assign to this expression")
            return "o"
        if c == AWAIT:
            if not self.await_ok:
                self.fail("await only in an async function")
            self.p += 1
            self.unary()
            return "o"
        if c == "<" and self.ts:  # an assertion <T>x
            self.type_args()
            return self.unary()
        at = self.p
        what = self.subscripts(self.primary())
        if s[self.p] in (INC, DEC) and self.p not in self.nl:
            if what not in "nm":
                raise Bad(at, "cannot assign to this expression")
            self.p += 1
            return "o"
        return what

    def subscripts(self, what: str, calls: bool = True) -> str:
        s = self.s
        chain = False
        while True:
            c = s[self.p]
            if c == ".":
                self.p += 1
                if not self.eat("#"):
                    self.word()
                what = "m"
            elif c == OPT:
                self.p += 1
                chain = True
                if s[self.p] == "(":
                    self.arguments()
                elif s[self.p] == "[":
                    self.p += 1
                    self.with_in(self.expression)
                    self.need("]")
                elif s[self.p] == "<" and self.ts:
                    self.type_args()
                    self.arguments()
                elif not self.eat("#"):
                    self.word()
                what = "o"
            elif c == "[":
                self.p += 1
                self.with_in(self.expression)
                self.need("]")
                what = "m"
            elif c == "(" and calls:
                self.arguments()
                what = "o"
            elif c == "T":
                self.p += 1
                what = "o"
            elif c == "!" and self.ts and self.p not in self.nl:
                self.p += 1
            elif c == "<" and self.ts and self.try_type_args():
                what = "o"
            else:
                return "o" if chain else what

    def try_type_args(self) -> bool:
        """<types> behind an expression if a call, a template or an end follows."""
        at, kinds = self.p, self.s
        try:
            self.type_args()
        except Bad:
            self.p, self.s = at, kinds
            return False
        c = self.s[self.p]
        if c in "(T" or c in ")],;:}." or c == END or self.p in self.nl:
            return True
        self.p, self.s = at, kinds
        return False

    def arguments(self) -> None:
        s = self.s
        self.need("(")
        in_ok, self.in_ok = self.in_ok, True
        while s[self.p] != ")":
            self.eat(SPREAD)
            self.assignment()
            if not self.eat(","):
                break
        self.in_ok = in_ok
        self.need(")")

    def primary(self) -> str:
        s, c = self.s, self.s[self.p]
        if c in "NSTR" or c in (THIS, NULL, TRUE, FALSE):
            self.p += 1
            return "o"
        if c == "(":
            self.p += 1
            what = self.with_in(self.expression)
            self.need(")")
            return what if what in "nm" else "o"
        if c == "[":
            self.p += 1
            in_ok, self.in_ok = self.in_ok, True
            while s[self.p] != "]":
                if s[self.p] == ",":
                    self.p += 1
                    continue
                self.eat(SPREAD)
                self.assignment()
                if s[self.p] != "]":
                    self.need(",")
            self.in_ok = in_ok
            self.need("]")
            return "p"
        if c == "{":
            self.object_literal()
            return "p"
        if c == FUNCTION or c == ASYNC and s[self.p + 1] == FUNCTION and self.p + 1 not in self.nl:
            is_async = self.eat(ASYNC)
            self.need(FUNCTION)
            star = self.eat("*")
            if s[self.p] in NAMES or s[self.p] in (AWAIT, YIELD):
                self.p += 1
            self.callable(is_async, star)
            return "o"
        if c == CLASS or c == "@":
            self.class_(False)
            return "o"
        if c == NEW:
            self.p += 1
            if self.eat("."):
                self.need(TARGET)
                return "o"
            if s[self.p] == IMPORT:
                self.fail("a constructor")
            self.subscripts(self.primary(), calls=False)
            if self.ts and s[self.p] == "<":
                self.type_args()
            if s[self.p] == "(":
                self.arguments()
            return "o"
        if c == SUPER:
            self.p += 1
            if s[self.p] not in "(.[":
                self.fail("( or .")
            return "o"
        if c == IMPORT:
            self.p += 1
            if self.eat("."):
                self.need(META)
                return "o"
            if s[self.p] != "(":
                self.fail("(")
            self.arguments()
            return "o"
        if c in NAMES:
            self.p += 1
            return "n"
        self.fail("an expression")

    def object_literal(self) -> None:
        s = self.s
        self.need("{")
        in_ok, self.in_ok = self.in_ok, True
        while s[self.p] != "}":
            c, n = s[self.p], s[self.p + 1]
            if self.eat(SPREAD):
                self.assignment()
            else:
                is_async = star = False
                special = False
                if c == ASYNC and n not in "(,:}=<":
                    self.p += 1
                    is_async = special = True
                if self.eat("*"):
                    star = special = True
                elif c in (GET, SET) and n not in "(,:}=<":
                    self.p += 1
                    special = True
                at = s[self.p]
                self.property_name()
                if s[self.p] == "(" or self.ts and s[self.p] == "<":
                    self.callable(is_async, star)
                elif special:
                    self.fail("(")
                elif self.eat(":"):
                    self.assignment()
                elif at in NAMES:
                    if self.eat("="):
                        self.assignment()
                else:
                    self.fail(":")
            if not self.eat(","):
                break
        self.in_ok = in_ok
        self.need("}")

    # types -----------------------------------------------------------------------------------------------------------
    def type_params(self) -> None:
        if not self.eat("<"):
            return
        s = self.s
        while s[self.p] != ">":
            while s[self.p] in (CONST, IN) or s[self.p] == "I" and s[self.p + 1] in WORDS and s[self.p + 1] != EXTENDS:
                self.p += 1
            self.word()
            if self.eat(EXTENDS):
                self.type()
            if self.eat("="):
                self.type()
            if not self.eat(","):
                break
        self.need(">")

    def type_args(self) -> None:
        self.need("<")
        self.type()
        while self.eat(","):
            self.type()
        self.shut()

    def shut(self) -> None:
        """One > of >, >> and the like."""
        c = self.s[self.p]
        split = {SHR: ">", USHR: SHR, GE: "=", SHRA: GE, USHRA: SHRA}.get(c)
        if split:  # the rest stays as the next token
            self.s = self.s[: self.p] + split + self.s[self.p + 1 :]
        else:
            self.need(">")

    def return_type(self) -> None:
        s = self.s
        if s[self.p] == ASSERTS and (s[self.p + 1] in NAMES or s[self.p + 1] == THIS) and s[self.p + 1] != IS:
            self.p += 2
            if self.eat(IS):
                self.type()
        elif (s[self.p] in NAMES or s[self.p] == THIS) and s[self.p + 1] == IS and self.p + 1 not in self.nl:
            self.p += 2
            self.type()
        else:
            self.type()

    def type(self) -> None:
        self.union()
        if self.s[self.p] == EXTENDS and self.p not in self.nl and not self.no_cond:
            self.p += 1
            self.no_cond = True
            try:
                self.union()
            finally:
                self.no_cond = False
            self.need("?")
            self.type()
            self.need(":")
            self.type()

    def union(self) -> None:
        s = self.s
        if s[self.p] in "|&":
            self.p += 1
        self.type_operator()
        while s[self.p] in "|&":
            self.p += 1
            self.type_operator()

    def type_operator(self) -> None:
        s, c = self.s, self.s[self.p]
        if c in (KEYOF, UNIQUE, READONLY) and (s[self.p + 1] in WORDS or s[self.p + 1] in "([{TSN"):
            self.p += 1
            return self.type_operator()
        if c == INFER:
            self.p += 1
            self.word()
            if s[self.p] == EXTENDS:
                at = self.p
                self.p += 1
                self.union()
                if s[self.p] == "?":
                    self.p = at
            return
        self.type_primary()
        while s[self.p] == "[" and self.p not in self.nl:
            self.p += 1
            if not self.eat("]"):
                self.type()
                self.need("]")

    def type_primary(self) -> None:
        s, c = self.s, self.s[self.p]
        if c == ABSTRACT and s[self.p + 1] == NEW:
            self.p += 1
            c = NEW
        if c == NEW or c == "<" or c == "(" and self.function_type():
            self.eat(NEW)
            self.type_params()
            self.params()
            self.need(ARROW)
            cond, self.no_cond = self.no_cond, False
            self.return_type()
            self.no_cond = cond
        elif c == "(":
            self.p += 1
            cond, self.no_cond = self.no_cond, False
            self.type()
            self.no_cond = cond
            self.need(")")
        elif c == "[":
            self.p += 1
            while s[self.p] != "]":
                self.eat(SPREAD)
                if s[self.p] in WORDS and (s[self.p + 1] == ":" or s[self.p + 1 : self.p + 3] == "?:"):
                    self.p += 1
                    self.eat("?")
                    self.p += 1
                self.type()
                self.eat("?")
                if not self.eat(","):
                    break
            self.need("]")
        elif c == "{":
            self.object_type()
        elif c in "SNT" or c in (TRUE, FALSE, NULL, VOID):
            self.p += 1
        elif c == "-":
            self.p += 1
            self.need("N")
        elif c == TYPEOF:
            self.p += 1
            if s[self.p] == IMPORT:
                return self.type_primary()
            self.word()
            while self.eat("."):
                if not self.eat("#"):
                    self.word()
            if s[self.p] == "<" and self.p not in self.nl:
                self.type_args()
        elif c == IMPORT:
            self.p += 1
            self.arguments()
            while self.eat("."):
                self.word()
            if s[self.p] == "<":
                self.type_args()
        elif c == THIS or c in NAMES:
            self.p += 1
            while self.eat("."):
                self.word()
            if s[self.p] == "<" and self.p not in self.nl:
                self.type_args()
        else:
            self.fail("a type")

    def function_type(self) -> bool:
        """Do the brackets here hold parameters?"""
        s, depth, e = self.s, 0, self.p
        c = s[e + 1]
        if not (c in ")[{" or c == SPREAD or c in WORDS and s[e + 2] in ":,?=)"):
            return False
        while s[e] != END:
            if s[e] in "([{":
                depth += 1
            elif s[e] in ")]}":
                depth -= 1
                if not depth:
                    return s[e + 1] == ARROW
            e += 1
        return False

    def index_signature(self) -> None:
        self.p += 2
        self.need(":")
        self.type()
        self.need("]")
        if self.s[self.p] in "?+-":
            self.p += 1
            self.eat("?")
        if self.eat(":"):
            self.type()

    def object_type(self) -> None:
        s = self.s
        self.need("{")
        cond, self.no_cond = self.no_cond, False
        while s[self.p] != "}":
            if s[self.p] in "+-" and s[self.p + 1] == READONLY:
                self.p += 2
            elif s[self.p] == READONLY and s[self.p + 1] not in "?:(<;,}":
                self.p += 1
            c = s[self.p]
            if c == "[" and s[self.p + 1] in WORDS and s[self.p + 2] == ":":
                self.index_signature()
            elif c == "[" and s[self.p + 1] in WORDS and s[self.p + 2] == IN:  # mapped
                self.p += 3
                self.type()
                if self.eat(AS):
                    self.type()
                self.need("]")
                if s[self.p] in "+-":
                    self.p += 1
                self.eat("?")
                if self.eat(":"):
                    self.type()
            else:
                if c == NEW and s[self.p + 1] in "(<":
                    self.p += 1
                elif c in (GET, SET) and s[self.p + 1] in WORDS:
                    self.p += 2
                elif c not in "(<":
                    self.property_name()
                self.eat("?")
                if s[self.p] in "(<":
                    self.type_params()
                    self.params()
                    if self.eat(":"):
                        self.return_type()
                elif self.eat(":"):
                    self.type()
            if s[self.p] in ";,":
                self.p += 1
            elif s[self.p] != "}" and self.p not in self.nl:
                self.fail("; or a new line")
        self.no_cond = cond
        self.need("}")


def _parse(text: str, ts: bool) -> list[tuple[int, str]]:
    text = text.removeprefix("﻿").replace("\r\n", "\n").replace("\r", "\n")
    if text[:2] == "#!":
        text = "//" + text
    s, nl = kinds_of(text)
    p = Ecma(s, nl, ts)
    whole = p.judged(p.file)
    if whole and not p.errors:
        return []
    # places, once more and slowly
    starts: list[int] = []
    slow = NESTED in "".join(map(K.__getitem__, TOKEN.findall(text)))
    for m in TOKEN.finditer(text):
        starts += [m.start()] * len(K[m[0]].replace("\n", ""))
    found = [(text.count("\n", 0, starts[at] if at < len(starts) else len(text)) + 1 if not slow else 0, what) for at, what in p.errors]
    if not whole:
        raise TooDeep(found)
    return found


def parse_js(text: str) -> list[tuple[int, str]]:
    return _parse(text, False)


def parse_ts(text: str) -> list[tuple[int, str]]:
    return _parse(text, True)
