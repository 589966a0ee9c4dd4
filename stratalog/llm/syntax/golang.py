"""Go."""

from __future__ import annotations

import re

from .base import END, LONGEST_SHAPE, WRONG, Bad, Kinds, Parser, Shapes, TooDeep

_ESC = r"\\(?:[abfnrtv\\'\"]|[0-7]{3}|x[0-9a-fA-F]{2}|u[0-9a-fA-F]{4}|U[0-9a-fA-F]{8})"
_WORDS = "break case chan const continue default defer else fallthrough for func go goto if import interface map package range return select struct switch type var"
_OPS = "<<= >>= &^= ... && || <- ++ -- == != <= >= := += -= *= /= %= &= |= ^= << >> &^ + - * / % & | ^ < > = ! ( ) [ ] { } , ; . : ~"
TOKEN = re.compile(
    r"\n|//[^\n]*|/\*.*?\*/|/\*|[^\W\d]\w*"
    r"|(?:0[xX][0-9a-fA-F_]+(?:\.[0-9a-fA-F_]*)?(?:[pP][+-]?\d+)?|0[bB][01_]+|0[oO][0-7_]+|(?:\d[\d_]*(?:\.[\d_]*)?|\.\d[\d_]*)(?:[eE][+-]?\d+)?)i?"
    rf"|\"(?:[^\"\\\n]|{_ESC})*\"|`[^`]*`|'(?:[^'\\\n]|{_ESC})'|" + "|".join(re.escape(o) for o in _OPS.split()) + r"|[^ \t\r\n]",
    re.S,
)


def _other(t: str) -> str:
    c = t[0]
    if t[:2] == "//":
        return ""
    if t[:2] == "/*":
        return WRONG if len(t) == 2 else "\n" if "\n" in t else ""
    if c == "\n":
        return "\n"
    if c in "\"`'":
        return "S" if len(t) > 1 else WRONG
    if c.isdigit() or c == "." and len(t) > 1:
        return "N"
    return "I" if c == "_" or c.isalpha() else WRONG


K = Kinds(_WORDS, _OPS, _other)
k = K.names
#: A new line ends a statement behind these.
_ENDS = re.compile("(?<=[INS" + re.escape(K.chars("break continue fallthrough return ++ -- ) ] }")) + "])\n")
PREC = {k[o]: n for n, ops in enumerate(("||", "&&", "== != < <= > >=", "+ - | ^", "* / % << >> & &^"), 1) for o in ops.split()}
UNARY = set(K.chars("+ - ! ^ * & <- ~"))
ASSIGN = set(K.chars("= := += -= *= /= %= &= |= ^= <<= >>= &^="))
TYPE_START = set("I*([" + K.chars("map chan func struct interface <-"))
FUNC, TYPE, VAR, CONST, IMPORT, PACKAGE = (k[w] for w in "func type var const import package".split())
IF, FOR, SWITCH, SELECT, CASE, DEFAULT, ELSE, RANGE, RETURN = (k[w] for w in "if for switch select case default else range return".split())
GO, DEFER, GOTO, BREAK, CONTINUE, FALL, MAP, CHAN, STRUCT, IFACE = (k[w] for w in "go defer goto break continue fallthrough map chan struct interface".split())
DOTS, ARROW, DEFINE, INC, DEC = (k[o] for o in "... <- := ++ --".split())
SHAPES = Shapes()


def lex(text: str) -> str:
    if text[:1] == "﻿":
        text = text[1:]
    s = "".join(map(K.__getitem__, TOKEN.findall(text))) + "\n"
    return _ENDS.sub(";", s).replace("\n", "")


class Go(Parser):
    kinds = K

    def __init__(self, s: str):
        super().__init__(s)
        self.level = 0  # below 0: in the head of if, for, switch, where T{ begins the block

    # statements ------------------------------------------------------------------------------------------------------
    def file(self) -> None:
        try:
            self.need(PACKAGE)
            self.need("I")
            self.end()
        except Bad as e:
            self.record(e)
            self.sync(";")
        imports = True
        while self.s[self.p] != END:
            start = self.p
            try:
                c = self.s[self.p]
                if c == IMPORT:
                    if not imports:
                        self.fail("imports only before other declarations")
                    self.p += 1
                    self.group(self.import_spec)
                elif c in (CONST, VAR, TYPE):
                    imports = False
                    self.declaration()
                elif c == FUNC:
                    imports = False
                    self.function()
                elif c == ";":
                    self.fail("a declaration")
                else:
                    self.fail("a declaration")
                self.end()
            except Bad as e:
                self.record(e)
                self.level = 0
                self.sync(";")
                if self.p == start or self.s[self.p] in ")]}":
                    self.p += 1

    def end(self) -> None:
        if self.s[self.p] == ";":
            self.p += 1
        elif self.s[self.p] not in ")}" and self.s[self.p] != END:
            self.fail("a new line or ;")

    def group(self, spec) -> None:
        if self.eat("("):
            while not self.eat(")"):
                spec()
                if self.s[self.p] != ")":
                    self.need(";")
        else:
            spec()

    def import_spec(self) -> None:
        if self.s[self.p] in "I.":
            self.p += 1
        self.need("S")

    def declaration(self) -> None:
        c = self.s[self.p]
        self.p += 1
        self.group({CONST: self.const_spec, VAR: self.var_spec, TYPE: self.type_spec}[c])

    def names(self) -> None:
        self.need("I")
        while self.eat(","):
            self.need("I")

    def const_spec(self) -> None:
        self.names()
        if self.s[self.p] in TYPE_START:
            self.type()
        if self.eat("="):
            self.expressions()

    def var_spec(self) -> None:
        self.names()
        if self.s[self.p] != "=":
            self.type()
        if self.eat("="):
            self.expressions()

    def type_spec(self) -> None:
        self.need("I")
        if self.s[self.p] == "[" and self.s[self.p + 1] == "I" and self.s[self.p + 2] != "]":
            at = self.p
            try:
                self.type_params()
            except Bad:
                self.p = at
        self.eat("=")
        self.type()

    def type_params(self) -> None:
        self.need("[")
        while True:
            self.names()
            self.constraint()
            if not self.eat(","):
                break
            if self.s[self.p] == "]":
                break
        self.need("]")

    def constraint(self) -> None:
        while True:
            self.eat("~")
            self.type()
            if not self.eat("|"):
                return

    def function(self) -> None:
        self.need(FUNC)
        if self.s[self.p] == "(":
            self.params()
        self.need("I")
        if self.s[self.p] == "[":
            self.type_params()
        self.signature()
        if self.s[self.p] == "{":
            self.block()

    def signature(self) -> None:
        self.params()
        if self.s[self.p] == "(":
            self.params()
        elif self.s[self.p] in TYPE_START:
            self.type()

    def params(self) -> None:
        """Either all entries have names or none has."""
        s = self.s
        self.need("(")
        named = plain = False
        while s[self.p] != ")":
            if self.eat(DOTS):
                self.type()
                plain = True
            else:
                at = self.p
                self.type()
                lone = self.p == at + 1 and s[at] == "I"
                if s[self.p] == DOTS or s[self.p] in TYPE_START:
                    if not lone and not (s[at] == "I" and s[at + 1] == "["):
                        self.fail(")")
                    if not lone:  # a name with an array type was read as an instance
                        self.p = at + 1
                    self.eat(DOTS)
                    self.type()
                    named = True
                elif not lone:
                    plain = plain or not (s[at] == "I" and s[at + 1] == "[")
            if not self.eat(","):
                break
        self.need(")")
        if named and plain:
            raise Bad(self.p - 1, "parameters with and without names")

    def block(self) -> None:
        self.need("{")
        level, self.level = self.level, 0
        self.statements()
        self.level = level
        self.need("}")

    def statements(self) -> None:
        s = self.s
        while True:
            c = s[self.p]
            if c == "}" or c == CASE or c == DEFAULT or c == END:
                return
            start = self.p
            stop = s.find(";", start) + 1
            if 0 < stop - start <= LONGEST_SHAPE and s[start:stop] in SHAPES:
                self.p = stop
                continue
            try:
                self.statement()
                if s[self.p] != "}":
                    self.need(";")
                    if self.p == stop:
                        SHAPES.keep(s[start:stop])
            except Bad as e:
                self.record(e)
                self.level = 0
                if self.p < e.at:
                    self.p = e.at
                self.sync(";")
                if self.p == start or s[self.p] in ")]":
                    self.p += 1

    def statement(self) -> None:
        c = self.s[self.p]
        if c in (CONST, VAR, TYPE):
            self.declaration()
        elif c == "{":
            self.block()
        elif c == IF:
            self.if_()
        elif c == FOR:
            self.for_()
        elif c == SWITCH:
            self.p += 1
            self.head()
            self.clauses(False)
        elif c == SELECT:
            self.p += 1
            self.clauses(True)
        elif c == RETURN:
            self.p += 1
            if self.s[self.p] not in ";}":
                self.expressions()
        elif c in (GO, DEFER):
            self.p += 1
            self.expression()
        elif c in (BREAK, CONTINUE):
            self.p += 1
            self.eat("I")
        elif c == GOTO:
            self.p += 1
            self.need("I")
        elif c == FALL:
            self.p += 1
        elif c == ";":
            pass
        elif c == "I" and self.s[self.p + 1] == ":":
            self.p += 2
            if self.s[self.p] not in "}":
                self.statement()
        else:
            self.simple()

    def simple(self) -> None:
        """Expressions, assignment, definition, send, increment."""
        s = self.s
        self.expressions()
        c = s[self.p]
        if c in ASSIGN:
            self.p += 1
            if s[self.p] == RANGE:
                self.p += 1
            self.expressions()
        elif c in (INC, DEC):
            self.p += 1
        elif c == ARROW:
            self.p += 1
            self.expression()

    def head(self) -> None:
        """[simple ;] [simple] up to the block."""
        level, self.level = self.level, -1
        if self.s[self.p] not in "{;":
            self.simple()
        if self.eat(";"):
            if self.s[self.p] != "{":
                self.simple()
        self.level = level
        if self.s[self.p] != "{":
            self.fail("{")

    def if_(self) -> None:
        s = self.s
        stop = s.find("{", self.p) + 1
        if 0 < stop - self.p <= LONGEST_SHAPE and s[self.p : stop] in SHAPES:
            self.p = stop - 1
        else:
            start = self.p
            self.p += 1
            if s[self.p] == "{":
                self.fail("a condition")
            self.head()
            if s[self.p - 1] == ";":
                self.fail("a condition")
            if self.p + 1 == stop:
                SHAPES.keep(s[start:stop])
        self.block()
        if self.eat(ELSE):
            if s[self.p] == IF:
                self.if_()
            elif s[self.p] == "{":
                self.block()
            else:
                self.fail("if or {")

    def for_(self) -> None:
        s = self.s
        stop = s.find("{", self.p) + 1
        if 0 < stop - self.p <= LONGEST_SHAPE and s[self.p : stop] in SHAPES:
            self.p = stop - 1
            return self.block()
        start = self.p
        self.p += 1
        level, self.level = self.level, -1
        if s[self.p] == RANGE:
            self.p += 1
            self.expression()
        elif s[self.p] != "{":
            if s[self.p] != ";":
                self.simple()
            if s[self.p] == ";":
                self.p += 1
                if s[self.p] != ";":
                    self.expression()
                self.need(";")
                if s[self.p] != "{":
                    self.simple()
        self.level = level
        if s[self.p] == "{" and self.p + 1 == stop:
            SHAPES.keep(s[start:stop])
        self.block()

    def clauses(self, select: bool) -> None:
        s = self.s
        self.need("{")
        level, self.level = self.level, 0
        while s[self.p] != "}":
            if self.eat(CASE):
                if select:
                    self.simple()
                else:
                    self.expressions()
            else:
                self.need(DEFAULT)
            self.need(":")
            self.statements()
            if s[self.p] == END:
                self.fail("}")
        self.p += 1
        self.level = level

    # types -----------------------------------------------------------------------------------------------------------
    def type(self) -> None:
        s, c = self.s, self.s[self.p]
        self.p += 1
        if c == "I":
            if self.eat("."):
                self.need("I")
            if s[self.p] == "[" and s[self.p + 1] != "]":
                at = self.p
                self.p += 1
                try:
                    self.type_list()
                    self.need("]")
                except Bad:
                    self.p = at
        elif c == "*":
            self.type()
        elif c == "(":
            self.type()
            self.need(")")
        elif c == "[":
            if not self.eat("]"):
                if not self.eat(DOTS):
                    level, self.level = self.level, 0
                    self.expression()
                    self.level = level
                self.need("]")
            self.type()
        elif c == MAP:
            self.need("[")
            self.type()
            self.need("]")
            self.type()
        elif c == CHAN:
            self.eat(ARROW)
            self.type()
        elif c == ARROW:
            self.need(CHAN)
            self.type()
        elif c == FUNC:
            self.signature()
        elif c == STRUCT:
            self.need("{")
            while not self.eat("}"):
                self.field()
                if s[self.p] != "}":
                    self.need(";")
        elif c == IFACE:
            self.need("{")
            while not self.eat("}"):
                if s[self.p] == "I" and s[self.p + 1] == "(":
                    self.p += 1
                    self.signature()
                else:
                    self.constraint()
                if s[self.p] != "}":
                    self.need(";")
        else:
            self.p -= 1
            self.fail("a type")

    def type_list(self) -> None:
        self.type()
        while self.eat(","):
            if self.s[self.p] == "]":
                break
            self.type()

    def field(self) -> None:
        s = self.s
        if s[self.p] == "*" or s[self.p] == "I" and s[self.p + 1] in ".;}S":
            self.eat("*")
            self.type()
        else:
            self.names()
            self.type()
        self.eat("S")

    # expressions -----------------------------------------------------------------------------------------------------
    def expressions(self) -> None:
        self.expression()
        while self.s[self.p] == ",":
            self.p += 1
            self.expression()

    def expression(self, least: int = 1) -> None:
        self.unary()
        while (n := PREC.get(self.s[self.p], 0)) >= least:
            self.p += 1
            self.expression(n + 1)

    def unary(self) -> None:
        while self.s[self.p] in UNARY:
            self.p += 1
        self.primary()

    def primary(self) -> None:
        s, c = self.s, self.s[self.p]
        literal = False  # may { follow as a literal's body?
        named = True
        if c == "I":
            self.p += 1
            literal = True
        elif c in "NS":
            self.p += 1
        elif c == "(":
            self.p += 1
            level, self.level = self.level, 0
            if s[self.p] in "[" or s[self.p] in (MAP, CHAN, STRUCT, IFACE):
                self.primary()
                while PREC.get(s[self.p]):
                    self.p += 1
                    self.expression()
            else:
                self.expression()
            self.level = level
            self.need(")")
        elif c == FUNC:
            self.p += 1
            self.signature()
            if s[self.p] == "{":
                self.block()
        elif c == "[" or c in (MAP, CHAN, STRUCT, IFACE):
            self.type()
            literal, named = True, False
        else:
            self.fail("an expression")
        while True:
            c = s[self.p]
            if c == ".":
                self.p += 1
                if self.eat("("):
                    if not self.eat(TYPE):
                        self.type()
                    self.need(")")
                    literal = False
                else:
                    self.need("I")
            elif c == "(":
                self.arguments()
                literal = False
            elif c == "[":
                self.index()
            elif c == "{" and literal and (self.level >= 0 or not named):
                self.body()
                literal = False
            else:
                return

    def arguments(self) -> None:
        s = self.s
        self.p += 1
        level, self.level = self.level, 0
        while s[self.p] != ")":
            self.expression()
            self.eat(DOTS)
            if not self.eat(","):
                break
        self.level = level
        self.need(")")

    def index(self) -> None:
        """An index, a slice or a list of types."""
        s = self.s
        self.p += 1
        level, self.level = self.level, 0
        if s[self.p] == "]":
            self.fail("an index")
        colons = 0
        while s[self.p] != "]":
            if s[self.p] == ":":
                self.p += 1
                colons += 1
                if colons > 2:
                    self.fail("]")
                continue
            self.expression()
            if s[self.p] == "," and not colons:
                self.p += 1
            elif s[self.p] not in ":]":
                self.fail("]")
        self.level = level
        self.need("]")

    def body(self) -> None:
        s = self.s
        self.p += 1
        level, self.level = self.level, 0
        while s[self.p] != "}":
            for turn in (0, 1):
                if s[self.p] == "{":
                    self.body()
                else:
                    self.expression()
                if turn or not self.eat(":"):
                    break
            if not self.eat(","):
                break
        self.level = level
        self.need("}")


def parse(text: str) -> list[tuple[int, str]]:
    p = Go(lex(text))
    whole = p.judged(p.file)
    found = [(line_of(text, at), what) for at, what in p.errors]
    if not whole:
        raise TooDeep(found)
    return found


def line_of(text: str, at: int) -> int:
    """The line of token ``at``; only for texts with errors, which are lexed again with places."""
    kinds, starts = [], []
    for m in TOKEN.finditer(text.removeprefix("﻿")):
        c = K[m[0]]
        if c == "\n":
            c = ";" if kinds and kinds[-1] and _ENDS.search(kinds[-1][-1] + "\n") else ""
        if c:
            kinds.append(c)
            starts.append(m.start())
    return text.count("\n", 0, starts[at] if at < len(starts) else len(text)) + 1
