"""Python 3: logical lines, each parsed by recursive descent, under a stack of indentations."""

from __future__ import annotations

import re

from .base import END, LONGEST_SHAPE, MOST_SHAPES, WRONG, Bad, Kinds, Parser, TooDeep, unbalanced

_WORDS = "False None True and as assert async await break class continue def del elif else except finally for from global if import in is lambda nonlocal not or pass raise return try while with yield"
_OPS = "**= //= >>= <<= ... ** // >> << <= >= == != -> := += -= *= /= %= &= |= ^= @= + - * / % @ & | ^ ~ < > ( ) [ ] { } , : . ; = !"
_PRE = r"(?:[rR][bBfFtT]?|[bBfFtT][rR]?|[uU])?"
_NUM = (
    r"(?:0[xX](?:_?[0-9a-fA-F])+|0[bB](?:_?[01])+|0[oO](?:_?[0-7])+"
    r"|(?:\d(?:_?\d)*\.(?:\d(?:_?\d)*)?|\.\d(?:_?\d)*|\d(?:_?\d)*)(?:[eE][+-]?\d(?:_?\d)*)?[jJ]?)"
)
# a line's start with its indentation is one token; blank lines, comments and joined lines fall away
TOKEN = re.compile(
    r"\n[ \t\f]*|\\\n|#[^\n]*"
    rf"|{_PRE}\"\"\"(?:[^\\\"]|\\.|\"(?!\"\"))*\"\"\"|{_PRE}'''(?:[^\\']|\\.|'(?!''))*'''"
    # f-strings may hold strings in the same quotes within their fields
    r"|[fF][rR]?\"(?!\"\")(?>[^\"\\\n{]|\\.|\{\{|\{(?>[^{}\"\n]|\"[^\"\n]*\"|\{[^{}\n]*\})*+\})*+\""
    r"|[fF][rR]?'(?!'')(?>[^'\\\n{]|\\.|\{\{|\{(?>[^{}'\n]|'[^'\n]*'|\{[^{}\n]*\})*+\})*+'"
    rf"|{_PRE}\"(?!\"\")(?:[^\"\\\n]|\\.)*\"|{_PRE}'(?!'')(?:[^'\\\n]|\\.)*'|{_PRE}\"\"(?!\")|{_PRE}''(?!')"
    rf"|[^\W\d]\w*|{_NUM}|" + "|".join(re.escape(o) for o in _OPS.split()) + r"|[^ \t\f\n]",
    re.S,
)
_SIMPLE_FIELD = re.compile(r"(?:[^{}]|\{\{|\}\}|\{[^\W\d]\w*(?:\.[^\W\d]\w*)*(?:![rsa])?(?::[^{}]*)?\})*\Z")
_OCTAL = re.compile(r"0[\d_]*[1-9][\d_]*\Z")


def _other(t: str) -> str:
    c = t[0]
    if c == "\n":
        return "\n"
    if c == "#" or t == "\\\n":
        return ""
    if t[-1] in "\"'":
        head = t[: min(t.index(q) for q in "\"'" if q in t)].lower()
        if len(t) - len(head) < 2:
            return WRONG
        if ("f" in head or "t" in head) and not _fstring(t, head):
            return WRONG
        if "b" in head:
            return "B" if t.isascii() else WRONG
        return "S"
    if c.isdigit() or c == "." and len(t) > 1:
        return WRONG if _OCTAL.match(t) else "N"
    return "I" if t.isidentifier() else WRONG


def _fstring(t: str, head: str) -> bool:
    body = t[len(head) :]
    n = 3 if body[:3] in ('"""', "'''") else 1
    body = body[n:-n]
    if _SIMPLE_FIELD.match(body):
        return True
    return _fields(body, 0)


def _fields(body: str, depth: int) -> bool:
    """Are the replacement fields of an f-string's text expressions? In a format spec (depth 1) braces are not doubled."""
    if depth > 4:
        return False
    p = 0
    while p < len(body):
        c = body[p]
        if c == "{":
            if body[p : p + 2] == "{{" and not depth:
                p += 2
                continue
            q, level, quote = p + 1, 0, ""
            while q < len(body):
                d = body[q]
                if quote:
                    if d == "\\":
                        q += 1
                    elif d == quote:
                        quote = ""
                elif d in "\"'":
                    quote = d
                elif d in "([{":
                    level += 1
                elif d in ")]" or d == "}" and level:
                    level -= 1
                elif d == "}" or level == 0 and (d == ":" or d == "!" and body[q + 1 : q + 2] != "="):
                    break
                q += 1
            else:
                return False
            expr = body[p + 1 : q]
            if re.search(r"(?<![=!<>])=\s*\Z", expr):
                expr = expr.rstrip()[:-1]
            if not _expression_ok(expr):
                return False
            if body[q] == "!":
                m = re.match(r"![rsa]\s*(?=[:}])", body[q:])
                if not m:
                    return False
                q += m.end()
            if body[q] == ":":
                # the spec may hold fields of its own
                level, r = 0, q + 1
                while r < len(body) and not (body[r] == "}" and level == 0):
                    level += {"{": 1, "}": -1}.get(body[r], 0)
                    r += 1
                if r >= len(body) or not _fields(body[q + 1 : r], depth + 1):
                    return False
                q = r
            p = q + 1
        elif c == "}":
            if body[p : p + 2] == "}}" and not depth:
                p += 2
                continue
            return False
        else:
            p += 1
    return True


def _expression_ok(text: str) -> bool:
    s = "".join(map(K.__getitem__, TOKEN.findall(text.replace("\n", " "))))
    if not s or "\n" in s:
        return False
    p = Line(s)
    try:
        p.star_expressions()
        return p.s[p.p] == END
    except Bad:
        return False


K = Kinds(_WORDS, _OPS, _other)
k = K.names
AUGMENTED = set(K.chars("**= //= >>= <<= += -= *= /= %= &= |= ^= @="))
BITS = {k[o]: n for n, ops in enumerate(("|", "^", "&", "<< >>", "+ -", "* / // % @"), 1) for o in ops.split()}
COMPARE = set(K.chars("< > <= >= == !="))
(FALSE, NONE, TRUE, AND, AS, ASSERT, ASYNC, AWAIT, BREAK, CLASS, CONTINUE, DEF, DEL, ELIF, ELSE, EXCEPT, FINALLY, FOR, FROM, GLOBAL, IF, IMPORT, IN, IS, LAMBDA, NONLOCAL, NOT, OR, PASS, RAISE, RETURN, TRY, WHILE, WITH, YIELD) = (k[w] for w in _WORDS.split())
POW, WALRUS, RARROW, DOTS = k["**"], k[":="], k["->"], k["..."]
TARGETS = set("nast")  # kinds of expressions that can be assigned: name, attribute, subscript, tuple or list of such
SHAPES: dict[str, str] = {}


class Line(Parser):
    """One logical line. Expressions return what they are: n a name, a attribute, s subscript, t tuple or list of targets,
    * starred target, c call, o anything else."""

    kinds = K

    # statements ------------------------------------------------------------------------------------------------------
    def line(self) -> str:
        """The statement's keyword if it opens a block on the next line, else 'inline' for a compound one, '' for a simple one."""
        s, c = self.s, self.s[self.p]
        if c in (IF, WHILE, ELIF):
            self.p += 1
            self.named()
        elif c in (ELSE, TRY, FINALLY):
            self.p += 1
        elif c == FOR:
            self.for_head()
        elif c == WITH:
            self.with_head()
        elif c == DEF:
            self.def_head()
        elif c == CLASS:
            self.p += 1
            self.need("I")
            self.type_params()
            if self.eat("("):
                self.call_args()
        elif c == EXCEPT:
            self.p += 1
            self.eat("*")
            if s[self.p] != ":":
                self.expression()
                if self.eat(AS):
                    self.need("I")
                elif s[self.p] == ",":
                    while self.eat(","):
                        self.expression()
        elif c == ASYNC:
            self.p += 1
            c = s[self.p]
            {DEF: self.def_head, FOR: self.for_head, WITH: self.with_head}.get(c, lambda: self.fail("def, for or with"))()
        elif c == "@":
            self.p += 1
            self.named()
            self.finish()
            return "@"
        else:
            soft = self.soft()
            if soft:
                return soft
            self.simple()
            return ""
        self.need(":")
        if s[self.p] == END:
            return c
        self.simple()
        return c + "inline"

    def finish(self) -> None:
        if self.s[self.p] != END:
            self.fail()

    def soft(self) -> str:
        """match and case are names unless the line is a head; it is one if it parses as one up to a last colon."""
        s, n = self.s, len(self.s) - 4
        if s[0] != "I" or n < 3 or ":" not in s or s[1] in "=.,:);":
            return ""
        for head, kind in ((self.star_expressions, "match"), (self.case_head, "case")):
            self.p = 1
            try:
                head()
                self.need(":")
                if s[self.p] == END:
                    return kind
                if kind == "case" and s[1] not in "([":
                    self.simple()
                    return kind + "inline"
            except Bad:
                pass
        self.p = 0
        return ""

    def case_head(self) -> None:
        self.patterns()
        if self.eat(IF):
            self.named()

    def patterns(self) -> None:
        self.pattern()
        while self.eat(","):
            if self.s[self.p] in ":" or self.s[self.p] == IF:
                break
            self.pattern()

    def pattern(self) -> None:
        s = self.s
        while True:
            if self.eat("*"):
                self.need("I")
            elif s[self.p] == "(" or s[self.p] == "[":
                shut = {"(": ")", "[": "]"}[s[self.p]]
                self.p += 1
                while s[self.p] != shut:
                    self.pattern()
                    if not self.eat(","):
                        break
                self.need(shut)
            elif self.eat("{"):
                while s[self.p] != "}":
                    if self.eat(POW):
                        self.need("I")
                    else:
                        self.pattern()
                        self.need(":")
                        self.pattern()
                    if not self.eat(","):
                        break
                self.need("}")
            elif s[self.p] in "NSB-" or s[self.p] in (NONE, TRUE, FALSE):
                self.eat("-")
                if s[self.p] in "SB":
                    self.strings()
                else:
                    self.p += 1
                    if s[self.p] in "+-":
                        self.p += 1
                        self.need("N")
            else:
                self.need("I")
                while self.eat("."):
                    self.need("I")
                if self.eat("("):
                    while s[self.p] != ")":
                        if s[self.p] == "I" and s[self.p + 1] == "=":
                            self.p += 2
                        self.pattern()
                        if not self.eat(","):
                            break
                    self.need(")")
            if not self.eat("|"):
                break
        if self.eat(AS):
            self.need("I")

    def for_head(self) -> None:
        self.p += 1
        self.targets()
        self.need(IN)
        self.star_expressions()

    def targets(self) -> None:
        """Targets of for: no comparison, so that `in` is left."""
        while True:
            self.eat("*")
            at = self.p
            if self.bits(1) not in TARGETS:
                raise Bad(at, "cannot assign to this expression")
            if not self.eat(","):
                return
            if self.s[self.p] in (IN, "="):
                return

    def with_head(self) -> None:
        self.p += 1
        if self.s[self.p] == "(":
            at = self.p
            try:
                self.p += 1
                while self.s[self.p] != ")":
                    self.with_item()
                    if not self.eat(","):
                        break
                self.need(")")
                if self.s[self.p] == ":":
                    return
            except Bad:
                pass
            self.p = at
        self.with_item()
        while self.eat(","):
            self.with_item()

    def with_item(self) -> None:
        self.expression()
        if self.eat(AS):
            at = self.p
            self.eat("*")
            if self.bits(1) not in TARGETS:
                raise Bad(at, "cannot assign to this expression")

    def type_params(self) -> None:
        if self.eat("["):
            while self.s[self.p] != "]":
                if not self.eat("*"):
                    self.eat(POW)
                self.need("I")
                if self.eat(":"):
                    self.expression()
                if self.eat("="):
                    self.expression()
                if not self.eat(","):
                    break
            self.need("]")

    def def_head(self) -> None:
        self.need(DEF)
        self.need("I")
        self.type_params()
        self.need("(")
        self.params(")", True)
        self.need(")")
        if self.eat(RARROW):
            self.expression()

    def params(self, shut: str, typed: bool) -> None:
        s = self.s
        default = star = False
        while s[self.p] != shut:
            if self.eat("/"):
                if star:
                    self.fail()
            elif self.eat(POW):
                self.need("I")
                if typed and self.eat(":"):
                    self.expression()
                self.eat(",")
                break
            elif self.eat("*"):
                if star:
                    raise Bad(self.p - 1, "a second *")
                star = True
                if s[self.p] == "I":
                    self.p += 1
                    if typed and self.eat(":"):
                        self.eat("*")
                        self.expression()
                elif s[self.p] != "," or s[self.p + 1] == shut:
                    self.fail("a parameter")
            else:
                self.need("I")
                if typed and self.eat(":"):
                    self.expression()
                if self.eat("="):
                    default = True
                    self.expression()
                elif default and not star:
                    raise Bad(self.p - 1, "parameter without a default follows one with a default")
            if not self.eat(","):
                break

    def simple(self) -> None:
        while True:
            self.small()
            if not self.eat(";"):
                break
            if self.s[self.p] == END:
                break
        self.finish()

    def small(self) -> None:
        s, c = self.s, self.s[self.p]
        if c in (PASS, BREAK, CONTINUE):
            self.p += 1
        elif c == RETURN:
            self.p += 1
            if s[self.p] not in ";" + END:
                self.star_expressions()
        elif c == RAISE:
            self.p += 1
            if s[self.p] not in ";" + END:
                self.expression()
                if self.eat(FROM):
                    self.expression()
        elif c in (GLOBAL, NONLOCAL):
            self.p += 1
            self.need("I")
            while self.eat(","):
                self.need("I")
        elif c == DEL:
            self.p += 1
            self.targets_list()
        elif c == ASSERT:
            self.p += 1
            self.expression()
            if self.eat(","):
                self.expression()
        elif c == IMPORT:
            self.p += 1
            self.dotted_as()
            while self.eat(","):
                self.dotted_as()
        elif c == FROM:
            self.from_import()
        elif c == "I" and s[self.p + 1] == "I" and s[self.p + 2] in "=[":  # type X = ...
            self.p += 2
            self.type_params()
            self.need("=")
            self.expression()
        else:
            self.expression_statement()

    def targets_list(self) -> None:
        while True:
            at = self.p
            if self.bits(1) not in TARGETS:
                raise Bad(at, "cannot delete this expression")
            if not self.eat(",") or self.s[self.p] in ";" + END:
                return

    def dotted(self) -> None:
        self.need("I")
        while self.eat("."):
            self.need("I")

    def dotted_as(self) -> None:
        self.dotted()
        if self.eat(AS):
            self.need("I")

    def from_import(self) -> None:
        s = self.s
        self.p += 1
        dots = False
        while s[self.p] in (".", DOTS):
            self.p += 1
            dots = True
        if not (dots and s[self.p] == IMPORT):
            self.dotted()
        self.need(IMPORT)
        if self.eat("*"):
            return
        paren = self.eat("(")
        while True:
            self.need("I")
            if self.eat(AS):
                self.need("I")
            if not self.eat(","):
                break
            if paren and s[self.p] == ")":
                break
        if paren:
            self.need(")")

    def expression_statement(self) -> None:
        s, at = self.s, self.p
        paren = s[at] == "("
        what = self.star_expressions()
        c = s[self.p]
        if c == ":" and what in "nas" or c == ":" and paren and what == "n":
            self.p += 1
            self.expression()
            if self.eat("="):
                self.star_expressions()
        elif c in AUGMENTED:
            if what not in "nas":
                raise Bad(at, "cannot assign to this expression")
            self.p += 1
            self.star_expressions()
        else:
            while self.s[self.p] == "=":
                if what not in TARGETS:
                    raise Bad(at, "cannot assign to this expression")
                self.p += 1
                at = self.p
                what = self.star_expressions()

    # expressions -----------------------------------------------------------------------------------------------------
    def star_expressions(self) -> str:
        """One or more, comma-separated, with stars or a yield."""
        s = self.s
        if s[self.p] == YIELD:
            self.yield_()
            return "o"
        what = self.star_named(False)
        if s[self.p] != ",":
            if what == "*":
                self.fail(",")
            return what
        ok = what in "nast*"
        while self.eat(","):
            if s[self.p] in "=)]};:" or s[self.p] == END or s[self.p] in AUGMENTED:
                break
            ok &= self.star_named(False) in "nast*"
        return "t" if ok else "o"

    def yield_(self) -> None:
        self.p += 1
        if self.eat(FROM):
            self.expression()
        elif self.s[self.p] not in ");]}=," and self.s[self.p] != END:
            self.star_expressions()

    def star_named(self, walrus: bool) -> str:
        if self.s[self.p] == "*":
            self.p += 1
            return "*" if self.bits(1) in TARGETS else "x"
        return self.named() if walrus else self.expression()

    def named(self) -> str:
        if self.s[self.p] == "I" and self.s[self.p + 1] == WALRUS:
            self.p += 2
            self.expression()
            return "o"
        return self.expression()

    def expression(self) -> str:
        s = self.s
        if s[self.p] == LAMBDA:
            self.p += 1
            self.params(":", False)
            self.need(":")
            self.expression()
            return "o"
        what = self.disjunction()
        if s[self.p] == IF:
            self.p += 1
            self.disjunction()
            self.need(ELSE)
            self.expression()
            return "o"
        return what

    def disjunction(self) -> str:
        what = self.inversion()
        while self.s[self.p] == AND or self.s[self.p] == OR:
            self.p += 1
            self.inversion()
            what = "o"
        return what

    def inversion(self) -> str:
        s = self.s
        if s[self.p] == NOT:
            while self.eat(NOT):
                pass
            self.comparison()
            return "o"
        return self.comparison()

    def comparison(self) -> str:
        s = self.s
        what = self.bits(1)
        while True:
            c = s[self.p]
            if c in COMPARE or c == IN:
                self.p += 1
            elif c == NOT and s[self.p + 1] == IN:
                self.p += 2
            elif c == IS:
                self.p += 1
                self.eat(NOT)
            else:
                return what
            self.bits(1)
            what = "o"

    def bits(self, least: int) -> str:
        what = self.unary()
        while (n := BITS.get(self.s[self.p], 0)) >= least:
            self.p += 1
            self.bits(n + 1)
            what = "o"
        return what

    def unary(self) -> str:
        s = self.s
        if s[self.p] in "+-~":
            self.p += 1
            self.unary()
            return "o"
        awaits = self.eat(AWAIT)
        what = self.primary()
        if s[self.p] == POW:
            self.p += 1
            self.unary()
            return "o"
        return "o" if awaits else what

    def strings(self) -> None:
        s, c = self.s, self.s[self.p]
        while s[self.p] == c:
            self.p += 1
        if s[self.p] in "SB":
            self.fail("strings of one kind")

    def primary(self) -> str:
        s, c = self.s, self.s[self.p]
        if c == "I":
            self.p += 1
            what = "n"
        elif c == "N" or c in (NONE, TRUE, FALSE, DOTS):
            self.p += 1
            what = "o"
        elif c in "SB":
            self.strings()
            what = "o"
        elif c == "(":
            what = self.paren()
        elif c == "[":
            what = self.list()
        elif c == "{":
            self.braces()
            what = "o"
        else:
            self.fail("an expression")
        while True:
            c = s[self.p]
            if c == ".":
                self.p += 1
                self.need("I")
                what = "a"
            elif c == "(":
                self.p += 1
                self.call_args()
                what = "c"
            elif c == "[":
                self.p += 1
                self.slices()
                what = "s"
            else:
                return what

    def comp_for(self) -> bool:
        s = self.s
        if not (s[self.p] == FOR or s[self.p] == ASYNC and s[self.p + 1] == FOR):
            return False
        while True:
            if s[self.p] == ASYNC:
                self.p += 1
            if not self.eat(FOR):
                return True
            self.targets()
            self.need(IN)
            self.disjunction()
            while self.eat(IF):
                if s[self.p] == "I" and s[self.p + 1] == WALRUS:
                    self.named()
                else:
                    self.disjunction()

    def paren(self) -> str:
        s = self.s
        self.p += 1
        if self.eat(")"):
            return "t"
        if s[self.p] == YIELD:
            self.yield_()
            self.need(")")
            return "o"
        what = self.star_named(True)
        if self.comp_for():
            self.need(")")
            return "o"
        if s[self.p] != ",":
            if what in "*x":
                self.fail(",")
            self.need(")")
            return what
        ok = what in "nast*"
        while self.eat(","):
            if s[self.p] == ")":
                break
            ok &= self.star_named(True) in "nast*"
        self.need(")")
        return "t" if ok else "o"

    def list(self) -> str:
        s = self.s
        self.p += 1
        ok = True
        if s[self.p] != "]":
            ok = self.star_named(True) in "nast*"
            if self.comp_for():
                ok = False
            else:
                while self.eat(","):
                    if s[self.p] == "]":
                        break
                    ok &= self.star_named(True) in "nast*"
        self.need("]")
        return "t" if ok else "o"

    def braces(self) -> None:
        s = self.s
        self.p += 1
        if self.eat("}"):
            return
        first, is_dict = True, False
        while s[self.p] != "}":
            if s[self.p] == POW:
                if not first and not is_dict:
                    self.fail()
                self.p += 1
                self.bits(1)
                is_dict = True
            else:
                self.star_named(True)
                if first and s[self.p] == ":":
                    is_dict = True
                if is_dict:
                    self.need(":")
                    self.expression()
                if first and self.comp_for():
                    break
            first = False
            if not self.eat(","):
                break
        self.need("}")

    def call_args(self) -> None:
        """Behind the opening bracket."""
        s = self.s
        keyword = 0
        while s[self.p] != ")":
            if self.eat(POW):
                self.expression()
                keyword = 2
            elif self.eat("*"):
                self.expression()
                if keyword == 2:
                    raise Bad(self.p - 1, "positional argument behind **")
            elif s[self.p] == "I" and s[self.p + 1] == "=":
                self.p += 2
                self.expression()
                keyword = keyword or 1
            else:
                at = self.p
                self.named()
                if s[self.p] == "=":
                    raise Bad(at, "expression cannot contain assignment")
                if self.comp_for():
                    if s[self.p] == "," and s[self.p + 1] != ")":
                        self.fail(")")
                elif keyword:
                    raise Bad(at, "positional argument behind a keyword argument")
            if not self.eat(","):
                break
        self.need(")")

    def slices(self) -> None:
        s = self.s
        if s[self.p] == "]":
            self.fail("an index")
        while s[self.p] != "]":
            if s[self.p] == ":":
                pass
            else:
                self.star_named(True)
            for _ in (0, 1):
                if self.eat(":"):
                    if s[self.p] not in ":,]":
                        self.expression()
            if not self.eat(","):
                break
        self.need("]")


#: What may come before a clause of a compound statement.
BEFORE = {ELIF: (IF, ELIF), ELSE: (IF, ELIF, FOR, WHILE, EXCEPT), EXCEPT: (TRY, EXCEPT), FINALLY: (TRY, EXCEPT, ELSE)}
CLAUSES = (ELIF, ELSE, EXCEPT, FINALLY)


def shape(s: str) -> str:
    """What a logical line of these kinds is, as Line.line() says, from memory if it was seen before."""
    what = SHAPES.get(s)
    if what is None:
        p = Line(s)
        what = p.line()
        if len(s) <= LONGEST_SHAPE:
            if len(SHAPES) > MOST_SHAPES:
                SHAPES.clear()
            SHAPES[s] = what
    return what


def parse(text: str) -> list[tuple[int, str]]:
    text = text.removeprefix("﻿").replace("\r\n", "\n").replace("\r", "\n")
    tokens = TOKEN.findall("\n" + text)
    kinds = list(map(K.__getitem__, tokens))
    s = "".join([c if len(c) == 1 else "\2" for c in kinds])  # one character a token, \2 for what is dropped
    errors: list[tuple[int, str]] = []
    # stack of [indentation, the last statement at it as far as a clause may follow]
    stack: list[list] = [["", ""]]
    opened, deep = None, False  # the head that waits for its block; whether a statement is nested too deeply to be judged
    lines = s.split("\n")
    at = 0
    n, i = len(lines), 1
    # the token with which each line begins
    place = []
    for part in lines:
        place.append(at)
        at += len(part) + 1

    def report(token: int, what: str) -> None:
        errors.append((sum(t.count("\n") for t in tokens[: token + 1]), what))

    while i < n:
        line = lines[i]
        code = line.replace("\2", "") if "\2" in line else line
        if not code:
            i += 1
            continue
        indent = tokens[place[i] - 1][1:]
        head = i
        # a logical line goes on while brackets are open
        depth = _depth(code)
        if depth > 0:
            parts = [code]
            while depth > 0 and i + 1 < n:
                i += 1
                more = lines[i].replace("\2", "")
                parts.append(more)
                depth += _depth(more)
            code = "".join(parts)
        i += 1
        start = place[head]
        if "\f" in indent:
            indent = indent.rpartition("\f")[2]
        # indentation
        top = stack[-1]
        if opened is not None:
            if len(indent.expandtabs()) <= len(top[0].expandtabs()):
                report(start, "expected an indented block")
            else:
                stack.append([indent, ""])
                top = stack[-1]
            opened = None
        if indent != top[0]:
            if len(indent) > len(top[0]) and indent.startswith(top[0]):
                report(start, "unexpected indentation")
                stack.append([indent, top[1]])
            else:
                while len(stack) > 1 and len(stack[-1][0].expandtabs()) > len(indent.expandtabs()):
                    if stack[-1][1] == TRY:
                        report(start, "try without except or finally")
                    stack.pop()
                if stack[-1][0] != indent:
                    report(start, "unindent does not match any outer indentation")
                    stack[-1][0] = indent
            top = stack[-1]
        # the statement
        first = code[0]
        before = top[1]
        if first in CLAUSES:
            if before not in BEFORE[first]:
                report(start, f"{K.text[first]} without its statement")
        elif before == TRY:
            report(start, "try without except or finally")
        elif before == "@" and first not in (DEF, CLASS, ASYNC, "@"):
            report(start, "a decorator without a definition")
        try:
            what = shape(code)
        except (Bad, RecursionError) as bad:
            e = bad
            if isinstance(bad, RecursionError):
                deep, e = True, unbalanced(code)
            if e:
                # the place: skip dropped tokens
                t, seen = start, -1
                while t < len(s) and seen < e.at:
                    if s[t] not in "\n\2":
                        seen += 1
                    t += 1
                report(t - 1, e.what)
            what = first if first in (IF, ELIF, ELSE, FOR, WHILE, TRY, EXCEPT, FINALLY, WITH, DEF, CLASS) else ""
            if what and i < n:  # a broken head still opens its block
                nxt = next((j for j in range(i, n) if lines[j].replace("\2", "")), None)
                deeper = nxt is not None and len(tokens[place[nxt] - 1]) - 1 > len(indent)
                opened = what if deeper else None
            top[1] = what
            continue
        if first == ELSE:
            top[1] = ELSE if before == EXCEPT else ""
        elif first == FINALLY:
            top[1] = ""
        elif first == ASYNC and len(code) > 1 and code[1] == FOR:
            top[1] = FOR
        elif first in (IF, ELIF, FOR, WHILE, TRY, EXCEPT):
            top[1] = first
        else:
            top[1] = "@" if what == "@" else ""
        if what and not what.endswith("inline") and what != "@":
            opened = what
    last = len(tokens) - 1
    if opened is not None:
        report(last, "expected an indented block")
    while stack:
        if stack.pop()[1] == TRY:
            report(last, "try without except or finally")
    if deep:
        raise TooDeep(errors)
    return errors


def _depth(code: str) -> int:
    c = code.count
    return c("(") + c("[") + c("{") - c(")") - c("]") - c("}")
