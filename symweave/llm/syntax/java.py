"""Local grammars of Java 17."""

from __future__ import annotations

import re

from symweave.llm.syntax.shapes import BRACE, END, WRONG, Bad, Grammar, Shapes, is_brace, is_bracket, is_paren

# The language's reserved words and operators, each with the character that stands for it.
_WORDS = {
    "m": "public private protected abstract native transient volatile strictfp",
    "p": "int long double float boolean char byte short", "l": "true false null", "b": "break continue",
    "S": "static", "F": "final", "z": "synchronized", "D": "default", "k": "class", "j": "interface", "e": "enum",
    "r": "record", "x": "sealed", "w": "permits", "y": "yield", "N": "new", "R": "return", "T": "throw", "W": "while",
    "O": "for", "d": "do", "I": "if", "E": "else", "t": "try", "c": "catch", "f": "finally", "h": "switch", "g": "case",
    "A": "assert", "P": "package", "M": "import", "X": "extends", "Z": "implements", "H": "throws", "o": "instanceof",
    "a": "this", "u": "super", "v": "void", WRONG: "goto const _",
}
_OPERATORS = {
    "Q": "+= -= *= /= %= &= |= ^= <<= >>= >>>=", "%": "== != <= >= && || ^ / % <<", "+": "+ -", "~": "! ~", "#": "++ --",
    "-": "->", "C": "::", "V": "...", '"': "\x02 \x03",
}
CLASSES = {w: c for table in (_WORDS, _OPERATORS) for c, ws in table.items() for w in ws.split(" ")} | {c: c for c in "=*&|@?:,;.<>()[]{}"}
_DIGITS = r"\d(?:[\d_]*\d)?"
_NUMBER = re.compile(
    r"0[xX][\da-fA-F](?:[\da-fA-F_]*[\da-fA-F])?[lL]?|0[xX][\da-fA-F_]*\.?[\da-fA-F_]*[pP][+-]?\d+[fFdD]?|0[bB][01](?:[01_]*[01])?[lL]?|0[0-7_]*[lL]?|[1-9](?:[\d_]*\d)?[lL]?"
    rf"|(?:{_DIGITS}\.(?:{_DIGITS})?|\.{_DIGITS})(?:[eE][+-]?{_DIGITS})?[fFdD]?|{_DIGITS}(?:[eE][+-]?{_DIGITS}[fFdD]?|[fFdD])"
)
TOKEN = re.compile(r"[ \t\f\r\n]*(\d\w*(?:\.\w*)?(?:(?<=[\d_.][eEpP])[+-]\w+)?|[\w$€¢-¥]+|\.\d\w*(?:(?<=\d[eE])[+-]\w+)?|>>>?=|<<=?|->|::|\.\.\.|\+\+|--|&&|\|\||[-+*/%&|^=!<>]=|[^ \t\f\r\n])")
_NUMERIC = re.compile(r"\.?\d")
IDENT = "irxyw"
_START = IDENT + 'n"lauNhvp~+#'


def classify(token: str) -> str:
    """The character of a token that isn't in CLASSES."""
    if _NUMERIC.match(token):
        return "n" if _NUMBER.fullmatch(token) else WRONG
    return "i" if token.replace("$", "a").replace("€", "a").isidentifier() else WRONG


class Java(Grammar):
    """The rules; a rule named as a kind of group checks the whole content of such a group."""

    shapes = Shapes()
    _simple = re.compile(f"[^IWOdthzEgDkjerFmS@;y{BRACE}][^;Id{BRACE}]*;")

    # Names, types and annotations.
    def name(self) -> None:
        self.take(IDENT)
        while self.c == "." and self.s[self.i + 1] in IDENT:
            self.i += 2

    def annotations(self) -> None:
        while self.c == "@" and self.s[self.i + 1] != "j":
            self.i += 1
            self.name()
            if is_paren(self.c):
                self.group("annotation_values", is_paren)

    def annotation_values(self) -> None:
        if self.c in IDENT and self.s[self.i + 1] == "=":
            self.list_of(lambda: (self.take(IDENT), self.take("="), self.element()), trailing=False)
        elif self.c != END:
            self.element()

    def element(self) -> None:
        if self.c == "@":
            self.annotations()
        elif is_brace(self.c):
            self.group("elements", is_brace)
        else:
            self.expression()

    def elements(self) -> None:
        self.list_of(self.element)

    def plain_type(self, diamond: bool = False) -> None:
        self.annotations()
        if self.got("p"):
            return
        while True:
            self.take(IDENT)
            if self.c == "<":
                if diamond and self.s[self.i + 1] == ">":
                    self.i += 2
                else:
                    self.type_arguments()
            if self.c != "." or self.s[self.i + 1] not in IDENT + "@":
                return
            self.i += 1
            self.annotations()

    def dims(self) -> int:
        n = 0
        while True:
            at = self.i
            self.annotations()
            if not (is_bracket(self.c) and not self.shapes.content[self.c]):
                self.i = at
                return n
            self.i += 1
            n += 1

    def type(self) -> None:
        self.plain_type()
        self.dims()

    def types(self) -> None:
        self.type()
        while self.got(","):
            self.type()

    def type_arguments(self) -> None:
        self.take("<")
        while True:
            self.annotations()
            if self.got("?"):
                if self.got("Xu"):
                    self.type()
            else:
                self.type()
            if not self.got(","):
                break
        self.take(">")

    def type_parameters(self) -> None:
        if self.got("<"):
            while True:
                self.annotations()
                self.take(IDENT)
                if self.got("X"):
                    self.bound()
                if not self.got(","):
                    break
            self.take(">")

    def bound(self) -> None:
        self.type()
        while self.got("&"):
            self.type()

    # Declarations.
    def file(self) -> None:
        at = self.i
        self.annotations()
        if self.got("P"):
            self.name()
            self.take(";")
        else:
            self.i = at
        while self.c in "M;":
            if self.got("M"):
                self.got("S")
                self.name()
                if self.got("."):
                    self.take("*")
                self.take(";")
            else:
                self.i += 1
        while self.c != END:
            if not self.got(";"):
                self.modifiers()
                self.type_declaration()

    def modifiers(self) -> None:
        while True:
            c, after = self.c, self.s[self.i + 1]
            if c in "mSFz" or c == "D" and after not in ":-" or c == "x" and after in "mSFkjx@":
                self.i += 1
            elif c == "i" and after == "+" and self.s[self.i + 2] == "x":
                self.i += 3
            elif c == "@" and after != "j":
                self.annotations()
            else:
                return

    def type_declaration(self) -> None:
        kind = self.take("kjer@")
        if kind == "@":
            self.take("j")
        self.take(IDENT)
        if kind in "kjr":
            self.type_parameters()
        if kind == "r":
            self.group("parameters", is_paren)
        if kind == "k" and self.got("X"):
            self.type()
        if kind == "j" and self.got("X") or kind in "ker" and self.got("Z"):
            self.types()
        if kind in "kj" and self.got("w"):
            self.types()
        self.group("enum_body" if kind == "e" else "members", is_brace)

    def members(self) -> None:
        while self.c != END:
            self.member()

    def enum_body(self) -> None:
        while self.c not in ";" + END:
            self.annotations()
            self.take(IDENT)
            if is_paren(self.c):
                self.group("arguments", is_paren)
            if is_brace(self.c):
                self.group("members", is_brace)
            if not self.got(","):
                break
        if self.got(";"):
            self.members()

    def member(self) -> None:
        if self.got(";"):
            return
        if is_brace(self.c) or self.c == "S" and is_brace(self.s[self.i + 1]):
            self.got("S")
            return self.group("block", is_brace)
        self.modifiers()
        if self.c in "kje@" or self.c == "r" and self.s[self.i + 1] in IDENT and (is_paren(self.s[self.i + 2]) or self.s[self.i + 2] == "<"):
            return self.type_declaration()
        self.type_parameters()
        if self.c in IDENT and is_brace(self.s[self.i + 1]):
            self.i += 1
            return self.group("block", is_brace)
        if self.c in IDENT and is_paren(self.s[self.i + 1]):
            self.i += 1
            self.group("parameters", is_paren)
            self.throws()
            return self.group("block", is_brace)
        if not self.got("v"):
            self.type()
        self.take(IDENT)
        if not is_paren(self.c):
            self.i -= 1
            self.declarators()
            self.take(";")
            return None
        self.group("parameters", is_paren)
        self.dims()
        self.throws()
        if self.got("D"):
            self.element()
        if not self.got(";"):
            self.group("block", is_brace)

    def throws(self) -> None:
        if self.got("H"):
            self.types()

    def parameters(self) -> None:
        self.list_of(self.parameter, trailing=False)

    def parameter(self) -> None:
        self.modifiers()
        self.type()
        self.annotations()
        self.got("V")
        if self.got("a"):
            return
        self.take(IDENT)
        if self.got("."):
            self.take("a")
        self.dims()

    def declarators(self) -> None:
        while True:
            self.take(IDENT)
            self.dims()
            if self.got("="):
                self.initial()
            if not self.got(","):
                return

    def initial(self) -> None:
        if is_brace(self.c):
            self.group("initials", is_brace)
        else:
            self.expression()

    def initials(self) -> None:
        self.list_of(self.initial)

    # Statements.
    def block(self) -> None:
        statements = self.shapes.statements
        while self.c != END:
            m = self._simple.match(self.s, self.i)
            if m is None:
                self.statement()
                continue
            known = statements.get(m.group())
            if known is None:
                known = statements[m.group()] = Java.holds("statement", m.group())
            if not known:
                raise Bad
            self.i = m.end()

    def statement(self) -> None:
        c = self.c
        if is_brace(c):
            return self.group("block", is_brace)
        if c in IDENT and self.s[self.i + 1] == ":":
            self.i += 2
            return self.statement()
        rule = self._statements.get(c)
        if rule and not (c == "y" and self.s[self.i + 1] in "=.#-Q[" or c == "y" and is_bracket(self.s[self.i + 1])):
            self.i += 1
            return rule(self)
        if c in "mFS@kjex" or c == "r" and self.s[self.i + 1] in IDENT and (is_paren(self.s[self.i + 2]) or self.s[self.i + 2] == "<"):
            self.modifiers()
            if self.c in "kjer@":
                return self.type_declaration()
            self.type()
            self.declarators()
            self.take(";")
            return None
        if c in IDENT + "p" and self.attempt(self.local):
            return None
        if self.expression() not in ("call", "assign", "step", "new"):
            raise Bad
        self.take(";")
        return None

    def local(self) -> None:
        self.type()
        self.declarators()
        self.take(";")

    def _if(self) -> None:
        self.group("expression", is_paren)
        self.statement()
        if self.got("E"):
            self.statement()

    def _while(self) -> None:
        self.group("expression", is_paren)
        self.statement()

    def _for(self) -> None:
        self.group("for_head", is_paren)
        self.statement()

    def _do(self) -> None:
        self.statement()
        self.take("W")
        self.group("expression", is_paren)
        self.take(";")

    def _try(self) -> None:
        enough = is_paren(self.c)
        if enough:
            self.group("resources", is_paren)
        self.group("block", is_brace)
        while self.got("c"):
            self.group("catch", is_paren)
            self.group("block", is_brace)
            enough = True
        if self.got("f"):
            self.group("block", is_brace)
        elif not enough:
            raise Bad

    def _switch(self) -> None:
        self.group("expression", is_paren)
        self.group("switch_body", is_brace)

    def _synchronized(self) -> None:
        self.group("expression", is_paren)
        self.group("block", is_brace)

    def _return(self) -> None:
        if not self.got(";"):
            self.expression()
            self.take(";")

    def _value(self) -> None:
        self.expression()
        self.take(";")

    def _jump(self) -> None:
        self.got(IDENT)
        self.take(";")

    def _assert(self) -> None:
        self.expression()
        if self.got(":"):
            self.expression()
        self.take(";")

    _statements = {
        "I": _if, "W": _while, "O": _for, "d": _do, "t": _try, "h": _switch, "z": _synchronized, "R": _return, "T": _value,
        "y": _value, "b": _jump, "A": _assert, ";": lambda self: None,
    }

    def for_head(self) -> None:
        def each() -> None:
            self.modifiers()
            self.type()
            self.take(IDENT)
            self.dims()
            self.take(":")
            self.expression()

        def declared() -> None:
            self.modifiers()
            self.type()
            self.declarators()
            self.take(";")

        if self.attempt(each):
            return
        if not self.attempt(declared):
            if self.c != ";":
                self.expressions()
            self.take(";")
        if self.c != ";":
            self.expression()
        self.take(";")
        if self.c != END:
            self.expressions()

    def expressions(self) -> None:
        self.expression()
        while self.got(","):
            self.expression()

    def resources(self) -> None:
        def declared() -> None:
            self.modifiers()
            self.type()
            self.take(IDENT)
            self.take("=")
            self.expression()

        while True:
            if not self.attempt(declared):
                self.expression()
            if not self.got(";") or self.c == END:
                return

    def catch(self) -> None:
        self.modifiers()
        self.type()
        while self.got("|"):
            self.type()
        self.take(IDENT)

    def switch_body(self) -> None:
        while self.c != END:
            if self.got("D"):
                pass
            else:
                self.take("g")
                while True:
                    self.expression(arrow=False)
                    if not self.got(","):
                        break
            if self.got("-"):
                if is_brace(self.c):
                    self.group("block", is_brace)
                else:
                    self.got("T")
                    self.expression()
                    self.take(";")
            else:
                self.take(":")
                while self.c not in "gD" + END:
                    self.statement()

    # Expressions: each gives the kind of what it is.
    def arguments(self) -> None:
        self.list_of(self.expression, trailing=False)

    def cast(self) -> None:
        self.bound()

    def lambda_parameters(self) -> None:
        if not self.attempt(lambda: (self.parameters(), self.c == END or self.fail())):
            self.list_of(lambda: self.take(IDENT), trailing=False)

    def expression(self, arrow: bool = True) -> str:
        kind, joined = self.operand(arrow), False
        while True:
            c = self.c
            if c in "=Q":
                if joined:
                    raise Bad
                self.i += 1
                self.expression(arrow)
                return "assign"
            if c == "?":
                self.i += 1
                self.expression()
                self.take(":")
                self.expression(arrow)
                return "value"
            if c == "o":
                self.i += 1
                self.got("F")
                self.type()
                self.got(IDENT)
            elif c in "%+*&|<>":
                self.i += 1
                if c == ">":
                    self.got(">") and self.got(">")
                self.operand(arrow)
            else:
                return kind
            kind, joined = "value", True

    def _lambda_body(self) -> str:
        self.take("-")
        if is_brace(self.c):
            self.group("block", is_brace)
        else:
            self.expression()
        return "value"

    def operand(self, arrow: bool = True) -> str:
        c, after = self.c, self.s[self.i + 1]
        if c in "+~":
            self.i += 1
            self.operand(arrow)
            return "value"
        if c == "#":
            self.i += 1
            self.operand(arrow)
            return "step"
        if arrow and after == "-":
            if c in IDENT:
                self.i += 1
                return self._lambda_body()
            if is_paren(c):
                self.group("lambda_parameters", is_paren)
                return self._lambda_body()
        if is_paren(c):
            if (after in IDENT + 'n"lauNhvp~' or is_paren(after) or after in "+#" and self.shapes.content[c][:1] == "p") and self.check("cast", c):
                self.i += 1
                self.operand(arrow)
                return "value"
            self.group("expression", is_paren)
            return self.suffixes("value")
        return self.suffixes(self.primary())

    def primary(self) -> str:
        c = self.take(_START)
        if c == "N":
            return self.creation()
        if c == "h":
            self._switch()
            return "value"
        if c in "pv":
            self.dims()
            if self.c not in ".C":
                raise Bad
        elif c in "au":
            if is_paren(self.c):
                self.group("arguments", is_paren)
                return "call"
            if c == "u" and self.c not in ".C":
                raise Bad
        elif c in IDENT:
            if is_paren(self.c):
                self.group("arguments", is_paren)
                return "call"
            if self.c == "<":
                self.attempt(lambda: (self.type_arguments(), self.dims(), self.c == "C" or self.fail()))
            elif is_bracket(self.c) and not self.shapes.content[self.c]:
                self.dims()
                if self.c not in ".C":
                    raise Bad
        elif c not in 'n"l':
            raise Bad
        return "value"

    def creation(self) -> str:
        self.annotations()
        if self.c == "<":
            self.type_arguments()
        self.plain_type(diamond=True)
        if is_paren(self.c):
            self.group("arguments", is_paren)
            if is_brace(self.c):
                self.group("members", is_brace)
            return "new"
        if self.dims():
            self.group("initials", is_brace)
            return "value"
        if not is_bracket(self.c):
            raise Bad
        while is_bracket(self.c) and self.shapes.content[self.c]:
            self.group("expression", is_bracket)
        self.dims()
        return "value"

    def suffixes(self, kind: str) -> str:
        while True:
            c = self.c
            if c == ".":
                self.i += 1
                if self.got("N"):
                    kind = self.creation()
                    continue
                if self.c == "<":
                    self.type_arguments()
                if self.take(IDENT + "kau") in IDENT + "u" and is_paren(self.c):
                    self.group("arguments", is_paren)
                    kind = "call"
                    continue
                if self.c == "<":
                    self.attempt(lambda: (self.type_arguments(), self.dims(), self.c == "C" or self.fail()))
                elif is_bracket(self.c) and not self.shapes.content[self.c]:
                    self.dims()
                    if self.c not in ".C":
                        raise Bad
                kind = "value"
            elif c == "C":
                self.i += 1
                if self.c == "<":
                    self.type_arguments()
                self.take(IDENT + "N")
                kind = "value"
            elif is_bracket(c):
                self.group("expression", is_bracket)
                kind = "value"
            elif c == "#":
                self.i += 1
                kind = "step"
            else:
                return kind
