"""Local grammars of Rust 2021."""

from __future__ import annotations

import re

from symweave.llm.syntax.shapes import BRACE, END, WRONG, Bad, Grammar, Shapes, is_brace, is_bracket, is_paren

# The language's reserved words and operators, each with the character that stands for it.
_WORDS = {
    "A": "as", "y": "async", "w": "await", "b": "break", "c": "const", "u": "continue", "p": "crate", "D": "dyn", "E": "else",
    "e": "enum", "X": "extern", "l": "true false", "f": "fn", "F": "for", "I": "if", "m": "impl", "n": "in", "L": "let",
    "o": "loop", "M": "match", "d": "mod", "v": "move", "t": "mut", "P": "pub", "r": "ref", "R": "return", "S": "self",
    "Z": "Self", "s": "static", "k": "struct", "q": "super", "T": "trait", "Y": "type", "U": "unsafe", "O": "use",
    "W": "where", "h": "while", "_": "_", WRONG: "abstract become box do final macro override priv try typeof unsized virtual yield",
}
_OPERATORS = {
    "Q": "+= -= *= /= %= &= |= ^= <<= >>=", "%": "== != <= >=", "/": "/ % ^ <<", "B": "&&", "H": "||", "C": "::", "g": "->",
    "G": "=>", "V": ".. ..= ...", '"': "\x02 \x03", "`": "\x04",
}
CLASSES = {w: c for table in (_WORDS, _OPERATORS) for c, ws in table.items() for w in ws.split(" ")} | {c: c for c in "=*&|@?:,;.<>()[]{}+-!#$"}
_NUMBER = re.compile(r"(?:0x[\da-fA-F_]*[\da-fA-F][\da-fA-F_]*|0o[0-7_]*[0-7][0-7_]*|0b[01_]*[01][01_]*|\d[\d_]*)(?:[iu](?:8|16|32|64|128|size))?|\d[\d_]*(?:\.\d[\d_]*)?(?:[eE][+-]?[\d_]*\d[\d_]*)?(?:f32|f64)?|\d[\d_]*\.")
TOKEN = re.compile(r"[ \t\n\x0b\f\r\x85‎‏  ]*(\d\w*(?:\.\d[\w]*|\.(?![\w.]))?(?:(?<=[\d_.][eE])[+-]\w+)?|(?:r#)?\w+|<<=|>>=|\.\.=|\.\.\.|\.\.|->|=>|::|&&|\|\||<<|[-+*/%&|^=!<>]=|[^ \t\n\x0b\f\r\x85‎‏  ])")
_START = 'iSZpqNl"'
_PATH = "iSZpq"


def classify(token: str) -> str:
    """The character of a token that isn't in CLASSES."""
    if token[0].isdigit():
        return "N" if _NUMBER.fullmatch(token) else WRONG
    token = token.removeprefix("r#")
    return "i" if token.isidentifier() else WRONG


class Rust(Grammar):
    """The rules; a rule named as a kind of group checks the whole content of such a group."""

    shapes = Shapes()
    _simple = re.compile(f"[^OdfkeTmsYXPcUIMohFu`#y;{BRACE}][^;{BRACE}]*;")

    # Attributes, paths, types and bounds. The content of attributes and macros is free, apart from brackets.
    def free(self) -> None:
        self.i = len(self.s) - 1
        if WRONG in self.s:
            raise Bad

    def attributes(self, inner: bool = False) -> None:
        while self.c == "#":
            self.i += 1
            if inner:
                self.got("!")
            self.group("free", is_bracket)

    def any_group(self) -> str:
        c = self.c
        if c < "\u1000" or not self.check("free", c):
            raise Bad
        self.i += 1
        return c

    def path(self, expression: bool = False) -> None:
        if self.c == "<":
            self.i += 1
            self.type()
            if self.got("A"):
                self.path()
            self.take(">")
            self.take("C")
        else:
            self.got("C")
        while True:
            self.take(_PATH)
            if self.c == "<" and not expression:
                self.generic_arguments()
            elif self.c == "C" and self.s[self.i + 1] == "<":
                self.i += 1
                self.generic_arguments()
            elif is_paren(self.c) and not expression:
                self.group("types", is_paren)
                if self.got("g"):
                    self.type()
            if not (self.c == "C" and self.s[self.i + 1] in _PATH):
                return
            self.i += 1

    def generic_arguments(self) -> None:
        self.take("<")
        while self.c != ">":
            if self.got("`") or self.got("-") and self.take("N") or self.got('Nl"'):
                pass
            elif is_brace(self.c):
                self.group("block", is_brace)
            else:
                self.type()
                if self.got("="):
                    self.type()
                elif self.got(":"):
                    self.bounds()
            if not self.got(","):
                break
        self.take(">")

    def type(self) -> None:
        c = self.c
        if is_paren(c):
            self.group("types", is_paren)
        elif is_bracket(c):
            self.group("array_type", is_bracket)
        elif c in "!_":
            self.i += 1
        elif c in "&B":
            self.i += 1
            self.got("`")
            self.got("t")
            self.type()
        elif c == "*":
            self.i += 1
            self.take("ct")
            self.type()
        elif c in "fUX" or c == "F":
            self.for_lifetimes()
            if self.c in "fUX":
                self.got("U")
                if self.got("X"):
                    self.got('"')
                self.take("f")
                self.group("function_types", is_paren)
                if self.got("g"):
                    self.type()
            else:
                self.path()
        elif c in "mD":
            self.i += 1
            self.bounds()
        else:
            self.path()
            if self.got("!"):
                self.any_group()

    def for_lifetimes(self) -> None:
        if self.got("F"):
            self.take("<")
            while self.got("`"):
                if not self.got(","):
                    break
            self.take(">")

    def types(self) -> None:
        self.list_of(self.bounded_type)

    def bounded_type(self) -> None:
        self.type()
        while self.got("+"):
            self.bound()

    def function_types(self) -> None:
        def one() -> None:
            self.attributes()
            if self.got("V"):
                return
            if self.c in "i_" and self.s[self.i + 1] == ":":
                self.i += 2
            self.type()

        self.list_of(one)

    def array_type(self) -> None:
        self.type()
        if self.got(";"):
            self.expression()

    def bounds(self) -> None:
        self.bound()
        while self.got("+"):
            if self.c in "`?F" + _PATH + "C<" or is_paren(self.c):
                self.bound()

    def bound(self) -> None:
        if self.got("`"):
            return
        if is_paren(self.c):
            return self.group("bounds", is_paren)
        self.got("?")
        self.for_lifetimes()
        self.path()

    def generics(self) -> None:
        if not self.got("<"):
            return
        while self.c != ">":
            self.attributes()
            if self.got("`"):
                if self.got(":") and self.c == "`":
                    self.bounds()
            elif self.got("c"):
                self.take("i")
                self.take(":")
                self.type()
                if self.got("="):
                    if is_brace(self.c):
                        self.group("block", is_brace)
                    else:
                        self.got("-")
                        self.take("Nli")
            else:
                self.take("i")
                if self.got(":") and self.c not in ",>=":
                    self.bounds()
                if self.got("="):
                    self.type()
            if not self.got(","):
                break
        self.take(">")

    def where(self) -> None:
        if not self.got("W"):
            return
        while not is_brace(self.c) and self.c not in ";=" + END:
            if self.got("`"):
                self.take(":")
            else:
                self.for_lifetimes()
                self.type()
                self.take(":")
            if self.c not in ",;=" and not is_brace(self.c):
                self.bounds()
            if not self.got(","):
                break

    # Patterns.
    def pattern(self) -> None:
        self.got("|")
        self.one_pattern()
        while self.got("|"):
            self.one_pattern()

    def one_pattern(self) -> None:
        c = self.c
        if c == "V":
            self.i += 1
            if self.c in 'Nl"-' + _PATH:
                self.pattern_end()
        elif c == "_":
            self.i += 1
        elif c in "&B":
            self.i += 1
            self.got("t")
            self.one_pattern()
        elif is_paren(c):
            self.group("patterns", is_paren)
        elif is_bracket(c):
            self.group("patterns", is_bracket)
        elif c in "rt" or c == "i" and self.s[self.i + 1] not in "C!V" and not self.s[self.i + 1] >= "\u1000":
            self.got("r")
            self.got("t")
            self.take("i")
            if self.got("@"):
                self.one_pattern()
        else:
            self.pattern_end()
            if self.got("V") and self.c in 'Nl"-' + _PATH:
                self.pattern_end()

    def pattern_end(self) -> None:
        if self.c in 'Nl"-':
            self.got("-")
            self.take('Nl"')
        elif self.c == "c" and is_brace(self.s[self.i + 1]):
            self.i += 1
            self.group("block", is_brace)
        else:
            self.path(expression=True)
            if self.got("!"):
                self.any_group()
            elif is_paren(self.c):
                self.group("patterns", is_paren)
            elif is_brace(self.c):
                self.group("field_patterns", is_brace)

    def patterns(self) -> None:
        self.list_of(self.pattern)

    def field_patterns(self) -> None:
        def one() -> None:
            self.attributes()
            if self.got("V"):
                return
            if self.c in "iN" and self.s[self.i + 1] == ":":
                self.i += 2
                self.pattern()
            else:
                self.got("r")
                self.got("t")
                self.take("i")

        self.list_of(one)

    # Items.
    def file(self) -> None:
        self.attributes(inner=True)
        self.items()

    def items(self) -> None:
        self.attributes(inner=True)
        while self.c != END:
            self.attributes()
            if not self.item():
                raise Bad

    def item(self) -> bool:
        """Takes an item if one begins here."""
        if self.got("P") and is_paren(self.c) and self.shapes.content[self.c][:1] in "pSqn":
            self.group("visibility", is_paren)
        c, after = self.c, self.s[self.i + 1]
        if c == "O":
            self.i += 1
            self.use_tree()
            self.take(";")
        elif c == "d" or c == "U" and after == "d":
            self.got("U")
            self.i += 1
            self.take("i")
            if not self.got(";"):
                self.group("items", is_brace)
        elif c == "f" or c in "cyUX" and self._is_function():
            while self.got("cyUX"):
                self.got('"')
            self.function()
        elif c == "k":
            self.i += 1
            self.take("i")
            self.generics()
            if is_paren(self.c):
                self.group("tuple_fields", is_paren)
                self.where()
                self.take(";")
            else:
                self.where()
                if not self.got(";"):
                    self.group("fields", is_brace)
        elif c == "e":
            self.i += 1
            self.take("i")
            self.generics()
            self.where()
            self.group("variants", is_brace)
        elif c == "T" or c == "U" and after == "T":
            self.got("U")
            self.i += 1
            self.take("i")
            self.generics()
            if self.got(":") and not is_brace(self.c) and self.c != "W":
                self.bounds()
            self.where()
            self.group("items", is_brace)
        elif c == "m" or c == "U" and after == "m":
            self.got("U")
            self.i += 1
            self.generics()
            self.got("!")
            self.type()
            if self.got("F"):
                self.type()
            self.where()
            self.group("items", is_brace)
        elif c == "c" and after in "i_":
            self.i += 2
            self.typed_value()
        elif c == "s" and after in "it":
            self.i += 1
            self.got("t")
            self.take("i")
            self.typed_value()
        elif c == "Y":
            self.i += 1
            self.take("i")
            self.generics()
            if self.got(":") and self.c not in "=;W":
                self.bounds()
            self.where()
            if self.got("="):
                self.type()
            self.where()
            self.take(";")
        elif c == "X" or c == "U" and after == "X":
            self.got("U")
            self.i += 1
            if self.got("p"):
                self.take("iS")
                if self.got("A"):
                    self.take("i_")
                self.take(";")
            else:
                self.got('"')
                self.group("items", is_brace)
        elif c in _PATH + "C" and self._macro():
            pass
        else:
            return False
        return True

    def _is_function(self) -> bool:
        at = self.i
        while self.s[at] in 'cyUX"' and self.s[at] != END:
            at += 1
        return self.s[at] == "f"

    def _macro(self, item: bool = True) -> bool:
        at = self.i
        if not self.attempt(lambda: (self.path(expression=True), self.take("!"))):
            return False
        if item:
            self.got("i")
        if self.c >= "\u1000" and self.check("free", self.c):
            brace = is_brace(self.c)
            self.i += 1
            if brace or not item or self.got(";"):
                return True
        self.i = at
        return False

    def visibility(self) -> None:
        if self.got("n"):
            self.path()
        else:
            self.take("pSq")

    def use_tree(self) -> None:
        self.got("C")
        while True:
            if self.got("*"):
                return
            if is_brace(self.c):
                return self.group("use_trees", is_brace)
            self.take(_PATH)
            if not self.got("C"):
                break
        if self.got("A"):
            self.take("i_")

    def use_trees(self) -> None:
        self.list_of(self.use_tree)

    def function(self) -> None:
        self.take("f")
        self.take("i")
        self.generics()
        self.group("parameters", is_paren)
        if self.got("g"):
            self.type()
        self.where()
        if not self.got(";"):
            self.group("block", is_brace)

    def typed_value(self) -> None:
        self.take(":")
        self.type()
        if self.got("="):
            self.expression()
        self.take(";")

    def parameters(self) -> None:
        def own() -> None:
            if self.got("&"):
                self.got("`")
            self.got("t")
            self.take("S")
            if self.got(":"):
                self.type()

        def one() -> None:
            self.attributes()
            if self.got("V") or self.attempt(own):
                return
            self.one_pattern()
            self.take(":")
            self.type()

        self.list_of(one)

    def _visible(self) -> None:
        self.attributes()
        if self.got("P") and is_paren(self.c) and self.shapes.content[self.c][:1] in "pSqn" and self.check("visibility", self.c):
            self.i += 1

    def fields(self) -> None:
        self.list_of(lambda: (self._visible(), self.take("i"), self.take(":"), self.type()))

    def tuple_fields(self) -> None:
        self.list_of(lambda: (self._visible(), self.type()))

    def variants(self) -> None:
        def one() -> None:
            self._visible()
            self.take("i")
            if is_paren(self.c):
                self.group("tuple_fields", is_paren)
            elif is_brace(self.c):
                self.group("fields", is_brace)
            if self.got("="):
                self.expression()

        self.list_of(one)

    # Statements.
    def block(self) -> None:
        statements = self.shapes.statements
        self.attributes(inner=True)
        while self.c != END:
            m = self._simple.match(self.s, self.i)
            known = m and statements.get(m.group())
            if m and known is None:
                known = statements[m.group()] = Rust.holds("statement", m.group())
            if known:
                self.i = m.end()
            else:
                self.statement()

    def statement(self) -> None:
        if self.got(";"):
            return
        self.attributes()
        if self.got("L"):
            self.pattern()
            if self.got(":"):
                self.type()
            if self.got("="):
                self.expression()
                if self.got("E"):
                    self.group("block", is_brace)
            self.take(";")
            return
        if self.c in "OdfkeTmsYXPcyU" and self.item():
            return
        if self.c in "i" and self.attempt(lambda: self._macro() or self.fail()):
            if self.c not in ".?":
                return
            self.suffixes()
            self.binary()
        elif self.block_like():
            if self.c not in ".?":
                self.got(";")
                return
            self.suffixes()
            self.binary()
        else:
            self.expression()
        if self.c != END:
            self.take(";")

    def block_like(self) -> bool:
        """Takes an expression that ends with a block if one begins here."""
        c, after = self.c, self.s[self.i + 1]
        if c == "`" and after == ":":
            self.i += 2
            c, after = self.c, self.s[self.i + 1]
        if is_brace(c):
            self.group("block", is_brace)
        elif c == "I":
            self.i += 1
            self.condition()
            self.group("block", is_brace)
            if self.got("E") and not (self.c == "I" and self.block_like()):
                self.group("block", is_brace)
        elif c == "M":
            self.i += 1
            self.expression(literal=False)
            self.group("arms", is_brace)
        elif c == "o":
            self.i += 1
            self.group("block", is_brace)
        elif c == "h":
            self.i += 1
            self.condition()
            self.group("block", is_brace)
        elif c == "F" and after != "<":
            self.i += 1
            self.pattern()
            self.take("n")
            self.expression(literal=False)
            self.group("block", is_brace)
        elif c in "Uc" and is_brace(after):
            self.i += 1
            self.group("block", is_brace)
        elif c == "y" and (is_brace(after) or after == "v" and is_brace(self.s[self.i + 2])):
            self.i += 1
            self.got("v")
            self.group("block", is_brace)
        else:
            return False
        return True

    def condition(self) -> None:
        self.expression(literal=False)

    def arms(self) -> None:
        self.attributes(inner=True)
        while self.c != END:
            self.attributes()
            self.pattern()
            if self.got("I"):
                self.expression()
            self.take("G")
            if is_brace(self.c):
                self.group("block", is_brace)
                if self.c in ".?":
                    self.suffixes()
                    self.binary()
                elif self.c == "," or self.c == END or self.c not in "+-*/%&|<>=":
                    self.got(",")
                    continue
                else:
                    self.binary()
            else:
                at = self.i
                if self.block_like() and self.c not in ".?,+-*/%&|<>=A" and self.c != END:
                    continue
                self.i = at
                self.expression()
            if not self.got(",") and self.c != END:
                raise Bad

    # Expressions.
    def expressions(self) -> None:
        self.list_of(lambda: (self.attributes(), self.expression()))

    def array(self) -> None:
        if self.c == END:
            return
        self.expression()
        if self.got(";"):
            self.expression()
        elif self.got(","):
            self.expressions()

    def expression(self, literal: bool = True) -> None:
        self.operand(literal)
        self.binary(literal)

    def binary(self, literal: bool = True) -> None:
        while True:
            c = self.c
            if c == "V":
                self.i += 1
                if self._starts(literal):
                    self.operand(literal)
            elif c == "A":
                self.i += 1
                self.type()
            elif c in "+-*/%&|BH<>=Q" and c != END:
                self.i += 1
                if c == ">":
                    self.got(">")
                self.operand(literal)
            else:
                return

    def _starts(self, literal: bool) -> bool:
        c = self.c
        return c != END and (c in _START + "C<-!*&B|HvRbuIMohFUyc`'" or is_paren(c) or is_bracket(c) or is_brace(c) and literal)

    def operand(self, literal: bool = True) -> None:
        c = self.c
        if c in "-!*":
            self.i += 1
            return self.operand(literal)
        if c in "&B":
            self.i += 1
            self.got("t")
            return self.operand(literal)
        if c == "V":
            self.i += 1
            if self._starts(literal):
                self.operand(literal)
            return None
        if c == "L":
            self.i += 1
            self.pattern()
            self.take("=")
            return self.operand(literal)
        if c in "|Hv" or c in "ys" and self.s[self.i + 1] in "|Hv":
            return self.closure()
        if c in "Rb":
            self.i += 1
            if c == "b":
                self.got("`")
            if self._starts(literal):
                self.expression(literal)
            return None
        if c == "u":
            self.i += 1
            self.got("`")
            return None
        if is_paren(c):
            self.group("expressions", is_paren)
        elif is_bracket(c):
            self.group("array", is_bracket)
        elif c in 'Nl"':
            self.i += 1
        elif c == "_":
            self.i += 1
            return None
        elif not self.block_like():
            self.path(expression=True)
            if self.got("!"):
                self.any_group()
            elif is_brace(self.c) and literal:
                self.group("literal_fields", is_brace)
        return self.suffixes()

    def closure(self) -> None:
        self.got("s")
        self.got("y")
        self.got("v")
        if not self.got("H"):
            self.take("|")
            while self.c != "|":
                self.attributes()
                self.one_pattern()
                if self.got(":"):
                    self.type()
                if not self.got(","):
                    break
            self.take("|")
        if self.got("g"):
            self.type()
            self.group("block", is_brace)
        else:
            self.expression()

    def literal_fields(self) -> None:
        def one() -> None:
            self.attributes()
            if self.got("V"):
                if self.c != END:
                    self.expression()
                return
            if self.take("iN") and self.got(":"):
                self.expression()

        self.list_of(one)

    def suffixes(self) -> None:
        while True:
            c = self.c
            if c == "?":
                self.i += 1
            elif c == ".":
                self.i += 1
                if self.take("iNw") == "i":
                    if self.c == "C":
                        self.i += 1
                        self.generic_arguments()
                        if not is_paren(self.c):
                            raise Bad
            elif is_paren(c):
                self.group("expressions", is_paren)
            elif is_bracket(c):
                self.group("expression", is_bracket)
            else:
                return
