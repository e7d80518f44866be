"""Balanced groups of tokens, each reduced to one character, and the base of the local grammars.

A file is a string with one character for each token. Its innermost bracketed groups are replaced by one character
that stands for all groups with the same content, until no bracket is left. So a statement is a short flat string,
equal statements of all files are one string, and each is parsed only once.
"""

from __future__ import annotations

import re

_INNER = re.compile(r"\([^()\[\]{}]*\)|\[[^()\[\]{}]*\]|\{[^()\[\]{}]*\}")
_PIECE = re.compile(r"[()\[\]{}]|[^()\[\]{}]+")
_CLOSE = {"(": ")", "[": "]", "{": "}"}
#: Levels of groups that are reduced one after the other; deeper ones are in a single pass.
ROUNDS = 64
_FIRST = {"(": 0x1000, "[": 0x50000, "{": 0x90000}
_LAST = {"(": 0x50000, "[": 0x90000, "{": 0x110000}
#: Ends every string; a token that is no token of the language.
END, WRONG = "\0", "\x01"
BRACE = "\U00090000-\U0010ffff"


class Bad(Exception):
    """The tokens don't follow the grammar."""


def is_paren(c: str) -> bool:
    return "က" <= c < "\U00050000"


def is_bracket(c: str) -> bool:
    return "\U00050000" <= c < "\U00090000"


def is_brace(c: str) -> bool:
    return c >= "\U00090000"


class Shapes:
    """The contents of groups by their character, and what has been found out about them."""

    def __init__(self) -> None:
        self.clear()

    def clear(self) -> None:
        self.next = dict(_FIRST)
        self.known: dict[str, str] = {}
        self.content: dict[str, str] = {}
        self.checked: dict[tuple[str, str], bool] = {}
        self.statements: dict[str, bool] = {}

    def _char(self, group: str) -> str:
        c = self.known.get(group)
        if c is None:
            n = self.next[group[0]]
            if 0xD800 <= n < 0xE000:
                n = 0xE000
            c = self.known[group] = chr(n)
            self.next[group[0]] = n + 1
            self.content[c] = group[1:-1]
        return c

    def reduce(self, tokens: str) -> str:
        """The tokens without brackets. Raises Bad if brackets don't match."""
        if any(self.next[k] > _LAST[k] - 100_000 for k in _FIRST) or len(self.statements) > 500_000:
            self.clear()
        n, rounds = 1, 0
        while n and rounds < ROUNDS:
            tokens, n = _INNER.subn(lambda m: self._char(m.group()), tokens)
            rounds += 1
        if n:
            tokens = self._deep(tokens)
        if any(b in tokens for b in "()[]{}"):
            raise Bad
        return tokens

    def _deep(self, tokens: str) -> str:
        """What is left of deep groups, in one pass over the tokens. Raises Bad if brackets don't match."""
        outer: list[tuple[str, list[str]]] = []
        parts: list[str] = []
        for piece in _PIECE.findall(tokens):
            if piece in _CLOSE:
                outer.append((piece, parts))
                parts = []
            elif piece in _CLOSE.values():
                if not outer or _CLOSE[outer[-1][0]] != piece:
                    raise Bad
                first, before = outer.pop()
                before.append(self._char(first + "".join(parts) + piece))
                parts = before
            else:
                parts.append(piece)
        if outer:
            raise Bad
        return "".join(parts)


class Grammar:
    """A recursive descent over one flat string; groups within it are checked by the rule their place asks for."""

    shapes: Shapes

    def __init__(self, tokens: str) -> None:
        self.s, self.i = tokens + 4 * END, 0

    def fail(self) -> None:
        raise Bad

    @property
    def c(self) -> str:
        return self.s[self.i]

    def take(self, chars: str) -> str:
        """The next token, which must be one of chars."""
        c = self.s[self.i]
        if c == END or c not in chars:
            raise Bad
        self.i += 1
        return c

    def got(self, chars: str) -> bool:
        """Whether the next token is one of chars; it is taken then."""
        c = self.s[self.i]
        if c != END and c in chars:
            self.i += 1
            return True
        return False

    def group(self, rule: str, is_kind) -> None:
        """Takes a group of the kind, whose content must follow the rule."""
        c = self.s[self.i]
        if not is_kind(c) or not self.check(rule, c):
            raise Bad
        self.i += 1

    def check(self, rule: str, c: str) -> bool:
        """Whether the content of the group follows the rule; each is looked into once."""
        key = (rule, c)
        known = self.shapes.checked.get(key)
        if known is None:
            known = self.shapes.checked[key] = self.holds(rule, self.shapes.content[c])
        return known

    @classmethod
    def holds(cls, rule: str, tokens: str) -> bool:
        """Whether the tokens as a whole follow the rule."""
        g = cls(tokens)
        try:
            getattr(g, rule)()
        except Bad:
            return False
        return g.c == END

    def attempt(self, rule) -> bool:
        """Whether the rule holds here; if not, nothing is taken."""
        at = self.i
        try:
            rule()
            return True
        except Bad:
            self.i = at
            return False

    def list_of(self, rule, trailing: bool = True) -> None:
        """Items between commas up to the end, none at all too, with a comma after the last one if that is allowed."""
        while self.c != END:
            rule()
            if not self.got(","):
                break
            if self.c == END and not trailing:
                raise Bad
