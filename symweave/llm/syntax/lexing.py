"""Lexer-state maps: what a chunk of a file is, for each state in which the lexer may enter it.

The states are N (plain code), K1, K2, ... (a block comment, Rust's ones nested), and of literals over several lines
T (Java text block, TOML basic string), L (TOML literal string), S (Rust string) and R0, R1, ... (raw string with so
many signs). Only where a chunk begins within a line there are also Q and A (a string of one line between double or
single quotes) and C (the rest of a line comment). X is what no text leads out of. A chunk that holds no end of a comment
or literal keeps its state; this makes the map finite. Maps of neighbouring chunks join to one, in whatever order.
"""

from __future__ import annotations

import re
from collections import defaultdict

from symweave.llm.syntax import data, java, rust
from symweave.llm.syntax.shapes import ROUNDS, WRONG

_ESCAPE_J = r"\\(?:[btnfrs\"'\\]|[0-3]?[0-7]{1,2}|u+[0-9a-fA-F]{4})"
_ESCAPE_R = r"\\(?:[nrt\\0'\"]|x[0-7][0-9a-fA-F]|u\{(?:[0-9a-fA-F]_*){1,6}\}|\r?\n)"
_BYTE_R = r"\\(?:[nrt\\0'\"]|x[0-9a-fA-F]{2}|\r?\n)"
# Each start of a comment or literal; the named groups say what it is: skip, a string, a character, a lifetime, or an open one.
_STARTS = {
    "java": re.compile(
        r'(?P<skip>//[^\r\n]*|/\*[\s\S]*?\*/)|(?P<open_K>/\*)|(?P<text>"""[ \t\f]*\r?\n(?:[^"\\]|\\[\s\S]|"(?!""))*+""")|(?P<open_T>"""[ \t\f]*\r?\n)'
        rf'|(?P<string>"(?:[^"\\\r\n]|{_ESCAPE_J})*+"|\'(?:[^\'\\\r\n\U00010000-\U0010ffff]|{_ESCAPE_J})\')|(?P<wrong>["\'\\])'
    ),
    "rust": re.compile(
        r"(?P<skip>//[^\n]*)|(?P<open_K>/\*)|(?P<raw>\b(?:br|cr|r)(?P<signs>#*)\")"
        rf'|(?P<string>\b[c]?"(?:[^"\\]|{_ESCAPE_R})*+"|"(?:[^"\\]|{_ESCAPE_R})*+"|\bb"(?:[^"\\\x80-\U0010ffff]|{_BYTE_R})*+"|(?:\bb)?\'(?:[^\'\\\r\n\t]|{_ESCAPE_R}|\\x[0-9a-fA-F]{{2}})\')'
        r"|(?P<life>'(?:[^\W\d]\w*)(?!'))|(?P<open_S>(?:\b[bc])?\")|(?P<wrong>['\\])"
    ),
    "json": re.compile(r'(?P<string>"(?:[^"\\\x00-\x1f]|\\(?:["\\/bfnrt]|u[0-9a-fA-F]{4}))*+")|(?P<wrong>")'),
    "toml": re.compile(
        r'(?P<skip>#[^\x00-\x08\x0a-\x1f\x7f]*)|(?P<text>"""(?:[^"\\\x00-\x08\x0b\x0c\x0e-\x1f\x7f]|\\(?:[btnfr"\\]|u[0-9a-fA-F]{4}|U[0-9a-fA-F]{8}|[ \t]*\r?\n\s*)|"{1,2}(?!"))*+"{3,5}|\'\'\'(?:[^\'\x00-\x08\x0b\x0c\x0e-\x1f\x7f]|\'{1,2}(?!\'))*+\'{3,5})'
        r'|(?P<open_T>""")|(?P<open_L>\'\'\')'
        r'|(?P<string>"(?:[^"\\\x00-\x08\x0a-\x1f\x7f]|\\(?:[btnfr"\\]|u[0-9a-fA-F]{4}|U[0-9a-fA-F]{8}))*+"|\'[^\'\x00-\x08\x0a-\x1f\x7f]*+\')|(?P<wrong>["\'#\\])'
    ),
}
_ENDS = {"T": re.compile(r'(?:[^"\\]|\\[\s\S]|"(?!""))*+"{3}(?:"{0,2}(?!"))?'), "L": re.compile(r"(?:[^']|'(?!''))*+'{3,5}"), "S": re.compile(r'(?:[^"\\]|\\[\s\S])*+"')}
_INSIDE = {
    ("java", "Q"): re.compile(rf'(?:[^"\\\r\n]|{_ESCAPE_J})*+'), ("json", "Q"): re.compile(r'(?:[^"\\\x00-\x1f]|\\(?:["\\/bfnrt]|u[0-9a-fA-F]{4}))*+'),
    ("toml", "Q"): re.compile(r'(?:[^"\\\x00-\x08\x0a-\x1f\x7f]|\\(?:[btnfr"\\]|u[0-9a-fA-F]{4}|U[0-9a-fA-F]{8}))*+'), ("toml", "A"): re.compile(r"[^'\x00-\x08\x0a-\x1f\x7f]*+"),
    ("java", "C"): re.compile(r"[^\r\n]*+"), ("rust", "C"): re.compile(r"[^\n]*+"), ("toml", "C"): re.compile(r"[^\x00-\x08\x0a-\x1f\x7f]*+"),
}
_QUOTES = {"Q": '"', "A": "'"}
_HEAD = re.compile(r"^\ufeff?(?:#!(?!\s*\[)[^\n]*)?")
_NEST = re.compile(r"/\*|\*/")
_MARKS = re.compile("[\x01-\x08]")
_BRACKETS, _PAIRS = re.compile(r"[^()\[\]{}]+"), re.compile(r"\(\)|\[\]|\{\}")


class _Classes(defaultdict):
    """The character of each token met so far."""

    def __init__(self, fixed: dict[str, str], rule) -> None:
        super().__init__(None, fixed)
        self.rule = rule

    def __missing__(self, token: str) -> str:
        c = self.rule(token)
        if len(self) < 200_000:
            self[token] = c
        return c


_TOKENS = {
    "java": (java.TOKEN, _Classes(java.CLASSES, java.classify)),
    "rust": (rust.TOKEN, _Classes(rust.CLASSES, rust.classify)),
    "json": (data.JSON_TOKEN, _Classes(data.JSON_CLASSES, data.classify_json)),
    "toml": (data.TOML_TOKEN, _Classes(data.TOML_CLASSES, data.classify_toml)),
}


def _leave(text: str, state: str, at: int, language: str) -> tuple[int, str]:
    """Where the comment or literal of the state ends in the text, and the state from there on."""
    kind, depth, nested = state[0], int(state[1:] or 0), language == "rust"
    if kind in "QAC":
        at = _INSIDE[language, kind].match(text, at).end()
        if at == len(text):
            return at, state
        return (at, "N") if kind == "C" else (at + 1, "N") if text[at] == _QUOTES[kind] else (len(text), "X")
    if kind == "K":
        for m in _NEST.finditer(text, at):
            depth += (1 if nested else 0) if m.group() == "/*" else -1
            if not depth:
                return m.end(), "N"
        return len(text), f"K{depth}"
    if kind == "R":
        end = text.find('"' + "#" * depth, at)
        return (len(text), state) if end < 0 else (end + 1 + depth, "N")
    m = _ENDS[kind].match(text, at)
    return (m.end(), "N") if m else (len(text), state)


def lex(text: str, language: str, state: str = "N") -> tuple[str, str]:
    """(tokens, state at the end) of a chunk, one character for each token; a literal counts where it begins."""
    starts, marks = _STARTS[language], language == "toml"
    parts, at = [], 0
    if state != "N":
        at, state = _leave(text, state, 0, language)
    while state == "N":
        m = starts.search(text, at)
        piece = text[at : m.start()] if m else text[at:]
        parts.append(_MARKS.sub(WRONG, piece) if not piece.isprintable() else piece)
        if m is None:
            break
        at, kind = m.end(), m.lastgroup
        if kind in ("skip", "life", "string", "text"):
            parts.append({"skip": " ", "life": " \x04 ", "string": " \x02 ", "text": " \x03 "}[kind])
            if kind == "skip" and at == len(text) and m.group()[:2] != "/*":
                state = "C"
        elif kind == "wrong":
            quote = next((k for k, q in _QUOTES.items() if q == m.group() and (language, k) in _INSIDE), None)
            whole = quote is not None and _leave(text, quote, at, language)[1] == quote
            parts.append(" \x02 " if whole else " \x01 ")
            if whole:
                state = quote
        elif kind == "raw" or kind == "signs":
            parts.append(" \x02 ")
            at, state = _leave(text, f"R{len(m.group('signs'))}", at, language)
        else:
            parts.append(" " if kind == "open_K" else " \x03 " if marks or kind == "open_T" else " \x02 ")
            at, state = _leave(text, "K1" if kind == "open_K" else kind[-1], at, language)
    pattern, classes = _TOKENS[language]
    return "".join(map(classes.__getitem__, pattern.findall("".join(parts)))), state


def brackets(tokens: str) -> str:
    """The brackets that find no partner within the tokens: closing ones, then opening ones, if the tokens are sound."""
    left, n, rounds = _BRACKETS.sub("", tokens), 1, 0
    while n and rounds < ROUNDS:
        left, n = _PAIRS.subn("", left)
        rounds += 1
    if not n:
        return left
    open_: list[str] = []
    for c in left:
        if open_ and open_[-1] + c in ("()", "[]", "{}"):
            open_.pop()
        else:
            open_.append(c)
    return "".join(open_)


def entries(text: str, language: str, within_line: bool) -> list[str]:
    """The states in which entering the chunk must be looked at; from any other one it is left as it was entered."""
    found = ["N", *(kind for lang, kind in _INSIDE if within_line and lang == language)]
    if language in ("java", "rust"):
        depth = deepest = 0
        for m in _NEST.finditer(text):
            depth += (1 if language == "rust" else 0) if m.group() == "/*" else -1
            deepest = min(deepest, depth)
        found += [f"K{d}" for d in range(1, (1 if language == "java" and deepest < 0 else -deepest) + 1)]
    if language in ("java", "toml") and '"""' in text:
        found.append("T")
    if language == "toml" and "'''" in text:
        found.append("L")
    if language == "rust" and '"' in text:
        found += ["S", *(f"R{n}" for n in range(max(map(len, re.findall('"(#*)', text))) + 1))]
    return found


def lost_depth(text: str) -> int:
    """By how much a chunk deepens a nested comment in which it lies wholly."""
    return text.count("/*") - text.count("*/")


#: Rows (entry state, exit state, tokens, unmatched brackets) of a chunk, and by how much it deepens a comment around it.
Map = tuple[list[tuple[str, str, str, str]], int]


def chunk_map(text: str, language: str, first: bool, within_line: bool = False) -> Map:
    """The map of a chunk; of a file's first chunk only from plain code."""
    rows = []
    if first and language == "rust":
        text = _HEAD.sub("", text, count=1)
    for entry in ["N"] if first else entries(text, language, within_line):
        tokens, end = lex(text, language, entry)
        rows.append((entry, end, tokens, brackets(tokens)))
    return rows, lost_depth(text)


def join(a: Map, b: Map, nested: bool, first: bool = False) -> Map:
    """The map of two neighbouring chunks together; joining is associative. first: a begins its file."""
    own, next_ = {r[0] for r in a[0]}, {r[0]: r for r in b[0]}
    deeper = lambda state, by: f"K{int(state[1:]) + by}" if nested and state[0] == "K" else state
    rows = []
    for entry, state, tokens, open_ in a[0]:
        if state in next_:
            _, state, more, unmatched = next_[state]
            rows.append((entry, state, tokens + more, brackets(open_ + unmatched)))
        else:
            rows.append((entry, deeper(state, b[1]), tokens, open_))
    # What leaves a as it entered it goes on as b says.
    for entry, state, tokens, open_ in [] if first else b[0]:
        before = deeper(entry, -a[1])
        if before not in own and (before[0] != "K" or int(before[1:]) > 0):
            rows.append((before, state, tokens, open_))
    return rows, a[1] + b[1]


def whole_file(m: Map) -> str | None:
    """The tokens of a file from its map; None if it ends within a comment or literal, or its brackets don't match."""
    _, state, tokens, open_ = m[0][0]
    return tokens if state in ("N", "C") and not open_ else None
