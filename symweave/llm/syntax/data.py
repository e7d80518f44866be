"""Local grammars of JSON (RFC 8259) and TOML 1.0: values are reduced from the innermost ones outwards."""

from __future__ import annotations

import re

from symweave.llm.syntax.shapes import ROUNDS, WRONG, Bad

JSON_CLASSES = {c: c for c in "{}[]:,"} | {"true": "v", "false": "v", "null": "v", "\x02": "s"}
_JSON_NUMBER = re.compile(r"-?(?:0|[1-9]\d*)(?:\.\d+)?(?:[eE][+-]?\d+)?", re.ASCII)
JSON_TOKEN = re.compile(r"[ \t\r\n]*([\w.+-]+|\S|[^ \t\r\n])", re.ASCII)
_JSON_INNER = re.compile(r"\{(?:s:[sv](?:,s:[sv])*)?\}|\[(?:[sv](?:,[sv])*)?\]")


def classify_json(token: str) -> str:
    return "v" if _JSON_NUMBER.fullmatch(token) else WRONG


_PIECE = re.compile(r"[\[\]{}]|[^\[\]{}]+")


def _outwards(tokens: str, inner: re.Pattern, group: re.Pattern, outer: int) -> str:
    """The tokens with every value replaced by v, level by level; deep ones in a single pass."""
    for _ in range(ROUNDS):
        tokens, n = inner.subn("v", tokens)
        if not n:
            return tokens
    return _outwards(_deep(tokens, group, outer), inner, group, outer) if "[" in tokens or "{" in tokens else tokens


def _deep(tokens: str, group: re.Pattern, outer: int) -> str:
    """The tokens with each group below so many outer ones replaced by v. Raises Bad if one is no value or brackets don't match."""
    above: list[list[str]] = []
    parts: list[str] = []
    for piece in _PIECE.findall(tokens):
        if piece in "[{":
            above.append(parts)
            parts = [piece]
        elif piece in "]}":
            if not above:
                raise Bad
            parts.append(piece)
            whole = "".join(parts)
            if len(above) > outer:
                if not group.fullmatch(whole):
                    raise Bad
                whole = "v"
            parts = above.pop()
            parts.append(whole)
        else:
            parts.append(piece)
    if above:
        raise Bad
    return "".join(parts)


def json_file(tokens: str) -> None:
    """Raises Bad unless the tokens are one value."""
    if _outwards(tokens, _JSON_INNER, _JSON_INNER, 0) not in ("s", "v"):
        raise Bad


# s: a string that may be a key, m: one over several lines, k: a bare key, f: keys with dots that are a number too, b: a key that is a value too, v: a value.
TOML_CLASSES = {c: c for c in "{}[]=,.\n"} | {"\x02": "s", "\x03": "m", "\r\n": "\n"}
_TOML_VALUE = (
    r"[+-]?(?:0|[1-9](?:_?\d)*)(?:(?:\.\d(?:_?\d)*)?(?:[eE][+-]?\d(?:_?\d)*)?)|[+-]?(?:inf|nan)|0x[\da-fA-F](?:_?[\da-fA-F])*|0o[0-7](?:_?[0-7])*|0b[01](?:_?[01])*|true|false"
    r"|\d{4}-\d\d-\d\d(?:[Tt ]\d\d:\d\d:\d\d(?:\.\d+)?(?:[Zz]|[+-]\d\d:\d\d)?)?|\d\d:\d\d:\d\d(?:\.\d+)?"
)
TOML_TOKEN = re.compile(rf"[ \t]*((?:{_TOML_VALUE})(?![\w.:+-])|[A-Za-z0-9_-]+|\r\n|\n|[^ \t])", re.ASCII)
_VALUE, _BARE = re.compile(_TOML_VALUE, re.ASCII), re.compile(r"[A-Za-z0-9_-]+", re.ASCII)
_KEY = r"[skbf](?:\.[skbf])*"
_TOML_INNER = re.compile(rf"(?<==)\[\n*(?:[smbfv]\n*(?:,\n*[smbfv]\n*)*(?:,\n*)?)?\]|(?<=[\[,\n])\[\n*(?:[smbfv]\n*(?:,\n*[smbfv]\n*)*(?:,\n*)?)?\](?=\n*[\],])|\{{(?:{_KEY}=[smbfv](?:,{_KEY}=[smbfv])*)?\}}")
_TOML_GROUP = re.compile(rf"\[\n*(?:[smbfv]\n*(?:,\n*[smbfv]\n*)*(?:,\n*)?)?\]|\{{(?:{_KEY}=[smbfv](?:,{_KEY}=[smbfv])*)?\}}")
_TOML_FILE = re.compile(rf"(?:(?:{_KEY}=[smbfv]|\[{_KEY}\]|\[\[{_KEY}\]\])?(?:\n|\Z))*")


def classify_toml(token: str) -> str:
    value, bare = _VALUE.fullmatch(token), _BARE.fullmatch(token)
    if value:
        return "b" if bare else "f" if re.fullmatch(r"[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", token) else "v"
    return "k" if bare else WRONG


def toml_file(tokens: str) -> None:
    """Raises Bad unless each line is a key with a value, a table head, or blank."""
    if not _TOML_FILE.fullmatch(_outwards(tokens, _TOML_INNER, _TOML_GROUP, 2)):
        raise Bad
