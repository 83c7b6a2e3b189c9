"""Reads plan files: settings `name = value;` with groups {}, lists () and arrays []."""

from __future__ import annotations

import re

from ..errors import InvalidParameter

_TOKEN = re.compile(
    r"""\s+|\#[^\n]*|//[^\n]*|/\*.*?\*/
    |(?P<float>[-+]?(?:\d+\.\d*|\.\d+|\d+(?=[eE]))(?:[eE][-+]?\d+)?)
    |(?P<hex>0[xX][0-9a-fA-F]+L?)|(?P<int>[-+]?\d+L?)
    |(?P<text>"(?:\\.|[^"\\])*")|(?P<name>[A-Za-z*][-A-Za-z0-9_*]*)|(?P<mark>[{}()\[\],;:=])""",
    re.VERBOSE | re.DOTALL,
)
_ESCAPES = {"n": "\n", "t": "\t", "r": "\r", "f": "\f"}


def _tokens(text: str) -> list[tuple[str, object]]:
    out, at = [], 0
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m:
            raise InvalidParameter(f"line {text.count(chr(10), 0, at) + 1}: {text[at : at + 20]!r}")
        at, kind = m.end(), m.lastgroup
        if kind == "float":
            out.append(("value", float(m[0])))
        elif kind in ("int", "hex"):
            out.append(("value", int(m[0].rstrip("L"), 16 if kind == "hex" else 10)))
        elif kind == "text":
            out.append(("text", re.sub(r"\\(.)", lambda e: _ESCAPES.get(e[1], e[1]), m[0][1:-1])))
        elif kind:
            out.append((kind, m[0]))
    return out


class _Reader:
    def __init__(self, text: str):
        self.tokens, self.at = _tokens(text), 0

    def next(self, want: str | None = None):
        if self.at >= len(self.tokens):
            raise InvalidParameter("the plan file ends early")
        kind, value = self.tokens[self.at]
        if want and value != want:
            raise InvalidParameter(f"{value!r} where {want!r} should be")
        self.at += 1
        return kind, value

    def peek(self):
        return self.tokens[self.at][1] if self.at < len(self.tokens) else None

    def group(self, end: str | None) -> dict:
        out: dict = {}
        while self.peek() != end:
            kind, name = self.next()
            if kind != "name":
                raise InvalidParameter(f"{name!r} where a name should be")
            if self.next()[1] not in (":", "="):
                raise InvalidParameter(f"no value for {name}")
            out[name] = self.value()
            if self.peek() in (";", ","):
                self.next()
        return out

    def value(self):
        kind, token = self.next()
        if kind == "text":
            while self.at < len(self.tokens) and self.tokens[self.at][0] == "text":
                token += self.next()[1]
            return token
        if kind == "value":
            return token
        if kind == "name" and token.lower() in ("true", "false"):
            return token.lower() == "true"
        if token == "{":
            out = self.group("}")
            self.next("}")
            return out
        if token in ("(", "["):
            close, items = {"(": ")", "[": "]"}[token], []
            while self.peek() != close:
                items.append(self.value())
                if self.peek() == ",":
                    self.next()
            self.next(close)
            return items
        raise InvalidParameter(f"{token!r} where a value should be")


def parse(text: str) -> dict:
    return _Reader(text).group(None)
