"""Query text to tokens."""

from __future__ import annotations

import re
from typing import NamedTuple

from tracemill.errors import LexError

KEYWORDS = frozenset(
    "select distinct from where group by having order asc desc limit offset as and or not in like between is null true false interval join inner left right on".split()
)


class Token(NamedTuple):
    kind: str  # keyword, name, quoted, int, float, string, duration, op, end
    value: str
    at: int


_TOKEN = re.compile(
    r"""(?P<skip>\s+|--[^\n]*)
    |(?P<float>\d+\.\d+(?![\w.]))
    |(?P<duration>\d+(?:us|ms|s|m|h|d)(?!\w))
    |(?P<int>\d+(?![\w]))
    |(?P<string>'(?:[^']|'')*')
    |(?P<quoted>"(?:[^"]|"")*")
    |(?P<name>[^\W\d]\w*)
    |(?P<op><=|>=|<>|!=|\|\||[-+*/%=<>(),.;])""",
    re.X,
)


def tokenize(text: str) -> list[Token]:
    """The tokens of text, an `end` last. Keywords are lower case, names as written."""
    out: list[Token] = []
    at = 0
    while at < len(text):
        m = _TOKEN.match(text, at)
        if m is None:
            what = "unterminated string" if text[at] in "'\"" else f"unexpected character {text[at]!r}"
            raise LexError(f"{what} at {at}")
        kind, value = m.lastgroup, m.group()
        if kind == "name" and value.lower() in KEYWORDS:
            kind, value = "keyword", value.lower()
        elif kind in ("string", "quoted"):
            value = value[1:-1].replace(value[0] * 2, value[0])
        elif kind == "op" and value == "<>":
            value = "!="
        if kind != "skip":
            out.append(Token(kind, value, at))
        at = m.end()
    out.append(Token("end", "", len(text)))
    return out
