"""Tokens of the SQLite dialect."""

from __future__ import annotations

import re
from typing import NamedTuple

from quarry.errors import ParseError


class Token(NamedTuple):
    kind: str  # word, quoted, string, blob, number, param, op, end
    text: str
    at: int


_PATTERN = re.compile(
    r"""(?P<space>\s+|--[^\n]*|/\*.*?\*/)
      | (?P<blob>[xX]'[0-9a-fA-F]*')
      | (?P<string>'(?:[^']|'')*')
      | (?P<quoted>"(?:[^"]|"")*"|`(?:[^`]|``)*`|\[[^\]]*\])
      | (?P<number>0[xX][0-9a-fA-F]+|(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)
      | (?P<param>\?\d*|[:@$]\w+)
      | (?P<word>[^\W\d]\w*)
      | (?P<op>\|\||<<|>>|<=|>=|<>|!=|==|->>|->|[-+*/%(),.;<>=&|~])""",
    re.X | re.S,
)


def tokens(sql: str) -> list[Token]:
    out, at = [], 0
    while at < len(sql):
        m = _PATTERN.match(sql, at)
        if not m:
            raise ParseError(f"unexpected {sql[at : at + 12]!r} at {at}")
        if m.lastgroup != "space":
            out.append(Token(m.lastgroup, m[0], at))
        at = m.end()
    out.append(Token("end", "", at))
    return out


def statements(sql: str) -> list[str]:
    """The statements of a text, without their semicolons."""
    out, begin = [], 0
    for t in tokens(sql):
        if t.text == ";" or t.kind == "end":
            if part := sql[begin : t.at].strip():
                out.append(part)
            begin = t.at + 1
    return [s for s in out if len(tokens(s)) > 1]
