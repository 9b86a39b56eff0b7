"""Tokens of the extended SQL dialect."""

from __future__ import annotations

import re
from typing import NamedTuple


class SqlError(ValueError):
    """A statement that can't be read, with its place."""


class Token(NamedTuple):
    kind: str  # word, quoted, string, number, op, macro, comment, end
    text: str
    at: int
    line: int

    @property
    def up(self) -> str:
        return self.text.upper() if self.kind == "word" else self.text


_SPEC = re.compile(
    r"""(?P<space>\s+)|(?P<comment>--[^\n]*|/\*.*?\*/)|(?P<macro>\{\{.*?\}\}|\{\*.*?\*\})
    |(?P<number>(?:\d[\d_]*\.?[\d_]*|\.\d+)(?:[eE][+-]?\d+)?)|(?P<string>'(?:[^']|'')*')|(?P<quoted>"(?:[^"]|"")*"|`(?:[^`]|``)*`)
    |(?P<word>[^\W\d]\w*)|(?P<op>\?::|::|->>|->|=>|\|\||//|<=>|<>|!=|<=|>=|==|[-+*/%(),.;<>=\[\]{}:!~^&|?@$\#])""",
    re.S | re.X,
)


def lex(sql: str, comments: bool = False) -> list[Token]:
    out, i, line = [], 0, 1
    while i < len(sql):
        m = _SPEC.match(sql, i)
        if not m:
            raise SqlError(f"line {line}: can't read {sql[i : i + 20]!r}")
        if m.lastgroup not in ("space", "comment") or comments and m.lastgroup == "comment":
            text = m[0]
            if m.lastgroup == "number" and text.endswith(".") and sql[m.end() : m.end() + 1].isidentifier():
                text = text[:-1]
            out.append(Token(m.lastgroup, text, i, line))
            line += text.count("\n")
            i += len(text)
            continue
        line += m[0].count("\n")
        i = m.end()
    out.append(Token("end", "", len(sql), line))
    return out
