"""Tokens of MySQL text."""

from __future__ import annotations

import re
from typing import NamedTuple

# What stands in quotes, comments or braces, and how it ends; one that does not end runs to the end of the text, where the group's name says what is open.
_REST = {
    "single": r"(?:[^'\\]++|\\.|\\\Z|'')*+(?:'|(?P<single>\Z))",
    "double": r"""(?:[^"]++|"")*+(?:"|(?P<double>\Z))""",
    "tick": r"[^`]*+(?:`|(?P<tick>\Z))",
    "block": r".*?(?:\*/|(?P<block>\Z))",
    "brace": r"[^}]*+(?:\}|(?P<brace>\Z))",
}
_SKIPPED = {"space": r"\s+", "comment": rf"/\*{_REST['block']}|--(?=[ \t\n]|\Z)[^\n]*|\#(?!\{{)[^\n]*"}
_KINDS = _SKIPPED | {
    "string": f"'{_REST['single']}|\"{_REST['double']}",
    "name": f"`{_REST['tick']}",
    "param": rf"[#$]\{{{_REST['brace']}|\?|:[A-Za-z_]\w*",
    "number": r"(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?(?![A-Za-z_$\u0080-\uffff])",
    "word": r"@*[\w$]+(?:\$\{[^}]*\}|\#\{[^}]*\})?",
}
_SIGN = "<=>|<>|!=|<=|>=|:=|\\|\\||&&|"
_OPEN = re.compile(r"\(\?P<\w+>")
_PIECES = re.compile("|".join(f"(?P<{kind}>{_OPEN.sub('(?:', pattern)})" for kind, pattern in _KINDS.items()) + f"|(?P<sign>{_SIGN}.)", re.S)


def _all_but(signs: str) -> re.Pattern:
    """As many tokens as come before one of these signs."""
    return re.compile("(?:" + "|".join([*_KINDS.values(), f"{_SIGN}[^{signs}]"]) + ")*+", re.S)


_TO_PARENTHESIS, _TO_SIGN = _all_but("()"), _all_but("();")
_GAP = re.compile("(?:" + "|".join(_SKIPPED.values()) + ")*+", re.S)
_ENDS = {state: re.compile(pattern, re.S) for state, pattern in _REST.items()}
#: What may be open where a line begins: nothing, or one of those.
STATES = ("", *_REST)


class Token(NamedTuple):
    kind: str  # string, name (in backticks), param, number, word or sign
    text: str
    depth: int
    start: int
    end: int

    @property
    def low(self) -> str:
        """The word in lower case; empty for what cannot be a keyword."""
        return self.text.lower() if self.kind == "word" else ""

    @property
    def value(self) -> str:
        return self.text.strip("`") if self.kind == "name" else self.text

    @property
    def is_name(self) -> bool:
        return self.kind == "name" or self.kind == "word" and not self.text.startswith("@")


def tokens(text: str) -> list[Token]:
    out, depth = [], 0
    for m in _PIECES.finditer(text):
        kind = m.lastgroup
        if kind in ("space", "comment"):
            continue
        if m[0] == ")" and kind == "sign":
            depth = max(0, depth - 1)
        out.append(Token(kind, m[0], depth, m.start(), m.end()))
        if m[0] == "(" and kind == "sign":
            depth += 1
    return out


def bare(text: str) -> str:
    """One line without comments."""
    out = "".join((" " if m[0].startswith("/") else "") if m.lastgroup == "comment" else " " if m.lastgroup == "space" else m[0] for m in _PIECES.finditer(text))
    return re.sub(r" {2,}", " ", out).strip() if "'" not in out and '"' not in out else "".join(re.sub(r" {2,}", " ", m[0]) if m.lastgroup == "space" else m[0] for m in _PIECES.finditer(out)).strip()


class Piece(NamedTuple):
    """What stands between two `;`: its first token (None: it has none) and its end."""

    start: int
    begin: int | None
    end: int


def pieces(text: str, state: str = "", depth: int = 0) -> list[Piece]:
    """The text between the `;` outside quotes, comments and parentheses; state and depth are what is open where the text begins."""

    def first(at: int) -> int | None:
        at = _GAP.match(text, at).end()
        return at if at < len(text) and (depth or text[at] != ";") else None

    at = _ENDS[state].match(text).end() if state else 0
    out, start, begin = [], 0, 0 if state not in ("", "block") else first(at)
    while (at := _TO_SIGN.match(text, at).end()) < len(text):
        if text[at] == "(":
            depth += 1
        elif text[at] == ")":
            depth = max(0, depth - 1)
        elif depth == 0:
            out.append(Piece(start, begin, at))
            start, begin = at + 1, first(at + 1)
        at += 1
    return [*out, Piece(start, begin, len(text))]


def effects(text: str) -> list[tuple[str, int, int]]:
    """For each of STATES that may be open where the text begins: (what is open where it ends, a, b), as a depth d before is max(d + a, b) after.

    The text begins and ends where lines do. Walks that meet at a parenthesis are one from there on.
    """

    def walk(at: int, met: dict[int, int]) -> tuple[str | None, list[int], int]:
        signs = []
        while (found := _TO_PARENTHESIS.match(text, at)).end() < len(text):
            at = found.end()
            if at in met:
                return None, signs, met[at]
            signs.append(at)
            at += 1
        return found.lastgroup or "", signs, 0

    def folded(signs: list[int]) -> tuple[int, int]:
        a = b = 0
        for i in signs:
            step = 1 if text[i] == "(" else -1
            a, b = a + step, max(0, b + step)
        return a, b

    end, plain, _ = walk(0, {})
    met = {at: i for i, at in enumerate(plain)}
    out = [(end, *folded(plain))]
    for state in STATES[1:]:
        rest = _ENDS[state].match(text)
        if rest.lastgroup:
            out.append((state, 0, 0))
            continue
        last, signs, i = walk(rest.end(), met)
        out.append((last, *folded(signs)) if last is not None else (end, *folded(signs + plain[i:])))
    return out


def statements(text: str) -> list[tuple[str, int]]:
    """(statement, line of its first token) between the `;` outside quotes, comments and parentheses."""
    out, line, counted = [], 1, 0
    for piece in pieces(text):
        if piece.begin is not None:
            line, counted = line + text.count("\n", counted, piece.begin), piece.begin
            out.append((text[piece.begin : piece.end].strip(), line))
    return out
