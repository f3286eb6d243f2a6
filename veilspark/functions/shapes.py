"""Shapes of short texts, and which patterns a shape leaves possible.

A shape has 0 for every decimal digit, A and a for ASCII letters, _ for other word characters, a
blank for white space, and all other ASCII signs as they are; it is as long as the text. A pattern loosened the
same way matches the shape of every text that the pattern matches. Columns have few shapes, so
what a shape rules out is worked out once per shape, not once per cell.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence

from ..patterns import Pattern

#: texts up to this length are gone about by their shape
LONGEST = 64
#: shapes a task remembers; beyond, it starts anew
REMEMBERED = 50_000

_PART = re.compile(r"\\.|\[(?:\\.|[^\]\\])+\]|\{\d+(?:,\d*)?\}|\(\?:|[()|?*+]|.", re.S)
_MEMBER = re.compile(r"(\\.|[^\\])-(\\.|[^\\])|\\.|.", re.S)
# What escapes stand for in a shape; word boundaries stay.
_ESCAPES = {r"\b": r"\b", r"\d": "0", r"\s": " ", r"\w": "[0Aa_]"}


class _Shape(dict):
    """Shape characters by code point, worked out as they are met."""

    def __missing__(self, point: int) -> int:
        c = chr(point)
        if c.isdecimal():
            shape = "0"
        elif c.isspace():
            shape = " "
        elif point < 128:
            shape = "A" if c.isupper() else "a" if c.islower() else c
        else:
            shape = "_" if c.isalnum() else "\x7f"
        if point < 0x3000:
            self[point] = ord(shape)
        return ord(shape)


_SHAPE = _Shape()


def shape(text: str) -> str:
    return text.translate(_SHAPE)


def _loose(c: str, ignore_case: bool) -> str:
    """Shapes of one character of a pattern."""
    made = shape(c)
    return "Aa_" if ignore_case and made in "Aa" else made


def loosened(regex: str, ignore_case: bool = False) -> str | None:
    """A regular expression for shapes that matches wherever ``regex`` does, None for grammar it doesn't know.

    Known are literals, classes that aren't negated, groups that don't capture, alternatives, repeats and word boundaries.
    """
    out = []
    for part in _PART.findall(regex):
        if part in ("(?:", "(", ")", "|", "?", "*", "+") or part[0] == "{" and len(part) > 1:
            out.append(part)
        elif part in _ESCAPES:
            out.append(_ESCAPES[part])
        elif part[0] == "[" and len(part) > 1:
            if part[1] == "^":
                return None
            members = set()
            for m in _MEMBER.finditer(part[1:-1]):
                if m[1]:
                    ends = m[1][-1], m[2][-1]
                    members.update(*(_loose(chr(c), ignore_case) for c in range(ord(ends[0]), ord(ends[1]) + 1)))
                elif m[0] in (r"\d", r"\s"):
                    members.add(_ESCAPES[m[0]])
                elif m[0][0] == "\\" and m[0][-1].isalnum():
                    return None
                else:
                    members.update(_loose(m[0][-1], ignore_case))
            out.append("[" + "".join(re.escape(c) for c in sorted(members)) + "]")
        elif part[0] == "\\" and part[-1].isalnum() or part in "^$.[{":
            return None
        else:
            out.append("[" + "".join(re.escape(c) for c in sorted(_loose(part[-1], ignore_case))) + "]")
    return None if "(?" in "".join(out).replace("(?:", "") else "".join(out)


def candidates(patterns: Sequence[Pattern]) -> Callable[[str], tuple[int, ...]]:
    """A function from a text to the places of the patterns that its shape leaves possible."""
    loose = [(i, loosened(p.regex, p.ignore_case)) for i, p in enumerate(patterns)]
    tests = [(i, re.compile(rx).search if rx is not None else lambda s: True) for i, rx in loose]
    known: dict[str, tuple[int, ...]] = {}

    def find(text: str) -> tuple[int, ...]:
        made = text.translate(_SHAPE)
        found = known.get(made)
        if found is None:
            found = tuple(i for i, search in tests if search(made))
            if len(known) >= REMEMBERED:
                known.clear()
            known[made] = found
        return found
    return find
