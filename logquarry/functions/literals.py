"""Texts that must stand in whatever a regular expression matches.

`required` gives a set of which at least one member occurs in every match, or None where a
pattern asks for none that is long enough. Texts are compared after `folded`, one character
for one, which is no finer than any case folding of the pattern itself; so a text without
any of them cannot match, and what has one must still be tried.
"""

from __future__ import annotations

import re

LEAST = 3               # a shorter text stands almost everywhere
MOST_BRANCHES = 32
# Characters outside ASCII that match an ASCII letter where case is ignored.
FOLD = {ord(c): ord(c) + 32 for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"} | {0x130: ord("i"), 0x131: ord("i"), 0x17F: ord("s"), 0x212A: ord("k")}


def folded(text: str) -> str:
    return text.lower() if text.isascii() else text.translate(FOLD)


def required(pattern: str) -> frozenset[str] | None:
    """For a pattern in the common part of both dialects; None also if it cannot be read."""
    from re import _parser
    try:
        tree = _parser.parse(pattern.removesuffix(r"\z"))
    except re.error:
        return None
    loose = bool(re.search(r"\(\?[a-zA-Z]*i", pattern))
    return _best(_Walk(loose).sequence(tree))


def _best(sets: list[frozenset[str]]) -> frozenset[str] | None:
    """The set whose shortest member is longest; fewer members break ties."""
    good = [s for s in sets if s and min(map(len, s)) >= LEAST and len(s) <= MOST_BRANCHES]
    return max(good, key=lambda s: (min(map(len, s)), -len(s), sorted(s)), default=None)


class _Walk:
    """Each step adds what one element of a sequence requires."""

    def __init__(self, loose: bool):
        self.loose = loose

    def sequence(self, items) -> list[frozenset[str]]:
        found, run = [], ""
        for op, arg in items:
            name = str(op)
            if name == "LITERAL" and not (self.loose and arg > 127):
                run += folded(chr(arg))
                continue
            if name in ("AT", "ASSERT", "ASSERT_NOT"):      # no width: what stands around it stays adjacent
                continue
            found += [frozenset([run])] if run else []
            run = ""
            found += self.inner(name, arg)
        return found + ([frozenset([run])] if run else [])

    def inner(self, name: str, arg) -> list[frozenset[str]]:
        if name == "SUBPATTERN":
            return self.sequence(arg[3])
        if name == "ATOMIC_GROUP":
            return self.sequence(arg)
        if name in ("MAX_REPEAT", "MIN_REPEAT", "POSSESSIVE_REPEAT"):
            return self.sequence(arg[2]) if arg[0] >= 1 else []
        if name == "BRANCH":
            each = [_best(self.sequence(branch)) for branch in arg[1]]
            return [frozenset().union(*each)] if all(each) else []
        return []
