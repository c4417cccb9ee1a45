"""Secret formats, and the Boolean trigram query that follows from each pattern."""

from __future__ import annotations

import re
from dataclasses import dataclass
from re import _constants as op
from re import _parser as parser

#: Strings that one place of a pattern may stand for; with more it is taken as unknown.
MOST_STRINGS = 32


@dataclass(frozen=True)
class Rule:
    kind: str
    pattern: str  # in the syntax that Java and Python share
    group: int = 0  # whose length counts
    least: int = 1  # code points of that group


#: The three base formats, in the order of their spans, then public token formats.
RULES = (
    Rule("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    Rule("access", r"AKIA[A-Z0-9]{14,}"),
    Rule("hex", r"[0-9a-f]{16,}"),
    Rule("private_key", r"-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[0-9A-Za-z_-]{35}"),
    Rule("stripe", r"sk_live_[0-9A-Za-z]{16,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}"),
)
BASE_KINDS = ("assign", "access", "hex")


def trigrams(text: str) -> frozenset[str]:
    return frozenset(text[i : i + 3] for i in range(len(text) - 2))


def _strings(kind, value) -> set[str] | None:
    """The strings that a one-character node stands for, in lower case, if they are few."""
    if kind is op.LITERAL:
        return {chr(value).lower()}
    if kind is op.IN:
        found: set[str] = set()
        for k, v in value:
            if k is op.LITERAL:
                found.add(chr(v).lower())
            elif k is op.RANGE and v[1] - v[0] < MOST_STRINGS:
                found |= {chr(c).lower() for c in range(v[0], v[1] + 1)}
            else:
                return None
        return found if len(found) <= MOST_STRINGS // 4 else None
    return None


def _or(clauses: set[frozenset[str]]) -> set[frozenset[str]]:
    """Clauses of which one must hold; a clause that contains another says nothing new."""
    return {c for c in clauses if not any(o < c for o in clauses)}


def _walk(nodes) -> tuple[set[str] | None, set[frozenset[str]]]:
    """(all strings it stands for, or None; clauses: sets of trigrams, one of which every match holds)."""
    every, known, exact = {frozenset()}, {""}, True

    def close() -> None:
        nonlocal every, known
        every = _or({a | trigrams(k) for a in every for k in known})
        known = {""}

    for kind, value in nodes:
        strings, clauses = _strings(kind, value), {frozenset()}
        if kind is op.SUBPATTERN:
            strings, clauses = _walk(value[-1])
        elif kind is op.BRANCH:
            parts = [_walk(p) for p in value[1]]
            strings = None if any(s is None for s, _ in parts) else set().union(*(s for s, _ in parts))
            clauses = _or(set().union(*(c for _, c in parts)))
        elif kind in (op.MAX_REPEAT, op.MIN_REPEAT):
            low, high, body = value
            inner, found = _walk(body)
            strings = {""} | inner if (low, high) == (0, 1) and inner is not None else None
            if low == high == 1:
                strings = inner
            clauses = found if low else {frozenset()}
        if strings is not None and len(strings) * len(known) <= MOST_STRINGS:
            known = {k + s for k in known for s in strings}
            continue
        exact = False
        close()
        if strings is not None:
            known = set(strings)
        else:
            every = _or({a | c for a in every for c in clauses})
    if exact:
        return known, _or({trigrams(k) for k in known})
    close()
    return None, every


def trigram_query(pattern: str) -> list[list[str]]:
    """Clauses of trigrams of the lower-cased text: a match holds all trigrams of one clause at least.

    An empty list: the pattern demands no trigram, and every text must be scanned.
    """
    _, clauses = _walk(parser.parse(re.sub(r"\\x20", " ", pattern)))
    return [] if frozenset() in clauses else sorted(sorted(c) for c in clauses)
