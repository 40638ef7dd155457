"""Boolean trigram queries derived from regular expressions.

A query is a disjunction of conjunctions: a list of sets of trigrams, one set of which every
matching text contains whole. None stands for "anything": the expression forces no trigram.
Trigrams are compared in lower case (A-Z only), so letter case never matters.
"""

from __future__ import annotations

import re
from re import _constants as ops
from re import _parser as parser

#: A set of alternatives that grows beyond this is closed: its trigrams so far are required.
MOST_STRINGS = 64


def trigrams(text: str) -> frozenset[str]:
    return frozenset(text[i : i + 3] for i in range(len(text) - 2))


class _Part:
    """What is known of a piece of the expression: the strings it spells exactly (None: unknown),
    and the disjunction of trigram sets that it forces besides them."""

    def __init__(self, exact: set[str] | None, forced: list[frozenset[str]] | None = None):
        self.exact, self.forced = exact, forced if forced is not None else [frozenset()]


def _both(a: list[frozenset[str]], b: list[frozenset[str]]) -> list[frozenset[str]]:
    out = {x | y for x in a for y in b}
    if len(out) > MOST_STRINGS:
        return min(a, b, key=len)
    return _least(out)


def _least(sets) -> list[frozenset[str]]:
    """Without the sets that contain another one: these add nothing to a disjunction."""
    sets = set(sets)
    return sorted((s for s in sets if not any(t < s for t in sets)), key=sorted)


def _closed(part: _Part) -> _Part:
    if part.exact is None:
        return part
    spelled = _least(trigrams(s) for s in part.exact)
    return _Part(None, _both(part.forced, spelled))


def _sequence(items) -> _Part:
    done = _Part({""})
    for op, arg in items:
        done = _joined(done, _one(op, arg))
    return done


def _joined(a: _Part, b: _Part) -> _Part:
    if a.exact is not None and b.exact is not None and len(a.exact) * len(b.exact) <= MOST_STRINGS:
        return _Part({x + y for x in a.exact for y in b.exact}, _both(a.forced, b.forced))
    if b.exact is not None:  # a is closed, b's strings may still grow
        a = _closed(a)
        return _Part(b.exact, _both(a.forced, b.forced))
    a, b = _closed(a), _closed(b)
    return _Part({""}, _both(a.forced, b.forced))


def _one(op, arg) -> _Part:
    if op is ops.LITERAL:
        return _Part({chr(arg).lower() if arg < 128 else chr(arg)})
    if op is ops.IN and all(o is ops.LITERAL for o, _ in arg) and len(arg) <= 8:
        return _Part({chr(c).lower() if c < 128 else chr(c) for _, c in arg})
    if op is ops.SUBPATTERN:
        return _sequence(arg[-1])
    if op is ops.BRANCH:
        parts = [_sequence(x) for x in arg[1]]
        if all(p.exact is not None and p.forced == [frozenset()] for p in parts):
            strings = set().union(*(p.exact for p in parts))
            if len(strings) <= MOST_STRINGS:
                return _Part(strings)
        return _Part(None, _least(s for p in parts for s in _closed(p).forced))
    if op in (ops.MAX_REPEAT, ops.MIN_REPEAT, ops.POSSESSIVE_REPEAT):
        least, most, inner = arg
        part = _sequence(inner)
        if least == 0:
            small = most == 1 and part.exact is not None and part.forced == [frozenset()]
            return _Part(part.exact | {""}) if small else _Part(None)
        whole = part
        for _ in range(min(least, 3) - 1):
            whole = _joined(whole, part)
        return whole if least == most <= 3 else _closed(whole)
    if op is ops.AT:
        return _Part({""})
    return _Part(None)


def query_of(pattern: str) -> list[frozenset[str]] | None:
    """The trigram query of a pattern in Python's (here also Java's) syntax; None if nothing is forced."""
    part = _closed(_sequence(parser.parse(pattern)))
    sets = _least(part.forced)
    return None if not sets or frozenset() in sets else sets


def holds(query: list[frozenset[str]] | None, text: str) -> bool:
    """Whether text may match, by the query alone."""
    low = re.sub("[A-Z]+", lambda m: m[0].lower(), text)
    return query is None or any(all(t in low for t in s) for s in query)
