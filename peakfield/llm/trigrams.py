"""Boolean trigram queries that a text must satisfy to match a regular expression."""

from __future__ import annotations

from itertools import product
from re import _constants as op
from re import _parser as parser

#: Alternatives that one stretch of literals may have before it is cut, and clauses of a query.
WIDE, CLAUSES = 64, 64
#: One clause: trigrams that must all be there. A query: clauses of which one must hold.
Query = frozenset[frozenset[str]]


def trigrams(s: str) -> frozenset[str]:
    return frozenset(s[i : i + 3] for i in range(len(s) - 2))


def _simple(clauses: set[frozenset[str]]) -> Query:
    """Without clauses that a weaker one makes needless."""
    return frozenset(c for c in clauses if not any(o < c for o in clauses))


class _Stretches:
    """Literal stretches of a sequence: sets of strings, one of which lies there unbroken."""

    def __init__(self) -> None:
        self.needs: list[Query] = []
        self.now: set[str] = {""}

    def add(self, choices: set[str]) -> None:
        longer = {a + b for a, b in product(self.now, choices)}
        if len(longer) > WIDE:
            self.cut()
            longer = choices if len(choices) <= WIDE else {""}
        self.now = longer

    def cut(self) -> None:
        if all(len(s) >= 3 for s in self.now):
            self.needs.append(_simple({trigrams(s) for s in self.now}))
        self.now = {""}


def _exact(items: list) -> set[str] | None:
    """All strings that a sequence matches, if these are few."""
    found = {""}
    for item in items:
        one = _choices(item)
        if one is None or len(one) * len(found) > WIDE:
            return None
        found = {a + b for a, b in product(found, one)}
    return found


def _choices(item: tuple) -> set[str] | None:
    kind, arg = item
    if kind is op.LITERAL:
        return {chr(arg).lower()}
    if kind is op.IN:
        out: set[str] = set()
        for k, a in arg:
            if k is op.LITERAL:
                out.add(chr(a).lower())
            elif k is op.RANGE and a[1] - a[0] < 8:
                out |= {chr(c).lower() for c in range(a[0], a[1] + 1)}
            else:
                return None
        return out if len(out) <= 8 else None
    if kind is op.SUBPATTERN:
        return _exact(list(arg[3]))
    if kind is op.BRANCH:
        parts = [_exact(list(x)) for x in arg[1]]
        return None if any(p is None for p in parts) else set().union(*parts)
    if kind in (op.MAX_REPEAT, op.MIN_REPEAT, op.POSSESSIVE_REPEAT) and arg[1] <= 2:
        one = _exact(list(arg[2]))
        return None if one is None else set().union(*({"".join(p) for p in product(one, repeat=n)} for n in range(arg[0], arg[1] + 1)))
    if kind is op.AT:
        return {""}
    return None


def _walk(items: list, into: _Stretches) -> None:
    for item in items:
        few = _choices(item)
        if few is not None and len(few) <= WIDE:
            into.add(few)
            continue
        into.cut()
        kind, arg = item
        if kind is op.SUBPATTERN:
            _walk(list(arg[3]), into)
            into.cut()
        elif kind is op.BRANCH:
            parts = [query(list(x)) for x in arg[1]]
            if all(parts):
                into.needs.append(_simple(set().union(*parts)))
        elif kind in (op.MAX_REPEAT, op.MIN_REPEAT, op.POSSESSIVE_REPEAT) and arg[0] >= 1:
            _walk(list(arg[2]), into)
            into.cut()


def query(pattern: str | list) -> Query | None:
    """Clauses of lower-case trigrams; None if the expression has no mandatory trigram."""
    into = _Stretches()
    _walk(list(parser.parse(pattern)) if isinstance(pattern, str) else pattern, into)
    into.cut()
    out: Query | None = None
    for need in sorted(into.needs, key=len):
        both = need if out is None else _simple({a | b for a, b in product(out, need)})
        if len(both) <= CLAUSES:
            out = both
    return out
