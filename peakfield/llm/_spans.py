"""Spans of regular-expression matches, with DataFrame functions only."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

SPAN = "array<struct<start:int,end:int,found:string>>"
NONE = f"cast(array() as {SPAN})"


def no_spans() -> Column:
    return F.expr(NONE)


#: A code point that Unicode sets aside as no character; texts that hold it take another way.
MARK = "\ufdd0"
#: Pieces of a text (those between matches and matches, by turns) that are walked at once: an even
#: number. An array that grows by one is copied as often, so that longer walks would be quadratic.
WALK = 256


def _bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)``, with the value worked out once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _placed(turns: Column, before: bool) -> Column:
    """The spans of every second piece that is not empty."""
    empty = no_spans()

    def step(acc: Column, p: Column) -> Column:
        end = acc["at"] + F.length(p)
        span = F.array(F.struct(acc["at"].alias("start"), end.alias("end"), p.alias("found")))
        return F.struct(end.alias("at"), (~acc["inside"]).alias("inside"), F.when(acc["inside"] & (p != ""), F.concat(acc["out"], span)).otherwise(acc["out"]).alias("out"))

    def walk(pieces: Column, at: Column) -> Column:
        return F.aggregate(pieces, F.struct(at.alias("at"), F.lit(False).alias("inside"), empty.alias("out")), step, lambda acc: acc["out"])

    def walks(parts: Column) -> Column:
        sizes = F.transform(parts, lambda p: F.aggregate(p, F.lit(0), lambda n, x: n + F.length(x)))
        begin = F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<int>)").alias("out"))
        starts = F.aggregate(sizes, begin, lambda acc, n: F.struct((acc["at"] + n).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out")), lambda acc: acc["out"])
        return F.flatten(F.zip_with(parts, starts, walk))

    parts = F.transform(F.sequence(F.lit(0), F.floor((F.size(turns) - 1) / WALK).cast("int")), lambda c: F.slice(turns, c * WALK + 1, WALK))
    out = _bound(parts, walks)
    if not before:
        return out
    piece = lambda i: F.coalesce(F.get(turns, i), F.lit(""))
    told = lambda s, k: F.struct(*(s[c].alias(c) for c in ("start", "end", "found")), F.concat(*(piece(2 * k - d) for d in (3, 2, 1, 0))).alias("before"))
    return F.transform(out, told)


def find(text: Column, pattern: str, ok: Callable[[Column], Column] | None = None, *, before: bool = False) -> Column:
    """(start, end, found) of the leftmost non-overlapping matches, in code points, end exclusive.

    One pass marks both ends of every match, so that a split at the marks gives the text between
    matches and the matches by turns, and running sums of the lengths give the places, in time
    that grows with the matches. ``ok`` drops matches afterwards, without another try inside them.
    ``before``: what stands before each match as well, back to the second last match. For patterns
    that never match nothing."""
    marked = F.split(F.regexp_replace(text, pattern, f"{MARK}$0{MARK}"), MARK, -1)
    between = F.split(text, pattern, -1)
    matches = F.concat(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.array(F.lit("")))
    by_turns = F.flatten(F.zip_with(between, matches, lambda a, b: F.array(a, b)))
    turns = F.when(F.contains(text, F.lit(MARK)), by_turns).otherwise(marked)
    none = F.expr("cast(array() as array<struct<start:int,end:int,found:string,before:string>>)") if before else no_spans()
    found = F.when(text.rlike(pattern), _bound(turns, lambda t: _placed(t, before))).otherwise(none)
    return found if ok is None else F.filter(found, lambda s: ok(s["found"]))


def joined(kinds: Iterable[tuple[str, Column]]) -> Column:
    """kind:start:end of all spans by start, then kind as listed, comma-joined."""

    def tagged(n: int, kind: str, spans: Column) -> Column:
        return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.lit(n).alias("n"), s["end"].alias("end"), F.lit(kind).alias("kind")))

    every = F.concat(*(tagged(n, *pair) for n, pair in enumerate(kinds)))
    return F.array_join(F.transform(F.sort_array(every), lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
