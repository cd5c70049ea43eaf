"""Scalar functions on sequences (arrays of symbols) and posteriors (arrays of rows)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

AMINO_ACIDS = tuple("ACDEFGHIKLMNPQRSTVWY")


def symbols(text: Column) -> Column:
    """The characters of a string."""
    return F.filter(F.split(text, ""), lambda c: c != "")


def text_of(seq: Column) -> Column:
    return F.array_join(seq, "")


def gapped_text(seq: Column) -> Column:
    """Upper-case text in which every way to write a gap is '-'."""
    return F.upper(F.array_join(F.transform(seq, lambda s: F.when(F.lower(s).isin("gap", "-", "."), "-").otherwise(s)), ""))


def _guard(value: Column, ok: Column, message: str) -> Column:
    return F.when(ok, value).otherwise(F.raise_error(F.lit(message)))


def hamming(a: Column, b: Column) -> Column:
    """Places in which two sequences of one length differ."""
    n = F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("string") != y.cast("string")).cast("int")), F.lit(0), lambda s, x: s + x)
    return _guard(n, F.size(a) == F.size(b), "sequences of unequal length")


def euclidean(a: Column, b: Column) -> Column:
    square = F.zip_with(a, b, lambda x, y: (x - y) * (x - y))
    return _guard(F.sqrt(F.aggregate(square, F.lit(0.0), lambda s, x: s + x)), F.size(a) == F.size(b), "vectors of unequal length")


def one_hot(seq: Column, alphabet: Sequence[str]) -> Column:
    """A row of 0 and 1 per symbol; letter case and the ways to write a gap don't matter."""
    letters = F.array(*map(F.lit, map(_folded, alphabet)))
    known = F.forall(seq, lambda s: F.array_contains(letters, _folded_column(s)))
    rows = F.transform(seq, lambda s: F.transform(letters, lambda a: (a == _folded_column(s)).cast("double")))
    return _guard(rows, known, "symbol outside the alphabet")


def codes(seq: Column, alphabet: Sequence[str]) -> Column:
    """Each symbol's place in the alphabet, from 0."""
    letters = F.array(*map(F.lit, map(_folded, alphabet)))
    found = F.transform(seq, lambda s: (F.array_position(letters, _folded_column(s)) - 1).cast("int"))
    return _guard(found, F.forall(found, lambda c: c >= 0), "symbol outside the alphabet")


def from_codes(places: Column, alphabet: Sequence[str]) -> Column:
    letters = F.array(*map(F.lit, alphabet))
    ok = F.forall(places, lambda c: (c >= 0) & (c < len(alphabet)))
    return _guard(F.transform(places, lambda c: F.get(letters, c.cast("int"))), ok, "code outside the alphabet")


def from_one_hot(rows: Column, alphabet: Sequence[str]) -> Column:
    letters = F.array(*map(F.lit, alphabet))
    exact = F.forall(rows, lambda r: (F.size(F.filter(r, lambda x: x == 1.0)) == 1) & (F.size(F.filter(r, lambda x: x != 0.0)) == 1))
    return _guard(F.transform(rows, lambda r: F.get(letters, F.array_position(r, F.lit(1.0)).cast("int") - 1)), exact, "not a one-hot row")


def _folded(s: str) -> str:
    return "gap" if s.lower() in ("gap", "-", ".") else s.upper()


def _folded_column(s: Column) -> Column:
    return F.when(F.lower(s).isin("gap", "-", "."), "gap").otherwise(F.upper(s))


def mutate(seq: Column, changes: dict[int, str]) -> Column:
    """A copy with other symbols at some places."""
    return F.transform(seq, lambda s, i: F.coalesce(*(F.when(i == p, F.lit(v)) for p, v in changes.items()), s))


def bits(value: Column, length: int) -> Column:
    """The bits of an integer, most significant first."""
    return F.transform(F.sequence(F.lit(length - 1), F.lit(0), F.lit(-1)), lambda i: F.call_function("shiftright", value, i).bitwiseAND(F.lit(1)).cast("int")) if length else F.array()


def from_bits(seq: Column) -> Column:
    return F.aggregate(seq, F.lit(0).cast("long"), lambda a, b: a * 2 + b)


def composition(seq: Column, alphabet: Sequence[str] = AMINO_ACIDS) -> Column:
    """Shares of the alphabet's symbols; uniform where a sequence has none of them."""
    counts = [F.size(F.filter(seq, _is(a))) for a in alphabet]
    total = sum(counts[1:], counts[0])
    return F.array(*(F.when(total > 0, c / total).otherwise(1.0 / len(alphabet)) for c in counts))


def _is(letter: str):
    return lambda s: F.upper(s) == letter


def row_sums_ok(rows: Column, tolerance: float = 1e-8) -> Column:
    """Whether every row of a posterior is finite, non-negative and sums to 1."""
    return F.forall(rows, lambda r: (F.abs(F.aggregate(r, F.lit(0.0), lambda s, x: s + x) - 1) <= tolerance) & F.forall(r, lambda x: (x >= 0) & ~F.isnan(x)))


def most_likely(rows: Column) -> Column:
    return F.transform(rows, lambda r: F.array_max(r))


def hard_calls(rows: Column, alphabet: Sequence[str]) -> Column:
    """The first most likely symbol of each row."""
    letters = F.array(*map(F.lit, alphabet))
    return F.transform(rows, lambda r: F.get(letters, F.array_position(r, F.array_max(r)).cast("int") - 1))


def entropy(row: Column, base: float | None = None) -> Column:
    """Shannon entropy of one row, in nats or of a base; nothing counts as 0 log 0."""
    total = F.aggregate(row, F.lit(0.0), lambda s, p: s + F.when(p > 0, p * F.log(p)).otherwise(0.0))
    return -total if base is None else -total / F.log(F.lit(float(base)))


def with_gaps(rows: Column, gap: Column) -> Column:
    """Rows over the alphabet and a gap: p * (1 - gap), then gap."""
    return F.zip_with(rows, gap, lambda r, g: F.concat(F.transform(r, lambda p: p * (1 - g)), F.array(g)))


def without_gaps(rows: Column) -> Column:
    """Rows without their last (gap) entry, scaled up by what it held."""
    return F.transform(rows, lambda r: F.transform(F.slice(r, 1, F.size(r) - 1), lambda p: p / F.greatest(1 - F.element_at(r, -1), F.lit(1e-12))))
