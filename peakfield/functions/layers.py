"""Scalar functions on fitness layers: replicates, categories and probabilities."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def replicates(values: Column) -> Column:
    """Replicates as they are held: none at all is one NaN."""
    return F.when(F.size(values) > 0, values).otherwise(F.array(F.lit(float("nan"))))


def _total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, x: s + x)


def mean(values: Column) -> Column:
    """The mean of replicates; a NaN makes it NaN."""
    return _total(replicates(values)) / F.size(replicates(values))


def spread(values: Column) -> Column:
    """The population standard deviation of replicates."""
    around = lambda m: F.transform(replicates(values), lambda x: (x - m) * (x - m))
    # A lambda's argument is computed once; the mean itself would be, anew, for every replicate.
    square = F.get(F.transform(F.array(mean(values)), lambda m: _total(around(m))), F.lit(0))
    return F.sqrt(square / F.size(replicates(values)))


def padded(values: Column, width: int) -> Column:
    return F.concat(replicates(values), F.array_repeat(F.lit(float("nan")), F.lit(width) - F.size(replicates(values))))


def trimmed(values: Column) -> Column:
    """Without the NaNs at the end."""
    keep = F.array_max(F.transform(values, lambda x, i: F.when(F.isnan(x), 0).otherwise(i + 1)))
    return F.slice(values, 1, F.coalesce(keep, F.lit(0)))


def rank(value: Column, categories: Sequence[str]) -> Column:
    """A category's place in their order, from 0; null outside."""
    place = F.array_position(F.array(*map(F.lit, categories)), value)
    return F.when(place > 0, place - 1).cast("int")


def likeliest(p: Column) -> Column:
    """The place of the first greatest probability."""
    return (F.array_position(p, F.array_max(p)) - 1).cast("int")


def from_counts(counts: Column, alpha: float = 0.0) -> Column:
    """(counts + alpha) / sum; a row without mass raises."""
    up = F.transform(counts, lambda c: c + F.lit(float(alpha)))
    return F.when(_total(up) > 0, F.transform(up, lambda c: c / _total(up))).otherwise(F.raise_error(F.lit("counts without mass")))


def from_logits(z: Column) -> Column:
    e = F.transform(z, lambda x: F.exp(x - F.array_max(z)))
    return F.transform(e, lambda x: x / _total(e))


def checked(p: Column, tolerance: float = 1e-8) -> Column:
    ok = F.forall(p, lambda x: (x >= 0) & ~F.isnan(x)) & (F.abs(_total(p) - 1) <= tolerance)
    return F.when(ok, p).otherwise(F.raise_error(F.lit("not a probability distribution")))
