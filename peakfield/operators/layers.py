"""Annotations and fitness layers: queries, attach policies, conversions and modifiers."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import layers as L
from ..functions.sequences import entropy

MISSING_VALUE, MISSING_NOTE = "__MISSING__", "__missing__"


def query(annotations: DataFrame, criteria: Mapping[str, object] | None = None) -> DataFrame:
    """Rows that meet every criterion: equality, or membership where a collection is given."""
    for column, want in (criteria or {}).items():
        if column not in annotations.columns:
            raise KeyError(column)
        c = F.col(f"`{column}`")
        annotations = annotations.where(c.isin(list(want)) if isinstance(want, (list, tuple, set, frozenset)) else c == F.lit(want))
    return annotations


def attach(rows: DataFrame, values: DataFrame, key: str, *, duplicates: str = "error", allow_missing: bool = False, fill: object = None) -> DataFrame:
    """rows LEFT JOIN values(key, value). Duplicate keys: error, first (by ``ord``), all (a list) or
    aggregate (the mean); a row without value raises unless allowed, and then takes ``fill``."""
    if duplicates == "error":
        if values.groupBy(key).count().where("count > 1").head(1):
            raise ValueError("several values for one key")
        one = values.select(key, "value")
    elif duplicates == "first":
        one = values.groupBy(key).agg(F.min_by("value", "ord").alias("value"))
    elif duplicates == "all":
        one = values.groupBy(key).agg(F.array_sort(F.collect_list("value")).alias("value"))
    elif duplicates == "aggregate":
        one = values.groupBy(key).agg(F.avg("value").alias("value"))
    else:
        raise ValueError("duplicates: error, first, all or aggregate")
    out = rows.join(one.withColumn("found", F.lit(True)), key, "left")
    if not allow_missing and out.where("found is null").head(1):
        raise ValueError("rows without a value")
    return out.withColumn("value", F.when(F.col("found"), F.col("value")).otherwise(F.lit(fill))).drop("found")


def missing_keys(rows: DataFrame, values: DataFrame, key: str) -> DataFrame:
    return rows.join(values, key, "left_anti")


def to_category(annotations: DataFrame, column: str, missing: str = MISSING_NOTE) -> DataFrame:
    return annotations.select("row_id", F.coalesce(F.col(column).cast("string"), F.lit(missing)).alias("value"))


def to_numeric(annotations: DataFrame, column: str) -> DataFrame:
    value = F.col(column).cast("double")
    return annotations.select("row_id", F.when(value.isNotNull(), value).otherwise(F.raise_error(F.lit("missing number"))).alias("value"))


def class_frequencies(nodes: DataFrame, categories: list[str], alpha: float = 0.0) -> DataFrame:
    """(block, p): the shares of categories in each block of nodes(block, category)."""
    counts = nodes.groupBy("block").agg(F.array(*(F.count_if(F.col("category") == c).cast("double") for c in categories)).alias("counts"))
    return counts.select("block", L.from_counts(F.col("counts"), alpha).alias("p"))


Modifier = Callable[[DataFrame], DataFrame]


def apply_modifier(layer: DataFrame, modifier: Modifier, taken: set[str] | None = None, name: str = "modified") -> tuple[str, DataFrame]:
    """A new layer under a name that is not taken yet."""
    n, base = 1, name
    while name in (taken or set()):
        name, n = f"{base}_{n}", n + 1
    return name, layer.transform(modifier)


def entropy_modifier(base: float | None = None) -> Modifier:
    return lambda layer: layer.withColumn("value", entropy(F.col("value"), base))


def slice_modifier(place: int) -> Modifier:
    """One category's probability."""
    return lambda layer: layer.withColumn("value", F.get("value", F.lit(place)))


def _normal(*keys: Column) -> Column:
    """A standard normal draw that depends on its keys alone, so that a task can be repeated."""
    u = [(F.pmod(F.xxhash64(*keys, F.lit(salt)), F.lit(1 << 40)) + 0.5) / float(1 << 40) for salt in (1, 2)]
    return F.sqrt(-2 * F.log(u[0])) * F.cos(2 * 3.141592653589793 * u[1])


def noise_modifier(scale: float, loc: float = 0.0, seed: int = 0) -> Modifier:
    """Normal noise on each replicate; NaN stays NaN."""
    return lambda layer: layer.withColumn("value", F.transform("value", lambda x, i: x + F.lit(loc) + F.lit(scale) * _normal(F.col("row_id"), i, F.lit(seed))))


def redraw_modifier(replicates: int, scale: float | None = None, seed: int = 0) -> Modifier:
    """Draws around the mean of the replicates, of their own spread unless a scale is given."""

    def run(layer: DataFrame) -> DataFrame:
        width = L.spread(F.col("value")) if scale is None else F.lit(scale)
        draws = F.transform(F.sequence(F.lit(1), F.lit(replicates)), lambda i: L.mean(F.col("value")) + width * _normal(F.col("row_id"), i, F.lit(seed)))
        return layer.withColumn("value", draws)

    return run


def arithmetic(layers: list[DataFrame], how: str) -> DataFrame:
    """Fold add, sub, mul or div over layers(row_id, value), from the left."""
    fold = {"add": lambda a, b: a + b, "sub": lambda a, b: a - b, "mul": lambda a, b: a * b, "div": lambda a, b: a / b}[how]
    out = layers[0].select("row_id", "value")
    for other in layers[1:]:
        out = out.join(other.select("row_id", F.col("value").alias("next")), "row_id").select("row_id", fold(F.col("value"), F.col("next")).alias("value"))
    return out


def moving_windows(rows: DataFrame, size: int, overlap: int) -> DataFrame:
    """(window, ord, ...): windows of ``size`` rows (ord from 0) that step by size - overlap, and a
    last one at the end if the others leave rows out."""
    if not 0 <= overlap < size:
        raise ValueError("overlap: from 0 to below the size")
    n, step = rows.count(), size - overlap
    starts = list(range(0, max(n - size, 0) + 1, step))
    tail = n > size and starts[-1] + size < n
    first = F.greatest(F.ceil((F.col("ord") - size + 1) / step), F.lit(0))
    last = F.least(F.floor(F.col("ord") / step), F.lit(len(starts) - 1))
    out = rows.where(first <= last).withColumn("window", F.explode(F.sequence(first, last))) if n else rows.withColumn("window", F.lit(0).cast("long"))
    return out.unionByName(rows.where(F.col("ord") >= n - size).withColumn("window", F.lit(len(starts)).cast("long"))) if tail else out
