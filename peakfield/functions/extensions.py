"""Functions that built-in ones can't say: an aggregate over replicates and a table function."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T


@F.pandas_udf(T.DoubleType())
def trimmed_mean(values: pd.Series) -> float:
    """The mean of a group without its least and its greatest value; of two or fewer, of all."""
    x = values.dropna()
    return float("nan") if x.empty else float(x.mean() if len(x) <= 2 else (x.sum() - x.min() - x.max()) / (len(x) - 2))


@F.udtf(returnType=T.StructType([T.StructField("place", T.IntegerType()), T.StructField("piece", T.StringType())]))
class Pieces:
    """The pieces of ``width`` characters of a text, by where they start (from 0)."""

    def eval(self, text: str, width: int) -> Iterator[tuple[int, str]]:
        for i in range(len(text or "") - width + 1):
            yield i, text[i : i + width]
