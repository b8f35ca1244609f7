"""String similarity as column expressions."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


def lcs_length(a: Column, b: Column) -> Column:
    """Length of the longest common subsequence, one row of the table at a time."""
    left, right = F.split(a, ""), F.split(b, "")
    chars = lambda c: F.filter(c, lambda x: x != "")
    width = F.size(chars(right))
    start = F.transform(F.sequence(F.lit(0), width), lambda i: F.lit(0))

    def row(previous: Column, x: Column) -> Column:
        pairs = F.arrays_zip(F.slice(previous, 1, width).alias("diagonal"), F.slice(previous, 2, width).alias("up"), chars(right).alias("y"))
        return F.aggregate(
            pairs, F.array(F.lit(0)),
            lambda out, p: F.concat(out, F.array(F.when(p["y"] == x, p["diagonal"] + 1).otherwise(F.greatest(p["up"], F.element_at(out, -1))))),
        )

    return F.when(width == 0, 0).otherwise(F.element_at(F.aggregate(chars(left), start, row), -1))


def ratio(a: Column, b: Column) -> Column:
    """0 to 100: twice the longest common subsequence over both lengths; two empty strings are equal."""
    total = F.length(a) + F.length(b)
    return F.when(total == 0, 100.0).otherwise(200.0 * lcs_length(a, b) / total)


def _lcs(a: str, b: str) -> int:
    """Bit-parallel: one integer holds a whole row of the table."""
    places: dict[str, int] = {}
    for i, x in enumerate(a):
        places[x] = places.get(x, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for y in b:
        m = row & places.get(y, 0)
        row = ((row + m) | (row - m)) & full
    return len(a) - row.bit_count()


def lcs_ratio(a: str, b: str) -> float:
    """The same as ratio, for two strings at hand."""
    return 200.0 * _lcs(a, b) / (len(a) + len(b)) if a or b else 100.0


@F.pandas_udf(DoubleType())
def fast_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """The same as ratio, in Arrow batches: for more than a few pairs."""
    return pd.Series([None if x is None or y is None else lcs_ratio(x, y) for x, y in zip(a, b, strict=True)], dtype=float)


def may_reach(a: Column, b: Column, threshold: float) -> Column:
    """Whether the lengths alone allow a ratio of threshold; cheap, to be applied first."""
    return 200.0 * F.least(F.length(a), F.length(b)) >= threshold * (F.length(a) + F.length(b))
