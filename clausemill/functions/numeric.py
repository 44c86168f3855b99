"""Numeric expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def nearest_rank(values: Column, p: float) -> Column:
    """Quantile of an array of non-null values at index round-half-even(p n + 0.5), kept within the array; null for none."""
    n = F.size(values)
    at = F.least(n, F.greatest(F.lit(1), F.bround(F.lit(p) * n + F.lit(0.5)).cast("int")))
    return F.when(n > 0, F.element_at(F.array_sort(values), at))


def share(part: Column, whole: Column) -> Column:
    """part / whole as double; null where the whole is 0."""
    return F.when(whole > 0, part.cast("double") / whole.cast("double"))
