"""Column helpers of the transaction operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def flag(condition: Column) -> Column:
    """1 or 0; null counts as 0."""
    return F.coalesce(condition, F.lit(False)).cast("int")


def clip(x: str | Column, low: float, high: float) -> Column:
    return F.when(col(x).isNotNull(), F.least(F.greatest(col(x), F.lit(low)), F.lit(high)))


def smoothed(total: Column, n: Column, prior: Column, weight: float) -> Column:
    return (total + weight * prior) / (n + weight)


def finite_or_zero(x: str | Column) -> Column:
    x = col(x)
    return F.when(x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")), 0.0).otherwise(x)


def draw(key: str, salt: str) -> Column:
    """A number below 2**32 from the md5 of a key, the same on every run."""
    return F.conv(F.substring(F.md5(F.concat(F.col(key).cast("string"), F.lit(salt))), 1, 8), 16, 10).cast("long")
