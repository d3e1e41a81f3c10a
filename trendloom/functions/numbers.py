"""Numeric columns: ratios, ranks and vectors."""

from __future__ import annotations

from pyspark.sql import Column, WindowSpec
from pyspark.sql import functions as F


def ratio(current: Column, previous: Column) -> Column:
    """``current / previous``, by 1 where the previous value is 0."""
    return current / F.when(previous == 0, F.lit(1)).otherwise(previous)


def at_least(value: Column, least) -> Column:
    """Null stays null, unlike with ``greatest``."""
    return F.when(value.isNotNull(), F.greatest(value, F.lit(least)))


def at_most(value: Column, most) -> Column:
    return F.when(value.isNotNull(), F.least(value, most if isinstance(most, Column) else F.lit(most)))


def average_rank(value: Column, group: list[str], ordered: WindowSpec, whole: WindowSpec, tied: WindowSpec) -> Column:
    """Mean rank of ties over the number of values that aren't null, in (0, 1]; null for null."""
    return F.when(value.isNotNull(), (F.rank().over(ordered) + (F.count(F.lit(1)).over(tied) - 1) / 2) / F.count(value).over(whole))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def unit(vector: Column) -> Column:
    """The vector at length 1; null if it is zero."""
    norm = F.sqrt(dot(vector, vector))
    # A lambda's value is computed once; the plain expression would be computed again for each component.
    scaled = F.transform(F.array(norm), lambda n: F.transform(vector, lambda x: x / n))
    return F.when(norm > 0, F.get(scaled, 0))
