"""Small numeric column expressions shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def inv_var(err: Column, floor: float = 1e-8) -> Column:
    return 1.0 / F.pow(F.greatest(err, F.lit(floor)), F.lit(2.0))


def finite(c: Column) -> Column:
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))


def no_nan(c: Column) -> Column:
    """NaN to NULL: in Spark NaN > x is true, so NaN must not reach a predicate."""
    return F.when(~F.isnan(c), c)


def rnd(c: Column, digits: int) -> Column:
    """Rounded, with negative zero folded into zero."""
    return F.round(c, digits) + F.lit(0.0)


def safe_div(a: Column, b: Column) -> Column:
    return F.try_divide(a, b)


def fence(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Adds a column that later filters are not rewritten into.

    Spark pushes a filter on a derived column below the projections that derive it by
    repeating their expressions; for deeply staged parsing that repeats them many times
    over. A one-element generator keeps rows and values and stops the rewrite.
    """
    return df.withColumn(name, F.explode_outer(F.array(value)))
