"""Small numeric helpers shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def cents(x) -> Column:
    """Money amount -> integer cents.  Sums and quantiles over cents are exact
    and independent of partitioning, unlike floating sums of ``adr``."""
    c = F.col(x) if isinstance(x, str) else x
    return F.round(c * 100).cast("long")


def stable(x, digits: int = 9) -> Column:
    """Round statistics whose last bits depend on summation order
    (moments, correlations) and fold -0.0 into 0.0."""
    c = F.col(x) if isinstance(x, str) else x
    return F.round(c, digits) + F.lit(0.0)


def safe_div(a, b) -> Column:
    """a / b, null when b is 0 (Spark ANSI mode raises on x/0)."""
    return F.try_divide(a, b)
