"""Small numeric helpers used by the evaluation and quota reports."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .amounts import _as_col


def safe_div(numerator, denominator) -> Column:
    """Quotient as double, 0 when the denominator is not positive."""
    n, d = _as_col(numerator).cast("double"), _as_col(denominator).cast("double")
    return F.when(d > 0, F.try_divide(n, d)).otherwise(F.lit(0.0))


def f1(precision, recall) -> Column:
    p, r = _as_col(precision), _as_col(recall)
    return safe_div(F.lit(2.0) * p * r, p + r)


def capped_percent(used, limit) -> Column:
    """min(100, round(100 * used / limit)); unlimited (-1) -> 0."""
    share = F.round(safe_div(used, limit) * 100.0).cast("bigint")
    return F.when(_as_col(limit) == -1, F.lit(0).cast("bigint")).otherwise(
        F.least(F.lit(100).cast("bigint"), share)
    )
