"""Numeric helpers: ANSI-safe division, half-even rounding, exact means."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import RATE_SCALE


def _c(col: Column | str) -> Column:
    return F.col(col) if isinstance(col, str) else col


def round_half_even(col: Column | str, digits: int) -> Column:
    """numpy ``round``: half-to-even on the scaled double (``rint(x*10^d)/10^d``)."""
    scale = float(10 ** digits)
    return F.rint(_c(col) * F.lit(scale)) / F.lit(scale)


def stable(col: Column | str, digits: int = 6) -> Column:
    """Final rounding of reported doubles so that results do not depend on
    the summation order chosen by the engine; ``+ 0.0`` folds -0.0 into 0.0."""
    return round_half_even(col, digits) + F.lit(0.0)


def nan_to_null(col: Column | str) -> Column:
    """A floating-point column with NaN as NULL, the only missing value here."""
    return F.when(~F.isnan(_c(col)), _c(col))


def safe_div(num: Column | str, den: Column | str) -> Column:
    """``num / nullif(den, 0)``: a zero denominator gives NULL, never an error."""
    return _c(num) / F.nullif(_c(den), F.lit(0))


def pooled_rate(visits_sum: Column | str, pop_sum: Column | str) -> Column:
    """Rate per 10,000 of summed visits over summed population (NULL if pop 0)."""
    return safe_div(visits_sum, pop_sum) * F.lit(RATE_SCALE)


def cents(col: Column | str) -> Column:
    """A 2-decimal value as an exact integer number of hundredths."""
    return F.rint(_c(col) * F.lit(100.0)).cast("bigint")


def exact_mean_2dp(col: Column | str) -> Column:
    """Mean of a 2-decimal double column, summed exactly as integer hundredths.

    The sum does not depend on row order, so the mean is bit-identical across
    partitionings (and equal to a DECIMAL(18,2) sum).  A bigint buffer keeps
    the aggregation in primitive, code-generated arithmetic.  NULLs are
    skipped; empty -> NULL.
    """
    c = _c(col)
    total = F.sum(cents(c)).cast("double") / F.lit(100.0)
    return total / F.nullif(F.count(c), F.lit(0))


def clip_lower(col: Column | str, floor: float = 0.0) -> Column:
    """``Series.clip(lower=floor)`` keeping NULL as NULL (greatest() would not)."""
    c = _c(col)
    return F.when(c.isNull(), F.lit(None).cast("double")).otherwise(F.greatest(c, F.lit(floor)))
