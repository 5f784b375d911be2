"""Mergeable rate cubes: small tables that answer rankings, profiles and KPIs.

A mean of row rates is a sum of hundredths over a count, and both add up, as
visits do. Two tables hold (rate_sum, rate_rows, visits): by place (year, week,
area, facility, care level, age group) and by cause (year, week, area, care
level, cause, age group). Every ranking, profile and KPI rolls up from one of
them, exactly (the sums are integers), so none scans the fact. Each is smaller
than the fact by the dimension it leaves out. Parts of a fact (years) have
cubes that can be set side by side.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import AGE_GROUP, AREA, CARE_LEVEL, CAUSE, FACILITY, RATE, VISITS, WEEK, YEAR
from ..functions.numeric import cents

RATE_SUM, RATE_ROWS = "rate_sum", "rate_rows"
PLACE_KEYS = (YEAR, WEEK, AREA, FACILITY, CARE_LEVEL, AGE_GROUP)
CAUSE_KEYS = (YEAR, WEEK, AREA, CARE_LEVEL, CAUSE, AGE_GROUP)


def rate_parts(df: DataFrame) -> list[Column]:
    """The mergeable parts, summed over rows of a fact or of a cube."""
    if RATE_SUM in df.columns:
        total, rows = F.sum(RATE_SUM), F.sum(RATE_ROWS)
    else:
        total, rows = F.sum(cents(RATE)), F.count(RATE)
    return [total.alias(RATE_SUM), rows.alias(RATE_ROWS)]


def mean_rate(total: Column | None = None, rows: Column | None = None) -> Column:
    """The mean of row rates from its parts; none of no rows."""
    total, rows = (F.col(RATE_SUM) if total is None else total), (F.col(RATE_ROWS) if rows is None else rows)
    return total.cast("double") / F.lit(100.0) / F.nullif(rows, F.lit(0))


def rate_cube(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``df`` (an analysed fact, or a cube of more keys) rolled up to ``keys``."""
    return df.groupBy(*keys).agg(*rate_parts(df), F.sum(VISITS).alias(VISITS))
