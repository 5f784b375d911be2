"""Reshape operators: unpivot (C1, C2), week spine (C4), gap interpolation."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import AGE_GROUP, VISITS, WEEK
from ..functions.numeric import nan_to_null


def unpivot_ages(df: DataFrame, age_columns: Sequence[tuple[str, str]]) -> DataFrame:
    """Wide age-band counts -> one row per age group.

    Id columns are all other columns; the label comes from ``age_columns``;
    counts are filled with 0 where NULL or NaN and made integral.  The API form keeps rows
    whose count is NULL (SQL UNPIVOT would drop them).
    """
    present = [(c, lab) for c, lab in age_columns if c in df.columns]
    if not present:
        raise ValueError("no age-band columns present in the feed")
    ids = [c for c in df.columns if c not in {c for c, _ in present}]
    floating = {c for c, t in df.dtypes if t in ("double", "float")}
    value_cols = [(nan_to_null(c) if c in floating else F.col(c)).cast("bigint").alias(c) for c, _ in present]
    long_df = df.select(*ids, *value_cols).unpivot(ids, [c for c, _ in present], "_band", "_count")
    label = F.create_map(*[F.lit(x) for pair in present for x in pair])[F.col("_band")]
    return (long_df
            .withColumn(VISITS, F.coalesce(F.col("_count"), F.lit(0)).cast("bigint"))
            .withColumn(AGE_GROUP, label)
            .drop("_band", "_count"))


def week_spine(keys: DataFrame, first: int = 1, last: int = 53) -> DataFrame:
    """Every key row repeated for weeks first..last (C4): an explode, no join."""
    return keys.select(*keys.columns, F.explode(F.sequence(F.lit(first), F.lit(last))).alias(WEEK))


def interpolate_linear(col: str, partition: Iterable[str], order: str = WEEK) -> Column:
    """Linear gap filling over ordered rows.

    Leading gaps stay NULL and trailing gaps repeat the last known value
    (pandas ``interpolate(method='linear')``).  Positions are the ``order``
    values, which equal row positions on a dense spine.
    """
    parts = list(partition)
    before = Window.partitionBy(*parts).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    after = Window.partitionBy(*parts).orderBy(order).rowsBetween(0, Window.unboundedFollowing)
    x = F.col(col)
    known_pos = F.when(x.isNotNull(), F.col(order))
    prev_v = F.last(x, ignorenulls=True).over(before)
    prev_p = F.last(known_pos, ignorenulls=True).over(before)
    next_v = F.first(x, ignorenulls=True).over(after)
    next_p = F.first(known_pos, ignorenulls=True).over(after)
    slope = (next_v - prev_v) / (next_p - prev_p).cast("double")
    blend = slope * (F.col(order) - prev_p).cast("double") + prev_v
    return (F.when(x.isNotNull(), x)
            .when(prev_v.isNull(), F.lit(None).cast("double"))
            .when(next_v.isNull(), prev_v)
            .otherwise(blend))
