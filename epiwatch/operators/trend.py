"""Smoothed trend: centred moving average (F1), long form (C2), J14."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import config as C
from ..config import RATE, SCOPE, WEEK, YEAR
from ..functions.numeric import stable


def centred_mean(col: str, window: int, partition: list[str], order: str = WEEK) -> Column:
    """``rolling(window, center=True).mean()``: the frame is rows
    [i - window//2, i + (window-1)//2]; missing unless all ``window`` values exist."""
    w = (Window.partitionBy(*partition).orderBy(order)
         .rowsBetween(-(window // 2), (window - 1) // 2))
    return F.when(F.count(F.col(col)).over(w) == window, F.avg(F.col(col)).over(w))


def smoothed(series: DataFrame, year: Column, window: int) -> DataFrame:
    """J14 per scope for one year: raw pooled rate and its centred moving average
    over the weeks present (absent weeks are skipped, not zero-filled)."""
    if not 1 <= window:
        raise ValueError("window must be positive")
    s = series.where(F.col(YEAR) == year).select(SCOPE, WEEK, F.col(RATE).alias(C.RAW_SERIES))
    return s.withColumn(C.SMOOTH_SERIES, centred_mean(C.RAW_SERIES, window, [SCOPE]))


def smoothed_long(sm: DataFrame) -> DataFrame:
    """(scope, week, series, rate) with both series; NULLs kept."""
    return (sm.unpivot([SCOPE, WEEK], [C.RAW_SERIES, C.SMOOTH_SERIES], "series", RATE)
            .withColumn(RATE, stable(RATE)))
