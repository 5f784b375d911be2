"""Endemic channel.

Works on the weekly pooled series of every scope at once.  Quartiles are exact
(``percentile``, linear interpolation) over the baseline years; each group
holds one value per baseline year, so the buffer is tiny.  All windows are
partitioned by scope and hold at most 53 rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import config as C
from ..config import RATE, SCOPE, WEEK, YEAR, Config
from ..functions.numeric import stable
from .rates import baseline_years
from .reshape import interpolate_linear, week_spine

CURRENT = "current_rate"


def quartiles(series: DataFrame, keys: list[str]) -> DataFrame:
    """Q1/Q2/Q3 of the rate per (keys, week) (E4, C3: array percentile + getItem)."""
    q = F.percentile(F.col(RATE), F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    return (series.groupBy(*keys, WEEK).agg(q.alias("_q"))
            .select(*keys, WEEK, *[F.col("_q")[i].alias(n) for i, n in enumerate(("q1", "q2", "q3"))]))


def channel_raw(series: DataFrame, cfg: Config) -> DataFrame:
    """Spine of weeks 1..53 per scope left-joined to baseline quartiles."""
    base = baseline_years(series, cfg)
    stats = quartiles(base, [SCOPE])
    spine = week_spine(base.select(SCOPE).distinct(), 1, 53)
    return spine.join(stats, [SCOPE, WEEK], "left")


def current_rates(series: DataFrame, year: Column) -> DataFrame:
    return (series.where(F.col(YEAR) == year)
            .select(SCOPE, WEEK, F.col(RATE).alias(CURRENT)))


def endemic_channel(series: DataFrame, cfg: Config, year: Column) -> DataFrame:
    """Interpolated channel plus the evaluated year's rate (D5) and the last
    observed week (J15, 1 when none).  Values unrounded."""
    raw = channel_raw(series, cfg)
    filled = raw.select(SCOPE, WEEK, *[interpolate_linear(q, [SCOPE]).alias(q) for q in ("q1", "q2", "q3")])
    chan = filled.join(current_rates(series, year), [SCOPE, WEEK], "left")
    w = Window.partitionBy(SCOPE)
    last = F.coalesce(F.max(F.when(F.col(CURRENT).isNotNull(), F.col(WEEK))).over(w), F.lit(1))
    return chan.withColumn("last_week", last)


def _fmt1(col: Column) -> Column:
    """One-decimal text of a number ('nan' when missing), as the insight shows it.

    ``format_number`` rounds half-even on the exact binary value, like Python's
    ``{:.1f}``; its digit grouping is removed."""
    return F.coalesce(F.regexp_replace(F.format_number(col, 1), ",", ""), F.lit("nan"))


def zone(val: Column, q1: Column, q2: Column, q3: Column) -> Column:
    """Strict '<' chain; a missing quartile never satisfies '<' (N5)."""
    return (F.when(val < q1, F.lit(C.ZONE_SUCCESS)).when(val < q2, F.lit(C.ZONE_SAFETY))
            .when(val < q3, F.lit(C.ZONE_ALARM)).otherwise(F.lit(C.ZONE_EPIDEMIC)))


def zones(chan: DataFrame, keep_last_week: bool = False) -> DataFrame:
    """J10 + F2 for every week with an observed rate: zone, insight, action and
    the week-over-week direction against week-1 of the dense spine."""
    val, q1, q2, q3 = (F.col(c) for c in (CURRENT, "q1", "q2", "q3"))
    prev = F.lag(val).over(Window.partitionBy(SCOPE).orderBy(WEEK))
    z = zone(val, q1, q2, q3)
    insight = (F.when(val < q1, F.lit(C.INSIGHT_SUCCESS)).when(val < q2, F.lit(C.INSIGHT_SAFETY))
               .when(val < q3, F.concat(F.lit(C.INSIGHT_ALARM.split("{}")[0]), _fmt1(q2),
                                        F.lit(C.INSIGHT_ALARM.split("{}")[1])))
               .otherwise(F.concat(F.lit(C.INSIGHT_EPIDEMIC.split("{}")[0]), _fmt1(q3),
                                   F.lit(C.INSIGHT_EPIDEMIC.split("{}")[1]))))
    action = (F.when(val < q1, F.lit(C.ACTION_SUCCESS)).when(val < q2, F.lit(C.ACTION_SAFETY))
              .when(val < q3, F.lit(C.ACTION_ALARM)).otherwise(F.lit(C.ACTION_EPIDEMIC)))
    trend = (F.when(prev.isNull(), F.lit(C.TREND_FLAT)).when(val > prev, F.lit(C.TREND_UP))
             .when(val < prev, F.lit(C.TREND_DOWN)).otherwise(F.lit(C.TREND_FLAT)))
    return (chan.withColumn("trend", trend)
            .where(val.isNotNull())
            .select(SCOPE, WEEK, stable(val).alias(CURRENT), stable(q1).alias("q1"),
                    stable(q2).alias("q2"), stable(q3).alias("q3"),
                    z.alias("zone"), insight.alias("insight"), action.alias("action"), "trend",
                    *(["last_week"] if keep_last_week else [])))


def round_channel(chan: DataFrame) -> DataFrame:
    return chan.withColumns({c: stable(c) for c in ("q1", "q2", "q3", CURRENT)})
