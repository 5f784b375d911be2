"""P-Score: percent excess over the historical weekly median."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import config as C
from ..config import RATE, SCOPE, WEEK, YEAR, Config
from ..functions.numeric import stable
from .rates import baseline_years

CURRENT = "current_rate"


def pscore(series: DataFrame, cfg: Config, year: Column) -> DataFrame:
    """J12 per scope: baseline median per week (not interpolated; weeks without
    baseline are absent), the year's rate, ((cur - med) / med) * 100 and the
    label by the sign of cur - med.  Over a zero median the score has no finite
    value and is NULL, while demand there is an excess by its label.  Scopes
    without rows in the evaluated year give no rows.  Values unrounded."""
    base = (baseline_years(series, cfg).groupBy(SCOPE, WEEK)
            .agg(F.median(RATE).alias("q2_hist")))
    cur = (series.where(F.col(YEAR) == year)
           .select(SCOPE, WEEK, F.col(RATE).alias(CURRENT)))
    df = base.join(cur, [SCOPE, WEEK], "left")
    p = (F.col(CURRENT) - F.col("q2_hist")) / F.nullif(F.col("q2_hist"), F.lit(0.0)) * F.lit(100.0)
    # scopes with rows in the evaluated year; an inner join with the distinct
    # list (equivalent to a semi join) stays an equi-join on scope
    has_year = series.where(F.col(YEAR) == year).select(SCOPE).distinct()
    return (df.join(has_year, SCOPE, "inner")
            .withColumn("p_score", p)
            .withColumn("kind", F.when(F.col(CURRENT) > F.col("q2_hist"), F.lit(C.PSCORE_EXCESS))
                        .otherwise(F.lit(C.PSCORE_DEFICIT))))


def unbounded(current: Column, median: Column) -> Column:
    """Demand in a week whose historical median is zero: an excess without
    finite score, above every band."""
    return (median == 0) & (current > 0)


def severity(peak: Column) -> Column:
    out = None
    for threshold, label in C.SEVERITY_BANDS:
        out = (F.when(peak > threshold, F.lit(label)) if out is None
               else out.when(peak > threshold, F.lit(label)))
    return out.otherwise(F.lit(C.SEVERITY_NORMAL))


def pscore_summary(ps: DataFrame) -> DataFrame:
    """J13 per scope over weeks with a score or with demand over a zero median:
    the greatest finite score, the peak week (first on ties; a week over a zero
    median comes before all others), mean of the positive finite scores (0 when
    none), the number of weeks over a zero median, and the severity band (the
    highest when there is such a week)."""
    beyond = F.coalesce(unbounded(F.col(CURRENT), F.col("q2_hist")), F.lit(False))
    valid = ps.where(F.col("p_score").isNotNull() | beyond)
    best = F.min(F.struct((~beyond).alias("finite"), (-F.col("p_score")).alias("n"), F.col(WEEK).alias("w")))
    avg_pos = F.coalesce(F.avg(F.when(F.col("p_score") > 0, F.col("p_score"))), F.lit(0.0))
    return (valid.groupBy(SCOPE)
            .agg(F.max("p_score").alias("peak_pscore"), best["w"].alias("peak_week"),
                 avg_pos.alias("mean_excess"), F.count_if(beyond).alias("zero_median_weeks"))
            .withColumn("severity", F.when(F.col("zero_median_weeks") > 0, F.lit(C.SEVERITY_BANDS[0][1]))
                        .otherwise(severity(F.col("peak_pscore"))))
            .withColumns({"peak_pscore": stable("peak_pscore"), "mean_excess": stable("mean_excess")}))


def round_pscore(ps: DataFrame) -> DataFrame:
    return ps.withColumns({c: stable(c) for c in ("q2_hist", CURRENT, "p_score")})

