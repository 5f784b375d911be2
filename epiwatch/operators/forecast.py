"""Harmonic-regression forecast per series.

Series are (scope[, cause target]) x target year, all fitted in one job.  The
training rows of a target year T are the series' weekly pooled rates of the
years before T outside the excluded years, with a rate; the model is
``rate ~ 1 + t + sin(2 pi t/P) + cos(2 pi t/P) + sin(4 pi t/P) + cos(4 pi t/P)``
with ``t = (year - base_year) * P + week``, weighted 5 for recent years.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import config as C
from ..config import RATE, WEEK, YEAR, Config
from ..functions.numeric import clip_lower, stable
from .wls import wls_fit

TARGET_YEAR = "target_year"
FEATURES = ("intercept", "t", "sin1", "cos1", "sin2", "cos2")


def harmonic_columns(year: Column, week: Column, cfg: Config) -> dict[str, Column]:
    """Time index and the two harmonics (period ``cfg.period`` weeks)."""
    t = (year - F.lit(cfg.base_year)).cast("double") * F.lit(cfg.period) + week.cast("double")
    a1 = F.lit(2 * math.pi) * t / F.lit(cfg.period)
    a2 = F.lit(4 * math.pi) * t / F.lit(cfg.period)
    return {"intercept": F.lit(1.0), "t": t, "sin1": F.sin(a1), "cos1": F.cos(a1),
            "sin2": F.sin(a2), "cos2": F.cos(a2)}


def regime_weight(year: Column, cfg: Config) -> Column:
    """Recent years weigh ``recent_weight``, older ones ``base_weight``."""
    return F.when(year >= F.lit(cfg.recent_year), F.lit(cfg.recent_weight)).otherwise(F.lit(cfg.base_weight))


def training_rows(series: DataFrame, keys: Sequence[str], cfg: Config) -> DataFrame:
    """B17 + B19 for every target year: each row is repeated for the target
    years it trains (an array filter + explode; no join)."""
    if not cfg.target_years:
        raise ValueError("no target years configured for the forecast")
    targets = F.array(*[F.lit(int(t)) for t in cfg.target_years])
    applies = F.filter(targets, lambda t: F.col(YEAR) < t)
    return (series.where(~F.col(YEAR).isin(list(cfg.excluded_years)) & F.col(RATE).isNotNull())
            .select(*keys, F.explode(applies).alias(TARGET_YEAR), YEAR, WEEK, RATE))


def harmonic_features(train: DataFrame, keys: Sequence[str], cfg: Config) -> DataFrame:
    h = harmonic_columns(F.col(YEAR), F.col(WEEK), cfg)
    return train.select(*keys, TARGET_YEAR, YEAR, WEEK, RATE,
                        *[h[n].alias(n) for n in FEATURES],
                        regime_weight(F.col(YEAR), cfg).alias("weight"))


def threshold_q3(series: DataFrame, train: DataFrame, keys: Sequence[str], cfg: Config) -> DataFrame:
    """E5: weekly Q3 of the training rates (default) or of the baseline years."""
    src = train
    if cfg.threshold_years == "baseline":
        lo, hi = cfg.baseline_years
        src = (series.where(F.col(YEAR).between(lo, hi) & F.col(RATE).isNotNull())
               .join(train.select(*keys, TARGET_YEAR).distinct(), list(keys)))
    elif cfg.threshold_years != "training":
        raise ValueError(f"unknown threshold_years {cfg.threshold_years!r}")
    return (src.groupBy(*keys, TARGET_YEAR, WEEK)
            .agg(F.percentile(F.col(RATE), F.lit(0.75)).alias("q3")))


def forecast(series: DataFrame, keys: Sequence[str], cfg: Config) -> DataFrame:
    """52 projected weeks per series and target year, with the
    Q3 threshold, the observed rate of the target year and the exceedance flag.
    Values unrounded."""
    keys = list(keys)
    train = training_rows(series, keys, cfg)
    feats = harmonic_features(train, keys, cfg)
    fit_in = feats.select(*keys, TARGET_YEAR, WEEK, *FEATURES,
                          F.col(RATE).alias("y"), F.col("weight").alias("w"), F.lit(False).alias("future"))
    spine = (train.select(*keys, TARGET_YEAR).distinct()
             .select(*keys, TARGET_YEAR,
                     F.explode(F.sequence(F.lit(1), F.lit(C.FORECAST_WEEKS))).alias(WEEK)))
    h = harmonic_columns(F.col(TARGET_YEAR), F.col(WEEK), cfg)
    future = spine.select(*keys, TARGET_YEAR, WEEK, *[h[n].alias(n) for n in FEATURES],
                          F.lit(None).cast("double").alias("y"), F.lit(0.0).alias("w"),
                          F.lit(True).alias("future"))
    fitted = wls_fit(fit_in.unionByName(future), keys + [TARGET_YEAR], FEATURES)
    proj = (fitted.where(F.col("future"))
            .select(*keys, TARGET_YEAR, WEEK, clip_lower(F.col("fit"), 0.0).alias("projected")))
    q3 = threshold_q3(series, train, keys, cfg)
    real = series.select(*keys, F.col(YEAR).alias(TARGET_YEAR), WEEK, F.col(RATE).alias("real_rate"))
    out = (proj.join(q3, keys + [TARGET_YEAR, WEEK], "left")
           .join(real, keys + [TARGET_YEAR, WEEK], "left"))
    return out.withColumn("over_q3", F.coalesce(F.col("projected") > F.col("q3"), F.lit(False)))


def _eval_aggs() -> list[Column]:
    real, proj = F.col("real_rate"), F.col("projected")
    both = real.isNotNull() & proj.isNotNull()
    mae = F.avg(F.when(both, F.abs(proj - real)))
    mape = F.avg(F.when(both & (real > 0), F.abs(real - proj) / real)) * F.lit(100.0)
    return [mae.alias("mae"), mape.alias("mape"), F.count_if(both).alias("eval_weeks")]


def evaluation(fc: DataFrame, keys: Sequence[str]) -> DataFrame:
    """MAE over weeks with an observed rate, MAPE over those with rate > 0
    (percent); NULL when the target year has no data."""
    return fc.groupBy(*keys, TARGET_YEAR).agg(*_eval_aggs())


def quality_band(mape: Column) -> Column:
    out = F.when(mape.isNull(), F.lit(None).cast("string"))
    for limit, label in C.MAPE_BANDS:
        out = out.when(mape < limit, F.lit(label))
    return out.otherwise(F.lit(C.MAPE_POOR))


def kpis(fc: DataFrame, keys: Sequence[str]) -> DataFrame:
    """J5, J6, J9 + J8 per series: peak week (first on ties), peak rate, weeks
    over Q3, MAE, MAPE, model quality band and the risk flag."""
    keys = list(keys)
    best = F.min(F.struct((-F.col("projected")).alias("n"), F.col(WEEK).alias("w")))
    out = (fc.groupBy(*keys, TARGET_YEAR)
           .agg(best["w"].alias("peak_week"), F.max("projected").alias("peak_rate"),
                F.count_if(F.col("over_q3")).alias("weeks_over_q3"), *_eval_aggs()))
    return (out.withColumn("quality", quality_band(F.col("mape")))
            .withColumn("epidemic_risk", F.col("weeks_over_q3") > 0)
            .withColumns({c: stable(c) for c in ("peak_rate", "mae", "mape")}))


def round_forecast(fc: DataFrame) -> DataFrame:
    return fc.withColumns({c: stable(c) for c in ("projected", "q3", "real_rate")})
