"""Registry of named queries over a folder of test tables.

Each query is ``fn(spark, sf_dir) -> DataFrame``.  Analytic queries scan the
published master (ETL run once per input fingerprint, see sources.landing);
ETL-stage queries are lazy plans over the landed feed and population.
Selections use the dashboard defaults: the evaluated year, weeks 1-52, the
first area / age group in sorted order where one must be chosen.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import config as C
from ..config import (AGE_GROUP, AREA, CARE_LEVEL, CAUSE, FACILITY, FACILITY_TYPE, GLOBAL_SCOPE,
                      POPULATION, RATE, SCOPE, VISITS, WEEK, YEAR, Config, driver_defaults)
from ..functions.classify import recode_cause
from ..functions.numeric import clip_lower, exact_mean_2dp, round_half_even, safe_div, stable
from ..functions.text import blank_to_null, contains_ci, head_before, is_blank, replace_all, utrim
from ..operators import channel, forecast, joins, pscore, rankings, trend
from ..operators.clean import (blanks_to_null, clean_feed, exclude_causes, filter_service,
                               fix_spelling, standardise_feed)
from ..operators.rates import TARGET, baseline_years, eval_year, matched_targets, select_scope
from ..operators.reshape import interpolate_linear
from ..sources import landing
from ..sources.parquet import MissingInputError
from ..sources.refresh import publish, read_current
from ..sources.store import checkpoint_root, clear_cache, unsorted_write
from .etl import build_master, joined, long_visits, normalise_population, run_pipeline

CFG: Config = driver_defaults()
#: A year of 53 weeks, for the variants over whole years; target years of the variant with several.
WHOLE_YEAR = 1998
SEVERAL_TARGETS = (2001, 2000, 1998)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(fn=None, *, name: str | None = None):
    """Register ``fn`` under its own name (or ``name``)."""
    def register(f):
        QUERIES[name or f.__name__] = f
        return f
    return register(fn) if fn is not None else register


# -- shared inputs -----------------------------------------------------------

def _raw(spark, d):
    return landing.raw_feed(spark, d)


def _pop(spark, d):
    return landing.population(spark, d)


def _m(spark, d):
    return landing.analysed(spark, d, CFG)


def _places(spark, d):
    return landing.place_cube(spark, d, CFG)


def _causes(spark, d):
    return landing.cause_rate_cube(spark, d, CFG)


def _year(m):
    return eval_year(m, CFG)


def _series_year(spark, d):
    """Evaluated year for series-based queries: the configured one, else the
    latest year of the small weekly cube (no fact-table scan)."""
    return eval_year(landing.weekly_series(spark, d, CFG), CFG)


def _series(spark, d, by_target=False):
    return landing.weekly_series(spark, d, CFG, by_target)


def _first_area(spark, d):
    """First territory in sorted order (the selector default), read from the
    small weekly cube instead of scanning the fact table."""
    return (landing.weekly_series(spark, d, CFG).where(F.col(SCOPE) != GLOBAL_SCOPE)
            .select(F.min(SCOPE)).scalar())


def _first_age_group():
    """First age group in sorted order among the configured bands."""
    return sorted(label for _, label in CFG.age_columns)[0]


# -- ETL stage (B1-B10, C1, D1-D3, E3, J19) -----------------------------------

@query
def clean_rows(spark, d):
    return clean_feed(_raw(spark, d), CFG)


@query
def excluded_labels(spark, d):
    return exclude_causes(filter_service(standardise_feed(_raw(spark, d)), CFG.service), CFG.excluded_causes)


@query
def spelling_fix(spark, d):
    df = filter_service(standardise_feed(_raw(spark, d)), CFG.service)
    df = fix_spelling(exclude_causes(df, CFG.excluded_causes), CFG.spelling, CFG.spelling_columns)
    return df.groupBy(C.REGION, AREA, FACILITY).agg(F.count(F.lit(1)).alias("rows"))


@query
def unpivot_ages(spark, d):
    return long_visits(_raw(spark, d), CFG)


@query
def pop_join(spark, d):
    return joined(_raw(spark, d), _pop(spark, d), CFG)


@query
def population_in_feed(spark, d):
    return joins.restrict_population(normalise_population(_pop(spark, d)), long_visits(_raw(spark, d), CFG))


@query
def area_coverage(spark, d):
    return joins.area_coverage(long_visits(_raw(spark, d), CFG), normalise_population(_pop(spark, d)))


@query(name="orphan_audit")
def orphan_audit_rows(spark, d):
    return joins.orphan_audit(joined(_raw(spark, d), _pop(spark, d), CFG))


@query
def row_rate(spark, d):
    return landing.master(spark, d, CFG)


@query
def master_summary(spark, d):
    return _summary(landing.master(spark, d, CFG))


def _summary(m):
    return (m.groupBy(YEAR)
            .agg(F.count(F.lit(1)).alias("rows"), F.sum(VISITS).alias(VISITS),
                 F.sum(POPULATION).alias(POPULATION),
                 F.count_if(F.col(POPULATION) == 0).alias("zero_population_rows"),
                 stable(exact_mean_2dp(RATE)).alias("mean_rate")))


@query
def nan_population_rates(spark, d):
    """Rates where some populations are NaN: they count as missing."""
    hole = (F.col(AGE_GROUP) == "BUILDING") & (F.col(YEAR) % 2 == 0)
    pop = _pop(spark, d).withColumn(POPULATION, F.when(hole, F.lit(float("nan"))).otherwise(F.col(POPULATION).cast("double")))
    return (build_master(_raw(spark, d), pop, CFG).groupBy(YEAR, AGE_GROUP)
            .agg(F.count(F.lit(1)).alias("rows"), F.count_if(F.col(POPULATION) == 0).alias("zero_population_rows"),
                 stable(exact_mean_2dp(RATE)).alias("mean_rate")))


@query
def refresh_roundtrip(spark, d):
    """The landed feed under its source column names
    and with administrative columns goes through the whole pipeline and is
    published; a snapshot without rows and a missing feed are refused; the
    published master is read back."""
    root = f"{checkpoint_root(spark)}/epiwatch/refresh-{uuid.uuid4().hex[:12]}"
    admin = {c: F.lit("x") for c in C.FEED_DROP_COLUMNS}
    source = {engine: name for name, engine in C.FEED_COLUMNS.items()}
    with unsorted_write(spark):  # the landed feed is by year
        _raw(spark, d).withColumnsRenamed(source).withColumns(admin).write.partitionBy(source[YEAR]).parquet(f"{root}/feed")
    _pop(spark, d).withColumnsRenamed({AREA: "ComunaGlosa", YEAR: "anio", AGE_GROUP: "grupo_etario", POPULATION: "poblacion"}
                                      ).write.parquet(f"{root}/population")
    cfg = CFG.with_(drop_columns=C.FEED_DROP_COLUMNS)
    ok, _, _ = run_pipeline(spark, f"{root}/feed", f"{root}/population", f"{root}/master", cfg)
    bad, _ = publish(spark, f"{root}/master", lambda p: read_current(spark, f"{root}/master").limit(0).write.parquet(p))
    try:
        run_pipeline(spark, f"{root}/absent", f"{root}/population", f"{root}/master", cfg)
        missing = False
    except MissingInputError:
        missing = True
    clear_cache(spark)
    m = read_current(spark, f"{root}/master")
    left = sum(c in m.columns for c in C.FEED_DROP_COLUMNS)
    return _summary(m).select(F.lit(ok).alias("published"), F.lit(not bad).alias("bad_refused"),
                              F.lit(missing).alias("missing_refused"), F.lit(left).alias("admin_columns"), "*")


# -- load-time classification (B11, B12, B21) ----------------------------------

@query
def cause_recode(spark, d):
    m = landing.master(spark, d, CFG)
    return (m.groupBy(F.col(CAUSE).alias("cause_raw"), recode_cause(CAUSE, CFG).alias(CAUSE))
            .agg(F.count(F.lit(1)).alias("rows")))


@query
def cause_drift(spark, d):
    """Feed-drift audit: trimmed cause labels without a recode entry (kept
    as they are by the recode, reported here) with their row and visit counts."""
    m = landing.master(spark, d, CFG)
    known = [k for k, _ in CFG.cause_labels]
    label = utrim(CAUSE)
    return (m.where(~label.isin(known) if known else F.lit(True))
            .groupBy(label.alias("cause"))
            .agg(F.count(F.lit(1)).alias("rows"), F.sum(VISITS).alias(VISITS)))


@query
def care_level(spark, d):
    return _m(spark, d).groupBy(FACILITY_TYPE, CARE_LEVEL).agg(F.count(F.lit(1)).alias("rows"))


@query
def selector_values(spark, d):
    return rankings.selectors(_places(spark, d))


# -- rankings and profiles -------------------------------------------------------

@query
def top_areas(spark, d):
    m = _places(spark, d)
    return rankings.top_areas(m, CFG, _year(m))


@query
def top5_causes(spark, d):
    m = _causes(spark, d)
    return rankings.top_causes(m, CFG, _year(m))


@query
def top10_facilities(spark, d):
    m = _places(spark, d)
    return rankings.top_facilities(m, CFG, _year(m))


@query
def top10_facilities_by_age(spark, d):
    m = _places(spark, d)
    return rankings.top_facilities_by_visits(m, CFG, _year(m), _first_age_group())


@query
def facility_ranking(spark, d):
    m = _places(spark, d)
    return rankings.facility_ranking(m, CFG, _year(m), _first_area(spark, d))


@query
def area_share(spark, d):
    m = _places(spark, d)
    return rankings.area_share(m, CFG, _year(m))


@query
def trend_by_level(spark, d):
    m = _places(spark, d)
    return rankings.week_mean_by(m, CFG, _year(m), CARE_LEVEL)


@query
def profile_age_level(spark, d):
    m = _places(spark, d)
    return rankings.profile_who(m, CFG, _year(m))


@query
def profile_cause_level(spark, d):
    m = _causes(spark, d)
    return rankings.cause_level_profile(m, CFG, _year(m))


@query
def facility_week(spark, d):
    m = _places(spark, d)
    return rankings.week_mean_by(m, CFG, _year(m), FACILITY, area=_first_area(spark, d))


@query
def area_week(spark, d):
    m = _places(spark, d)
    return rankings.week_mean_by(m, CFG, _year(m), AREA)


@query
def kpi_totals(spark, d):
    m = _places(spark, d)
    return rankings.kpi_totals(m, CFG, _year(m))


@query
def insights(spark, d):
    m = _causes(spark, d)
    return rankings.insights(m, CFG, _year(m))


@query
def overview_bundle(spark, d):
    m = _places(spark, d)
    return rankings.overview(m, _causes(spark, d), CFG, _year(m))


@query
def peak_area(spark, d):
    m = _places(spark, d)
    return rankings.peak_area(m, CFG, _year(m))


@query
def share_of_leading_cause(spark, d):
    m = _causes(spark, d)
    s = rankings.year_slice(m, _year(m), CFG.week_window)
    by_cause = rankings.visits_by(s, [CAUSE])
    total = rankings.total_of(by_cause)
    lead = rankings.arg_max(by_cause, VISITS, CAUSE).select(CAUSE).scalar()
    return by_cause.select(CAUSE, VISITS, F.lit(total).alias("total_visits"),
                           stable(safe_div(F.col(VISITS), F.lit(total)) * 100).alias("share_pct"),
                           (F.col(CAUSE) == lead).alias("is_leading"))


# The dashboard's default window is weeks 1-52 (Config.week_window); these are the
# same queries over a whole year of 53 weeks.

WHOLE = CFG.with_(week_window=(1, 53))


@query
def top_areas_whole_year(spark, d):
    return rankings.top_areas(_places(spark, d), WHOLE, F.lit(WHOLE_YEAR))


@query
def kpi_totals_whole_year(spark, d):
    return rankings.kpi_totals(_places(spark, d), WHOLE, F.lit(WHOLE_YEAR))


@query
def area_share_whole_year(spark, d):
    return rankings.area_share(_places(spark, d), WHOLE, F.lit(WHOLE_YEAR))


# -- weekly series, channel, zones --------------------------------------------

@query
def weekly_pooled_rate(spark, d):
    return rankings.rounded(_series(spark, d), RATE)


@query
def endemic_channel(spark, d):
    return channel.round_channel(channel.endemic_channel(_series(spark, d), CFG, _series_year(spark, d)))


@query
def zone_by_week(spark, d):
    return channel.zones(channel.endemic_channel(_series(spark, d), CFG, _series_year(spark, d)))


@query
def week_lookup(spark, d):
    z = channel.zones(channel.endemic_channel(_series(spark, d), CFG, _series_year(spark, d)), keep_last_week=True)
    return z.where(F.col(WEEK) == F.col("last_week")).drop("last_week")


@query
def interpolated_weeks(spark, d):
    raw = channel.channel_raw(_series(spark, d), CFG)
    return raw.select(SCOPE, WEEK, stable("q2").alias("q2_raw"),
                      stable(interpolate_linear("q2", [SCOPE])).alias("q2"))


@query
def baseline_slice(spark, d):
    return rankings.rounded(baseline_years(_series(spark, d), CFG), RATE)


@query
def peak_week(spark, d):
    cur = _series(spark, d).where(F.col(YEAR) == _series_year(spark, d))
    return rankings.rounded(rankings.arg_max(cur, RATE, WEEK, [SCOPE]).withColumnRenamed("max_" + RATE, RATE), RATE)


# -- P-Score -------------------------------------------------------------------

@query
def pscore_weekly(spark, d):
    return pscore.round_pscore(pscore.pscore(select_scope(_series(spark, d), GLOBAL_SCOPE), CFG, _series_year(spark, d)))


@query
def pscore_by_area(spark, d):
    return pscore.round_pscore(pscore.pscore(_series(spark, d), CFG, _series_year(spark, d)))


@query
def pscore_summary(spark, d):
    return pscore.pscore_summary(pscore.pscore(_series(spark, d), CFG, _series_year(spark, d)))


def _quiet_weeks(spark, d):
    """The weekly series with every fifth baseline week silent, so that some
    historical medians are zero."""
    lo, hi = CFG.baseline_years
    quiet = F.col(YEAR).between(lo, hi) & (F.col(WEEK) % 5 == 0)
    return _series(spark, d).withColumn(RATE, F.when(quiet, F.lit(0.0)).otherwise(F.col(RATE)))


@query
def pscore_zero_median(spark, d):
    return pscore.round_pscore(pscore.pscore(_quiet_weeks(spark, d), CFG, _series_year(spark, d)))


@query
def pscore_zero_median_summary(spark, d):
    return pscore.pscore_summary(pscore.pscore(_quiet_weeks(spark, d), CFG, _series_year(spark, d)))


# -- smoothed trend --------------------------------------------------------------

@query
def moving_average(spark, d):
    sm = trend.smoothed(_series(spark, d), _series_year(spark, d), CFG.smoothing_window)
    return sm.withColumns({C.RAW_SERIES: stable(C.RAW_SERIES), C.SMOOTH_SERIES: stable(C.SMOOTH_SERIES)})


@query
def moving_average_long(spark, d):
    return trend.smoothed_long(trend.smoothed(_series(spark, d), _series_year(spark, d), CFG.smoothing_window))


# -- forecast --------------------------------------------------------------------

@query
def harmonic_features(spark, d):
    s = _series(spark, d)
    feats = forecast.harmonic_features(forecast.training_rows(s, [SCOPE], CFG), [SCOPE], CFG)
    return feats.withColumns({c: stable(c) for c in (RATE, "t", "sin1", "cos1", "sin2", "cos2")})


@query
def training_slice(spark, d):
    s = _series(spark, d)
    return rankings.rounded(forecast.training_rows(s, [SCOPE], CFG), RATE)


def _forecasts(spark, d, by_target=False):
    return landing.forecasts(spark, d, CFG, by_target)


@query
def wls_forecast(spark, d):
    return forecast.round_forecast(select_scope(_forecasts(spark, d), GLOBAL_SCOPE))


@query
def forecast_by_area(spark, d):
    return forecast.round_forecast(_forecasts(spark, d))


@query
def forecast_exceedance(spark, d):
    fc = forecast.round_forecast(_forecasts(spark, d))
    return fc.select(SCOPE, forecast.TARGET_YEAR, WEEK, "projected", "q3", "over_q3")


@query
def forecast_eval(spark, d):
    ev = forecast.evaluation(_forecasts(spark, d), [SCOPE])
    return ev.withColumns({"mae": stable("mae"), "mape": stable("mape")})


@query
def forecast_kpis(spark, d):
    return forecast.kpis(_forecasts(spark, d), [SCOPE])


@query
def forecast_by_cause(spark, d):
    return forecast.round_forecast(_forecasts(spark, d, by_target=True))


@query
def forecast_cause_kpis(spark, d):
    return forecast.kpis(_forecasts(spark, d, by_target=True), [SCOPE, TARGET])


_SEVERAL = CFG.with_(target_years=SEVERAL_TARGETS)


@query
def forecast_several_targets(spark, d):
    return forecast.round_forecast(landing.forecasts(spark, d, _SEVERAL))


@query
def forecast_kpis_several_targets(spark, d):
    return forecast.kpis(landing.forecasts(spark, d, _SEVERAL), [SCOPE])


# -- filters and scalar functions ------------------------------------------------

@query
def filtered_slice(spark, d):
    m = _m(spark, d)
    s = rankings.year_slice(m, _year(m), CFG.week_window, area=_first_area(spark, d))
    return s.select(FACILITY, AREA, CAUSE, CARE_LEVEL, AGE_GROUP, YEAR, WEEK, VISITS, POPULATION, RATE)


@query
def cause_substring(spark, d):
    m = _m(spark, d)
    hits = m.select("*", F.explode(matched_targets(F.col(CAUSE), CFG.target_causes)).alias(TARGET))
    return hits.groupBy(TARGET, CAUSE).agg(F.count(F.lit(1)).alias("rows"), F.sum(VISITS).alias(VISITS))


@query
def null_audit(spark, d):
    df = blanks_to_null(filter_service(standardise_feed(_raw(spark, d)), CFG.service))
    return rankings.null_audit(df)


@query
def scalar_text(spark, d):
    raw = standardise_feed(_raw(spark, d))
    src = raw.select(CAUSE, FACILITY_TYPE, AREA).distinct()
    return src.select(
        F.col(CAUSE).alias("cause_raw"), F.col(FACILITY_TYPE).alias("type_raw"), F.col(AREA).alias("area_raw"),
        utrim(CAUSE).alias("cause_trim"), F.upper(utrim(CAUSE)).alias("cause_upper"),
        head_before(utrim(CAUSE), " (").alias("cause_head"),
        recode_cause(CAUSE, CFG).alias("cause_mapped"),
        contains_ci(CAUSE, "la").alias("cause_has_la"),
        is_blank(FACILITY_TYPE).alias("type_blank"),
        blank_to_null(FACILITY_TYPE).alias("type_or_null"),
        replace_all(utrim(AREA), CFG.spelling).alias("area_fixed"))


@query
def scalar_numeric(spark, d):
    s = select_scope(_series(spark, d), GLOBAL_SCOPE)
    r = F.col(RATE)
    a = F.lit(2 * math.pi) * F.col(WEEK).cast("double") / F.lit(C.WEEKS_PER_YEAR)
    return s.select(
        YEAR, WEEK, VISITS, POPULATION,
        stable(r).alias(RATE),
        round_half_even(r, 2).alias("rate_2dp"),
        stable(F.abs(r - F.lit(100.0))).alias("abs_dev_100"),
        stable(clip_lower(r - F.lit(100.0), 0.0)).alias("excess_over_100"),
        stable(F.sqrt(r)).alias("sqrt_rate"),
        stable(F.sin(a)).alias("sin_week"), stable(F.cos(a)).alias("cos_week"),
        stable(F.pi() * F.col(WEEK)).alias("pi_week"),
        F.concat(F.col(WEEK).cast("string"), F.lit(".5")).try_cast("double").alias("coerced"),
        F.concat(F.lit("n/a"), F.col(WEEK).cast("string")).try_cast("double").alias("coerced_bad"),
        F.nullif(F.col(POPULATION), F.lit(0.0)).isNull().alias("zero_population"),
        F.coalesce(F.col(RATE), F.lit(0.0)).alias("rate_or_zero"))


@query
def head_active_rows(spark, d):
    m = landing.master(spark, d, CFG)
    return rankings.head_rows(m, [AREA, YEAR, WEEK, FACILITY, CAUSE, AGE_GROUP], 5,
                              F.col(VISITS) > 0)

