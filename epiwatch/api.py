"""Public entry points: the analyses of the surveillance dashboard as functions.

Every function takes what was published (``load``) plus the selections the
dashboard offers as plain parameters and returns a DataFrame.  ``scope=None``
/ ``area=None`` / ``age=None`` mean "all" (an area may also be "Global", as in
the dashboard); a territory name restricts the result to that scope.  Nothing
is collected: results are lazy plans, and the per-scope analyses compute every
territory at once when no scope is given.

Series analyses (channel, zones, P-Score, trend, forecast) read the weekly
series published with the master; rankings, profiles, KPIs and insights read the
rate cubes. None scans fact rows. An analysed master may be passed instead of
what ``load`` returns; it is then aggregated on the spot.

    from epiwatch import api
    ok, msg, audit = api.run_etl(spark, "feed.parquet", "population.parquet", "/shared/master", cfg)
    m = api.load(spark, "/shared/master", cfg)
    api.ranking(m, cfg, "areas", year=2025).show()
    api.channel(m, cfg, year=2025, scope="Global").show()
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .config import (AGE_GROUP, AREA, CARE_LEVEL, CAUSE, FACILITY, GLOBAL_SCOPE, POPULATION, RATE, VISITS, WEEK,
                     YEAR, Config)
from .operators import channel as _channel
from .operators import forecast as _forecast
from .operators import pscore as _pscore
from .operators import rankings as _rankings
from .operators import trend as _trend
from .operators.clean import require_columns
from .operators.cubes import CAUSE_KEYS, rate_cube
from .operators.rates import (TARGET, cause_week_totals, eval_year, scoped_series, select_scope, totals_from_cause_cube,
                              weekly_series)
from .plans.etl import cube_key, dashboard_view, run_pipeline, series_key
from .sources.refresh import CAUSES, CUBE, PLACES, WEEKLY, WEEKLY_BY_CAUSE, read_current, read_manifest

__all__ = ["run_etl", "load", "Published", "selectors", "ranking", "profile", "kpis", "insights", "overview", "series", "channel", "zones",
           "pscore", "pscore_summary", "smoothed", "forecast", "forecast_kpis", "GLOBAL_SCOPE"]


def run_etl(spark: SparkSession, feed_path: str, population_path: str, out_root: str,
            cfg: Config) -> tuple[bool, str, dict]:
    """Clean, unpivot, join and rate the feed; publish the master (staged)."""
    return run_pipeline(spark, feed_path, population_path, out_root, cfg)


@dataclass(frozen=True)
class Published:
    """One published version: the analysed fact and the tables derived from it."""

    master: DataFrame
    cube: DataFrame
    places: DataFrame
    causes: DataFrame
    weekly: DataFrame | None
    weekly_by_cause: DataFrame | None
    years: tuple[int, ...]
    rows: int


def load(spark: SparkSession, master_root: str, cfg: Config) -> Published:
    """The published version, the master with recoded causes and care levels.
    Fails if the master lacks a column. Series that were published under other
    options than ``cfg`` has are rolled up again from the cube, where it still
    serves."""
    master = read_current(spark, master_root)
    require_columns(master, [AREA, CAUSE, FACILITY, YEAR, WEEK, AGE_GROUP, VISITS, POPULATION, RATE], "published master")
    about = read_manifest(spark, master_root)
    view = dashboard_view(master, cfg)
    cube = (read_current(spark, master_root, CUBE) if about["cube_key"] == cube_key(cfg) else cause_week_totals(view))
    places = read_current(spark, master_root, PLACES)
    causes = read_current(spark, master_root, CAUSES) if about["cube_key"] == cube_key(cfg) else rate_cube(view, CAUSE_KEYS)
    if about["series_key"] == series_key(cfg):
        weekly = read_current(spark, master_root, WEEKLY)
        by_cause = read_current(spark, master_root, WEEKLY_BY_CAUSE) if cfg.target_causes else None
    elif cfg.denominator == "row_sum":
        weekly = scoped_series(totals_from_cause_cube(cube, cfg))
        by_cause = scoped_series(totals_from_cause_cube(cube, cfg, True), [TARGET]) if cfg.target_causes else None
    else:
        weekly, by_cause = weekly_series(view, cfg), weekly_series(view, cfg, True) if cfg.target_causes else None
    return Published(view, cube, places, causes, weekly, by_cause, tuple(about["years"]), about["rows"])


def _fact(m: Published | DataFrame) -> DataFrame:
    return m.master if isinstance(m, Published) else m


def _places(m: Published | DataFrame) -> DataFrame:
    return m.places if isinstance(m, Published) else m


def _causes(m: Published | DataFrame) -> DataFrame:
    return m.causes if isinstance(m, Published) else m


def _year(m: Published | DataFrame, cfg: Config, year):
    """Selected year, else the configured one, else the latest year: of the
    manifest, or of the frame that is given."""
    if year is None and cfg.eval_year is None and isinstance(m, Published):
        year = max(m.years)
    return F.lit(year) if year is not None else eval_year(m, cfg) if isinstance(m, DataFrame) else F.lit(cfg.eval_year)


def selectors(m: Published, cfg: Config) -> DataFrame:
    """The values to choose from: years (latest first), areas, age groups."""
    return _rankings.selectors(m.places)


def ranking(m: Published | DataFrame, cfg: Config, kind: str, year: int | None = None,
            weeks: tuple[int, int] | None = None, area: str | None = None, age: str | None = None) -> DataFrame:
    """Rankings: "areas" (all, by mean rate), "causes" (top-k), "facilities"
    (top-k with area), "facilities_in_area" (all in ``area``), "facilities_by_visits"."""
    c = cfg.with_(week_window=weeks) if weeks else cfg
    y = _year(m, cfg, year)
    if kind == "areas":
        return _rankings.top_areas(_places(m), c, y)
    if kind == "causes":
        return _rankings.top_causes(_causes(m), c, y)
    if kind == "facilities":
        return _rankings.top_facilities(_places(m), c, y)
    if kind == "facilities_in_area":
        if area is None:
            raise ValueError("facilities_in_area needs an area")
        return _rankings.facility_ranking(_places(m), c, y, area)
    if kind == "facilities_by_visits":
        return _rankings.top_facilities_by_visits(_places(m), c, y, age, area)
    raise ValueError(f"unknown ranking {kind!r}")


def profile(m: Published | DataFrame, cfg: Config, kind: str, year: int | None = None,
            weeks: tuple[int, int] | None = None, area: str | None = None, age: str | None = None) -> DataFrame:
    """Load profiles: "who" (J16), "causes_by_level" (top-k causes x care level),
    "week_by_level", "week_by_facility", "week_by_area", "area_share"."""
    c = cfg.with_(week_window=weeks) if weeks else cfg
    y = _year(m, cfg, year)
    if kind == "who":
        return _rankings.profile_who(_places(m), c, y, area, age)
    if kind == "causes_by_level":
        return _rankings.cause_level_profile(_causes(m), c, y, area, age)
    if kind == "week_by_level":
        return _rankings.week_mean_by(_places(m), c, y, CARE_LEVEL, area, age)
    if kind == "week_by_facility":
        return _rankings.week_mean_by(_places(m), c, y, FACILITY, area, age)
    if kind == "week_by_area":
        return _rankings.week_mean_by(_places(m), c, y, AREA, area, age)
    if kind == "area_share":
        return _rankings.area_share(_places(m), c, y)
    raise ValueError(f"unknown profile {kind!r}")


def kpis(m: Published | DataFrame, cfg: Config, year: int | None = None, weeks=None, area=None, age=None) -> DataFrame:
    c = cfg.with_(week_window=weeks) if weeks else cfg
    return _rankings.kpi_totals(_places(m), c, _year(m, cfg, year), area, age)


def insights(m: Published | DataFrame, cfg: Config, year: int | None = None, weeks=None, area=None, age=None) -> DataFrame:
    c = cfg.with_(week_window=weeks) if weeks else cfg
    return _rankings.insights(_causes(m), c, _year(m, cfg, year), area, age)


def overview(m: Published | DataFrame, cfg: Config, year: int | None = None, weeks: tuple[int, int] | None = None) -> DataFrame:
    """Every area, the top causes and the top facilities by mean rate."""
    c = cfg.with_(week_window=weeks) if weeks else cfg
    return _rankings.overview(_places(m), _causes(m), c, _year(m, cfg, year))


def series(m: Published | DataFrame, cfg: Config, scope: str | None = None, by_cause: bool = False,
           weekly: DataFrame | None = None) -> DataFrame:
    """Weekly pooled rates per scope (and cause target when ``by_cause``).

    Every series-based analysis below also takes ``weekly=``: pass a series
    computed once (and written or cached by the caller) to avoid aggregating
    the fact table again for each analysis."""
    if weekly is None and isinstance(m, Published):
        weekly = m.weekly_by_cause if by_cause else m.weekly
    return select_scope(weekly if weekly is not None else weekly_series(_fact(m), cfg, by_cause), scope)


def _series_year(m: Published | DataFrame, s: DataFrame, cfg: Config, year):
    return _year(m if isinstance(m, Published) else s, cfg, year)


def channel(m: Published | DataFrame, cfg: Config, year: int | None = None, scope: str | None = None,
            weekly: DataFrame | None = None) -> DataFrame:
    """Endemic channel (Q1-Q3 over the baseline years, interpolated) with the year's rate."""
    s = series(m, cfg, scope, weekly=weekly)
    return _channel.round_channel(_channel.endemic_channel(s, cfg, _series_year(m, s, cfg, year)))


def zones(m: Published | DataFrame, cfg: Config, year: int | None = None, scope: str | None = None,
          week: int | None = None, weekly: DataFrame | None = None) -> DataFrame:
    """Zone, insight, action and direction per observed week (or one week)."""
    s = series(m, cfg, scope, weekly=weekly)
    z = _channel.zones(_channel.endemic_channel(s, cfg, _series_year(m, s, cfg, year)))
    return z if week is None else z.where(F.col("week") == week)


def pscore(m: Published | DataFrame, cfg: Config, year: int | None = None, scope: str | None = None,
           weekly: DataFrame | None = None) -> DataFrame:
    s = series(m, cfg, scope, weekly=weekly)
    return _pscore.round_pscore(_pscore.pscore(s, cfg, _series_year(m, s, cfg, year)))


def pscore_summary(m: Published | DataFrame, cfg: Config, year: int | None = None, scope: str | None = None,
                   weekly: DataFrame | None = None) -> DataFrame:
    s = series(m, cfg, scope, weekly=weekly)
    return _pscore.pscore_summary(_pscore.pscore(s, cfg, _series_year(m, s, cfg, year)))


def smoothed(m: Published | DataFrame, cfg: Config, year: int | None = None, scope: str | None = None,
             window: int | None = None, long: bool = False, weekly: DataFrame | None = None) -> DataFrame:
    s = series(m, cfg, scope, weekly=weekly)
    sm = _trend.smoothed(s, _series_year(m, s, cfg, year), window or cfg.smoothing_window)
    return _trend.smoothed_long(sm) if long else sm


def forecast(m: Published | DataFrame, cfg: Config, scope: str | None = None, by_cause: bool = False,
             target_years: tuple[int, ...] | None = None,
             weekly: DataFrame | None = None) -> DataFrame:
    """52-week harmonic forecast per scope (and cause target) and target year."""
    c = cfg.with_(target_years=target_years) if target_years else cfg
    keys = ["scope", TARGET] if by_cause else ["scope"]
    return _forecast.round_forecast(_forecast.forecast(series(m, c, scope, by_cause, weekly=weekly), keys, c))


def forecast_kpis(m: Published | DataFrame, cfg: Config, scope: str | None = None, by_cause: bool = False,
                  target_years: tuple[int, ...] | None = None,
                  weekly: DataFrame | None = None) -> DataFrame:
    c = cfg.with_(target_years=target_years) if target_years else cfg
    keys = ["scope", TARGET] if by_cause else ["scope"]
    return _forecast.kpis(_forecast.forecast(series(m, c, scope, by_cause, weekly=weekly), keys, c), keys)

