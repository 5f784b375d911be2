"""Landed inputs, the published master and its derived tables for a folder of
test tables.

``raw_feed`` / ``population`` land the weekly feed and the population table
derived from the star-schema tables (the role of the downloaded files);
``master`` runs the ETL; ``weekly_series`` and ``forecasts`` hold the shared
weekly cube and the all-series forecast.  Each is written once per input
fingerprint (sources.store) and then scanned with pruning and pushdown.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..config import YEAR, Config, driver_defaults
from ..operators.cubes import CAUSE_KEYS, PLACE_KEYS, rate_cube
from ..operators.forecast import forecast
from ..operators.rates import (TARGET, area_week_totals, cause_week_totals, scoped_series,
                               totals_from_cause_cube)
from ..plans.etl import ETL_OPTIONS, dashboard_view, write_master
from . import driver_tables
from .store import fingerprint, materialise, materialise_df, read_published

# Bump when the landing or ETL logic changes, so stored tables are rebuilt.
STORE_VERSION = "11"

RAW_SOURCES = ("lineitem", "orders", "customer", "supplier", "nation", "region", "part")
POP_SOURCES = ("customer", "nation", "orders")


def _paths(sf_dir: str, names) -> list[str]:
    return [f"{sf_dir.rstrip('/')}/{n}.parquet" for n in names]


def raw_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = fingerprint(spark, _paths(sf_dir, RAW_SOURCES), f"raw-{STORE_VERSION}")
    # Landed by year, like a weekly feed archive: every ETL scan task then
    # reads a single year and can write its master directory without a shuffle;
    # sorted here, on the wide rows, so that the ETL need not sort the long ones.
    return materialise_df(spark, "raw", key, lambda: driver_tables.raw_feed(spark, sf_dir),
                          partition_by="year", order=("area", "week"))


def population(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = fingerprint(spark, _paths(sf_dir, POP_SOURCES), f"pop-{STORE_VERSION}")
    return materialise_df(spark, "population", key, lambda: driver_tables.population(spark, sf_dir))


#: The options that each stored table depends on, beside ETL_OPTIONS and the tables it comes from.
SERIES_OPTIONS = ("cause_labels", "target_causes", "denominator")
MODEL_OPTIONS = ("baseline_years", "excluded_years", "recent_year", "recent_weight", "base_weight", "base_year", "period",
                 "target_years", "threshold_years")


def _key(spark: SparkSession, sf_dir: str, cfg: Config, *options: str) -> str:
    names = sorted(set(RAW_SOURCES) | set(POP_SOURCES))
    return fingerprint(spark, _paths(sf_dir, names), f"{STORE_VERSION}-" + repr([(o, getattr(cfg, o)) for o in options]))


def _master_key(spark: SparkSession, sf_dir: str, cfg: Config) -> str:
    return _key(spark, sf_dir, cfg, *ETL_OPTIONS)


def _series_key(spark: SparkSession, sf_dir: str, cfg: Config) -> str:
    return _key(spark, sf_dir, cfg, *ETL_OPTIONS, *SERIES_OPTIONS)


def master(spark: SparkSession, sf_dir: str, cfg: Config | None = None) -> DataFrame:
    """Scan of the published master fact (ETL run first when missing)."""
    cfg = cfg or driver_defaults()
    path = materialise(spark, "master", _master_key(spark, sf_dir, cfg),
                       lambda p: write_master(raw_feed(spark, sf_dir), population(spark, sf_dir), cfg, p,
                                              feed_by_year=True))
    return read_published(spark, path)


def weekly_series(spark: SparkSession, sf_dir: str, cfg: Config | None = None,
                  by_target: bool = False) -> DataFrame:
    """The shared weekly cube: visits, population and pooled rate per
    (scope[, cause target], year, week) -- every area plus the "Global"
    roll-up -- aggregated from the master once per master version and kept as
    a small table.  Every series-based query (channel, P-Score, trend,
    forecast) reads it instead of re-aggregating the fact table.

    The table is a few rows per scope-week, so it is also cached: later scans
    of the same path are served from memory (Spark's cache manager matches
    them), and a lost executor only means re-reading the small file."""
    cfg = cfg or driver_defaults()
    key = _series_key(spark, sf_dir, cfg) + ("-t" if by_target else "")
    extra = [TARGET] if by_target else []

    def build() -> DataFrame:
        if cfg.denominator == "row_sum":   # both variants roll up from one stored cube
            totals = totals_from_cause_cube(cause_cube(spark, sf_dir, cfg), cfg, by_target)
        else:
            totals = area_week_totals(analysed(spark, sf_dir, cfg), cfg, by_target)
        return scoped_series(totals, extra)
    return materialise_df(spark, "weekly", key, build).cache()


def cause_cube(spark: SparkSession, sf_dir: str, cfg: Config | None = None) -> DataFrame:
    """Visits and population per (area, cause, year, week): the single
    aggregation of the fact table behind every weekly series."""
    cfg = cfg or driver_defaults()
    return materialise_df(spark, "cube", _key(spark, sf_dir, cfg, *ETL_OPTIONS, "cause_labels"),
                          lambda: cause_week_totals(analysed(spark, sf_dir, cfg)))


def place_cube(spark: SparkSession, sf_dir: str, cfg: Config | None = None) -> DataFrame:
    """Rates and visits by place and age group (``operators.cubes``), one
    directory a year."""
    cfg = cfg or driver_defaults()
    return materialise_df(spark, "places", _key(spark, sf_dir, cfg, *ETL_OPTIONS),
                          lambda: rate_cube(analysed(spark, sf_dir, cfg), PLACE_KEYS), partition_by=YEAR)


def cause_rate_cube(spark: SparkSession, sf_dir: str, cfg: Config | None = None) -> DataFrame:
    """Rates and visits by cause, area, care level and age group, one directory
    a year."""
    cfg = cfg or driver_defaults()
    return materialise_df(spark, "causes", _key(spark, sf_dir, cfg, *ETL_OPTIONS, "cause_labels"),
                          lambda: rate_cube(analysed(spark, sf_dir, cfg), CAUSE_KEYS), partition_by=YEAR)


def forecasts(spark: SparkSession, sf_dir: str, cfg: Config | None = None,
              by_target: bool = False) -> DataFrame:
    """The harmonic forecast of every series (scope[, cause target]) and target
    year, computed in one job from the weekly cube and stored once per master
    version (values unrounded); forecast tables, evaluations and KPIs are
    derived from it.  Small (52 rows per series), so it is cached as well."""
    cfg = cfg or driver_defaults()
    key = _key(spark, sf_dir, cfg, *ETL_OPTIONS, *SERIES_OPTIONS, *MODEL_OPTIONS) + ("-t" if by_target else "")
    keys = ["scope", TARGET] if by_target else ["scope"]
    df = materialise_df(spark, "forecast", key,
                        lambda: forecast(weekly_series(spark, sf_dir, cfg, by_target), keys, cfg))
    return df.cache()


def analysed(spark: SparkSession, sf_dir: str, cfg: Config | None = None) -> DataFrame:
    """Master as the analytics see it (recoded cause, care level)."""
    cfg = cfg or driver_defaults()
    return dashboard_view(master(spark, sf_dir, cfg), cfg)
