"""Rates: row rate (E3), weekly pooled-rate series (E1/E2) and slice filters.

The weekly series are built from one partial aggregate of the fact table at
(area[, cause target], year, week) granularity -- a few rows per area-week --
and the network-wide "Global" scope is rolled up from that small table, so
the fact table is scanned and shuffled once however many scopes are served.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import (AGE_GROUP, AREA, CAUSE, GLOBAL_SCOPE, POPULATION, RATE, RATE_SCALE, SCOPE,
                      VISITS, WEEK, YEAR, Config)
from ..functions.numeric import pooled_rate, round_half_even
from ..functions.text import contains_ci

TARGET = "target"


def row_rate(visits: Column, population: Column) -> Column:
    """Rate per 10,000 of one row, 2 decimals half-even; 0.0 when population <= 0."""
    raw = visits / F.nullif(population, F.lit(0.0)) * F.lit(RATE_SCALE)
    return F.when(population > 0, round_half_even(raw, 2)).otherwise(F.lit(0.0))


# -- slice filters (B13-B20, B22) --------------------------------------------

def year_weeks(df: DataFrame, year: int | Column, weeks: tuple[int, int]) -> DataFrame:
    y = year if isinstance(year, Column) else F.lit(year)
    return df.where((F.col(YEAR) == y) & F.col(WEEK).between(weeks[0], weeks[1]))


def optional_eq(df: DataFrame, col: str, value) -> DataFrame:
    """Filter only when a value is given."""
    return df if value is None else df.where(F.col(col) == F.lit(value))


def optional_area(df: DataFrame, area: str | Column | None) -> DataFrame:
    """Rows of one territory; None and "Global" mean all of them."""
    every = isinstance(area, str) and area == GLOBAL_SCOPE  # area may also be a column
    return optional_eq(df, AREA, None if every else area)


def baseline_years(df: DataFrame, cfg: Config) -> DataFrame:
    lo, hi = cfg.baseline_years
    return df.where(F.col(YEAR).between(lo, hi))


def latest_year(master: DataFrame) -> Column:
    """Latest year present, as a scalar subquery (evaluated once)."""
    return master.select(F.max(YEAR)).scalar()


def eval_year(master: DataFrame, cfg: Config) -> Column:
    return F.lit(cfg.eval_year) if cfg.eval_year is not None else latest_year(master)


# -- weekly pooled series ----------------------------------------------------

def matched_targets(cause: Column, targets: Sequence[str]) -> Column:
    """Array of the target names contained (case-insensitively) in the cause.

    The relational reading of a loop of substring filters: a theta join with a
    fixed target list, written as an array filter so no join is planned.
    """
    if not targets:
        raise ValueError("no cause targets configured")
    arr = F.array(*[F.lit(str(t)) for t in targets])
    return F.filter(arr, lambda t: contains_ci(cause, t))


def area_week_totals(master: DataFrame, cfg: Config, by_target: bool = False) -> DataFrame:
    """Visits and population summed per (area[, target], year, week).

    For cause targets the fact table is first reduced per (area, cause, year,
    week) -- a partial aggregate -- and the substring match runs on that small
    table; sums of sums are exact, so the result equals matching every row.
    """
    keys = [AREA]
    if cfg.denominator == "distinct_cell":
        df = master
        if by_target:
            df = df.select("*", F.explode(matched_targets(F.col(CAUSE), cfg.target_causes)).alias(TARGET))
            keys.append(TARGET)
        df = (df.groupBy(*keys, YEAR, WEEK, AGE_GROUP)
              .agg(F.sum(VISITS).alias(VISITS), F.max(POPULATION).alias(POPULATION)))
    elif cfg.denominator == "row_sum":
        df = master
        if by_target:
            df = (master.groupBy(AREA, CAUSE, YEAR, WEEK)
                  .agg(F.sum(VISITS).alias(VISITS), F.sum(POPULATION).alias(POPULATION))
                  .select("*", F.explode(matched_targets(F.col(CAUSE), cfg.target_causes)).alias(TARGET)))
            keys.append(TARGET)
    else:
        raise ValueError(f"unknown denominator {cfg.denominator!r}")
    return (df.groupBy(*keys, YEAR, WEEK)
            .agg(F.sum(VISITS).alias(VISITS), F.sum(POPULATION).alias(POPULATION)))


def cause_week_totals(master: DataFrame) -> DataFrame:
    """Visits and population per (area, cause, year, week): the one fact-table
    aggregate from which every row-sum series (all causes, or per cause
    target) is rolled up."""
    return (master.groupBy(AREA, CAUSE, YEAR, WEEK)
            .agg(F.sum(VISITS).alias(VISITS), F.sum(POPULATION).alias(POPULATION)))


def totals_from_cause_cube(cube: DataFrame, cfg: Config, by_target: bool = False) -> DataFrame:
    """``area_week_totals`` for the row-sum denominator, rolled up from the
    (area, cause, year, week) cube instead of the fact table."""
    keys = [AREA]
    df = cube
    if by_target:
        df = cube.select("*", F.explode(matched_targets(F.col(CAUSE), cfg.target_causes)).alias(TARGET))
        keys.append(TARGET)
    return (df.groupBy(*keys, YEAR, WEEK)
            .agg(F.sum(VISITS).alias(VISITS), F.sum(POPULATION).alias(POPULATION)))


def scoped_series(totals: DataFrame, extra_keys: Sequence[str] = ()) -> DataFrame:
    """Per-area rows plus a "Global" roll-up: (scope, *extra, year, week, visits,
    population, rate).  Filtering on ``scope`` prunes the unused branch."""
    per_area = totals.select(F.col(AREA).alias(SCOPE), *extra_keys, YEAR, WEEK, VISITS, POPULATION)
    glob = (totals.groupBy(*extra_keys, YEAR, WEEK)
            .agg(F.sum(VISITS).alias(VISITS), F.sum(POPULATION).alias(POPULATION))
            .select(F.lit(GLOBAL_SCOPE).alias(SCOPE), *extra_keys, YEAR, WEEK, VISITS, POPULATION))
    return (per_area.unionByName(glob)
            .withColumn(RATE, pooled_rate(F.col(VISITS), F.col(POPULATION))))


def weekly_series(master: DataFrame, cfg: Config, by_target: bool = False) -> DataFrame:
    """E1/E2 for every scope (and cause target) at once."""
    totals = area_week_totals(master, cfg, by_target)
    return scoped_series(totals, [TARGET] if by_target else [])


def select_scope(series: DataFrame, scope: str | None) -> DataFrame:
    """Single-scope slice (B14); ``None`` keeps every scope."""
    return optional_eq(series, SCOPE, scope)

