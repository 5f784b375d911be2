"""Batch ETL (J19): wide weekly feed + population -> long master fact with rates.

read -> clean -> unpivot -> key normalisation -> population left join ->
row rate -> Parquet partitioned by year.  Everything before the write is
narrow except the population join, whose (small, aggregated) dimension side is
broadcast when its size estimate allows it, so the fact rows are not shuffled.
"""

from __future__ import annotations

from contextlib import nullcontext

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from ..config import (AGE_GROUP, AREA, CARE_LEVEL, CAUSE, FACILITY, FACILITY_TYPE, GLOBAL_SCOPE,
                      POPULATION, POPULATION_COLUMNS, POPULATION_RENAMES, RATE, VISITS, YEAR,
                      Config)
from ..functions.classify import care_level, recode_cause
from ..functions.numeric import nan_to_null
from ..operators.clean import clean_feed, normalise_keys, rename_present, require_columns, standardise_feed
from ..operators.joins import join_population
from ..operators.rates import TARGET, area_week_totals, cause_week_totals, row_rate, scoped_series, totals_from_cause_cube
from ..operators.reshape import unpivot_ages


def long_visits(raw: DataFrame, cfg: Config) -> DataFrame:
    """Cleaned feed, unpivoted to one row per age group, keys normalised."""
    long_df = unpivot_ages(clean_feed(raw, cfg), cfg.age_columns)
    return normalise_keys(long_df, text_keys=[AREA, AGE_GROUP], int_keys=[YEAR])


def normalise_population(pop: DataFrame) -> DataFrame:
    """Population projections with canonical names and normalised keys; a NaN
    population is a missing one (N2)."""
    df = rename_present(pop, POPULATION_RENAMES)
    df = rename_present(df, POPULATION_COLUMNS)
    require_columns(df, [AREA, YEAR, AGE_GROUP, POPULATION], "population table")
    df = normalise_keys(df, text_keys=[AREA, AGE_GROUP], int_keys=[YEAR])
    return df.withColumn(POPULATION, nan_to_null(F.col(POPULATION).cast("double")))


def joined(raw: DataFrame, pop: DataFrame, cfg: Config) -> DataFrame:
    """Long visits left-joined to population (population NULL when unmatched)."""
    return join_population(long_visits(raw, cfg), normalise_population(pop))


def with_rates(df: DataFrame) -> DataFrame:
    """Fill missing population with 0 and compute the row rate."""
    pop = F.coalesce(F.col(POPULATION), F.lit(0.0)).cast("double")
    visits = F.col(VISITS).cast("double")
    return (df.withColumn(POPULATION, pop)
            .withColumn(VISITS, visits)
            .withColumn(RATE, row_rate(F.col(VISITS), F.col(POPULATION))))


def population_extras(pop: DataFrame) -> list[str]:
    """Population columns other than the join keys and the population itself;
    they flow into the master after ``population`` (a left merge appends them)."""
    return [c for c in normalise_population(pop).columns if c not in (AREA, YEAR, AGE_GROUP, POPULATION)]


def master_column_order(df: DataFrame, extras: list[str]) -> list[str]:
    tail = [VISITS, AGE_GROUP, POPULATION] + extras
    ids = [c for c in df.columns if c not in tail + [RATE, "_orphan"]]
    return ids + tail + [RATE]


def build_master(raw: DataFrame, pop: DataFrame, cfg: Config) -> DataFrame:
    """The master fact as a lazy DataFrame."""
    df = with_rates(joined(raw, pop, cfg))
    return df.select(*master_column_order(df, population_extras(pop)))


def master_for_write(raw: DataFrame, pop: DataFrame, cfg: Config, feed_by_year: bool = False,
                     observation: Observation | None = None) -> DataFrame:
    """The master rows exactly as ``write_master`` writes them.

    ``feed_by_year``: the feed is stored partitioned by year, so a scan task
    holds few years (small files of several may share a task) and writes few
    directories -- the ETL runs without any shuffle where the population side
    is broadcast.  It does not sort either: a scan task of compressed feed files
    holds several times its size in long rows, and the rows keep the order of
    the feed (landed by area and week).  Otherwise the rows are
    rebalanced on the year first (AQE splits a hot year into advisory-sized
    tasks and merges small ones), so tasks do not each write every year, and
    sorted inside a task by area and week.  In either order row-group statistics
    prune scope and week filters on later scans.  The orphan audit (D3) is an
    ``observe`` above any exchange, so no pass counts rows twice.
    """
    df = joined(raw, pop, cfg).withColumn("_orphan", F.col(POPULATION).isNull())
    out = with_rates(df)
    out = out.select(*master_column_order(out, population_extras(pop)), "_orphan")
    if not feed_by_year:
        out = out.hint("rebalance", YEAR)
    if observation is not None:
        out = out.observe(observation, F.count(F.lit(1)).alias("rows"),
                          F.count_if(F.col("_orphan")).alias("orphan_rows"))
    out = out.drop("_orphan")
    order = [c for c in (YEAR, AREA, "week") if c in out.columns]
    return out if feed_by_year else out.sortWithinPartitions(*order)


def write_master(raw: DataFrame, pop: DataFrame, cfg: Config, path: str,
                 feed_by_year: bool = False) -> dict:
    """Run the ETL and write the master (A4), partitioned by year; returns the
    orphan audit collected during the same pass (no extra scan)."""
    from ..sources.store import unsorted_write

    obs = Observation("etl_audit")
    writer = master_for_write(raw, pop, cfg, feed_by_year, obs).write.mode("overwrite").partitionBy(YEAR)
    with unsorted_write(raw.sparkSession) if feed_by_year else nullcontext():
        writer.parquet(path)
    return dict(obs.get)


def dashboard_view(master: DataFrame, cfg: Config) -> DataFrame:
    """Master as analysed: cause recoded (B11) and care level added."""
    level_src = FACILITY_TYPE if FACILITY_TYPE in master.columns else FACILITY
    return (master.withColumn(CAUSE, recode_cause(CAUSE, cfg))
            .withColumn(CARE_LEVEL, care_level(level_src)))


#: The options that the master depends on, beside the tables it comes from.
ETL_OPTIONS = ("service", "excluded_causes", "spelling", "spelling_columns", "age_columns", "drop_columns", "required_only")


def cube_key(cfg: Config) -> str:
    """The options that the cause cube depends on, beside the master's."""
    return repr(cfg.cause_labels)


def series_key(cfg: Config) -> str:
    """The options that the weekly series depend on, beside the master's."""
    return repr((cfg.cause_labels, cfg.target_causes, cfg.denominator))


def _year_of(df: DataFrame) -> Column:
    kind = df.schema[YEAR].dataType
    return F.col(YEAR) if isinstance(kind, IntegralType) else F.col(YEAR).try_cast("double").cast("int")


def year_digests(df: DataFrame) -> dict[int | None, str]:
    """A digest of the rows of each calendar year, whatever their order and
    files: their number and two sums of row hashes. One aggregate; what comes to
    the driver is a row for each year."""
    cols = sorted(df.columns)
    sums = [F.sum(F.xxhash64(F.lit(k), *cols).cast("decimal(38,0)")).cast("string") for k in (0, 1)]
    rows = df.groupBy(_year_of(df).alias("y")).agg(F.count(F.lit(1)).cast("string").alias("n"), F.concat_ws(":", *sums).alias("s")).collect()
    return {r["y"]: f"{r['n']}:{r['s']}" for r in rows}


def run_pipeline(spark, feed_path: str, population_path: str, out_root: str,
                 cfg: Config) -> tuple[bool, str, dict]:
    """J19 end to end on landed files: guarded reads (A6), ETL, staged publish (A5).

    One version holds the master, the (area, cause, year, week) cube, the rate
    cubes by place and by cause, the weekly series (all causes; per cause
    target) and a manifest. The fact rows are aggregated for the cubes; the
    series are rolled up from the first. Years whose feed and population rows
    and options are as in the published version are not worked on again: the
    manifest points to the version that has them. If nothing changed, nothing
    is published. Returns (ok, message, audit); the audit counts the rows of the
    years that were written. ``api.load`` reads what was published.
    """
    from ..operators.cubes import CAUSE_KEYS, PLACE_KEYS, rate_cube
    from ..sources.parquet import read_table
    from ..sources.refresh import (CAUSES, CUBE, MASTER, PLACES, WEEKLY, WEEKLY_BY_CAUSE, current_version, publish,
                                   read_manifest, read_parts)

    from ..config import FEED_COLUMNS
    from ..sources.store import partition_columns

    raw = read_table(spark, feed_path, what="weekly feed")
    pop = read_table(spark, population_path, what="population table")
    parts = partition_columns(spark, feed_path)
    by_year = bool(parts) and FEED_COLUMNS.get(parts[0], parts[0]) == YEAR
    audit: dict = {}

    feed = standardise_feed(raw)
    pop_digests = year_digests(normalise_population(pop))
    options = repr([(o, getattr(cfg, o)) for o in ETL_OPTIONS]) + cube_key(cfg)
    digests = {str(y): f"{d}|{pop_digests.get(y)}|{options}" for y, d in year_digests(feed).items()} if YEAR in feed.columns else {}
    old = read_manifest(spark, out_root) if current_version(spark, out_root) else {}
    same = {y for y, d in digests.items() if old.get("digests", {}).get(y) == d}
    if digests and same == set(digests) == set(old["digests"]) and old["series_key"] == series_key(cfg):
        return True, "unchanged: the published version has these rows", {"rows": 0, "orphan_rows": 0}
    if same == set(digests):  # years went, or the series are others: a version has at least one year of its own
        same -= {max(same)} if same else set()
    kept = {name: [y for y in years if str(y) in same] for name, years in old.get("parts", {}).items()}
    kept = {name: years for name, years in kept.items() if years}
    if same:
        year = _year_of(feed)
        changed = [int(y) for y in digests if y not in same and y != "None"]
        feed = feed.where(year.isin(changed) | year.isNull() if "None" not in same else year.isin(changed))

    def _write(path: str):
        audit.update(write_master(feed, pop, cfg, path, feed_by_year=by_year))

    def _check(master: DataFrame) -> str | None:
        taken = not master.where(F.col(AREA) == GLOBAL_SCOPE).isEmpty()
        return f"an area is called {GLOBAL_SCOPE!r}, the name of the roll-up" if taken else None

    def _derive(master: DataFrame, version: str) -> dict:
        view = dashboard_view(master, cfg)
        for name, cube in ((CUBE, cause_week_totals(view)), (PLACES, rate_cube(view, PLACE_KEYS)), (CAUSES, rate_cube(view, CAUSE_KEYS))):
            cube.hint("rebalance", YEAR).write.partitionBy(YEAR).parquet(f"{version}/{name}")
        counts = {r[YEAR]: r["count"] for r in master.groupBy(YEAR).count().collect()}  # a few calendar years
        now = {**kept, version.rsplit("/", 1)[-1]: sorted(counts, key=str)}
        every = read_parts(spark, out_root, now, CUBE)
        for name, by_target in ((WEEKLY, False), (WEEKLY_BY_CAUSE, True)):
            if by_target and not cfg.target_causes:
                continue
            totals = (totals_from_cause_cube(every, cfg, by_target) if cfg.denominator == "row_sum"
                      else area_week_totals(dashboard_view(read_parts(spark, out_root, now, MASTER), cfg), cfg, by_target))
            scoped_series(totals, [TARGET] if by_target else []).write.parquet(f"{version}/{name}")
        by_year_rows = {**{y: n for y, n in old.get("year_rows", {}).items() if y in same}, **{str(y): n for y, n in counts.items()}}
        years = sorted(y for ys in now.values() for y in ys if y is not None)
        return {"years": years, "rows": sum(by_year_rows.values()), "year_rows": by_year_rows, "parts": now, "digests": digests,
                "series_key": series_key(cfg), "cube_key": cube_key(cfg)}

    ok, msg = publish(spark, out_root, _write, required=[AREA, YEAR, AGE_GROUP, VISITS, POPULATION, RATE],
                      check=_check, derive=_derive)
    return ok, msg, audit
