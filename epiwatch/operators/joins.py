"""Joins: population lookup (D1), dimension restriction (D2), orphan audit (D3).

Broadcasts are size-checked: a side is hinted for broadcast only when the
optimizer's size estimate is under the limit; otherwise the plan is left to
Spark (sort-merge join, or an AQE runtime switch to broadcast once the real
size of the shuffled side is known).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import AGE_GROUP, AREA, POPULATION, YEAR

POPULATION_KEYS = (AREA, YEAR, AGE_GROUP)


def estimated_size_bytes(df: DataFrame) -> int:
    """Optimizer size estimate of ``df`` (no job is run)."""
    size = df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    return size if isinstance(size, int) else int(size.toString())


_UNITS = {"b": 1, "k": 1024, "kb": 1024, "m": 1024 ** 2, "mb": 1024 ** 2, "g": 1024 ** 3, "gb": 1024 ** 3}


def broadcast_limit(df: DataFrame) -> int:
    """The session's auto-broadcast threshold in bytes (<= 0: broadcasts off)."""
    raw = str(df.sparkSession.conf.get("spark.sql.autoBroadcastJoinThreshold", "10485760")).strip().lower()
    num = raw.rstrip("bkmg")
    unit = raw[len(num):] or "b"
    try:
        return int(float(num) * _UNITS.get(unit, 1))
    except ValueError:
        return 10 * 1024 * 1024


def broadcast_if_small(df: DataFrame, max_bytes: int | None = None) -> DataFrame:
    """Hint ``broadcast`` only when the estimated size is within ``max_bytes``
    (default: the session's auto-broadcast threshold; none when disabled)."""
    limit = max_bytes if max_bytes is not None else broadcast_limit(df)
    if limit <= 0:
        return df
    try:
        size = estimated_size_bytes(df)
    except Exception:  # estimate unavailable: leave the choice to Spark/AQE
        return df
    return F.broadcast(df) if size <= limit else df


def join_population(long_df: DataFrame, pop: DataFrame) -> DataFrame:
    """Left join of the long visits table to population on (area, year, age).

    Duplicate population keys fan out visit rows, as a relational left join
    does; unmatched rows get NULL population (filled later by the rate step).
    """
    return long_df.join(broadcast_if_small(pop), list(POPULATION_KEYS), "left")


def restrict_population(pop: DataFrame, long_df: DataFrame) -> DataFrame:
    """Population rows whose area occurs in the visits table (left semi join)."""
    areas = long_df.select(AREA).distinct()
    return pop.join(areas, AREA, "left_semi")


def area_coverage(long_df: DataFrame, pop: DataFrame) -> DataFrame:
    """Areas of either side with presence flags (the printed area lists of the
    source system, as data): a union of two distinct projections and one
    aggregate -- no join."""
    feed = long_df.select(AREA, F.lit(True).alias("in_feed"), F.lit(False).alias("in_population"))
    dim = pop.select(AREA, F.lit(False).alias("in_feed"), F.lit(True).alias("in_population"))
    return (feed.unionByName(dim).where(F.col(AREA).isNotNull()).groupBy(AREA)
            .agg(F.max("in_feed").alias("in_feed"), F.max("in_population").alias("in_population")))


def orphan_audit(joined: DataFrame) -> DataFrame:
    """One row: number of rows without population plus one example key.

    The example is the smallest (area, year, age) among the orphans, so the
    result is deterministic; a single aggregate pass, no shuffle of rows.
    """
    orphan = F.col(POPULATION).isNull()
    example = F.min(F.when(orphan, F.struct(F.col(AREA), F.col(YEAR), F.col(AGE_GROUP))))
    return (joined.agg(F.count_if(orphan).alias("orphan_rows"),
                       F.count(F.lit(1)).alias("total_rows"),
                       example.alias("ex"))
            .select("orphan_rows", "total_rows",
                    F.col("ex." + AREA).alias("example_area"),
                    F.col("ex." + YEAR).alias("example_year"),
                    F.col("ex." + AGE_GROUP).alias("example_age_group")))
