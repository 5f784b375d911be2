"""Rankings, profiles and KPI aggregates.

Every function takes an analysed fact or a rate cube (``cubes``) that has the
columns it names; the results are the same.

Every aggregate is a hash aggregate with map-side partial aggregation, so a
hot key costs one partial row per task, not a skewed shuffle.  Ties are always
broken by the key (ascending), which is also the "first" key of an arg-max.
Top-k uses ``orderBy().limit(k)`` (TakeOrderedAndProject: a per-task heap).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import (AGE_GROUP, AREA, CARE_LEVEL, CAUSE, FACILITY, LEVEL_HOSPITAL, LEVEL_PRIMARY,
                      RATE, VISITS, WEEK, YEAR, Config)
from ..functions.numeric import safe_div, stable
from .cubes import mean_rate, rate_parts
from .rates import optional_area, optional_eq, year_weeks


def year_slice(df: DataFrame, year, weeks, area=None, age=None) -> DataFrame:
    """Rows of one year and week window, optionally one area / age group."""
    out = year_weeks(df, year, weeks)
    out = optional_area(out, area)
    return optional_eq(out, AGE_GROUP, age)


def mean_rate_by(df: DataFrame, keys: Sequence[str], name: str = RATE) -> DataFrame:
    """Mean of row rates per key (exact integer-hundredths sum), NULL keys dropped.

    The value is left unrounded so that rankings and arg-max see the exact
    order; ``rounded`` applies the reporting precision at the very end.
    """
    cond = None
    for k in keys:
        cond = F.col(k).isNotNull() if cond is None else cond & F.col(k).isNotNull()
    total, rows = rate_parts(df)
    return df.where(cond).groupBy(*keys).agg(mean_rate(total, rows).alias(name))


def rounded(df: DataFrame, *cols: str) -> DataFrame:
    """Apply the reporting precision to the named double columns."""
    return df.withColumns({c: stable(c) for c in cols})


def visits_by(df: DataFrame, keys: Sequence[str], name: str = VISITS) -> DataFrame:
    """Visits summed per key, NULL keys dropped."""
    cond = None
    for k in keys:
        cond = F.col(k).isNotNull() if cond is None else cond & F.col(k).isNotNull()
    return df.where(cond).groupBy(*keys).agg(F.sum(VISITS).alias(name))


def stretch(value: Column) -> Column:
    """A number that rises with ``value``: equal only for values within about
    one part in 64, so it cuts any range of rates or visits into a few thousand
    stretches at most. Nulls come before all."""
    size = F.rint(F.log2(F.abs(value) + F.lit(1e-9)) * F.lit(64.0)).cast("int") + F.lit(4096)
    return F.when(value.isNull(), F.lit(-(2**30))).when(value < 0, -size).otherwise(size)


def numbered(df: DataFrame, name: str, cut: Column, order: Sequence[Column]) -> DataFrame:
    """``df`` with the place of each row by ``order``, from 1. ``cut`` is
    ascending in that order: rows are numbered within each of its values, and
    the rows of all values before are added, so no task orders the whole list.
    What is gathered is a count for each value of ``cut``."""
    keyed = df.withColumn("_cut", cut)
    counts = keyed.groupBy("_cut").agg(F.count(F.lit(1)).alias("n")).agg(F.collect_list(F.struct("_cut", "n"))).scalar()
    before = F.aggregate(F.filter("_counts", lambda c: c["_cut"] < F.col("_cut")), F.lit(0).cast("long"), lambda s, c: s + c["n"])
    place = F.row_number().over(Window.partitionBy("_cut").orderBy(*order))
    return keyed.withColumn(name, place).withColumn("_counts", counts).withColumn(name, (F.col(name) + before).cast("int")).drop("_cut", "_counts")


def ranked(df: DataFrame, value: str, keys: Sequence[str], k: int | None = None,
           round_value: bool = True) -> DataFrame:
    """Descending by value, ties by keys, with the ``rank``; ``k`` keeps the
    top k (G1-G5). Ordering uses the exact value; the reported value is rounded
    afterwards. The rank of a top k is counted over those rows; that of a full
    ranking stretch by stretch (``numbered``)."""
    order = [F.col(value).desc_nulls_last(), *[F.col(c).asc() for c in keys]]
    if k is not None:
        out = df.orderBy(*order).limit(k).withColumn("rank", F.row_number().over(Window.orderBy(*order)))
    else:
        out = numbered(df, "rank", -stretch(F.col(value)), order)
    return rounded(out, value) if round_value else out


def top_areas(m: DataFrame, cfg: Config, year) -> DataFrame:
    """E7 + G1: every area by mean row rate, descending (ties by area)."""
    return ranked(mean_rate_by(year_slice(m, year, cfg.week_window), [AREA]), RATE, [AREA])


def top_causes(m: DataFrame, cfg: Config, year) -> DataFrame:
    """E8 + G2: the top-k causes by mean row rate."""
    return ranked(mean_rate_by(year_slice(m, year, cfg.week_window), [CAUSE]), RATE, [CAUSE], cfg.top_causes)


def top_facilities(m: DataFrame, cfg: Config, year) -> DataFrame:
    """E9 + G3: the top-k (area, facility) pairs by mean row rate."""
    keys = [AREA, FACILITY]
    return ranked(mean_rate_by(year_slice(m, year, cfg.week_window), keys), RATE, keys, cfg.top_facilities)


def top_facilities_by_visits(m: DataFrame, cfg: Config, year, age: str, area=None) -> DataFrame:
    """E15 + G4: the top-k facilities (with care level) by visits, optionally for one age group / area."""
    keys = [FACILITY, CARE_LEVEL]
    agg = visits_by(year_slice(m, year, cfg.week_window, area, age), keys)
    return ranked(agg, VISITS, keys, cfg.top_facilities)


def facility_ranking(m: DataFrame, cfg: Config, year, area: str) -> DataFrame:
    """E12 + G1: every facility of one area by mean row rate."""
    keys = [FACILITY, CARE_LEVEL]
    return ranked(mean_rate_by(year_slice(m, year, cfg.week_window, area), keys), RATE, keys)


def total_of(agg: DataFrame, col: str = VISITS):
    """Grand total of an aggregated frame as a scalar subquery.

    Summing the per-key aggregate instead of the fact slice lets Spark reuse
    the aggregate's exchange, so the fact table is scanned once; no
    un-partitioned window is needed."""
    return agg.select(F.sum(col)).scalar()


def area_share(m: DataFrame, cfg: Config, year) -> DataFrame:
    """Visits per area and share of the total."""
    by_area = visits_by(year_slice(m, year, cfg.week_window), [AREA])
    return by_area.withColumn("share", stable(safe_div(F.col(VISITS), total_of(by_area))))


def mean_rate_profile(m: DataFrame, cfg: Config, year, keys: Sequence[str], area=None, age=None) -> DataFrame:
    """Mean row rate per arbitrary keys over a slice (E10, E11, E13, E14 are instances)."""
    return rounded(mean_rate_by(year_slice(m, year, cfg.week_window, area, age), keys), RATE)


def profile_who(m: DataFrame, cfg: Config, year, area=None, age=None) -> DataFrame:
    """Facilities by visits when an age group is chosen, else age x level rates."""
    if age is not None:
        return top_facilities_by_visits(m, cfg, year, age, area)
    return mean_rate_profile(m, cfg, year, [AGE_GROUP, CARE_LEVEL], area)


def cause_level_profile(m: DataFrame, cfg: Config, year, area=None, age=None) -> DataFrame:
    """Visits by cause x care level, restricted to the top-k causes.

    The slice is scanned and aggregated once: the cause totals are rolled up
    from the cause x level aggregate (Spark reuses its exchange), the top-k is
    a per-task heap (TakeOrderedAndProject), and the k causes -- a list whose
    size is the configured k -- are broadcast into an inner join.  (A semi
    join would be pushed below the aggregate and scan the slice twice.)"""
    by_level = visits_by(year_slice(m, year, cfg.week_window, area, age), [CAUSE, CARE_LEVEL])
    top = ranked(by_level.groupBy(CAUSE).agg(F.sum(VISITS).alias("_t")), "_t", [CAUSE],
                 cfg.top_causes, round_value=False).select(CAUSE)
    return by_level.join(F.broadcast(top), CAUSE).select(CAUSE, CARE_LEVEL, VISITS)


def kpi_totals(m: DataFrame, cfg: Config, year, area=None, age=None) -> DataFrame:
    """Total, hospital and primary-care visits and their shares (percent)."""
    s = year_slice(m, year, cfg.week_window, area, age)
    total = F.sum(VISITS)
    hosp = F.sum(F.when(F.col(CARE_LEVEL) == LEVEL_HOSPITAL, F.col(VISITS)).otherwise(0.0))
    prim = F.sum(F.when(F.col(CARE_LEVEL) == LEVEL_PRIMARY, F.col(VISITS)).otherwise(0.0))
    return (s.agg(total.alias("total_visits"), hosp.alias("hospital_visits"),
                  prim.alias("primary_visits"))
            .select("*",
                    stable(safe_div(F.col("hospital_visits"), F.col("total_visits")) * 100).alias("hospital_pct"),
                    stable(safe_div(F.col("primary_visits"), F.col("total_visits")) * 100).alias("primary_pct")))


def arg_max(df: DataFrame, value: str, key: str, group: Sequence[str] = ()) -> DataFrame:
    """Arg-max of ``value`` per group, first key on ties (E19) and the max.

    ``min(struct(-value, key))`` picks the largest value and, among equal
    values, the smallest key; it is an ordinary partial aggregate.
    """
    order = F.struct((-F.col(value)).alias("neg"), F.col(key).alias("k"))
    best = F.min(F.when(F.col(value).isNotNull(), order))
    cols = [F.col(g) for g in group]
    return (df.groupBy(*cols)
            .agg(best.alias("_b"), F.max(value).alias("max_" + value))
            .select(*cols, F.col("_b.k").alias(key), F.col("max_" + value)))


def insights(m: DataFrame, cfg: Config, year, area=None, age=None) -> DataFrame:
    """Leading cause by visits, its share of the total, the leading age
    group by mean rate (when no age filter is set) and the total, as one row.

    One grouping-sets aggregate (cause | age group) feeds one conditional
    global aggregate: a single scan and two small shuffles."""
    s = year_slice(m, year, cfg.week_window, area, age)
    both = (s.groupingSets([[CAUSE], [AGE_GROUP]], CAUSE, AGE_GROUP)
            .agg(F.sum(VISITS).alias(VISITS), *rate_parts(s), F.grouping_id().alias("_g"))
            .select(CAUSE, AGE_GROUP, VISITS, "_g", mean_rate().alias(RATE)))
    is_cause = (F.col("_g") == 1) & F.col(CAUSE).isNotNull()
    is_age = (F.col("_g") == 2) & F.col(AGE_GROUP).isNotNull()
    lead_c = F.min(F.when(is_cause & F.col(VISITS).isNotNull(),
                          F.struct((-F.col(VISITS)).alias("n"), F.col(CAUSE).alias("k"))))
    lead_a = F.min(F.when(is_age & F.col(RATE).isNotNull(),
                          F.struct((-F.col(RATE)).alias("n"), F.col(AGE_GROUP).alias("k"))))
    one = both.agg(lead_c.alias("_c"), lead_a.alias("_a"),
                   F.sum(F.when(is_cause, F.col(VISITS))).alias("total_visits"))
    out = one.select(F.col("_c.k").alias("leading_cause"), (-F.col("_c.n")).alias("leading_cause_visits"),
                     "total_visits",
                     stable(safe_div(-F.col("_c.n"), F.col("total_visits")) * 100).alias("leading_cause_pct"),
                     (F.col("_a.k") if age is None else F.lit(age)).alias("leading_age_group"))
    # the source reports nothing when the slice is empty
    return out.where(F.col("leading_cause").isNotNull())


def overview(place: DataFrame, cause: DataFrame, cfg: Config, year) -> DataFrame:
    """Area ranking, top-k causes and top-k facilities, each rolled up from
    the rate cube that has its keys (an analysed fact may be given for either)."""
    null_s = F.lit(None).cast("string")

    def part(kind: str, df: DataFrame, key: str, key2: str | None = None) -> DataFrame:
        return df.select(F.lit(kind).alias("ranking"), "rank", F.col(key).alias("key"),
                         (F.col(key2) if key2 else null_s).alias("key2"), RATE)

    return (part("areas", top_areas(place, cfg, year), AREA)
            .unionByName(part("causes", top_causes(cause, cfg, year), CAUSE))
            .unionByName(part("facilities", top_facilities(place, cfg, year), AREA, FACILITY)))


def selectors(place: DataFrame) -> DataFrame:
    """The values a user can choose from, (kind, position, value): years
    descending, areas and age groups ascending, from the place cube (or an
    analysed fact). Places in the lists are counted by year or by the values'
    first two characters."""
    def listed(column: str, down: bool = False) -> DataFrame:
        values = place.select(column).where(F.col(column).isNotNull()).distinct()
        order, cut = (F.col(column).desc(), -F.col(column)) if down else (F.col(column).asc(), F.substring(F.col(column), 1, 2))
        return (numbered(values, "position", cut, [order])
                .select(F.lit(column).alias("kind"), "position", F.col(column).cast("string").alias("value")))

    return listed(YEAR, down=True).unionByName(listed(AREA)).unionByName(listed(AGE_GROUP))


def peak_area(m: DataFrame, cfg: Config, year) -> DataFrame:
    """Area with the highest mean rate (first on ties) and that rate."""
    by_area = mean_rate_by(year_slice(m, year, cfg.week_window), [AREA])
    return rounded(arg_max(by_area, RATE, AREA).withColumnRenamed("max_" + RATE, RATE), RATE)


def null_audit(df: DataFrame) -> DataFrame:
    """Number of missing values (NULL, or NaN in floating-point columns)
    per column, one row, one pass."""
    floating = {c for c, t in df.dtypes if t in ("double", "float")}

    def missing(c: str) -> Column:
        return F.col(c).isNull() | F.isnan(c) if c in floating else F.col(c).isNull()

    return df.agg(*[F.count_if(missing(c)).alias(f"{c}_nulls") for c in df.columns])


def head_rows(df: DataFrame, order: Sequence[str], n: int = 5, where: Column | None = None) -> DataFrame:
    """First n rows in a stated order (the limit is the feature)."""
    src = df.where(where) if where is not None else df
    return src.orderBy(*order).limit(n)


def week_mean_by(m: DataFrame, cfg: Config, year, key: str, area=None, age=None) -> DataFrame:
    """Mean row rate per (week, key): E10 (care level), E13 (facility), E14 (area)."""
    return rounded(mean_rate_by(year_slice(m, year, cfg.week_window, area, age), [WEEK, key]), RATE)
