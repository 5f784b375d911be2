"""Documented variants offered as options."""

from pyspark.sql import functions as F

from epiwatch import config as C
from epiwatch.operators import forecast
from epiwatch.operators.clean import drop_incomplete
from epiwatch.operators.rates import area_week_totals, scoped_series

MASTER = ("facility string, area string, cause string, year int, week int, age_group string, "
          "visits double, population double")


def test_denominator_row_sum_vs_distinct_cell(spark):
    rows = [("f1", "A", "Influenza", 2019, 1, "g1", 2.0, 100.0),
            ("f2", "A", "Influenza", 2019, 1, "g1", 3.0, 100.0),   # same cell, second facility
            ("f1", "A", "Neumonía", 2019, 1, "g2", 5.0, 50.0)]
    m = spark.createDataFrame(rows, MASTER)
    row_sum = area_week_totals(m, C.Config()).first()
    cell = area_week_totals(m, C.Config(denominator="distinct_cell")).first()
    assert (row_sum.visits, row_sum.population) == (10.0, 250.0)
    assert (cell.visits, cell.population) == (10.0, 150.0)


def test_cause_targets_match_by_substring_and_sum_exactly(spark):
    rows = [("f1", "A", "Influenza", 2019, 1, "g1", 2.0, 100.0),
            ("f1", "A", "Influenza B", 2019, 1, "g2", 1.0, 10.0),
            ("f1", "B", "IRA Alta", 2019, 1, "g1", 4.0, 40.0)]
    m = spark.createDataFrame(rows, MASTER)
    cfg = C.Config(target_causes=("influenza", "IRA Alta"))
    got = {(r.area, r.target): (r.visits, r.population) for r in area_week_totals(m, cfg, by_target=True).collect()}
    assert got == {("A", "influenza"): (3.0, 110.0), ("B", "IRA Alta"): (4.0, 40.0)}
    glob = {r.target: r.rate for r in scoped_series(area_week_totals(m, cfg, True), ["target"])
            .where(F.col("scope") == C.GLOBAL_SCOPE).collect()}
    assert abs(glob["influenza"] - 3.0 / 110.0 * 10000) < 1e-9


def test_threshold_years_variants(spark):
    cfg = C.Config(base_year=2014, baseline_years=(2014, 2015), excluded_years=(), recent_year=2017,
                   target_years=(2018,))
    rows = [("G", y, w, float(y - 2013) * 10 + w) for y in (2014, 2015, 2016, 2017) for w in range(1, 53)]
    s = spark.createDataFrame(rows, "scope string, year int, week int, rate double")
    train = {r.week: r.q3 for r in forecast.forecast(s, ["scope"], cfg).collect()}
    base = {r.week: r.q3 for r in forecast.forecast(s, ["scope"], cfg.with_(threshold_years="baseline")).collect()}
    assert train[1] == 33.5     # linear Q3 of 11, 21, 31, 41
    assert base[1] == 18.5      # linear Q3 of 11, 21


def test_required_only_drop_variant(spark):
    df = spark.createDataFrame([("a", None, 1.0), ("b", "x", None), (None, "y", 2.0)], "k string, lat string, v double")
    assert drop_incomplete(df).count() == 0
    assert drop_incomplete(df, ["k", "v"]).count() == 1


def test_training_years_slice(spark):
    from epiwatch.operators.forecast import training_rows
    cfg = C.Config(excluded_years=(2020, 2021, 2022), target_years=(2025,))
    df = spark.createDataFrame([("G", y, 1, 2.0) for y in range(2018, 2026)], "scope string, year int, week int, rate double")
    got = sorted(r.year for r in training_rows(df, ["scope"], cfg).collect())
    assert got == [2018, 2019, 2023, 2024]


def test_empty_target_lists_fail_clearly(spark):
    import pytest
    from epiwatch.operators import forecast
    from epiwatch.operators.rates import matched_targets
    s = spark.createDataFrame([("G", 2019, 1, 1.0)], "scope string, year int, week int, rate double")
    with pytest.raises(ValueError):
        forecast.training_rows(s, ["scope"], C.Config(target_years=()))
    with pytest.raises(ValueError):
        matched_targets(F.col("cause"), ())
