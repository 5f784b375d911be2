"""Channel, interpolation, moving average, P-Score and arg-max edge cases."""

import random

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from epiwatch import config as C
from epiwatch.operators.channel import quartiles, zone
from epiwatch.operators.pscore import pscore, pscore_summary, severity
from epiwatch.operators.rankings import arg_max
from epiwatch.operators.reshape import interpolate_linear
from epiwatch.operators.trend import centred_mean


def test_quartiles_skip_null(spark):
    df = spark.createDataFrame([("G", 1, v) for v in (3.0, 1.0, None, 7.0, 10.0)], "scope string, week int, rate double")
    r = quartiles(df, ["scope"]).collect()[0]
    assert (r.q1, r.q2, r.q3) == (2.5, 5.0, 7.75)


def test_interpolation_matches_pandas(spark):
    series = [None, None, 1.0, None, None, 4.0, 5.0, None, None]
    df = spark.createDataFrame([("G", i + 1, v) for i, v in enumerate(series)], "scope string, week int, x double")
    got = [r.y for r in df.select("week", interpolate_linear("x", ["scope"]).alias("y")).orderBy("week").collect()]
    assert got == [None, None, 1.0, 2.0, 3.0, 4.0, 5.0, 5.0, 5.0]
    rnd = random.Random(7)
    for _ in range(5):
        vals = [None if rnd.random() < 0.4 else rnd.uniform(0, 10) for _ in range(20)]
        df = spark.createDataFrame([("G", i + 1, v) for i, v in enumerate(vals)], "scope string, week int, x double")
        got = [r.y for r in df.select("week", interpolate_linear("x", ["scope"]).alias("y")).orderBy("week").collect()]
        exp = pd.Series(vals, dtype=float).interpolate(method="linear").tolist()
        for g, e in zip(got, exp):
            assert (g is None and np.isnan(e)) or abs(g - e) < 1e-12


def test_centred_moving_average_matches_pandas(spark):
    rnd = random.Random(3)
    vals = [None if rnd.random() < 0.15 else rnd.uniform(0, 50) for _ in range(30)]
    df = spark.createDataFrame([("G", i + 1, v) for i, v in enumerate(vals)], "scope string, week int, x double")
    for w in range(2, 9):
        got = [r.y for r in df.select("week", centred_mean("x", w, ["scope"]).alias("y")).orderBy("week").collect()]
        exp = pd.Series(vals, dtype=float).rolling(window=w, center=True).mean().tolist()
        for g, e in zip(got, exp):
            assert (g is None and np.isnan(e)) or abs(g - e) < 1e-9, (w, g, e)


def test_zone_bounds_and_missing_quartile(spark):
    rows = [(1.0, 1.0, 2.0, 3.0), (2.0, 1.0, 2.0, 3.0), (3.0, 1.0, 2.0, 3.0), (0.5, 1.0, 2.0, 3.0), (5.0, None, None, None)]
    df = spark.createDataFrame(rows, "v double, a double, b double, c double")
    got = [r.z for r in df.select(zone(F.col("v"), F.col("a"), F.col("b"), F.col("c")).alias("z")).collect()]
    assert got == [C.ZONE_SAFETY, C.ZONE_ALARM, C.ZONE_EPIDEMIC, C.ZONE_SUCCESS, C.ZONE_EPIDEMIC]


def test_demand_over_a_zero_median_is_the_strongest_alarm(spark):
    cfg = C.Config(baseline_years=(2014, 2015), eval_year=2016)
    rows = [("G", 2014, 1, 0.0), ("G", 2015, 1, 0.0), ("G", 2016, 1, 1.0),
            ("G", 2014, 2, 2.0), ("G", 2015, 2, 4.0), ("G", 2016, 2, 6.0)]
    series = spark.createDataFrame(rows, "scope string, year int, week int, rate double")
    out = {r.week: r for r in pscore(series, cfg, F.lit(2016)).collect()}
    assert out[1].p_score is None and out[1].kind == C.PSCORE_EXCESS
    assert out[2].p_score == 100.0 and out[2].kind == C.PSCORE_EXCESS
    r = pscore_summary(pscore(series, cfg, F.lit(2016))).collect()[0]
    assert (r.peak_week, r.peak_pscore, r.mean_excess, r.zero_median_weeks) == (1, 100.0, 100.0, 1)
    assert r.severity == C.SEVERITY_BANDS[0][1]


def test_no_demand_over_a_zero_median_is_no_alarm(spark):
    cfg = C.Config(baseline_years=(2014, 2015), eval_year=2016)
    rows = [("G", 2014, 1, 0.0), ("G", 2016, 1, 0.0), ("G", 2014, 2, 2.0), ("G", 2016, 2, 1.0), ("G", 2014, 3, 2.0), ("G", 2016, 3, None),
            ("H", 2014, 1, 0.0), ("H", 2016, 1, 0.0)]
    series = spark.createDataFrame(rows, "scope string, year int, week int, rate double")
    ps = pscore(series, cfg, F.lit(2016))
    assert {(r.scope, r.week): r.kind for r in ps.collect()} == {(s, w): C.PSCORE_DEFICIT for s, w in (("G", 1), ("G", 2), ("G", 3), ("H", 1))}
    r = pscore_summary(ps).collect()
    assert [(x.scope, x.peak_pscore, x.peak_week, x.zero_median_weeks, x.severity) for x in r] == [("G", -50.0, 2, 0, C.SEVERITY_NORMAL)]


def test_severity_bands(spark):
    df = spark.createDataFrame([(v,) for v in (50.1, 50.0, 20.0, 0.1, 0.0)], "p double")
    got = [r.s for r in df.select(severity(F.col("p")).alias("s")).collect()]
    labels = dict((t, lab) for t, lab in C.SEVERITY_BANDS)
    assert got == [labels[50.0], labels[20.0], labels[0.0], labels[0.0], C.SEVERITY_NORMAL]


def test_arg_max_first_key_on_ties(spark):
    df = spark.createDataFrame([("a", 1.0), ("c", 3.0), ("b", 3.0)], "k string, v double")
    r = arg_max(df, "v", "k").collect()[0]
    assert r.k == "b" and r.max_v == 3.0
