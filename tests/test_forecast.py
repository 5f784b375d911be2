"""Harmonic WLS: recovery, agreement with numpy lstsq, rank-deficient fallback, metrics."""

import math
import random

import numpy as np

from epiwatch import config as C
from epiwatch.operators import forecast
from epiwatch.operators.wls import wls_fit

CFG = C.Config(base_year=2014, recent_year=2023, excluded_years=(2020, 2021, 2022), target_years=(2025,))


def _design(year, week):
    t = (year - CFG.base_year) * CFG.period + week
    a = 2 * math.pi * t / CFG.period
    return [1.0, t, math.sin(a), math.cos(a), math.sin(2 * a), math.cos(2 * a)]


def _series(spark, fn, years, weeks, scope="G"):
    rows = [(scope, y, w, float(fn(y, w))) for y in years for w in weeks]
    return spark.createDataFrame(rows, "scope string, year int, week int, rate double")


def _numpy_forecast(rows, target):
    X, yv, wv = [], [], []
    for (y, w, r) in rows:
        if y in CFG.excluded_years or y >= target or r is None:
            continue
        X.append(_design(y, w)); yv.append(r); wv.append(5.0 if y >= CFG.recent_year else 1.0)
    X, yv, sw = np.array(X), np.array(yv), np.sqrt(np.array(wv))
    beta = np.linalg.lstsq(X * sw[:, None], yv * sw, rcond=None)[0]
    return {w: max(0.0, float(np.dot(_design(target, w), beta))) for w in range(1, 53)}


def test_exact_harmonic_series_is_recovered(spark):
    beta = [40.0, 0.01, 8.0, -3.0, 2.0, 1.0]
    s = _series(spark, lambda y, w: float(np.dot(_design(y, w), beta)), range(2014, 2025), range(1, 53))
    fc = {r.week: r.projected for r in forecast.forecast(s, ["scope"], CFG).collect()}
    for w in range(1, 53):
        assert abs(fc[w] - max(0.0, float(np.dot(_design(2025, w), beta)))) < 1e-9


def test_matches_numpy_lstsq_on_noisy_data(spark):
    rnd = random.Random(11)
    rows = [(y, w, rnd.uniform(0, 30) + 10 * math.sin(w / 8)) for y in range(2014, 2025) for w in range(1, 54)
            if rnd.random() > 0.1]
    s = spark.createDataFrame([("G",) + r for r in rows], "scope string, year int, week int, rate double")
    got = {r.week: r.projected for r in forecast.forecast(s, ["scope"], CFG).collect()}
    exp = _numpy_forecast(rows, 2025)
    assert max(abs(got[w] - exp[w]) for w in exp) < 1e-8


def test_rank_deficient_series_gets_the_minimum_norm_solution(spark):
    rows = [(2019, w, float(w)) for w in (3, 10, 20, 30, 40)]  # 5 distinct weeks < 6 columns
    s = spark.createDataFrame([("G",) + r for r in rows], "scope string, year int, week int, rate double")
    fc = forecast.forecast(s, ["scope"], CFG)
    got = {r.week: r.projected for r in fc.collect()}
    exp = _numpy_forecast(rows, 2025)
    assert max(abs(got[w] - exp[w]) for w in exp) < 1e-6
    plan = fc._jdf.queryExecution().executedPlan().toString()
    assert "Pandas" not in plan and "Window" not in plan


def _fitted(spark, groups, n):
    """fit and deficient by (series, row) of {series: [(y, w, x...)]}."""
    rows = [(g, i, *map(float, r)) for g, some in groups.items() for i, r in enumerate(some)]
    xs = [f"x{j}" for j in range(n)]
    df = spark.createDataFrame(rows, "k string, i int, y double, w double, " + ", ".join(f"{c} double" for c in xs))
    return {(r.k, r.i): r for r in wls_fit(df, ["k"], xs).collect()}


def _lstsq(some):
    a = np.array(some, dtype=float)
    sw = np.sqrt(a[:, 1])
    return a[:, 2:] @ np.linalg.lstsq(a[:, 2:] * sw[:, None], a[:, 0] * sw, rcond=None)[0]


def test_solver_flags_dependent_columns_and_equals_lstsq(spark):
    rnd = random.Random(5)
    y = lambda: rnd.uniform(0, 9)
    groups = {
        "collinear": [(y(), 1 + i % 2, 1, i, 2 * i) for i in range(10)],
        "zero column": [(y(), 1, 1, 0, i) for i in range(8)],
        "one row": [(4.0, 5.0, 1, 2, 3)],
        "equal rows": [(y(), 1, 1, 7, 3) for _ in range(6)],
        "far from the origin": [(y(), 1 + i % 3, 1, 1e4 + i, (1e4 + i) ** 2) for i in range(30)],
        "well posed": [(y(), 1 + i % 3, 1, i, math.sin(i)) for i in range(30)],
    }
    got = _fitted(spark, groups, 3)
    assert {k for (k, _), r in got.items() if r.deficient} == {"collinear", "zero column", "one row", "equal rows"}
    for k, some in groups.items():
        if k == "far from the origin":  # the same parabola about its middle, where the columns are apart
            some = [(a, b, 1, i - 15, (i - 15) ** 2) for i, (a, b, *_) in enumerate(some)]
        assert max(abs(got[k, i].fit - v) for i, v in enumerate(_lstsq(some))) < (1e-5 if k == "far from the origin" else 1e-9), k


def test_few_weeks_side_by_side_keep_their_digits(spark):
    """Harmonics over nine neighbouring weeks are nearly dependent."""
    rnd = random.Random(8)
    some = [(rnd.uniform(5, 40), 5.0, *_design(2023, w)) for w in range(20, 29)]
    got = _fitted(spark, {"g": some}, 6)
    assert max(abs(got["g", i].fit - v) for i, v in enumerate(_lstsq(some))) < 1e-8


def test_rows_without_weight_do_not_train(spark):
    some = [(2.0 * i, 1.0, 1.0, i) for i in range(5)] + [(1e9, 0.0, 1.0, 10.0)]
    got = _fitted(spark, {"g": some, "none": [(1.0, 0.0, 1.0, 1.0)]}, 2)
    assert abs(got["g", 5].fit - 20.0) < 1e-9 and math.isnan(got["none", 0].fit)


def test_mape_skips_zero_actual(spark):
    fc = spark.createDataFrame([("G", 2025, 1, 1.0, 0.0), ("G", 2025, 2, 12.0, 10.0), ("G", 2025, 3, 5.0, None)],
                               "scope string, target_year int, week int, projected double, real_rate double")
    r = forecast.evaluation(fc, ["scope"]).collect()[0]
    assert abs(r.mape - 20.0) < 1e-12 and abs(r.mae - 1.5) < 1e-12 and r.eval_weeks == 2


def test_kpis_peak_first_week_and_bands(spark):
    fc = spark.createDataFrame([("G", 2025, 1, 3.0, 2.0, None, True), ("G", 2025, 2, 3.0, 4.0, None, False)],
                               "scope string, target_year int, week int, projected double, q3 double, "
                               "real_rate double, over_q3 boolean")
    r = forecast.kpis(fc, ["scope"]).collect()[0]
    assert r.peak_week == 1 and r.peak_rate == 3.0 and r.weeks_over_q3 == 1
    assert r.mape is None and r.quality is None and r.epidemic_risk


def test_solver_equals_mllib_weighted_normal_equations(spark):
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import LinearRegression
    rnd = random.Random(2)
    rows = [(y, w, rnd.uniform(5, 40)) for y in range(2014, 2025) for w in range(1, 53) if y not in (2020, 2021, 2022)]
    s = spark.createDataFrame([("G",) + r for r in rows], "scope string, year int, week int, rate double")
    feats = forecast.harmonic_features(forecast.training_rows(s, ["scope"], CFG), ["scope"], CFG)
    vec = VectorAssembler(inputCols=list(forecast.FEATURES[1:]), outputCol="f").transform(feats)
    model = LinearRegression(featuresCol="f", labelCol="rate", weightCol="weight", solver="normal",
                             regParam=0.0, fitIntercept=True, standardization=False).fit(vec)
    got = {r.week: r.projected for r in forecast.forecast(s, ["scope"], CFG).collect()}
    for w in (1, 13, 26, 40, 52):
        x = _design(2025, w)
        exp = max(0.0, model.intercept + sum(c * v for c, v in zip(model.coefficients, x[1:])))
        assert abs(got[w] - exp) < 1e-6
