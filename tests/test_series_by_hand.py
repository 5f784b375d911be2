"""The weekly analyses against plain arithmetic on small hand-made series, and
on the test tables against sums built here row by row."""

import math
import os

import pytest
from pyspark.sql import functions as F

from epiwatch import config as C
from epiwatch.operators import channel, forecast, pscore, trend
from epiwatch.plans.catalog import QUERIES
from epiwatch.sources import landing

SF = "/root/testdata/sf0.001"
CFG = C.Config(baseline_years=(2014, 2017), excluded_years=(2016,), recent_year=2017, base_year=2014,
               target_years=(2018,), eval_year=2018)


def quantile(values: list[float], p: float) -> float:
    """Between order statistics (n - 1) p and the next, by the fraction."""
    v = sorted(values)
    at = (len(v) - 1) * p
    low = int(at)
    return v[low] if low + 1 == len(v) else v[low] + (at - low) * (v[low + 1] - v[low])


def gaps_filled(values: list[float | None]) -> list[float | None]:
    known = [i for i, v in enumerate(values) if v is not None]
    out = []
    for i, v in enumerate(values):
        before, after = [k for k in known if k <= i], [k for k in known if k >= i]
        if v is not None or not before:
            out.append(v)
        elif not after:
            out.append(values[before[-1]])
        else:
            a, b = before[-1], after[0]
            out.append(values[a] + (values[b] - values[a]) * (i - a) / (b - a))
    return out


def solved(a: list[list[float]], b: list[float]) -> list[float]:
    """Gauss-Jordan elimination with pivoting."""
    m = [[*row, y] for row, y in zip(a, b)]
    n = len(m)
    for c in range(n):
        p = max(range(c, n), key=lambda r: abs(m[r][c]))
        m[c], m[p] = m[p], m[c]
        m[c] = [x / m[c][c] for x in m[c]]
        for r in range(n):
            if r != c:
                m[r] = [x - m[r][c] * y for x, y in zip(m[r], m[c])]
    return [row[-1] for row in m]


def design(year: int, week: int, cfg: C.Config) -> list[float]:
    t = (year - cfg.base_year) * cfg.period + week
    turn = 2 * math.pi * t / cfg.period
    return [1.0, t, math.sin(turn), math.cos(turn), math.sin(2 * turn), math.cos(2 * turn)]


def harmonic_fit(points: list[tuple[int, int, float]], cfg: C.Config) -> list[float]:
    """Coefficients of the weighted normal equations; time is centred for them."""
    mid = sum(design(y, w, cfg)[1] for y, w, _ in points) / len(points)
    rows = []
    for y, w, rate in points:
        x = design(y, w, cfg)
        x[1] = (x[1] - mid) / 100
        rows.append((x, rate, cfg.recent_weight if y >= cfg.recent_year else cfg.base_weight))
    a = [[sum(k * x[i] * x[j] for x, _, k in rows) for j in range(6)] for i in range(6)]
    beta = solved(a, [sum(k * x[i] * r for x, r, k in rows) for i in range(6)])
    beta[1] /= 100
    beta[0] -= beta[1] * mid
    return beta


def close(a, b, tolerance=1e-9):
    return (a is None and b is None) or (a is not None and b is not None and abs(a - b) <= tolerance * max(1.0, abs(b)))


def made() -> dict[tuple[int, int], float]:
    """(year, week) -> rate: two waves, a trend, and weeks that are missing."""
    out = {}
    for year in range(2014, 2019):
        for week in range(1, 54):
            if (year * 7 + week * 3) % 11 == 0 or week in (1, 30, 31, 53) or (year == 2018 and week > 40):
                continue
            out[year, week] = 30 + 0.1 * (year - 2014) * week + 12 * math.sin(week / 8.3) + 5 * math.cos(week / 3.9 + year) + (year * week) % 7
    return out


@pytest.fixture(scope="module")
def series(spark):
    rows = [("A", y, w, r, 1.0, 1.0) for (y, w), r in made().items()]
    return spark.createDataFrame(rows, "scope string, year int, week int, rate double, visits double, population double").cache()


def by_week(df) -> dict:
    return {r.week: r for r in df.collect()}


def test_channel(series):
    got = by_week(channel.endemic_channel(series, CFG, F.lit(2018)))
    rates = made()
    for column, p in (("q1", 0.25), ("q2", 0.5), ("q3", 0.75)):
        raw = []
        for week in range(1, 54):
            v = [rates[y, week] for y in range(2014, 2018) if (y, week) in rates]
            raw.append(quantile(v, p) if v else None)
        assert None in raw
        for week, want in enumerate(gaps_filled(raw), 1):
            assert close(got[week][column], want), (column, week)
    assert all(close(got[w].current_rate, rates.get((2018, w))) for w in range(1, 54))


def test_pscore(series):
    rates = made()
    got = by_week(pscore.pscore(series, CFG, F.lit(2018)))
    for week, r in got.items():
        median = quantile([rates[y, week] for y in range(2014, 2018) if (y, week) in rates], 0.5)
        now = rates.get((2018, week))
        assert close(r.q2_hist, median)
        assert close(r.p_score, None if now is None else 100 * (now - median) / median)
        assert r.kind == (C.PSCORE_EXCESS if now is not None and now > median else C.PSCORE_DEFICIT)


@pytest.mark.parametrize("window", range(2, 9))
def test_moving_average(series, window):
    rates = made()
    weeks = sorted(w for y, w in rates if y == 2018)
    values = [rates[2018, w] for w in weeks]
    got = by_week(trend.smoothed(series, F.lit(2018), window))
    for i, week in enumerate(weeks):
        first, last = i - window // 2, i + (window - 1) // 2
        want = sum(values[first:last + 1]) / window if first >= 0 and last < len(values) else None
        assert close(got[week][C.SMOOTH_SERIES], want)


def test_forecast(series):
    rates = made()
    points = [(y, w, r) for (y, w), r in rates.items() if y < 2018 and y != 2016]
    beta = harmonic_fit(points, CFG)
    got = by_week(forecast.forecast(series, ["scope"], CFG))
    assert sorted(got) == list(range(1, 53))
    for week, r in got.items():
        projected = max(0.0, sum(b * x for b, x in zip(beta, design(2018, week, CFG))))
        rest = [v for y, w, v in points if w == week]
        q3 = quantile(rest, 0.75) if rest else None
        assert close(r.projected, projected)
        assert close(r.q3, q3)
        assert close(r.real_rate, rates.get((2018, week)))
        assert r.over_q3 == (q3 is not None and projected > q3)


@pytest.mark.skipif(not os.path.isdir(SF), reason="test tables not present")
def test_global_series_of_the_test_tables(spark):
    """Pooled rates are sums over rows, not means of rates; then the forecast."""
    cfg = C.driver_defaults()
    visits: dict = {}
    people: dict = {}
    for r in landing.analysed(spark, SF).select("year", "week", "visits", "population").collect():
        key = r.year, r.week
        visits[key] = visits.get(key, 0.0) + r.visits
        people[key] = people.get(key, 0.0) + r.population
    rates = {k: visits[k] / people[k] * 10_000 for k in visits if people[k]}
    found = QUERIES["weekly_pooled_rate"](spark, SF).where(F.col("scope") == C.GLOBAL_SCOPE).collect()
    assert {(r.year, r.week) for r in found} == set(visits)
    assert all(close(r.rate, rates.get((r.year, r.week)), 1e-6) for r in found)
    target = cfg.target_years[0]
    beta = harmonic_fit([(y, w, r) for (y, w), r in rates.items() if y < target and y not in cfg.excluded_years], cfg)
    for r in QUERIES["wls_forecast"](spark, SF).collect():
        assert close(r.projected, max(0.0, sum(b * x for b, x in zip(beta, design(target, r.week, cfg)))), 1e-6)
