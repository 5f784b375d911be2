"""Public API on a source-schema feed: ETL, publish, per-choice results equal bulk results."""

import math
import random

import pytest
from pyspark.sql import functions as F

from epiwatch import api
from epiwatch import config as C

from test_etl import FEED_SCHEMA, _row


@pytest.fixture(scope="module")
def published(spark, tmp_path_factory):
    rnd = random.Random(1)
    rows = []
    areas = ["Norte", "Tome", "Sur"]
    causes = ["Influenza (J09-J11)", "Neumonía (J12-J18)", "IRA Alta (J00-J06)"]
    for year in range(2014, 2026):
        if year in (2020, 2021):
            continue
        for week in range(1, 53 if year < 2025 else 20):
            for area in areas:
                for cause in causes:
                    base = 20 + 15 * math.sin(2 * math.pi * week / 52.1429) + rnd.uniform(0, 5)
                    counts = tuple(max(0, int(base * f)) for f in (0.1, 0.2, 0.3, 0.3, 0.1))
                    rows.append(_row(area=area, cause=cause, year=year, week=week, counts=counts,
                                     fac=f"Hospital {area}"))
    feed = spark.createDataFrame(rows, FEED_SCHEMA)
    pop_rows = [(a, y, g, 1000.0 + 10 * y % 7) for a in ["Norte", "Tomé", "Sur"]
                for y in range(2014, 2026) for g in C.FEED_AGE_COLUMNS.values()]
    pop = spark.createDataFrame(pop_rows, "ComunaGlosa string, Anio int, grupo_etario string, Poblacion double")
    d = tmp_path_factory.mktemp("api")
    feed.write.parquet(f"{d}/feed")
    pop.write.parquet(f"{d}/pop")
    cfg = C.surveillance_defaults().with_(target_years=(2025, 2024), eval_year=2025)
    ok, msg, audit = api.run_etl(spark, f"{d}/feed", f"{d}/pop", f"{d}/master", cfg)
    assert ok, msg
    assert audit["orphan_rows"] == 0
    return api.load(spark, f"{d}/master", cfg), cfg


def _rows(df, order):
    return [tuple(r) for r in df.orderBy(*order).collect()]


def test_single_scope_equals_bulk(published):
    m, cfg = published
    for fn, order in ((api.channel, ["scope", "week"]), (api.pscore, ["scope", "week"]),
                      (api.smoothed, ["scope", "week"])):
        bulk = fn(m, cfg).where(F.col("scope") == "Sur")
        one = fn(m, cfg, scope="Sur")
        assert _rows(bulk, order) == _rows(one, order)
    bulk = api.forecast(m, cfg).where(F.col("scope") == C.GLOBAL_SCOPE)
    one = api.forecast(m, cfg, scope=C.GLOBAL_SCOPE)
    assert _rows(bulk, ["target_year", "week"]) == _rows(one, ["target_year", "week"])


def test_quartiles_ordered_and_complete(published):
    m, cfg = published
    ch = api.channel(m, cfg, scope=C.GLOBAL_SCOPE).collect()
    assert len(ch) == 53
    for r in ch:
        if r.q1 is not None:
            assert r.q1 <= r.q2 <= r.q3


def test_forecast_quality_and_causes(published):
    m, cfg = published
    k = {(r.scope, r.target_year): r for r in api.forecast_kpis(m, cfg).collect()}
    g25 = k[(C.GLOBAL_SCOPE, 2025)]
    assert g25.eval_weeks == 19 and g25.mape < 25 and g25.quality == "good"
    g24 = k[(C.GLOBAL_SCOPE, 2024)]
    assert g24.eval_weeks == 52
    by_cause = api.forecast_kpis(m, cfg, by_cause=True, scope=C.GLOBAL_SCOPE).collect()
    assert {r.target for r in by_cause} == {"IRA Alta", "Neumonía", "Influenza"}


def test_rankings_and_kpis(published):
    m, cfg = published
    areas = api.ranking(m, cfg, "areas", year=2024).collect()
    assert [r.area for r in areas] == sorted([r.area for r in areas], key=lambda a: -[x.rate for x in areas if x.area == a][0])
    assert {r.area for r in areas} == {"Norte", "Tomé", "Sur"}
    k = api.kpis(m, cfg, year=2024).collect()[0]
    assert k.hospital_pct == 100.0
    z = api.zones(m, cfg, scope=C.GLOBAL_SCOPE, week=5).collect()
    assert len(z) == 1 and z[0].zone in {C.ZONE_SUCCESS, C.ZONE_SAFETY, C.ZONE_ALARM, C.ZONE_EPIDEMIC}


def test_partition_count_does_not_change_results(spark, published):
    m, cfg = published
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "1")
        a = _rows(api.forecast(m, cfg), ["scope", "target_year", "week"])
        spark.conf.set("spark.sql.shuffle.partitions", "13")
        b = _rows(api.forecast(m, cfg), ["scope", "target_year", "week"])
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert a == b


def test_profiles_and_filters(published):
    m, cfg = published
    who_all = api.profile(m, cfg, "who", year=2024).collect()
    assert {r.age_group for r in who_all} == set(C.FEED_AGE_COLUMNS.values())
    who_age = api.profile(m, cfg, "who", year=2024, age="65oMas").collect()
    assert len(who_age) == 3 and all(r.visits > 0 for r in who_age)          # facilities by visits
    by_level = api.profile(m, cfg, "causes_by_level", year=2024, weeks=(1, 10)).collect()
    assert {r.cause for r in by_level} <= {"Influenza", "Neumonía", "IRA Alta"}
    ins = api.insights(m, cfg, year=2024, area="Sur", age="1a4Anios").collect()[0]
    assert ins.leading_age_group == "1a4Anios" and ins.total_visits > 0
    assert api.ranking(m, cfg, "facilities_in_area", year=2024, area="Sur").count() == 1
    long = api.smoothed(m, cfg, scope=C.GLOBAL_SCOPE, long=True, window=3).collect()
    assert {r.series for r in long} == {C.RAW_SERIES, C.SMOOTH_SERIES}


def test_precomputed_weekly_series_gives_same_results(published):
    m, cfg = published
    weekly = api.series(m, cfg).cache()
    assert _rows(api.channel(m, cfg, weekly=weekly), ["scope", "week"]) == _rows(api.channel(m, cfg), ["scope", "week"])
    assert (_rows(api.forecast_kpis(m, cfg, weekly=weekly), ["scope", "target_year"])
            == _rows(api.forecast_kpis(m, cfg), ["scope", "target_year"]))
    weekly.unpersist()
