"""What the pipeline publishes, and that analyses read it instead of the fact."""

import json
import os
import re

import pytest
from pyspark.sql import functions as F

from epiwatch import api
from epiwatch import config as C
from epiwatch.operators import rankings
from epiwatch.operators.clean import MissingColumnsError
from epiwatch.sources import landing, refresh, store

from test_api import published  # noqa: F401
from test_etl import FEED_SCHEMA, _pop, _row


def fact_scans(df) -> int:
    df.sparkSession.conf.set("spark.sql.maxMetadataStringLength", "4000")  # whole paths in plans
    plan = df._jdf.queryExecution().executedPlan().toString()
    return len(re.findall(r"/master[\],]", plan))  # a scan names its folder once


SERIES = {
    "channel": lambda m, c, **k: api.channel(m, c, **k), "zones": lambda m, c, **k: api.zones(m, c, **k),
    "pscore": lambda m, c, **k: api.pscore(m, c, **k), "pscore_summary": lambda m, c, **k: api.pscore_summary(m, c, **k),
    "smoothed": lambda m, c, **k: api.smoothed(m, c, **k), "global channel": lambda m, c, **k: api.channel(m, c, scope="Global", **k),
}
FORECASTS = {
    "forecast": lambda m, c: api.forecast(m, c), "forecast_kpis": lambda m, c: api.forecast_kpis(m, c),
    "by cause": lambda m, c: api.forecast(m, c, by_cause=True), "series": lambda m, c: api.series(m, c),
}
CUBES = {
    "areas": lambda m, c, **k: api.ranking(m, c, "areas", **k), "causes": lambda m, c, **k: api.ranking(m, c, "causes", **k),
    "facilities": lambda m, c, **k: api.ranking(m, c, "facilities", **k),
    "in area": lambda m, c, **k: api.ranking(m, c, "facilities_in_area", area="Sur", **k),
    "by visits": lambda m, c, **k: api.ranking(m, c, "facilities_by_visits", area="Norte", age="65oMas", **k),
    "kpis": lambda m, c, **k: api.kpis(m, c, **k), "kpis of area": lambda m, c, **k: api.kpis(m, c, area="Sur", weeks=(3, 9), **k),
    "insights": lambda m, c, **k: api.insights(m, c, **k), "insights of area": lambda m, c, **k: api.insights(m, c, area="Sur", **k),
    "overview": lambda m, c, **k: api.overview(m, c, **k),
    **{kind: lambda m, c, kind=kind, **k: api.profile(m, c, kind, **k)
       for kind in ("who", "causes_by_level", "week_by_level", "week_by_facility", "week_by_area", "area_share")},
}


@pytest.mark.parametrize("year", [None, 2024])
@pytest.mark.parametrize("set_year", [None, 2025])
def test_scans_of_the_fact(published, year, set_year):  # noqa: F811
    m, cfg = published
    cfg = cfg.with_(eval_year=set_year)
    for name, fn in SERIES.items():
        assert fact_scans(fn(m, cfg, year=year)) == 0, name
    for name, fn in FORECASTS.items():
        assert fact_scans(fn(m, cfg)) == 0, name
    for name, fn in CUBES.items():
        assert fact_scans(fn(m, cfg, year=year)) == 0, name
    assert fact_scans(api.selectors(m, cfg)) == 0


def test_rankings_of_the_cubes_equal_those_of_the_fact(published):  # noqa: F811
    m, cfg = published
    for name, fn in CUBES.items():
        got, want = ([tuple(r) for r in fn(x, cfg, year=2024).collect()] for x in (m, m.master))
        assert set(got) == set(want) and len(got) == len(want) > 0, name


def test_full_rankings_are_not_ordered_in_one_partition(spark, published):  # noqa: F811
    m, cfg = published
    plan = api.ranking(m, cfg, "areas", year=2024)._jdf.queryExecution().optimizedPlan().toString()
    assert re.search(r"Window .*\[_cut", plan), plan
    values = [(float(v), f"k{i:03}") for i, v in enumerate([0.0, 0.0, 1e-7, 3, 3.01, 3.01, 250, 9e8, 9e8, 17, 17.2])] + [(None, "none"), (-2.0, "below")]
    df = spark.createDataFrame(values, "v double, key string")
    got = [(r.key, r["rank"]) for r in rankings.ranked(df, "v", ["key"]).orderBy("rank").collect()]
    order = sorted(values, key=lambda x: (x[0] is None, -(x[0] or 0), x[1]))
    assert got == [(k, i) for i, (_, k) in enumerate(order, 1)]


def test_published_series_equal_those_of_the_fact(published):  # noqa: F811
    m, cfg = published
    for by_cause in (False, True):
        ours = {tuple(r) for r in api.series(m, cfg, by_cause=by_cause).collect()}
        assert ours == {tuple(r) for r in api.series(m.master, cfg, by_cause=by_cause).collect()}
    for fn in (api.channel, api.pscore, api.smoothed):
        assert {tuple(r) for r in fn(m, cfg, year=2024).collect()} == {tuple(r) for r in fn(m.master, cfg, year=2024).collect()}
    assert m.rows == m.master.count()
    assert list(m.years) == sorted({r.year for r in m.master.select("year").distinct().collect()})


def test_selectors_are_sorted(published):  # noqa: F811
    m, cfg = published
    rows = api.selectors(m, cfg).orderBy("kind", "position").collect()
    listed = {k: [r.value for r in rows if r.kind == k] for k in ("year", "area", "age_group")}
    assert listed["year"] == [str(y) for y in sorted(m.years, reverse=True)]
    assert listed["area"] == ["Norte", "Sur", "Tomé"]
    assert listed["age_group"] == sorted(C.FEED_AGE_COLUMNS.values())


def test_global_means_all_territories(published):  # noqa: F811
    m, cfg = published
    for kind in ("week_by_level", "causes_by_level", "who"):
        assert ({tuple(r) for r in api.profile(m, cfg, kind, area="Global").collect()}
                == {tuple(r) for r in api.profile(m, cfg, kind).collect()} != set())


def test_series_for_other_targets_come_from_the_cube(spark, published, tmp_path):  # noqa: F811
    m, cfg = published
    root = re.search(r"file:(\S+)/v-", m.master.inputFiles()[0].replace("file://", "file:"))[1]
    other = cfg.with_(target_causes=("Influenza",))
    n = api.load(spark, root, other)
    assert {r.target for r in n.weekly_by_cause.select("target").distinct().collect()} == {"Influenza"}
    assert fact_scans(n.weekly_by_cause) == 0
    with pytest.raises(FileNotFoundError):
        api.load(spark, str(tmp_path), cfg)


def _publish(spark, root, feed_rows):
    feed = spark.createDataFrame(feed_rows, FEED_SCHEMA)
    areas = {r[10] for r in feed_rows}
    pop = _pop(spark, [(a, 2019, g, 100.0) for a in areas for g in C.FEED_AGE_COLUMNS.values()])
    feed.write.mode("overwrite").parquet(f"{root}/feed")
    pop.write.mode("overwrite").parquet(f"{root}/pop")
    return api.run_etl(spark, f"{root}/feed", f"{root}/pop", f"{root}/master", C.surveillance_defaults())


def test_an_area_called_global_is_refused(spark, scratch):
    ok, message, _ = _publish(spark, scratch, [_row(area="Global")])
    assert not ok and "Global" in message
    assert refresh.current_version(spark, f"{scratch}/master") is None


def test_pointer_is_replaced_in_one_step_and_is_relative(spark, scratch, monkeypatch):
    ok, message, _ = _publish(spark, scratch, [_row()])
    assert ok, message
    root = f"{scratch}/master"
    first = refresh.current_version(spark, root)
    with open(f"{root}/CURRENT") as f:
        assert f.read().strip() == os.path.basename(first)
    # A writer that dies before the rename leaves the old pointer whole.
    before = os.listdir(root)
    real = refresh._jvm_fs

    class Broken:
        def __init__(self, fs):
            self.fs = fs

        def create(self, p, over):
            assert not over, "the live pointer must not be truncated"
            self.fs.create(p, over).close()
            raise OSError("lost")

    monkeypatch.setattr(refresh, "_jvm_fs", lambda s, p: (real(s, p)[0], Broken(real(s, p)[1])))
    with pytest.raises(OSError):
        refresh._write_text(spark, f"{root}/CURRENT", "v-none\n")
    monkeypatch.undo()
    assert refresh.current_version(spark, root) == first
    assert "CURRENT" in before
    with open(f"{first}/{refresh.MANIFEST}") as f:
        assert json.load(f)["rows"] == 5


def test_load_checks_columns(spark, scratch):
    ok, _ = refresh.publish(spark, scratch, lambda p: spark.range(3).write.parquet(p))
    assert ok
    with pytest.raises(MissingColumnsError):
        api.load(spark, scratch, C.surveillance_defaults())


def test_fingerprint_sees_a_file_rewritten_below_a_partition(spark, scratch):
    p = f"{scratch}/t"
    spark.range(10).withColumn("k", F.col("id") % 2).write.partitionBy("k").parquet(p)
    first = store.fingerprint(spark, [p])
    assert store.fingerprint(spark, [p]) == first
    folder = f"{p}/k=0"
    name = next(n for n in os.listdir(folder) if n.endswith(".parquet"))
    top = os.stat(p).st_mtime
    os.utime(f"{folder}/{name}", (1, 10_000))
    assert os.stat(p).st_mtime == top
    assert store.fingerprint(spark, [p]) != first


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="test tables not present")
def test_analysis_options_do_not_change_stored_tables(spark):
    d, cfg = "/root/testdata/sf0.001", C.driver_defaults()
    for change in ({"top_facilities": 20}, {"week_window": (1, 53)}, {"smoothing_window": 3}, {"eval_year": 2000}):
        other = cfg.with_(**change)
        assert landing._master_key(spark, d, other) == landing._master_key(spark, d, cfg)
        assert landing._series_key(spark, d, other) == landing._series_key(spark, d, cfg)
    assert landing._master_key(spark, d, cfg.with_(target_years=(2000,))) == landing._master_key(spark, d, cfg)
    assert landing._master_key(spark, d, cfg.with_(service="OTHER")) != landing._master_key(spark, d, cfg)


def test_second_caller_waits_for_the_first(spark, scratch):
    import threading
    import uuid

    spark.conf.set("spark.epiwatch.namespace", "t-" + uuid.uuid4().hex[:8])
    try:
        calls, go = [], threading.Event()

        def write(path):
            calls.append(path)
            go.wait(20)
            spark.range(5).write.parquet(path)

        out = []
        threads = [threading.Thread(target=lambda: out.append(store.materialise(spark, "tbl", "k", write))) for _ in range(3)]
        [t.start() for t in threads]
        go.set()
        [t.join() for t in threads]
        assert len(calls) == 1 and len(set(out)) == 1

        def failing(path):
            raise ValueError("no")

        with pytest.raises(ValueError):
            store.materialise(spark, "tbl2", "k", failing)
        assert store.materialise(spark, "tbl2", "k", write)  # the claim was released
    finally:
        spark.conf.unset("spark.epiwatch.namespace")


def test_a_refresh_writes_only_the_years_that_changed(spark, scratch, monkeypatch):
    def rows(late=3, years=(2018, 2019, 2022)):
        return [_row(area=a, cause=c, year=y, week=w, fac=f"Hospital {a}", counts=(late if (y, w) == (2019, 5) else 1, 2, 3, 4, 5))
                for y in years for w in range(1, 8) for a in ("Norte", "Sur") for c in ("Influenza (J09-J11)", "Neumonía (J12-J18)")]

    cfg, root = C.surveillance_defaults(), f"{scratch}/one"
    tables = (refresh.MASTER, refresh.CUBE, refresh.PLACES, refresh.CAUSES, refresh.WEEKLY, refresh.WEEKLY_BY_CAUSE)

    def content(at):
        out = {}
        for t in tables:
            df = refresh.read_current(spark, f"{at}/master", t)
            out[t] = sorted((tuple(r) for r in df.select(sorted(df.columns)).collect()), key=str)
        return out

    def written_years():
        v = refresh.current_version(spark, f"{root}/master")
        return sorted(n for n in os.listdir(f"{v}/master") if n.startswith("year="))

    assert _publish(spark, root, rows())[0] and len(written_years()) == 3
    first = refresh.current_version(spark, f"{root}/master")
    ok, message, audit = _publish(spark, root, rows())  # the same rows in other files
    assert ok and "unchanged" in message and audit["rows"] == 0
    assert refresh.current_version(spark, f"{root}/master") == first

    ok, message, audit = _publish(spark, root, rows(late=9))
    assert ok and written_years() == ["year=2019"] and audit["rows"] == len(rows()) // 3 * 5
    assert _publish(spark, f"{scratch}/full", rows(late=9))[0]
    assert content(root) == content(f"{scratch}/full")
    m, n = api.load(spark, f"{root}/master", cfg), api.load(spark, f"{scratch}/full/master", cfg)
    assert (m.years, m.rows) == (n.years, n.rows) == ((2018, 2019, 2022), len(rows()) * 5)
    assert {tuple(r) for r in api.ranking(m, cfg, "causes", year=2018).collect()} == {tuple(r) for r in api.ranking(n, cfg, "causes", year=2018).collect()}

    before = content(root)  # a failure leaves the old version
    monkeypatch.setattr(refresh, "read_parts", lambda *a: 1 / 0)
    ok, message, _ = _publish(spark, root, rows(late=11))
    monkeypatch.undo()
    assert not ok and "ZeroDivisionError" in message and content(root) == before

    assert _publish(spark, root, rows(late=9, years=(2018, 2022)))[0]  # a year less
    assert _publish(spark, f"{scratch}/less", rows(years=(2018, 2022)))[0]
    assert content(root) == content(f"{scratch}/less")
    assert api.load(spark, f"{root}/master", cfg).years == (2018, 2022)
