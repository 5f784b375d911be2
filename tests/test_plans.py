"""Physical-plan properties that matter at scale."""

import os

import pytest
from pyspark.sql import functions as F

from epiwatch.config import driver_defaults
from epiwatch.plans import catalog
from epiwatch.plans.etl import joined
from epiwatch.sources import landing

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables not present")


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_population_join_is_broadcast(spark):
    df = joined(landing.raw_feed(spark, SF), landing.population(spark, SF), driver_defaults())
    assert "BroadcastHashJoin" in _plan(df)


def test_master_scan_prunes_year_and_columns(spark):
    m = landing.master(spark, SF)
    df = m.where((F.col("year") == 2001) & (F.col("area") == "NATION_1")).select("visits")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(year" in plan and "= 2001" in plan
    assert "PushedFilters: [IsNotNull(area), EqualTo(area,NATION_1)]" in plan
    assert "ReadSchema: struct<area:string,visits:double>" in plan


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_no_python_in_query_plans(spark, name):
    plan = _plan(catalog.QUERIES[name](spark, SF))
    for node in ("BatchEvalPython", "ArrowEvalPython", "FlatMapGroupsInPandas", "MapInPandas"):
        assert node not in plan, (name, node)


def _window_specs(plan) -> list[str]:
    """Partition specs of every Window node of an executed (adaptive) plan."""
    out = []
    name = plan.nodeName()
    if name == "Window":
        out.append(plan.partitionSpec().toString())
    if name == "AdaptiveSparkPlan":
        out += _window_specs(plan.executedPlan())
    if "QueryStage" in name:
        out += _window_specs(plan.plan())
    it = plan.children().iterator()
    while it.hasNext():
        out += _window_specs(it.next())
    return out


def _forecast_plan(spark, by_target):
    from epiwatch.operators import forecast
    keys = ["scope", "target"] if by_target else ["scope"]
    return forecast.forecast(landing.weekly_series(spark, SF, driver_defaults(), by_target), keys, driver_defaults())


@pytest.mark.parametrize("by_target", [False, True])
def test_forecast_has_no_window_and_no_python(spark, by_target):
    df = _forecast_plan(spark, by_target)
    df.collect()
    plan = df._jdf.queryExecution().executedPlan()
    assert not _window_specs(plan)
    assert not any(node in plan.toString() for node in ("Pandas", "Python", "Arrow"))


@pytest.mark.parametrize("name", ["endemic_channel", "moving_average", "zone_by_week"])
def test_every_window_is_partitioned_by_series(spark, name):
    df = catalog.QUERIES[name](spark, SF)
    df.collect()
    specs = _window_specs(df._jdf.queryExecution().executedPlan())
    assert specs, name
    for spec in specs:
        assert "scope" in spec, (name, spec)   # never an un-partitioned (single-task) window


def _scans(plan) -> list[str]:
    """File scans executed by an adaptive plan (reused exchanges do not re-scan)."""
    out = []
    name = plan.nodeName()
    if name.startswith("Scan"):
        out.append(plan.toString())
    if name == "AdaptiveSparkPlan":
        out += _scans(plan.executedPlan())
    if "QueryStage" in name:
        out += _scans(plan.plan())
    it = plan.children().iterator()
    while it.hasNext():
        out += _scans(it.next())
    sub = plan.subqueries().iterator()
    while sub.hasNext():
        out += _scans(sub.next())
    return out


def test_fact_table_scanned_at_most_once_per_query(spark):
    for name, fn in catalog.QUERIES.items():
        df = fn(spark, SF)
        df.collect()
        master_scans = [s for s in _scans(df._jdf.queryExecution().executedPlan()) if "/master-" in s]
        assert len(master_scans) <= 1, (name, len(master_scans))


def test_broadcast_hint_respects_threshold(spark):
    from epiwatch.operators.joins import broadcast_if_small, broadcast_limit
    small = spark.range(10)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "10MB")
        assert broadcast_limit(small) == 10 * 1024 * 1024
        assert "broadcast" in broadcast_if_small(small)._jdf.queryExecution().logical().toString().lower()
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        assert "broadcast" not in broadcast_if_small(small)._jdf.queryExecution().logical().toString().lower()
        big = spark.range(10 ** 9)
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "10MB")
        assert "broadcast" not in broadcast_if_small(big)._jdf.queryExecution().logical().toString().lower()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_etl_on_year_partitioned_feed_has_no_shuffle(spark):
    from epiwatch.plans.etl import master_for_write
    raw, pop = landing.raw_feed(spark, SF), landing.population(spark, SF)
    plan = master_for_write(raw, pop, driver_defaults(), feed_by_year=True)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan
    # the only exchange is the broadcast of the population table
    assert plan.count("Exchange") == plan.count("BroadcastExchange") >= 1
    flat = master_for_write(raw, pop, driver_defaults(), feed_by_year=False)._jdf.queryExecution().executedPlan().toString()
    assert flat.count("Exchange") > flat.count("BroadcastExchange")


def _final_plan_string(df) -> str:
    df.collect()
    plan = df._jdf.queryExecution().executedPlan()
    return plan.executedPlan().toString() if plan.nodeName() == "AdaptiveSparkPlan" else plan.toString()


def test_no_cross_or_nested_loop_joins(spark):
    for name, fn in catalog.QUERIES.items():
        plan = _final_plan_string(fn(spark, SF))
        assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan, name


def test_etl_by_year_writes_without_a_sort(spark, scratch):
    """the long rows of a scan task are not sorted before the write, and keep the feed's order."""
    from epiwatch.plans.etl import master_for_write, write_master
    from epiwatch.sources.store import unsorted_write
    raw, pop = landing.raw_feed(spark, SF), landing.population(spark, SF)
    plan = master_for_write(raw, pop, driver_defaults(), feed_by_year=True)._jdf.queryExecution().executedPlan().toString()
    assert "Sort" not in plan
    before = spark.conf.get("spark.sql.maxConcurrentOutputFileWriters")
    write_master(raw, pop, driver_defaults(), f"{scratch}/m", feed_by_year=True)
    write_master(raw, pop, driver_defaults(), f"{scratch}/n", feed_by_year=False)
    assert spark.conf.get("spark.sql.maxConcurrentOutputFileWriters") == before
    m, n = spark.read.parquet(f"{scratch}/m"), spark.read.parquet(f"{scratch}/n")
    assert m.count() == n.count() and m.exceptAll(n.select(m.columns)).isEmpty()
    with unsorted_write(spark):  # more values than open files
        spark.range(2000).selectExpr("id", "id % 40 AS k").write.partitionBy("k").parquet(f"{scratch}/many")
    assert spark.read.parquet(f"{scratch}/many").groupBy("k").count().where("count = 50").count() == 40


def test_feed_is_aggregated_once(spark, scratch):
    """One aggregation from the lines to the feed, whatever the keys: repeated names, keys and
    nations, causes that differ by the mark alone, null keys, dates and segments."""
    import datetime
    from epiwatch.sources import driver_tables
    d = datetime.datetime(1998, 12, 31)
    tables = {
        "region": ("r_regionkey int, r_name string", [(0, "R"), (1, None)]),
        "nation": ("n_nationkey int, n_name string, n_regionkey int", [(0, "A", 0), (0, "A", 0), (1, "A", 0), (2, None, 1), (3, "A ", 0)]),
        "supplier": ("s_suppkey long, s_name string, s_nationkey int", [(5, "S", 0), (10, "S", 0), (10, "S", 1), (15, "S", 1), (7, "S", 0), (21, "S", 3), (29, None, 2), (33, "T", 1), (-4, "T", 1), (None, "S", 0), (12, "U", None)]),
        "part": ("p_partkey long, p_type string", [(1, "X"), (2, "  X"), (3, None), (3, "Y"), (None, "Z")]),
        "customer": ("c_custkey long, c_mktsegment string", [(1, "BUILDING"), (2, "OTHER"), (3, None), (4, "MACHINERY"), (4, "FURNITURE")]),
        "orders": ("o_orderkey long, o_custkey long, o_orderdate timestamp", [(k, 1 + k % 4, None if k == 3 else d - datetime.timedelta(days=100 * (k // 4))) for k in range(12)]),
        "lineitem": ("l_orderkey long, l_partkey long, l_suppkey long", [(k % 12, 1 + k % 3, (5, 10, 15, 7, 21, 29, 33, -4, 12, None)[k % 10]) for k in range(400)])}
    for name, (schema, rows) in tables.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{scratch}/{name}.parquet")
    feed = driver_tables.raw_feed(spark, scratch)
    k = "s_suppkey"
    for name in tables:
        spark.read.parquet(f"{scratch}/{name}.parquet").createOrReplaceTempView(f"t_{name}")
    want = spark.sql(f"""
        SELECT s_name facility, concat(n_name, if({k} % 7 = 0, ' ', '')) area, r_name region, if({k} % 2 = 1, concat('  ', p_type), p_type) cause,
               CASE WHEN {k} % 5 = 0 THEN 'Hospital Base' WHEN {k} % 5 = 1 THEN 'SAPU' WHEN {k} % 5 = 2 THEN 'SAR' WHEN {k} % 5 = 3 THEN 'Consultorio'
                    WHEN {k} % 10 = 9 THEN '  ' ELSE 'Instituto' END facility_type, if({k} % 10 = 3, 'OTHER', 'MAIN') service,
               year(o_orderdate) year, cast(floor((dayofyear(o_orderdate) - 1) / 7) + 1 as int) week, count(*) n_total,
               {", ".join(f"count_if(c_mktsegment = '{s}') n_{s.lower()}" for s in driver_tables.SEGMENTS)}
        FROM t_lineitem JOIN t_part ON l_partkey = p_partkey JOIN t_orders ON l_orderkey = o_orderkey JOIN t_customer ON o_custkey = c_custkey
             JOIN t_supplier ON l_suppkey = s_suppkey JOIN t_nation ON s_nationkey = n_nationkey JOIN t_region ON n_regionkey = r_regionkey
        GROUP BY 1, 2, 3, 4, 5, 6, 7, 8""")
    assert feed.columns == want.columns and [t for _, t in feed.dtypes] == [t for _, t in want.dtypes]
    assert feed.count() == want.count() > 20 and feed.exceptAll(want).isEmpty() and want.exceptAll(feed).isEmpty()
    plan = feed._jdf.queryExecution().executedPlan().toString()
    assert plan.split("== Initial Plan ==")[-1].count("HashAggregate") == 2
