"""Adapter: synthetic star-schema test tables -> raw weekly feed + population.

This is the "landing" step of the pipeline on the test data (FIXTURES.md
section 3): it plays the role of the published weekly feed and of the
population projections.  Both are plain DataFrame jobs over the given tables.

Join order is chosen for scale (Catalyst does not reorder without CBO stats):
lineitem is joined to part first, to orders/customer second and to the supplier
dimension third, and aggregated once, by the feed's own keys; the big shuffles
carry narrow rows (year and week as one number, segment, facility type and
service as small codes).  nation/region are fixed-size dimensions and are broadcast.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.joins import broadcast_if_small

FACILITY_TYPES = ("Hospital Base", "SAPU", "SAR", "Consultorio", "  ", "Instituto")
SEGMENTS = ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _year(col: str):
    return F.year(F.col(col)).cast("int")


def _week(col: str):
    return (F.floor((F.dayofyear(F.col(col)) - 1) / 7) + 1).cast("int")


def raw_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wide weekly feed: one row per facility x area x cause x type x service x
    year x week with one visit-count column per age band."""
    li = _t(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey")
    part = _t(spark, sf_dir, "part").select("p_partkey", "p_type")
    orders = _t(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    cust = _t(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    supp = _t(spark, sf_dir, "supplier").select("s_suppkey", "s_name", "s_nationkey")
    nation = _t(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey")
    region = _t(spark, sf_dir, "region").select("r_regionkey", "r_name")

    # Year and week as one number, the segment as its place in the list (none: null).
    segment = F.nullif(F.array_position(F.array(*map(F.lit, SEGMENTS)), F.col("c_mktsegment")), F.lit(0)).cast("tinyint")
    order_info = (orders.join(cust, orders.o_custkey == cust.c_custkey)
                  .select("o_orderkey", (_year("o_orderdate") * 64 + _week("o_orderdate")).alias("time"), segment.alias("segment")))
    lines = (li.join(part, li.l_partkey == part.p_partkey)
             .join(order_info, li.l_orderkey == order_info.o_orderkey)
             .select("l_suppkey", "p_type", "time", "segment"))

    geo = (broadcast_if_small(nation)
           .join(broadcast_if_small(region),
                 F.col("n_regionkey") == F.col("r_regionkey"))
           .select("n_nationkey", "n_name", "r_name"))
    k = F.col("s_suppkey")
    kind = (F.when(k % 5 == 0, 0).when(k % 5 == 1, 1).when(k % 5 == 2, 2).when(k % 5 == 3, 3)
            .when(k % 10 == 9, 4).otherwise(5))
    facility = (supp.join(broadcast_if_small(geo), F.col("s_nationkey") == F.col("n_nationkey"))
                .select("s_suppkey", F.col("s_name").alias("facility"),
                        F.concat(F.col("n_name"), F.when(k % 7 == 0, F.lit(" ")).otherwise(F.lit("")))
                        .alias("area"),
                        F.col("r_name").alias("region"), (k % 2 == 1).alias("odd"),
                        (kind * 2 + F.when(k % 10 == 3, 1).otherwise(0)).cast("tinyint").alias("kind")))
    counts = [F.count(F.lit(1)).alias("n_total"),
              *(F.count_if(F.col("segment") == i).alias(f"n_{s.lower()}") for i, s in enumerate(SEGMENTS, 1))]
    feed = (lines.join(facility, lines.l_suppkey == facility.s_suppkey)
            .withColumn("cause", F.when(F.col("odd"), F.concat(F.lit("  "), F.col("p_type"))).otherwise(F.col("p_type")))
            .groupBy("facility", "area", "region", "cause", "kind", "time").agg(*counts))
    types = F.array(*map(F.lit, FACILITY_TYPES))
    return feed.select("facility", "area", "region", "cause",
                       types[F.floor(F.col("kind") / 2).cast("int")].alias("facility_type"),
                       F.when(F.col("kind") % 2 == 1, F.lit("OTHER")).otherwise(F.lit("MAIN")).alias("service"),
                       F.floor(F.col("time") / 64).cast("int").alias("year"), F.pmod("time", F.lit(64)).cast("int").alias("week"),
                       "n_total", *(f"n_{s.lower()}" for s in SEGMENTS))


def population(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Population per area x year x age group (customers per nation x segment,
    repeated for every order year; one cell is left out on purpose)."""
    cust = _t(spark, sf_dir, "customer").select("c_nationkey", "c_mktsegment")
    nation = _t(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    orders = _t(spark, sf_dir, "orders").select("o_orderdate")
    # The distinct order years: a scalar subquery whose result is bounded by the
    # number of calendar years, attached to each (area, age) cell and exploded.
    years = orders.select(F.sort_array(F.collect_set(_year("o_orderdate"))).alias("ys")).scalar()
    cells = (cust.join(broadcast_if_small(nation),
                       F.col("c_nationkey") == F.col("n_nationkey"))
             .where(~((F.col("n_nationkey") == 24) & (F.col("c_mktsegment") == "MACHINERY")))
             .groupBy(F.col("n_name").alias("area"), F.col("c_mktsegment").alias("age_group"))
             .agg(F.count(F.lit(1)).alias("population")))
    return (cells.select("area", F.explode(years).alias("year"), "age_group", "population")
            .select("area", F.col("year").cast("int").alias("year"), "age_group",
                    F.col("population").cast("bigint").alias("population")))
