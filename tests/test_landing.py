"""The landing adapter reproduces the counts published in FIXTURES.md section 3."""

import os

import pytest
from pyspark.sql import functions as F

from epiwatch.config import driver_defaults
from epiwatch.plans.etl import joined
from epiwatch.sources import landing

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables not present")


def test_fixture_counts(spark):
    raw, pop = landing.raw_feed(spark, SF), landing.population(spark, SF)
    assert raw.count() == 5026
    assert pop.count() == 644
    j = joined(raw, pop, driver_defaults())
    assert j.count() == 16295
    assert j.where(F.col("population").isNull()).count() == 3626


def test_filters_remove_published_row_counts(spark):
    raw = landing.raw_feed(spark, SF)
    assert raw.where(F.col("service") != "MAIN").count() == 510
    assert raw.where(F.col("facility_type") == "  ").count() == 512
    assert raw.where(F.trim(F.col("cause")) == "PROMO").count() == 949


def test_master_is_partitioned_by_year_and_complete(spark):
    m = landing.master(spark, SF)
    assert "year" in m.columns and m.count() == 16295
    assert m.where(F.col("rate").isNull() | F.col("population").isNull()).count() == 0
