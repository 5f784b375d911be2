"""Results do not depend on the number of executor threads (local[1] vs local[4]),
on ANSI mode, or on the session time zone."""

import json
import os
import subprocess
import sys

import pytest

from oracle_harness import value_hash

SF = "/root/testdata/sf0.001"
NAMES = ["top_areas", "overview_bundle", "endemic_channel", "pscore_by_area", "moving_average",
         "forecast_kpis", "forecast_cause_kpis", "row_rate"]
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables not present")

CHILD = r"""
import json, sys, uuid
sys.path.insert(0, sys.argv[1]); sys.path.insert(0, sys.argv[1] + "/tests")
from pyspark.sql import SparkSession
spark = (SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false")
         .config("spark.sql.shuffle.partitions", "3").config("spark.sql.ansi.enabled", "false")
         .config("spark.sql.session.timeZone", "America/Santiago").getOrCreate())
spark.sparkContext.setLogLevel("ERROR")
spark.conf.set("spark.epiwatch.namespace", "par-" + uuid.uuid4().hex[:8])   # recompute everything
from epiwatch.plans.catalog import QUERIES
from oracle_harness import value_hash
print("RESULT " + json.dumps({n: value_hash(QUERIES[n](spark, sys.argv[2]).toPandas()) for n in sys.argv[3:]}))
"""


def test_single_thread_results_equal_multi_thread(spark):
    from epiwatch.plans.catalog import QUERIES
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    out = subprocess.run([sys.executable, "-c", CHILD, root, SF, *NAMES], capture_output=True, text=True,
                         timeout=900)
    line = [x for x in out.stdout.splitlines() if x.startswith("RESULT ")]
    assert line, out.stderr[-2000:]
    single = json.loads(line[-1][len("RESULT "):])
    for n in NAMES:
        assert value_hash(QUERIES[n](spark, SF).toPandas()) == single[n], n
