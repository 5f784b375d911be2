"""Property tests (Hypothesis) against pandas semantics and simple invariants."""

import math

import numpy as np
import pandas as pd
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from epiwatch.operators.rates import row_rate
from epiwatch.operators.reshape import interpolate_linear
from epiwatch.operators.trend import centred_mean

SETTINGS = settings(max_examples=15, deadline=None, suppress_health_check=list(HealthCheck))
values = st.lists(st.one_of(st.none(), st.floats(0, 1000, allow_nan=False)), min_size=1, max_size=25)


def _frame(spark, vals):
    return spark.createDataFrame([("G", i + 1, v) for i, v in enumerate(vals)], "scope string, week int, x double")


@SETTINGS
@given(vals=values)
def test_interpolation_property(spark, vals):
    got = [r.y for r in _frame(spark, vals).select("week", interpolate_linear("x", ["scope"]).alias("y"))
           .orderBy("week").collect()]
    exp = pd.Series(vals, dtype=float).interpolate(method="linear").tolist()
    for g, e in zip(got, exp):
        assert (g is None and math.isnan(e)) or abs(g - e) <= 1e-9 * max(1.0, abs(e))


@SETTINGS
@given(vals=values, window=st.integers(2, 8))
def test_moving_average_property(spark, vals, window):
    got = [r.y for r in _frame(spark, vals).select("week", centred_mean("x", window, ["scope"]).alias("y"))
           .orderBy("week").collect()]
    exp = pd.Series(vals, dtype=float).rolling(window=window, center=True).mean().tolist()
    for g, e in zip(got, exp):
        assert (g is None and math.isnan(e)) or abs(g - e) <= 1e-9 * max(1.0, abs(e))


@SETTINGS
@given(v=st.integers(0, 10_000), p=st.integers(0, 100_000), k=st.integers(1, 5))
def test_row_rate_zero_safe_and_linear(spark, v, p, k):
    df = spark.createDataFrame([(float(v), float(p)), (float(v * k), float(p))], "v double, p double")
    r = [x.r for x in df.select(row_rate(F.col("v"), F.col("p")).alias("r")).collect()]
    if p == 0:
        assert r == [0.0, 0.0]
    else:
        assert r[0] == float(np.round(v / p * 10000, 2))
        assert abs(r[1] - k * (v / p * 10000)) <= 0.005 + 1e-9
