"""Scalar semantics: Unicode trim/blank, spelling, rounding, division, classifier."""

from pyspark.sql import functions as F

from epiwatch import config as C
from epiwatch.functions import (blank_to_null, care_level, clip_lower, contains_ci, head_before,
                                map_labels, replace_all, round_half_even, safe_div, utrim)


def _one(spark, values, expr, dtype="string"):
    df = spark.createDataFrame([(v,) for v in values], f"x {dtype}")
    return [r[0] for r in df.select(expr(F.col("x"))).collect()]


def test_unicode_trim_and_blank(spark):
    assert _one(spark, ["  Tomé \t"], utrim) == ["Tomé"]
    assert _one(spark, [" ", "  ", "\x1c", "a"], blank_to_null) == [None, None, None, "a"]
    # Java's trim would keep the NBSP; Python's strip removes it
    assert _one(spark, [" x "], utrim) == ["x"]


def test_spelling_dictionary_in_order(spark):
    got = _one(spark, ["SAPU Tome Alto", "Región Del BíoBío", "Región Del Bíobío"],
               lambda c: replace_all(c, C.FEED_SPELLING))
    assert got == ["SAPU Tomé Alto", "Región Del BioBío", "Región del BioBío"]


def test_excluded_label_matching_is_exact_after_outer_trim(spark):
    from epiwatch.operators.clean import exclude_causes
    df = spark.createDataFrame([("  - Por covid-19, virus identificado U07.1 ",),
                                ("TOTAL CAUSA SISTEMA  RESPIRATORIO (J00-J98)",),
                                ("TOTAL CAUSA SISTEMA RESPIRATORIO (J00-J98)",),
                                ("Influenza (J09-J11)",)], "cause string")
    kept = [r.cause for r in exclude_causes(df, C.FEED_EXCLUDED_CAUSES).collect()]
    assert kept == ["TOTAL CAUSA SISTEMA RESPIRATORIO (J00-J98)", "Influenza (J09-J11)"]


def test_round_half_even_matches_numpy(spark):
    import numpy as np
    vals = [0.285, 0.125, 0.375, 2.665, 1.005, 28.4999, 0.5]
    got = _one(spark, vals, lambda c: round_half_even(c, 2), "double")
    assert got == [float(np.round(v, 2)) for v in vals]
    assert got[:4] == [0.28, 0.12, 0.38, 2.66]


def test_safe_division_and_clip(spark):
    df = spark.createDataFrame([(5.0, 0.0), (5.0, 2.0), (None, 1.0)], "a double, b double")
    out = df.select(safe_div("a", "b").alias("q"), clip_lower(F.col("a") - 6, 0.0).alias("c")).collect()
    assert [r.q for r in out] == [None, 2.5, None]
    assert [r.c for r in out] == [0.0, 0.0, None]   # NULL stays NULL (greatest would give 0)


def test_care_level_classifier(spark):
    got = _one(spark, ["Hospital X", "SAR Y", "Consultorio Cesar", None, "instituto z"], care_level)
    assert got == [C.LEVEL_HOSPITAL, C.LEVEL_PRIMARY, C.LEVEL_PRIMARY, C.LEVEL_OTHER, C.LEVEL_HOSPITAL]


def test_label_map_contains_and_head(spark):
    pairs = [("Influenza (J09-J11)", "Influenza")]
    assert _one(spark, ["Influenza (J09-J11)", "Otro"], lambda c: map_labels(c, pairs)) == ["Influenza", "Otro"]
    assert _one(spark, ["Neumonía (J12-J18)", None], lambda c: contains_ci(c, "NEUMO")) == [True, False]
    assert _one(spark, ["IRA Alta (J00-J06)", "Sin parentesis"], head_before) == ["IRA Alta", "Sin parentesis"]
