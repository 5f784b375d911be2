"""ETL on hand-made feeds in the source schema (surveillance defaults)."""

from pyspark.sql import functions as F

from epiwatch import config as C
from epiwatch.plans.etl import build_master, dashboard_view, joined, long_visits, run_pipeline
from epiwatch.sources.refresh import current_version, publish, read_current

FEED_SCHEMA = ("EstablecimientoCodigo string, RegionCodigo string, ComunaCodigo string, ServicioSaludCodigo string, "
               "DependenciaAdministrativa string, TipoUrgencia string, NivelComplejidad string, OrdenCausa string, "
               "EstablecimientoGlosa string, RegionGlosa string, ComunaGlosa string, ServicioSaludGlosa string, "
               "TipoEstablecimiento string, NivelAtencion string, Latitud double, Longitud double, Anio int, "
               "SemanaEstadistica int, Causa string, NumTotal bigint, NumMenor1Anio bigint, Num1a4Anios bigint, "
               "Num5a14Anios bigint, Num15a64Anios bigint, Num65oMas bigint")
SVC = C.FEED_SERVICE


def _row(area="Tome", ftype="Hospital Las Higueras", cause="Influenza (J09-J11)", lat=-36.7, year=2019,
         week=1, counts=(1, 2, 3, 4, 5), service=SVC, fac="SAPU Tome Alto"):
    return ("1", "8", "8103", "29", "d", "t", "n", "1", fac, "Región Del Bíobío", area, service, ftype, "u",
            lat, -73.1, year, week, cause, sum(counts)) + tuple(counts)


def _pop(spark, rows):
    return spark.createDataFrame(rows, "ComunaGlosa string, anio int, grupo_etario string, poblacion double")


def test_clean_unpivot_join_rate(spark):
    feed = spark.createDataFrame([
        _row(area="  Tome \t"),                              # NBSP around key, spelling fix -> Tomé
        _row(ftype=" "),                                     # NBSP-only cell -> null -> dropped
        _row(lat=None),                                           # null coordinate -> dropped
        _row(service="Otro Servicio"),                            # other service
        _row(cause="  - Por covid-19, virus identificado U07.1 "),  # excluded label
        _row(year=2020, counts=(5, 0, 0, 0, 0)),                  # zero population year
    ], FEED_SCHEMA)
    pop = _pop(spark, [("Tomé", 2019, g, 100.0) for g in C.FEED_AGE_COLUMNS.values()]
               + [("Tomé", 2020, "Menor1Anio", 0.0)])
    cfg = C.surveillance_defaults()
    lv = long_visits(feed, cfg)
    assert lv.count() == 10
    assert lv.agg(F.sum("visits")).first()[0] == 15 + 5          # visits invariant under unpivot
    m = build_master(feed, pop, cfg)
    rows = {(r.year, r.age_group): r for r in m.collect()}
    assert rows[(2019, "Menor1Anio")].area == "Tomé"
    assert rows[(2019, "Menor1Anio")].facility == "SAPU Tomé Alto"
    assert rows[(2019, "Menor1Anio")].region == "Región del BioBío"
    assert rows[(2019, "65oMas")].rate == 500.0                   # 5 / 100 * 10,000
    assert rows[(2020, "Menor1Anio")].population == 0.0 and rows[(2020, "Menor1Anio")].rate == 0.0
    assert rows[(2020, "1a4Anios")].population == 0.0               # orphan filled with 0
    assert "EstablecimientoCodigo" not in m.columns
    orphans = joined(feed, pop, cfg).where(F.col("population").isNull()).count()
    assert orphans == 4
    view = dashboard_view(m, cfg)
    assert {r.cause for r in view.collect()} == {"Influenza"}
    assert {r.care_level for r in view.collect()} == {C.LEVEL_HOSPITAL}


def test_nan_counts_as_missing(spark):
    """A NaN population gives population 0 and rate 0 and is an orphan; a NaN
    count is 0 where rows may be incomplete."""
    from epiwatch.operators.joins import orphan_audit
    from epiwatch.operators.rankings import null_audit, top_areas

    feed = spark.createDataFrame([_row(year=2019)], FEED_SCHEMA).withColumn(
        "NumMenor1Anio", F.lit(float("nan")))
    cfg = C.surveillance_defaults().with_(required_only=("cause",))
    pop = _pop(spark, [("Tomé", 2019, g, float("nan") if g == "65oMas" else 100.0) for g in C.FEED_AGE_COLUMNS.values()])
    m = build_master(feed, pop, cfg)
    rows = {r.age_group: r for r in m.collect()}
    assert rows["Menor1Anio"].visits == 0.0 and rows["Menor1Anio"].rate == 0.0
    assert rows["65oMas"].population == 0.0 and rows["65oMas"].rate == 0.0
    assert orphan_audit(joined(feed, pop, cfg)).first().orphan_rows == 1
    assert null_audit(pop).first().poblacion_nulls == 1
    assert top_areas(dashboard_view(m, cfg), cfg, F.lit(2019)).first().rate > 0


def test_duplicate_population_keys_fan_out(spark):
    feed = spark.createDataFrame([_row()], FEED_SCHEMA)
    pop = _pop(spark, [("Tomé", 2019, "Menor1Anio", 10.0), ("Tomé", 2019, "Menor1Anio", 20.0)])
    m = build_master(feed, pop, C.surveillance_defaults())
    assert m.where(F.col("age_group") == "Menor1Anio").count() == 2


def test_missing_column_fails_clearly(spark):
    import pytest
    from epiwatch.operators.clean import MissingColumnsError
    feed = spark.createDataFrame([_row()], FEED_SCHEMA).drop("Causa")
    with pytest.raises(MissingColumnsError):
        build_master(feed, _pop(spark, [("Tomé", 2019, "Menor1Anio", 1.0)]), C.surveillance_defaults())


def test_pipeline_publish_and_failed_refresh_keeps_old(spark, scratch):
    feed = spark.createDataFrame([_row()], FEED_SCHEMA)
    pop = _pop(spark, [("Tomé", 2019, g, 100.0) for g in C.FEED_AGE_COLUMNS.values()])
    feed.write.parquet(f"{scratch}/feed")
    pop.write.parquet(f"{scratch}/pop")
    ok, msg, audit = run_pipeline(spark, f"{scratch}/feed", f"{scratch}/pop", f"{scratch}/master",
                                  C.surveillance_defaults())
    assert ok, msg
    assert audit["rows"] == 5 and audit["orphan_rows"] == 0
    first = current_version(spark, f"{scratch}/master")
    assert read_current(spark, f"{scratch}/master").count() == 5
    # a refresh whose validation fails leaves the published version in place
    ok2, msg2 = publish(spark, f"{scratch}/master", lambda p: feed.limit(0).write.parquet(p), min_rows=1)
    assert not ok2 and current_version(spark, f"{scratch}/master") == first
    # a missing input stops before any work
    import pytest
    from epiwatch.sources.parquet import MissingInputError
    with pytest.raises(MissingInputError):
        run_pipeline(spark, f"{scratch}/nope", f"{scratch}/pop", f"{scratch}/master", C.surveillance_defaults())


def test_year_partitioned_feed_gives_same_master(spark, scratch):
    from epiwatch.sources.store import partition_columns
    rows = [_row(year=y, week=w) for y in (2018, 2019) for w in (1, 2)]
    feed = spark.createDataFrame(rows, FEED_SCHEMA)
    pop = _pop(spark, [("Tomé", y, g, 100.0) for y in (2018, 2019) for g in C.FEED_AGE_COLUMNS.values()])
    feed.write.partitionBy("Anio").parquet(f"{scratch}/feed_by_year")
    feed.write.parquet(f"{scratch}/feed_flat")
    pop.write.parquet(f"{scratch}/pop")
    assert partition_columns(spark, f"{scratch}/feed_by_year") == ["Anio"]
    assert partition_columns(spark, f"{scratch}/feed_flat") == []
    cfg = C.surveillance_defaults()
    out = {}
    for name in ("feed_by_year", "feed_flat"):
        ok, msg, audit = run_pipeline(spark, f"{scratch}/{name}", f"{scratch}/pop", f"{scratch}/m_{name}", cfg)
        assert ok, msg
        cols = ["year", "week", "age_group", "visits", "population", "rate"]
        out[name] = sorted(tuple(r) for r in read_current(spark, f"{scratch}/m_{name}").select(*cols).collect())
    assert out["feed_by_year"] == out["feed_flat"] and len(out["feed_flat"]) == 20


def test_extra_population_columns_flow_after_population(spark):
    feed = spark.createDataFrame([_row()], FEED_SCHEMA)
    pop = spark.createDataFrame([("Tomé", 2019, g, 100.0, "proj-2017") for g in C.FEED_AGE_COLUMNS.values()],
                                "ComunaGlosa string, Anio int, grupo_etario string, Poblacion double, fuente string")
    m = build_master(feed, pop, C.surveillance_defaults())
    cols = m.columns
    assert cols[-1] == "rate" and cols.index("fuente") == cols.index("population") + 1
    assert {r.fuente for r in m.collect()} == {"proj-2017"}
