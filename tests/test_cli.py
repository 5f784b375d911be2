"""Command line: ETL on landed files, then an analysis on the published master."""

import json

from epiwatch import config as C
from epiwatch.__main__ import main

from test_etl import FEED_SCHEMA, _pop, _row


def test_cli_etl_and_show(spark, scratch, capsys):
    rows = [_row(year=y, week=w) for y in (2014, 2015, 2016) for w in range(1, 8)]
    spark.createDataFrame(rows, FEED_SCHEMA).write.parquet(f"{scratch}/feed")
    _pop(spark, [("Tomé", y, g, 100.0) for y in (2014, 2015, 2016) for g in C.FEED_AGE_COLUMNS.values()]) \
        .write.parquet(f"{scratch}/pop")
    assert main(["etl", "--feed", f"{scratch}/feed", "--population", f"{scratch}/pop", "--out", f"{scratch}/m"]) == 0
    out = json.loads(capsys.readouterr().out.strip().splitlines()[-1])
    assert out["ok"] and out["audit"]["rows"] == 105
    assert main(["show", "--master", f"{scratch}/m", "ranking", "--kind", "areas", "--year", "2016"]) == 0
    assert "Tomé" in capsys.readouterr().out


def test_cli_show_series_and_query(spark, scratch, capsys):
    rows = [_row(year=y, week=w) for y in (2014, 2015, 2016, 2017) for w in range(1, 13)]
    spark.createDataFrame(rows, FEED_SCHEMA).write.parquet(f"{scratch}/feed")
    _pop(spark, [("Tomé", y, g, 100.0) for y in (2014, 2015, 2016, 2017) for g in C.FEED_AGE_COLUMNS.values()]) \
        .write.parquet(f"{scratch}/pop")
    assert main(["etl", "--feed", f"{scratch}/feed", "--population", f"{scratch}/pop", "--out", f"{scratch}/m"]) == 0
    capsys.readouterr()
    assert main(["show", "--master", f"{scratch}/m", "channel", "--scope", C.GLOBAL_SCOPE, "--year", "2017"]) == 0
    assert "q1" in capsys.readouterr().out
    assert main(["show", "--master", f"{scratch}/m", "pscore_summary", "--year", "2017"]) == 0
    assert "severity" in capsys.readouterr().out
    assert main(["query", "/root/testdata/sf0.001", "kpi_totals"]) == 0
    assert "total_visits" in capsys.readouterr().out


def test_cli_selections(spark, scratch, capsys):
    rows = [_row(year=y, week=w) for y in (2014, 2015, 2016, 2017) for w in range(1, 54)]
    spark.createDataFrame(rows, FEED_SCHEMA).write.parquet(f"{scratch}/feed")
    _pop(spark, [("Tomé", y, g, 100.0) for y in (2014, 2015, 2016, 2017) for g in C.FEED_AGE_COLUMNS.values()]) \
        .write.parquet(f"{scratch}/pop")
    with open(f"{scratch}/options.json", "w") as f:
        json.dump({"baseline_years": [2014, 2016], "target_years": [2017], "top_causes": 1}, f)
    options = ["--config", f"{scratch}/options.json"]
    assert main(["etl", "--feed", f"{scratch}/feed", "--population", f"{scratch}/pop", "--out", f"{scratch}/m", *options]) == 0

    def show(*args) -> str:
        capsys.readouterr()
        assert main(["show", "--master", f"{scratch}/m", *args, *options]) == 0
        return capsys.readouterr().out

    assert "|780.0" in show("kpis", "--year", "2017")  # weeks 1-52 of 15 visits
    assert "|795.0" in show("kpis", "--year", "2017", "--weeks", "1", "53")
    assert show("zones", "--year", "2017", "--week", "7").count("|Tomé") == 1
    # The first full window of two rows ends in week 2, of eight in week 5.
    two, eight = show("smoothed", "--year", "2017", "--window", "2"), show("smoothed", "--year", "2017", "--window", "8")
    assert two.count("NULL") < eight.count("NULL")
    assert "|2016 " in show("forecast", "--target-years", "2016").replace("       ", " ").replace("|  ", "|")
    assert "|2017 " in show("selectors")
