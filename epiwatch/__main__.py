"""Command line: run the ETL on landed files, or a named analysis.

    python -m epiwatch etl --feed feed.parquet --population pop.parquet --out /shared/master
    python -m epiwatch show --master /shared/master channel --scope Global --year 2025
    python -m epiwatch query /root/testdata/sf0.01 endemic_channel      # registered test-data query
"""

from __future__ import annotations

import argparse
import json
import sys

from .config import Config, surveillance_defaults


def _session(master: str):
    from .session import get_session
    spark = get_session(master=master)
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def _config(path: str | None) -> Config:
    """The defaults, with the options of a JSON file (lists become tuples)."""
    if not path:
        return surveillance_defaults()
    with open(path, encoding="utf-8") as f:
        given = json.load(f)

    def fixed(v):
        return tuple(map(fixed, v)) if isinstance(v, list) else v

    return surveillance_defaults().with_(**{k: fixed(v) for k, v in given.items()})


def main(argv: list[str] | None = None) -> int:
    ap = argparse.ArgumentParser(prog="epiwatch")
    ap.add_argument("--spark-master", default="local[*]")
    sub = ap.add_subparsers(dest="cmd", required=True)

    etl = sub.add_parser("etl", help="clean, unpivot, join, rate and publish the master")
    etl.add_argument("--feed", required=True)
    etl.add_argument("--population", required=True)
    etl.add_argument("--out", required=True)
    etl.add_argument("--config", help="JSON file of Config options that differ from the defaults")
    show = sub.add_parser("show", help="run an analysis on a published master")
    show.add_argument("--master", required=True)
    show.add_argument("analysis", choices=["ranking", "profile", "kpis", "insights", "channel", "zones",
                                           "pscore", "pscore_summary", "smoothed", "forecast", "forecast_kpis", "selectors"])
    show.add_argument("--kind", help="ranking/profile kind, e.g. areas, causes, facilities, who")
    show.add_argument("--year", type=int)
    show.add_argument("--weeks", type=int, nargs=2, metavar=("FIRST", "LAST"), help="week window (default 1 52; a year may have 53)")
    show.add_argument("--week", type=int, help="one week of the zones")
    show.add_argument("--window", type=int, help="weeks of the moving average")
    show.add_argument("--target-years", type=int, nargs="+", help="years to forecast")
    show.add_argument("--scope")
    show.add_argument("--area")
    show.add_argument("--age")
    show.add_argument("--by-cause", action="store_true")
    show.add_argument("--config", help="JSON file of Config options that differ from the defaults")
    show.add_argument("--rows", type=int, default=60)
    q = sub.add_parser("query", help="run a registered query over a folder of test tables")
    q.add_argument("sf_dir")
    q.add_argument("name")
    q.add_argument("--rows", type=int, default=60)
    args = ap.parse_args(argv)

    spark = _session(args.spark_master)
    if args.cmd == "etl":
        from .plans.etl import run_pipeline
        ok, msg, audit = run_pipeline(spark, args.feed, args.population, args.out, _config(args.config))
        print(json.dumps({"ok": ok, "message": msg, "audit": audit}))
        return 0 if ok else 1
    if args.cmd == "query":
        from .plans.catalog import QUERIES
        QUERIES[args.name](spark, args.sf_dir).show(args.rows, truncate=False)
        return 0
    from . import api
    cfg = _config(args.config)
    weeks = tuple(args.weeks) if args.weeks else None
    m = api.load(spark, args.master, cfg)
    a = args.analysis
    if a in ("ranking", "profile"):
        df = getattr(api, a)(m, cfg, args.kind or ("areas" if a == "ranking" else "who"), year=args.year,
                             weeks=weeks, area=args.area, age=args.age)
    elif a in ("kpis", "insights"):
        df = getattr(api, a)(m, cfg, year=args.year, weeks=weeks, area=args.area, age=args.age)
    elif a in ("forecast", "forecast_kpis"):
        df = getattr(api, a)(m, cfg, scope=args.scope, by_cause=args.by_cause,
                             target_years=tuple(args.target_years) if args.target_years else None)
    elif a == "selectors":
        df = api.selectors(m, cfg)
    elif a == "zones":
        df = api.zones(m, cfg, year=args.year, scope=args.scope, week=args.week)
    elif a == "smoothed":
        df = api.smoothed(m, cfg, year=args.year, scope=args.scope, window=args.window)
    else:
        df = getattr(api, a)(m, cfg, year=args.year, scope=args.scope)
    df.show(args.rows, truncate=False)
    return 0


if __name__ == "__main__":
    sys.exit(main())
