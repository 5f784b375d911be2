"""Wall time, stage count and shuffle bytes of named queries.

    python tools/stage_profile.py /root/testdata/sf0.1 etl endemic_channel pscore_by_area moving_average forecast_by_cause

Spark's event log is written to a fresh scratch folder and read back; no UI or
REST endpoint is used.  "landing" lands the feed and population, "etl" builds
the master; both write into a fresh store namespace.
"""

from __future__ import annotations

import glob
import io
import json
import os
import sys
import tempfile
import time
import uuid

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def _events(evdir: str):
    import zstandard
    for f in glob.glob(os.path.join(evdir, "**", "*"), recursive=True):
        if not os.path.isfile(f) or "appstatus" in os.path.basename(f):
            continue
        raw = open(f, "rb").read()
        if f.endswith(".zstd"):
            raw = zstandard.ZstdDecompressor().stream_reader(io.BytesIO(raw)).read()
        for line in raw.decode("utf-8", "replace").splitlines():
            try:
                yield json.loads(line)
            except ValueError:
                continue


def main() -> None:
    sf_dir, names = sys.argv[1], sys.argv[2:]
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    evdir = tempfile.mkdtemp(prefix="epiwatch-events-")
    from pyspark.sql import SparkSession
    spark = (SparkSession.builder.master(f"local[{cpus}]").appName("epiwatch-profile")
             .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
             .config("spark.sql.shuffle.partitions", str(max(8, 2 * cpus)))
             .config("spark.eventLog.enabled", "true").config("spark.eventLog.dir", evdir)
             .getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    spark.conf.set("spark.epiwatch.namespace", "profile-" + uuid.uuid4().hex[:10])
    from epiwatch.plans.catalog import QUERIES
    from epiwatch.sources import landing
    walls = {}
    for name in names:
        spark.sparkContext.setJobGroup(name, name)
        t = time.perf_counter()
        if name == "landing":
            landing.raw_feed(spark, sf_dir)
            landing.population(spark, sf_dir)
        elif name == "etl":
            landing.master(spark, sf_dir)
        else:
            QUERIES[name](spark, sf_dir).collect()
        walls[name] = time.perf_counter() - t
    spark.stop()
    job_group, stage_job, out = {}, {}, {n: {"stages": 0, "shuffle_write_bytes": 0, "shuffle_read_bytes": 0}
                                         for n in names}
    for e in _events(evdir):
        if e["Event"] == "SparkListenerJobStart":
            g = (e.get("Properties") or {}).get("spark.jobGroup.id")
            for sid in e.get("Stage IDs", []):
                stage_job[sid] = g
        elif e["Event"] == "SparkListenerStageCompleted":
            si = e["Stage Info"]
            g = stage_job.get(si["Stage ID"])
            if g not in out:
                continue
            out[g]["stages"] += 1
            for acc in si.get("Accumulables", []):
                if acc.get("Name") == "internal.metrics.shuffle.write.bytesWritten":
                    out[g]["shuffle_write_bytes"] += int(acc.get("Value", 0))
                if acc.get("Name") in ("internal.metrics.shuffle.read.remoteBytesRead",
                                       "internal.metrics.shuffle.read.localBytesRead"):
                    out[g]["shuffle_read_bytes"] += int(acc.get("Value", 0))
    for n in names:
        out[n]["wall_sec"] = round(walls[n], 3)
    print(json.dumps({"sf_dir": sf_dir, "cpus": cpus, "queries": out}))


if __name__ == "__main__":
    main()
