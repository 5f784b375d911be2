"""Weekly snapshot refresh with staged publish (A5) and cache invalidation.

A snapshot is written to a new version folder, read back and validated
(required columns, minimum row count, optional extra check); only then is the
``CURRENT`` pointer switched to it, by renaming a complete new pointer over the
old one, so a reader sees the one or the other.  A failed write or validation leaves the
published version untouched.  Nothing is deleted: old versions stay until a
retention job removes them, so readers of the previous version are never cut
off mid-query.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable, Iterable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession

from ..config import YEAR
from ..operators.clean import require_columns
from .store import SUCCESS, _jvm_fs, path_exists

POINTER = "CURRENT"
MANIFEST = "MANIFEST.json"
MASTER, CUBE, WEEKLY, WEEKLY_BY_CAUSE = "master", "cube", "weekly", "weekly_by_cause"
PLACES, CAUSES = "places", "causes"
#: Tables with a folder for each year, which a version may leave to an earlier one.
BY_YEAR = (MASTER, CUBE, PLACES, CAUSES)
NO_YEAR = "__HIVE_DEFAULT_PARTITION__"


def _write_text(spark: SparkSession, path: str, text: str) -> None:
    """Replace the file at ``path`` in one step: write beside it, rename over it."""
    new, fs = _jvm_fs(spark, f"{path}.{uuid.uuid4().hex[:12]}.new")
    out = fs.create(new, False)
    try:
        out.write(bytearray(text.encode("utf-8")))
    finally:
        out.close()
    sc = spark.sparkContext
    hadoop = sc._jvm.org.apache.hadoop.fs
    files = hadoop.FileContext.getFileContext(new.toUri(), sc._jsc.hadoopConfiguration())
    options = sc._gateway.new_array(hadoop.Options.Rename, 1)
    options[0] = hadoop.Options.Rename.OVERWRITE
    files.rename(new, hadoop.Path(path), options)


def _read_text(spark: SparkSession, path: str) -> str | None:
    p, fs = _jvm_fs(spark, path)
    if not fs.exists(p):
        return None
    jvm = spark.sparkContext._jvm
    stream = fs.open(p)
    try:
        reader = jvm.java.io.BufferedReader(jvm.java.io.InputStreamReader(stream, "UTF-8"))
        line = reader.readLine()
        return None if line is None else str(line)
    finally:
        stream.close()


def current_version(spark: SparkSession, root: str) -> str | None:
    """Path of the published version, or None when nothing is published. The
    pointer holds a name relative to ``root``, so a published folder can move."""
    root = root.rstrip("/")
    name = _read_text(spark, f"{root}/{POINTER}")
    if name and path_exists(spark, f"{root}/{name}/{MASTER}/{SUCCESS}"):
        return f"{root}/{name}"
    return None


def read_parts(spark: SparkSession, root: str, parts: dict[str, list], table: str) -> DataFrame:
    """A table by year, put together from the versions that have its years."""
    frames = []
    for name, years in sorted(parts.items()):
        base = f"{root.rstrip('/')}/{name}/{table}"
        folders = [f"{base}/{YEAR}={NO_YEAR if y is None else y}" for y in years]
        frames.append(spark.read.option("basePath", base).parquet(*folders))
    return reduce(DataFrame.unionByName, frames)


def read_current(spark: SparkSession, root: str, table: str = MASTER) -> DataFrame:
    """A table of the published version."""
    v = current_version(spark, root)
    if v is None:
        raise FileNotFoundError(f"no published snapshot under {root}")
    parts = read_manifest(spark, root).get("parts") if table in BY_YEAR else None
    if parts and list(parts) != [v.rsplit("/", 1)[-1]]:
        return read_parts(spark, root, parts, table)
    return spark.read.parquet(f"{v}/{table}")


def read_manifest(spark: SparkSession, root: str) -> dict:
    """What was published: years, rows, and the options of its tables."""
    v = current_version(spark, root)
    text = _read_text(spark, f"{v}/{MANIFEST}") if v else None
    return json.loads(text) if text else {}


def publish(spark: SparkSession, root: str, write: Callable[[str], object],
            required: Iterable[str] = (), min_rows: int = 1,
            check: Callable[[DataFrame], str | None] | None = None,
            derive: Callable[[DataFrame, str], dict] | None = None) -> tuple[bool, str]:
    """Write a new version's master with ``write(path)``, validate it, add what
    ``derive(master, version)`` writes beside it and returns for the manifest,
    and publish the version.

    Returns ``(ok, message)``; on failure the previous version stays current.
    """
    root = root.rstrip("/")
    name = f"v-{time.strftime('%Y%m%dT%H%M%S')}-{uuid.uuid4().hex[:8]}"
    version = f"{root}/{name}"
    try:
        write(f"{version}/{MASTER}")
        df = spark.read.parquet(f"{version}/{MASTER}")
        require_columns(df, list(required), "snapshot")
        n = df.count()
        if n < min_rows:
            return False, f"snapshot has {n} rows (< {min_rows}); previous version kept"
        problem = check(df) if check else None
        if problem:
            return False, f"snapshot rejected: {problem}; previous version kept"
        manifest = {"rows": n, **(derive(df, version) if derive else {})}
        _write_text(spark, f"{version}/{MANIFEST}", json.dumps(manifest) + "\n")
    except Exception as exc:  # the old version stays published
        return False, f"snapshot failed: {type(exc).__name__}: {exc}"
    _write_text(spark, f"{root}/{POINTER}", name + "\n")
    spark.catalog.refreshByPath(root)
    return True, f"published {version} ({n} rows)"

