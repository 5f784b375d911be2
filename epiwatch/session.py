"""Session helper for tests, the benchmark and command-line runs."""

from __future__ import annotations

from pyspark.sql import SparkSession


def get_session(master: str = "local[8]", shuffle_partitions: int = 8, app: str = "epiwatch") -> SparkSession:
    return (SparkSession.builder.master(master).appName(app)
            .config("spark.ui.enabled", "false")
            .config("spark.ui.showConsoleProgress", "false")
            .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
            .config("spark.sql.adaptive.enabled", "true")
            .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
            .config("spark.sql.adaptive.skewJoin.enabled", "true")
            .config("spark.sql.session.timeZone", "UTC")
            .config("spark.driver.memory", "8g")
            .getOrCreate())
