"""Parquet sources with pre-flight guards."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession

from ..operators.clean import require_columns
from .store import path_exists


class MissingInputError(FileNotFoundError):
    """An input table is absent: the job stops before doing any work."""


def read_table(spark: SparkSession, path: str, required: Iterable[str] = (),
               what: str = "input") -> DataFrame:
    """``spark.read.parquet`` after checking that the path and columns exist."""
    if not path_exists(spark, path):
        raise MissingInputError(f"{what} not found: {path}")
    df = spark.read.parquet(path)
    require_columns(df, list(required), what)
    return df
