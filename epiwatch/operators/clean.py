"""Cleaning operators of the weekly feed.

All are narrow projections/filters: they fuse into one whole-stage-codegen
span after the Parquet scan, and the domain filter is pushed into the scan.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..config import AREA, CAUSE, FEED_COLUMNS, SERVICE, YEAR, Config
from ..functions.text import blank_to_null, replace_all, utrim


class MissingColumnsError(ValueError):
    """A required input column is absent (the feed renamed or dropped it)."""


def require_columns(df: DataFrame, required: Iterable[str], what: str = "input") -> None:
    missing = [c for c in required if c not in df.columns]
    if missing:
        raise MissingColumnsError(f"{what} lacks required column(s) {missing}; "
                                  f"present: {sorted(df.columns)}")


def rename_present(df: DataFrame, mapping: Mapping[str, str]) -> DataFrame:
    """Rename only the columns that exist."""
    present = {k: v for k, v in mapping.items() if k in df.columns and k != v}
    return df.withColumnsRenamed(present) if present else df


def standardise_feed(df: DataFrame) -> DataFrame:
    """Source column names -> engine names, for the columns present."""
    return rename_present(df, FEED_COLUMNS)


def filter_service(df: DataFrame, service: str) -> DataFrame:
    """Domain equality filter (B1); pushed to the Parquet scan."""
    return df.where(F.col(SERVICE) == F.lit(service))


def exclude_causes(df: DataFrame, labels: Iterable[str]) -> DataFrame:
    """Drop rows whose trimmed cause is one of the trimmed labels (B2).

    A NULL cause yields NULL here and is dropped; in the source system it
    survives this step and is dropped by the null rule right after, so the
    end result is the same.
    """
    trimmed = [lab.strip() for lab in labels]
    if not trimmed:
        return df
    return df.where(~utrim(CAUSE).isin(trimmed))


def fix_spelling(df: DataFrame, pairs, columns: Iterable[str]) -> DataFrame:
    """Regex spelling dictionary over the given text columns, if present."""
    cols = {c: replace_all(c, pairs) for c in columns if c in df.columns}
    return df.withColumns(cols) if cols and pairs else df


def blanks_to_null(df: DataFrame) -> DataFrame:
    """Whitespace-only text -> NULL in every string column."""
    cols = {f.name: blank_to_null(f.name) for f in df.schema.fields
            if isinstance(f.dataType, StringType)}
    return df.withColumns(cols) if cols else df


def drop_incomplete(df: DataFrame, subset: Iterable[str] | None = None) -> DataFrame:
    """Drop rows with a NULL (or NaN) in any column, or in ``subset``."""
    return df.na.drop(how="any", subset=list(subset) if subset else None)


def drop_present(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    """Drop columns if present (B6); absent names are ignored."""
    return df.drop(*[c for c in columns if c in df.columns])


def to_int(col: str):
    """Truncating integer cast that also accepts text such as '2014.0' (N8)."""
    return F.col(col).cast("double").cast("int")


def normalise_keys(df: DataFrame, text_keys: Iterable[str], int_keys: Iterable[str] = (YEAR,)) -> DataFrame:
    """Join-key normalisation (B8): integer keys, Unicode-trimmed text keys."""
    cols = {k: to_int(k) for k in int_keys if k in df.columns}
    cols.update({k: utrim(F.col(k).cast("string")) for k in text_keys if k in df.columns})
    return df.withColumns(cols)


def clean_feed(raw: DataFrame, cfg: Config) -> DataFrame:
    """B1 -> B2 -> B3 -> B4 -> B5 -> B6 on the standardised wide feed."""
    df = standardise_feed(raw)
    require_columns(df, [SERVICE, CAUSE, AREA, YEAR], "weekly feed")
    df = filter_service(df, cfg.service)
    df = exclude_causes(df, cfg.excluded_causes)
    df = fix_spelling(df, cfg.spelling, cfg.spelling_columns)
    df = blanks_to_null(df)
    df = drop_incomplete(df, cfg.required_only)
    return drop_present(df, cfg.drop_columns)
