"""Eager checks of arguments, made before a plan is built."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def text(value: str | None, name: str) -> str:
    if value is None or not value.strip():
        raise ValueError(f"{name} must be non-empty")
    return value


def positive(value: int | None, name: str) -> int:
    if isinstance(value, bool) or not isinstance(value, int) or value <= 0:
        raise ValueError(f"{name} must be a positive integer")
    return value


def number(value: float, name: str, *, low: float = -math.inf) -> float:
    if isinstance(value, bool) or not isinstance(value, (int, float)) or not math.isfinite(value) or value < low:
        raise ValueError(f"{name} must be a finite number" + (f" of at least {low:g}" if low > -math.inf else ""))
    return float(value)


def unique_ids(ids: list[str], name: str = "track_id") -> list[str]:
    if any(i is None or not str(i).strip() for i in ids):
        raise ValueError(f"{name} must be non-empty")
    if len(set(ids)) != len(ids):
        raise ValueError(f"{name} must be unique")
    return ids


def distinct_rows(df: DataFrame, column: str = "track_id") -> DataFrame:
    """Fail if an id is blank or comes twice; counted in parts, one row reaches the driver."""
    bad = df.groupBy(column).count().filter((F.col("count") > 1) | F.col(column).isNull() | (F.trim(column) == "")).limit(1).collect()
    if bad:
        raise ValueError(f"{column} must be non-empty and unique: {bad[0][0]!r}")
    return df
