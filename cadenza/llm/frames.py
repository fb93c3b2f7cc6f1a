"""Carrying a table's own columns through an operator under names that can't clash.

Columns are told apart by their place and exact name, so names that differ in case
alone, or that hold dots and spaces, are columns like any other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def hide(df: DataFrame) -> DataFrame:
    """Every column of ``df`` as ``_c0``, ``_c1`` and so on."""
    return df.toDF(*(f"_c{i}" for i in range(len(df.columns))))


def hidden_fields(df: DataFrame) -> list[T.StructField]:
    return [T.StructField(f"_c{i}", f.dataType) for i, f in enumerate(df.schema)]


def place(df: DataFrame, name: str) -> str:
    """The hidden name of the column of exactly that name."""
    return f"_c{df.columns.index(name)}"


def take(df: DataFrame, *names: str) -> DataFrame:
    """The columns of exactly these names."""
    return hide(df).select(*(F.col(place(df, n)).alias(n) for n in names))


def restored(df: DataFrame, like: DataFrame, replace: dict[str, Column] | None = None, add: dict[str, Column] | None = None) -> DataFrame:
    """``like``'s columns back under their names; ``add``'s follow and win over columns of the same name in any case."""
    replace, add = replace or {}, add or {}
    taken = {k.lower() for k in add}
    own = [replace.get(c, F.col(f"_c{i}")).alias(c) for i, c in enumerate(like.columns) if c.lower() not in taken]
    return df.select(*own, *(v.alias(k) for k, v in add.items()))
