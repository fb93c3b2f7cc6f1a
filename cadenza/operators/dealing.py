"""Dealing rows out over parts whose size doesn't grow with the stored tables behind them."""

from __future__ import annotations

from pyspark.sql import DataFrame

#: Bytes of stored tables for each part.
PART_BYTES = 4 << 20
_UNKNOWN = 1 << 62


def parts(df: DataFrame) -> int:
    """A part for every ``PART_BYTES`` of the files that ``df`` reads; tables that aren't files count by their known size or not at all."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = (int(leaves.apply(i).stats().sizeInBytes()) for i in range(leaves.length()))
    return -(-sum(s for s in sizes if s < _UNKNOWN) // PART_BYTES)


def _enough(df: DataFrame) -> int:
    """Parts that the session makes of ``df`` by itself: adaptive execution merges its shuffle partitions into about one for each core."""
    spark = df.sparkSession
    return min(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))


def deal(df: DataFrame, *keys: str) -> DataFrame:
    """``df`` dealt out by the keys where its tables need more parts than the session makes by itself; else as it is."""
    n = parts(df)
    return df.repartition(n, *keys) if n > _enough(df) else df


def look_up(rows: DataFrame, known: DataFrame, key: str, how: str = "left") -> DataFrame:
    """A join that keeps to ``rows``, by sorted parts where either side is large, so that no task holds a whole side.

    The known side is dealt out, and the rows follow it: a semi join slips below a deal of its rows and leaves the join undealt.
    """
    more = parts(known)
    n = parts(rows) + more
    return rows.join(known.repartition(n, key).hint("merge"), key, how) if n > _enough(rows) or more > 1 else rows.join(known, key, how)
