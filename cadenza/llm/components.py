"""Connected components of a graph given as edges between 64-bit ids."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadenza.llm.storage import cut, free, made


def _mirror(edges: DataFrame) -> DataFrame:
    return edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))


def _large_star(edges: DataFrame) -> DataFrame:
    """Each node's larger neighbours move to the least node around it."""
    both = _mirror(edges)
    least = cut(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")))
    return both.filter(F.col("b") > F.col("a")).join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter(F.col("a") != F.col("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Each node and its smaller neighbours move to the least of them."""
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    least = cut(down.groupBy("a").agg(F.min("b").alias("m")))
    moved = down.join(least, "a")
    return moved.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b"))).filter(F.col("a") != F.col("b")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """``node`` and ``label`` (the least id of its component) for every node of an edge (columns ``a``, ``b``).

    Alternating stars: a logarithmic number of rounds, each linear in the edges and
    written to the shared folder.  Nodes of any degree are aggregated in parts, and
    their least neighbours are written before they meet the edges again, so that Spark
    can split the edges of a node with very many.
    """
    spark = edges.sparkSession
    now = cut(edges.filter(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    first = len(made(spark)) - 1
    state = None
    while True:
        now = cut(_small_star(cut(_large_star(now))))
        free(spark, first, keep=1)  # what the round read
        seen = tuple(now.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).head())
        if seen == state:
            break
        state = seen
    return now.select(F.col("a").alias("node"), F.col("b").alias("label")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("label"))).distinct()
