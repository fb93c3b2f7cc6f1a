"""Ranking quality: nDCG, recall and reciprocal rank of result lists against graded judgments.

``results`` has ``query_id, rank`` (from 1) and ``track_id``; ``judgments`` has
``query_id, track_id, grade`` (0 to 3; relevant from 2).  Where nothing can be
measured the value is null, never 0.  Unjudged results keep their rank with gain 0.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def evaluate(results: DataFrame, judgments: DataFrame, *, k: int = 10, relevant: int = 2, least_judged: int = 3) -> DataFrame:
    """``query_id, ndcg, recall, rr`` of every judged query, null where its pool doesn't allow the measure."""
    gain = lambda g: F.pow(F.lit(2.0), g) - 1
    discount = lambda r: F.log(2.0, r + 1)
    order = Window.partitionBy("query_id").orderBy(F.desc("grade"), "track_id")
    ideal = judgments.withColumn("_r", F.row_number().over(order))
    pool = ideal.groupBy("query_id").agg(
        F.count("*").alias("judged"), F.count_if(F.col("grade") >= relevant).alias("relevant"), F.sum(F.when(F.col("_r") <= k, gain(F.col("grade")) / discount(F.col("_r")))).alias("idcg")
    )
    top = results.filter(F.col("rank") <= k).join(judgments, ["query_id", "track_id"], "left")
    got = top.groupBy("query_id").agg(
        F.sum(F.coalesce(gain(F.col("grade")), F.lit(0.0)) / discount(F.col("rank"))).alias("dcg"),
        F.count_if(F.col("grade") >= relevant).alias("hits"),
        F.min(F.when(F.col("grade") >= relevant, F.col("rank"))).alias("first"),
        F.count_if(F.col("grade").isNull()).alias("unjudged"),
    )
    met = pool.join(got, "query_id", "left")
    enough = F.col("judged") >= least_judged
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    return met.select(
        "query_id", "judged", "relevant",
        F.when(enough & (F.col("idcg") > 0), zero("dcg") / F.col("idcg")).alias("ndcg"),
        F.when(enough & (F.col("relevant") > 0), zero("hits") / F.col("relevant")).alias("recall"),
        F.when(enough & (F.col("relevant") > 0), F.coalesce(1 / F.col("first"), F.lit(0.0))).alias("rr"),
        F.coalesce("unjudged", F.lit(0).cast("long")).alias("unjudged"),
    )


def means(measured: DataFrame) -> DataFrame:
    """Means over the queries that could be measured, and how many they were."""
    return measured.agg(*(F.avg(c).alias(f"mean_{c}") for c in ("ndcg", "recall", "rr")), *(F.count(c).alias(f"n_{c}") for c in ("ndcg", "recall", "rr")))
