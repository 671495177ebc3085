"""Quality of rankings against labelled answers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def metrics(ranked: DataFrame, truth: DataFrame) -> DataFrame:
    """One row (queries, top1, top5, mrr): ranked has (query_id, item_id, position from 0), truth (query_id, item_id).

    A query whose answer isn't ranked counts as zero.
    """
    place = truth.join(ranked, ["query_id", "item_id"], "left").groupBy("query_id").agg(F.min("position").alias("p"))
    p = F.col("p")
    hit = [F.avg(F.when(p < n, 1.0).otherwise(0.0)) for n in (1, 5)]
    return place.agg(F.count(F.lit(1)).alias("queries"), F.round(hit[0], 6).alias("top1"), F.round(hit[1], 6).alias("top5"), F.round(F.avg(F.coalesce(1.0 / (p + 1), F.lit(0.0))), 6).alias("mrr"))


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """One row (queries, recall): the mean share of each query's exact answers that was found."""
    per = exact.join(found.select("query_id", "item_id", F.lit(1).alias("hit")), ["query_id", "item_id"], "left").groupBy("query_id").agg((F.count("hit") / F.count(F.lit(1))).alias("r"))
    return per.agg(F.count(F.lit(1)).alias("queries"), F.round(F.avg("r"), 6).alias("recall"))
