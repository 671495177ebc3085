"""Scores from earlier opens, and re-ranking by them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HALF_LIFE_DAYS, HORIZON_DAYS, SAME_QUERY = 14, 90, 100
DAY = 86_400


def opens(events: DataFrame) -> DataFrame:
    """(query, path, count, last_open) from single opens (query, path, at): seconds; blank queries don't count."""
    q = F.substring(F.lower(F.trim("query")), 1, 512)
    return events.withColumn("query", q).filter("query <> ''").groupBy("query", "path").agg(F.count(F.lit(1)).alias("count"), F.max("at").alias("last_open"))


def record(opened: DataFrame, events: DataFrame, now: float) -> DataFrame:
    """The stored counters after more opens; those not opened within the horizon are erased."""
    both = opened.select("query", "path", "count", "last_open").unionByName(opens(events))
    summed = both.groupBy("query", "path").agg(F.sum("count").alias("count"), F.max("last_open").alias("last_open"))
    return summed.filter(F.col("last_open") > now - HORIZON_DAYS * DAY)


def scores(opened: DataFrame, query: str, now: float) -> DataFrame:
    """(path, history): each row's log1p(count), halved every 14 days, a hundredfold for the same query; 90 days back."""
    q = query.strip().lower()[:512]
    age = F.greatest(F.lit(0.0), F.lit(float(now)) - F.col("last_open")) / DAY
    weight = F.log1p("count") * F.pow(F.lit(0.5), age / HALF_LIFE_DAYS) * F.when(F.col("query") == q, SAME_QUERY).otherwise(1)
    return opened.filter(F.col("last_open") > now - HORIZON_DAYS * DAY).groupBy("path").agg(F.sum(weight).alias("history"))


def rerank(results: DataFrame, history: DataFrame, tiers: list[str] | None = None) -> DataFrame:
    """results by tiers (true first), then history, then their position; results has path and position."""
    joined = results.join(history, "path", "left").withColumn("history", F.coalesce("history", F.lit(0.0)))
    return joined.orderBy(*[F.desc(t) for t in tiers or []], F.desc("history"), "position")
