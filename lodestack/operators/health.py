"""Counts over the catalog."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Statuses per count. partial and needsOCR stand in two sets on purpose.
SETS = {"indexed": ("indexed", "partial", "needsOCR"), "pending": ("queued", "needsOCR"), "failed": ("failed", "locked", "denied", "partial"), "unsupported": ("unsupported",)}


def source_health(sources: DataFrame, files: DataFrame) -> DataFrame:
    """Every source with its number of files and of files by state, in name order regardless of case."""
    counts = files.groupBy("source_id").agg(F.count(F.lit(1)).alias("files"), *[F.sum(F.when(F.col("status").isin(*s), 1).otherwise(0)).alias(k) for k, s in SETS.items()])
    joined = sources.join(counts, "source_id", "left")
    return joined.select("source_id", "source_name", "availability", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("files", *SETS)]).orderBy(F.lower("source_name"), "source_id")


def statistics(files: DataFrame, passages: DataFrame, vectors: DataFrame) -> DataFrame:
    """One row: numbers of files, passages and vectors."""
    one = [t.agg(F.count(F.lit(1)).alias(n)) for n, t in (("files", files), ("passages", passages), ("vectors", vectors))]
    return one[0].crossJoin(one[1]).crossJoin(one[2])  # one row each


def orphan_contents(contents: DataFrame, files: DataFrame) -> DataFrame:
    """Contents that no file has any more."""
    return contents.join(files.select("content_id"), "content_id", "left_anti")


def unembedded(passages: DataFrame, vectors: DataFrame, files: DataFrame) -> DataFrame:
    """Passages of owned contents that lack a vector."""
    return passages.join(files.select("content_id"), "content_id", "left_semi").join(vectors.select("passage_id"), "passage_id", "left_anti")


def summary_json(sources: DataFrame, files: DataFrame, passages: DataFrame, vectors: DataFrame) -> str:
    """One JSON document about a catalog's health: its counts and those of each source."""
    import json

    counts = statistics(files, passages, vectors).first().asDict()
    return json.dumps({"counts": counts, "sources": [r.asDict() for r in source_health(sources, files).collect()]})  # one row per source
