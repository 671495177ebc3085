"""Rank fusion of channels into one result list."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestack.functions.batch import composed

# Each channel's weight and the limits of its list.
NAME, LITERAL_BASE, LITERAL, TEXT, MEANING, OFFSET = 3.0, 0.08, 1.0, 1.8, 1.3, 60
NAME_LIMIT, TEXT_LIMIT = 180, 360
KINDS = ("Filename match", "Text match", "Meaning match")
CARRIED = 3


def contribution(position, weight: float, base: float = 0.0):
    return F.lit(base) + F.lit(weight) / (position + OFFSET)


def fuse(hits: DataFrame) -> DataFrame:
    """(file_id, score, name_matched, match_kind, passage_ids) from hits (file_id, kind, score, position, passage_id).

    A channel counts once, by its best hit (so the two name lists are one channel); channels add up. passage_ids are
    those of carry_passages(), empty where no hit has one, and left out where hits has no passages. A file has few
    hits: every list is limited.
    """
    # Three channels at most: adding them in one fixed order makes sums equal everywhere.
    each = [F.max(F.when(F.col("kind") == k, F.col("score"))) for k in KINDS]
    met = [e.isNotNull().cast("int") for e in each]
    carried = []
    if "passage_id" in hits.columns:
        found = F.array_sort(F.collect_set(F.when(F.col("passage_id").isNotNull(), F.struct(_turn().alias("turn"), "position", "passage_id"))))
        carried = [F.slice(F.array_distinct(F.transform(found, lambda x: x["passage_id"])), 1, CARRIED).alias("passage_ids")]
    return hits.groupBy("file_id").agg(
        (F.coalesce(each[0], F.lit(0.0)) + F.coalesce(each[1], F.lit(0.0)) + F.coalesce(each[2], F.lit(0.0))).alias("score"),
        F.bool_or(F.col("kind") == KINDS[0]).alias("name_matched"),
        F.when(met[0] + met[1] + met[2] > 1, "Hybrid match").otherwise(F.min("kind")).alias("match_kind"),
        *carried,
    )


def final_order() -> list:
    """Files whose name matched come first; scores within 1e-7 are equal; then the smaller id."""
    return [F.desc("name_matched"), F.desc(F.round("score", 7)), F.col("file_id")]


def fill(lists: list[DataFrame], limit: int, order: list) -> DataFrame:
    """The first list, then as many rows of the next ones as the limit leaves; each list is limited by itself."""
    tagged = [x.orderBy(*order).limit(limit).withColumn("part", F.lit(i)) for i, x in enumerate(lists)]
    out = tagged[0]
    for x in tagged[1:]:
        out = out.unionByName(x)
    return out.orderBy("part", *order).limit(limit)


def merge_channels(hits: DataFrame, limit: int) -> DataFrame:
    """One row per path from several channels: hits has (path, file_id, is_document, name_matched, score, passages, channel).

    A catalog row beats one that only has metadata (negative id); of catalog rows the one with more passages
    stays, earlier channels first; name flags are united and the highest score counts.
    """
    rank = F.struct((F.col("file_id") > 0).alias("known"), F.when(F.col("file_id") > 0, F.col("passages")).otherwise(0).alias("passages"), (-F.col("channel")).alias("first"))
    one = hits.groupBy("path").agg(F.max_by(F.struct("file_id", "is_document", "passages"), rank).alias("row"), F.bool_or("name_matched").alias("name_matched"), F.max("score").alias("score"))
    out = one.select("path", "row.*", "name_matched", "score")
    return out.orderBy(F.desc("is_document"), F.desc("name_matched"), F.desc("score"), "path").limit(limit)


def group_by_name(results: DataFrame, limit: int | None = None) -> DataFrame:
    """Groups of results with the same file name in any case, in order of first appearance: results has (position, path, name).

    A path counts once, at its first position.
    """
    once = results.groupBy("path").agg(F.min_by(F.struct("position", "name"), "position").alias("r")).select("path", "r.*")
    groups = once.groupBy(F.lower(composed("name")).alias("group_key")).agg(F.min("position").alias("first_position"), F.transform(F.array_sort(F.collect_list(F.struct("position", "path"))), lambda x: x["path"]).alias("paths"))
    out = groups.orderBy("first_position", "group_key")
    return out.limit(limit) if limit else out


def _turn():
    """Text matches give a file's passages first, then meaning matches."""
    return F.when(F.col("kind") == KINDS[1], 0).when(F.col("kind") == KINDS[2], 1).otherwise(2)


def carry_passages(hits: DataFrame, most: int = CARRIED) -> DataFrame:
    """(file_id, passage_ids): up to three distinct passages per file; the text match's first, else the meaning match's."""
    first = hits.filter(F.col("passage_id").isNotNull()).groupBy("file_id", "passage_id").agg(F.min(F.struct(_turn().alias("turn"), "position")).alias("r"))
    w = Window.partitionBy("file_id").orderBy("r", "passage_id")
    kept = first.withColumn("n", F.row_number().over(w)).filter(F.col("n") <= most)
    return kept.groupBy("file_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "passage_id"))), lambda x: x["passage_id"]).alias("passage_ids"))
