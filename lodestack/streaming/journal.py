"""The change feed: events to scopes, a durable journal of dirty scopes, and counters of opens."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lodestack.functions.text import excluded
from lodestack.operators.incremental import MOST_PENDING, minimal_scopes

# Bits of an event's flags. Any of the first means that single paths can't be trusted.
MUST_SCAN, USER_DROPPED, KERNEL_DROPPED, IDS_WRAPPED, HISTORY_DONE, ROOT_CHANGED = 0x1, 0x2, 0x4, 0x8, 0x10, 0x20
LOST = MUST_SCAN | USER_DROPPED | KERNEL_DROPPED | ROOT_CHANGED | IDS_WRAPPED
DATA_VOLUME = "/System/Volumes/Data"


def real_path(path: Column) -> Column:
    """A path under its usual name: the data volume's and /private's aliases go."""
    p = F.regexp_replace(path, f"^{DATA_VOLUME}(?=/)", "")
    return F.regexp_replace(p, r"^/private(?=/(?:tmp|var)(?:/|$))", "")


def scope(path: Column, flags: Column, root: str, index_path: str = "", exclusions: list[str] | None = None) -> Column:
    """The folder to look at again for an event: '' for the whole root, null for none."""
    p = real_path(path)
    below = "/" if root == "/" else root + "/"
    relative = F.substring(p, F.lit(len(below) + 1), F.length(p))
    parent = F.regexp_replace(relative, r"/?[^/]*$", "")
    out = F.when(flags.bitwiseAND(LOST) != 0, "").when(flags.bitwiseAND(HISTORY_DONE) != 0, F.lit(None))
    if index_path:
        out = out.when((p == index_path) | p.startswith(index_path + "/"), F.lit(None))
    out = out.when((p == root) | (p == "/") | F.startswith(F.lit(root), F.concat(p, F.lit("/"))), "")
    return out.when(~p.startswith(below), F.lit(None)).when(excluded(relative, exclusions or []), F.lit(None)).otherwise(parent)


def route(events: DataFrame, root: str, index_path: str = "", exclusions: list[str] | None = None) -> DataFrame:
    """events (event_id, path, flags) with their scope; events that concern nothing are left out. Streams too."""
    return events.withColumn("scope", scope(F.col("path"), F.col("flags"), root, index_path, exclusions)).filter(F.col("scope").isNotNull())


def capture(pending: DataFrame, routed: DataFrame, limit: int = MOST_PENDING) -> DataFrame:
    """(stream, scope, id) after a batch: a scope named again gets its newest id; more than limit scopes of a
    stream become its whole root, with the newest id."""
    both = pending.select("stream", "scope", "id").unionByName(routed.select("stream", "scope", F.col("event_id").alias("id")))
    latest = both.groupBy("stream", "scope").agg(F.max("id").alias("id"))
    size = latest.groupBy("stream").agg(F.count(F.lit(1)).alias("n"), F.max("id").alias("last"))
    full = size.filter(F.col("n") > limit)
    rest = latest.join(full.select("stream"), "stream", "left_anti")
    return rest.unionByName(full.select("stream", F.lit("").alias("scope"), F.col("last").alias("id")))


def cursors(streams: DataFrame, events: DataFrame, current: int) -> DataFrame:
    """(stream, checkpoint) after a batch: the largest event id seen, never less than before. Where ids began anew (the
    wrapped flag), counting goes on from the current id and the events after that; events has (stream, position, event_id, flags)."""
    wrapped = F.col("flags").bitwiseAND(IDS_WRAPPED) != 0
    anew = events.filter(wrapped).groupBy("stream").agg(F.max("position").alias("anew"))
    later = events.filter(~wrapped & (F.col("event_id") > 0)).join(anew, "stream", "left").filter(F.col("anew").isNull() | (F.col("position") > F.col("anew")))
    top = later.groupBy("stream").agg(F.max("event_id").alias("top"))
    held = streams.select("stream", "checkpoint").join(anew, "stream", "left").join(top, "stream", "left")
    return held.select("stream", F.greatest(F.when(F.col("anew").isNotNull(), F.lit(current)).otherwise(F.col("checkpoint")), F.col("top")).alias("checkpoint"))


def acknowledge(pending: DataFrame, stream: str, through: int) -> DataFrame:
    """What stays after a scan: scopes named since its batch was taken."""
    return pending.filter((F.col("stream") != stream) | (F.col("id") > through))


def pending_batch(pending: DataFrame, stream: str) -> DataFrame:
    """The minimal scopes of a stream, each with the id up to which the batch goes."""
    own = pending.filter(F.col("stream") == stream)
    return minimal_scopes(own, "scope").crossJoin(F.broadcast(own.agg(F.max("id").alias("through"))))  # one row


def prepare(streams: DataFrame, pending: DataFrame, stream: str, identity: str, current: int) -> tuple[int, DataFrame, DataFrame]:
    """(cursor, streams, pending) at the start of a watch: streams has (stream, identity, checkpoint).

    A known stream of the same identity goes on from its checkpoint. Otherwise, or if the checkpoint lies ahead
    of the current id, history can't be trusted: it begins at the current id with the whole root to look at.
    """
    held = streams.filter((F.col("stream") == stream) & (F.col("identity") == identity) & (F.col("checkpoint") <= current)).first()  # one row
    if held is not None:
        return held["checkpoint"], streams, pending
    spark = streams.sparkSession
    fresh = spark.createDataFrame([(stream, identity, current)], "stream string, identity string, checkpoint long")
    root = spark.createDataFrame([(stream, "", current)], "stream string, scope string, id long")
    others = F.col("stream") != stream
    return current, streams.filter(others).unionByName(fresh), pending.filter(others).unionByName(root)


def forget(streams: DataFrame, pending: DataFrame, stream: str) -> tuple[DataFrame, DataFrame]:
    """Both tables without a stream."""
    return streams.filter(F.col("stream") != stream), pending.filter(F.col("stream") != stream)


@dataclass
class Journal:
    """Dirty scopes as snapshots in a folder: each micro-batch writes the next one.

    The batch number is part of the snapshot's name, so a batch that is run again after a failure rewrites the
    same snapshot from the same predecessor.
    """

    spark: SparkSession
    path: str

    def snapshot(self, batch: int) -> DataFrame:
        schema = "stream string, scope string, id long"
        return self.spark.createDataFrame([], schema) if batch < 0 else self.spark.read.schema(schema).parquet(f"{self.path}/batch={batch}")

    def write(self, frame: DataFrame, batch: int) -> None:
        capture(self.snapshot(batch - 1), frame).write.mode("overwrite").parquet(f"{self.path}/batch={batch}")

    def start(self, events: DataFrame, root: str, checkpoint: str, debounce: str | None = None) -> StreamingQuery:
        """events is a stream of (stream, event_id, path, flags). debounce collects events for that long; without
        it, all there is now is read and the query ends."""
        writer = route(events, root).writeStream.foreachBatch(self.write).option("checkpointLocation", checkpoint)
        return (writer.trigger(processingTime=debounce) if debounce else writer.trigger(availableNow=True)).start()


def open_counts(events: DataFrame, horizon: str | None = None, ts: str = "ts") -> DataFrame:
    """(query, path, count, last_open) of a stream or table of opens (query, path, ts); blank queries don't count.

    With a horizon, the stream's state of older events goes by watermark.
    """
    if horizon and events.isStreaming:
        events = events.withWatermark(ts, horizon)
    q = F.substring(F.lower(F.trim("query")), 1, 512)
    return events.withColumn("query", q).filter("query <> ''").groupBy("query", "path").agg(F.count(F.lit(1)).alias("count"), F.max(ts).alias("last_open"))
