"""Registered queries of the change feed, its keyed state, and of what follows changes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestack.engine import Engine, citation
from lodestack.operators import backfill, incremental, vectors
from lodestack.operators.filters import SearchRequest, under
from lodestack.plans import catalog as cat
from lodestack.plans.catalog import catalog, micros, read
from lodestack.plans.registry import _JOINED, query, visible_sql
from lodestack.runtime import scratch
from lodestack.sources import feed, registration
from lodestack.sources.snapshots import Snapshots
from lodestack.streaming import journal, stateful

_HOUR = 3_600_000


def _streamed(spark: SparkSession, parts: list[DataFrame], plan, mode: str) -> DataFrame:
    """All rows of plan(stream) over the parts, each a micro-batch of its own, with their batch."""
    folder, out, state = scratch(spark, "feed"), scratch(spark, "stream-out"), scratch(spark, "stream-state")

    def keep(frame: DataFrame, batch: int) -> None:
        frame.withColumn("batch", F.lit(batch)).write.mode("overwrite").parquet(f"{out}/at={batch}")

    for part in parts:
        part.coalesce(1).write.mode("append").parquet(folder)
        stream = spark.readStream.schema(part.schema).parquet(folder)
        run = plan(stream).writeStream.outputMode(mode).foreachBatch(keep).option("checkpointLocation", state).trigger(availableNow=True).start()
        run.awaitTermination()
    return spark.read.parquet(out).drop("at")


def _later(events: DataFrame, days: int, **columns) -> DataFrame:
    """One row ``days`` after the last of events: it moves the watermark on."""
    return events.agg((F.max("ts") + F.expr(f"INTERVAL {days} DAYS")).alias("ts")).select(*[(F.col("ts") if c == "ts" else columns[c].cast(kind)).alias(c) for c, kind in events.dtypes])


@query(f"""WITH RECURSIVE e AS (SELECT 's' || user_id % 9 AS stream, event_id, epoch_us(ts) // 1000 AS t_ms, 'd' || user_id % 40 || '/' || event_type AS scope FROM events),
w AS (SELECT stream, min(t_ms) AS opened FROM e GROUP BY stream UNION ALL SELECT w.stream, min(e.t_ms) FROM w JOIN e ON e.stream = w.stream AND e.t_ms >= w.opened + {6 * _HOUR} GROUP BY w.stream, w.opened),
h AS (SELECT e.*, w.opened FROM e JOIN w ON e.stream = w.stream AND e.t_ms >= w.opened AND e.t_ms < w.opened + {6 * _HOUR}),
n AS (SELECT stream, opened, max(event_id) AS last, count(DISTINCT scope) AS scopes FROM h GROUP BY stream, opened)
SELECT h.stream, h.opened, h.opened + {6 * _HOUR} AS due, n.last, CASE WHEN n.scopes > 12 THEN '' ELSE scope END AS scope, max(CASE WHEN n.scopes > 12 THEN n.last ELSE event_id END) AS id FROM h JOIN n USING (stream, opened) GROUP BY ALL""")
def debounced_scopes(spark: SparkSession, sf: str) -> DataFrame:
    """Batches of scopes, each handed on six hours after its first event; more than twelve scopes become the root."""
    e = read(spark, sf, "events")
    user = F.col("user_id")
    own = e.select(F.concat(F.lit("s"), user % 9).alias("stream"), "event_id", F.col("ts").cast("timestamp").alias("ts"), F.concat(F.lit("d"), user % 40, F.lit("/"), F.col("event_type")).alias("scope"))
    third = own.select(F.percentile_approx("ts", [0.3, 0.6])).first()[0]  # two times
    parts = [own.filter(F.col("ts") < third[0]), own.filter((F.col("ts") >= third[0]) & (F.col("ts") < third[1])), own.filter(F.col("ts") >= third[1])]
    parts.append(_later(own, 2, stream=F.lit("clock"), event_id=F.lit(-1), scope=F.lit("clock")))
    rows = _streamed(spark, parts, lambda s: stateful.debounced(s, 6 * _HOUR, 12), "append")
    return rows.filter("stream <> 'clock'").select("stream", "opened", "due", "last", "scope", "id")


@query("""WITH e AS (SELECT event_type AS query, '/f/' || (user_id % 40) AS path, epoch_us(ts) AS opened FROM events)
SELECT query, path, CAST(count(*) AS BIGINT) AS count, max(opened) AS last_open_us FROM e GROUP BY query, path HAVING max(opened) > (SELECT max(opened) FROM e) - CAST(15 AS BIGINT) * 86400000000""")
def expiring_counters(spark: SparkSession, sf: str) -> DataFrame:
    """Counters of opens with 90 days to live since the last one, 75 days after the end."""
    e = read(spark, sf, "events")
    own = e.select(F.col("event_type").alias("query"), F.concat(F.lit("/f/"), F.col("user_id") % 40).alias("path"), F.col("ts").cast("timestamp").alias("ts"))
    half = own.select(F.percentile_approx("ts", 0.5)).first()[0]
    parts = [own.filter(F.col("ts") <= half), own.filter(F.col("ts") > half), _later(own, 75, query=F.lit("clock"), path=F.lit("clock"))]
    rows = _streamed(spark, parts, stateful.open_counters, "update")
    return stateful.latest(rows).filter("path <> 'clock'")


@query("""WITH e AS (SELECT event_id, CASE WHEN event_id > (SELECT max(event_id) FROM events) * 3 // 4 THEN 2 WHEN event_id > (SELECT max(event_id) FROM events) // 2 THEN 1 ELSE 0 END AS part, 'd' || user_id % 30 || '/' || event_type AS scope FROM events)
SELECT event_id, scope FROM e WHERE part < 2 UNION ALL SELECT (SELECT max(event_id) FROM events), ''""")
def change_feed_resumed(spark: SparkSession, sf: str) -> DataFrame:
    """The feed read by its streaming source: half, then on from the checkpoint; then its identity changes, and the whole root
    is asked for instead of the last quarter."""
    feed.register(spark)
    e = read(spark, sf, "events")
    last = e.agg(F.max("event_id")).first()[0]
    i = F.col("event_id")
    path = F.concat(F.lit("/vol/root/d"), F.col("user_id") % 30, F.lit("/"), F.col("event_type"), F.lit("/f"), i)
    events = e.select(i, F.col("ts").cast("timestamp").alias("ts"), path.alias("path"), F.lit(0).alias("flags"))
    folder, out, state = scratch(spark, "feed"), scratch(spark, "routed"), scratch(spark, "feed-state")
    for part, identity in ((events.filter(i <= last // 2), "volume-1"), (events.filter((i > last // 2) & (i <= last * 3 // 4)), "volume-1"), (events.filter(i > last * 3 // 4), "volume-2")):
        feed.write_feed(part, folder, identity)
        stream = spark.readStream.format("change-feed").option("path", folder).option("root", "/vol/root").load()
        run = journal.route(stream, "/vol/root").select("event_id", "scope").writeStream.format("parquet").option("path", out).option("checkpointLocation", state).trigger(availableNow=True).start()
        run.awaitTermination()
    return spark.read.schema("event_id long, scope string").parquet(out)


@query("""WITH {cat}, f AS (SELECT DISTINCT regexp_replace(relative_path, '/?[^/]*$', '') AS folder FROM files_ WHERE file_id % 9 <> 3), d AS (SELECT DISTINCT relative_path || '/' || file_id % 30 || '/new' AS scope FROM files_ UNION SELECT DISTINCT regexp_replace(relative_path, '/?[^/]*$', '') || '/deeper' FROM files_)
SELECT scope, coalesce((SELECT max_by(folder, length(folder)) FROM f WHERE starts_with(d.scope || '/', f.folder || '/')), '') AS folder FROM d""")
def nearest_folder(spark: SparkSession, sf: str) -> DataFrame:
    """Where a rescan of vanished folders begins: the nearest one above that is left."""
    f = cat.files(read(spark, sf, "documents")).select("file_id", "relative_path", F.regexp_replace("relative_path", "/?[^/]*$", "").alias("folder"))
    scopes = f.select(F.concat("relative_path", F.lit("/"), F.col("file_id") % 30, F.lit("/new")).alias("scope")).union(f.select(F.concat("folder", F.lit("/deeper"))))
    return registration.nearest_folders(scopes, f.filter("file_id % 9 <> 3").select("folder"), path="folder")


@query(f"""WITH {{cat}}, own AS (SELECT * FROM files_ WHERE source_id <> 'src4'), held AS (SELECT first * {cat.PER_CONTENT} AS passage_id FROM contents_ WHERE first % 3 = 0)
SELECT passage_id, '{vectors.MODEL}' AS model FROM passages_ p WHERE EXISTS (SELECT 1 FROM own WHERE own.content_id = p.content_id) AND regexp_matches(text, '[\\p{{L}}\\p{{N}}]') UNION SELECT passage_id, '{vectors.MODEL}' FROM held""")
def fenced_backfill(spark: SparkSession, sf: str) -> DataFrame:
    """Vectors made for all passages while a source is revoked: what was made for its own isn't published."""
    c = catalog(spark, sf)
    kept = Snapshots(spark, scratch(spark, "fence"))
    held = c.passages.filter((F.col("ordinal") == 0) & (F.floor(F.col("passage_id") / cat.PER_CONTENT) % 3 == 0)).select("passage_id", F.lit(vectors.MODEL).alias("model"), F.lit(b"").alias("packed"))
    kept.publish({"files": c.files, "passages": c.passages, "packed": held})

    def made(passages: DataFrame, packed: DataFrame, files: DataFrame, model: str) -> DataFrame:
        out = vectors.backfill(passages, packed, files, model)
        kept.publish({"files": incremental.revoke(files, F.col("source_id") == "src4").filter("content_id IS NOT NULL")})
        return out

    backfill.fenced_backfill(kept, make=made)
    return kept.table("packed").select("passage_id", "model")


@query("""WITH e AS (SELECT user_id, event_id, epoch(ts) AS at, value FROM events), m AS (SELECT max(event_id) AS last FROM e), b AS (SELECT user_id, count(*) AS size, max(e.at) AS mtime FROM e, m WHERE event_id <= last // 2 GROUP BY user_id),
a AS (SELECT user_id, count(*) AS size, max(e.at) AS mtime FROM e, m WHERE event_id <= last // 2 + last // 200 AND user_id % 11 <> 0 GROUP BY user_id)
SELECT b.user_id, CASE WHEN a.user_id IS NULL THEN 'gone' WHEN a.size = b.size AND abs(a.mtime - b.mtime) <= 1e-6 THEN 'publish' ELSE 'retry' END AS verdict FROM b LEFT JOIN a USING (user_id)""")
def stable_reads(spark: SparkSession, sf: str) -> DataFrame:
    """Files that changed while they were read are read again. A user's events are a file that grows."""
    e = read(spark, sf, "events").select("user_id", "event_id", (micros("ts") / 1e6).alias("at"))
    last = e.agg(F.max("event_id")).first()[0]

    def listing(rows: DataFrame) -> DataFrame:
        return rows.groupBy("user_id").agg(F.count(F.lit(1)).alias("size"), F.max("at").alias("mtime"))

    before = listing(e.filter(F.col("event_id") <= last // 2))
    after = listing(e.filter((F.col("event_id") <= last // 2 + last // 200) & (F.col("user_id") % 11 != 0)))
    return incremental.stable_reads(before, before.select("user_id"), after, ["user_id"]).select("user_id", "verdict")


# --- sources and what a caller narrows --------------------------------------------------------------------------------

_SOURCES_SQL = """s AS (SELECT *, CASE WHEN availability = 'offline' THEN 'offline' WHEN kind = 'network' THEN 'paused' ELSE availability END AS state, CASE WHEN kind <> 'local' THEN CAST(1700000000 + CAST(substr(source_id, 4) AS INTEGER) * 100 AS DOUBLE) END AS last_scan FROM sources_)"""


def _sources(spark: SparkSession, sf: str) -> DataFrame:
    n = F.substring("source_id", 4, 9).cast("int")
    own = catalog(spark, sf).sources
    state = F.when(F.col("availability") == "offline", "offline").when(F.col("kind") == "network", "paused").otherwise(F.col("availability"))
    return own.withColumn("availability", state).withColumn("last_scan", F.when(F.col("kind") != "local", (F.lit(1_700_000_000) + n * 100).cast("double")))


@query(f"""WITH {{cat}}, {_SOURCES_SQL} SELECT source_id FROM s WHERE state NOT IN ('paused', 'offline') AND (last_scan IS NULL OR last_scan <= 1700001900 - 900)""")
def due_sources(spark: SparkSession, sf: str) -> DataFrame:
    """Sources to look at again."""
    return incremental.due_sources(_sources(spark, sf), 1_700_001_900.0).select("source_id")


@query("""WITH {cat}, f AS (SELECT source_id AS identity, '/new' || source_path AS path, CASE WHEN kind = 'local' THEN 'ok' WHEN kind = 'external' AND offline_content THEN 'ok' ELSE 'denied' END AS state FROM sources_)
SELECT s.source_id AS identity, CASE WHEN f.state = 'ok' THEN f.path ELSE s.source_path END AS path, CASE WHEN s.kind = 'network' THEN 'paused' WHEN f.state = 'ok' THEN 'online' ELSE 'offline' END AS availability FROM sources_ s JOIN f ON f.identity = s.source_id""")
def source_availability(spark: SparkSession, sf: str) -> DataFrame:
    """Sources after a look at their places; paused ones stay so."""
    s = catalog(spark, sf).sources
    state = F.when((F.col("kind") == "local") | (F.col("kind") == "external") & F.col("offline_content"), "ok").otherwise("denied")
    found = s.select(F.col("source_id").alias("identity"), F.concat(F.lit("/new"), "source_path").alias("path"), state.alias("state"))
    known = s.select(F.col("source_id").alias("identity"), F.col("source_path").alias("path"), (F.col("kind") == "network").alias("paused"))
    return registration.refresh_availability(known, found).select("identity", "path", "availability")


@query("""WITH {cat} SELECT file_id, relative_path FROM files_ WHERE NOT (len(list_filter(string_split(relative_path, '/'), lambda x: x = 'node_modules')) > 0 OR regexp_full_match(relative_path, 'files/.*[.]csv'))""")
def source_exclusions(spark: SparkSession, sf: str) -> DataFrame:
    """Files that stay in the catalog after a source's exclusions changed."""
    return incremental.exclude(cat.files(read(spark, sf, "documents")), ["node_modules", "files/*.csv"]).select("file_id", "relative_path")


@query("""WITH e AS (SELECT 's' || user_id % 7 AS stream, max(event_id) AS checkpoint FROM events GROUP BY 1), k AS (SELECT stream, 'v' || CAST(substr(stream, 2) AS INTEGER) % 3 AS identity, checkpoint FROM e)
SELECT stream, CASE WHEN stream = 's4' THEN 'v9' ELSE identity END AS identity, CASE WHEN stream = 's4' THEN CAST(5 AS BIGINT) ELSE checkpoint END AS checkpoint, stream = 's4' AS whole FROM k""")
def journal_prepared(spark: SparkSession, sf: str) -> DataFrame:
    """Streams at the start of a watch: one goes on from its checkpoint, one whose place has another identity begins anew with
    its root to look at."""
    e = read(spark, sf, "events")
    k = F.col("user_id") % 7
    streams = e.groupBy(F.concat(F.lit("s"), k).alias("stream"), F.concat(F.lit("v"), k % 3).alias("identity")).agg(F.max("event_id").alias("checkpoint")).select("stream", "identity", "checkpoint")
    pending = streams.select("stream", F.lit("old").alias("scope"), F.lit(1).cast("long").alias("id")).filter("stream = 's4'")
    _, streams, pending = journal.prepare(streams, pending, "s2", "v2", 1 << 40)  # as it was
    _, streams, pending = journal.prepare(streams, pending, "s4", "v9", 5)
    root = pending.filter("scope = ''").select("stream", F.lit(True).alias("whole"))
    return streams.join(root, "stream", "left").select("stream", "identity", "checkpoint", F.coalesce("whole", F.lit(False)).alias("whole"))


_ASKED = (3, 7, 8, 21, 44, 45, 120, 9_999_999)


@query(f"WITH {{cat}} SELECT f.file_id, f.name FROM {_JOINED} WHERE {visible_sql(SearchRequest(''))} AND f.file_id IN ({', '.join(map(str, _ASKED))})")
def filter_ids(spark: SparkSession, sf: str) -> DataFrame:
    """Visible files among those that a caller names."""
    return Engine(catalog(spark, sf))._visible(SearchRequest("", file_ids=_ASKED)).select("file_id", "name")


@query("SELECT p_partkey FROM part WHERE '/Applications/' || p_size || '/' || p_partkey || '.app' LIKE '/Applications/7/%'")
def app_scope(spark: SparkSession, sf: str) -> DataFrame:
    """Applications below a source's folder."""
    path = F.concat(F.lit("/Applications/"), F.col("p_size"), F.lit("/"), F.col("p_partkey"), F.lit(".app"))
    return read(spark, sf, "part").filter(under(path, "/Applications/7/")).select("p_partkey")


@query("""WITH {cat} SELECT file_id, passage_id, p.text || chr(10) || chr(10) || f.name || ', passage ' || (ordinal + 1) || chr(10) || source_path || '/' || relative_path AS cited FROM passages_ p JOIN files_ f USING (content_id) JOIN sources_ s ON s.source_id = f.source_id""")
def citations(spark: SparkSession, sf: str) -> DataFrame:
    """Every passage of every file with its place."""
    c = catalog(spark, sf)
    met = c.passages.join(c.files, "content_id").join(c.sources, "source_id")
    place = F.concat(F.lit("passage "), (F.col("ordinal") + 1).cast("string"))
    return met.select("file_id", "passage_id", citation(F.col("text"), F.col("name"), place, F.concat_ws("/", "source_path", "relative_path")).alias("cited"))
