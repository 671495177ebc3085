"""Keyed state, the change feed's source, fenced backfill."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from lodestack.operators import backfill, incremental
from lodestack.plans import change_queries as cq
from lodestack.sources import feed
from lodestack.sources.snapshots import Snapshots
from lodestack.streaming import stateful

T0 = dt.datetime(2024, 5, 1)


def at(seconds):
    return T0 + dt.timedelta(seconds=seconds)


def events(spark, rows):
    return spark.createDataFrame([(s, i, at(t), x) for s, i, t, x in rows], "stream string, event_id long, ts timestamp, scope string")


def test_a_busy_stream_is_not_put_off(spark):
    parts = [events(spark, [("a", i, i, f"d{i % 3}") for i in range(5)]), events(spark, [("a", 5 + i, 5 + i, "d9") for i in range(6)] + [("b", 90, 6, "x")]), events(spark, [("c", 99, 500, "end")])]
    rows = cq._streamed(spark, parts, lambda s: stateful.debounced(s, 4000, 2), "append").filter("stream <> 'c'").collect()
    start = int(T0.replace(tzinfo=dt.timezone.utc).timestamp() * 1000)
    found = sorted((r["stream"], (r["opened"] - start) // 1000, (r["due"] - start) // 1000, r["last"], r["scope"], r["id"]) for r in rows)
    # Three scopes of the first four seconds become the root; the window after begins with the next event.
    assert found == [("a", 0, 4, 3, "", 3), ("a", 4, 8, 7, "d1", 4), ("a", 4, 8, 7, "d9", 7), ("a", 8, 12, 10, "d9", 10), ("b", 6, 10, 90, "x", 90)]


def test_each_open_renews_a_counter(spark):
    day = 86_400
    opens = lambda *rows: spark.createDataFrame([(q, p, at(t * day)) for q, p, t in rows], "query string, path string, ts timestamp")
    parts = [opens((" Q ", "/a", 0), ("q", "/a", 1), ("q", "/b", 0), ("  ", "/a", 0)), opens(("q", "/a", 60)), opens(("q", "/c", 100)), opens(("q", "/b", 101)), opens(("q", "/z", 140))]
    rows = cq._streamed(spark, parts, stateful.open_counters, "update")
    held = {r["path"]: r["count"] for r in stateful.latest(rows).collect()}
    # /a was renewed on day 60; /b ended on day 90 and began anew.
    assert held == {"/a": 3, "/b": 1, "/c": 1, "/z": 1}
    assert rows.filter("count = 0").select("path").distinct().collect()[0]["path"] == "/b"


@pytest.fixture
def watched(spark, tmp_path):
    feed.register(spark)
    place, out, state = (str(tmp_path / n) for n in ("feed", "out", "state"))

    def read():
        stream = spark.readStream.format("change-feed").option("path", place).option("root", "/r").load()
        run = stream.select("event_id", "path", "flags").writeStream.format("parquet").option("path", out).option("checkpointLocation", state).trigger(availableNow=True).start()
        run.awaitTermination()
        return sorted(tuple(r) for r in spark.read.schema("event_id long, path string, flags int").parquet(out).collect())

    def write(ids, identity=None):
        rows = spark.createDataFrame([(i, at(i), f"/r/{i}", 0) for i in ids], "event_id long, ts timestamp, path string, flags int")
        feed.write_feed(rows, place, identity, file_rows=3)

    return read, write, tmp_path / "feed"


def test_feed_goes_on_after_a_restart(watched):
    read, write, _ = watched
    write(range(10), "v1")
    assert read() == [(i, f"/r/{i}", 0) for i in range(10)]
    assert len(read()) == 10
    write(range(10, 17))
    assert read() == [(i, f"/r/{i}", 0) for i in range(17)]


def test_feed_of_another_identity_asks_for_the_root(watched):
    read, write, _ = watched
    write(range(5), "v1")
    read()
    write(range(5, 8), "v2")
    assert read()[5:] == [(7, "/r", feed.ROOT_CHANGED)]
    write(range(8, 10))
    assert [r[0] for r in read()[6:]] == [8, 9]


def test_feed_whose_ids_began_anew_asks_for_the_root(watched):
    read, write, place = watched
    write(range(100, 105), "v1")
    read()
    for f in place.glob("*.parquet"):
        f.unlink()
    write(range(3))
    assert read() == sorted([*[(i, f"/r/{i}", 0) for i in range(100, 105)], (2, "/r", feed.ROOT_CHANGED)])


def test_backfill_checks_ownership_again_and_retries(spark, tmp_path):
    kept = Snapshots(spark, str(tmp_path / "t"))
    files = spark.createDataFrame([(i, f"c{i}", "s") for i in range(4)], "file_id long, content_id string, source_id string")
    passages = spark.createDataFrame([(i, f"c{i}", 0, f"text {i}") for i in range(4)], "passage_id long, content_id string, ordinal int, text string")
    none = spark.createDataFrame([], "passage_id long, model string, packed binary")
    kept.publish({"files": files, "passages": passages, "packed": none})
    made, published = [], kept.publish

    def make(passages, packed, files, model):
        made.append(1)
        kept.publish({"files": files.filter("file_id <> 2")})  # revoked while vectors are made
        return passages.select("passage_id", F.lit(model).alias("model"), F.lit(b"v").alias("packed"))

    def contested(tables, sort=None, base=None):
        if base is not None and len(made) == 1:
            made.append(2)
            published({"files": kept.table("files").filter("file_id <> 3")})  # and once more just before the commit
        return published(tables, sort, base)

    kept.publish = contested
    version = backfill.fenced_backfill(kept, "m", make)
    assert sorted(r["passage_id"] for r in kept.table("packed", version).collect()) == [0, 1] and made == [1, 2]
    kept.publish = lambda tables, sort=None, base=None: (_ for _ in ()).throw(RuntimeError("taken"))
    with pytest.raises(backfill.Conflict):
        backfill.fenced_backfill(kept, "m2", lambda p, v, f, m: none, attempts=2)


def test_files_that_change_while_read_are_read_again(spark):
    listing = lambda *rows: spark.createDataFrame(rows, "path string, size long, mtime double")
    before, after = listing(("a", 1, 1.0), ("b", 1, 1.0), ("c", 1, 1.0), ("d", 1, 1.0)), listing(("a", 1, 1.0), ("b", 2, 1.0), ("c", 1, 2.0), ("e", 1, 1.0))
    got = incremental.stable_reads(before, spark.createDataFrame([(p,) for p in "abcde"], "path string"), after, ["path"]).collect()
    assert {r["path"]: r["verdict"] for r in got} == {"a": "publish", "b": "retry", "c": "retry", "d": "gone", "e": "retry"}
