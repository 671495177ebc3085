import plistlib
import threading
import time

import pytest
from pyspark.sql import functions as F

from lodestack.sources import registration as reg
from lodestack.sources.snapshots import Snapshots
from lodestack.streaming import journal


def test_identity_survives_another_mount_point(spark):
    rows = spark.createDataFrame([("smbfs", "//nas/s", "/Volumes/s", "/Volumes/s/docs", False, False), ("apfs", "U1", "/", "/Users/x", True, True), ("apfs", "U2", "/Volumes/D", "/Volumes/D", True, False)], "fs string, volume string, mount string, path string, local boolean, internal boolean")
    got = rows.select(reg.identity(F.col("fs"), F.col("volume"), F.col("mount"), F.col("path")).alias("i"), reg.source_kind(F.col("fs"), F.col("local"), F.col("internal")).alias("k")).collect()
    assert [(r["i"], r["k"]) for r in got] == [("smbfs|//nas/s|/docs", "network"), ("apfs|U1|Users/x", "local"), ("apfs|U2|", "external")]


def test_probes_are_bounded():
    gate, running, most, started = threading.Event(), [0], [0], []

    def probe(place):
        started.append(place)
        running[0] += 1
        most[0] = max(most[0], running[0])
        gate.wait(5)
        running[0] -= 1
        return place

    p = reg.Prober(probe, seconds=0.3)
    began = time.time()
    errors = []
    threads = [threading.Thread(target=lambda i=i: errors.append(pytest.raises(TimeoutError, p.inspect, i))) for i in range(4)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert len(errors) == 4 and time.time() - began < 3 and most[0] == 2
    gate.set()
    assert p.inspect("later", 3) == "later" and len(started) == 3  # probes that were given up while queued never began


def test_availability(spark):
    sources = spark.createDataFrame([("a", "/old", False, "offline"), ("b", "/b", False, "online"), ("c", "/c", True, "online")], "identity string, path string, paused boolean, availability string")
    found = spark.createDataFrame([("a", "/new", "ok"), ("b", "/b", "denied"), ("c", "/c", "ok")], "identity string, path string, state string")
    got = {r["identity"]: (r["path"], r["availability"]) for r in reg.refresh_availability(sources, found).collect()}
    assert got == {"a": ("/new", "online"), "b": ("/b", "offline"), "c": ("/c", "paused")}


def test_scope_climbs_to_an_existing_folder(spark):
    scopes = spark.createDataFrame([("a/b/c/d",), ("a/b",), ("x/y",), ("",), ("a/b",)], "scope string")
    found = {r["scope"]: r["folder"] for r in reg.nearest_folders(scopes, spark.createDataFrame([("a",), ("a/b",), ("a/b/cc",)], "relative_path string")).collect()}
    assert found == {"a/b/c/d": "a/b", "a/b": "a/b", "x/y": "", "": ""}
    plan = reg.nearest_folders(scopes, spark.createDataFrame([("a",)], "relative_path string"))._jdf.queryExecution().executedPlan().toString()
    assert "HashJoin" in plan or "SortMergeJoin" in plan


def _bundle(folder, name, **info):
    c = folder / f"{name}.app" / "Contents"
    c.mkdir(parents=True)
    (c / "Info.plist").write_bytes(plistlib.dumps(info))
    return folder / f"{name}.app"


def test_applications(spark, tmp_path):
    a = _bundle(tmp_path / "Apps", "One", CFBundleDisplayName="Uno", CFBundleIdentifier="x.one")
    _bundle(tmp_path / "Apps" / "sub", "Two", CFBundleName="$(NAME)")
    _bundle(tmp_path / "Apps", "Helper", LSBackgroundOnly=True)
    _bundle(tmp_path / "Apps", "Kit", CFBundlePackageType="BNDL")
    _bundle(a / "Contents", "Inner")
    (tmp_path / "Apps" / "link").symlink_to(tmp_path / "Apps" / "sub")
    (tmp_path / "Apps" / "Alias.app").symlink_to(a)
    got = {(r["name"], r["bundle_id"]) for r in reg.applications(spark, [str(tmp_path / "Apps")]).collect()}
    assert got == {("Uno", "x.one"), ("Two", None)}


def test_snapshots(spark, tmp_path):
    s = Snapshots(spark, str(tmp_path))
    assert s.current() == 0
    s.publish({"files": spark.range(5), "passages": spark.range(7)}, sort={"files": ["id"]})
    reader = s.table("files")
    s.publish({"files": spark.range(3)}, base=1)
    assert reader.count() == 5 and s.table("files").count() == 3 and s.table("passages").count() == 7
    with pytest.raises(RuntimeError):
        s.publish({"files": spark.range(1)}, base=1)
    assert [p.rsplit("/", 2)[1:] for p in s.erase()] == [["v1", "files"]] and s.table("passages").count() == 7


def test_journal_prepare(spark):
    streams = spark.createDataFrame([("s", "i", 10)], "stream string, identity string, checkpoint long")
    pending = spark.createDataFrame([("s", "a", 9)], "stream string, scope string, id long")
    assert journal.prepare(streams, pending, "s", "i", 12)[0] == 10
    for identity, current in (("other", 12), ("i", 5)):
        cursor, known, todo = journal.prepare(streams, pending, "s", identity, current)
        assert cursor == current and [r["scope"] for r in todo.collect()] == [""] and known.first()["identity"] == identity
    assert all(t.count() == 0 for t in journal.forget(streams, pending, "s"))


def test_indexed_engine_gives_the_same_results(spark, tmp_path):
    from lodestack.engine import Engine
    from lodestack.operators.filters import SearchRequest
    from lodestack.plans.catalog import catalog

    c = catalog(spark, "/root/testdata/sf0.001")
    request = SearchRequest("report thing", limit=20)
    want = [r.asDict() for r in Engine(c).search(request).collect()]
    held = Engine.indexed(c, Snapshots(spark, str(tmp_path)))
    assert [r.asDict() for r in held.search(request).collect()] == want
    plan = held.passage_index.filter("term = 'report'")._jdf.queryExecution().toString()
    assert "PushedFilters: [IsNotNull(term), EqualTo(term,report)]" in plan
