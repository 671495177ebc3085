import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestack.engine import Engine, TimedOut, profile, search_channels, within
from lodestack.operators import filters, fusion, history, incremental, names, vectors
from lodestack.operators.filters import SearchRequest
from lodestack.plans.catalog import Catalog, catalog
from lodestack.sources import network
from lodestack.streaming import journal

SF = "/root/testdata/sf0.001"


def test_golden_buckets():
    assert vectors.buckets_of([1, -2, 3, -4, 5, -6, 7, -8]) == [1803, 4934, 10630, 14052, 20368, 24421, 28585, 31397, 36809, 39667]
    assert vectors.buckets_of([100, -200, 300, -400, 500, -600, 700, -800]) == vectors.buckets_of([1, -2, 3, -4, 5, -6, 7, -8])
    assert len(set(vectors.probes([1, 2, 3, -4]))) == 930


@pytest.mark.parametrize("bad", [[], [0.0, 0.0], [float("nan"), 1.0], [float("inf"), 1.0], [1.0] * 4097])
def test_invalid_vectors(spark, bad):
    assert vectors.pack_one(bad) == b"" and vectors.buckets_of(bad) == []
    row = spark.createDataFrame([(bad, [1.0, 1.0])], "a array<double>, b array<double>")
    assert row.select(vectors.cosine(F.col("a"), F.col("b")).alias("c")).first()["c"] == 0.0


def test_pack_round_trip():
    v = np.random.default_rng(0).normal(size=768)
    packed = vectors.pack_one(v)
    assert len(packed) == 780
    back = vectors.unpack_one(packed)
    assert float(back @ (v / np.linalg.norm(v))) > 0.9999
    for broken in (b"", packed[:-1], b"XXXX" + packed[4:], packed[:12] + b"\x80" + packed[13:]):
        assert len(vectors.unpack_one(broken)) == 0


def test_best_passage_per_content(spark):
    rows = [(1000 + i, "a", [1.0, 0.001 * i]) for i in range(250)] + [(1, "b", [1.0, 0.5]), (2, "c", [-1.0, 0.0])]
    got = vectors.scan(spark.createDataFrame(rows, "passage_id long, content_id string, embedding array<double>"), [1.0, 0.0], limit=2).collect()
    assert [(r["content_id"], r["passage_id"]) for r in got] == [("a", 1000), ("b", 1)]


def test_lsh_recall():
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(24, 64))
    held = np.repeat(centres, 4, axis=0) + 0.2 * rng.normal(size=(96, 64))
    keys = [set(vectors.buckets_of(v)) for v in held]
    found = []
    for q in centres:
        probe = set(vectors.probes(q))
        hit = {i for i, k in enumerate(keys) if k & probe}
        near = np.argsort(-(held @ q) / np.linalg.norm(held, axis=1))[:4]
        found.append(len(hit & set(near.tolist())) / 4)
    assert np.mean(found) >= 0.9


APPS = [("/A/Visual Studio Code.app", "Visual Studio Code"), ("/A/Éditeur.app", "Éditeur"), ("/A/TextEdit.app", "TextEdit"), ("/A/System Settings.app", "System Settings"), ("/A/Notes.app", "Notes"), ("/A/Photo Booth.app", "Photo Booth")]


@pytest.mark.parametrize(("query", "best", "score"), [("notes", "Notes", 1000), ("textedit", "TextEdit", 1000), ("editeur", "Éditeur", 1000), ("edit", "TextEdit", 920), ("edite", "Éditeur", 898), ("vsc", "Visual Studio Code", 850), ("syse", "System Settings", 804), ("visual code", "Visual Studio Code", 860), ("studio", "Visual Studio Code", 920), ("set", "System Settings", 820), ("nots", "Notes", 480)])
def test_app_scores(spark, query, best, score):
    apps = spark.createDataFrame([(p, n, p.rsplit("/", 1)[1][:-4], None, False) for p, n in APPS], "path string, name string, file_name string, bundle_id string, running boolean")
    got = names.app_ranking(apps, query).collect()
    assert (got[0]["name"], got[0]["score"]) == (best, score)


def test_app_copies(spark):
    apps = spark.createDataFrame([("/b", "Notes", "Notes", "x", True), ("/a", "Notes", "Notes", "x", False)], "path string, name string, file_name string, bundle_id string, running boolean")
    assert [r["path"] for r in names.app_ranking(apps, "notes").collect()] == ["/b"]


def _catalog(spark, files, passages=()):
    sources = spark.createDataFrame([("s", "S", "/v", "local", "online", True)], "source_id string, source_name string, source_path string, kind string, availability string, offline_content boolean")
    f = spark.createDataFrame(
        [(i, "s", p.rsplit("/", 1)[-1], p.rsplit(".", 1)[-1], p, 1, float(i), float(i), "indexed", f"c{i}", f"c{i}") for i, p in files],
        "file_id long, source_id string, name string, ext string, relative_path string, size long, mtime double, indexed_mtime double, status string, content_id string, fingerprint string",
    )
    p = spark.createDataFrame(list(passages), "passage_id long, content_id string, ordinal int, text string")
    return Catalog(sources, f, p, spark.createDataFrame([], "passage_id long, content_id string, embedding array<float>"))


def test_documents_are_not_crowded_out(spark):
    files = [(i, f"src/plan{i}.swift") for i in range(1, 201)] + [(500, "plan.md")]
    got = Engine(_catalog(spark, files)).search(SearchRequest("plan", limit=3)).collect()
    assert len(got) == 3 and got[0]["file_id"] == 500


def test_dependency_folders_are_hidden_unless_asked_for(spark):
    files = [(i, f"{d}/tool.md") for i, d in enumerate([".venv", "venv", "node_modules", ".node_modules", "x/.node"], 1)] + [(9, "ok/tool.md")]
    e = Engine(_catalog(spark, files))
    assert [r["file_id"] for r in e.search(SearchRequest("tool")).collect()] == [9]
    assert {r["file_id"] for r in e.search(SearchRequest("node_modules tool")).collect()} == {3, 9}


def test_name_before_content(spark):
    files = [(1, "a/other.md"), (2, "a/budget.md")]
    got = Engine(_catalog(spark, files, [(10, "c1", 0, "budget budget budget")])).search(SearchRequest("budget")).collect()
    assert [(r["file_id"], r["name_matched"]) for r in got] == [(2, True), (1, False)]


def test_shared_content_gives_both_files(spark):
    c = _catalog(spark, [(1, "a.md"), (2, "b.md")], [(10, "c1", 0, "zebra")])
    c = Catalog(c.sources, c.files.withColumn("content_id", F.lit("c1")), c.passages, c.vectors)
    assert {r["file_id"] for r in Engine(c).search(SearchRequest("zebra")).collect()} == {1, 2}


@pytest.mark.parametrize("query", ['"', "name:x*", "((", "😀", "a OR", "%_'", "\\", "-", "*"])
def test_hostile_requests(spark, query):
    e = Engine(_catalog(spark, [(1, "a.md")], [(10, "c1", 0, "text")]))
    for mode in ("exact", "hybrid"):
        e.search(SearchRequest(query, mode=mode)).collect()


def test_preview_starts_before_the_match(spark):
    c = _catalog(spark, [(1, "a.md")], [(i, "c1", i, f"p{i}") for i in range(400)])
    got = [r["ordinal"] for r in Engine(c).preview(1, 350).collect()]
    assert got[0] == 320 and got[-1] == 399
    assert len(Engine(c).preview(1).collect()) == 300


def test_passages_carried(spark):
    hits = spark.createDataFrame([(1, "Meaning match", 0, 7), (1, "Text match", 4, 5), (1, "Text match", 9, 7), (1, "Text match", 10, 8), (1, "Text match", 11, 9)], "file_id long, kind string, position long, passage_id long")
    assert fusion.carry_passages(hits).first()["passage_ids"] == [5, 7, 8]


def test_fusion_takes_a_channel_once(spark):
    hits = spark.createDataFrame([(1, "Filename match", 0.05), (1, "Filename match", 0.096), (1, "Text match", 0.03), (2, "Text match", 0.03)], "file_id long, kind string, score double")
    got = {r["file_id"]: r for r in fusion.fuse(hits).collect()}
    assert abs(got[1]["score"] - 0.126) < 1e-12 and got[1]["match_kind"] == "Hybrid match" and got[2]["match_kind"] == "Text match"


def test_history_stays_inside_tiers(spark):
    now = 1e9
    opened = history.opens(spark.createDataFrame([("Q ", "/x", now - 86400), ("q", "/x", now), (" ", "/y", now), ("q", "/old", now - 91 * 86400)], "query string, path string, at double"))
    scores = history.scores(opened, "q", now)
    assert [(r["path"], round(r["history"], 6)) for r in scores.collect()] == [("/x", round(100 * np.log1p(2), 6))]
    results = spark.createDataFrame([(0, "/doc", True), (1, "/other", False), (2, "/x", False)], "position int, path string, doc boolean")
    assert [r["path"] for r in history.rerank(results, scores, ["doc"]).collect()] == ["/doc", "/x", "/other"]


def test_minimal_scopes(spark):
    def run(*paths):
        return sorted(r["scope"] for r in incremental.minimal_scopes(spark.createDataFrame([(p,) for p in paths], "path string")).collect())

    assert run("a", "a/b", "ab", "c/d/e", "c/d") == ["a", "ab", "c/d"]
    assert run("a", "../x") == [""] and run("a", "/abs") == [""] and run("a", "") == [""]


def test_incomplete_listing_deletes_nothing(spark):
    known = spark.createDataFrame([(1, 5, 1.0, "indexed", "a/x")], "file_id int, size int, mtime double, status string, relative_path string")
    none = known.drop("status").limit(0)
    assert incremental.diff(known, none, ["file_id"], complete=False).first()["change"] == "same"
    assert incremental.diff(known, none, ["file_id"]).first()["change"] == "gone"
    assert incremental.diff(known, none, ["file_id"], scope="b").count() == 0


def test_retry_delay_and_jobs(spark):
    jobs = spark.createDataFrame([(1, "text", 0, 5.0, "a/x"), (2, "text", 3, 50.0, "a/y"), (3, "ocr", 0, 0.0, "b")], "file_id int, phase string, attempts int, retry_at double, relative_path string")
    assert [r["file_id"] for r in incremental.ready_jobs(jobs, "text", 10).collect()] == [1]
    assert [r["d"] for r in jobs.select(incremental.retry_delay(F.col("attempts")).alias("d")).collect()] == [30.0, 240.0, 30.0]


def test_source_upsert(spark):
    schema = "source_id string, identity string, name string, path string, availability string"
    known = spark.createDataFrame([("1", "i1", "One", "/old", "offline"), ("2", "i2", "Two", "/two", "online")], schema)
    added = spark.createDataFrame([("9", "i1", "New", "/new", "online"), ("3", "i3", "Three", "/three", "online")], schema)
    got = {r["source_id"]: (r["path"], r["availability"], r["name"]) for r in incremental.upsert_sources(known, added).collect()}
    assert got == {"1": ("/new", "online", "One"), "2": ("/two", "online", "Two"), "3": ("/three", "online", "Three")}


@pytest.mark.parametrize(("path", "flags", "scope"), [("/r/a/b.txt", 0, "a"), ("/r/b.txt", 0, ""), ("/r", 0, ""), ("/", 0, ""), ("/x/y", 0, None), ("/r/a/b", 1, ""), ("/r/a/b", 0x10, None), ("/r/idx/f", 0, None), ("/System/Volumes/Data/r/a/f", 0, "a"), ("/r/skip/f", 0, None)])
def test_event_routing(spark, path, flags, scope):
    row = spark.createDataFrame([(path, flags)], "path string, flags int")
    assert row.select(journal.scope(F.col("path"), F.col("flags"), "/r", "/r/idx", ["skip"]).alias("s")).first()["s"] == scope


def test_private_aliases(spark):
    row = spark.createDataFrame([("/private/tmp/a/f", 0), ("/private/etc/f", 0)], "path string, flags int")
    assert [r["s"] for r in row.select(journal.scope(F.col("path"), F.col("flags"), "/tmp").alias("s")).collect()] == ["a", None]


def test_journal_collapses_bursts_and_keeps_later_events(spark):
    none = spark.createDataFrame([], "stream string, scope string, id long")
    routed = spark.range(600).select(F.lit("s").alias("stream"), F.concat(F.lit("d"), "id").alias("scope"), F.col("id").alias("event_id"))
    assert [(r["scope"], r["id"]) for r in journal.capture(none, routed).collect()] == [("", 599)]
    held = journal.capture(none, routed.filter("event_id < 3"))
    again = journal.capture(held, spark.createDataFrame([("s", "d0", 9)], "stream string, scope string, event_id long"))
    assert {(r["scope"], r["id"]) for r in journal.acknowledge(again, "s", 2).collect()} == {("d0", 9)}
    assert {(r["scope"], r["through"]) for r in journal.pending_batch(again, "s").collect()} == {("d0", 9), ("d1", 9), ("d2", 9)}


@pytest.mark.parametrize(("text", "out"), [("NAS/share", "smb://nas/share"), ("smb://Host:445/A b", "smb://host:445/A%20b"), ("fe80::1", "smb://[fe80::1]"), ("smb://[::1]/x", "smb://[::1]/x"), ("10.0.0.1", "smb://10.0.0.1")])
def test_share_addresses(text, out):
    assert network.canonical(text) == out


@pytest.mark.parametrize(("text", "reason"), [("", "invalid"), ("ftp://x", "scheme"), ("smb://u:p@h/s", "credentials"), ("h/../x", "invalid"), ("999.1.1.1", "invalid"), ("-bad/x", "invalid"), ("h?x=1", "invalid"), ("h:0/x", "invalid"), ("a\\b", "invalid"), ("h/%zz", "invalid")])
def test_refused_addresses(text, reason):
    with pytest.raises(network.AddressError) as e:
        network.canonical(text)
    assert e.value.reason == reason and (not text or text not in str(e.value))


def test_mounts(spark):
    rows = [("smbfs", "//user@NAS/disk10", "/Volumes/disk10"), ("smbfs", "//NAS/disk2", "/Volumes/disk2"), ("apfs", "/dev/disk1", "/")]
    got = network.mounted_shares(spark.createDataFrame(rows, "fs string, source string, path string")).collect()
    assert [r["url"] for r in got] == ["smb://nas/disk2", "smb://nas/disk10"]


def test_budget_is_typed(spark):
    slow = spark.range(0, 12_000_000, 1, 200).agg(F.max(F.sha2(F.col("id").cast("string"), 512)))
    with pytest.raises(TimedOut):
        within(spark, slow, 0.5)
    assert len(within(spark, spark.range(3), 30)) == 3


def test_profile_and_channels(spark):
    e = Engine(catalog(spark, SF))
    assert '"query": "report"' in profile(e, SearchRequest("report", limit=12))
    seen = []
    got = search_channels(e, SearchRequest("report", limit=5), on_update=lambda r: seen.append(len(r)))
    assert len(got) == 5 and len(seen) in (1, 2)  # names may run late on a busy machine


def test_metadata_owner_is_the_longest_source(spark):
    sources = spark.createDataFrame([("a", "A", "/v", "online"), ("b", "B", "/v/in", "online"), ("c", "C", "/v/in/off", "offline")], "source_id string, source_name string, source_path string, availability string")
    paths = spark.createDataFrame([("/v/in/x/report.md", 1.0), ("/v/report.md", 1.0), ("/v/in/off/report.md", 1.0), ("/v/node_modules/report.md", 1.0), ("/v/A.app/report.md", 1.0)], "path string, mtime double")
    got = {(r["path"], r["source_id"]) for r in filters.metadata_hits(paths, sources, SearchRequest("report")).collect()}
    assert got == {("/v/in/x/report.md", "b"), ("/v/report.md", "a"), ("/v/in/off/report.md", "b")}


def test_search_shows_passages_and_respects_access(spark):
    files = [(1, "budget.md"), (2, "other.md"), (3, "gone.md"), (4, "moved.md")]
    c = _catalog(spark, files, [(10, "c1", 0, "first words"), (11, "c1", 1, "the budget of the year"), (20, "c2", 0, "budget budget"), (30, "c3", 0, "budget"), (40, "c4", 0, "budget here")])
    access = spark.createDataFrame([(3, "denied"), (4, "missing")], "file_id long, state string")
    plain = {r["file_id"]: r for r in Engine(c).search(SearchRequest("budget")).collect()}
    assert set(plain) == {1, 2, 3, 4} and plain[1]["passage_ids"] == [11] and plain[1]["passage"] == "the budget of the year" and plain[2]["ordinal"] == 0
    held = {r["file_id"]: r for r in Engine(c, access=access).search(SearchRequest("budget")).collect()}
    assert 3 not in held and held[4]["stale"] and not held[1]["stale"]  # this source lets its content be shown offline
    recent = {r["file_id"]: r["passage"] for r in Engine(c).search(SearchRequest("")).collect()}
    assert recent[1] == "first words"
    revoked = spark.createDataFrame([(2, 1e12)], "file_id long, revoked_at double")
    assert 2 not in {r["file_id"] for r in Engine(c, revoked=revoked).search(SearchRequest("budget")).collect()}
