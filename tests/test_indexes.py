"""Trigram postings and bounded postings against plain scans."""

import random
from dataclasses import replace

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from lodestack.engine import Engine
from lodestack.functions.text import parse_query
from lodestack.operators import fulltext, name_index, topk
from lodestack.operators.filters import SearchRequest
from lodestack.plans.catalog import catalog
from lodestack.sources.snapshots import Snapshots

ALPHABET = ["ab", "bc", "Ünit", "report", ".md", "-", "a", "İ", "zz"]


@pytest.fixture(scope="module")
def named(spark):
    rng = random.Random(1)
    rows = [(i * 977, "".join(rng.choice(ALPHABET) for _ in range(rng.randrange(6)))) for i in range(3000)] + [(5_000_001, None), (5_000_002, "")]
    return spark.createDataFrame(rows, "file_id long, name string").cache()


@pytest.mark.parametrize("literal", ["report", "REPORT.md", "ünit", "abab", "zzz", "t-a", "no such name", "aba"])
def test_trigrams_find_what_a_scan_finds(named, literal):
    want = {r[0] for r in named.filter(F.contains(F.lower("name"), F.lit(literal.lower()))).select("file_id").collect()}
    assert {r[0] for r in name_index.matching(named, name_index.postings(named), literal).select("file_id").collect()} == want


def test_only_asked_trigrams_are_read(spark, named, tmp_path):
    kept = Snapshots(spark, str(tmp_path))
    kept.publish({"grams": name_index.postings(named)}, sort={"grams": name_index.SORT})
    plan = name_index.candidates(kept.table("grams"), "report")._jdf.queryExecution().executedPlan().toString()
    assert "In(gram, [" in plan.split("PushedFilters")[1] and "name" not in plan.split("ReadSchema")[1].split("\n")[0]


def test_rows_of_one_trigram_are_bounded(named):
    rows = name_index.postings(named).select(F.size("ids").alias("n"), (F.col("ids")[F.size("ids") - 1] - F.col("ids")[0]).alias("wide")).collect()
    assert max(r["n"] for r in rows) <= name_index.BLOCK and max(r["wide"] for r in rows) < name_index.BLOCK


def test_refresh_builds_touched_blocks_only(named):
    index = name_index.postings(named)
    gone, fresh = named.filter("file_id = 977"), named.sparkSession.createDataFrame([(1954, "renamed"), (9_999_999, "new one")], "file_id long, name string")
    now = named.filter("file_id NOT IN (977, 1954)").unionByName(fresh)
    as_set = lambda t: {(r["gram"], r["block"], tuple(r["ids"])) for r in t.collect()}
    assert as_set(name_index.refresh(index, gone, fresh)) == as_set(name_index.postings(now))


@pytest.fixture(scope="module")
def passages(spark):
    rng = random.Random(7)
    words = [f"w{i}" for i in range(60)]
    weights = [1 / (i + 1) for i in range(60)]
    rows = [(i, " ".join(rng.choices(words, weights, k=rng.choice([3, 8, 30, 90, 300])))) for i in range(1500)] + [(5000, ""), (5001, None)]
    p = spark.createDataFrame(rows, "passage_id long, text string").cache()
    stats = fulltext.index_stats(p, ["text"]).cache()
    return p, fulltext.postings(p, "passage_id", ["text"]).cache(), stats, topk.index(p, "passage_id", "text", 40).cache()


@pytest.mark.parametrize("query", ["w59 w3", "w0 w1 w2", "w40", "w7 w7 w50", "nothing", "nothing w30"])
@pytest.mark.parametrize("k", [1, 10, 2000])
def test_first_results_are_exact(passages, monkeypatch, query, k):
    p, index, stats, blocks = passages
    monkeypatch.setattr(topk, "BIN", 40)
    monkeypatch.setattr(topk, "NAMED", 5)
    phrases = parse_query(query)

    def finish(scored):
        return scored.withColumn("relevance", F.round("relevance", 9)).filter("passage_id % 7 <> 3").orderBy("relevance", "passage_id").limit(k)

    want = [tuple(r) for r in finish(fulltext.bm25(index, stats, "passage_id", phrases)).collect()]
    assert [tuple(r) for r in topk.best(blocks, stats, topk.plain_words(phrases), "passage_id", k, finish).collect()] == want


def test_fewer_postings_are_read_for_fewer_results(passages):
    p, index, stats, blocks = passages
    asked = ["w59", "w1"]
    ranked = sorted((-r["relevance"] for r in fulltext.bm25(index, stats, "passage_id", parse_query(" ".join(asked))).collect()), reverse=True)
    read = [topk.read_share(blocks, stats, asked, "passage_id", ranked[k - 1]).first() for k in (1, 20, 200)]
    assert read[0]["read"] < read[1]["read"] <= read[2]["read"] and read[0]["read"] < read[0]["postings"] / 3


def test_phrases_and_prefixes_need_places():
    assert topk.plain_words(parse_query('"a b"')) is None and topk.plain_words(parse_query("ab", prefix=True)) is None and topk.plain_words(parse_query("ab cd")) == ["ab", "cd"]


def _shuffles(frame):
    return frame._jdf.queryExecution().executedPlan().toString().count("Exchange ")


def test_postings_are_made_within_their_rows(spark):
    rows = spark.createDataFrame([(1, "b a b", "a"), (2, "", None), (3, "", "C, a")], "key long, x string, y string")
    made = fulltext.postings(rows, "key", ["x", "y"])
    assert _shuffles(made) == 0
    want = [("a", 1, "x", 4, [1]), ("a", 1, "y", 4, [0]), ("a", 3, "y", 2, [1]), ("b", 1, "x", 4, [0, 2]), ("c", 3, "y", 2, [0])]
    assert sorted((r["term"], r["key"], r["field"], r["dl"], r["places"]) for r in made.collect()) == sorted(want)


def test_bounded_postings_shuffle_rows_not_terms(passages):
    plan = topk.index(passages[0], "passage_id", "text", 40)._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(term" not in plan and "hashpartitioning(bin" in plan


def test_long_rows_make_small_bins(spark):
    rows = spark.range(8).select(F.col("id").alias("key"), F.repeat(F.lit("w "), topk.WORDS * 4).alias("text"))
    assert topk.bins(rows, "key", "text", 8).select("bin").distinct().count() > 1


def test_refresh_leaves_dealt_postings_in_place(passages):
    p = passages[0]
    now = fulltext.refresh(fulltext.dealt(p, "passage_id", ["text"]), "passage_id", p.filter("passage_id < 9"), fulltext.postings(p.limit(0), "passage_id", ["text"]))
    assert "SortMergeJoin" not in now._jdf.queryExecution().executedPlan().toString() and now.agg(F.min("passage_id")).first()[0] == 9


def test_only_what_a_request_reads_is_published(spark, tmp_path):
    kept = Snapshots(spark, str(tmp_path))
    made = catalog(spark, "/root/testdata/sf0.001")
    engine = Engine.published(made, kept, ["files", "gram_index"])
    assert sorted(kept.names()) == ["files", "gram_index"] and kept.current() == 2
    Engine.published(made, kept, ["files", "passages", "passage_stats"])
    assert sorted(kept.names()) == ["files", "gram_index", "passage_stats", "passages"]
    request = SearchRequest("report", names_only=True, limit=20)
    assert [tuple(r) for r in engine.search(request).select("file_id", "score").collect()] == [tuple(r) for r in Engine(made).search(request).select("file_id", "score").collect()]


def test_published_passages_are_not_shuffled_for_their_index(spark, tmp_path, monkeypatch):
    made, kept, seen = catalog(spark, "/root/testdata/sf0.001"), Snapshots(spark, str(tmp_path)), {}
    size, publish = 1 << 15, kept.publish

    def watched(tables, **how):
        seen.update({n: (_shuffles(t), t.rdd.getNumPartitions()) for n, t in tables.items()})
        return publish(tables, **how)

    monkeypatch.setattr(fulltext, "TASK_BYTES", size)
    monkeypatch.setattr(kept, "publish", watched)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    Engine.published(made, kept, ["passages", "passage_index"])
    shuffles, parts = seen["passage_index"]
    stored = sum(p.stat().st_size for p in (tmp_path / "v1" / "passages").glob("*.parquet"))
    assert shuffles == 0 and parts >= stored // size > 1 and spark.conf.get("spark.sql.files.maxPartitionBytes") == before
    as_set = lambda t: {(r["term"], r["passage_id"], r["dl"], tuple(r["places"])) for r in t.collect()}
    assert as_set(kept.table("passage_index")) == as_set(fulltext.postings(made.passages, "passage_id", ["text"]))
    groups = [pq.ParquetFile(p).metadata.num_row_groups for p in (tmp_path / "v1" / "passages").glob("*.parquet")]
    assert sum(groups) > len(groups)


def test_a_word_of_all_names_is_dealt_to_many_tasks(spark, tmp_path):
    names_ = F.concat(F.lit("report-"), F.col("id"))
    files = spark.range(20_000).select(F.col("id").alias("file_id"), names_.alias("name"), F.concat(F.lit("report/"), names_).alias("relative_path"))
    kept = Snapshots(spark, str(tmp_path))
    adaptive = "spark.sql.adaptive.coalescePartitions.enabled"
    before = spark.conf.get(adaptive)
    spark.conf.set(adaptive, "false")
    engine = Engine.published(replace(catalog(spark, "/root/testdata/sf0.001"), files=files), kept, ["name_index"])
    spark.conf.set(adaptive, before)
    dealt = engine.name_index.filter("term = 'report'").groupBy(F.input_file_name()).count().collect()
    assert sum(r["count"] for r in dealt) == 40_000 and max(r["count"] for r in dealt) < 25_000


@pytest.mark.parametrize("query", ["w59 w3", '"w0 w1" w40', "w1 nothing"])
def test_a_query_without_index_tokenises_once(passages, query):
    p, index, stats, _ = passages
    phrases = parse_query(query, prefix=True)
    found, counted = fulltext.asked(p, "passage_id", "text", phrases)
    assert counted.first() == stats.first() and "regexp" not in found._jdf.queryExecution().optimizedPlan().toString()
    key = lambda rows: sorted((r["passage_id"], round(r["relevance"], 9)) for r in rows.collect())
    assert key(fulltext.bm25(found, counted, "passage_id", phrases)) == key(fulltext.bm25(index, stats, "passage_id", phrases))
