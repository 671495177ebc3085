"""The pipeline against plain Python versions of its stages."""

from collections import defaultdict

import corpus_pipeline
from lodestack.llm.word_bpe import TOKENIZER, library
from tests.llm.test_near_copies import pairs_by_hand, shingles_by_hand
from tests.llm.test_text_operators import SPACE, UPPER, classes_by_hand, corpus, kept_by_hand, print_by_hand

SF = "/root/testdata/sf0.001"


def least_of_groups(docs):
    """Smallest id of each document's group: links of two fingerprint bits or of Jaccard similarity 0.8, over all pairs."""
    root = {i: i for i in docs}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    sets = defaultdict(list)
    for i, t in docs.items():
        sets[shingles_by_hand(t)].append(i)
    links = [*pairs_by_hand(list(docs.items())), *((same[0], i) for same in sets.values() for i in same)]
    links += [(i, r) for i, r in classes_by_hand([(i, print_by_hand(t)) for i, t in docs.items()]).items()]
    for i, j in links:
        x, y = find(i), find(j)
        root[max(x, y)] = min(x, y)
    return {i: find(i) for i in docs}


def by_hand(bench):
    import re

    kept = kept_by_hand(corpus())
    docs = {i: t for i, t, _ in corpus() if i in kept}
    holders = defaultdict(set)
    key = lambda x: x.strip(SPACE).translate(UPPER)
    for i, t in docs.items():
        for x in t.split("\n"):
            holders[key(x)].add(i)
    lost = {k: max(v) for k, v in holders.items() if len(k) >= 40 and len(v) >= 5}
    docs = {i: "\n".join(x for x in t.split("\n") if lost.get(key(x), i) == i) for i, t in docs.items()}
    roots = least_of_groups(docs)
    docs = {i: t for i, t in docs.items() if roots[i] == i}
    words = lambda t: " ".join(re.findall(r"[^\W_]+", t.lower()))
    return {i: t for i, t in docs.items() if not any(f" {words(b)} " in f" {words(t)} " for b in bench)}


def test_run(spark):
    bench = [r["text"] for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    got = {r["doc_id"]: r for r in corpus_pipeline.run(spark, SF).collect()}
    want = by_hand(bench)
    assert {i: r["text"] for i, r in got.items()} == want
    for r in got.values():
        assert r["n_chars"] == len(r["text"]) and r["ids"] == library(TOKENIZER).encode(r["text"], add_special_tokens=False).ids and r["n_tokens"] == len(r["ids"])


def test_stages_keep_the_columns(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert 4 <= len(corpus_pipeline.STAGES) <= 5
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, SF).dtypes == docs.dtypes
        assert stage(spark, docs.limit(0), SF).count() == 0


def test_repeated_rows(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").filter("doc_id < 20")
    twice = docs.union(docs)
    once = corpus_pipeline.near_dedup(spark, docs, SF).count()
    assert corpus_pipeline.near_dedup(spark, twice, SF).count() == once


def test_null_columns(spark):
    rows = [(None, "some words of a text without a key, long enough to stay in here", None, None, None), (1, None, "en", None, None), (2, "", None, "s", 0), (3, "another text of more than ten words that should stay where it is", None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
    assert sorted((r["doc_id"] or 0) for r in docs.collect()) == [0, 3]


def test_rows_are_told_apart_by_key_and_text(spark):
    words = [f"w{i}" for i in range(300)]
    one, two = " ".join(words), " ".join(reversed(words))
    near = " ".join([*words[:150], "edited", *words[151:]])
    rows = [(1, one, "en", "b", 1), (1, one, "de", "a", 1), (1, two, "en", "s", 1), (None, near, "en", "s", 1), (None, "some words of its own", None, None, None), (None, "some words of its own", None, None, None)]
    docs = spark.createDataFrame([(*r, 7) for r in rows], "doc_id long, text string, lang string, source string, n_chars long, extra int")
    got = sorted(((r["doc_id"] or 0), r["text"], r["source"]) for r in corpus_pipeline.near_dedup(spark, docs, "").collect())
    assert got == [(0, "some words of its own", None), (1, one, "a"), (1, two, "s")]


def test_rows_without_key_leak_too(spark):
    item = spark.read.parquet(f"{SF}/benchmark.parquet").first()["text"]
    docs = spark.createDataFrame([(None, f"before it {item} after it", None, None, 1), (None, "a clean text", None, None, 1)], "doc_id long, text string, lang string, source string, n_chars long")
    assert [r["text"] for r in corpus_pipeline.decontaminated(spark, docs, SF).collect()] == ["a clean text"]


def test_missing_columns(spark):
    docs = spark.createDataFrame([(1, "a text of more than ten words that is neither short nor repeated at all")], "doc_id long, text string")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
    assert docs.count() == 1
