import sqlite3

import pytest
from pyspark.sql import functions as F

from lodestack.functions import text as tx
from lodestack.operators import fulltext


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_fold_and_words(spark):
    assert one(spark, tx.words(F.lit("Élan_vital-3 straße"))) == ["elan", "vital", "3", "straße"]
    assert tx.word_list("Élan_vital-3 straße") == ["elan", "vital", "3", "straße"]


@pytest.mark.parametrize("query", ['"', "'", "OR AND NOT", "name:x*", "(((", "😀", '"a" OR "b', "NEAR(a b)", "--", "\\"])
def test_hostile_queries_parse(query):
    for exact in (False, True):
        assert all(p.tokens for p in tx.parse_query(query, exact))


def test_parse_groups_and_limits():
    assert tx.parse_query('red "blue green" x') == [tx.Phrase(("red",)), tx.Phrase(("blue", "green")), tx.Phrase(("x",))]
    assert tx.parse_query('"of the"') == [tx.Phrase(("of", "the"))]
    assert len(tx.parse_query(" ".join("abc" for _ in range(40)))) == 24


@pytest.mark.parametrize(("path", "patterns", "out"), [("a/b.txt", ["*.txt"], True), ("a/b.txt", ["a"], True), ("a/b.txt", ["/a/"], True), ("x/a/b", ["a/b"], False), ("a/b/c", ["a/b"], True), ("a/b", ["", " "], False), ("k1", ["k[!2]"], True)])
def test_exclusion(spark, path, patterns, out):
    assert one(spark, tx.excluded(F.lit(path), patterns)) is out


def test_column_name(spark):
    assert [one(spark, tx.column_name(F.lit(n))) for n in (1, 26, 27, 52, 702, 703)] == ["A", "Z", "AA", "AZ", "ZZ", "AAA"]


BOOKS = ["the quick brown fox", "quick quick dog", "a lazy dog sleeps near the fox", "nothing here", "foxes and dogs", "the the the", "brown dog, quick fox!"]


@pytest.mark.parametrize(("match", "query", "prefix"), [('"quick"', "quick", False), ('"quick" OR "dog"', "quick dog", False), ('"brown fox"', '"brown fox"', False), ('"fox"*', "fox", True), ('"the"', "the", False)])
def test_bm25_equals_sqlite(spark, match, query, prefix):
    con = sqlite3.connect(":memory:")
    con.execute("CREATE VIRTUAL TABLE t USING fts5(text, tokenize='unicode61 remove_diacritics 2')")
    con.executemany("INSERT INTO t(rowid, text) VALUES (?, ?)", list(enumerate(BOOKS, 1)))
    want = dict(con.execute("SELECT rowid, bm25(t) FROM t WHERE t MATCH ?", (match,)).fetchall())
    rows = spark.createDataFrame(list(enumerate(BOOKS, 1)), "id long, text string")
    got = fulltext.bm25(fulltext.postings(rows, "id", ["text"]), fulltext.index_stats(rows, ["text"]), "id", tx.parse_query(query, prefix=prefix))
    got = {r["id"]: r["relevance"] for r in got.collect()}
    assert got.keys() == want.keys()
    assert all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_index_refresh(spark):
    rows = spark.createDataFrame(list(enumerate(BOOKS, 1)), "id long, text string")
    index = fulltext.postings(rows, "id", ["text"])
    new = spark.createDataFrame([(1, "entirely new")], "id long, text string")
    fresh = fulltext.refresh(index, "id", new, fulltext.postings(new, "id", ["text"]))
    assert {r["term"] for r in fresh.filter("id = 1").collect()} == {"entirely", "new"}


def test_highlight(spark):
    assert one(spark, fulltext.highlight(F.lit("The cat THE end of it"), "the of")) == "[The] cat [THE] end of it"


def test_batch_functions(spark):
    from lodestack.functions.batch import composed, fnv1a, negative_id

    assert fnv1a("") == 14695981039346656037 and fnv1a("a") == 0xAF63DC4C8601EC8C
    assert one(spark, composed(F.lit("e\u0301"))) == "é" and one(spark, negative_id(F.lit("/a"))) < 0
