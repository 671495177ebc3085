"""Counts of near words as tiles."""

import random
from collections import Counter

import numpy as np
import pytest

from lodestack.operators import encoder, word_tiles
from lodestack.runtime import materialize


@pytest.fixture
def small(monkeypatch):
    """Bounds so low that a few texts make many blocks, ranges and pieces."""
    for name, value in (("BLOCK", 200), ("SIDE", 8), ("PIECE", 5)):
        monkeypatch.setattr(word_tiles, name, value)


def _texts(spark):
    rng = random.Random(5)
    rows = [(i, " ".join(rng.choices([f"w{k}" for k in range(40)], [1 / (k + 1) for k in range(40)], k=rng.randrange(1, 40)))) for i in range(120)]
    return rows, spark.createDataFrame([*rows, (900, None), (901, " - "), (902, "w0 w0 w0")], "passage_id long, text string").repartition(3)


def test_tiles_hold_every_near_pair(spark, small):
    rows, texts = _texts(spark)
    n, seen = Counter(), Counter()
    for w in [t.split() for _, t in rows] + [["w0"] * 3]:
        seen.update(w)
        for i in range(len(w)):
            n.update(tuple(sorted((w[i], w[j]))) for j in range(i + 1, min(i + 6, len(w))))
    n = {p: c for p, c in n.items() if min(seen[p[0]], seen[p[1]]) >= 10}
    made = word_tiles.counted(texts, "text", 10, encoder.WINDOW)
    want = n | {(b, a): c for (a, b), c in n.items()}
    assert {(r["a"], r["b"]): r["n"] for r in made.rows().collect()} == want
    assert made.pairs.filter("p <> q").count() > 0 and made.pairs.groupBy("p", "q").count().filter("count > 1").count() > 0
    assert made.total == sum(want.values())
    weights = encoder.weights(made.rows()).groupBy("a").agg({"*": "count", "x": "sum"}).collect()
    assert {r["word"]: (r["partners"], round(r["weight"], 6)) for r in made.partners().collect()} == {r["a"]: (r["count(1)"], round(r["sum(x)"], 6)) for r in weights}


def test_no_pair_is_a_row(spark):
    """A corpus of one block and one range: thousands of pairs are one row, written once."""
    _, texts = _texts(spark)
    made = word_tiles.counted(texts.coalesce(1), "text", 1, encoder.WINDOW)
    assert made.pairs.count() == 1 and made.rows().count() > 1000
    assert made.ids.groupBy("p", "i").count().filter("count > 1").count() == 0


def test_a_factor_over_many_ranges_reproduces_the_matrix(spark, small, monkeypatch):
    monkeypatch.setattr(encoder, "CHUNK", 7)
    _, texts = _texts(spark)
    counts = word_tiles.counted(texts, "text", 20, encoder.WINDOW)
    words = sorted(r["word"] for r in counts.ids.collect())
    x = {(r["a"], r["b"]): r["x"] for r in encoder.weights(counts.rows()).collect()}
    values, turned = np.linalg.eigh(np.array([[x.get((a, b), 0.0) for b in words] for a in words]))
    made = encoder.train(texts, rank=len(words), least=20)
    assert {r["p"] for r in counts.ids.select("p").distinct().collect()} > {0}
    idf = {r["word"]: r["idf"] for r in counts.ids.collect()}
    v = {r["word"]: np.array(r["v"]) / idf[r["word"]] for r in made.vectors.collect()}
    none = np.zeros(len(words))
    assert np.allclose([[v.get(a, none) @ v.get(b, none) for b in words] for a in words], turned * np.maximum(values, 0) @ turned.T, atol=1e-6)


def test_a_product_shuffles_no_part_of_the_matrix(spark, small):
    _, texts = _texts(spark)
    counts = word_tiles.counted(texts, "text", 20, encoder.WINDOW)
    matrix = materialize(encoder._both_orders(counts.pairs, 4), "test-matrix")
    factor = encoder._by_range(encoder._sketch(counts.ids, 3), "test-factor", 3)
    made = encoder._times(matrix, counts.total, encoder._by_range(counts.margins, "test-margins", 1), factor)
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan
    assert made.select("p").distinct().count() == counts.margins.count()
