"""The encoder that is trained on the corpus."""

import math
import random
from collections import Counter

import numpy as np

from lodestack.operators import encoder, vectors


def corpus(spark):
    """Sentences of two topics; 'car' and 'auto' stand in the same places of one, never together."""
    rng = random.Random(3)
    road, kitchen = [f"road{i}" for i in range(12)], [f"pot{i}" for i in range(12)]
    rows = []
    for i in range(600):
        own, thing = (road, rng.choice(["car", "auto"])) if i % 2 else (kitchen, rng.choice(["soup", "stew"]))
        w = [*rng.sample(own, 4), thing, *rng.sample(own, 4), "the"]
        rows.append((i, " ".join(w)))
    return spark.createDataFrame([*rows, (9000, None), (9001, " - ")], "passage_id long, text string").cache()


def test_words_of_like_company_are_near(spark):
    made = encoder.train(corpus(spark), rank=8)
    texts = spark.createDataFrame([(0, "car"), (1, "auto"), (2, "soup"), (3, "a stew, the"), (4, "unknown words"), (5, None)], "id long, text string")
    v = {r["id"]: np.array(r["vector"]) for r in made.encode(texts, "id", "text").collect()}
    assert set(v) == {0, 1, 2, 3} and all(abs(np.linalg.norm(x) - 1) < 1e-5 for x in v.values())
    assert v[0] @ v[1] > 0.9 and v[2] @ v[3] > 0.8 and v[0] @ v[2] < 0.4
    assert abs(np.dot(vectors.encode_text("car"), vectors.encode_text("auto"))) < 0.5  # the hashed encoder sees no likeness
    again = encoder.train(corpus(spark), rank=8)
    w = {r["id"]: np.array(r["vector"]) for r in again.encode(texts, "id", "text").collect()}
    assert all(np.allclose(abs(v[i] @ v[0]), abs(w[i] @ w[0]), atol=1e-4) for i in v)


def test_factors_reproduce_the_matrix(spark):
    """With all columns the product of the factors is the matrix's part of positive eigenvalues."""
    texts = spark.createDataFrame([(i, "a b c a b d e a c e b d " * 3) for i in range(3)] + [(9, "a e d d c b a e " * 4)], "passage_id long, text string")
    vocab = encoder.vocabulary(texts, "passage_id", "text", 2)
    m = {(r["a"], r["b"]): r["x"] for r in encoder.weights(encoder.cooccurrences(texts, "passage_id", "text", vocab)).collect()}
    words = sorted({a for a, _ in m})
    full = np.array([[m.get((a, b), 0.0) for b in words] for a in words])
    values, turned = np.linalg.eigh(full)
    want = turned * np.maximum(values, 0) @ turned.T
    made = encoder.train(texts, rank=len(words), least=2)
    idf = {r["word"]: r["idf"] for r in vocab.collect()}
    v = {r["word"]: np.array(r["v"]) / idf[r["word"]] for r in made.vectors.collect()}
    assert np.allclose([[v[a] @ v[b] for b in words] for a in words], want, atol=1e-6)


def test_weights_equal_plain_python(spark):
    texts = [(0, "one two one three two four five six one two"), (1, "two one"), (2, "six five")]
    n = Counter()
    for _, t in texts:
        w = t.split()
        for i in range(len(w)):
            for j in range(i + 1, min(i + 6, len(w))):
                n[tuple(sorted((w[i], w[j])))] += 1
    both = Counter(n)
    both.update({(b, a): c for (a, b), c in n.items() if a != b})
    m = Counter()
    for (a, _), c in both.items():
        m[a] += c
    total = sum(m.values())
    want = {p: math.log(c * total / m[p[0]] / m[p[1]]) for p, c in both.items() if c * total > m[p[0]] * m[p[1]]}
    frame = spark.createDataFrame(texts, "passage_id long, text string")
    got = encoder.weights(encoder.cooccurrences(frame, "passage_id", "text", encoder.vocabulary(frame, "passage_id", "text", 1))).collect()
    assert {(r["a"], r["b"]): round(r["x"], 9) for r in got} == {p: round(x, 9) for p, x in want.items()}


def test_an_empty_corpus_knows_no_word(spark):
    none = spark.createDataFrame([], "passage_id long, text string")
    assert encoder.train(none, rank=4).encode(corpus(spark), "passage_id", "text").collect() == []


def test_words_that_cancel_each_other_out_have_a_vector(spark):
    """w29 and w42 have one place and opposite signs."""
    assert np.isclose(np.linalg.norm(vectors.encode_text("w29 w42")), 1) and vectors.encode_text(" - ") is None
    passages = spark.createDataFrame([(1, "c", 0, "w29 w42"), (2, "c", 1, "?")], "passage_id long, content_id string, ordinal int, text string")
    files, held = spark.createDataFrame([(1, "c")], "file_id long, content_id string"), spark.createDataFrame([], "passage_id long, model string")
    assert [r["passage_id"] for r in vectors.backfill(passages, held, files).collect()] == [1]
