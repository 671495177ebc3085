"""The near-dedup stage against Jaccard by brute force."""

import random
from collections import defaultdict

import corpus_pipeline
import pyarrow.parquet as pq
from lodestack.llm import near_copies, ngram_join, simhash


def shingles_by_hand(text, k=5):
    w = (text or "").encode().lower().split()
    return frozenset(b" ".join(w[i : i + k]) for i in range(max(1, len(w) - k + 1))) if w else frozenset()


def pairs_by_hand(docs):
    """All pairs of keys with different sets of similarity 0.8 or more, by an inverted index."""
    sets = {i: shingles_by_hand(t) for i, t in docs}
    at, shared = defaultdict(list), defaultdict(int)
    for i, s in sets.items():
        for x in s:
            for j in at[x]:
                shared[j, i] += 1
            at[x].append(i)
    return {(a, b) for (a, b), n in shared.items() if 5 * n >= 4 * (len(sets[a]) + len(sets[b]) - n) and sets[a] != sets[b]}


def test_recall_on_documents(spark):
    path = "/root/testdata/sf0.01/documents.parquet"
    t = pq.read_table(path)
    want = pairs_by_hand(list(zip(t["doc_id"].to_pylist(), t["text"].to_pylist(), strict=True)))
    got = {r["doc_id"]: r["component_id"] for r in near_copies.near_copies(spark.read.parquet(path)).collect()}
    found = sum(got[a] == got[b] for a, b in want)
    print(f"{found} of {len(want)} pairs")
    assert len(want) > 10 and found == len(want)


def test_stage_drops_near_copies_and_keeps_others(spark):
    rng = random.Random(5)
    words = [f"w{rng.randrange(10**6)}" for _ in range(200)]
    near, far = list(words), list(words)
    near[50] = near[150] = "edited"  # 10 of 196 shingles
    for i in range(0, 200, 10):
        far[i] = "changed"  # most shingles are lost
    rows = [(i, " ".join(w), "en", "s", 1) for i, w in enumerate((words, near, far, reversed(words)))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted(r["doc_id"] for r in corpus_pipeline.near_dedup(spark, docs, "").collect()) == [0, 2, 3]


def test_crowd(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "CROWD", 4)
    rng = random.Random(6)
    docs = []
    for family in range(3):
        base = [f"{family}-{rng.randrange(10**6)}" for _ in range(120)]
        for k in range(60):
            w = list(base)
            for _ in range(rng.randrange(6)):
                w[rng.randrange(120)] = f"x{rng.randrange(10**6)}"
            docs.append((family * 100 + k, " ".join(w)))
    got = {r["doc_id"]: r["component_id"] for r in near_copies.near_copies(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    want = pairs_by_hand(docs)
    assert all(got[a] == got[b] for a, b in want) and len(set(got.values())) >= 3
    prints = {i: simhash.fingerprint(t.encode()) for i, t in docs}  # operator 10's links count too
    linked = {i for p in want for i in p} | {i for i in prints for j in prints if i != j and (prints[i] ^ prints[j]).bit_count() <= simhash.RADIUS}
    assert all(got[i] == i or i in linked for i in got if len({j for j in got if got[j] == got[i]}) > 1)
