"""Operators 11 to 13 against brute force, on the supplied tables and on small fixtures."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict
from itertools import combinations
from zlib import crc32

import pyarrow.parquet as pq
import pytest
from lodestack.llm import importance, ngram_join, queries, spelling

SF = "/root/testdata/sf0.001"
KEYED = "doc_id long, text string"


def supplied(name, *columns):
    t = pq.read_table(f"{SF}/{name}.parquet")
    return list(zip(*[t[c].to_pylist() for c in columns], strict=True))


# Operator 11


def features_by_hand(text):
    w = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return len(w), [" ".join(w[i : i + n]) for n in (1, 2, 3) for i in range(len(w) - n + 1)]


def resampled_by_hand(docs, target):
    def counted(texts):
        return Counter(crc32(f.encode()) % 10000 for t in texts for f in features_by_hand(t)[1])

    s, t = counted([x for _, x in docs]), counted(target)
    total_s, total_t = sum(s.values()), sum(t.values())
    rows = []
    for key, text in docs:
        n, fs = features_by_hand(text)
        weight = sum(math.floor(1000 * math.log((t[b] + 1) * (total_s + 10000) / ((s[b] + 1) * (total_t + 10000)))) for b in (crc32(f.encode()) % 10000 for f in fs))
        h = int(hashlib.sha256(f"42:{'' if key is None else key}".encode()).hexdigest()[:8], 16)
        rows.append([key, n, len(fs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))])
    fit = sorted((r for r in rows if r[1] >= 20), key=lambda r: (-r[4], r[0] is None, r[0] or 0))
    rank = {id(r): i + 1 for i, r in enumerate(fit[: 5 * len(fit) // 100])}
    return [(r[0], *r[2:], rank.get(id(r))) for r in rows]


def test_resampling_equals_brute_force(spark):
    want = resampled_by_hand(supplied("documents", "doc_id", "text"), [t for (t,) in supplied("benchmark", "text")])
    got = queries.op11_importance_resampling(spark, SF)
    assert sorted(map(tuple, got.select("doc_id", "n_features", "weight", "score", "rank").collect())) == sorted(want)


def odd_texts():
    rng = random.Random(3)
    texts = [None, "", " ", "ÀÉ é É", "a" * 5000, "one", "One two", "x\x00y", "ab1 2c 💡 x", " ".join(f"w{rng.randrange(50)}" for _ in range(150_000))]
    return [(i, t) for i, t in enumerate(texts)] + [(None, "word " * 30), (7, "twin text"), (7, "twin text")] + [(100 + i, " ".join(f"w{rng.randrange(99)}" for _ in range(30))) for i in range(40)]


def test_resampling_of_odd_texts(spark):
    docs, target = odd_texts(), [("w1 w2 w3 " * 20,), (None,)]
    frame = spark.createDataFrame([(*d, 1, 2) for d in docs], KEYED + ", rank int, weight int")
    got = importance.resample(frame, spark.createDataFrame(target, "text string"))
    order = lambda r: tuple((x is None, x or 0) for x in r)
    assert sorted(map(tuple, got.select("doc_id", "n_features", "weight", "score", "rank").collect()), key=order) == sorted(resampled_by_hand(docs, [t for (t,) in target]), key=order)
    none = spark.createDataFrame([], KEYED)
    assert importance.resample(none, none).collect() == []


# Operator 12


def shingles_by_hand(text):
    w = [x for x in re.split("[\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if x]
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def components_by_hand(docs):
    sets = [shingles_by_hand(t) for _, t in docs]
    held, shared = defaultdict(list), Counter()
    for i, s in enumerate(sets):
        for x in s:
            for j in held[x]:
                shared[j, i] += 1
            held[x].append(i)
    root = list(range(len(docs)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for (i, j), n in shared.items():
        if 100 * n >= 80 * (len(sets[i]) + len(sets[j]) - n):
            root[find(j)] = find(i)
    least = {}
    for i, (key, _) in enumerate(docs):
        if key is not None:
            least[find(i)] = min(key, least.get(find(i), key))
    return sorted(((key, len(s), least.get(find(i))) for i, ((key, _), s) in enumerate(zip(docs, sets, strict=True))), key=str)


def joined(frame):
    return sorted(map(tuple, frame.select("doc_id", "n_shingles", "component_id").collect()), key=str)


def test_jaccard_join_equals_brute_force(spark):
    assert joined(queries.op12_ngram_jaccard_join(spark, SF)) == components_by_hand(supplied("documents", "doc_id", "text"))


@pytest.mark.parametrize("block", [300, 1 << 20])
def test_jaccard_join_of_families_and_shared_passages(spark, monkeypatch, block):
    """Large families around the threshold, a passage in many texts and copies; blocks of few tokens meet in ranges."""
    monkeypatch.setattr(ngram_join, "BLOCK", block)
    monkeypatch.setattr(ngram_join, "CROWD", 4)
    rng, docs = random.Random(8), []
    passage = " ".join(f"p{i}" for i in range(60))
    for family in range(3):
        base = [f"{family}-{rng.randrange(10**6)}" for _ in range(100)]
        for k in range(60):
            w = list(base)
            for _ in range(rng.randrange(5)):
                w[rng.randrange(100)] = f"x{rng.randrange(10**6)}"
            docs.append((family * 100 + k, " ".join(w)))
    docs += [(1000 + i, " ".join(f"q{rng.randrange(10**6)}" for _ in range(20 + i)) + " " + passage) for i in range(40)]
    docs += [(2000 + i, docs[i % 7][1]) for i in range(50)]
    rng.shuffle(docs)
    assert joined(ngram_join.jaccard_components(spark.createDataFrame(docs, KEYED))) == components_by_hand(docs)


def test_jaccard_join_of_odd_texts(spark):
    docs = odd_texts() + [(20, "A b"), (21, "a  B"), (22, "a b c"), (23, " "), (24, "word " * 31)]
    frame = spark.createDataFrame([(*d, b"s", 1) for d in docs], KEYED + ", sid binary, n int")
    assert joined(ngram_join.jaccard_components(frame)) == components_by_hand(docs)
    assert ngram_join.jaccard_components(spark.createDataFrame([], KEYED)).collect() == []


def test_jaccard_threshold_is_exact(spark):
    base = [f"w{i}" for i in range(40)]  # 36 shingles
    docs = [(i, " ".join(base + [f"t{j}" for j in range(i)])) for i in range(12)]
    assert joined(ngram_join.jaccard_components(spark.createDataFrame(docs, KEYED))) == components_by_hand(docs)
    four, five = " ".join(base[:8]), " ".join(base[:9])  # 4 of 5 shingles: exactly the threshold
    assert {r[2] for r in joined(ngram_join.jaccard_components(spark.createDataFrame([(1, four), (2, five)], KEYED)))} == {1}


# Operator 13


def variants_by_hand(docs):
    n = Counter()
    for key, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = crc32(f"{'' if key is None else key}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    n = {w: c for w, c in n.items() if len(w) >= 7 and c >= 2}
    cut = defaultdict(set)
    for w in n:
        for i in range(len(w)):
            cut[w[:i] + "*" + w[i + 1 :]].add(w)
    near = defaultdict(set)
    for group in cut.values():
        for a, b in combinations(group, 2):
            near[a].add(b)
            near[b].add(a)
    for w in n:
        for i in range(len(w)):
            if (d := w[:i] + w[i + 1 :]) in n:
                near[w].add(d)
                near[d].add(w)
    form = {}
    for w, found in near.items():
        best = min(found, key=lambda x: (-n[x], x))
        if n[best] >= 10 * n[w]:
            form[w] = best

    def root(w):
        return root(form[w]) if w in form else w

    return sorted(((w, form.get(w), root(w), n[w], len(near[w]), n.get(form.get(w))) for w in n), key=str)


def grouped(frame):
    return sorted(map(tuple, frame.select("word", "form", "root", "n", "n_near", "form_n").collect()), key=str)


def test_variants_equal_brute_force(spark):
    assert grouped(queries.op13_spelling_variants(spark, SF)) == variants_by_hand(supplied("documents", "doc_id", "text"))


def test_variants_over_several_shards_and_broadcasts(spark, monkeypatch):
    monkeypatch.setattr(spelling, "HELD_WORDS", 40)
    monkeypatch.setattr(spelling, "SHARD_WORDS", 7)
    monkeypatch.setattr(spelling, "BROADCAST_BYTES", 2000)
    rng, docs = random.Random(4), []
    stems = ["kitchen", "journey", "Élevage", "aaaaaaaa", "zürichsee", "balloons"]
    for i in range(400):
        w = rng.choice(stems)
        for _ in range(rng.choice([0, 0, 0, 0, 0, 1, 1, 2, 3])):
            at = rng.randrange(len(w))
            w = rng.choice([w[:at] + w[at + 1 :], w[:at] + rng.choice("aeÉß") + w[at:], w[:at] + rng.choice("xyÀ") + w[at + 1 :]])
        docs.append((i % 90, f"{w}, {w} short {w}7{w}"))
    docs += [*odd_texts(), (500, "kitchen " * 500), (501, "kitchenx " * 31), (502, "kitchenxy kitchenxy")]
    want = variants_by_hand(docs)
    assert grouped(spelling.variants(spark.createDataFrame([(*d, "w", 1) for d in docs], KEYED + ", word string, n int"))) == want
    assert any(w[1] and w[2] != w[1] for w in want), "no chain of forms"
    assert spelling.variants(spark.createDataFrame([], KEYED)).collect() == []


def test_trie_finds_each_neighbour():
    rng = random.Random(2)
    words = sorted({"".join(rng.choice("abé") for _ in range(rng.randrange(7, 10))) for _ in range(400)})
    tries = {k: spelling.Trie.of(*map(list, zip(*[(w, i + 1) for i, w in enumerate(words) if len(w) == k], strict=True))) if 7 <= k < 10 else spelling.Trie.of([], []) for k in range(6, 11)}

    def apart(a, b):
        if abs(len(a) - len(b)) > 1 or a == b:
            return False
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b, strict=True)) == 1
        a, b = sorted((a, b), key=len)
        return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))

    for w in words[:120]:
        assert {x: n for length in range(6, 11) if abs(length - len(w)) < 2 for x, n in tries[length].near(w, length).items()} == {x: i + 1 for i, x in enumerate(words) if apart(w, x)}
