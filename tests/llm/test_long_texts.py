"""Very long texts, words, and lists of matches: whole results, in about linear time."""

import hashlib
import random
import re
import time

import numpy as np
import pytest

from lodestack.llm import bpe_codec, line_dedup, ngram_join, quality_rules, secret_scan, simhash, token_counts
from lodestack.llm.word_bpe import TOKENIZER, WordTable, library, vocabulary
from tests.llm.test_text_operators import measured_by_hand, print_by_hand, spans_by_hand


def test_many_shared_lines_in_one_text(spark):
    n = 20_000
    shared = [f"shared line number {i} that is longer than forty characters" for i in range(n)]
    text = "\n".join(x for i, line in enumerate(shared) for x in (line, f"own {i}"))
    docs = spark.createDataFrame([(i, text) for i in range(5)], "doc_id long, text string")
    began = time.time()
    got = {r["doc_id"]: r for r in line_dedup.drop_shared_lines(docs).collect()}
    assert time.time() - began < 30
    assert got[4]["text"] == text and got[0]["n_dropped"] == n and got[0]["n_lines"] == 2 * n
    assert got[0]["text"] == "\n".join(f"own {i}" for i in range(n))


def test_many_secrets_in_one_text(spark):
    text = " ".join(f"password=abcdef{i} AKIA{i:016d} {i:030x} é" for i in range(20_000))
    docs = spark.createDataFrame([(1, text), (2, "x"), (3, "token=" + "a" * 1_000_000)], "doc_id long, text string")
    began = time.time()
    got = {r["doc_id"]: [(s["start"], s["kind"], s["end"]) for s in r["spans"]] for r in secret_scan.scan(docs).collect()}
    assert time.time() - began < 30
    assert got[1] == spans_by_hand(text) and len(got[1]) >= 60_000 and got[2] == [] and got[3] == spans_by_hand("token=" + "a" * 1_000_000)


def test_exact_lengths_find_what_the_contract_asks():
    rng = random.Random(3)
    rules = {r.kind: r for r in secret_scan.RULES}
    for kind, open_, least, letters in (("hex", r"[0-9a-f]+", 24, "0af g"), ("access", r"AKIA[A-Z0-9]+", 20, "AKI0 ")):
        for _ in range(300):
            t = "".join(rng.choice(["AKIA", "0" * 9, *letters]) for _ in range(60))
            want = [m.span() for m in re.finditer(open_, t) if len(m[0]) >= least]
            assert [m.span() for m in re.finditer(rules[kind].regex, t)] == want


@pytest.mark.parametrize("word", ["a" * 100_000, "".join(random.Random(1).choices("abcdefghijklmnop", k=100_000)), "é" * 30_000, "ab" * 40_000 + "123" * 5_000])
def test_giant_words(word):
    v, codec = bpe_codec.codec(TOKENIZER)
    want = library(TOKENIZER).encode(word, add_special_tokens=False).ids
    began = time.process_time()
    assert token_counts._table(TOKENIZER).token_counts([word.encode()]).tolist() == [len(want)]
    ids, n = codec.token_ids([word.encode()])
    assert time.process_time() - began < 20
    assert n.tolist() == [len(want)] and hashlib.sha256(ids.astype("<u4").tobytes()).digest() == hashlib.sha256(np.array(want, "<u4").tobytes()).digest()


def test_long_and_short_sequences_merge_alike():
    v = vocabulary(TOKENIZER)
    merger, rng = token_counts.RankMerger(v.merges), random.Random(5)
    words = ["".join(rng.choices(["th", "e", "in", "g", "a", "x", "tion"], k=rng.randrange(1, 90))) for _ in range(300)]
    for w, short in zip(words, merger.merge([v.symbols(w) for w in words]), strict=True):
        assert merger.merge_long(v.symbols(w)).tolist() == short.tolist() == library(TOKENIZER).encode(w, add_special_tokens=False).ids


def test_word_table_is_bounded_by_bytes():
    v = vocabulary(TOKENIZER)
    merger = token_counts.RankMerger(v.merges)
    table = WordTable(lambda chunks: v.encode_chunks(chunks, lambda pre: merger.merge([v.symbols(p) for p in pre])), limit_bytes=10_000)
    for i in range(20):
        word = f"{i}" + "abc" * 1_000
        assert table.token_counts([word.encode()]).tolist() == [len(library(TOKENIZER).encode(word, add_special_tokens=False).ids)]
        assert table.bytes < 10_000 + 20_000


def test_long_text_of_few_words():
    line = "one two three four five six seven "
    n, chars, symbols, dup, repeated, lines = quality_rules._measure((line * 30_000).encode())
    assert (n, chars, symbols, dup, repeated, lines) == (210_000, 30_000 * len(line.replace(" ", "")), 0, 0, 210_000, 1)
    assert measured_by_hand(line * 30) == (210, 30 * len(line.replace(" ", "")), 0, 0, 210)
    assert simhash.fingerprint((line * 600).encode()) == print_by_hand(line * 600)
    assert len(ngram_join.shingle_sets([(line * 30_000).encode()])[0]) == 7
