"""Operators 6, 7 and 8 against the tokenizers library."""

import hashlib
import random
import zlib

import numpy as np
import pyarrow.parquet as pq
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lodestack.llm import bpe_codec, frame_store, queries, token_counts
from lodestack.llm.word_bpe import TOKENIZER, library
from lodestack.runtime import scratch

SF = "/root/testdata/sf0.001"
EDGE = ["", " ", "\n\t\x0b", "a", "aaaa" * 500, "-----" * 200, "<|endoftext|>", "x<|startoftext|>y<|endoftext|><|endoftext|>", "<|EndOfText|>", "ΑΣ Σς", "İstanbul", "ée", "a\u0085b c", "日本語テキスト", "😀😀👩‍👩‍👧", "it's we'll I'D", "½²٣", "́start", "hahaha" * 100, "0123456789" * 30]


def reference(texts):
    return [e.ids for e in library(TOKENIZER).encode_batch(texts, add_special_tokens=False)]


def ids_by(table, texts):
    flat, n = table.token_ids([t.encode() for t in texts])
    return [x.tolist() for x in np.split(flat, np.cumsum(n)[:-1])]


TABLES = {"merging": token_counts._table, "prefixes": lambda n: bpe_codec.codec(n)[1], "library": frame_store._table}


@pytest.mark.parametrize("how", TABLES)
def test_edge_texts(how):
    assert ids_by(TABLES[how](TOKENIZER), EDGE) == reference(EDGE)


@pytest.mark.parametrize("how", TABLES)
def test_corpus(how):
    texts = pq.read_table(f"{SF}/documents.parquet")["text"].to_pylist()
    assert ids_by(TABLES[how](TOKENIZER), texts) == reference(texts)


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from("abcdehinorst '<|>-.!é́"), st.characters(exclude_categories=["Cs"])), max_size=60))
def test_any_text(text):
    want = reference([text])
    assert all(ids_by(t(TOKENIZER), [text]) == want for t in TABLES.values())


def test_few_letters():
    rng = random.Random(5)
    texts = ["".join(rng.choice("abhorst") for _ in range(rng.randint(1, 60))) for _ in range(400)]
    assert all(ids_by(t(TOKENIZER), texts) == reference(texts) for t in TABLES.values())


def test_forgetting_changes_nothing():
    v, _ = bpe_codec.codec(TOKENIZER)
    small = type(bpe_codec.codec(TOKENIZER)[1])(bpe_codec.codec(TOKENIZER)[1].encode, limit=3)
    for _ in range(3):
        assert ids_by(small, EDGE) == reference(EDGE)


ROWS = [(1, "one two", "x"), (1, "one two", "x"), (2, None, None), (None, "three", "y"), (3, "", "z"), (4, "long " * 50_000, "w")]


@pytest.fixture
def docs(spark):
    # Extra columns clash with the names of the results.
    return spark.createDataFrame([(*r, 9, "d", [1], True) for r in ROWS], "doc_id long, text string, lang string, n_tokens int, decoded string, ids array<int>, over_limit boolean")


def test_count_tokens(docs):
    got = {(r["doc_id"], r["n_bytes"]): (r["n_tokens"], r["over_limit"], r["lang"]) for r in token_counts.count_tokens(docs).collect()}
    assert got == {(1, 7): (2, False, "x"), (2, 0): (0, False, None), (None, 5): (1, False, "y"), (3, 0): (0, False, "z"), (4, 250_000): (50_000, True, "w")}
    assert token_counts.count_tokens(docs).count() == 6 and token_counts.count_tokens(docs.limit(0)).count() == 0


def test_encode_and_decode(docs):
    both = bpe_codec.decode(bpe_codec.encode(docs.filter("coalesce(doc_id, 0) <> 4"))).collect()
    for r in both:
        assert r["ids"] == reference([r["text"] or ""])[0] and r["decoded"] == library(TOKENIZER).decode(r["ids"], skip_special_tokens=False)
    assert bpe_codec.encode(docs.limit(0)).count() == 0


def test_op8_query(spark):
    got = {r["doc_id"]: r for r in queries.op8_bpe_codec(spark, SF).collect()}
    table = pq.read_table(f"{SF}/documents.parquet")
    for i, text, ids in zip(table["doc_id"].to_pylist(), table["text"].to_pylist(), reference(table["text"].to_pylist()), strict=True):
        shown = library(TOKENIZER).decode(ids, skip_special_tokens=False)
        assert (got[i]["n_tokens"], got[i]["ids_sha256"], got[i]["decoded_sha256"]) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(shown.encode()).hexdigest()), text[:50]


def test_op7_query(spark):
    got = {r["doc_id"]: r for r in queries.op7_token_id_frames(spark, SF).collect()}
    table = pq.read_table(f"{SF}/documents.parquet").sort_by("doc_id")
    start = 0
    for i, ids in zip(table["doc_id"].to_pylist(), reference(table["text"].to_pylist()), strict=True):
        ids = np.array([*ids, 2], "<u4")
        assert (got[i]["start"], got[i]["n_tokens"], got[i]["ids_crc32"]) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)


def test_store(spark, docs):
    path = scratch(spark, "t")
    manifest = frame_store.write_store(docs, path)
    rows = sorted(frame_store.read_store(spark, path, manifest).collect(), key=lambda r: r["start"])
    assert [r["doc_id"] for r in rows] == [None, 1, 1, 2, 3, 4] and [r["n_tokens"] for r in rows] == [2, 3, 3, 1, 1, 50_001]
    assert [r["start"] for r in rows] == np.cumsum([0, *[r["n_tokens"] for r in rows][:-1]]).tolist()
    assert frame_store.read_store(spark, scratch(spark, "e"), frame_store.write_store(docs.limit(0), scratch(spark, "e"))).count() == 0


def _shard(tmp_path, documents):
    fs, _ = frame_store.arrow_store(str(tmp_path))
    with fs.open_output_stream(f"{tmp_path}/s") as sink:
        w = frame_store.ShardWriter(sink)
        for k, ids in documents:
            w.add(k, np.array(ids, np.int32))
        w.close()
    return fs


def test_shard_reads_only_the_frames_it_needs(tmp_path):
    documents = [(k, [k] * 40_000) for k in range(6)]
    fs = _shard(tmp_path, documents)
    with fs.open_input_file(f"{tmp_path}/s") as f:
        reader = frame_store.ShardReader(f)
        assert len(reader.entries) == 6
        seen, frame = [], reader.frame
        reader.frame = lambda i: (seen.append(i), frame(i))[1]
        assert reader.lookup([3])[3][0].tolist() == [3] * 40_000 and seen == [3]


def test_any_key_and_none_read_back(tmp_path):
    least = -(1 << 63)
    fs = _shard(tmp_path, [(None, [1]), (None, []), (least, [2]), (0, [3] * 70_000), (5, [])])
    with fs.open_input_file(f"{tmp_path}/s") as f:
        reader = frame_store.ShardReader(f)
        assert [(k, len(ids)) for i in range(len(reader.entries)) for k, ids in reader.frame(i)] == [(None, 1), (None, 0), (least, 1), (0, 70_000), (5, 0)]
        found = reader.lookup([None, least, 7])
        assert set(found) == {None, least} and [x.tolist() for x in found[None]] == [[1], []]


def test_shard_is_plain_zstandard_and_guarded(tmp_path):
    import io

    import zstandard

    fs = _shard(tmp_path, [(1, [5, 6]), (None, []), (2, list(range(70_000)))])
    raw = (tmp_path / "s").read_bytes()
    whole = zstandard.ZstdDecompressor().stream_reader(io.BytesIO(raw), read_across_frames=True).read()
    assert len(whole) == 4 + 2 * 12 + 8 + 4 + 12 + 280_000
    broken = bytearray(raw)
    broken[20] ^= 1
    (tmp_path / "s").write_bytes(broken)
    with fs.open_input_file(f"{tmp_path}/s") as f, pytest.raises(Exception, match="damaged|checksum|corrupt|rror"):
        list(frame_store.ShardReader(f).frame(0))


def test_over_limit_column(spark):
    got = queries.op6_token_counts(spark, SF)
    assert got.columns == ["doc_id", "n_bytes", "n_tokens", "over_limit"] and got.filter((F.col("n_tokens") > 2048) != F.col("over_limit")).count() == 0
