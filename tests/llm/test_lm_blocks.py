"""Operator 4's numbering and packing within a block, without Spark."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest

from lodestack.llm import lm_scoring


@pytest.mark.parametrize("bits", [1, 12, 40, 56, 64])
def test_numbered_equals_unique(bits):
    rng = np.random.default_rng(bits)
    values = rng.integers(0, 2**bits, 5_000, np.uint64, endpoint=False) if bits < 64 else rng.integers(0, 2**64 - 1, 5_000, np.uint64, endpoint=True)
    close = np.uint64(2**bits - 1) - np.arange(min(2**bits, 9), dtype=np.uint64)  # told apart by the last bits alone
    for x in (values, np.concatenate([values, values[:70], close, close[::-1]]), values[:1], values[:0], (values >> np.uint64(1)).view(np.int64)):
        for got, want in zip(lm_scoring._numbered(x), np.unique(x, return_inverse=True), strict=True):
            assert got.tolist() == want.tolist() and (got.dtype.kind == want.dtype.kind or not len(x))


def test_pack_round_trip():
    for x in (np.arange(300, dtype=np.int64), np.full(9, 255, np.uint32), np.array([0, 2**64 - 1, 5], np.uint64), np.array([0.25, 1e-9], np.float32), np.zeros(0, np.uint8), np.array([3, 70_000], np.int64)):
        got = lm_scoring._unpack(lm_scoring._pack(x), x.dtype)
        assert got.dtype == x.dtype and got.tolist() == x.tolist()
    assert lm_scoring._pack(np.full(9, 255, np.int64))[0] == 1  # planes above the largest number are left out


def test_entries_of_a_range_may_come_in_any_order():
    hashes = np.array([5, 4, (1 << 56) - 1, (1 << 56) - 2, 1 << 40], np.uint64)
    seen = {}
    for r, own, h in lm_scoring._by_range("pair", hashes, 512):
        assert hashes[own].tolist() == h.tolist() and r not in seen
        seen[r] = np.cumsum(lm_scoring._unpack(lm_scoring._pack(np.diff(h, prepend=np.uint64(0))), np.uint64), dtype=np.uint64).tolist()
    assert sorted(sum(seen.values(), [])) == sorted(hashes.tolist()) and len(seen) == 2


def test_a_block_is_built_once_for_words_and_pairs(monkeypatch):
    class Frame:
        def __init__(self):
            self.run = []

        def mapInPandas(self, run, schema):
            self.run.append(run)
            return self

        def groupBy(self, *keys):
            return self

        def applyInPandas(self, run, schema):
            return self

    words = np.array([0, 7, 9], np.uint64)
    row = {"block": 0, "fold": bytes([0, 3]), "length": lm_scoring._pack(np.array([3, 2])), "size": 3, "words": lm_scoring._pack(np.diff(words, prepend=np.uint64(0))), "at": lm_scoring._pack(np.array([1, 2, 0, 1, 0], np.uint32))}
    built, block = [], lm_scoring.Block
    monkeypatch.setattr(lm_scoring, "Block", lambda r: built.append(1) or block(r))
    found = Frame()
    lm_scoring.totals(found, ("word", "pair"), 512)
    sent = pd.concat(found.run[0](iter([pd.DataFrame([row])])))
    assert set(sent["kind"]) == {"word", "pair"} and len(built) == 1
