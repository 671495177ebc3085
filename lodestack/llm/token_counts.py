"""Operator 6: token counts by rank-synchronous array merging."""

from __future__ import annotations

import heapq
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from lodestack.llm.tables import extended, pieces
from lodestack.llm.word_bpe import TOKENIZER, WordTable, vocabulary

NONE = np.iinfo(np.int64).max
#: Longer sequences keep their ranks between rounds; shorter ones are ranked anew, many at once.
LONG = 200


class RankMerger:
    """Merges many symbol sequences at once.

    All sequences lie one after another in one array. In each round every sequence finds the lowest rank
    among its adjacent pairs and merges all places of that pair, left to right where they overlap. A merged
    symbol only takes part in pairs of higher rank than its own, so this equals merging one place at a time.
    """

    def __init__(self, merges: list[tuple[int, int, int]]):
        key = np.array([(a << 20) | b for a, b, _ in merges], np.int64)
        self.order = np.argsort(key)
        self.key = key[self.order]
        self.made = np.array([c for _, _, c in merges], np.int32)

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        want = (left.astype(np.int64) << 20) | right
        at = np.minimum(np.searchsorted(self.key, want), len(self.key) - 1)
        return np.where(self.key[at] == want, self.order[at], NONE)

    def merge_long(self, sequence: np.ndarray) -> np.ndarray:
        """merge() of one long sequence: places wait in a bucket per rank, and a round ranks only the pairs beside its
        merges. Every merge makes two pairs at most, so work is about linear in the sequence."""
        n = len(sequence)
        symbol = np.append(sequence.astype(np.int32), 0)
        after, before = np.arange(1, n + 2), np.arange(-1, n)
        rank = np.full(n + 1, NONE)
        buckets: dict[int, list[np.ndarray]] = {}
        heap: list[int] = []

        def file(places: np.ndarray) -> None:
            """Rank the pairs that begin at places, all of which have a successor."""
            found = self.ranks(symbol[places], symbol[after[places]])
            rank[places] = found
            places, found = places[found != NONE], found[found != NONE]
            order = np.argsort(found, kind="stable")
            which, cuts = np.unique(found[order], return_index=True)
            for r, own in zip(which.tolist(), np.split(places[order], cuts[1:]) if len(which) else (), strict=True):
                if r not in buckets:
                    heapq.heappush(heap, r)
                buckets.setdefault(r, []).append(own)

        file(np.arange(n - 1))
        while heap:
            r = heapq.heappop(heap)
            at = np.unique(np.concatenate(buckets.pop(r)))
            at = at[rank[at] == r]
            if len(at) > 1:  # of a run of overlapping places take the first, third, ...
                run = np.concatenate([[True], after[at[:-1]] != at[1:]])
                first = np.maximum.accumulate(np.where(run, np.arange(len(at)), 0))
                at = at[(np.arange(len(at)) - first) % 2 == 0]
            if not len(at):
                continue
            gone = after[at]
            symbol[at] = self.made[r]
            rank[gone] = rank[at] = NONE
            after[at] = after[gone]
            before[after[at]] = at
            left = before[at]
            beside = np.unique(np.concatenate([at, left[left >= 0]]))
            file(beside[after[beside] < n])
        alive = np.ones(n, bool)
        place = np.arange(n)
        alive[place[1:]] = after[np.maximum(before[1:n], 0)] == place[1:]
        return symbol[:n][alive]

    def merge(self, sequences: list[np.ndarray]) -> list[np.ndarray]:
        done: list[np.ndarray | None] = [self.merge_long(s) if len(s) > LONG else None for s in sequences]
        names = np.array([i for i, x in enumerate(done) if x is None], np.int64)
        if not len(names):
            return done  # type: ignore[return-value]
        sequences = [sequences[i] for i in names]
        lengths = np.fromiter(map(len, sequences), np.int64, len(sequences))
        flat = np.concatenate(sequences).astype(np.int32)
        while len(names):
            starts = np.cumsum(lengths) - lengths
            rank = np.full(len(flat), NONE)
            rank[:-1] = self.ranks(flat[:-1], flat[1:])
            rank[starts + lengths - 1] = NONE  # no pair across sequences
            lowest = np.minimum.reduceat(rank, starts)
            over = lowest == NONE
            if over.any():
                for name, a, n in zip(names[over].tolist(), starts[over].tolist(), lengths[over].tolist(), strict=True):
                    done[name] = flat[a : a + n].copy()
                keep = np.repeat(~over, lengths)
                flat, rank = flat[keep], rank[keep]
                names, lengths, lowest = names[~over], lengths[~over], lowest[~over]
                if not len(names):
                    break
            hit = rank == np.repeat(lowest, lengths)
            at = np.flatnonzero(hit)
            touching = np.flatnonzero(np.diff(at) == 1)
            if len(touching):  # of a run of overlapping places take the first, third, ...
                run = np.concatenate([[True], np.diff(at) != 1])
                first = np.maximum.accumulate(np.where(run, np.arange(len(at)), 0))
                at = at[(np.arange(len(at)) - first) % 2 == 0]
            flat[at] = self.made[rank[at]]
            stay = np.ones(len(flat), bool)
            stay[at + 1] = False
            whose = np.repeat(np.arange(len(names)), lengths)
            lengths = lengths - np.bincount(whose[at], minlength=len(names))
            flat = flat[stay]
        return done  # type: ignore[return-value]


@cache
def _table(name: str) -> WordTable:
    v = vocabulary(name)
    merger = RankMerger(v.merges)
    return WordTable(lambda chunks: v.encode_chunks(chunks, lambda pre: merger.merge([v.symbols(p) for p in pre])))


def count_tokens(docs: DataFrame, text: str = "text", name: str = TOKENIZER, limit: int = 2048) -> DataFrame:
    """docs' columns with n_bytes, n_tokens and over_limit (n_tokens > limit) added.

    No shuffle: one pass over the rows. Null and empty texts have zero bytes and tokens; very long texts and single
    words are counted whole, in about linear time; repeated rows stay, each counted alone; an empty table gives an empty table. Columns of docs named like the three new ones
    are replaced.
    """
    new = ("n_bytes", "n_tokens", "over_limit")
    own = [c for c in docs.columns if c not in new]
    docs = docs.select(*[docs[c] for c in own])
    schema = extended(docs.schema, n_bytes=T.LongType(), n_tokens=T.LongType(), over_limit=T.BooleanType())

    def run(batches):
        table = _table(name)
        for batch in batches:
            for rows, texts in pieces(batch, text):
                n = table.token_counts(texts)
                sizes = np.fromiter(map(len, texts), np.int64, len(texts))
                yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(sizes), pa.array(n), pa.array(n > limit)], names=[*own, *new])

    return docs.mapInArrow(run, schema)
