"""Counts of words that stand near each other, as tiles of a symmetric matrix.

Texts are read once, into blocks that hold each text as numbers of the block's own words. The vocabulary is dealt into ranges
by the words' hashes; a tile holds the pairs of words of two ranges. A block's pairs are counted in its task, and what is
shuffled is one packed message for each tile it meets, two to three bytes a pair, so no pair is a row. The number of ranges
follows vocabulary and tokens, which bounds a tile's size; what belongs to a range's words (margins, rows of a factor) is one
array of bounded size.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestack.functions.text import words
from lodestack.runtime import discard, materialize

#: Tokens of a block, words of a range, messages' pairs of a tile and pairs of a tile's row, each about.
BLOCK, SIDE, TILE, PIECE = 1 << 20, 1 << 15, 10_000_000, 1 << 22
_WIDTH = 1 << 16  # room for a range's words
_TILES = "p int, q int, k long, ij binary, n binary"


def blocks(texts: DataFrame, text: str) -> DataFrame:
    """(block, words, n, df, codes, lengths): texts of about BLOCK tokens; n and df count a word's tokens and texts in the block."""

    def made(columns):
        toks = pa.chunked_array(columns).combine_chunks()
        lengths = pc.fill_null(pc.list_value_length(toks), 0).to_numpy(zero_copy_only=False)
        coded = toks.flatten().dictionary_encode()
        codes, many = coded.indices.to_numpy(zero_copy_only=False), len(coded.dictionary)
        owner = np.repeat(np.arange(len(lengths), dtype=np.int64), lengths)
        df = np.bincount(np.unique(owner * many + codes) % max(many, 1), minlength=many)
        lists = [coded.dictionary, pa.array(np.bincount(codes, minlength=many), pa.int64()), pa.array(df, pa.int64()), pa.array(codes, pa.int32()), pa.array(lengths, pa.int32())]
        arrays = [pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x) for x in lists]
        return pa.RecordBatch.from_arrays([pa.array([uuid.uuid4().hex]), *arrays], names=["block", "words", "n", "df", "codes", "lengths"])

    def run(batches):
        held, tokens = [], 0
        for batch in batches:
            held.append(batch.column(0))
            tokens += len(batch.column(0).flatten())
            if tokens >= BLOCK:
                yield made(held)
                held, tokens = [], 0
        if held:
            yield made(held)

    return texts.select(words(F.col(text)).alias("toks")).mapInArrow(run, "block string, words array<string>, n array<long>, df array<long>, codes array<int>, lengths array<int>")


def vocabulary(held: DataFrame, least: int) -> DataFrame:
    """(word, n, idf) of words that occur ``least`` times or more in blocks()."""
    total = held.agg(F.sum(F.size("lengths"))).first()[0] or 0
    each = held.select(F.inline(F.arrays_zip("words", "n", "df"))).groupBy("words").agg(F.sum("n").alias("n"), F.sum("df").alias("df"))
    return each.filter(F.col("n") >= least).select(F.col("words").alias("word"), "n", F.log(F.lit(1.0) + total / F.col("df")).alias("idf"))


def numbered(vocab: DataFrame, tokens: int, window: int) -> DataFrame:
    """The vocabulary with each word's range p and its place i there."""
    ranges = max(1, -(-vocab.count() // SIDE), int(np.ceil(np.sqrt(2 * window * tokens / TILE))))
    p = F.pmod(F.xxhash64("word"), F.lit(ranges)).cast("int")
    return vocab.withColumn("p", p).withColumn("i", F.row_number().over(Window.partitionBy("p").orderBy("word")) - 1)


def packed(values: np.ndarray, width: int) -> bytes:
    """Whole numbers of ``width`` bytes, compressed byte by byte of them: high bytes are alike."""
    planes = np.ascontiguousarray(values, f"<u{width}").view(np.uint8).reshape(-1, width).T
    return pa.compress(planes.tobytes(), codec="zstd", asbytes=True)


def unpacked(body: bytes, k: int, width: int) -> np.ndarray:
    planes = np.frombuffer(pa.decompress(body, decompressed_size=k * width, codec="zstd", asbytes=True), np.uint8)
    return np.ascontiguousarray(planes.reshape(width, k).T).view(f"<u{width}").ravel()


def tile_rows(rows: list[tuple]) -> pa.RecordBatch:
    """Rows of (p, q, ij, n) as a batch of _TILES; ij has i in its upper half."""
    p, q, ij, n = zip(*rows, strict=True)
    kinds = (pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary())
    columns = (p, q, [len(x) for x in ij], [packed(x, 4) for x in ij], [packed(x, 8) for x in n])
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["p", "q", "k", "ij", "n"])


def each_tile(batch: pa.RecordBatch):
    """(p, q, i, j, n) of a batch's rows; n in doubles."""
    for p, q, k, ij, n in zip(*(batch.column(c).to_pylist() for c in ("p", "q", "k", "ij", "n")), strict=True):
        at = unpacked(ij, k, 4)
        yield p, q, (at >> 16).astype(np.int64), (at & 0xFFFF).astype(np.int64), unpacked(n, k, 8).astype(np.float64)


def _messages(coded: DataFrame, window: int) -> DataFrame:
    """(p, q, k, ij, n): each block's counts of near pairs, a row for each tile; the pair's word of greater number is i's."""

    def counted(codes, lengths, known):
        ids = np.full(int(codes.max(initial=-1)) + 1, -1, np.int64)
        ids[known.field("local").to_numpy()] = known.field("id").to_numpy()
        at, owner, found = ids[codes], np.repeat(np.arange(len(lengths)), lengths), []
        for k in range(1, window + 1):
            a, b = at[k:], at[:-k]
            ok = (owner[k:] == owner[:-k]) & (a >= 0) & (b >= 0)
            hi, lo = np.maximum(a[ok], b[ok]), np.minimum(a[ok], b[ok])
            found.append((hi >> 16 << 48) | (lo >> 16 << 32) | ((hi & 0xFFFF) << 16) | (lo & 0xFFFF))
        return np.unique(np.concatenate(found), return_counts=True)

    def run(batches):
        for batch in batches:
            for codes, lengths, known in zip(batch.column("codes"), batch.column("lengths"), batch.column("known"), strict=True):
                pairs, n = counted(codes.values.to_numpy(), lengths.values.to_numpy(), known.values)
                cuts = np.flatnonzero(np.diff(pairs >> 32)) + 1
                rows = [(int(x[0] >> 48), int(x[0] >> 32 & 0xFFFF), x & 0xFFFFFFFF, m) for x, m in zip(np.split(pairs, cuts), np.split(n, cuts), strict=True) if len(x)]
                if rows:
                    yield tile_rows(rows)

    return coded.select("codes", "lengths", "known").mapInArrow(run, _TILES)


def tiles(held: DataFrame, ids: DataFrame, window: int) -> DataFrame:
    """(p, q, k, ij, n): how often two words stand within ``window`` words of each other in a text of blocks(), each pair once.

    Words that aren't in ids are dropped from the counts, not from the texts, so distances are the texts' own.
    """
    met = held.select("block", F.posexplode("words").alias("local", "word")).join(ids.select("word", (F.col("p") * _WIDTH + F.col("i")).alias("id")), "word")
    known = met.groupBy("block").agg(F.collect_list(F.struct("local", "id")).alias("known"))

    def merged(frame: pd.DataFrame) -> pd.DataFrame:
        both = np.concatenate([unpacked(ij, k, 4).astype(np.uint64) << np.uint64(32) | unpacked(n, k, 8) for k, ij, n in zip(frame["k"], frame["ij"], frame["n"], strict=True)])
        both.sort()
        at, n = both >> np.uint64(32), both & np.uint64(0xFFFFFFFF)
        starts = np.flatnonzero(np.diff(at, prepend=at[:1] + np.uint64(1)))
        at, n = at[starts], np.add.reduceat(n, starts)
        p, q = int(frame["p"].iloc[0]), int(frame["q"].iloc[0])
        return tile_rows([(p, q, at[x : x + PIECE], n[x : x + PIECE]) for x in range(0, len(at), PIECE)]).to_pandas()

    return _messages(held.select("block", "codes", "lengths").join(known, "block"), window).groupBy("p", "q").applyInPandas(merged, _TILES)


class Sums:
    """Arrays that a task sums up by range, each growing to its longest part."""

    def __init__(self):
        self.held: dict[int, np.ndarray] = {}

    def add(self, p: int, v: np.ndarray) -> None:
        own = self.held.get(p, v[:0])
        longer, shorter = (v.copy(), own) if len(v) > len(own) else (own, v)
        longer[: len(shorter)] += shorter
        self.held[p] = longer

    def batch(self) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(self.held), pa.int32()), pa.array([v.tobytes() for v in self.held.values()], pa.binary())], names=["p", "v"])


def summed(parts: DataFrame) -> DataFrame:
    """(p, v): the sums of a range's parts, arrays of doubles."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        total = Sums()
        for p, v in zip(frame["p"], frame["v"], strict=True):
            total.add(int(p), np.frombuffer(v))
        return total.batch().to_pandas()

    return parts.groupBy("p").applyInPandas(run, "p int, v binary")


def margins(made: DataFrame) -> DataFrame:
    """(p, v): the sums of the matrix's rows, of all words of a range."""

    def run(batches):
        total = Sums()
        for batch in batches:
            for p, q, i, j, n in each_tile(batch):
                total.add(p, np.bincount(i, n))
                total.add(q, np.bincount(j, np.where((i == j) & (p == q), 0.0, n)))  # a word beside itself counts once
        yield total.batch()

    return summed(made.mapInArrow(run, "p int, v binary"))


def drawn(n: np.ndarray, total: float, m: np.ndarray, m2: np.ndarray) -> np.ndarray:
    """Pointwise mutual information."""
    return np.log(n * total / (m * m2))


@dataclass(frozen=True)
class Counts:
    """ids has (word, n, idf, p, i); pairs are tiles(), margins their rows' sums, total the sum of these."""

    ids: DataFrame
    pairs: DataFrame
    margins: DataFrame
    total: float

    def rows(self) -> DataFrame:
        """(a, b, n) in both orders: a row for each pair, for small vocabularies."""

        def run(batches):
            for batch in batches:
                for p, q, i, j, n in each_tile(batch):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(i), p), pa.int32()), pa.array(i, pa.int32()), pa.array(np.full(len(i), q), pa.int32()), pa.array(j, pa.int32()), pa.array(n, pa.int64())], names=["p", "i", "q", "j", "n"])

        each = self.pairs.mapInArrow(run, "p int, i int, q int, j int, n long")
        a, b = self.ids.select(F.col("word").alias("a"), "p", "i"), self.ids.select(F.col("word").alias("b"), F.col("p").alias("q"), F.col("i").alias("j"))
        once = each.join(a, ["p", "i"]).join(b, ["q", "j"]).select("a", "b", "n")
        return once.unionByName(once.filter("a <> b").select(F.col("b").alias("a"), F.col("a").alias("b"), "n"))

    def partners(self) -> DataFrame:
        """(word, partners, weight): how many words each word is drawn to, and the sum of the weights, from the tiles' own sums."""
        total = self.total

        def run(batches):
            sums = Sums()
            for batch in batches:
                for (p, q, i, j, n), m, m2 in zip(each_tile(batch), batch.column("m").to_pylist(), batch.column("m2").to_pylist(), strict=True):
                    x = drawn(n, total, np.frombuffer(m)[i], np.frombuffer(m2)[j])
                    for r, at, some in ((p, i, x > 0), (q, j, (x > 0) & ~((i == j) & (p == q)))):
                        sums.add(r, np.stack([np.bincount(at[some]), np.bincount(at[some], x[some])], axis=1).astype(np.float64).ravel())
            yield sums.batch()

        def listed(batches):
            for batch in batches:
                for p, v in zip(batch.column("p").to_pylist(), batch.column("v").to_pylist(), strict=True):
                    v = np.frombuffer(v).reshape(-1, 2)
                    i = np.flatnonzero(v[:, 0])
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(i), p), pa.int32()), pa.array(i, pa.int32()), pa.array(v[i, 0], pa.int64()), pa.array(v[i, 1])], names=["p", "i", "partners", "weight"])

        m, m2 = self.margins.withColumnRenamed("v", "m"), self.margins.select(F.col("p").alias("q"), F.col("v").alias("m2"))
        parts = self.pairs.join(m, "p").join(m2, "q").select("p", "q", "k", "ij", "n", "m", "m2").mapInArrow(run, "p int, v binary")
        each = summed(parts).mapInArrow(listed, "p int, i int, partners long, weight double")
        return each.join(self.ids, ["p", "i"]).select("word", "partners", "weight")


def count(held: DataFrame, vocab: DataFrame, window: int) -> Counts:
    """The counts of blocks(), written. vocab has the words to count."""
    tokens = held.agg(F.sum(F.aggregate("lengths", F.lit(0).cast("long"), lambda s, x: s + x))).first()[0] or 0
    ids = materialize(numbered(vocab, tokens, window), "word-numbers")
    pairs = materialize(tiles(held, ids, window), "word-pairs")
    sums = materialize(margins(pairs), "word-margins")
    total = sum(r["s"] for r in sums.mapInArrow(_totals, "s double").collect())  # a number for each range
    return Counts(ids, pairs, sums, total or 1.0)


def _totals(batches):
    for batch in batches:
        yield pa.RecordBatch.from_arrays([pa.array([float(np.frombuffer(v).sum()) for v in batch.column("v").to_pylist()], pa.float64())], names=["s"])


def counted(texts: DataFrame, text: str, least: int, window: int) -> Counts:
    """The counts of all texts' words that occur ``least`` times or more; texts are read once."""
    held = materialize(blocks(texts, text), "word-blocks")
    made = count(held, vocabulary(held, least), window)
    discard(held)
    return made
