"""An encoder trained on the corpus: word vectors from co-occurrence, texts as weighted means of them.

Words that stand near the same words get like vectors, so texts can be near each other without a common word. Co-occurrence
counts within WINDOW words are weighted by positive pointwise mutual information; the symmetric matrix of weights is
factored by a randomised method: a random sketch of its columns, power iterations, and a small eigenproblem. The matrix stays
packed tiles (word_tiles); a tall factor is one array for each range of words, which tasks read as their tiles ask for it, so
that a product shuffles a factor's size and not the matrix's. The driver holds RANK x RANK sums only.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestack.functions.text import words
from lodestack.operators import word_tiles
from lodestack.runtime import arrow_store, cleaned, discard, materialize, remove, scratch

WINDOW, LEAST_COUNT, RANK, EXTRA, ROUNDS = 5, 5, 48, 8, 2
NAME = "corpus-ppmi-48-v1"
#: Pairs that a product takes at a time.
CHUNK = 1 << 14


def _numbered(texts: DataFrame, key: str, text: str) -> DataFrame:
    return texts.select(F.col(key).alias("key"), words(F.col(text)).alias("toks"))


def vocabulary(texts: DataFrame, key: str, text: str, least: int = LEAST_COUNT) -> DataFrame:
    """(word, n, idf) of words that occur ``least`` times or more."""
    held = materialize(word_tiles.blocks(texts, text), "encoder-blocks")
    vocab = materialize(word_tiles.vocabulary(held, least), "encoder-words")
    discard(held)
    return vocab


def cooccurrences(texts: DataFrame, key: str, text: str, vocab: DataFrame, window: int = WINDOW) -> DataFrame:
    """(a, b, n): how often two words of the vocabulary stand within ``window`` words of each other, in both orders.

    Rare words are dropped from the counts, not from the texts, so distances are the texts' own. word_tiles.Counts holds
    the same without a row for each pair.
    """
    held = materialize(word_tiles.blocks(texts, text), "encoder-blocks")
    made = word_tiles.count(held, vocab, window)
    discard(held)
    return made.rows()


def weights(pairs: DataFrame) -> DataFrame:
    """(a, b, x): positive pointwise mutual information of the pairs."""
    margin = pairs.groupBy("a").agg(F.sum("n").alias("m"))
    total = margin.agg(F.sum("m")).first()[0] or 1
    x = F.log(F.col("n") * float(total) / (F.col("m") * F.col("m2")))
    joined = pairs.join(margin, "a").join(margin.select(F.col("a").alias("b"), F.col("m").alias("m2")), "b")
    return joined.select("a", "b", x.alias("x")).filter("x > 0")


def _grouped(rows: DataFrame, by: str, weight: str, rank: int) -> DataFrame:
    """(by, v): the sums of v times weight. Each Arrow batch is summed up first."""
    kind = rows.schema[by].dataType

    def run(batches):
        for batch in batches:
            keys = batch.column(by).dictionary_encode()
            at = keys.indices.to_numpy()
            v = batch.column("v").flatten().to_numpy().reshape(-1, rank) * batch.column(weight).to_numpy()[:, None]
            order = np.argsort(at, kind="stable")
            starts = np.flatnonzero(np.diff(at[order], prepend=-1)) if len(at) else np.zeros(0, np.int64)
            sums = np.add.reduceat(v[order], starts) if len(at) else v
            yield pa.RecordBatch.from_arrays([keys.dictionary.take(pa.array(at[order][starts])), pa.array(list(sums), pa.list_(pa.float64()))], names=[by, "v"])

    partial = rows.select(by, F.col(weight).cast("double").alias(weight), "v").mapInArrow(run, T.StructType([T.StructField(by, kind), T.StructField("v", T.ArrayType(T.DoubleType()))]))
    return partial.groupBy(by).agg(F.array(*[F.sum(F.col("v")[d]) for d in range(rank)]).alias("v"))


class _Ranges:
    """Arrays written by range, one for each; tasks read them, and keep the last. ``turn`` is a small matrix to multiply rows by."""

    def __init__(self, path: str, width: int, turn: np.ndarray | None = None):
        self.path, self.width, self.turn, self.held = path, width, turn, (None, None)

    def __call__(self, p: int) -> np.ndarray:
        if self.held[0] != p:
            fs, root = arrow_store(f"{self.path}/p={p}")
            rows = np.frombuffer(pq.read_table(root, filesystem=fs, columns=["v"], partitioning=None).column("v")[0].as_py()).reshape(-1, self.width)
            self.held = p, rows if self.turn is None else rows @ self.turn
        return self.held[1]

    def turned(self, by: np.ndarray) -> _Ranges:
        return _Ranges(self.path, self.width, by)


def _by_range(rows: DataFrame, label: str, width: int) -> _Ranges:
    """(p, v), a row for each range, written."""
    path = scratch(rows.sparkSession, label)
    with cleaned(rows.sparkSession):
        rows.write.partitionBy("p").parquet(path)
    return _Ranges(path, width)


def _both_orders(pairs: DataFrame, ranges: int) -> DataFrame:
    """The tiles of the whole matrix, in tasks by range, each tile's pairs by row."""

    def run(batches):
        for batch in batches:
            rows = []
            for p, q, i, j, n in word_tiles.each_tile(batch):
                there, back = i << 16 | j, j << 16 | i
                if p == q:
                    there, back, n = np.concatenate([there, back[i != j]]), None, np.concatenate([n, n[i != j]])
                for x, y, code in ((p, q, there), (q, p, back)):
                    if code is not None:
                        order = np.argsort(code)
                        rows.append((x, y, code[order], n[order]))
            if rows:
                yield word_tiles.tile_rows(rows)

    return pairs.mapInArrow(run, pairs.schema).repartitionByRange(ranges, "p", "q").sortWithinPartitions("p", "q")


def _times(matrix: DataFrame, total: float, margins: _Ranges, factor: _Ranges) -> DataFrame:
    """(p, v): parts of the matrix of weights by a factor, a task's part of a range in one row."""
    width = factor.width

    def run(batches):
        other, at, out = _Ranges(margins.path, 1), None, None
        for batch in batches:
            for p, q, i, j, n in word_tiles.each_tile(batch):
                m = margins(p)[:, 0]
                x = word_tiles.drawn(n, total, m[i], other(q)[j, 0])
                i, j, x = i[x > 0], j[x > 0], x[x > 0]
                if p != at:
                    if out is not None:
                        yield _part(at, out)
                    at, out = p, np.zeros((len(m), width))
                rows = factor(q)
                for k in range(0, len(i), CHUNK):
                    own = i[k : k + CHUNK]
                    starts = np.flatnonzero(np.diff(own, prepend=-1))
                    out[own[starts]] += np.add.reduceat(rows[j[k : k + CHUNK]] * x[k : k + CHUNK, None], starts, axis=0)
        if out is not None:
            yield _part(at, out)

    return matrix.mapInArrow(run, "p int, v binary")


def _part(p: int, rows: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([p], pa.int32()), pa.array([rows.tobytes()], pa.binary())], names=["p", "v"])


def _inner(parts: DataFrame, factor: _Ranges | None, width: int) -> np.ndarray:
    """The sums of products of a factor's rows with those of parts (of parts' rows with themselves): partial sums come from the tasks."""

    def run(batches):
        sums = np.zeros((width, width))
        for batch in batches:
            for p, v in zip(batch.column("p").to_pylist(), batch.column("v").to_pylist(), strict=True):
                v = np.frombuffer(v).reshape(-1, width)
                sums += (v if factor is None else factor(p)[: len(v)]).T @ v
        yield pa.RecordBatch.from_arrays([pa.array([sums.ravel().tolist()], pa.list_(pa.float64()))], names=["s"])

    return np.array([r["s"] for r in parts.mapInArrow(run, "s array<double>").collect()]).sum(axis=0).reshape(width, width)  # a row a task


def _sketch(ids: DataFrame, width: int) -> DataFrame:
    """(p, v): signs drawn from the words' hashes."""
    sign = lambda d: F.when(F.pmod(F.xxhash64("word", F.lit(d)), F.lit(2)) == 0, 1).otherwise(-1).cast("byte")

    def run(table: pa.Table) -> pa.Table:
        signs = table.column("signs").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
        rows = np.empty(signs.shape)
        rows[table.column("i").to_numpy()] = signs
        return pa.Table.from_batches([_part(table.column("p")[0].as_py(), rows)])

    return ids.select("p", "i", F.array(*[sign(d) for d in range(width)]).alias("signs")).groupBy("p").applyInArrow(run, "p int, v binary")


def _rows(factor: _Ranges, table: DataFrame, by: np.ndarray) -> DataFrame:
    """(p, i, v): the rows of a written factor times a small matrix; rows of zeros are left out."""

    def run(batches):
        for batch in batches:
            for p, v in zip(batch.column("p").to_pylist(), batch.column("v").to_pylist(), strict=True):
                v = np.frombuffer(v).reshape(-1, factor.width) @ by
                i = np.flatnonzero(v.any(axis=1))
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(i) + 1) * by.shape[1], pa.int32()), pa.array(v[i].ravel()))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(i), p), pa.int32()), pa.array(i, pa.int32()), lists], names=["p", "i", "v"])

    return table.mapInArrow(run, "p int, i int, v array<double>")


@dataclass(frozen=True)
class Encoder:
    """vectors has (word, v), v already times the word's idf."""

    vectors: DataFrame
    rank: int
    name: str = NAME

    def encode(self, texts: DataFrame, key: str, text: str) -> DataFrame:
        """(key, vector): the unit vector of each text; texts without known words have none."""
        each = _numbered(texts, key, text).select("key", F.explode("toks").alias("word")).groupBy("key", "word").agg(F.count(F.lit(1)).alias("n"))
        total = _grouped(each.join(self.vectors, "word"), "key", "n", self.rank)
        norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))
        return total.withColumn("norm", norm).filter("norm > 1e-12").select(F.col("key").alias(key), F.transform("v", lambda x: (x / F.col("norm")).cast("float")).alias("vector"))


def train(texts: DataFrame, key: str = "passage_id", text: str = "text", rank: int = RANK, window: int = WINDOW, least: int = LEAST_COUNT, rounds: int = ROUNDS) -> Encoder:
    """An encoder from all texts. The sketch is drawn from the words' hashes, so training again gives the same vectors.

    Null and blank texts teach nothing; a corpus without repeated words gives an encoder that knows none.
    """
    wide = rank + EXTRA
    counts = word_tiles.counted(texts, text, least, window)
    spark = texts.sparkSession
    ranges = counts.margins.count()
    if ranges == 0:
        return Encoder(counts.ids.select("word", F.array(*[F.lit(0.0)] * rank).alias("v")).limit(0), rank)
    margins = _by_range(counts.margins, "encoder-margins", 1)
    matrix = materialize(_both_orders(counts.pairs, ranges), "encoder-matrix")
    discard(counts.pairs)
    table = lambda factor: spark.read.schema("v binary, p int").parquet(factor.path)
    factor = _by_range(_sketch(counts.ids, wide), "encoder-factor", wide)
    for _ in range(rounds + 1):
        made = _by_range(word_tiles.summed(_times(matrix, counts.total, margins, factor)), "encoder-factor", wide)
        remove(spark, factor.path)
        values, vectors = np.linalg.eigh(_inner(table(made), None, wide))
        scale = np.where(values > values.max() * 1e-12, 1 / np.sqrt(np.maximum(values, 1e-300)), 0.0)
        factor = made.turned(vectors * scale)  # orthonormal columns, as far as the factor's rank goes
    small = _inner(_times(matrix, counts.total, margins, factor), factor, wide)
    values, vectors = np.linalg.eigh((small + small.T) / 2)
    best = np.argsort(-values)[:rank]
    placed = _rows(factor, table(factor), factor.turn @ (vectors[:, best] * np.sqrt(np.maximum(values[best], 0))))
    out = materialize(placed.join(counts.ids, ["p", "i"]).select("word", F.transform("v", lambda x: x * F.col("idf")).alias("v")), "encoder-vectors")
    for held in (matrix, counts.ids):
        discard(held)
    for path in (margins.path, factor.path):
        remove(spark, path)
    return Encoder(out, rank)
