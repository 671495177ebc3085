"""Vectors: normalising, packing to bytes, exact cosine scan, locality-sensitive buckets."""

from __future__ import annotations

import struct
from functools import cache
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed values of the stored format and of the bucket scheme.
MAGIC = b"FAV1"
MOST_DIMENSIONS = 4096
TABLES, BITS, PROBED_BITS = 10, 12, 8
PLANE_SEED, GAMMA, MIX1, MIX2 = 0x46494E44414E5954, 0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB

THRESHOLD, CONTENTS, FAN_OUT = 0.30, 180, 50


def _doubles(vector: Column) -> Column:
    return F.transform(vector, lambda x: x.cast("double"))


def _let(value: Column, use) -> Column:
    """use(value) with value computed once: inside a lambda, an outer expression would be computed per element."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _valid(v: Column, top: Column) -> Column:
    return F.size(v).between(1, MOST_DIMENSIONS) & ~F.exists(v, lambda x: F.isnan(x) | (F.abs(x) == float("inf"))) & (top > 0)


def normalized(vector: Column) -> Column:
    """Unit vector; null for empty, too long, zero or non-finite ones. Scaled by the largest entry first."""

    def scale(v):
        return _let(F.array_max(F.transform(v, F.abs)), lambda top: F.when(_valid(v, top), _let(F.transform(v, lambda x: x / top), unit)))

    def unit(v):
        return _let(F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x)), lambda norm: F.transform(v, lambda x: x / norm))

    return _let(_doubles(vector), scale)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """In [-1, 1]; 0 for invalid vectors or different lengths."""

    def clipped(d):
        return F.when(d > 1, 1.0).when(d < -1, -1.0).otherwise(d)

    both = _let(normalized(a), lambda x: _let(normalized(b), lambda y: _let(dot(x, y), clipped)))
    return F.coalesce(F.when(F.size(a) == F.size(b), both), F.lit(0.0))


def literal(vector) -> Column:
    return F.array(*[F.lit(float(x)) for x in vector])


def scan(vectors: DataFrame, query, limit: int = CONTENTS, threshold: float = THRESHOLD) -> DataFrame:
    """(content_id, passage_id, score): the best passage of each content at or above threshold, top contents.

    The query is a literal; each vector is read once; contents keep one row by a partial maximum before the
    shuffle, and only limit rows leave the sort.
    """
    q = _unit(query)
    if q is None:
        return vectors.select("content_id", "passage_id", F.lit(0.0).alias("score")).limit(0)
    q = np.asarray(query, np.float64)
    unit = q / np.abs(q).max()
    unit = literal(unit / np.sqrt((unit * unit).sum()))
    near = F.when(F.size("embedding") == len(q), _let(normalized(F.col("embedding")), lambda v: dot(v, unit)))
    scored = vectors.select("content_id", "passage_id", near.alias("score")).filter(F.col("score") >= threshold)
    best = scored.groupBy("content_id").agg(F.max(F.struct("score", (-F.col("passage_id")).alias("back"))).alias("best"))
    out = best.select("content_id", (-F.col("best.back")).alias("passage_id"), F.col("best.score").alias("score"))
    return out.orderBy(F.desc("score"), "passage_id").limit(limit)


def _unit(v: np.ndarray) -> np.ndarray | None:
    v = np.asarray(v, np.float64)
    if not 0 < len(v) <= MOST_DIMENSIONS or not np.isfinite(v).all():
        return None
    top = np.abs(v).max()
    if top == 0:
        return None
    v = v / top
    return (v / np.sqrt((v * v).sum())).astype(np.float32)


def pack_one(v) -> bytes:
    """Magic, dimension, scale and one signed byte per dimension; empty for an invalid vector."""
    unit = _unit(v)
    if unit is None:
        return b""
    scale = np.float32(np.abs(unit).max() / np.float32(127))
    q = unit / scale
    q = np.clip(np.sign(q) * np.floor(np.abs(q) + np.float32(0.5)), -127, 127).astype(np.int8)
    return MAGIC + struct.pack("<If", len(unit), scale) + q.tobytes()


def unpack_one(b: bytes | None) -> np.ndarray:
    """The unit vector of a packed one; empty if the bytes are malformed."""
    none = np.zeros(0, np.float32)
    if not b or len(b) < 13 or b[:4] != MAGIC:
        return none
    n, scale = struct.unpack_from("<If", b, 4)
    q = np.frombuffer(b, np.int8, -1, 12)
    if n != len(q) or not 0 < n <= MOST_DIMENSIONS or not (np.isfinite(scale) and 0 < scale <= 1) or (q == -128).any():
        return none
    unit = _unit(q.astype(np.float32) * np.float32(scale))
    return none if unit is None else unit


def _by_length(rows, least: int = 1) -> list[tuple[list[int], int]]:
    """(places, length) of a batch's rows that aren't null, by their length."""
    at: dict[int, list[int]] = {}
    for i, x in enumerate(rows):
        if x is not None and len(x) >= least:
            at.setdefault(len(x), []).append(i)
    return [(own, n) for n, own in at.items()]


def _units(m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Unit rows of a matrix as floats, and which rows are valid vectors."""
    m = np.asarray(m, np.float64)
    top = np.abs(m).max(axis=1)
    good = np.isfinite(m).all(axis=1) & (top > 0) & (m.shape[1] <= MOST_DIMENSIONS)
    m = m[good] / top[good, None]
    return (m / np.sqrt((m * m).sum(axis=1))[:, None]).astype(np.float32), good


def _packed(rows: pd.Series) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(places, bytes, scales) of a batch's well-formed packed vectors, one matrix per dimension."""
    out = []
    for own, size in _by_length(rows, 13):
        raw = np.frombuffer(b"".join(rows.iloc[i] for i in own), np.uint8).reshape(-1, size)
        n, scale = raw[:, 4:8].copy().view("<u4")[:, 0], raw[:, 8:12].copy().view("<f4")[:, 0]
        q = raw[:, 12:].view(np.int8)
        good = (raw[:, :4] == np.frombuffer(MAGIC, np.uint8)).all(axis=1) & (n == size - 12) & (n <= MOST_DIMENSIONS) & np.isfinite(scale) & (scale > 0) & (scale <= 1) & (q != -128).all(axis=1) & (q != 0).any(axis=1)
        out.append((np.array(own)[good], q[good], scale[good]))
    return out


@F.pandas_udf(T.BinaryType())
def pack(v: pd.Series) -> pd.Series:
    """Packed vectors of a batch, a matrix per dimension; empty for invalid ones."""
    out = [b""] * len(v)
    for own, n in _by_length(v):
        unit, good = _units(np.stack([v.iloc[i] for i in own]))
        scale = (np.abs(unit).max(axis=1) / np.float32(127))[:, None] if len(unit) else np.zeros((0, 1), np.float32)
        q = unit / scale
        q = np.clip(np.sign(q) * np.floor(np.abs(q) + np.float32(0.5)), -127, 127).astype(np.int8)
        for i, row, s in zip(np.array(own)[good], q, scale[:, 0], strict=True):
            out[i] = MAGIC + struct.pack("<If", n, s) + row.tobytes()
    return pd.Series(out)


@F.pandas_udf(T.ArrayType(T.FloatType()))
def unpack(b: pd.Series) -> pd.Series:
    """Unit vectors of a batch of packed ones; empty for malformed bytes."""
    out: list = [np.zeros(0, np.float32)] * len(b)
    for own, q, scale in _packed(b):
        unit, good = _units(q.astype(np.float32) * scale[:, None])
        for i, row in zip(own[good], unit, strict=True):
            out[i] = row
    return pd.Series(out)


def packed_cosine(packed: Column, query) -> Column:
    """Cosine of a float query and packed vectors by one matrix product per batch; -2 for malformed bytes."""
    q = _unit(np.asarray(query, np.float64))

    @F.pandas_udf("double")
    def kernel(column: pd.Series) -> pd.Series:
        out = np.full(len(column), -2.0)
        for own, m, _ in _packed(column) if q is not None else ():
            if m.shape[1] == len(q) and len(own):
                m = m.astype(np.float64)
                out[own] = np.clip(m @ q.astype(np.float64) / np.sqrt((m * m).sum(axis=1)), -1, 1)
        return pd.Series(out)

    return kernel(packed)


@cache
def planes() -> np.ndarray:
    """Integer hyperplanes, (tables x bits) by dimension: bit counts of a fixed 64-bit stream, less 32."""
    n = TABLES * BITS * MOST_DIMENSIONS
    with np.errstate(over="ignore"):
        x = np.uint64(PLANE_SEED) + np.arange(1, n + 1, dtype=np.uint64) * np.uint64(GAMMA)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(MIX1)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(MIX2)
        x ^= x >> np.uint64(31)
    return (np.bitwise_count(x).astype(np.int8) - 32).reshape(TABLES * BITS, MOST_DIMENSIONS)


def _signatures(units: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of unit rows: bits per table, and every bit's distance to its plane."""
    p = planes()[:, : units.shape[1]].astype(np.float64)
    d = units.astype(np.float64) @ p.T
    bits = ((d >= 0).reshape(-1, TABLES, BITS) << np.arange(BITS)).sum(axis=2)
    lengths = np.sqrt((p * p).sum(axis=1))
    margins = np.where(lengths > 0, np.abs(d) / np.where(lengths > 0, lengths, 1), np.inf).reshape(-1, TABLES, BITS)
    return bits, margins


def buckets_of(v) -> list[int]:
    unit = _unit(v)
    if unit is None:
        return []
    bits, _ = _signatures(unit[None])
    return [(t << BITS) | int(b) for t, b in enumerate(bits[0])]


@F.pandas_udf(T.ArrayType(T.LongType()))
def buckets(v: pd.Series) -> pd.Series:
    """One key per table, made for a whole batch by one matrix product per dimension."""
    out: list[list[int]] = [[] for _ in range(len(v))]
    for own, _ in _by_length(v):
        units, good = _units(np.stack([v.iloc[i] for i in own]))
        if len(units):
            bits, _ = _signatures(units)
            keys = (np.arange(TABLES) << BITS) | bits
            for i, row in zip(np.array(own)[good], keys.tolist(), strict=True):
                out[i] = row
    return pd.Series(out)


def probes(query) -> list[int]:
    """Keys to look up for a query: all tables' own keys, then each with every 1, 2 or 3 of its 8 least certain bits flipped."""
    unit = _unit(query)
    if unit is None:
        return []
    bits, margins = _signatures(unit[None])
    own = [(t << BITS) | int(b) for t, b in enumerate(bits[0])]
    out = list(own)
    for t in range(TABLES):
        near = np.argsort(margins[0, t], kind="stable")[:PROBED_BITS].tolist()
        for n in (1, 2, 3):
            for flipped in combinations(near, n):
                out.append(own[t] ^ sum(1 << b for b in flipped))
    return out


def bucket_candidates(postings: DataFrame, query, limit: int = 1200) -> DataFrame:
    """(passage_id, hits): passages by the number of probed buckets they lie in; postings has (bucket, passage_id)."""
    return postings.filter(F.col("bucket").isin(*probes(query))).groupBy("passage_id").agg(F.count(F.lit(1)).alias("hits")).orderBy(F.desc("hits"), "passage_id").limit(limit)


#: Name of the built-in encoder; vectors are only comparable under one name.
MODEL = "hashed-words-256-v1"
ENCODED_CHARS, ENCODED_DIMENSIONS = 4096, 256


def encode_text(text: str | None) -> list[float] | None:
    """A deterministic unit vector of a text's folded words, each added to one signed place by its hash; None when
    blank. Where the signs cancel each other out in all places, words are added without them. It stands in for a sentence
    model, which needs files that this library doesn't have."""
    import hashlib

    from lodestack.functions.text import word_list

    v, plain = np.zeros(ENCODED_DIMENSIONS), np.zeros(ENCODED_DIMENSIONS)
    for w in word_list((text or "").strip()[:ENCODED_CHARS]):
        h = int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "little")
        v[h % ENCODED_DIMENSIONS] += 1.0 if h >> 63 else -1.0
        plain[h % ENCODED_DIMENSIONS] += 1.0
    unit = _unit(v if v.any() else plain)
    return None if unit is None else unit.tolist()


@F.pandas_udf(T.ArrayType(T.FloatType()))
def encode(text: pd.Series) -> pd.Series:
    return text.map(encode_text)


def for_model(vectors: DataFrame, model: str) -> DataFrame:
    return vectors.filter(F.col("model") == model)


def backfill(passages: DataFrame, vectors: DataFrame, files: DataFrame, model: str = MODEL) -> DataFrame:
    """(passage_id, model, packed) for owned passages that lack a vector of the model; blank ones get none."""
    from lodestack.operators.health import unembedded

    todo = unembedded(passages, for_model(vectors, model), files)
    made = todo.select("passage_id", F.lit(model).alias("model"), pack(encode("text")).alias("packed"))
    return made.filter(F.length("packed") > 0)
