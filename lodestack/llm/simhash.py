"""Operator 10: SimHash near-duplicates through pivot distance tables.

Fingerprints. A bit is set if more than half of the text's 3-word shingles have it set in their XXH64.

Pivot table. Each distinct fingerprint gets its Hamming distances to 65 reference fingerprints: zero, and for
each of the four 16-bit blocks the 16 rows of a Hadamard matrix in that block with zeros elsewhere. By the
triangle inequality two fingerprints at distance d or less differ by d or less in every coordinate.

Search. Within 2 bits at least two of the four blocks agree, and where a block agrees the 16 coordinates of
its pivots, less the coordinate of zero, agree too. So the six pairs of blocks give six keys of coordinates,
one of which every linked pair shares; rows meet by key, are discarded by the maximum coordinate difference,
and survivors are verified by their differing bits. Keys with more than CROWD members would make too many
pairs (large families of near copies); their members meet exactly in another way: each is listed under itself
and its 64 one-bit neighbours, and two fingerprints share such a listing if and only if they differ in 2 bits
or fewer. The listing grows with the members, not with their pairs.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestack.llm.components import components
from lodestack.llm.tables import pieces
from lodestack.runtime import materialize

SHINGLE, SEED, RADIUS = 3, 42, 2
CROWD = 64
_BLOCKS, _WIDTH = 4, 16
_CHUNK = 50_000
_MASK = (1 << 64) - 1


def fingerprint(text: bytes) -> int:
    """Unsigned 64-bit SimHash of a UTF-8 text; zero without words. Memory is bounded by _CHUNK shingles."""
    words = text.lower().split()  # bytes: A-Z and ASCII white space only
    if not words:
        return 0
    joined = b" ".join(words)
    n = max(1, len(words) - SHINGLE + 1)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = (ends - lengths).tolist()
    ends = ends[min(SHINGLE, len(words)) - 1 :].tolist()
    digest, bits = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    for at in range(0, n, _CHUNK):
        to = min(n, at + _CHUNK)
        h = np.array([digest(joined[a:b], SEED) for a, b in zip(starts[at:to], ends[at:to], strict=True)], ">u8")
        bits += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * bits > n).tobytes(), "big")


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, fp): the fingerprint of every row as a signed long. Null and empty texts: zero. No shuffle."""
    docs = docs.select(docs[key], docs[text])

    def run(batches):
        for batch in batches:
            for rows, texts in pieces(batch, text):
                fp = np.array([fingerprint(t) for t in texts], np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(fp)], names=[key, "fp"])

    return docs.mapInArrow(run, T.StructType([docs.schema[key], T.StructField("fp", T.LongType())]))


def pivots() -> list[int]:
    """The reference fingerprints: zero, then 16 per block; row i of the matrix has parity(i & j) at bit j."""
    rows = [sum((i & j).bit_count() % 2 << j for j in range(_WIDTH)) for i in range(1, _WIDTH)] + [(1 << _WIDTH) - 1]
    return [0] + [r << _WIDTH * b for b in range(_BLOCKS) for r in rows]


def _long(u: int) -> Column:
    return F.lit(u - (1 << 64) if u >> 63 else u)


def pivot_table(prints: DataFrame) -> DataFrame:
    """Distinct fp with its distances to all pivots."""
    far = F.array(*[F.bit_count(F.col("fp").bitwiseXOR(_long(p))).cast("tinyint") for p in pivots()])
    return prints.select("fp").distinct().withColumn("far", far)


def _keyed(table: DataFrame) -> DataFrame:
    """Six rows per fingerprint: the pair of blocks and the hash of their pivots' coordinates less zero's."""

    def block(b: int) -> Column:
        return F.transform(F.slice("far", 2 + _WIDTH * b, _WIDTH), lambda x: (x - F.element_at("far", 1)).cast("int"))

    keys = [F.struct(F.lit(_BLOCKS * i + j).alias("pair"), F.xxhash64(block(i), block(j)).alias("bin")) for i in range(_BLOCKS) for j in range(i + 1, _BLOCKS)]
    return table.select("fp", "far", F.inline(F.array(*keys)))


def pivot_links(prints: DataFrame, crowd: int = CROWD) -> DataFrame:
    """Edges (a, b) between fingerprints of RADIUS differing bits or fewer, enough of them to connect all
    linked ones: every such pair outside crowded keys, and a star per shared listing inside them."""
    table = materialize(pivot_table(prints), "pivot-table")
    keyed = _keyed(table)
    sizes = materialize(keyed.groupBy("pair", "bin").count().filter("count > 1"), "pivot-bins")
    met = keyed.join(sizes, ["pair", "bin"])
    few = met.filter(F.col("count") <= crowd).select("pair", "bin", "fp", "far")
    others = few.select("pair", "bin", F.col("fp").alias("fp2"), F.col("far").alias("far2"))
    near = ~F.exists(F.zip_with("far", "far2", lambda x, y: F.abs(x.cast("int") - y)), lambda d: d > RADIUS)
    pairs = few.join(others, ["pair", "bin"]).filter("fp < fp2").filter(near).filter(F.bit_count(F.col("fp").bitwiseXOR(F.col("fp2"))) <= RADIUS)
    pairs = pairs.select(F.col("fp").alias("a"), F.col("fp2").alias("b"))

    many = met.filter(F.col("count") > crowd).select("fp").distinct()
    around = F.array(F.lit(0).cast("long"), *[_long(1 << i) for i in range(64)])
    listed = materialize(many.select("fp", F.explode(F.transform(around, lambda bit: F.col("fp").bitwiseXOR(bit))).alias("place")), "places")
    heads = listed.groupBy("place").agg(F.min("fp").alias("head"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    stars = listed.join(heads, "place").filter("fp != head").select(F.col("head").alias("a"), F.col("fp").alias("b"))
    return pairs.union(stars).distinct()


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row of docs: key, fingerprint (16 lowercase hex digits) and component_id, the smallest key
    reachable over links of RADIUS differing bits or fewer.

    Only (key, fingerprint) is kept of the texts. Exact copies collapse before the search; hot fingerprints
    come back by an inner join that adaptive execution splits. Texts without words have fingerprint zero and
    link like any other; a null key is never a component_id unless its component has no other key; very long texts
    are hashed whole, a bounded number of shingles at a time; repeated rows stay, each with the same result; an
    empty table gives an empty table. Only key and text are read, so other columns can't clash.
    """
    prints = materialize(fingerprints(docs, key, text), "fingerprints")
    firsts = prints.groupBy("fp").agg(F.min(key).alias("first"))
    roots = components(pivot_links(prints)).select(F.col("node").alias("fp"), "root")
    classes = materialize(firsts.join(roots, "fp", "left").select("fp", "first", F.coalesce("root", "fp").alias("root")), "classes")
    # Written before their joins: an aggregate right below would keep adaptive execution from splitting a hot root.
    least = materialize(classes.groupBy("root").agg(F.min("first").alias("component_id")), "least")
    known = materialize(classes.join(least, "root").select("fp", "component_id"), "components")
    return prints.join(known, "fp").select(key, F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
