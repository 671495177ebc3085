"""Operator 12: exact Jaccard self-join of word n-gram sets by prefixes under several token orders.

Two sets of sizes n and m reach the similarity s only if they share o = s / (1 + s) * (n + m) tokens, so each has one of
them in its first n - ceil(s * n) + 1 tokens under any order of all tokens. Three orders are used, all of which begin with
the tokens that stand in one row only: then rarest first, and twice by an independent hash. A pair is a candidate if it
shares a token of the first order's prefixes at positions that leave room for o tokens, and shares one of the
prefixes of each other order too. Survivors are verified on all tokens that don't stand in one row only, for the others
are in no intersection, and the sets' sizes are known.

Document frequencies of all tokens (``_told``). Tasks make blocks of about BLOCK tokens and deal them out by ranges of
token hashes: a range gets each block's tokens as one row of packed arrays, with the documents that hold them. It
answers with the tokens that occur more than once. A token of HOT or more documents of a block goes as one entry
with its number, and its documents wait with the block. So a range holds a bounded number of entries a block, however
frequent its tokens are. A row from a block to a range has BLOCK * RANGE_TOKENS tokens over those of the corpus: beyond
about 1 TB of text raise both by the memory that a worker has, to keep some dozens a row. Nothing comes back of the many tokens that occur once: a document in which they fill the
prefix has no partner and is done.

Frequent tokens. Where a prefix token is left to more than CROWD sets (a family of near copies), its members are first
verified against the one with most room, whose rarer tokens are fewest. What is then outside the component of most
members meets every member of another component. So each candidate pair is verified or connected already, and a
family costs its members, not their pairs.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestack.llm import simhash
from lodestack.llm.components import components
from lodestack.llm.tables import pieces
from lodestack.runtime import discard, materialize

SHINGLE, LEAST = 5, (4, 5)
BLOCK, RANGE_TOKENS, LEAST_RANGES, HOT, CROWD = 1 << 20, 1 << 21, 64, 8, 16
MOST_DF = (1 << 16) - 1  # more frequent tokens are of one rank
#: Bytes of a token within its range, fewer where ranges have over 16 bits: tokens are told apart by 54 bits or more.
WIDTH = 6
_PASS = 1024  # groups by which blocks' own rows pass the ranges
_M1, _M2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)  # fixed values: MurmurHash3's finalizer
_FACTORS = np.random.default_rng(42).integers(0, 1 << 63, 2 * SHINGLE, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * _M1
    h = (h ^ (h >> np.uint64(33))) * _M2
    return h ^ (h >> np.uint64(33))


def shingle_sets(texts: list[bytes]) -> list[np.ndarray]:
    """Per text the sorted distinct 64-bit hashes of its SHINGLE-word shingles (of fewer words: of the whole sequence; of
    none: empty). A distinct word is hashed once; a shingle's hash is the mixed sum of its words' hashes times odd factors."""
    found = [t.lower().split() for t in texts]  # bytes: A-Z and ASCII white space only
    known: dict[bytes, int] = defaultdict()
    known.default_factory = known.__len__
    ids = [np.fromiter(map(known.__getitem__, ws), np.int64, len(ws)) for ws in found]
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, known), np.uint64, len(known))
    out = []
    for own in ids:
        h = hashes[own]
        k = min(SHINGLE, len(h))
        total = sum((h[j : len(h) - k + 1 + j] * _FACTORS[j] for j in range(k)), np.zeros(max(0, len(h) - k + 1) if k else 0, np.uint64))
        out.append(np.unique(mixed(total + _FACTORS[SHINGLE + k - 1]) if k else total))
    return out


def set_id(hashes: np.ndarray) -> bytes:
    """128 bits of a set."""
    return xxhash.xxh128_digest(hashes.tobytes())


def prefix_size(n: int) -> int:
    up, down = LEAST
    return n - -(-up * n // down) + 1


_PACKED = [("low", "binary"), ("own", "binary"), ("df", "binary"), ("hot", "binary"), ("hot_df", "binary")]


def _pack(tokens: np.ndarray, width: int) -> bytes:
    """So many low bytes of each."""
    return np.ascontiguousarray(tokens.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width]).tobytes()


def _unpack(packed: bytes, width: int, r: int = 0) -> np.ndarray:
    out = np.zeros((len(packed) // width, 8), np.uint8)
    out[:, :width] = np.frombuffer(packed, np.uint8).reshape(-1, width)
    return out.reshape(-1).view("<u8") + np.uint64(r << 8 * width)


def _schema(key: T.StructField) -> T.StructType:
    """A row from a block to a range and back (_PACKED), or a block's own row (the lists)."""
    packed = [T.StructField(c, T.BinaryType()) for c, _ in _PACKED]
    lists = [T.StructField("keys", T.ArrayType(key.dataType)), T.StructField("sizes", T.ArrayType(T.IntegerType())), T.StructField("sids", T.ArrayType(T.BinaryType())), T.StructField("fps", T.ArrayType(T.LongType()))]
    return T.StructType([T.StructField("range", T.LongType()), T.StructField("block", T.LongType()), *packed, *lists])


def _block(schema: pa.Schema, block: int, bits: int, width: int, held: list[tuple]) -> pa.RecordBatch:
    """The rows of a block: one for each range of token hashes, and its own."""
    keys, sets, fps = zip(*held, strict=True)
    own = np.repeat(np.arange(len(sets), dtype=np.uint16), [len(h) for h in sets])
    tokens = np.concatenate(sets) >> np.uint64(64 - 8 * width - bits)  # the range and width more bytes
    order = np.argsort(tokens, kind="stable")
    tokens, own = tokens[order], own[order]
    starts = np.flatnonzero(np.concatenate([[True], tokens[1:] != tokens[:-1]])) if len(tokens) else np.zeros(0, np.int64)
    counts = np.diff(np.append(starts, len(tokens)))
    crowded = np.repeat(counts >= HOT, counts)
    rows: dict[str, list] = {c: [] for c in schema.names}

    def add(**row) -> None:
        for c in rows:
            rows[c].append(row.get(c))

    few, whose = tokens[~crowded], own[~crowded]
    hot, many = tokens[starts][counts >= HOT], counts[counts >= HOT].astype(np.uint32)
    few_in, hot_in = few >> np.uint64(8 * width), hot >> np.uint64(8 * width)
    met = np.union1d(few_in, hot_in)
    places = [np.searchsorted(x, met, side).tolist() for x in (few_in, hot_in) for side in ("left", "right")]
    for r, a, b, c, d in zip(met.tolist(), *places, strict=True):
        add(range=r, block=block, low=_pack(few[a:b], width), own=whose[a:b].tobytes(), hot=_pack(hot[c:d], width), hot_df=many[c:d].tobytes())
    add(range=-1 - block % _PASS, block=block, low=tokens[crowded].tobytes(), own=own[crowded].tobytes(), keys=list(keys), sizes=[len(h) for h in sets], sids=[set_id(h) for h in sets], fps=list(fps))
    return pa.RecordBatch.from_arrays([pa.array(rows[f.name], f.type) for f in schema], schema=schema)


def _blocks(docs: DataFrame, key: str, text: str, bits: int, width: int, prints: bool) -> DataFrame:
    docs = docs.select(docs[key].alias("key"), docs[text].alias("text"))
    schema = _schema(docs.schema["key"])
    arrow = docs.sparkSession.createDataFrame([], schema).toArrow().schema

    def run(batches):
        held, total = [], 0
        block = TaskContext.get().partitionId() << 32
        for batch in batches:
            for rows, texts in pieces(batch):
                for k, h, t in zip(rows.column(0).to_pylist(), shingle_sets(texts), texts, strict=True):
                    fp = simhash.fingerprint(t) if prints else 0
                    held.append((k, h, fp - (1 << 64) if fp >> 63 else fp))
                    total += len(h)
                    if total >= BLOCK or len(held) == 1 << 16:
                        yield _block(arrow, block, bits, width, held)
                        held, total, block = [], 0, block + 1
        if held:
            yield _block(arrow, block, bits, width, held)

    return docs.mapInArrow(run, schema)


def _told(schema: pa.Schema, width: int):
    """What a range answers to its blocks: their tokens that occur more than once, and how often."""

    def answer(table: pa.Table) -> pa.Table:
        if table["range"][0].as_py() < 0:
            return table
        get = lambda c, kind: [np.frombuffer(b, kind) for b in table[c].to_pylist()]
        low, hot = ([_unpack(b, width) for b in table[c].to_pylist()] for c in ("low", "hot"))
        own, many = get("own", np.uint16), get("hot_df", np.uint32)
        tokens, number = np.unique(np.concatenate(low + hot), return_inverse=True)
        weight = np.concatenate([np.ones(sum(map(len, low)), np.int64), *[m.astype(np.int64) for m in many]])
        df = np.minimum(np.bincount(number, weight, len(tokens)), MOST_DF).astype(np.uint16)
        parts = np.split(df[number], np.cumsum([len(x) for x in low + hot])[:-1])
        mine, theirs = parts[: len(low)], parts[len(low) :]
        new = {
            "low": [_pack(x[d > 1], width) for x, d in zip(low, mine, strict=True)], "own": [x[d > 1].tobytes() for x, d in zip(own, mine, strict=True)], "df": [d[d > 1].tobytes() for d in mine],
            "hot_df": [d.tobytes() for d in theirs],
        }
        for c, values in new.items():
            table = table.set_column(schema.get_field_index(c), c, pa.array(values, pa.binary()))
        return table

    return answer


def _assembled(schema: pa.Schema, width: int):
    """The documents of a block with their prefixes under the three orders, without the tokens that occur once."""

    def assemble(table: pa.Table) -> pa.Table:
        tokens, owns, dfs, hot, hot_df = [], [], [], [], []
        for r, low, own, df, h, hd in zip(*[table[c].to_pylist() for c in ("range", "low", "own", "df", "hot", "hot_df")], strict=True):
            if r < 0:
                waiting, waiting_own = np.frombuffer(low, np.uint64), np.frombuffer(own, np.uint16)
            else:
                tokens.append(_unpack(low, width, r))
                owns.append(np.frombuffer(own, np.uint16))
                dfs.append(np.frombuffer(df, np.uint16))
                hot.append(_unpack(h, width, r))
                hot_df.append(np.frombuffer(hd, np.uint16))
        if len(waiting):
            known, df = np.concatenate(hot), np.concatenate(hot_df)
            order = np.argsort(known)
            tokens.append(waiting)
            owns.append(waiting_own)
            dfs.append(df[order][np.searchsorted(known[order], waiting)])
        token, own, df = (np.concatenate(x) if x else np.zeros(0, kind) for x, kind in ((tokens, np.uint64), (owns, np.uint16), (dfs, np.uint16)))
        own_row = table.filter(pa.compute.less(table["range"], 0))
        keys, sizes, sids, fps = (own_row[c][0] for c in ("keys", "sizes", "sids", "fps"))
        sizes = np.array(sizes.as_py(), np.int64)
        repeated = np.bincount(own, minlength=len(sizes))
        first = sizes - repeated  # so many tokens that occur once come before
        room = np.minimum(np.maximum((sizes - -(-LEAST[0] * sizes // LEAST[1]) + 1) - first, 0), repeated)
        ends = np.cumsum(repeated)
        columns = [keys.values, sids.values, pa.array(sizes.astype(np.int32)), pa.array(first.astype(np.int32)), fps.values]
        for order in ((token, df), (mixed(token + np.uint64(1)),), (mixed(token + np.uint64(2)),)):
            ranked = token[np.lexsort((*order, own))].view(np.int64)
            columns.append(pa.array([ranked[e - n : e - n + k] for e, n, k in zip(ends.tolist(), repeated.tolist(), room.tolist(), strict=True)], pa.list_(pa.int64())))
        columns.append(pa.array([ranked[e - n : e if k else e - n] for e, n, k in zip(ends.tolist(), repeated.tolist(), room.tolist(), strict=True)], pa.list_(pa.int64())))
        return pa.Table.from_arrays(columns, schema=schema)

    return assemble


def prefixes(docs: DataFrame, key: str = "doc_id", text: str = "text", prints: bool = False) -> DataFrame:
    """Per row: key, sid (its set), n (the set's size), first (how many of its tokens occur nowhere else), fp (operator 10's
    fingerprint if prints, else 0), p1, p2, p3: its prefixes under the three orders without these tokens, and shared: its
    tokens that occur elsewhere too, if the prefixes have any.

    Texts are read twice, once for their length, and never shuffled. Blocks are named by partition and number, so docs must
    be a table, whose partitions hold the same rows in the same order whenever they are read.
    """
    chars = docs.agg(F.sum(F.octet_length(docs[text]))).first()[0] or 0
    bits = min(24, max(LEAST_RANGES - 1, chars // 6 // RANGE_TOKENS).bit_length())  # a word and a space take about 6 bytes
    width = min(WIDTH, (64 - bits) // 8)
    sent = _blocks(docs, key, text, bits, width, prints)
    arrow = docs.sparkSession.createDataFrame([], sent.schema).toArrow().schema
    told = materialize(sent.groupBy("range").applyInArrow(_told(arrow, width), sent.schema), "ngram-told")
    kind = docs.schema[key].dataType
    schema = T.StructType([T.StructField("key", kind), T.StructField("sid", T.BinaryType()), *[T.StructField(c, T.IntegerType()) for c in ("n", "first")], T.StructField("fp", T.LongType()), *[T.StructField(c, T.ArrayType(T.LongType())) for c in ("p1", "p2", "p3", "shared")]])
    out = docs.sparkSession.createDataFrame([], schema).toArrow().schema
    rows = materialize(told.groupBy("block").applyInArrow(_assembled(out, width), schema), "ngram-prefixes")
    discard(told)
    return rows


def _room(a: str, b: str) -> Column:
    """Whether the positions of a shared token leave room for enough shared ones."""
    up, down = LEAST
    return F.least(F.col(f"n_{a}") - F.col(f"at_{a}"), F.col(f"n_{b}") - F.col(f"at_{b}")) * (up + down) >= (F.col(f"n_{a}") + F.col(f"n_{b}")) * up


def _side(of: DataFrame, name: str, by: str) -> DataFrame:
    return of.select(by, *[F.col(c).alias(name if c == "sid" else f"{c}_{name}") for c in of.columns if c != by])


def _pairs(found: DataFrame) -> DataFrame:
    return found.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) that pass the other orders' filters and whose sets are similar enough."""
    named = lambda of, name: of.select(*[F.col(c).alias(name if c == "sid" else f"{c}_{name}") for c in of.columns])
    other = sets.select("sid", "n", "p2", "p3", "shared")
    met = pairs.join(named(other, "a"), "a").join(named(other, "b"), "b").filter(F.arrays_overlap("p2_a", "p2_b") & F.arrays_overlap("p3_a", "p3_b"))
    up, down = LEAST
    both = F.size(F.array_intersect("shared_a", "shared_b"))
    return materialize(met.filter(both * (up + down) >= (F.col("n_a") + F.col("n_b")) * up).select("a", "b"), "ngram-pairs")


def links(rows: DataFrame) -> DataFrame:
    """Edges (a, b) between sets, enough of them to connect all pairs that are similar. rows: prefixes(docs)."""
    sets = materialize(rows.filter(F.size("p1") > 0).dropDuplicates(["sid"]).select("sid", "n", "first", "p1", "p2", "p3", "shared"), "ngram-sets")
    tokens = sets.select("sid", "n", "first", F.posexplode("p1").alias("i", "token")).select("sid", "n", (F.col("first") + F.col("i")).alias("at"), "token")
    sizes = materialize(tokens.groupBy("token").count().filter("count > 1"), "ngram-tokens")
    met = materialize(tokens.join(sizes, "token"), "ngram-met")
    few, many = met.filter(F.col("count") <= CROWD).drop("count"), met.filter(F.col("count") > CROWD).drop("count")
    near = _side(few, "x", "token").join(_side(few, "y", "token"), "token").filter(F.col("x") < F.col("y")).filter(_room("x", "y")).select("x", "y")
    heads = many.groupBy("token").agg(F.min(F.struct("at", "sid", "n")).alias("h")).select("token", "h.sid", "h.n", "h.at")
    star = _side(many, "x", "token").join(_side(heads, "y", "token"), "token").filter(F.col("x") != F.col("y")).filter(_room("x", "y")).select("x", "y")
    edges = _verified(_pairs(near.union(star)), sets)
    if many.limit(1).count() == 0:
        return edges
    roots = components(edges).select(F.col("node").alias("sid"), "root")
    placed = materialize(many.join(roots, "sid", "left").select("token", "sid", "n", "at", F.coalesce("root", "sid").alias("root")), "ngram-placed")
    bulk = placed.groupBy("token", "root").count().groupBy("token").agg(F.max(F.struct("count", "root")).alias("m")).select("token", F.col("m.root").alias("bulk"))
    outside = placed.join(bulk, "token").filter(F.col("root") != F.col("bulk")).drop("bulk")
    rest = _side(outside, "x", "token").join(_side(placed, "y", "token"), "token").filter(F.col("root_x") != F.col("root_y")).filter(_room("x", "y"))
    return edges.union(_verified(_pairs(rest.select("x", "y")), sets))


def classes(rows: DataFrame, edges: DataFrame) -> DataFrame:
    """(sid, component_id): the smallest key of each set's component, a null key only where there is no other."""
    firsts = rows.groupBy("sid").agg(F.min("key").alias("first"))
    roots = components(edges).select(F.col("node").alias("sid"), "root")
    placed = materialize(firsts.join(roots, "sid", "left").select("sid", "first", F.coalesce("root", "sid").alias("root")), "ngram-classes")
    # Written before its join: an aggregate right below would keep adaptive execution from splitting a hot root.
    least = materialize(placed.groupBy("root").agg(F.min("first").alias("component_id")), "ngram-least")
    return materialize(placed.join(least, "root").select("sid", "component_id"), "ngram-known")


def jaccard_components(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row of docs: key, n_shingles and component_id, the smallest key reachable over links of similarity 4 / 5 or more.

    Shingles are told apart by at least 54 bits of their hashes, sets by 128. Null and empty texts, and texts without words, have
    empty sets, which link with nothing: their component is their own key. Equal sets are linked; a null key is a
    component_id only where its component has no other; repeated rows stay, each with the same result; very long texts count
    whole; an empty table gives an empty table. Only key and text are read, so other columns can't clash.
    """
    rows = prefixes(docs, key, text)
    known = classes(rows.filter("n > 0"), links(rows))
    alone = rows.filter("n = 0").select("key", "n", F.col("key").alias("component_id"))
    out = rows.filter("n > 0").join(known, "sid").select("key", "n", "component_id").union(alone)
    return out.select(F.col("key").alias(key), F.col("n").cast("long").alias("n_shingles"), "component_id")
