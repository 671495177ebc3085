"""Operator 4: language-model scores by deleted interpolation.

The model is a trigram model, with weights per bucket of the context's count (powers of two):

    P(w | u v) = a c(u v w) / c(u v) + (1 - a) P(w | v)      a by the bucket of c(u v)
    P(w | v)   = b c(v w) / c(v)     + (1 - b) P(w)          b by the bucket of c(v)
    P(w)       = g c(w) / N          + (1 - g) / (V + 1)

The weights are learned by expectation-maximisation on counts of a held-out fold of the training documents against
the counts of the other training documents; final counts are those of all training documents, and one model scores
all texts: equal texts score equal. It knows the texts that it was trained on by heart, so their scores can't be
compared with others'; ask for score_left_out to have the probability of a training text by a model of the other
texts' counts as well.

How counts reach their places. Texts are read once into blocks: runs of at most BLOCK_TOKENS tokens, each with
its own list of distinct tokens (64-bit hashes). A block sends each distinct token, bigram or trigram once, with its
counts, to the counter of its range of hashes; counters add up and send totals back in the block's own order. So a
word or pair that stands everywhere makes one entry per block, and nothing is grouped by a hot key. Trigrams go last
and only where both bigrams occur more than once in the corpus: else the trigram occurs once, which needs no asking.

Size. A message holds the entries of one block for one range; their number is blocks times ranges, and at most one
per entry. RANGES ranges serve up to RANGES * RANGE_TOKENS tokens (so messages are in proportion to the tokens);
beyond, the number of ranges grows so that a counter's memory stays bounded. For more than about 1 TB of text raise
block_tokens and range_tokens by the memory that a worker has: messages then keep their size.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestack.llm.tables import pieces
from lodestack.runtime import discard, materialize

FOLDS, HELD_OUT, TUNING = 7, 2, 3
BLOCK_TOKENS, RANGE_TOKENS, RANGES = 1_000_000, 2_000_000, 512
#: Bits of the hashes of words, and of bigrams and trigrams: 10^12 of these meet in about 7 million pairs.
BITS, GRAM_BITS = 64, 56
#: EM ends when no weight moves by more than TOLERANCE, or after ROUNDS.
BUCKETS, ROUNDS, TOLERANCE = 24, 40, 1e-3
#: Hashes of the end token and of the start context.
END, START = 0, 2
_MIX = np.uint64(0x9E3779B97F4A7C15)


#: One of each for a worker: making them takes longer than most messages.
_PRESS, _LOOSEN = zstandard.ZstdCompressor(level=1), zstandard.ZstdDecompressor()


def _pack(values: np.ndarray) -> bytes:
    """Numbers by byte planes through zstandard, after their number of planes: high planes that are all zero are left out."""
    width = values.dtype.itemsize
    flat = np.ascontiguousarray(values).view(f"u{width}")
    planes = max(1, -(-int(flat.max(initial=0)).bit_length() // 8))
    raw = flat.astype(np.uint8) if planes == 1 else flat.view(np.uint8).reshape(-1, width)[:, :planes].T
    return bytes([planes]) + _PRESS.compress(raw.tobytes())


def _unpack(packed: bytes, kind) -> np.ndarray:
    planes, width = packed[0], np.dtype(kind).itemsize
    raw = np.frombuffer(_LOOSEN.decompress(memoryview(packed)[1:]), np.uint8)
    if planes == 1:
        return raw.astype(f"u{width}").view(kind)
    out = np.zeros((len(raw) // planes, width), np.uint8)
    out[:, :planes] = raw.reshape(planes, -1).T
    return out.reshape(-1).view(kind)


def _order(values: np.ndarray) -> np.ndarray:
    """Places of unsigned values, ascending by as many leading bits as fit into 64 with a place below them: a sort of
    numbers takes a fraction of the time of an argsort. The last bits of very large values aren't looked at."""
    room = np.uint64(len(values).bit_length())
    extra = max(0, int(values.max(initial=0)).bit_length() + int(room) - 64)
    keys = values.astype(np.uint64)
    keys >>= np.uint64(extra)
    keys <<= room
    keys |= np.arange(len(keys), dtype=np.uint64)
    keys.sort()
    keys &= (np.uint64(1) << room) - np.uint64(1)
    return keys.view(np.int64)


def _numbered(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct values, none of them negative, ascending, and each value's number among them."""
    order = _order(values)
    found = values[order]
    if (found[1:] < found[:-1]).any():  # told apart only by bits that _order() has no room for
        return np.unique(values, return_inverse=True)
    fresh = np.ones(len(found), bool)
    fresh[1:] = found[1:] != found[:-1]
    number = np.empty(len(found), np.int64)
    number[order] = np.cumsum(fresh) - 1
    return found[fresh], number


def _fold(keys: pa.Array) -> np.ndarray:
    return np.array([zlib.crc32(str(k).encode()) % FOLDS if k is not None else 0 for k in keys.to_pylist()], np.uint8)


def blocks(docs: DataFrame, key: str, text: str, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """One row per block: block, tokens (their number), docs (keys), fold and length of each document, words (hashes of the block's
    distinct tokens, ascending), size (their number) and at (each token as a number of that list; a document's last is the end)."""
    docs = docs.select(docs[key].cast("long").alias("key"), docs[text].alias("text"))

    def run(batches):
        keys, folds, lengths, parts, held = [], [], [], [], 0

        def emit():
            flat = np.concatenate(parts)
            words, at = _numbered(flat)
            return pa.RecordBatch.from_pydict({
                "docs": pa.array([[None if k is None else k for k in keys]], pa.list_(pa.int64())), "fold": [np.concatenate(folds).tobytes()], "length": [_pack(np.array(lengths, np.int64))],
                "tokens": pa.array([len(flat)], pa.int64()), "size": pa.array([len(words)], pa.int64()), "words": [_pack(np.diff(words, prepend=np.uint64(0)))], "at": [_pack(at.astype(np.uint32))],
            })

        digest = xxhash.xxh64_intdigest
        for batch in batches:
            for rows, texts in pieces(batch):
                keys += rows.column(0).to_pylist()
                folds.append(_fold(rows.column(0)))
                for t in texts:
                    words = t.lower().split()
                    h = np.fromiter(map(digest, words), np.uint64, len(words))
                    parts.append(np.append(h, np.uint64(END)))
                    lengths.append(len(h) + 1)
                    held += len(h) + 1
                if held >= block_tokens:
                    yield emit()
                    keys, folds, lengths, parts, held = [], [], [], [], 0
        if keys:
            yield emit()

    found = docs.mapInArrow(run, "docs array<long>, fold binary, length binary, tokens long, size long, words binary, at binary")
    return found.withColumn("block", F.monotonically_increasing_id())


def _mixed(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """A hash of each pair of hashes, in order, of GRAM_BITS."""
    h = (left * _MIX) ^ ((right ^ (right >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + (left >> np.uint64(31)))
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0x94D049BB133111EB)
    return (h ^ (h >> np.uint64(31))) >> np.uint64(64 - GRAM_BITS)


class Block:
    """The arrays of a row of blocks(), with the number of each token's bigram and, where asked for, of its trigram."""

    def __init__(self, row):
        self.fold = np.frombuffer(row["fold"], np.uint8)
        self.length = _unpack(row["length"], np.int64)
        self.size = int(row["size"])
        self.at = _unpack(row["at"], np.uint32).astype(np.int64)
        self.ends = np.cumsum(self.length)
        self.token_fold = np.repeat(self.fold, self.length)
        self.first = self.ends - self.length
        self.before = np.empty_like(self.at)
        self.before[1:] = self.at[:-1]
        self.before[self.first] = self.size  # the start context
        self.pair, self.pair_at = _numbered(self.before * self.size + self.at)
        self.words = np.cumsum(_unpack(row["words"], np.uint64), dtype=np.uint64) if row.get("words") is not None else None

    def pairs(self) -> np.ndarray:
        """Hashes of the block's bigrams."""
        return _mixed(np.append(self.words, np.uint64(START))[self.pair // self.size], self.words[self.pair % self.size])

    def triples(self, alone: np.ndarray) -> None:
        """Number the trigrams of which neither bigram is alone in the corpus: triple, and triple_at for the tokens asked."""
        asked = ~alone[self.pair_at]
        asked[1:] &= asked[:-1]
        asked[self.first] = False  # a text's first token has no trigram
        self.asked = np.flatnonzero(asked)
        self.triple, self.triple_at = _numbered(self.pair_at[self.asked - 1] * self.size + self.at[self.asked])

    def triple_hashes(self) -> np.ndarray:
        return _mixed(self.pairs()[self.triple // self.size], self.words[self.triple % self.size])

    def counts(self, at: np.ndarray, size: int, where: np.ndarray | slice = slice(None)) -> dict[str, np.ndarray]:
        """Counts in training, in the tuning fold alone, and in the texts held out."""
        fold = self.token_fold[where]
        return {c: np.bincount(at[own], minlength=size).astype(np.uint32) for c, own in (("train", fold != HELD_OUT), ("tuning", fold == TUNING), ("held", fold == HELD_OUT))}


def _by_range(kind: str, hashes: np.ndarray, ranges: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(range, order, hashes): entries by even range of their hashes, in an order that follows from the hashes alone."""
    if not len(hashes):
        return
    order = np.arange(len(hashes)) if kind == "word" else _order(hashes)  # a block's words are ascending
    sorted_ = hashes[order]
    which = (sorted_ >> np.uint64((BITS if kind == "word" else GRAM_BITS) - 32)) * np.uint64(ranges) >> np.uint64(32)
    cuts = [0, *(np.flatnonzero(which[1:] != which[:-1]) + 1).tolist(), len(which)]
    for a, b in zip(cuts, cuts[1:], strict=False):
        yield int(which[a]), order[a:b], sorted_[a:b]


def _hashes(b: Block, row: dict, kind: str) -> np.ndarray:
    """The hashes of a block's entries of a kind."""
    if kind == "triple":
        b.triples(_flags(row["pair_alone"]))
    return {"word": lambda: b.words, "pair": b.pairs, "triple": b.triple_hashes}[kind]()


def _counts(b: Block, kind: str) -> dict[str, np.ndarray]:
    """The counts of the entries, once _hashes() has numbered them."""
    if kind == "word":
        return b.counts(b.at, b.size)
    return b.counts(b.pair_at, len(b.pair)) if kind == "pair" else b.counts(b.triple_at, len(b.triple), b.asked)


def _flags(packed: bytes) -> np.ndarray:
    return _unpack(packed, np.uint8).astype(bool)


def totals(found: DataFrame, kinds: tuple[str, ...], ranges: int) -> DataFrame:
    """(block, kind, range, train, tuning, alone, ...): total counts in the order of _by_range(), and whether an
    entry occurs once in all texts; the first row of a range also has its numbers of types and tokens."""

    def send(frames):
        for frame in frames:
            for row in frame.to_dict("records"):
                b = Block(row)
                for kind in kinds:
                    hashes, counted = _hashes(b, row, kind), _counts(b, kind)
                    out = [(row["block"], kind, r, _pack(np.diff(h, prepend=np.uint64(0))), *(_pack(c[own]) for c in counted.values())) for r, own, h in _by_range(kind, hashes, ranges)]
                    yield pd.DataFrame(out, columns=["block", "kind", "range", "hashes", "train", "tuning", "held"])

    def add(group: pd.DataFrame) -> pd.DataFrame:
        hashes = [np.cumsum(_unpack(x, np.uint64), dtype=np.uint64) for x in group["hashes"]]
        sizes = np.cumsum([0, *map(len, hashes)])
        types, at = _numbered(np.concatenate(hashes))
        sums = {c: np.bincount(at, np.concatenate([_unpack(x, np.uint32) for x in group[c]]), len(types)).astype(np.int64) for c in ("train", "tuning", "held")}
        kept = sums["train"] - sums["tuning"]
        sums["alone"] = (sums["train"] + sums.pop("held") == 1).astype(np.uint8)
        first = np.arange(len(group)) == 0
        return pd.DataFrame({
            "block": group["block"], "kind": group["kind"], "range": group["range"], **{c: [_pack(x[at[a:b]]) for a, b in zip(sizes, sizes[1:], strict=False)] for c, x in sums.items()},
            "types": np.where(first, int((sums["train"] > 0).sum()), 0), "tokens": np.where(first, int(sums["train"].sum()), 0),
            "kept_types": np.where(first, int((kept > 0).sum()), 0), "kept_tokens": np.where(first, int(kept.sum()), 0),
        })

    sent = found.mapInPandas(send, "block long, kind string, range int, hashes binary, train binary, tuning binary, held binary")
    return sent.groupBy("kind", "range").applyInPandas(add, "block long, kind string, range int, train binary, tuning binary, alone binary, types long, tokens long, kept_types long, kept_tokens long")


def resolved(found: DataFrame, total: DataFrame, kinds: tuple[str, ...], ranges: int, carried: tuple[str, ...]) -> DataFrame:
    """found's carried columns and the total counts of each block's entries: <kind>_train, _tuning and _alone."""
    # A block's totals come to it in one row: their size is bounded by the block's.
    back = total.groupBy("block").agg(F.collect_list(F.struct("kind", "range", "train", "tuning", "alone")).alias("back"))
    met = found.join(back, "block", "left")  # one row per block on either side
    kept = [f for f in found.schema.fields if f.name in carried]
    added = [(f"{kind}_{c}", t) for kind in kinds for c, t in (("train", np.int64), ("tuning", np.int64), ("alone", np.uint8))]

    def place(frames):
        for frame in frames:
            for row in frame.to_dict("records"):
                back = row.pop("back")
                parts = {(x["kind"], x["range"]): x for x in (back if back is not None else ())}
                out, b = {f.name: row[f.name] for f in kept}, Block(row)
                for kind in kinds:
                    hashes = _hashes(b, row, kind)
                    placed = {c: np.zeros(len(hashes), t) for c, t in (("train", np.int64), ("tuning", np.int64), ("alone", np.uint8))}
                    for r, order, _ in _by_range(kind, hashes, ranges):
                        for c, x in placed.items():
                            x[order] = _unpack(parts[kind, r][c], x.dtype)
                    out |= {f"{kind}_{c}": _pack(x) for c, x in placed.items()}
                yield pd.DataFrame([out])

    schema = T.StructType([*kept, *[T.StructField(c, T.BinaryType()) for c, _ in added]])
    return met.mapInPandas(place, schema)


def _bucket(context: np.ndarray) -> np.ndarray:
    """0 for unseen contexts, else 1 + the integer part of log2, at most BUCKETS - 1."""
    return np.where(context > 0, np.minimum(np.frexp(context.astype(float))[1], BUCKETS - 1), 0)


def _own(doc: np.ndarray, at: np.ndarray, size: int) -> np.ndarray:
    """How often each place's entry occurs in the place's own document."""
    _, which, n = np.unique(doc * size + at, return_inverse=True, return_counts=True)
    return n[which]


def _parts(row: dict, b: Block, sums: dict, tuning: bool, left_out: bool = False) -> tuple[np.ndarray, ...]:
    """Per token: buckets of its two contexts, and its trigram, bigram and unigram estimates; also the token's own
    count. With tuning by the counts without the tuning fold, with left_out by those without the token's own document."""

    def counted(kind: str) -> np.ndarray:
        train = _unpack(row[f"{kind}_train"], np.int64)
        return train - _unpack(row[f"{kind}_tuning"], np.int64) if tuning else train

    b.triples(_flags(row["pair_alone"]))
    # A trigram that wasn't asked for occurs here alone.
    three = (b.token_fold != HELD_OUT).astype(np.int64) - ((b.token_fold == TUNING) if tuning else 0)
    three[b.asked] = counted("triple")[b.triple_at]
    word, pair = counted("word"), counted("pair")
    one, two, own = word[b.at], pair[b.pair_at], word[b.at]
    starts, n = (sums["kept_docs"], sums["kept_tokens"]) if tuning else (sums["docs"], sums["tokens"])
    starts, n = np.full(len(b.length), starts), np.full(len(b.length), n)
    if left_out:
        known = b.fold != HELD_OUT
        doc, seen = np.repeat(np.arange(len(b.length)), b.length), np.repeat(known, b.length)
        starts, n = starts - known, n - known * b.length
        one = one - seen * _own(doc, b.at, b.size)
        two = two - seen * _own(doc, b.pair_at, len(b.pair))
        less = _own(doc[b.asked], b.triple_at, len(b.triple))
        own_three = np.ones(len(b.at), np.int64)
        own_three[b.asked] = less
        three = three - seen * own_three
    # A token's contexts are the two pairs and words before it, in its own document.
    context, around = np.empty_like(one), np.zeros_like(one)
    context[1:], around[1:] = one[:-1], two[:-1]
    context[b.first], around[b.first], three[b.first] = starts, 0, 0
    return _bucket(around), _bucket(context), three / np.maximum(around, 1), two / np.maximum(context, 1), one / np.maximum(np.repeat(n, b.length), 1), own


def tuning_rows(full: DataFrame, sums: dict) -> DataFrame:
    """(long, short, three, two, one): packed buckets and estimates of the tuning fold's tokens, one row per block."""

    def run(frames):
        for frame in frames:
            for row in frame.to_dict("records"):
                b = Block(row)
                own = b.token_fold == TUNING
                if own.any():
                    long, short, *estimates, _ = _parts(row, b, sums, True)
                    yield pd.DataFrame([[_pack(long[own].astype(np.uint8)), _pack(short[own].astype(np.uint8)), *(_pack(x[own].astype(np.float32)) for x in estimates)]], columns=["long", "short", "three", "two", "one"])

    return full.mapInPandas(run, "long binary, short binary, three binary, two binary, one binary")


def _terms(weights: dict[str, np.ndarray], long, short, three, two, one, floor: float) -> list[np.ndarray]:
    """The four parts of each token's probability."""
    a, b, g = weights["three"][long], weights["two"][short], weights["one"][0]
    rest = (1 - a) * (1 - b)
    return [a * three, (1 - a) * b * two, rest * g * one, rest * (1 - g) * floor]


def learn(rows: DataFrame, types: int, rounds: int = ROUNDS, tolerance: float = TOLERANCE) -> dict[str, np.ndarray]:
    """The weights three and two by bucket, and one. Each round is one pass over all tuning tokens that returns two
    sums per weight; the first starts from one half. Buckets without tokens take the nearest seen bucket's."""
    weights = {"three": np.full(BUCKETS, 0.5), "two": np.full(BUCKETS, 0.5), "one": np.full(1, 0.5)}
    weights["three"][0] = weights["two"][0] = 0
    floor = 1 / (types + 1)
    for _ in range(rounds):
        now = {k: w.copy() for k, w in weights.items()}

        def expect(frames, now=now):
            sums = {k: np.zeros((len(w), 2)) for k, w in now.items()}
            for frame in frames:
                for row in frame.itertuples(index=False):
                    long, short = (_unpack(x, np.uint8) for x in (row.long, row.short))
                    terms = _terms(now, long, short, *(_unpack(x, np.float32) for x in (row.three, row.two, row.one)), floor)
                    total = sum(terms)
                    three, two, one, _ = (t / total for t in terms)
                    for k, bucket, hit, of in (("three", long, three, np.ones(len(total))), ("two", short, two, 1 - three), ("one", np.zeros(len(total), np.uint8), one, 1 - three - two)):
                        sums[k][:, 0] += np.bincount(bucket, hit, len(now[k]))
                        sums[k][:, 1] += np.bincount(bucket, of, len(now[k]))
            yield pd.DataFrame([(k, i, *map(float, x)) for k, s in sums.items() for i, x in enumerate(s) if x.any()], columns=["weight", "bucket", "hit", "of"])

        found = rows.mapInPandas(expect, "weight string, bucket int, hit double, of double").groupBy("weight", "bucket").agg(F.sum("hit").alias("hit"), F.sum("of").alias("of")).collect()  # a row per weight at most
        seen = {(r["weight"], r["bucket"]): r["hit"] / r["of"] for r in found if r["of"] > 0}
        for k, w in weights.items():
            known = [i for name, i in seen if name == k]
            for i in range(len(w)):
                if known:
                    w[i] = min(max(seen[k, min(known, key=lambda j: (abs(j - i), j))], 1e-6), 1 - 1e-6)
        weights["three"][0] = weights["two"][0] = 0
        if max(np.abs(weights[k] - now[k]).max() for k in weights) <= tolerance:
            break
    return weights


def score(docs: DataFrame, key: str = "doc_id", text: str = "text", block_tokens: int = BLOCK_TOKENS, range_tokens: int = RANGE_TOKENS, left_out: bool = False) -> DataFrame:
    """Per row: key, held_out, n_tokens, n_known, train_tokens, base_score and score, natural for all texts.

    Tokens are A-Z-lowered words and one end token a text (null and empty texts: only that); a text of any length is
    scored whole, the longest making a block of its own. base_score adds log10((c + 1) / (N + V + 1)) over tokens,
    c with the text's own tokens; score is the model's log10 probability. With left_out there is score_left_out too, for
    which a training text's own counts are deleted first; for other texts it is score.
    The fold of a row is the crc32 of its key as text, so all rows of a key share it; rows of null key train.
    Repeated rows count each. An empty table gives an empty table. Only key and text are read, so other columns
    can't clash.
    """
    found = materialize(blocks(docs, key, text, block_tokens), "lm-blocks")
    n_blocks, n_tokens = found.agg(F.count(F.lit(1)), F.sum("tokens")).first()
    schema = f"`{key}` long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double" + ", score_left_out double" * left_out
    if not n_blocks:
        return docs.sparkSession.createDataFrame([], schema)
    ranges = max(RANGES, -(-n_tokens // range_tokens))
    total = materialize(totals(found, ("word", "pair"), ranges), "lm-totals")
    of = total.filter("kind = 'word'").agg(*[F.sum(c).alias(c) for c in ("types", "tokens", "kept_types", "kept_tokens")]).first()
    sums = {c: int(of[c] or 0) for c in ("types", "tokens", "kept_types", "kept_tokens")}
    own = ("docs", "fold", "length", "size", "at", "block")
    two = materialize(resolved(found, total, ("word", "pair"), ranges, (*own, "words")), "lm-pairs")
    discard(found)
    discard(total)
    total = materialize(totals(two, ("triple",), ranges), "lm-totals")
    carried = (*own, "word_train", "word_tuning", "pair_train", "pair_tuning", "pair_alone")
    full = materialize(resolved(two, total, ("triple",), ranges, carried), "lm-triples")
    discard(two)
    discard(total)

    def ends(frames):  # texts in training, and without the tuning fold: the counts of the start context
        for frame in frames:
            folds = [np.frombuffer(x, np.uint8) for x in frame["fold"]]
            yield pd.DataFrame({"train": [sum(int((f != HELD_OUT).sum()) for f in folds)], "kept": [sum(int(((f != HELD_OUT) & (f != TUNING)).sum()) for f in folds)]})

    texts = full.select("fold").mapInPandas(ends, "train long, kept long").agg(F.sum("train").alias("train"), F.sum("kept").alias("kept")).first()
    sums |= {"docs": int(texts["train"]), "kept_docs": int(texts["kept"])}
    rows = materialize(tuning_rows(full, sums), "lm-tuning")
    weights = learn(rows, sums["kept_types"])
    discard(rows)

    def run(frames):
        n, v = sums["tokens"], sums["types"]
        for frame in frames:
            for row in frame.to_dict("records"):
                b = Block(row)
                *parts, c = _parts(row, b, sums, False)
                p = [sum(_terms(weights, *parts, 1 / (v + 1)))]
                if left_out:
                    p.append(sum(_terms(weights, *_parts(row, b, sums, False, True)[:-1], 1 / (v + 1))))
                base = np.log10((c + 1) / (n + v + 1))
                yield pd.DataFrame({
                    key: pd.array(list(row["docs"]), "Int64"), "held_out": b.fold == HELD_OUT, "n_tokens": b.length, "n_known": np.add.reduceat((c > 0).astype(np.int64), b.first), "train_tokens": n,
                    "base_score": np.add.reduceat(base, b.first), **{name: np.add.reduceat(np.log10(x), b.first) for name, x in zip(("score", "score_left_out"), p, strict=False)},
                })

    return full.mapInPandas(run, schema)
