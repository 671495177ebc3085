"""Operator 8: BPE encoding and decoding by dynamic programming over prefixes."""

from __future__ import annotations

import hashlib
from functools import cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from lodestack.llm.tables import extended, pieces
from lodestack.llm.word_bpe import TOKENIZER, Vocabulary, WordTable, vocabulary


#: Compatibility answers that a Python worker remembers; then it starts anew. Bounds memory, changes no result.
REMEMBERED_PAIRS = 250_000


class PrefixEncoder:
    """Exact BPE ids from one left-to-right pass.

    The last token of a prefix's encoding is unique: it is the vocabulary token that ends the prefix and is
    compatible with the last token of what stands before it. The automaton lists the tokens that end at each
    place, longest first, through its suffix links; ``last`` keeps the one that fits and the back-pointers,
    a token's length each, give the ids. Two tokens are compatible if merging their joint symbols leaves
    exactly the two, which is decided by undoing merges along their common border.
    """

    def __init__(self, v: Vocabulary):
        self.v = v
        self.rank = {(a, b): r for r, (a, b, _) in enumerate(v.merges)}
        self.parts = {c: (a, b) for a, b, c in v.merges}
        self.made_at = {c: r for r, (_, _, c) in enumerate(v.merges)}
        spelled: dict[int, str] = {i: chr(i + 1) for i in [*v.inner.tolist(), *v.last.tolist()]}
        for a, b, c in v.merges:
            spelled[c] = spelled[a] + spelled[b]
        self.find = ahocorasick.Automaton()
        for i, s in spelled.items():
            if self._whole(i):
                self.find.add_word(s, (len(s), i))
        self.find.make_automaton()
        self.fits: dict[int, bool] = {}

    def _whole(self, token: int) -> bool:
        """Whether a token's own symbols merge into that token."""
        return token not in self.parts or self.compatible(*self.parts[token], below=self.made_at[token])

    def compatible(self, left: int, right: int, below: int = 1 << 60) -> bool:
        """No merge of rank less than ``below`` joins symbols across the border while left and right are built."""
        while True:
            joined = self.rank.get((left, right))
            if joined is not None and joined < below:
                return False
            a, b = self.made_at.get(left, -1), self.made_at.get(right, -1)
            if a < 0 and b < 0:
                return True
            # Undo the later of the two merges: before it, its near half stood at the border. On equal rank the
            # left one was applied first, so undo the right one. A pair of rank up to the undone merge's would
            # have been applied before it; on the left side also at the same rank.
            if a > b:
                below, left = a, self.parts[left][1]
            else:
                below, right = b + 1, self.parts[right][0]

    def encode(self, pretoken: str) -> np.ndarray:
        symbols = "".join(map(chr, (self.v.symbols(pretoken) + 1).tolist()))
        n = len(symbols)
        last, size, fits = [-1] * n, [0] * n, self.fits
        for end, (length, token) in self.find.iter(symbols):
            if last[end] >= 0:
                continue
            before = end - length
            if before >= 0:
                left = last[before]
                if left < 0:
                    continue
                key = left << 20 | token
                fit = fits.get(key)
                if fit is None:
                    if len(fits) > REMEMBERED_PAIRS:
                        fits.clear()
                    fit = fits[key] = self.compatible(left, token)
                if not fit:
                    continue
            last[end], size[end] = token, length
        out, end = [], n - 1
        while end >= 0:
            out.append(last[end])
            end -= size[end]
        return np.array(out[::-1], np.int32)


@cache
def codec(name: str) -> tuple[Vocabulary, WordTable]:
    v = vocabulary(name)
    encoder = PrefixEncoder(v)
    return v, WordTable(lambda chunks: v.encode_chunks(chunks, lambda pre: [encoder.encode(p) for p in pre]))


def decode_ids(v: Vocabulary, ids: np.ndarray) -> str:
    """The vocabulary has no decoder of its own: tokens are shown as they are, with a space between."""
    return " ".join(map(v.token.__getitem__, ids.tolist()))


def _ends(counts: np.ndarray):
    ends = np.cumsum(counts)
    return zip((ends - counts).tolist(), ends.tolist(), strict=True)


def encode(docs: DataFrame, text: str = "text", name: str = TOKENIZER, ids: str = "ids") -> DataFrame:
    """docs' columns with an array<int> column of token ids added (a column of that name is replaced).

    No shuffle. Null and empty texts get an empty array; very long texts and single words are encoded whole, in linear
    time; repeated rows stay; empty tables stay empty. Other columns are carried as they are.
    """
    own = [c for c in docs.columns if c != ids]
    docs = docs.select(*[docs[c] for c in own])

    def run(batches):
        _, table = codec(name)
        for batch in batches:
            for rows, texts in pieces(batch, text):
                flat, n = table.token_ids(texts)
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]).astype(np.int32)), pa.array(flat))
                yield pa.RecordBatch.from_arrays([*rows.columns, lists], names=[*own, ids])

    return docs.mapInArrow(run, extended(docs.schema, **{ids: T.ArrayType(T.IntegerType())}))


def decode(encoded: DataFrame, ids: str = "ids", name: str = TOKENIZER, text: str = "decoded") -> DataFrame:
    """encoded's columns with the decoded text added (a column of that name is replaced). Null ids: empty text."""
    own = [c for c in encoded.columns if c != text]
    encoded = encoded.select(*[encoded[c] for c in own])

    def run(batches):
        v = vocabulary(name)
        for batch in batches:
            lists = batch.column(batch.schema.get_field_index(ids))
            out = [decode_ids(v, np.array(x.as_py() or [], np.int64)) for x in lists]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.string())], names=[*own, text])

    return encoded.mapInArrow(run, extended(encoded.schema, **{text: T.StringType()}))


def digest(docs: DataFrame, key: str = "doc_id", text: str = "text", name: str = TOKENIZER) -> DataFrame:
    """Per row: key, n_tokens, ids_sha256 and decoded_sha256 of encode() followed by decode(), in one pass.

    Null and empty texts have no ids and decode to the empty text; a null key stays null; very long texts are whole;
    repeated rows stay; empty tables stay empty. Only key and text are read, so other columns can't clash.
    """
    docs = docs.select(docs[key], docs[text])
    names = [key, "n_tokens", "ids_sha256", "decoded_sha256"]
    schema = T.StructType([docs.schema[key], T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())])

    def run(batches):
        v, table = codec(name)
        for batch in batches:
            for rows, texts in pieces(batch, text):
                flat, n = table.token_ids(texts)
                flat = flat.astype("<u4")
                coded, shown = [], []
                for a, b in _ends(n):
                    coded.append(hashlib.sha256(flat[a:b].tobytes()).hexdigest())
                    shown.append(hashlib.sha256(decode_ids(v, flat[a:b]).encode()).hexdigest())
                yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(n), pa.array(coded, pa.string()), pa.array(shown, pa.string())], names=names)

    return docs.mapInArrow(run, schema)
