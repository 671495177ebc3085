"""Shared ground of the operators on the public word-level BPE vocabulary.

White space never takes part in that vocabulary, so the chunks between ASCII white space encode independently.
``WordTable`` encodes each distinct chunk once and assembles documents from the rows of a ragged table.
"""

from __future__ import annotations

import json
import os
from collections.abc import Callable
from functools import cache

import numpy as np
import regex

TOKENIZER = "word_bpe_49k.json"
#: Distinct chunks, and bytes of chunks and ids, that a Python worker remembers; then it starts anew. Bounds memory,
#: changes no result.
REMEMBERED, REMEMBERED_BYTES = 600_000, 32_000_000

#: Fixed value of the vocabulary: its pre-token pattern.
PRETOKEN = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")

#: Printable ASCII and Latin-1: here normal form C changes nothing and lower case is a plain mapping.
_PLAIN = regex.compile(r"[!-~¡-ÿ]*")


def tokenizer_path(name: str) -> str:
    if os.path.isabs(name):
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


@cache
def library(name: str):
    """The tokenizers library's object for a vocabulary file, without truncation and padding."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(tokenizer_path(name))
    tok.no_truncation()
    tok.no_padding()
    return tok


class Vocabulary:
    """Base symbols, merges and special tokens of a word-level BPE file."""

    def __init__(self, name: str):
        with open(tokenizer_path(name), encoding="utf-8") as f:
            spec = json.load(f)
        ids: dict[str, int] = spec["model"]["vocab"]
        self.end = spec["model"]["end_of_word_suffix"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.token = [""] * (max([*ids.values(), *self.special.values()]) + 1)
        for s, i in {**ids, **self.special}.items():
            self.token[i] = s
        self.merges = [(ids[a], ids[b], ids[a + b]) for a, b in map(_pair, spec["model"]["merges"])]
        letters = self.letters = _byte_letters()
        self.inner = np.array([ids[c] for c in letters], np.int32)
        self.last = np.array([ids[c + self.end] for c in letters], np.int32)
        self.split_special = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")")
        self._library = library(name)

    def pretokens(self, chunk: str) -> list[str]:
        """Normalised pre-tokens of a text without special strings."""
        if _PLAIN.fullmatch(chunk):
            return PRETOKEN.findall(chunk.lower())
        clean = self._library.normalizer.normalize_str(chunk)
        return [clean[a:b] for _, (a, b) in self._library.pre_tokenizer.pre_tokenize_str(clean)]

    def spelled(self, pretoken: str) -> str:
        """A pre-token's bytes as the letters that stand for them."""
        return pretoken if pretoken.isascii() and pretoken.isprintable() else "".join(map(self.letters.__getitem__, pretoken.encode()))

    def symbols(self, pretoken: str) -> np.ndarray:
        raw = np.frombuffer(pretoken.encode(), np.uint8)
        out = self.inner[raw]
        out[-1] = self.last[raw[-1]]
        return out

    def encode_chunks(self, chunks: list[bytes], encode_pretokens: Callable[[list[str]], list[np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all chunks one after another, and each chunk's number of ids.

        encode_pretokens gives the ids of distinct pre-tokens. Special strings take the places after them.
        """
        known: dict[str, int] = {}
        special = list(self.special)
        places: list[int] = []
        counts = np.ones(len(chunks), np.int64)
        for i, raw in enumerate(chunks):
            chunk = raw.decode()
            if chunk.isascii() and chunk.isalpha():
                places.append(known.setdefault(chunk.lower(), len(known)))
                continue
            before = len(places)
            for piece in self.split_special.split(chunk) if "<|" in chunk else (chunk,):
                if piece in self.special:
                    places.append(-1 - special.index(piece))
                elif piece:
                    places += [known.setdefault(p, len(known)) for p in self.pretokens(piece)]
            counts[i] = len(places) - before
        ids = [*encode_pretokens(list(known)), *(np.array([self.special[s]], np.int32) for s in reversed(special))]
        lengths = np.fromiter(map(len, ids), np.int64, len(ids))
        at = np.array(places, np.int64)
        at[at < 0] += len(ids)
        return ragged_take(np.concatenate(ids), np.cumsum(lengths) - lengths, lengths, at), ragged_sums(lengths[at], counts)


def _pair(merge: str | list[str]) -> tuple[str, str]:
    a, b = merge.split(" ") if isinstance(merge, str) else merge
    return a, b


def _byte_letters() -> list[str]:
    """The printable letter that stands for each byte in byte-level vocabularies, by byte."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    extra = iter(range(256, 512))
    keep = set(shown)
    return [chr(b) if b in keep else chr(next(extra)) for b in range(256)]


@cache
def vocabulary(name: str) -> Vocabulary:
    return Vocabulary(name)


class _Rows(dict):
    """Chunk to row number; unknown chunks get the next number and wait in ``new``."""

    def __init__(self):
        super().__init__()
        self.new: list[bytes] = []

    def __missing__(self, chunk: bytes) -> int:
        row = self[chunk] = len(self)
        self.new.append(chunk)
        return row


class WordTable:
    """Ragged table of the ids of all chunks met so far."""

    def __init__(self, encode: Callable[[list[bytes]], tuple[np.ndarray, np.ndarray]], limit: int = REMEMBERED, limit_bytes: int = REMEMBERED_BYTES):
        self.encode, self.limit, self.limit_bytes = encode, limit, limit_bytes
        self._reset()

    def _reset(self) -> None:
        self.rows = _Rows()
        self.start, self.length, self.flat = np.zeros(1024, np.int32), np.zeros(1024, np.int32), np.zeros(4096, np.int32)
        self.held = self.used = self.bytes = 0

    def _grow(self) -> None:
        new, self.rows.new = self.rows.new, []
        ids, lengths = self.encode(new)
        self.start = _room(self.start, self.held + len(new))
        self.length = _room(self.length, self.held + len(new))
        self.flat = _room(self.flat, self.used + len(ids))
        self.start[self.held : self.held + len(new)] = self.used + np.cumsum(lengths) - lengths
        self.length[self.held : self.held + len(new)] = lengths
        self.flat[self.used : self.used + len(ids)] = ids
        self.held += len(new)
        self.used += len(ids)
        self.bytes += sum(map(len, new)) + ids.nbytes

    def documents(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """For each text its number of chunks, and the table rows of all chunks in order."""
        if len(self.rows) > self.limit or self.bytes > self.limit_bytes:
            self._reset()
        counts, parts = np.zeros(len(texts), np.int64), []
        for i, text in enumerate(texts):
            words = text.split()
            counts[i] = len(words)
            parts.append(np.fromiter(map(self.rows.__getitem__, words), np.int64, len(words)))
        if self.rows.new:
            self._grow()
        return counts, np.concatenate(parts) if parts else np.zeros(0, np.int64)

    def token_counts(self, texts: list[bytes]) -> np.ndarray:
        counts, rows = self.documents(texts)
        return ragged_sums(self.length[rows], counts)

    def token_ids(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after another, and the number of each text's ids."""
        counts, rows = self.documents(texts)
        lengths = self.length[rows]
        return ragged_take(self.flat, self.start, self.length, rows), ragged_sums(lengths, counts)


def _room(values: np.ndarray, size: int) -> np.ndarray:
    """values with place for size entries, twice as long each time."""
    if size <= len(values):
        return values
    out = np.zeros(max(size, 2 * len(values)), values.dtype)
    out[: len(values)] = values
    return out


def ragged_take(flat: np.ndarray, start: np.ndarray, length: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """The wanted rows of a ragged table one after another."""
    lengths = length[rows].astype(np.int64)
    at = np.repeat(start[rows] - (np.cumsum(lengths) - lengths), lengths)
    at += np.arange(len(at))
    return flat[at]


def ragged_sums(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Sums of consecutive runs of values, counts long each."""
    total = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
    ends = np.cumsum(counts)
    return total[ends] - total[ends - counts]
