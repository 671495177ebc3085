"""Operator 7: token ids in independent zstandard frames with a trailing seek table.

A store is a folder of shards ``ids-00000-<attempt>.zst``, named by a manifest. A shard is a plain zstandard file:

* data frames, each holding a run of documents (at most FRAME_IDS ids, or one longer document):
  u32 n, n x i64 document key, n x u32 length (highest bit set: a document without key), then all ids as u32,
  little-endian throughout;
* one skippable frame, the document index: per data frame its number of documents (highest bit set: some have no
  key), and the first and last key of the others (first above last where there are none);
* one skippable frame, the seek table: per frame its compressed size, decompressed size and the low 32 bits
  of the XXH64 of its decompressed bytes; then the number of frames, a descriptor byte and a magic number.

Any zstandard tool reads the ids of a whole shard; a reader of single documents reads the two trailing frames
and then only the frames that can hold them. Checksums are verified on reading.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestack.llm.tables import pieces
from lodestack.llm.word_bpe import TOKENIZER, WordTable, library, vocabulary
from lodestack.runtime import arrow_store, scratch

FRAME_IDS = 65_536
#: Fixed values of the public zstandard seekable format.
SKIPPABLE, SEEK_MAGIC, CHECKSUM_FLAG = 0x184D2A5E, 0x8F92EAB1, 0x80
INDEX_SKIPPABLE, KEYLESS = 0x184D2A50, 1 << 31


class ShardWriter:
    def __init__(self, sink):
        self.sink = sink
        self.entries: list[tuple[int, int, int]] = []
        self.index: list[tuple[int, int, int]] = []
        self.keys: list[int | None] = []
        self.ids: list[np.ndarray] = []
        self.held = 0
        self.documents = self.total = 0
        self.pack = zstandard.ZstdCompressor(level=1, write_checksum=True)

    def add(self, key: int | None, ids: np.ndarray) -> None:
        if self.keys and self.held + len(ids) > FRAME_IDS:
            self.flush()
        self.keys.append(key)
        self.ids.append(ids)
        self.held += len(ids)

    def flush(self) -> None:
        if not self.keys:
            return
        known = [k for k in self.keys if k is not None]
        lengths = [len(x) | (KEYLESS if k is None else 0) for k, x in zip(self.keys, self.ids, strict=True)]
        raw = b"".join([struct.pack("<I", len(self.keys)), np.array([k or 0 for k in self.keys], "<i8").tobytes(), np.array(lengths, "<u4").tobytes(), np.concatenate(self.ids).astype("<u4").tobytes()])
        packed = self.pack.compress(raw)
        self.sink.write(packed)
        self.entries.append((len(packed), len(raw), xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF))
        self.index.append((len(self.keys) | (KEYLESS if len(known) < len(self.keys) else 0), *((min(known), max(known)) if known else (1, 0))))
        self.documents += len(self.keys)
        self.total += self.held
        self.keys, self.ids, self.held = [], [], 0

    def close(self) -> None:
        self.flush()
        index = b"".join(struct.pack("<Iqq", *x) for x in self.index)
        self.sink.write(struct.pack("<II", INDEX_SKIPPABLE, len(index)) + index)
        table = b"".join(struct.pack("<III", *x) for x in self.entries) + struct.pack("<IBI", len(self.entries), CHECKSUM_FLAG, SEEK_MAGIC)
        self.sink.write(struct.pack("<II", SKIPPABLE, len(table)) + table)


class ShardReader:
    def __init__(self, source):
        self.source = source
        size = source.size()
        tail = source.read_at(9, size - 9)
        n, flags, magic = struct.unpack("<IBI", tail)
        if magic != SEEK_MAGIC or flags != CHECKSUM_FLAG:
            raise ValueError("no seek table")
        at = size - 9 - 12 * n
        self.entries = list(struct.iter_unpack("<III", source.read_at(12 * n, at))) if n else []
        at -= 8 + 20 * n
        self.index = list(struct.iter_unpack("<Iqq", source.read_at(20 * n, at))) if n else []
        sizes = [e[0] for e in self.entries]
        self.offsets = [sum(sizes[:i]) for i in range(n)] if n < 2 else [0, *np.cumsum(sizes)[:-1].tolist()]

    def frame(self, i: int) -> Iterator[tuple[int | None, np.ndarray]]:
        packed, size, check = self.entries[i]
        raw = zstandard.ZstdDecompressor().decompress(self.source.read_at(packed, self.offsets[i]), max_output_size=size)
        if len(raw) != size or xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF != check:
            raise ValueError(f"frame {i} is damaged")
        (n,) = struct.unpack_from("<I", raw)
        keys = np.frombuffer(raw, "<i8", n, 4)
        marked = np.frombuffer(raw, "<u4", n, 4 + 8 * n)
        lengths = (marked & ~np.uint32(KEYLESS)).astype(np.int64)
        ids = np.frombuffer(raw, "<u4", -1, 4 + 12 * n)
        ends = np.cumsum(lengths)
        for key, keyless, a, b in zip(keys.tolist(), (marked >= KEYLESS).tolist(), (ends - lengths).tolist(), ends.tolist(), strict=True):
            yield (None if keyless else key), ids[a:b]

    def lookup(self, keys: Iterable[int | None]) -> dict[int | None, list[np.ndarray]]:
        """The ids of the wanted documents; only frames whose key range holds one are decompressed."""
        want = set(keys)
        known = sorted(k for k in want if k is not None)
        out: dict[int | None, list[np.ndarray]] = {}
        for i, (n, first, last) in enumerate(self.index):
            if n >= KEYLESS and None in want or bisect_left(known, first) < bisect_right(known, last):
                for key, ids in self.frame(i):
                    if key in want:
                        out.setdefault(key, []).append(ids)
        return out


@cache
def _table(name: str) -> WordTable:
    """Distinct pre-tokens through the library's own BPE model."""
    v, model = vocabulary(name), library(name).model

    def encode(pretokens: list[str]) -> list[np.ndarray]:
        return [np.array([t.id for t in model.tokenize(v.spelled(p))], np.int32) for p in pretokens]

    return WordTable(lambda chunks: v.encode_chunks(chunks, encode))


def write_store(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", name: str = TOKENIZER, end_id: int = 2) -> DataFrame:
    """Encode the rows of docs, in ascending key order, into a store at path; returns its manifest.

    One range shuffle of the texts by key (rows of equal key are ordered by text). Each attempt of a task writes a
    shard under a name of its own, and the manifest names that of the attempt which counted; others, of tasks that
    were repeated or ran twice at once, are never read. Null keys come first; null texts are empty (only the end id);
    very long texts make a frame of their own; repeated rows stay; an empty table gives an empty store. The manifest
    has a row per shard: shard, file, documents, ids, start (ids of all earlier shards).
    """
    spark = docs.sparkSession
    ordered = docs.select(docs[key].cast("long").alias("key"), docs[text].alias("text")).repartitionByRange("key", F.xxhash64("text")).sortWithinPartitions("key", F.xxhash64("text"))

    def run(batches):
        table, fs, sink = _table(name), None, None
        shard = TaskContext.get().partitionId()
        end = np.array([end_id], np.int32)
        for batch in batches:
            for rows, texts in pieces(batch):
                if sink is None:
                    fs, root = arrow_store(path)
                    fs.create_dir(root, recursive=True)
                    shard_file = f"ids-{shard:05d}-{uuid.uuid4().hex}.zst"
                    sink = fs.open_output_stream(f"{root}/{shard_file}", compression=None)
                    writer = ShardWriter(sink)
                flat, n = table.token_ids(texts)
                ends = np.cumsum(n).tolist()
                for k, a, b in zip(rows.column(0).to_pylist(), [0, *ends[:-1]], ends, strict=True):
                    writer.add(k, np.concatenate([flat[a:b], end]))
        if sink is not None:
            writer.close()
            sink.close()
            yield pa.RecordBatch.from_pydict({"shard": pa.array([shard], pa.int64()), "file": [shard_file], "documents": pa.array([writer.documents], pa.int64()), "ids": pa.array([writer.total], pa.int64())})

    shards = ordered.mapInArrow(run, "shard long, file string, documents long, ids long")
    made = scratch(spark, "manifest")
    shards.write.parquet(made)
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # one row per shard
    return spark.read.schema(shards.schema).parquet(made).withColumn("start", F.coalesce(F.sum("ids").over(before), F.lit(0)))


def read_store(spark: SparkSession, path: str, manifest: DataFrame, key: str = "doc_id") -> DataFrame:
    """Per stored document: key, start (ids of all documents before it), n_tokens and ids_crc32."""

    def run(batches):
        fs, root = arrow_store(path)
        for batch in batches:
            for file, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                with fs.open_input_file(f"{root}/{file}") as source:
                    reader = ShardReader(source)
                    for i in range(len(reader.entries)):
                        out: dict[str, list] = {key: [], "start": [], "n_tokens": [], "ids_crc32": []}
                        for k, ids in reader.frame(i):
                            for c, x in zip(out, (k, start, len(ids), zlib.crc32(ids.tobytes())), strict=True):
                                out[c].append(x)
                            start += len(ids)
                        yield pa.RecordBatch.from_pydict({c: pa.array(x, pa.int64()) for c, x in out.items()})

    # As many tasks as shards: by the manifest's size alone, adaptive execution would read all shards in one.
    shards = manifest.select("file", "start").repartition(max(1, manifest.count()))
    return shards.mapInArrow(run, f"`{key}` long, start long, n_tokens long, ids_crc32 long")
