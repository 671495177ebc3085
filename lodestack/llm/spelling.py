"""Operator 13: grouping spelling variants by tries and distance-one automata.

Words are counted in tasks first, so a frequent word costs one row a task. The vocabulary is dealt into shards of words
of one length, about SHARD_WORDS each; a task makes a shard's words into a trie of three flat arrays in level order.
Groups of shards of at most BROADCAST_BYTES are broadcast in turn; each word's automaton for one edit is
intersected with every shard of its length, one less and one more, depth first: along the word's own path the edit that
leads to the shard's length is tried at each place, and behind it only the rest of the word is followed. A word sends its number of neighbours and its
best one, which are summed up over shards.
"""

from __future__ import annotations

import re
from array import array
from collections import Counter
from collections.abc import Iterator
from zlib import crc32

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestack.llm.tables import pieces
from lodestack.runtime import materialize

LEAST_CHARS, LEAST_COUNT, RATIO, SLIPS = 7, 2, 10, 31
SHARD_WORDS, BROADCAST_BYTES, HELD_WORDS = 300_000, 64_000_000, 300_000


def slip(key: str, word: str) -> str:
    """The word, less one code point in one of SLIPS cases told by the key."""
    h = crc32(f"{key}:{word}".encode())
    at = h % len(word)
    return word if h % SLIPS else word[:at] + word[at + 1 :]


def word_counts(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(word, n) of all words of LEAST_CHARS code points or more."""
    docs = docs.select(docs[key].cast("string").alias("key"), docs[text].alias("text"))
    # Shorter runs make no word, so only the start of one that is long enough matches; it is taken whole.
    runs = re.compile(f"[A-Za-zÀ-ÿ]{{{LEAST_CHARS},}}")

    def sent(held: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], names=["word", "n"])

    def run(batches):
        held: Counter = Counter()
        for batch in batches:
            for rows, texts in pieces(batch):
                for doc, t in zip(rows.column(0).to_pylist(), texts, strict=True):
                    own = Counter(runs.findall(t.lower().decode()))  # bytes: A-Z only
                    for word, n in own.items():
                        word = slip("" if doc is None else doc, word)
                        if len(word) >= LEAST_CHARS:
                            held[word] += n
                if len(held) > HELD_WORDS:
                    yield sent(held)
                    held.clear()
        yield sent(held)

    return docs.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


class Trie:
    """Words in level order: the children of node v are first[v] to first[v + 1] - 1, labels[v] is the character that leads
    to v, count[v] the number of occurrences of the word that ends there, or 0."""

    def __init__(self, labels: str, first: array, count: array):
        self.labels, self.first, self.count = labels, first, count

    @classmethod
    def of(cls, words: list[str], counts: list[int]) -> Trie:
        """words: distinct and in order."""
        labels, first, count, level, depth = [" "], array("i", [1]), array("q"), [(0, len(words))], 0
        while level:
            below = []
            for lo, hi in level:
                ends = lo < hi and len(words[lo]) == depth
                count.append(counts[lo] if ends else 0)
                at = lo + ends
                while at < hi:
                    label, start = words[at][depth], at
                    while at < hi and words[at][depth] == label:
                        at += 1
                    labels.append(label)
                    below.append((start, at))
                first.append(len(labels))
            level, depth = below, depth + 1
        return cls("".join(labels), first, count)

    def _rest(self, v: int, word: str, at: int) -> int:
        """The count of the word at the end of word[at:] from v, or 0."""
        labels, first = self.labels, self.first
        for c in word[at:]:
            v = labels.find(c, first[v], first[v + 1])
            if v < 0:
                return 0
        return self.count[v]

    def near(self, word: str, length: int) -> dict[str, int]:
        """The words of ``length`` code points that one inserted, deleted or replaced one makes of word, with their counts.

        The length tells the edit, so the automaton's other branches, which couldn't end, aren't followed.
        """
        labels, first, count, found, v = self.labels, self.first, self.count, {}, 0
        more, size = length - len(word), len(word)
        for at in range(size + (more > 0)):
            if more < 0:
                if n := self._rest(v, word, at + 1):
                    found[word[:at] + word[at + 1 :]] = n
            else:
                after = at + 1 - more  # the place of word that follows the new character
                for child in range(first[v], first[v + 1]):
                    if after < size:
                        below = labels.find(word[after], first[child], first[child + 1])
                        n = self._rest(below, word, after + 1) if below >= 0 else 0
                    else:
                        n = count[child]
                    if n and (more or labels[child] != word[at]):
                        found[word[:at] + labels[child] + word[after:]] = n
            if at == size:
                break
            v = labels.find(word[at], first[v], first[v + 1])
            if v < 0:
                break
        return found


def shards(vocabulary: DataFrame, shard_words: int = SHARD_WORDS) -> DataFrame:
    """(length, part, labels, first, count, bytes): the tries of the vocabulary (word, n)."""
    sized = vocabulary.withColumn("length", F.length("word"))
    parts = sized.groupBy("length").agg(F.ceil(F.count(F.lit(1)) / shard_words).alias("parts"))  # one row a length
    dealt = sized.join(parts, "length").select("length", F.pmod(F.xxhash64("word"), "parts").cast("int").alias("part"), "word", "n")

    def build(table: pa.Table) -> pa.Table:
        words, counts = zip(*sorted(zip(table["word"].to_pylist(), table["n"].to_pylist(), strict=True)), strict=True)
        trie = Trie.of(list(words), list(counts))
        row = {"length": table["length"][:1], "part": table["part"][:1], "labels": [trie.labels], "first": [trie.first.tobytes()], "count": [trie.count.tobytes()], "bytes": [12 * len(trie.count) + len(trie.labels.encode())]}
        return pa.table(row)

    return dealt.groupBy("length", "part").applyInArrow(build, "length int, part int, labels string, first binary, count binary, bytes long")


def _groups(sizes: list[tuple[int, int, int]], most: int) -> Iterator[list[tuple[int, int]]]:
    """Runs of (length, part) with at most ``most`` bytes, or one shard."""
    held, total = [], 0
    for length, part, size in sizes:
        if held and total + size > most:
            yield held
            held, total = [], 0
        held.append((length, part))
        total += size
    if held:
        yield held


def neighbours(vocabulary: DataFrame, shard_words: int = SHARD_WORDS, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """(word, n_near, best_n, best) of the words of vocabulary (word, n) that have a neighbour."""
    spark = vocabulary.sparkSession
    made = materialize(shards(vocabulary, shard_words), "trie-shards")
    sizes = [tuple(r) for r in made.select("length", "part", "bytes").orderBy("length", "part").collect()]  # a row for each 300,000 words
    parts = []
    for group in _groups(sizes, broadcast_bytes):
        own = made.filter(F.concat_ws(":", "length", "part").isin([f"{a}:{b}" for a, b in group]))
        held = spark.sparkContext.broadcast([(r["length"], r["labels"], bytes(r["first"]), bytes(r["count"])) for r in own.collect()])

        def run(batches, held=held):
            tries = [(length, Trie(labels, array("i", first), array("q", count))) for length, labels, first, count in held.value]
            for batch in batches:
                out = []
                for word in batch.column(0).to_pylist():
                    met = [(-n, near) for length, trie in tries if abs(length - len(word)) <= 1 for near, n in trie.near(word, length).items()]
                    if met:
                        n, best = min(met)
                        out.append((word, len(met), -n, best))
                columns = zip(*out, strict=True) if out else ((), (), (), ())
                yield pa.RecordBatch.from_arrays([pa.array(list(c), kind) for c, kind in zip(columns, (pa.string(), pa.int64(), pa.int64(), pa.string()), strict=True)], names=["word", "n_near", "best_n", "best"])

        low, high = min(a for a, _ in group) - 1, max(a for a, _ in group) + 1
        words = vocabulary.select("word").filter(F.length("word").between(low, high))
        words = words.repartition(max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))), "word")
        parts.append(materialize(words.mapInArrow(run, "word string, n_near long, best_n long, best string"), "near-words"))
        held.destroy()
    if not parts:
        return spark.createDataFrame([], "word string, n_near long, best_n long, best string")
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    least = F.min(F.struct((-F.col("best_n")).alias("n"), F.col("best").alias("best"))).alias("least")
    return out.groupBy("word").agg(F.sum("n_near").alias("n_near"), least).select("word", "n_near", (-F.col("least.n")).alias("best_n"), F.col("least.best").alias("best"))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of (word, form), following forms to the last. Counts grow along forms, so there is no circle; each round
    doubles the way."""
    now = materialize(forms.select("word", F.col("form").alias("root")), "forms")
    while True:
        further = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        joined = materialize(now.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "forms")
        now = joined.select("word", "root")
        if joined.filter("moved").limit(1).count() == 0:
            return now


def variants(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per word that occurs LEAST_COUNT times or more: word, form, root, n, n_near, form_n.

    form is the neighbour (one code point inserted, deleted or replaced) of most occurrences, ties to the smaller in
    code-point order, if these are RATIO times the word's or more, else null; root is the last of the word's forms, or the
    word. Null and empty texts have no words; a null key counts as an empty one; repeated rows count each; very long
    texts count whole; an empty table gives an empty table. Only key and text are read, so other columns can't clash.
    """
    vocabulary = materialize(word_counts(docs, key, text).filter(F.col("n") >= LEAST_COUNT), "vocabulary")
    near = neighbours(vocabulary, SHARD_WORDS, BROADCAST_BYTES)
    formed = F.col("best_n") >= RATIO * F.col("n")
    known = materialize(vocabulary.join(near, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(formed, F.col("best")).alias("form"), F.when(formed, F.col("best_n")).alias("form_n")), "word-forms")
    last = roots(known.filter("form IS NOT NULL"))
    return known.join(last, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
