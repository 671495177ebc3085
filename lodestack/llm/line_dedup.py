"""Operator 1: dropping lines that many documents share. Built-in functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestack.runtime import materialize

MIN_CHARS, MIN_DOCUMENTS = 40, 5
_SPACE = " \t\n\x0b\x0c\r"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def line_key(line: Column) -> Column:
    return F.translate(F.btrim(line, F.lit(_SPACE)), _UPPER, _LOWER)


def line_hash(key: Column) -> Column:
    """128 bits of a key."""
    return F.struct(F.xxhash64(key).alias("a"), F.xxhash64(F.lit(1), key).alias("b"))


def shared_lines(docs: DataFrame, key: str = "doc_id", text: str = "text", min_chars: int = MIN_CHARS, min_documents: int = MIN_DOCUMENTS) -> DataFrame:
    """Per document that loses lines: key and ``dropped``, the array of their positions from 0.

    Lines are exploded as (hash, key, position), counted by distinct key per hash with partial sums on both
    levels, and the hashes over the threshold are joined back; a hash that a third of all documents share is
    split by adaptive skew handling. Texts are not shuffled.
    """
    lines = docs.select(docs[key].alias("key"), F.posexplode_outer(F.split(F.coalesce(docs[text], F.lit("")), "\n", -1)).alias("at", "line"))
    lines = lines.filter(F.length("line") >= min_chars).select("key", "at", line_key(F.col("line")).alias("line")).filter(F.length("line") >= min_chars)
    hashed = materialize(lines.select("key", "at", line_hash(F.col("line")).alias("h")).select("key", "at", "h.a", "h.b"), "line-hashes")
    counted = hashed.groupBy("a", "b").agg(F.count_distinct("key").alias("n"), F.max("key").alias("keeper"))
    # Written first: an aggregate right below the join would keep adaptive execution from splitting a hot hash.
    shared = materialize(counted.filter(F.col("n") >= min_documents).select("a", "b", "keeper"), "shared-lines")
    lost = hashed.join(shared, ["a", "b"]).filter(F.col("key") != F.col("keeper"))
    # Repeated rows of a document give a position more than once; a set bounds the array by the document's lines.
    return lost.groupBy("key").agg(F.collect_set("at").alias("dropped")).withColumnRenamed("key", key)


def drop_shared_lines(docs: DataFrame, key: str = "doc_id", text: str = "text", min_chars: int = MIN_CHARS, min_documents: int = MIN_DOCUMENTS) -> DataFrame:
    """docs' columns, text without its shared lines, and n_lines, n_dropped added.

    A line is shared if its key (stripped of white space, A-Z lowered) has min_chars code points or more and
    stands in min_documents or more distinct documents; it stays only in the largest key that holds it. Null
    and empty texts are one empty line; null keys count as no document and lose nothing; repeated rows of one
    key are one document and get the same result each; an empty table gives an empty table. Columns named
    n_lines or n_dropped are replaced.
    """
    own = [c for c in docs.columns if c not in ("n_lines", "n_dropped")]
    docs = docs.select(*[docs[c] for c in own])
    lost = shared_lines(docs, key, text, min_chars, min_documents).select(F.col(key).alias("_key"), F.col("dropped").alias("_dropped"))
    joined = docs.join(lost, docs[key] == lost["_key"], "left")
    lines = F.split(F.coalesce(docs[text], F.lit("")), "\n", -1)

    def left(each: Column) -> Column:
        """The lines whose positions aren't dropped, by a hash set of positions."""
        return F.array_join(F.transform(F.array_except(F.sequence(F.lit(0), F.size(each) - 1), "_dropped"), lambda i: F.get(each, i)), "\n")

    # The outer lambda splits the text once; named inside the inner one, the split would run for every line.
    reassembled = F.element_at(F.transform(F.array(lines), left), 1)
    kept = F.when(F.col("_dropped").isNull(), F.coalesce(docs[text], F.lit(""))).otherwise(reassembled)
    return joined.select(*[(kept.alias(c) if c == text else docs[c]) for c in own], F.size(lines).cast("long").alias("n_lines"), F.coalesce(F.size("_dropped"), F.lit(0)).cast("long").alias("n_dropped"))
