"""Operator 11: importance resampling towards a target distribution by hashed n-grams.

Features are runs of one to three consecutive words. A piece of text maps its distinct words to integer ids, writes
n-grams as tuples of ids (the number of its first words' tuple, and a word's id), and takes the CRC of each distinct
tuple's bytes once: they are the bytes of its first words, a space and a word, so the CRC goes on from theirs. Counts
and gains of distinct tuples are joined back to the places where they stand.

Ids and tuples don't leave their piece: the features of a bucket are a sum over pieces, so a task sends at most one
row a bucket, however much it reads, and texts are never shuffled. The gains of all buckets are an array of
``buckets`` numbers, which each task of the second pass gets. Ranks come from a sort by ranges and the sizes of these.
"""

from __future__ import annotations

import math
import re
from collections import defaultdict
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestack.llm.tables import pieces
from lodestack.runtime import discard, materialize

BUCKETS, LONGEST, LEAST_WORDS, SHARE, SEED = 10_000, 3, 20, (5, 100), 42
_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")  # of lower-cased UTF-8


def words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """Words per text, the ids of all words in order, and the dictionary: the word of each id."""
    found = [_WORD.findall(t.lower()) for t in texts]  # bytes: A-Z only
    sizes = np.fromiter(map(len, found), np.int64, len(found))
    known: dict[bytes, int] = defaultdict()
    known.default_factory = known.__len__
    return sizes, np.fromiter((known[w] for ws in found for w in ws), np.int64, int(sizes.sum())), list(known)


def tuples(sizes: np.ndarray, ids: np.ndarray, dictionary: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For runs of 1 to LONGEST words: the CRCs of the distinct tuples, the tuple of each run and the text of each run."""
    text = np.repeat(np.arange(len(sizes)), sizes)
    spaced = [b" " + w for w in dictionary]
    crcs, of, at = np.fromiter(map(crc32, dictionary), np.int64, len(dictionary)), ids, np.arange(len(ids))
    yield crcs, of, text
    for n in range(2, LONGEST + 1):
        longer = at + n - 1 < len(ids)
        longer[longer] = text[at[longer]] == text[at[longer] + n - 1]
        at, of = at[longer], of[longer]
        distinct, of = np.unique(of * len(dictionary) + ids[at + n - 1], return_inverse=True) if len(at) else (at, at)
        first, last = np.divmod(distinct, max(1, len(dictionary)))
        crcs = np.fromiter(map(crc32, [spaced[w] for w in last.tolist()], crcs[first].tolist()), np.int64, len(distinct))
        yield crcs, of, text[at]


def bucket_counts(docs: DataFrame, text: str = "text", buckets: int = BUCKETS) -> DataFrame:
    """(bucket, n): the features of all texts by bucket, repeats included."""
    docs = docs.select(docs[text].alias("text"))

    def run(batches):
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for _, texts in pieces(batch):
                for crcs, of, _ in tuples(*words(texts)):
                    total += np.bincount(crcs % buckets, np.bincount(of, minlength=len(crcs)), buckets).astype(np.int64)
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen.astype(np.int32)), pa.array(total[seen])], names=["bucket", "n"])

    return docs.mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(raw: dict[int, int], target: dict[int, int], buckets: int = BUCKETS) -> list[int]:
    """Per bucket floor(1000 ln) of the smoothed target share over the smoothed raw share."""
    s, t = float(sum(raw.values())), float(sum(target.values()))
    return [math.floor(1000 * math.log((target.get(b, 0) + 1.0) * (s + buckets) / ((raw.get(b, 0) + 1.0) * (t + buckets)))) for b in range(buckets)]


def weights(docs: DataFrame, gain: list[int], key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: key, n_words, n_features and weight, the sum of its features' gains."""
    docs, of_bucket = docs.select(docs[key], docs[text].alias("_text")), np.array(gain, np.int64)
    schema = T.StructType([docs.schema[key], *[T.StructField(c, T.LongType()) for c in ("n_words", "n_features", "weight")]])

    def run(batches):
        for batch in batches:
            for rows, texts in pieces(batch, "_text"):
                sizes, ids, dictionary = words(texts)
                n, weight = np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64)
                for crcs, of, at in tuples(sizes, ids, dictionary):
                    n += np.bincount(at, minlength=len(texts))
                    weight += np.bincount(at, of_bucket[crcs % len(of_bucket)][of], len(texts)).astype(np.int64)  # whole numbers below 2 ** 53
                yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(sizes), pa.array(n), pa.array(weight)], names=schema.names)

    return docs.mapInArrow(run, schema)


def resample(docs: DataFrame, target: DataFrame, key: str = "doc_id", text: str = "text", target_text: str = "text", buckets: int = BUCKETS, least_words: int = LEAST_WORDS, share: tuple[int, int] = SHARE, seed: int = SEED) -> DataFrame:
    """Per row of docs: key, n_words, n_features, weight, score and rank.

    score is weight plus Gumbel noise from the key's hash, so the highest scores are a sample without replacement in
    proportion to the exponentials of the weights. Of the N rows with least_words words or more, share[0] * N // share[1] of
    highest score are drawn and ranked from 1, ties to the smaller key, a null key last; others have a null rank.

    Null and empty texts have no features and weigh 0; an empty target leaves its smoothing; repeated rows count and
    are ranked each, in any order among equals; very long texts count whole (a piece of their own); an empty table gives
    an empty table. Only key and text are read, so other columns can't clash.
    """
    raw, aim = ({r["bucket"]: r["n"] for r in bucket_counts(of, column, buckets).collect()} for of, column in ((docs, text), (target, target_text)))
    weighed = materialize(weights(docs, gains(raw, aim, buckets), key, text), "resample-weights")
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(key).cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    score = F.col("weight") + F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))
    fit = F.col("n_words") >= least_words
    scored = weighed.withColumns({"score": score, "_fit": fit})
    order = [F.desc("_fit"), F.desc("score"), F.asc_nulls_last(key)]
    place = F.monotonically_increasing_id()  # the part's number and the row's place in it
    ordered = materialize(scored.repartitionByRange(*order).sortWithinPartitions(*order).withColumns({"_part": F.shiftright(place, 33), "_at": place.bitwiseAND((1 << 33) - 1)}), "resample-order")
    discard(weighed)
    parts = ordered.groupBy("_part").agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    parts = parts.select("_part", F.coalesce(before, F.lit(0)).alias("_before"))  # one row for each part
    drawn = share[0] * ordered.filter("_fit").count() // share[1]
    rank = F.col("_before") + F.col("_at") + 1
    return ordered.join(F.broadcast(parts), "_part").select(key, "n_words", "n_features", "weight", "score", F.when(F.col("_fit") & (rank <= drawn), rank).alias("rank"))
