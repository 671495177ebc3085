"""Literal search in names by postings of trigrams.

A row of the index holds the ids of one block of files whose names have one trigram, so a trigram that every name has
is many short rows. Written sorted by trigram, a query reads its own trigrams' rows and nothing else: they are
intersected block by block, and the names of the ids that are left are verified.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

GRAM, BLOCK = 3, 1 << 13
SORT = ["gram", "block"]


def grams(name: Column) -> Column:
    """The distinct trigrams of a name in lower case; none of a shorter one."""
    low = F.lower(name)
    n = F.length(low) - GRAM + 1
    return F.when(n < 1, F.array().cast("array<string>")).otherwise(F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.substring(low, i, F.lit(GRAM)))))


def postings(files: DataFrame, key: str = "file_id", name: str = "name") -> DataFrame:
    """(gram, block, ids): the index of files (key, name). Null and short names have no rows."""
    each = files.select(F.col(key).alias("id"), F.explode(grams(F.col(name))).alias("gram"))
    return _blocked(each.select("gram", F.floor(F.col("id") / BLOCK).alias("block"), "id"))


def _blocked(each: DataFrame) -> DataFrame:
    return each.groupBy("gram", "block").agg(F.sort_array(F.collect_set("id")).alias("ids"))


def refresh(index: DataFrame, gone: DataFrame, fresh: DataFrame, key: str = "file_id", name: str = "name") -> DataFrame:
    """The index after the files of gone (key) left and those of fresh (key, name) came or got another name.

    Only blocks that hold such files are built anew; the rows of others stay as they are.
    """
    left = gone.select(F.col(key).alias("id")).union(fresh.select(F.col(key).alias("id"))).distinct()
    touched = left.select(F.floor(F.col("id") / BLOCK).alias("block")).distinct()
    stay = index.join(touched, "block", "left_anti").select("gram", "block", "ids")
    old = index.join(touched, "block", "left_semi").select("gram", "block", F.explode("ids").alias("id")).join(left, "id", "left_anti").select("gram", "block", "id")
    new = fresh.select(F.col(key).alias("id"), F.explode(grams(F.col(name))).alias("gram")).select("gram", F.floor(F.col("id") / BLOCK).alias("block"), "id")
    return stay.union(_blocked(old.union(new)))


def query_grams(literal: str) -> list[str]:
    low = literal.lower()
    return list(dict.fromkeys(low[i : i + GRAM] for i in range(len(low) - GRAM + 1)))


def candidates(index: DataFrame, literal: str, key: str = "file_id") -> DataFrame:
    """The keys of files whose names have all trigrams of a literal of GRAM characters or more."""
    asked = query_grams(literal)
    met = index.filter(F.col("gram").isin(asked)).groupBy("block").agg(F.collect_list("ids").alias("lists")).filter(F.size("lists") == len(asked))
    both = F.aggregate(F.slice("lists", 2, len(asked)), F.element_at("lists", 1), F.array_intersect)
    return met.select(F.explode(both).alias(key))


def matching(found: DataFrame, index: DataFrame, literal: str, key: str = "file_id", name: str = "name") -> DataFrame:
    """The rows of found whose names contain the literal, letters in either case."""
    return found.join(candidates(index, literal, key), key, "left_semi").filter(F.contains(F.lower(name), F.lit(literal.lower())))
