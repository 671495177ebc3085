"""Best matches of words without scoring every posting.

Rows are put into bins of about BIN rows of like length. An index row holds one term's postings of one bin, with its greatest
count and its least length, which bound the score of every row of the bin. A query of words first reads these
bounds only; it scores the bins of highest bounds, takes the score of its k-th result as threshold, and then reads the
postings of the bins whose bounds reach it. What is left out can't be among the first k, so results are exact.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestack.functions.text import Phrase, words
from lodestack.operators.fulltext import B, FLOOR, K1, runs, tasks

BIN = 256
#: Bins of a length class are told apart by hash; classes are eighths of a doubling.
CLASSES = 8
#: Bins of longer rows than this have fewer of them, so that a bin's words fit in one row.
WORDS = 512
SORT = ["term", "bin"]
#: Bins are named in a filter up to this number, so that files are pruned by them; more are met by a join.
NAMED = 64
_SLACK = 1e-8


def bins(rows: DataFrame, key: str, column: str, size: int = BIN) -> DataFrame:
    """(key, dl, bin, toks): rows with their words and bins of about ``size`` rows of like length (fewer of very long ones)."""
    tokens = rows.select(key, words(F.col(column)).alias("toks")).withColumn("dl", F.size("toks"))
    tokens = tokens.withColumn("class", F.floor(CLASSES * F.log2(F.col("dl") + 1)).cast("int"))
    share = F.greatest(F.count(F.lit(1)) / size, F.sum("dl") / (size * WORDS))
    parts = tokens.groupBy("class").agg(F.ceil(share).alias("parts"))  # a row for each length class
    return tokens.join(F.broadcast(parts), "class").select(key, "dl", F.concat_ws("-", F.lpad(F.col("class").cast("string"), 4, "0"), F.pmod(F.xxhash64(key), "parts")).alias("bin"), "toks")


def index(rows: DataFrame, key: str, column: str, size: int = BIN) -> DataFrame:
    """(term, bin, n, top_tf, least_dl, entries): entries are (key, dl, tf), sorted by key.

    Only whole bins are shuffled, as few rows with their words; the rows of a bin's terms are made within it.
    """
    placed = bins(rows, key, column, size).select(F.col(key).alias("key"), "dl", "bin", F.array_join("toks", " ").alias("words")).filter(F.col("dl") > 0)
    held = placed.repartition(tasks(rows), "bin").groupBy("bin").agg(F.collect_list(F.struct("key", "dl", "words")).alias("rows"))
    counts = lambda words: runs(F.sort_array(F.transform(F.split(words, " "), lambda t: F.struct(t.alias("term")))), "term", lambda own: [F.size(own).alias("tf")])
    each = F.flatten(F.transform("rows", lambda r: F.transform(counts(r["words"]), lambda t: F.struct(t["term"].alias("term"), r["key"].alias("key"), r["dl"].alias("dl"), t["tf"].alias("tf")))))
    entries = lambda own: F.transform(own, lambda x: F.struct(x["key"].alias("key"), x["dl"].alias("dl"), x["tf"].alias("tf")))
    most = lambda own, name, best: best(F.transform(own, lambda x: x[name]))
    made = runs(F.sort_array(each), "term", lambda own: [F.size(own).cast("long").alias("n"), most(own, "tf", F.array_max).alias("top_tf"), most(own, "dl", F.array_min).alias("least_dl"), entries(own).alias("entries")])
    # Outer: for an inner explode Catalyst adds a filter on the array's size that makes it once more.
    return held.select("bin", F.inline_outer(made)).filter(F.col("term").isNotNull()).select("term", "bin", "n", "top_tf", "least_dl", "entries")


def plain_words(phrases: list[Phrase]) -> list[str] | None:
    """The words of a query of single whole words, else None: phrases and prefixes need their places to be counted."""
    if any(p.prefix or len(p.tokens) != 1 for p in phrases):
        return None
    return [p.tokens[0] for p in phrases]


def _term_score(tf: Column, dl: Column, average: Column) -> Column:
    return tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl / average))


class Ranking:
    """One query of words over an index; every part is a plan."""

    def __init__(self, table: DataFrame, stats: DataFrame, asked: list[str], key: str):
        self.table, self.key = table, key
        weight = F.create_map(*[x for w in dict.fromkeys(asked) for x in (F.lit(w), F.lit(float(asked.count(w))))])
        own = table.filter(F.col("term").isin(asked))
        # Frequencies count all rows of the index, so they come from the bounds alone.
        df = own.groupBy("term").agg(F.sum("n").alias("df")).crossJoin(F.broadcast(stats))  # a row for each word asked for
        idf = F.log((F.col("rows") - F.col("df") + 0.5) / (F.col("df") + 0.5))
        self.weights = df.select("term", (F.when(idf <= 0, F.lit(FLOOR)).otherwise(idf) * F.element_at(weight, F.col("term"))).alias("idf"), (F.col("length") / F.col("rows")).alias("average"))
        self.own = own

    def bounds(self) -> DataFrame:
        """(bin, bound, rows): no row of a bin scores more than its bound; the entries aren't read."""
        each = self.own.select("term", "bin", "n", "top_tf", "least_dl").join(F.broadcast(self.weights), "term")
        return each.groupBy("bin").agg(F.sum(F.col("idf") * _term_score(F.col("top_tf"), F.col("least_dl"), F.col("average"))).alias("bound"), F.max("n").alias("rows"))

    def scored(self, some: DataFrame | list[str] | None = None) -> DataFrame:
        """(key, relevance) of the rows of some bins, or of all."""
        rows = self.own.select("term", "bin", "entries")
        if isinstance(some, list):
            rows = rows.filter(F.col("bin").isin(some))
        elif some is not None:
            rows = rows.join(some.select("bin"), "bin", "left_semi")
        each = rows.join(F.broadcast(self.weights), "term").select("idf", "average", F.inline("entries"))
        return each.groupBy("key").agg((-F.sum(F.col("idf") * _term_score(F.col("tf"), F.col("dl"), F.col("average")))).alias("relevance")).withColumnRenamed("key", self.key)


def best(table: DataFrame, stats: DataFrame, asked: list[str], key: str, k: int, finish: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """finish(scored)'s first k rows, which are those of finish over all scored rows.

    finish takes (key, relevance) and returns rows that have relevance, in its order and at most k: the filters, joins and
    groupings of a channel. It must be that a row's score is that of one of its keys, and that less keys make no other row better.
    """
    ranking = Ranking(table, stats, asked, key)
    bounds = ranking.bounds()
    # A bin is one row. The best ones are scored to find the threshold: first as many as can hold k rows, then more.
    for taken in (2, 32):
        first = [r["bin"] for r in bounds.orderBy(F.desc("bound"), "bin").limit(max(1, -(-taken * k // BIN))).collect()]
        edge = finish(ranking.scored(first)).agg(F.count(F.lit(1)).alias("n"), F.max("relevance").alias("last")).first() if first else {"n": 0}
        if edge["n"] == k:
            break
    else:
        return finish(ranking.scored())
    reach = bounds.filter(F.col("bound") >= -edge["last"] - _SLACK)
    names = [r["bin"] for r in reach.select("bin").limit(NAMED + 1).collect()]
    return finish(ranking.scored(names if len(names) <= NAMED else reach))


def read_share(table: DataFrame, stats: DataFrame, asked: list[str], key: str, threshold: float) -> DataFrame:
    """One row: postings of the words, and those in bins whose bounds reach a threshold."""
    ranking = Ranking(table, stats, asked, key)
    reach = ranking.bounds().filter(F.col("bound") >= threshold - _SLACK).select("bin", F.lit(True).alias("hit"))
    return ranking.own.select("bin", "n").join(reach, "bin", "left").agg(F.sum("n").alias("postings"), F.sum(F.when(F.col("hit"), F.col("n"))).alias("read"))
