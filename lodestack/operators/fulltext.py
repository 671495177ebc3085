"""Inverted index and BM25 ranking."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestack.functions.packing import let
from lodestack.functions.text import Phrase, words
from lodestack.runtime import materialize, plan_bytes

K1, B, FLOOR = 1.2, 0.75, 1e-6
#: Bytes of a table's files whose rows one task indexes.
TASK_BYTES, MOST_TASKS = 4 << 20, 100_000


def postings(rows: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """(term, key, field, places, dl): places of a term in a row's field; dl is the row's length over all fields.

    Written sorted by term this is the index: a query reads the terms it asks for and nothing else. A row's postings are
    made within the row, so that no token is shuffled.
    """
    tokens = rows.select(key, *[words(F.col(c)).alias(f"_{c}") for c in columns])
    length = sum((F.size(f"_{c}") for c in columns), F.lit(0))
    fields = F.array(*[F.struct(F.lit(c).alias("field"), term_places(F.col(f"_{c}")).alias("terms")) for c in columns])
    each = tokens.select(key, length.alias("dl"), F.inline_outer(fields))
    # Outer: for an inner explode Catalyst adds a filter on the array's size that tokenises once more.
    placed = each.select(key, "dl", "field", F.inline_outer("terms")).filter(F.col("term").isNotNull())
    return placed.select("term", key, "field", "dl", "places")


def tasks(rows: DataFrame) -> int:
    """So many tasks that the postings of each task's rows are sorted in memory; the session's number if the size isn't known."""
    n = -(-plan_bytes(rows) // TASK_BYTES)
    return max(1, n) if n <= MOST_TASKS else int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def dealt(rows: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """postings() of rows dealt out to tasks of bounded size: only the rows themselves are shuffled."""
    return postings(rows.select(key, *columns).repartition(tasks(rows), key), key, columns)


def runs(items: Column, name: str, body: Callable[[Column], list[Column]]) -> Column:
    """Of an array of structs sorted by a field: for each of its values a struct of the value and body(its items)."""

    def cut(all_: Column) -> Column:
        at = F.filter(F.sequence(F.lit(1), F.size(all_)), lambda i: (i == 1) | (F.get(all_, i - 1)[name] != F.get(all_, i - 2)[name]))
        one = lambda i, to: F.struct(F.get(all_, i - 1)[name].alias(name), *body(F.slice(all_, i, to - i)))
        return let(at, lambda b: F.transform(b, lambda i, n: one(i, F.coalesce(F.get(b, n + 1), F.size(all_) + 1))))

    return let(items, lambda x: F.when(F.size(x) > 0, cut(x)))


def term_places(tokens: Column) -> Column:
    """(term, places) of each distinct token of an array; null without tokens."""
    return _gathered(F.transform(tokens, lambda t, at: F.struct(t.alias("term"), at.cast("int").alias("at"))))


def _gathered(placed: Column) -> Column:
    return runs(F.sort_array(placed), "term", lambda own: [F.transform(own, lambda x: x["at"]).alias("places")])


def index_stats(rows: DataFrame, columns: list[str]) -> DataFrame:
    """One row: number of rows and total length of the whole index, whatever a query filters."""
    length = sum((F.size(words(F.col(c))) for c in columns), F.lit(0))
    return rows.select(length.cast("long").alias("dl")).agg(F.count(F.lit(1)).alias("rows"), F.sum("dl").alias("length"))


def _wanted(phrases: list[Phrase], term: Column) -> Column:
    out = F.lit(False)
    for p in phrases:
        for i, t in enumerate(p.tokens):
            out = out | (F.startswith(term, F.lit(t)) if p.prefix and i == len(p.tokens) - 1 else term == t)
    return out


def asked(rows: DataFrame, key: str, column: str, phrases: list[Phrase]) -> tuple[DataFrame, DataFrame]:
    """postings() of a query's terms alone, and index_stats() of all rows: for one query without an index.

    Rows are read and tokenised once; what is written of each is its length and its places of these terms.
    """
    tokens = rows.select(key, words(F.col(column)).alias("toks"))
    placed = F.filter(F.transform("toks", lambda t, at: F.struct(t.alias("term"), at.cast("int").alias("at"))), lambda x: _wanted(phrases, x["term"]))
    held = materialize(tokens.select(key, F.size("toks").alias("dl"), _gathered(placed).alias("terms")), "asked")
    found = held.select(key, "dl", F.inline("terms")).select("term", key, F.lit(column).alias("field"), "dl", "places")
    return found, held.agg(F.count(F.lit(1)).alias("rows"), F.sum(F.col("dl").cast("long")).alias("length"))


def phrase_counts(index: DataFrame, key: str, phrases: list[Phrase], fields: list[str] | None = None) -> DataFrame:
    """(key, dl, tf0, tf1, ...): how often each phrase stands in a row; rows without any are left out.

    A phrase's tokens stand at consecutive places of one field: the places of each token, moved back by its
    position in the phrase, are intersected.
    """
    found = index.filter(_wanted(phrases, F.col("term")))
    if fields:
        found = found.filter(F.col("field").isin(*fields))
    slots = {}
    for n, p in enumerate(phrases):
        for i, t in enumerate(p.tokens):
            hit = F.startswith("term", F.lit(t)) if p.prefix and i == len(p.tokens) - 1 else F.col("term") == t
            moved = F.transform("places", _less(i))
            slots[f"s{n}_{i}"] = F.flatten(F.collect_list(F.when(hit, moved)))
    by_field = found.groupBy(key, "field", "dl").agg(*[c.alias(k) for k, c in slots.items()])
    counted = []
    for n, p in enumerate(phrases):
        both = F.col(f"s{n}_0")
        for i in range(1, len(p.tokens)):
            both = F.array_intersect(both, F.col(f"s{n}_{i}"))
        counted.append(F.sum(F.size(both)).alias(f"tf{n}"))
    totals = by_field.groupBy(key, "dl").agg(*counted)
    some = F.lit(False)
    for n in range(len(phrases)):
        some = some | (F.col(f"tf{n}") > 0)
    return totals.filter(some)


def _less(i: int):
    return lambda x: x - i


def bm25(index: DataFrame, stats: DataFrame, key: str, phrases: list[Phrase], fields: list[str] | None = None) -> DataFrame:
    """(key, relevance): negated BM25, so that lower is better. Document frequencies count all rows of the index."""
    counts = phrase_counts(index, key, phrases, fields)
    df = counts.agg(*[F.sum(F.when(F.col(f"tf{n}") > 0, 1).otherwise(0)).alias(f"df{n}") for n in range(len(phrases))])
    rows = counts.crossJoin(F.broadcast(stats)).crossJoin(F.broadcast(df))  # one row each
    average = F.col("length") / F.col("rows")
    total = F.lit(0.0)
    for n in range(len(phrases)):
        tf, d = F.col(f"tf{n}"), F.col(f"df{n}")
        idf = F.log((F.col("rows") - d + 0.5) / (d + 0.5))
        idf = F.when(idf <= 0, F.lit(FLOOR)).otherwise(idf)
        total = total + idf * (tf * (K1 + 1)) / (tf + K1 * (1 - B + B * F.col("dl") / average))
    return rows.select(key, (-total).alias("relevance"))


def representatives(scored: DataFrame, passages: DataFrame) -> DataFrame:
    """The best passage of each content: (content_id, passage_id, relevance, text)."""
    joined = scored.join(passages.select("passage_id", "content_id", "ordinal", "text"), "passage_id")
    best = Window.partitionBy("content_id").orderBy("relevance", "passage_id")
    return joined.withColumn("n", F.row_number().over(best)).filter("n = 1").drop("n")


def refresh(index: DataFrame, key: str, changed: DataFrame, fresh: DataFrame) -> DataFrame:
    """The index after some rows changed or went: their old postings leave, fresh ones enter.

    A dealt() index already lies by its rows' keys, so its postings aren't shuffled or sorted for that.
    """
    return index.join(changed.select(key).hint("shuffle_hash"), key, "left_anti").unionByName(fresh)


def highlight(text: Column, query: str, before: str = "[", after: str = "]") -> Column:
    """The first 1,300 characters with the query's longer terms marked, letters in either case."""
    import re

    terms = [t for t in re.split(r"[^\w]+", query) if len(t) > 2][:12]
    shown = F.substring(text, 1, 1300)
    if not terms:
        return shown
    pattern = "(?iu)(" + "|".join(map(re.escape, sorted(terms, key=len, reverse=True))) + ")"
    return F.regexp_replace(shown, pattern, f"{re.escape(before)}$1{re.escape(after)}")
