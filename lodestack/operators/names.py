"""Name channels and application-name scores."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestack.functions.text import fold, unquoted
from lodestack.operators.filters import SearchRequest, is_path_query

LITERAL_LIMIT = 100


def literal_names(found: DataFrame, request: SearchRequest, limit: int = LITERAL_LIMIT) -> DataFrame:
    """Literal matches of the query, best first, with their position: found is filtered files joined with sources.

    A path query is looked for in names and relative paths; three characters or more in names; fewer only at
    the start of names, in name order. Both sides are folded to lower case by full Unicode rules.
    """
    literal = unquoted(request.query.strip()[:512]).lower()
    name = F.lower("name")
    first = [F.when(name == literal, 0).otherwise(1), F.desc("mtime"), F.col("file_id")]
    if is_path_query(request.query):
        hits = found.filter(F.contains(name, F.lit(literal)) | F.contains(F.lower("relative_path"), F.lit(literal)))
    elif len(literal) >= 3:
        hits = found.filter(F.contains(name, F.lit(literal)))
    else:
        hits = found.filter(F.startswith(name, F.lit(literal)))
        first = [name, F.col("file_id")]
    return ranked(hits.orderBy(*first).limit(limit), first)


def ranked(rows: DataFrame, order: list) -> DataFrame:
    """rows with ``position`` from 0 in the given order. Meant for lists that a limit has made short."""
    return rows.withColumn("position", (F.row_number().over(Window.orderBy(*order)) - 1).cast("long"))


def normalized(name: Column) -> Column:
    """Letters and digits of a name, folded, in single spaces."""
    return F.btrim(F.regexp_replace(fold(name), r"[^\p{L}\p{N}]+", " "))


def _normal(text: str) -> str:
    text = unicodedata.normalize("NFKD", text)
    text = "".join(c for c in text if not unicodedata.combining(c)).casefold()
    return " ".join("".join(c if unicodedata.category(c)[0] in "LN" else " " for c in text).split())


def app_query(query: str) -> str:
    return _normal(query)


def _abbreviates(needle: str, tokens: list[str]) -> bool:
    """needle is put together from beginnings of the first two or more tokens, in order and leaving none out."""
    reach = {0}
    for used, token in enumerate(tokens[:16], 1):
        ahead = set()
        for at in reach:
            n = 0
            while n < len(token) and at + n < len(needle) and token[n] == needle[at + n]:
                n += 1
                ahead.add(at + n)
        if used >= 2 and len(needle) in ahead:
            return True
        reach = ahead
    return False


def _gaps(needle: str, compact: str) -> int | None:
    at = 0
    for c in needle:
        at = compact.find(c, at) + 1
        if not at:
            return None
    return at - len(needle)


def app_score(names: DataFrame, query: str, name: str = "name") -> DataFrame:
    """names with ``score`` for an application query; rows that don't match are left out.

    The steps that built-in functions express are one chain of conditions. Abbreviations and scattered letters,
    which need a search along the name, run in an Arrow batch function on the few names that got past the chain.
    """
    q = app_query(query)
    needle, asked = q.replace(" ", ""), q.split(" ")
    if not q:
        return names.limit(0).withColumn("score", F.lit(0).cast("int"))
    folded = normalized(F.col(name))
    compact = F.replace(folded, F.lit(" "), F.lit(""))
    humps = F.regexp_replace(F.regexp_replace(name, "([a-z0-9])([A-Z])", "$1 $2"), "([A-Z])([A-Z][a-z])", "$1 $2")
    tokens = F.split(normalized(humps), " ")
    rows = names.withColumns({"_folded": folded, "_compact": compact, "_tokens": tokens}).filter(F.col("_folded") != "")
    f, c, t = F.col("_folded"), F.col("_compact"), F.col("_tokens")
    chain = F.when(f == q, 1000).when(c == needle, 980)
    if len(asked) == 1:
        chain = chain.when(F.array_contains(t, q), 920)
    chain = chain.when(F.startswith(f, F.lit(q)), F.lit(900) - F.least(F.length(f) - len(q), F.lit(30)))
    if len(asked) > 1:  # each word begins a later token than the one before
        chain = chain.when(F.concat(F.lit(" "), F.array_join(t, " ")).rlike(".*".join(f" {w}[^ ]*" for w in asked)), 860)
    if len(needle) >= 2:
        chain = chain.when(F.exists(t, lambda x: F.startswith(x, F.lit(needle))), 820)
        chain = chain.when((F.size(t) > 1) & (F.array_join(F.transform(t, lambda x: F.substring(x, 1, 1)), "") == needle), 850)

    @F.pandas_udf("int")
    def scattered(compact: pd.Series, tokens: pd.Series) -> pd.Series:
        out = []
        for c, t in zip(compact, tokens, strict=True):
            score = None
            if len(t) > 1 and len(needle) >= 2 and _abbreviates(needle, list(t)):
                score = 800 + min(len(needle), 30)
            elif len(needle) >= 3 and c[:1] == needle[0]:
                gaps = _gaps(needle, c)
                if gaps is not None and gaps <= 3 and len(needle) / (len(needle) + gaps) >= 0.65:
                    score = 500 - 20 * gaps
            out.append(score)
        return pd.Series(out, dtype="Int32")

    judged = rows.withColumn("_score", chain.cast("int"))
    sure = judged.filter(F.col("_score").isNotNull())
    rest = judged.filter(F.col("_score").isNull() & F.startswith(c, F.lit(needle[0]))).withColumn("_score", scattered("_compact", "_tokens"))
    return sure.unionByName(rest.filter(F.col("_score").isNotNull())).withColumn("score", F.col("_score")).drop("_folded", "_compact", "_tokens", "_score")


def natural(name: Column) -> Column:
    """A key that sorts names without regard to case, and their numbers by value."""
    parts = F.regexp_extract_all(F.lower(name), F.lit("[0-9]+|[^0-9]+"), F.lit(0))
    return F.array_join(F.transform(parts, lambda x: F.when(x.rlike("^[0-9]"), F.lpad(F.regexp_replace(x, "^0+(?=.)", ""), 20, "0")).otherwise(x)), "")


def app_ranking(apps: DataFrame, query: str) -> DataFrame:
    """Applications that match: apps has (path, name, file_name, bundle_id, running).

    One copy per bundle id (else per path), a running one first, then the smallest path; the better of the
    name's score and the file name's less 10; by score, then name in natural order, then path.
    """
    copy = Window.partitionBy(F.coalesce("bundle_id", "path")).orderBy(F.desc("running"), "path")
    own = apps.withColumn("_n", F.row_number().over(copy)).filter("_n = 1").drop("_n")
    by_name = app_score(own, query)
    by_file = app_score(own, query, "file_name").withColumn("score", F.col("score") - 10)
    best = by_name.unionByName(by_file).groupBy("path", "name").agg(F.max("score").alias("score"))
    return best.orderBy(F.desc("score"), natural(F.col("name")), "path")


def result_identity(kind: Column, path: Column) -> Column:
    """application:path or document:path."""
    return F.concat_ws(":", kind, path)


def with_extras(apps: DataFrame, extras: DataFrame) -> DataFrame:
    """apps and the extras whose path isn't among them."""
    return apps.unionByName(extras.join(apps.select("path"), "path", "left_anti"))
