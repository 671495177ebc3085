"""Near copies for the pipeline's near-dedup stage.

Two texts are linked if their sets of 5-word shingles have a Jaccard similarity of 0.8 or more, found by operator 12's
exact join, or if operator 10 links them (3-word SimHash, 2 bits). SimHash alone can't reach such texts: they
differ in about ten bits, and keys that are exact for that radius would have too few bits to tell texts apart.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestack.llm import ngram_join, simhash
from lodestack.runtime import materialize


def _simhash_links(rows: DataFrame) -> DataFrame:
    """Edges (a, b) between sets by operator 10's links of their fingerprints."""
    prints = materialize(rows.select("fp", "sid").distinct(), "near-prints")
    heads = materialize(prints.groupBy("fp").agg(F.min("sid").alias("head")), "near-heads")
    same = prints.join(heads, "fp").filter(F.col("sid") != F.col("head")).select(F.col("head").alias("a"), F.col("sid").alias("b"))
    close = simhash.pivot_links(heads.select("fp"))
    close = close.join(heads.select(F.col("fp").alias("a"), F.col("head").alias("x")), "a").join(heads.select(F.col("fp").alias("b"), F.col("head").alias("y")), "b")
    return same.union(close.select("x", "y"))


def near_copies(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row of docs: key and component_id, the smallest key reachable over links.

    Texts of equal sets (exact copies, all texts without words) collapse before the search. A null key is never a
    component_id unless its component has no other key; the rows of a repeated key are judged each by its own text;
    repeated rows stay, each with the same result; very long texts count whole; an empty table gives an empty table.
    Only key (of any type that has an order) and text are read, so other columns can't clash.
    """
    rows = ngram_join.prefixes(docs, key, text, prints=True)
    known = ngram_join.classes(rows, _simhash_links(rows).union(ngram_join.links(rows)))
    return rows.select("key", "sid").join(known, "sid").select(F.col("key").alias(key), "component_id")
