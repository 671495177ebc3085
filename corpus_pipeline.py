"""Corpus preparation: documents through quality rules, line dedup, near-dedup, decontamination and BPE."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestack.llm import bpe_codec, decontaminate, line_dedup, near_copies, quality_rules
from lodestack.llm.tables import table
from lodestack.runtime import discard, importable, materialize

COLUMNS = {"doc_id": "long", "text": "string", "lang": "string", "source": "string", "n_chars": "long"}


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules or their host's verdict on them reject go.

    Null and empty texts have no words and go; a null source is a host of its own; a very long text is measured
    whole; repeated rows are judged each; an empty table stays empty. Columns beyond those of documents are left out
    by all stages, missing ones are null.
    """
    importable(spark)
    return quality_rules.apply_rules(_columns(docs)).filter("kept").select(*COLUMNS)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of 40 characters or more that five documents share go, but in the largest doc_id; n_chars is counted anew.

    Null texts become empty; rows without doc_id count as no document and lose nothing; repeated rows of a doc_id are
    one document; very long texts are split whole; an empty table stays empty.
    """
    kept = line_dedup.drop_shared_lines(_columns(docs))
    return kept.select("doc_id", "text", "lang", "source", F.length("text").cast("long").alias("n_chars"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group (5-word shingles of Jaccard similarity 0.8 by operator 12, or operator 10's links) one document stays, once.

    It is the one of smallest doc_id (rows without doc_id come last; of several texts of that doc_id the one of
    smallest hash). Rows are told apart by doc_id and text: texts of one doc_id that aren't alike stay, and of rows equal
    in both the one of least source, lang and n_chars stays. Texts without words are one group; very long texts
    count whole; an empty table stays empty.
    """
    importable(spark)
    named = _columns(docs).withColumn("_row", _row())
    key = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "_row")
    keep = near_copies.near_copies(named.select(key.alias("key"), "text"), "key").filter("key = component_id")
    keep = materialize(keep.select("key._row").distinct(), "near-keep")
    # One row of each (doc_id, text): these are in one place after the join, and texts aren't compared.
    first = Window.partitionBy("_row").orderBy("source", "lang", "n_chars")
    one = named.join(keep, "_row", "left_semi").withColumn("_n", F.row_number().over(first)).filter("_n = 1")
    return one.select(*COLUMNS)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that leak a benchmark item go.

    Rows are judged each by its own text, whatever their doc_id; null and empty texts leak nothing; very long texts
    are read whole; an empty table stays empty.
    """
    named = _columns(docs).withColumn("_row", _row())
    # Written first, so that the join is planned by the real number of leaks and texts stay where they are.
    leaks = materialize(decontaminate.contaminated(named, table(spark, sf_dir, "benchmark"), "_row").select("_row").distinct(), "leaks")
    return named.join(leaks, "_row", "left_anti").select(*COLUMNS)


def bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The columns of documents, the token ids and their number; null and empty texts have none. Every row stays.

    Repeated rows are coded each; very long texts are coded whole, in pieces of words; an empty table stays empty.
    """
    importable(spark)
    coded = bpe_codec.encode(_columns(docs))
    return coded.withColumn("n_tokens", F.size("ids").cast("long"))


def _columns(docs: DataFrame) -> DataFrame:
    return docs.select(*[docs[c] if c in docs.columns else F.lit(None).cast(kind).alias(c) for c, kind in COLUMNS.items()])


def _row() -> Column:
    """A row's own name: 128 bits of doc_id and text."""
    parts = F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.col("doc_id").isNull(), F.coalesce("text", F.lit(""))
    return F.struct(F.xxhash64(*parts).alias("a"), F.xxhash64(F.lit(1), *parts).alias("b"))


STAGES = [
    ("quality_rules", quality),
    ("line_dedup", lines),
    ("simhash_near_dedup", near_dedup),
    ("benchmark_decontamination", decontaminated),
    ("bpe_encoding", bpe),
]

#: Fingerprints, template windows and BPE have no SQL; tests compare run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STAGES applied to documents, each written to the shared folder and read by the next; a table goes once it is read."""
    docs, read = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
        if read is not None:
            discard(read)
        read = docs
    return STAGES[-1][1](spark, docs, sf_dir)
