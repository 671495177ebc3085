"""Reading the input tables and giving operators bounded pieces of Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from lodestack.runtime import plan_bytes

#: UTF-8 bytes of text that a Python worker handles at once; a longer text makes a piece of its own.
PIECE_BYTES = 1_000_000


#: A table read in fewer tasks than the cluster has cores is dealt out anew into parts of at least this size.
LEAST_PART = 1_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    parts = min(spark.sparkContext.defaultParallelism, plan_bytes(df) // LEAST_PART)
    if parts >= 4 and df._jdf.queryExecution().toRdd().getNumPartitions() < parts:  # one large file of one row group, say
        return df.repartition(parts)
    return df


def pieces(batch: pa.RecordBatch, text: str = "text") -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Runs of rows of batch with at most PIECE_BYTES of text, and their texts as UTF-8 (null: empty)."""
    first, held, texts = 0, 0, []
    column = batch.column(batch.schema.get_field_index(text)).cast(pa.binary())
    for i in range(len(column)):
        b = column[i].as_py() or b""
        if texts and held + len(b) > PIECE_BYTES:
            yield batch.slice(first, i - first), texts
            first, held, texts = i, 0, []
        held += len(b)
        texts.append(b)
    if texts:
        yield batch.slice(first), texts


def extended(schema: T.StructType, **columns: T.DataType) -> T.StructType:
    """A copy of schema with nullable columns added."""
    return T.StructType([*schema.fields, *[T.StructField(c, kind) for c, kind in columns.items()]])
