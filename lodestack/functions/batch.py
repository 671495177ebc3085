"""Scalar functions that Spark lacks, as Arrow batch functions."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed values of the public FNV-1a hash.
FNV_START, FNV_PRIME = 14695981039346656037, 1099511628211
_MASK = (1 << 64) - 1


def fnv1a(text: str) -> int:
    h = FNV_START
    for b in text.encode():
        h = (h ^ b) * FNV_PRIME & _MASK
    return h


@F.pandas_udf(T.LongType())
def negative_id(path: pd.Series) -> pd.Series:
    """An id below zero that depends on the path alone, for rows that have none in the catalog."""
    return path.map(lambda p: None if p is None else (fnv1a(p) | 1 << 63) - (1 << 64)).astype("Int64")


@F.pandas_udf(T.StringType())
def composed(text: pd.Series) -> pd.Series:
    """Unicode normal form C."""
    return text.map(lambda t: None if t is None else unicodedata.normalize("NFC", t))
