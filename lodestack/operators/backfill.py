"""Vectors for passages that lack one, published only for what is still owned at the time."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from lodestack.operators import vectors as v
from lodestack.operators.health import unembedded
from lodestack.runtime import discard, materialize

ATTEMPTS = 8


class Conflict(RuntimeError):
    """Others published so often that no attempt got through."""


def still_wanted(made: DataFrame, passages: DataFrame, held: DataFrame, files: DataFrame, model: str) -> DataFrame:
    """The made vectors (passage_id, model, packed) whose passage exists, is owned and still lacks a vector of the model."""
    wanted = unembedded(passages, v.for_model(held, model), files).select("passage_id")
    return made.join(wanted, "passage_id", "left_semi")


def fenced_backfill(snapshots, model: str = v.MODEL, make: Callable[[DataFrame, DataFrame, DataFrame, str], DataFrame] = v.backfill, attempts: int = ATTEMPTS) -> int:
    """Publish vectors for owned passages that lack one; returns the version.

    snapshots holds the tables files, passages and packed (passage_id, model, packed). Vectors are made once, from the
    version that is current at the start, and written. The fence is at the end: ownership is read anew from the version
    that is current then, and the publication names it as its base, so that it fails if another one came between; then the
    check, not the work, is done again. A file that was revoked while vectors were made gets none.
    """
    start = snapshots.current()
    tables = [snapshots.table(n, start) for n in ("passages", "packed", "files")]
    made = materialize(make(*tables, model), "backfill")
    try:
        for _ in range(attempts):
            now = snapshots.current()
            passages, held, files = (snapshots.table(n, now) for n in ("passages", "packed", "files"))
            try:
                return snapshots.publish({"packed": held.unionByName(still_wanted(made, passages, held, files, model))}, base=now)
            except RuntimeError:  # published by another writer meanwhile
                continue
        raise Conflict(f"other versions were published during {attempts} attempts")
    finally:
        discard(made)
