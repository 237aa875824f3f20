"""Labelled rows to learn from, and the held-out rule."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def held_out(id_column: str = "doc_id") -> Column:
    """Rows that no model learns from: crc32 of the id as text, mod 3, is 1. A null id is held out."""
    return F.coalesce(F.crc32(F.col(id_column).cast("string").cast("binary")) % 3 == 1, F.lit(True))


def sample_limit(rows: int, max_rows: int) -> int | None:
    """Bound of a signed 64-bit hash that takes about ``max_rows`` of ``rows``; None takes all."""
    if rows <= max_rows:
        return None
    return max_rows * (1 << 64) // rows - (1 << 63)


def training_rows(docs: DataFrame, labels: DataFrame, label: str, max_rows: int) -> DataFrame:
    """(text, y) of labelled documents that are not held out, about ``max_rows`` of them at most.

    Which ids are taken depends on a hash of the id alone, so every size of corpus gives an
    even sample. Rows with a null label are left out; an id with several labels has the largest, one with several
    texts the smallest of them, so there is one row for each id.
    """
    known = labels.where(F.col(label).isNotNull() & ~held_out()).groupBy("doc_id").agg(
        F.max(F.col(label).cast("int")).alias("y"))
    limit = sample_limit(known.count(), max_rows)

    def chosen() -> Column:
        return F.lit(True) if limit is None else F.xxhash64("doc_id", F.lit(17)) < limit

    # The labels of the sample are bounded by max_rows, so they go to the texts and not the texts to them.
    found = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).where(~held_out() & chosen()).join(
        F.broadcast(known.where(chosen())), "doc_id")
    return found.groupBy("doc_id", "y").agg(F.min("text").alias("text")).select("text", "y")
