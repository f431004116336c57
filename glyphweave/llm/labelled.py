"""Bounded samples of labelled rows for fitting models."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: At most so many labelled rows are used to fit a classifier; scores cover all rows.
SAMPLE_ROWS = 12_000


def fold_of(column: str, folds: int) -> Column:
    """crc32 of an id's text, modulo `folds`; null for a null id."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % folds


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, usable: Column, rows: int = SAMPLE_ROWS) -> DataFrame:
    """(text, label) of at most `rows` labelled documents, chosen by a hash of doc_id.

    `usable` is a condition on doc_id. Null ids and labels are left out; of several
    labels of one document the larger counts; equal texts count once.
    """
    known = (
        labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull())
        .groupBy(F.col("doc_id").cast("long").alias("doc_id"))
        .agg(F.max(label).cast("int").alias("label"))
        .where(usable)
    )
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return texts.join(F.broadcast(chosen), "doc_id").groupBy(F.xxhash64("text"), F.length("text")).agg(
        F.first("text").alias("text"), F.max("label").alias("label")
    ).select("text", "label")
