"""Exact length histogram: what every context limit keeps, from one row per encoded length."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from glyphweave.llm.encoding import encoder, vocabulary
from glyphweave.llm.workspace import written

#: Lengths in one block of the two-level suffix sums.
BLOCK = 1024


def encoded_lengths(docs: DataFrame, path: str = "") -> DataFrame:
    """(n_tokens, documents) of each batch; a null or empty text has no tokens."""
    path = path or vocabulary()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for batch in batches:
            lengths, documents = np.unique(enc.lengths(batch.column(0)), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(lengths), pa.array(documents.astype(np.int64))], names=["n_tokens", "documents"])

    return docs.select(F.col("text").cast("string").alias("text")).mapInArrow(count, "n_tokens long, documents long")


def length_histogram(docs: DataFrame, path: str = "") -> DataFrame:
    """documents of each encoded length, written, so that texts are encoded once however often it is read.

    Batches are counted before anything is shuffled.
    """
    return written(encoded_lengths(docs, path).groupBy("n_tokens").agg(F.sum("documents").alias("documents")), "token-histogram")


def limit_report(histogram: DataFrame) -> DataFrame:
    """For each occurring length, taken as a context limit, exact totals by suffix sums.

    Returns context_limit, documents (of just that length), documents_longer,
    tokens_longer (in documents over the limit), tokens_kept (all texts truncated to
    the limit), tokens_total, share_within (of documents at most that long). Between
    two occurring lengths tokens_kept is linear, so these rows answer any limit, see
    `kept_at`. An empty table gives no rows. Suffix sums run within blocks of BLOCK
    lengths and over the blocks' totals, so no window holds all lengths: a task gets
    at most BLOCK rows of a block, and one a row for each block.
    """
    rows = histogram.select("n_tokens", "documents", (F.col("n_tokens") * F.col("documents")).alias("tokens"), F.floor(F.col("n_tokens") / BLOCK).alias("block"))
    later = Window.partitionBy("block").orderBy(F.desc("n_tokens")).rowsBetween(Window.unboundedPreceding, -1)
    blocks = rows.groupBy("block").agg(F.sum("documents").alias("block_docs"), F.sum("tokens").alias("block_tokens"))
    beyond = Window.orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    above = blocks.select(
        "block",
        F.coalesce(F.sum("block_docs").over(beyond), F.lit(0)).alias("above_docs"),
        F.coalesce(F.sum("block_tokens").over(beyond), F.lit(0)).alias("above_tokens"),
        F.sum("block_docs").over(every).alias("all_docs"),
        F.sum("block_tokens").over(every).alias("all_tokens"),
    )
    summed = rows.select(
        "*",
        F.coalesce(F.sum("documents").over(later), F.lit(0)).alias("in_docs"),
        F.coalesce(F.sum("tokens").over(later), F.lit(0)).alias("in_tokens"),
    ).join(above, "block")
    longer, tokens = F.col("in_docs") + F.col("above_docs"), F.col("in_tokens") + F.col("above_tokens")
    return summed.select(
        F.col("n_tokens").alias("context_limit"),
        "documents",
        longer.alias("documents_longer"),
        tokens.alias("tokens_longer"),
        (F.col("all_tokens") - tokens + longer * F.col("n_tokens")).alias("tokens_kept"),
        F.col("all_tokens").alias("tokens_total"),
        ((F.col("all_docs") - longer) / F.col("all_docs")).alias("share_within"),
    )


def kept_at(report: DataFrame, limits: list[int]) -> DataFrame:
    """tokens_kept for arbitrary limits: the nearest row at or below, plus its longer documents' extra tokens."""
    asked = report.sparkSession.createDataFrame([(int(x),) for x in limits], "asked long")
    below = report.join(F.broadcast(asked), F.col("context_limit") <= F.col("asked"))
    last = below.groupBy("asked").agg(F.max_by(F.struct("context_limit", "tokens_kept", "documents_longer"), "context_limit").alias("r"))
    first = report.agg((F.max(F.col("documents") + F.col("documents_longer"))).alias("all_docs"))
    return asked.join(last, "asked", "left").crossJoin(F.broadcast(first)).select(
        F.col("asked").alias("context_limit"),
        F.coalesce(
            F.col("r.tokens_kept") + F.col("r.documents_longer") * (F.col("asked") - F.col("r.context_limit")),
            F.coalesce(F.col("all_docs"), F.lit(0)) * F.col("asked"),
        ).alias("tokens_kept"),
    )


def quantiles(report: DataFrame, shares: list[float]) -> DataFrame:
    """Exact nearest-rank length quantiles: the smallest length within which a share of documents lies."""
    picked = [F.min(F.when(F.col("share_within") >= q, F.col("context_limit"))).alias(f"q{round(q * 1000):04d}") for q in shares]
    return report.agg(*picked)


