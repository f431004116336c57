"""Corpus pipeline: quality filter, near-duplicate groups, decontamination, secret masking, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last
return the columns of `documents`. A stage's result is written as Parquet and read
again as the next one's docs.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphweave.llm import decontaminate, hilbert_packing, jaccard_join, quality_gam, secret_scan
from glyphweave.llm.labelled import fold_of
from glyphweave.llm.queries import table
from glyphweave.llm.workspace import written

#: Near copies share four fifths of their runs of five words; op9_jaccard_join has its own rule.
NEAR_COPIES = jaccard_join.Rule(width=5, over=80, under=100)

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def plain(docs: DataFrame) -> DataFrame:
    """`docs` with names that no operator uses itself: text, and field_0, field_1, ... for the others."""
    return docs.toDF(*(c if c == "text" else f"field_{k}" for k, c in enumerate(docs.columns)))


def named(kept: DataFrame, docs: DataFrame) -> DataFrame:
    """The rows of plain(docs) that were kept, with the columns of `docs` again."""
    return kept.select(*(F.col(c if c == "text" else f"field_{k}").alias(c) for k, c in enumerate(docs.columns)))


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that the quality classifier rejects (score below 0.3). A null text is judged as the empty one."""
    model = quality_gam.train(docs, table(spark, sf_dir, "labels"), fold_of("doc_id", 5) != 0)
    return named(quality_gam.score(plain(docs), model).where("predicted = 1"), docs)


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document, of the smallest doc_id, of each group that the Jaccard join links by NEAR_COPIES.

    Null and wordless texts are linked with nothing and stay.
    """
    return jaccard_join.one_of_each(docs, NEAR_COPIES)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents of which a twentieth or more lies under benchmark windows. Null and wordless texts stay."""
    found = decontaminate.contamination(plain(docs), table(spark, sf_dir, "benchmark"))
    return named(found.where(~F.col("contaminated")), docs)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace found secrets in texts; no document is dropped, null texts stay null, and n_chars follows where there is one."""
    clean = secret_scan.masked(docs, secret_scan.train(secret_scan.sample_findings(spark)))
    if "n_chars" not in docs.columns:
        return clean
    return clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack what is left into sequences; a row for each piece."""
    return hilbert_packing.piece_digest(hilbert_packing.pack(docs.select("doc_id", "text")))


STAGES: list[tuple[str, Stage]] = [
    ("quality", keep_quality),
    ("jaccard", keep_one_of_each),
    ("decontamination", drop_contaminated),
    ("secrets", mask_secrets),
    ("packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)


#: Models and token ids are beyond SQL; tests compare the stages with brute force.
ORACLE_SQL: str | None = None
