"""Page-wise results kept up to date: after an edit only pages with new contents are worked out again.

A page-wise result (lines, search hits) has doc_id and page, and its rows depend on their page's
contents alone. Beside it, `page_digests` of the pages it was made from are kept. A page whose contents
the document had before, at whatever number, takes its rows from there: moved and duplicated pages cost a join.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphweave.operators.words import PAGE


def page_digests(pages: DataFrame, contents: list[str]) -> DataFrame:
    """doc_id, page, digest: one row for each page (doc_id, page, and the columns `contents`, nulls too)."""
    return pages.select(*PAGE, F.sha2(F.to_json(F.struct(*contents)), 256).alias("digest"))


def page_sources(before: DataFrame, after: DataFrame) -> DataFrame:
    """Where pages come from: each page of `after` with `source`, the first page of its document in `before` of equal digest, or null."""
    first = before.groupBy("doc_id", "digest").agg(F.min("page").alias("source"))
    return after.join(first, ["doc_id", "digest"], "left").select(*PAGE, "source")


def refreshed(view: DataFrame, before: DataFrame, pages: DataFrame, contents: list[str], make: Callable[[DataFrame], DataFrame], tasks: int | None = None) -> DataFrame:
    """`view` brought up to `pages`; rows tell by `made_again` whether they were worked out anew.

    `before`: page_digests of the pages that `view` was made from. `make` turns pages into
    rows with the columns of `view`; it is given only pages that their document had nowhere before.
    Deleted pages take their rows along. Rows and pages are dealt over so many `tasks`, if given, so that a task sorts no more of a larger table.
    """
    dealt = lambda rows: rows.repartition(tasks, *PAGE) if tasks else rows
    origin = page_sources(before, page_digests(pages, contents))
    known = origin.where("source is not null").select("doc_id", F.col("page").alias("new_page"), F.col("source").alias("page"))
    carried = dealt(view).join(dealt(known), PAGE).withColumn("page", F.col("new_page")).select(*view.columns, F.lit(False).alias("made_again"))
    new = dealt(pages).join(dealt(origin.where("source is null")), PAGE, "left_semi")
    return carried.unionByName(make(new).select(*view.columns, F.lit(True).alias("made_again")))
