"""Ordered page lists: move, delete, duplicate, rotate, merge, extract, split. Pages are numbered from 0."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def reindex(pages: DataFrame, order: list | None = None) -> DataFrame:
    """Number each document's pages 0, 1, 2 ... in the given order (by page)."""
    place = Window.partitionBy("doc_id").orderBy(*(order or ["page"]))
    return pages.withColumn("page", F.row_number().over(place) - 1)


def moved_index(page: Column, source: Column, to: Column) -> Column:
    """Where a page is after the page at `source` was taken out and put in at `to`."""
    return (
        F.when(page == source, to)
        .when((source < page) & (page <= to), page - 1)
        .when((to <= page) & (page < source), page + 1)
        .otherwise(page)
    )


def dropped_index(source: Column, at: Column) -> Column:
    """Target of a drag whose drop mark counts the dragged page."""
    return F.when(at > source, at - 1).otherwise(at)


def _sizes(pages: DataFrame) -> DataFrame:
    return pages.withColumn("n_pages", F.count("*").over(Window.partitionBy("doc_id")))


def move_page(pages: DataFrame, source: int, to: int) -> DataFrame:
    """Documents without either place are left as they are."""
    there = (F.lit(source) < F.col("n_pages")) & (F.lit(to) < F.col("n_pages"))
    moved = F.when(there, moved_index(F.col("page"), F.lit(source), F.lit(to))).otherwise(F.col("page"))
    return _sizes(pages).withColumn("page", moved.cast("int")).drop("n_pages")


def delete_pages(pages: DataFrame, chosen: DataFrame) -> DataFrame:
    """Delete the chosen (doc_id, page); a document of which all pages are chosen keeps them."""
    marked = pages.join(chosen.select("doc_id", "page").distinct().withColumn("gone", F.lit(True)), ["doc_id", "page"], "left")
    whole = F.min(F.coalesce("gone", F.lit(False)).cast("int")).over(Window.partitionBy("doc_id")) == 1
    kept = marked.withColumn("whole", whole).where("whole or gone is null").drop("gone", "whole")
    return reindex(kept.select(*pages.columns))


def duplicate_page(pages: DataFrame, at: int) -> DataFrame:
    """A copy of page `at` comes right after it."""
    copies = F.explode(F.when(F.col("page") == at, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy")
    return reindex(pages.select("*", copies), ["page", "copy"]).drop("copy")


def rotated(rotation: Column, by: int) -> Column:
    return F.pmod(rotation + by, F.lit(360))


def merge_documents(pages: DataFrame, inserted: DataFrame, at: int) -> DataFrame:
    """Put the pages of `inserted` (same columns, doc_id of the target) before page `at`."""
    first = pages.withColumn("half", (F.col("page") >= at).cast("int") * 2)
    second = inserted.withColumn("half", F.lit(1))
    return reindex(first.unionByName(second), ["half", "page"]).drop("half")


def merge_summary(inserted: DataFrame, fields: DataFrame) -> DataFrame:
    """What a merge brought into each document: n_inserted pages, and has_forms if any form field (doc_id, name) came along."""
    counts = inserted.groupBy("doc_id").agg(F.count("*").alias("n_inserted"))
    forms = fields.select("doc_id").distinct().withColumn("has_forms", F.lit(True))
    return counts.join(forms, "doc_id", "left").fillna(False, ["has_forms"])


def extract_pages(pages: DataFrame, order: list[int]) -> DataFrame:
    """The pages named by `order`, in that order; missing ones are skipped, repeated ones repeat."""
    wanted = F.posexplode(F.array(*(F.lit(int(k)) for k in order)).cast("array<int>"))
    picks = pages.sparkSession.range(1).select(wanted.alias("at", "page"))
    return reindex(pages.join(F.broadcast(picks), "page"), ["at"]).select(*pages.columns)


def split_documents(pages: DataFrame, at: int) -> DataFrame:
    """Two parts (column part: 0, 1) of documents with a page `at` above 0; others stay one part."""
    fits = (F.lit(at) > 0) & (F.lit(at) < F.col("n_pages"))
    part = F.when(fits & (F.col("page") >= at), 1).otherwise(0)
    page = F.when(part == 1, F.col("page") - at).otherwise(F.col("page"))
    return _sizes(pages).withColumn("part", part).withColumn("page", page.cast("int")).drop("n_pages")


def select_range(lo: Column, hi: Column) -> Column:
    """All pages from the smaller to the larger."""
    return F.sequence(F.least(lo, hi), F.greatest(lo, hi))


def toggle(selected: Column, page: Column) -> Column:
    """Add a page to a selection, or take it out."""
    return F.when(F.array_contains(selected, page), F.array_except(selected, F.array(page))).otherwise(
        F.array_sort(F.array_union(selected, F.array(page)))
    )
