"""Feeds and counts that follow pages as they come.

Layout rules are per page, so a page is laid out when it arrives, whatever came before.
What depends on other pages is keyed state: the place and the clock of each document's
reading feed, and the newest revision of each page. State lives in the query's
checkpoint, so a stream goes on after a restart where it stopped.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from glyphweave.functions.text import dwell, pivot_index
from glyphweave.operators.lines import place_words
from glyphweave.plans.bridge import bridge_words, text_lines

PAGES = "doc_id long, page int, words array<struct<word_ord:int,text:string>>"
FEED = "doc_id long, feed_pos long, page int, word_ord int, text string, pivot int, shown_at double, shown_for double"
REVISIONS = "doc_id long, page int, revision long, text string"
CHANGES = "doc_id long, page int, revision long, n_words long, change long"


def text_stream(spark: SparkSession, folder: str) -> DataFrame:
    """New Parquet files of texts (doc_id, text) in a folder."""
    return spark.readStream.schema("doc_id long, text string").parquet(folder)


def page_word_counts(docs: DataFrame) -> DataFrame:
    """Words of each page of typeset texts. Works on streams and tables alike."""
    words = text_lines(docs).select("doc_id", "page", F.explode(F.split("line", " ")).alias("text")).where("text <> ''")
    return words.groupBy("doc_id", "page").agg(F.count("*").alias("n_words"))


def reading_pages(placed: DataFrame, pages: DataFrame) -> DataFrame:
    """PAGES rows of placed words: each of `pages` (doc_id, page) with its words in reading order, none if it has none."""
    ordered = F.array_sort(F.collect_list(F.struct("line_ord", "pos", F.col("word_ord").cast("int").alias("word_ord"), "text")))
    words = placed.groupBy("doc_id", "page").agg(F.transform(ordered, lambda w: F.struct(w["word_ord"].alias("word_ord"), w["text"].alias("text"))).alias("words"))
    return pages.select("doc_id", "page").join(words, ["doc_id", "page"], "left").withColumn("words", F.coalesce("words", F.array().cast("array<struct<word_ord:int,text:string>>")))


def append_pages(spark: SparkSession, folder: str, out: str, checkpoint: str) -> StreamingQuery:
    """Lay out new texts and append their pages (PAGES) to a Parquet folder, batch by batch; ends when all files are read."""

    def write(batch: DataFrame, batch_no: int) -> None:
        pages = text_lines(batch).select("doc_id", "page").distinct()
        done = reading_pages(place_words(bridge_words(batch)), pages)
        done.write.mode("overwrite").parquet(f"{out}/batch={batch_no}")  # the same batch again overwrites itself

    return text_stream(spark, folder).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def page_stream(spark: SparkSession, folder: str, files: int = 100) -> DataFrame:
    """New Parquet files of pages (PAGES), `files` at a time."""
    return spark.readStream.schema(PAGES).option("maxFilesPerTrigger", files).option("recursiveFileLookup", True).parquet(folder)


def feed_stream(pages: DataFrame, words_per_minute: int = 300) -> DataFrame:
    """FEED rows of a stream of pages (PAGES), as `reading_feed` gives them for a table.

    A document's pages are fed in order from page 0: one that comes early is held in the
    state until those before it are there, one that comes again is left out. Its words and its clock
    go on from the page before.
    """
    beat = F.lit(60000.0 / words_per_minute)

    def timed(w: Column) -> Column:
        return F.struct(w["word_ord"].alias("word_ord"), w["text"].alias("text"), pivot_index(F.length(w["text"])).alias("pivot"), (beat * dwell(w["text"])).alias("shown_for"))

    rows = pages.select("doc_id", "page", F.to_json(F.transform("words", timed)).alias("words"))

    def go_on(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        page, place, clock, held = state.get if state.exists else (0, 0, 0.0, "{}")
        waiting: dict[str, str] = json.loads(held)
        for batch in batches:
            for number, words in zip(batch["page"].tolist(), batch["words"].tolist(), strict=True):
                if number >= page:
                    waiting.setdefault(str(number), words)
        out: list[tuple[Any, ...]] = []
        while str(page) in waiting:
            for w in json.loads(waiting.pop(str(page))):
                out.append((key[0], place, page, w["word_ord"], w["text"], w["pivot"], clock, w["shown_for"]))
                place, clock = place + 1, clock + w["shown_for"]
            page += 1
        state.update((page, place, clock, json.dumps(waiting)))
        yield pd.DataFrame(out, columns=[c.split()[0] for c in FEED.split(", ")])

    return rows.groupBy("doc_id").applyInPandasWithState(go_on, FEED, "page int, place long, clock double, held string", "append", GroupStateTimeout.NoTimeout)


def page_words(text: Column) -> Column:
    """How many words a page's text has: runs without white space."""
    return F.size(F.filter(F.split(text, r"\s+"), lambda w: w != "")).cast("long")


def revision_stream(spark: SparkSession, folder: str, files: int = 100) -> DataFrame:
    """New Parquet files of page revisions (REVISIONS), `files` at a time; a null text deletes the page."""
    return spark.readStream.schema(REVISIONS).option("maxFilesPerTrigger", files).parquet(folder)


def count_changes(revisions: DataFrame) -> DataFrame:
    """CHANGES rows of a stream of revisions: the newest one so far of each page, and by how much the count changed.

    A revision that is not newer than what was seen of its page changes nothing, so they may
    come in any order and again; of equal ones the first counts. The old count is taken back by the change.
    """
    counted = revisions.select("doc_id", "page", "revision", F.coalesce(page_words(F.col("text")), F.lit(0).cast("long")).alias("n_words"))

    def newest(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        seen, count = state.get if state.exists else (None, 0)
        best = seen, count
        for batch in batches:
            for revision, n in zip(batch["revision"].tolist(), batch["n_words"].tolist(), strict=True):
                if best[0] is None or revision > best[0]:
                    best = revision, n
        if best[0] != seen:
            state.update(best)
            yield pd.DataFrame([(*key, *best, best[1] - count)], columns=[c.split()[0] for c in CHANGES.split(", ")])

    return counted.groupBy("doc_id", "page").applyInPandasWithState(newest, CHANGES, "revision long, n_words long", "append", GroupStateTimeout.NoTimeout)


def append_changes(changes: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Append a stream's rows to a Parquet folder; ends when all files are read. A batch that is run again overwrites itself."""

    def write(batch: DataFrame, batch_no: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={batch_no}")

    return changes.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def counted_words(changes: DataFrame) -> DataFrame:
    """doc_id, n_pages, n_words of each document by its changes so far; documents without words have 0 of both."""
    pages = changes.groupBy("doc_id", "page").agg(F.sum("change").alias("n_words"))
    return pages.groupBy("doc_id").agg(F.count_if(F.col("n_words") > 0).alias("n_pages"), F.sum("n_words").alias("n_words"))
