"""Phrase search over blocks, reading order, and the reading feed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from glyphweave.functions.text import dwell, pivot_index
from glyphweave.operators.lines import reading_ranks
from glyphweave.operators.words import PAGE


def search_units(lines: DataFrame) -> DataFrame:
    """Texts to search: a paragraph as one, any other block line by line.

    `lines`: with words, block_ord and kind. Returns doc_id, page, block_ord, unit, kind,
    text, words (in order, with offset and box). Nothing is joined: words come with their lines.
    """
    unit = F.when(F.col("kind") == "paragraph", 0).otherwise(F.col("line_ord"))
    down = Window.partitionBy(*PAGE, "block_ord", "unit").orderBy("line_ord").rowsBetween(Window.unboundedPreceding, -1)
    led = lines.withColumn("unit", unit).withColumn("before", F.coalesce(F.sum("n_chars").over(down), F.lit(0)))
    entries = F.transform("words", lambda w: F.struct((F.col("before") + w["lead"]).alias("offset"), *(w[c].alias(c) for c in ("text", "x", "y", "w", "h", "word_ord"))))
    ordered = F.array_sort(F.collect_list(F.struct("line_ord", entries.alias("words"))))
    grouped = led.groupBy(*PAGE, "block_ord", "unit").agg(F.first("kind").alias("kind"), F.flatten(F.transform(ordered, lambda line: line["words"])).alias("words"))
    return grouped.withColumn("text", F.array_join(F.col("words.text"), " "))


def is_word_char(char: Column) -> Column:
    return char.rlike(r"^[\p{L}\p{N}_]$")


def find_phrase(units: DataFrame, query: str, case_sensitive: bool = False, whole_word: bool = False) -> DataFrame:
    """Non-overlapping hits, left to right, with their words and box.

    The query is trimmed; a blank one finds nothing. With `whole_word`, a hit beside a
    letter, digit or underscore is dropped but has used up its text. Offsets count
    characters. Returns doc_id, page, block_ord, unit, offset, matched, n_words, x, y, w, h.
    """
    needle = query.strip()
    if not needle:
        return units.limit(0).select(*PAGE, "block_ord", "unit", F.lit(0).cast("long").alias("offset"), F.lit("").alias("matched"), F.lit(0).alias("n_words"), *(F.lit(0.0).alias(c) for c in "xywh"))
    size = len(needle)
    hay = F.col("text") if case_sensitive else F.lower("text")
    needle = needle if case_sensitive else needle.lower()
    quoted = "\\Q" + needle.replace("\\E", "\\E\\\\E\\Q") + "\\E"
    pieces = F.split("hay", quoted, -1)
    ends = F.transform(pieces, lambda p, k: F.length(p))
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<bigint>").alias("hits"))

    def step(acc, n):
        here = acc["at"] + n
        return F.struct((here + size).alias("at"), F.concat(acc["hits"], F.array(here)).alias("hits"))

    hits = F.aggregate(F.slice(ends, 1, F.greatest(F.size(ends) - 1, F.lit(0))), start, step, lambda acc: acc["hits"])
    found = (
        units.withColumn("hay", hay)
        .where(F.contains("hay", F.lit(needle)))
        .select(*PAGE, "block_ord", "unit", "text", "hay", "words", F.explode(hits).alias("offset"))
    )
    if whole_word:
        left = F.when(F.col("offset") > 0, F.substring("hay", F.col("offset").cast("int"), F.lit(1)))
        right = F.substring("hay", (F.col("offset") + size + 1).cast("int"), F.lit(1))
        found = found.where(~F.coalesce(is_word_char(left), F.lit(False)) & ~F.coalesce(is_word_char(right), F.lit(False)))
    hit = F.filter("words", lambda w: (w["offset"] < F.col("offset") + size) & (w["offset"] + F.length(w["text"]) > F.col("offset")))
    boxed = found.withColumn("hit", hit).where(F.size("hit") > 0)
    left_x, low_y = F.array_min(F.col("hit.x")), F.array_min(F.col("hit.y"))
    return boxed.select(
        *PAGE,
        "block_ord",
        "unit",
        "offset",
        F.substring("text", (F.col("offset") + 1).cast("int"), F.lit(size)).alias("matched"),
        F.size("hit").alias("n_words"),
        left_x.alias("x"),
        low_y.alias("y"),
        (F.array_max(F.transform("hit", lambda w: w["x"] + w["w"])) - left_x).alias("w"),
        (F.array_max(F.transform("hit", lambda w: w["y"] + w["h"])) - low_y).alias("h"),
    )


def reading_feed(placed: DataFrame, words_per_minute: int = 300) -> DataFrame:
    """Words in reading order with the time each is shown, in milliseconds.

    Returns doc_id, feed_pos, page, word_ord, text, pivot, shown_at, shown_for.
    """
    order = Window.partitionBy("doc_id").orderBy("page", "line_ord", "pos")
    shown_for = F.lit(60000.0 / words_per_minute) * dwell(F.col("text"))
    timed = placed.withColumn("feed_pos", F.row_number().over(order) - 1).withColumn("shown_for", shown_for)
    clock = F.coalesce(F.sum("shown_for").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    return timed.select("doc_id", "feed_pos", "page", "word_ord", "text", pivot_index(F.length("text")).alias("pivot"), clock.alias("shown_at"), "shown_for")


def word_count(placed: DataFrame) -> DataFrame:
    return placed.groupBy("doc_id").agg(F.count("*").alias("n_words"))


def step_hit(current: Column, by: int, hits: Column) -> Column:
    """The next or previous hit, wrapping round; null without hits."""
    return F.when(hits > 0, F.pmod(current + by, hits))


def refreshed_hit(current: Column, hits: Column) -> Column:
    """The current hit after hits were found again: the same number, or the last one; null without hits or a current one."""
    return F.when((hits > 0) & current.isNotNull(), F.least(current, hits - 1))


def anchor_positions(feed: DataFrame, anchors: DataFrame) -> DataFrame:
    """Where the feed reaches each anchored word (anchor_id, doc_id, page, word_ord); anchors on no word give no row."""
    return anchors.join(feed, [*PAGE, "word_ord"]).groupBy("anchor_id").agg(F.min("feed_pos").alias("feed_pos"))


def page_anchors(pages: DataFrame, word_ord: Column) -> DataFrame:
    """Where the feed reaches one word of each page (doc_id, page, words): doc_id, page, feed_pos, null if the page lacks that word.

    Words stay in the rows of their pages; only a count and a place of each page are shuffled. Pages of no words have no row.
    """
    ranked = pages.select(*PAGE, "words", arrow_udf(reading_ranks, "array<int>")("words").alias("ranks"))
    at = F.array_position(F.col("words.word_ord"), word_ord).cast("int") - 1
    counted = ranked.select(*PAGE, F.size("words").alias("n"), F.when(at >= 0, F.get("ranks", at)).alias("rank")).where("n > 0")
    earlier = Window.partitionBy("doc_id").orderBy("page").rowsBetween(Window.unboundedPreceding, -1)
    return counted.select(*PAGE, (F.coalesce(F.sum("n").over(earlier), F.lit(0)) + F.col("rank")).cast("int").alias("feed_pos"))
