"""Glyphs to words: a word breaks at spaces and undecodable glyphs, and where style, baseline or gap jumps."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glyphweave.sources.content import glyph_rows, key_runs, shown_pages, with_fonts

PAGE = ["doc_id", "page"]


def separates(text: Column) -> Column:
    """Space, no-break space and undecodable glyphs end a word and belong to none."""
    return text.isin(" ", " ", "")


def detect_words(glyphs: DataFrame) -> DataFrame:
    """`glyphs` (doc_id, page, glyph_ord, unicode, x, y, width, height, font_res, font_size) to words.

    A glyph starts a word after a separator, at another font, at a size that differs
    by 0.01 or more, at a baseline off by 0.15 of its height or more, at a gap over
    0.19 of its height plus 0.5, or at a step back by more than its height.
    Returns doc_id, page, word_ord, text, x, y, w, h, baseline, font_res, font_size,
    glyph_lo, glyph_hi. One exchange on the page serves both windows and the sums, and none if glyphs are dealt by page.
    """
    flow = Window.partitionBy(*PAGE).orderBy("glyph_ord")
    gap = F.col("x") - (F.lag("x").over(flow) + F.lag("width").over(flow))
    fits = (
        (F.lag("font_res").over(flow) == F.col("font_res"))
        & (F.abs(F.col("font_size") - F.lag("font_size").over(flow)) < 0.01)
        & (F.abs(F.col("y") - F.lag("y").over(flow)) < 0.15 * F.col("height"))
        & (gap <= 0.19 * F.col("height") + 0.5)
        & (gap >= -F.col("height"))
        & ~F.lag("gone").over(flow)
    )
    marked = (
        glyphs.withColumn("gone", separates(F.coalesce("unicode", F.lit(""))))
        .withColumn("starts", F.when(F.coalesce(fits, F.lit(False)), 0).otherwise(1))
        .withColumn("run", F.sum("starts").over(flow.rowsBetween(Window.unboundedPreceding, 0)))
        .where(~F.col("gone"))
    )
    box_y = F.col("y") - 0.22 * F.col("height")
    words = marked.groupBy(*PAGE, "run").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("glyph_ord", "unicode"))), lambda g: g["unicode"]), "").alias("text"),
        F.min("x").alias("x"),
        F.min(box_y).alias("y"),
        (F.max(F.col("x") + F.col("width")) - F.min("x")).alias("w"),
        (F.max(box_y + F.col("height")) - F.min(box_y)).alias("h"),
        F.min_by("y", "glyph_ord").alias("baseline"),
        F.min_by("font_res", "glyph_ord").alias("font_res"),
        F.min_by("font_size", "glyph_ord").alias("font_size"),
        F.min("glyph_ord").alias("glyph_lo"),
        F.max("glyph_ord").alias("glyph_hi"),
    )
    order = F.row_number().over(Window.partitionBy(*PAGE).orderBy("run")) - 1
    return words.withColumn("word_ord", order).select(
        *PAGE, "word_ord", "text", "x", "y", "w", "h", "baseline", "font_res", "font_size", "glyph_lo", "glyph_hi"
    )


WORD_SCHEMA = (
    "doc_id long, page int, word_ord int, text string, x double, y double, w double, h double, baseline double,"
    " font_res string, font_size double, glyph_lo long, glyph_hi long"
)


def number_glyphs(glyphs: DataFrame) -> DataFrame:
    """`glyphs` with the word_ord that `detect_words` gives each one's word; separators go.

    Nothing is shuffled: a page's glyphs must follow each other in order in one task, as `extract_glyphs` without `block` leaves them.
    """

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for page in key_runs(batches, PAGE):
            word = word_numbers(page)
            yield from page.append_column("word_ord", pa.array(word.astype(np.int32))).filter(pa.array(word >= 0)).to_batches()

    return glyphs.mapInArrow(number, glyphs.select("*", F.lit(0).alias("word_ord")).schema)


def page_words(glyphs: DataFrame) -> DataFrame:
    """`detect_words` of glyphs that lie page by page, as `number_glyphs` asks; nothing is shuffled."""

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for page in key_runs(batches, PAGE):
            yield words_of(page.combine_chunks())

    return glyphs.mapInArrow(found, WORD_SCHEMA)


def read_words(pages: DataFrame, fonts: DataFrame | None, columns: Sequence[str] | None = None) -> DataFrame:
    """`detect_words` of what `pages` (doc_id, page, content) show: a page is read and its words found where its stream lies, as in `read_glyphs`.

    Glyphs are no rows; only `columns` of WORD_SCHEMA are given, if named.
    """
    kinds = {f.split()[0]: f for f in WORD_SCHEMA.split(", ")}
    names = list(columns or kinds)

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in shown_pages(batches, False, True):
            yield words_of(glyph_rows(held, GLYPHS)).select(names)

    return with_fonts(pages, fonts).mapInArrow(found, ", ".join(kinds[n] for n in names))


GLYPHS = (*PAGE, "glyph_ord", "unicode", "x", "y", "width", "height", "font_res", "font_size")


def word_numbers(glyphs: pa.RecordBatch | pa.Table) -> np.ndarray:
    """The word_ord of each glyph of whole pages, by the rule of `detect_words`; -1 for separators."""
    c = {n: glyphs.column(n).to_numpy(zero_copy_only=False) for n in (*PAGE, "x", "y", "width", "height", "font_size")}
    if not len(c["x"]):
        return np.zeros(0, np.int64)
    char, font = (pc.fill_null(glyphs.column(n), "") for n in ("unicode", "font_res"))
    gone = pc.is_in(char, pa.array([" ", "\u00a0", ""])).to_numpy(zero_copy_only=False)
    font = pc.dictionary_encode(font.combine_chunks() if isinstance(font, pa.ChunkedArray) else font).indices.to_numpy()
    named = glyphs.column("font_res").is_valid().to_numpy(zero_copy_only=False)
    size, x, y, high = c["font_size"], c["x"], c["y"], c["height"][1:]
    gap = x[1:] - (x[:-1] + c["width"][:-1])
    other = (c["doc_id"][1:] != c["doc_id"][:-1]) | (c["page"][1:] != c["page"][:-1])
    fits = (font[1:] == font[:-1]) & named[1:] & named[:-1] & (np.abs(size[1:] - size[:-1]) < 0.01) & (np.abs(y[1:] - y[:-1]) < 0.15 * high)
    fits &= (gap <= 0.19 * high + 0.5) & (gap >= -high) & ~gone[:-1] & ~other
    run = np.cumsum(np.append(True, ~fits))
    # words are runs that are not gone, counted over a page
    begins = np.append(True, run[1:] != run[:-1]) & ~gone
    seen = np.cumsum(begins)
    heads = np.flatnonzero(np.append(True, other))
    before = np.repeat((seen - begins)[heads], np.diff(np.append(heads, len(run))))
    return np.where(gone, -1, seen - before - 1)


def words_of(glyphs: pa.RecordBatch | pa.Table) -> pa.RecordBatch:
    """WORD_SCHEMA rows of the glyphs of whole pages, page by page and in order."""
    word = word_numbers(glyphs)
    kept = word >= 0
    glyphs, word = glyphs.select(list(GLYPHS)).filter(pa.array(kept)), word[kept]
    c = {n: glyphs.column(n).to_numpy(zero_copy_only=False) for n in (*PAGE, "glyph_ord", "x", "y", "width", "height", "font_size")}
    if not len(word):
        return pa.RecordBatch.from_arrays([pa.array([], t) for t in _WORD_TYPES], names=_WORD_NAMES)
    at = np.flatnonzero(np.append(True, (word[1:] != word[:-1]) | (c["page"][1:] != c["page"][:-1]) | (c["doc_id"][1:] != c["doc_id"][:-1])))
    ends = np.append(at[1:], len(word))
    low = c["y"] - 0.22 * c["height"]
    x, y = np.minimum.reduceat(c["x"], at), np.minimum.reduceat(low, at)
    char, font = (v.combine_chunks() if isinstance(v, pa.ChunkedArray) else v for v in (glyphs.column("unicode"), glyphs.column("font_res")))
    text = pc.binary_join(pa.ListArray.from_arrays(pa.array(np.append(at, len(word)).astype(np.int32)), char), "")
    right, top = np.maximum.reduceat(c["x"] + c["width"], at), np.maximum.reduceat(low + c["height"], at)
    columns = [
        c["doc_id"][at], c["page"][at], word[at], text, x, y, right - x, top - y, c["y"][at], font.take(pa.array(at)), c["font_size"][at], c["glyph_ord"][at], c["glyph_ord"][ends - 1],
    ]
    return pa.RecordBatch.from_arrays([v if isinstance(v, pa.Array) else pa.array(v, t) for v, t in zip(columns, _WORD_TYPES, strict=True)], names=_WORD_NAMES)


_WORD_NAMES = [f.split()[0] for f in WORD_SCHEMA.split(", ")]
_WORD_TYPES = [{"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "double": pa.float64()}[f.split()[1]] for f in WORD_SCHEMA.split(", ")]
