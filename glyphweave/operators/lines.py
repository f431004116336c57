"""Words to lines.

The rule is first fit in reading order: a word joins the first line whose baseline,
frozen at its first word, lies within a quarter of the word's size (1 at least).
A word's line is then also the first that fits it among all lines of the page, and
words of the same baseline and size share it. So only a page's few runs of such words
are folded, in one row for each page; columns of all its words are numbered and added up at once.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import pairwise

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from glyphweave.operators.words import GLYPHS, PAGE, WORD_SCHEMA, words_of
from glyphweave.sources.content import glyph_rows, shown_pages, with_fonts


def first_fit(page: pd.DataFrame) -> pd.DataFrame:
    """line_ord and line_baseline of one page's words, word by word; lines are numbered from the top."""
    page = page.sort_values("word_ord", kind="stable")
    frozen: list[float] = []
    chosen = []
    for baseline, size in zip(page["baseline"], page["font_size"], strict=True):
        reach = max(0.25 * size, 1.0)
        line = next((k for k, b in enumerate(frozen) if abs(b - baseline) < reach), len(frozen))
        if line == len(frozen):
            frozen.append(baseline)
        chosen.append(line)
    top_down = sorted(range(len(frozen)), key=lambda k: -frozen[k])
    place = {line: k for k, line in enumerate(top_down)}
    return page.assign(line_ord=[place[c] for c in chosen], line_baseline=[frozen[c] for c in chosen])


def flat(words: pa.Array, *names: str) -> tuple[np.ndarray, list[np.ndarray]]:
    """The row of each word in a column of lists of structs, and some of their fields."""
    held = words.flatten()
    return pc.list_parent_indices(words).to_numpy(), [held.field(n).to_numpy(zero_copy_only=False) for n in names]


def listed(counts: np.ndarray, columns: dict[str, pa.Array]) -> pa.ListArray:
    """Lists of structs of so many elements each."""
    struct = pa.StructArray.from_arrays(list(columns.values()), names=list(columns))
    return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(counts)).astype(np.int32)), struct)


def before(amounts: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Sums of what goes before each place in its group; groups begin at `starts` and have such sizes."""
    sums = np.cumsum(amounts) - amounts
    return sums - np.repeat(sums[starts], sizes)


def fitted(page: np.ndarray, word_ord: np.ndarray, baseline: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """line_ord and line_baseline of each word, by first fit in reading order."""
    order = np.lexsort((word_ord, page))
    sorted_ = [c[order] for c in (page, baseline, size)]
    runs = np.flatnonzero(np.append(True, np.logical_or.reduce([c[1:] != c[:-1] for c in sorted_]))[: len(order)])
    of, base, reach = sorted_[0][runs], sorted_[1][runs].tolist(), np.maximum(0.25 * sorted_[2][runs], 1.0).tolist()
    place, frozen_at = np.zeros(len(runs), np.int32), np.zeros(len(runs))
    for a, b in pairwise([*np.flatnonzero(np.append(True, of[1:] != of[:-1])[: len(of)]).tolist(), len(of)]):
        frozen: list[float] = []
        chosen = []
        for k in range(a, b):
            line = next((n for n, held in enumerate(frozen) if abs(held - base[k]) < reach[k]), len(frozen))
            if line == len(frozen):
                frozen.append(base[k])
            chosen.append(line)
        down = np.argsort(-np.array(frozen), kind="stable")
        place[a:b], frozen_at[a:b] = np.argsort(down)[chosen], np.array(frozen)[chosen]
    sizes = np.diff(np.append(runs, len(order)))
    line_ord, line_baseline = np.empty(len(order), np.int32), np.empty(len(order))
    line_ord[order], line_baseline[order] = np.repeat(place, sizes), np.repeat(frozen_at, sizes)
    return line_ord, line_baseline


def runs_of(page: np.ndarray, line_ord: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where lines begin among sorted words, and how many words they have."""
    starts = np.flatnonzero(np.append(True, (page[1:] != page[:-1]) | (line_ord[1:] != line_ord[:-1]))[: len(page)])
    return starts, np.diff(np.append(starts, len(page)))


PLACES = "array<struct<line_ord:int,line_baseline:double,pos:int>>"


def word_places(words: pa.Array) -> pa.Array:
    """line_ord, line_baseline and pos of the words of pages, in the order in which they are held."""
    page, (word_ord, baseline, size, x) = flat(words, "word_ord", "baseline", "font_size", "x")
    pos = np.zeros(len(page), np.int32)
    line_ord, line_baseline = np.zeros(0, np.int32), np.zeros(0)
    if len(page):
        line_ord, line_baseline = fitted(page, word_ord, baseline, size)
        order = np.lexsort((word_ord, x, line_ord, page))
        starts, sizes = runs_of(page[order], line_ord[order])
        pos[order] = np.arange(len(page)) - np.repeat(starts, sizes)
    return listed(np.bincount(page, minlength=len(words)), {"line_ord": pa.array(line_ord), "line_baseline": pa.array(line_baseline), "pos": pa.array(pos)})


def reading_ranks(words: pa.Array) -> pa.Array:
    """How many words of its page the feed shows before each word, in the order in which they are held."""
    page, (word_ord, baseline, size, x) = flat(words, "word_ord", "baseline", "font_size", "x")
    counts = np.bincount(page, minlength=len(words)) if len(page) else np.zeros(len(words), np.int64)
    ranks = np.zeros(len(page), np.int32)
    if len(page):
        line_ord, _ = fitted(page, word_ord, baseline, size)
        ranks[np.lexsort((word_ord, x, line_ord, page))] = np.arange(len(page)) - np.repeat(np.cumsum(counts) - counts, counts)
    return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(counts)).astype(np.int32)), pa.array(ranks))


LINE_WORDS = "array<struct<pos:int,word_ord:int,text:string,x:double,y:double,w:double,h:double,lead:long,cell:int>>"
LINES = (
    "array<struct<line_ord:int,x:double,y:double,w:double,h:double,baseline:double,n_words:long,text:string,"
    f"first_size:double,first_w:double,column_gaps:long,n_chars:long,block_ord:int,kind:string,words:{LINE_WORDS}>>"
)
UNITS = (
    "array<struct<block_ord:int,unit:int,kind:string,text:string,"
    "words:array<struct<offset:long,text:string,x:double,y:double,w:double,h:double,word_ord:int>>>>"
)


def lines_of_words(words: pa.Array) -> pa.Array:
    """`detect_lines` of the placed words of pages, with block_ord and kind, in one pass."""
    page, columns, sizes, own = line_columns(words)
    held = {k: v if isinstance(v, pa.Array) else pa.array(v, pa.string() if k == "kind" else None) for k, v in columns.items()}
    return listed(np.bincount(page, minlength=len(words)), held | {"words": listed(sizes, {k: own[k] for k in ("pos", "word_ord", "text", *"xywh", "lead", "cell")})})


def units_of_words(words: pa.Array) -> pa.Array:
    """`search_units` of the lines of pages: a unit's lines follow each other, so it is a run of their words."""
    page, columns, sizes, own = line_columns(words)
    paragraph, block = columns["kind"] == "paragraph", columns["block_ord"]
    at = np.flatnonzero(np.append(True, ~(paragraph[1:] & (block[1:] == block[:-1]) & (page[1:] == page[:-1])))[: len(page)])
    sizes = np.add.reduceat(sizes, at) if len(at) else sizes
    starts = np.cumsum(sizes) - sizes
    chars = pc.utf8_length(own["text"]).to_numpy(zero_copy_only=False).astype(np.int64) + 1
    offset = pa.array(before(chars, starts, sizes) if len(at) else chars)
    held = listed(sizes, {"offset": offset, **{k: own[k] for k in ("text", *"xywh", "word_ord")}})
    unit = np.where(paragraph, 0, columns["line_ord"]).astype(np.int32)
    text = pc.binary_join(pa.ListArray.from_arrays(held.offsets, own["text"]), " ")
    made = {"block_ord": pa.array(block[at]), "unit": pa.array(unit[at]), "kind": pa.array(columns["kind"][at], pa.string()), "text": text, "words": held}
    return listed(np.bincount(page[at], minlength=len(words)), made)


def blocks_of(page: np.ndarray, x: np.ndarray, y: np.ndarray, w: np.ndarray, h: np.ndarray, size: np.ndarray, first_w: np.ndarray, gaps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """block_ord and kind of each line, by the rules of `detect_blocks` and `with_kinds`."""
    top = np.append(True, page[1:] != page[:-1])[: len(page)]
    if not len(page):
        return np.zeros(0, np.int32), np.zeros(0, object)
    taller, low = np.maximum(h[:-1], h[1:]), y[1:] + h[1:]
    aligned = np.abs(x[:-1] - x[1:]) < 2 * taller
    shared = np.minimum(x[:-1] + w[:-1], x[1:] + w[1:]) - np.maximum(x[:-1], x[1:])
    breaks = np.append(False, (y[:-1] - low > 0.9 * taller) | (~aligned & (shared <= 0))) & ~top
    seen = np.cumsum(breaks)
    pages = np.flatnonzero(top)
    block_ord = (seen - np.repeat(seen[pages], np.diff(np.append(pages, len(page))))).astype(np.int32)
    starts = np.flatnonzero(top | breaks)
    sizes = np.diff(np.append(starts, len(page)))
    widest = np.maximum.reduceat(w, starts)
    inner = np.append(~(top | breaks)[1:], False)  # the next line is of the same block
    loose = inner & np.append(w[:-1] + 0.25 * size[1:] + first_w[1:] <= np.repeat(widest, sizes)[:-1] + 2, False)
    some, wide = (np.add.reduceat(c.astype(np.int64), starts) for c in (loose, gaps > 0))
    kind = np.where((sizes >= 2) & (wide >= 2), "table", np.where((sizes < 2) | (widest < 18 * size[starts]) | (some > 0), "lines", "paragraph")).astype(object)
    return block_ord, np.repeat(kind, sizes)


def line_columns(words: pa.Array) -> tuple[np.ndarray, dict[str, np.ndarray | pa.Array], np.ndarray, dict[str, pa.Array]]:
    """The page of each line, the lines' columns, how many words each has, and the columns of these words, line by line."""
    page, (word_ord, baseline, size, x, y, w, h) = flat(words, "word_ord", "baseline", "font_size", *"xywh")
    if not len(page):
        page = page[:0]
        word_ord, size = np.zeros(0, np.int32), np.zeros(0)
        x = y = w = h = baseline = size
    line_ord, line_baseline = fitted(page, word_ord, baseline, size)
    order = np.lexsort((word_ord, x, line_ord, page))
    page, line_ord, line_baseline, word_ord, size, x, y, w, h = (c[order] for c in (page, line_ord, line_baseline, word_ord, size, x, y, w, h))
    text = words.flatten().field("text").take(pa.array(order))
    starts, sizes = runs_of(page, line_ord)
    first = np.zeros(len(page), bool)
    first[starts] = True
    wide = np.append(False, x[1:] - (x[:-1] + w[:-1]) >= 1.5 * size[:-1])[: len(page)] & ~first
    chars = pc.utf8_length(text).to_numpy(zero_copy_only=False).astype(np.int64) + 1
    total = lambda how, c: how.reduceat(c, starts) if len(starts) else c
    low_x, low_y, right, top = total(np.minimum, x), total(np.minimum, y), total(np.maximum, x + w), total(np.maximum, y + h)
    pos = (np.arange(len(page)) - np.repeat(starts, sizes)).astype(np.int32)
    cell = (before(wide.astype(np.int64), starts, sizes) + wide).astype(np.int32)
    own = {"pos": pos, "word_ord": word_ord.astype(np.int32), "x": x, "y": y, "w": w, "h": h, "lead": before(chars, starts, sizes), "cell": cell}
    gaps = total(np.add, wide.astype(np.int64))
    block_ord, kind = blocks_of(page[starts], low_x, low_y, right - low_x, top - low_y, size[starts], w[starts], gaps)
    joined = pc.binary_join(pa.ListArray.from_arrays(pa.array(np.append(starts, len(page)).astype(np.int32)), text), " ")
    columns = {
        "line_ord": line_ord[starts], "x": low_x, "y": low_y, "w": right - low_x, "h": top - low_y, "baseline": line_baseline[starts], "n_words": sizes,
        "text": joined, "first_size": size[starts], "first_w": w[starts], "column_gaps": gaps, "n_chars": total(np.add, chars), "block_ord": block_ord, "kind": kind,
    }
    return page[starts], columns, sizes, {**{k: pa.array(v) for k, v in own.items()}, "text": text}


def gathered(words: DataFrame) -> DataFrame:
    """(doc_id, page, words): a row for each page, with all of its words. One exchange on the page, none if words are dealt by it."""
    return words.groupBy(*PAGE).agg(F.collect_list(F.struct(*(c for c in words.columns if c not in PAGE))).alias("words"))


def place_pages(pages: DataFrame) -> DataFrame:
    """place_words of gathered words."""
    placed = pages.select(*PAGE, "words", arrow_udf(word_places, PLACES)("words").alias("places"))
    rows = placed.select(*PAGE, F.explode(F.arrays_zip("words", "places")).alias("w"))
    return rows.select(*PAGE, "w.words.*", "w.places.*")


def place_words(words: DataFrame) -> DataFrame:
    """Add line_ord (from the top), line_baseline and pos (by x, ties in reading order) to words.

    One exchange on the page serves all. A row holds one page's words.
    """
    return place_pages(gathered(words))


def read_placed(pages: DataFrame, fonts: DataFrame | None, kept: Callable[[pa.RecordBatch], np.ndarray] | None = None) -> DataFrame:
    """place_words of what `pages` (doc_id, page, content) show: a page is read and its words placed where its stream lies.

    Only words for which `kept` is true of a batch of them are rows; the others have told where their lines are.
    """

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in shown_pages(batches, False, True):
            found = words_of(glyph_rows(held, GLYPHS))
            sizes = np.diff(np.append(np.flatnonzero(found.column("word_ord").to_numpy() == 0), len(found)))
            places = word_places(listed(sizes, {c: found.column(c) for c in ("word_ord", "baseline", "font_size", "x")})).flatten()
            for field in places.type:
                found = found.append_column(field.name, places.field(field.name))
            yield found if kept is None else found.filter(pa.array(kept(found)))

    return with_fonts(pages, fonts).mapInArrow(placed, f"{WORD_SCHEMA}, {PLACES[13:-2]}")


def page_lines(pages: DataFrame) -> DataFrame:
    """detect_lines of the placed words of pages, with block_ord and kind; words stay in the rows of their pages and lines.

    Spark does not know these rows to lie by page any more, so what groups them again should do without `words` and `text`.
    """
    return pages.select(*PAGE, F.inline(arrow_udf(lines_of_words, LINES)("words")))


def page_units(pages: DataFrame) -> DataFrame:
    """search_units of pages of words; nothing is shuffled."""
    return pages.select(*PAGE, F.inline(arrow_udf(units_of_words, UNITS)("words")))


def fold_lines(words: DataFrame) -> DataFrame:
    """place_words by the fold alone, page by page."""
    names = words.columns
    shape = words.select("*", F.lit(0).alias("line_ord"), F.lit(0.0).alias("line_baseline")).schema
    folded = words.groupBy(*PAGE).applyInPandas(lambda pdf: first_fit(pdf)[[*names, "line_ord", "line_baseline"]], shape)
    along = Window.partitionBy(*PAGE, "line_ord").orderBy("x", "word_ord")
    return folded.withColumn("pos", F.row_number().over(along) - 1)


def detect_lines(placed: DataFrame) -> DataFrame:
    """One row for each line: its box, baseline, text, first word and number of column gaps.

    `words` holds its words in order (pos, word_ord, text, x, y, w, h) with `lead`, the
    characters before each in the line's text, and `cell`, the column gaps before it; n_chars counts
    all characters, spaces too.
    """
    along = Window.partitionBy(*PAGE, "line_ord").orderBy("pos")
    gap = F.col("x") - (F.lag("x").over(along) + F.lag("w").over(along))
    gapped = placed.withColumn("wide", F.coalesce((gap >= 1.5 * F.lag("font_size").over(along)).cast("int"), F.lit(0)))
    before = F.sum(F.length("text") + 1).over(along.rowsBetween(Window.unboundedPreceding, -1))
    cell = F.sum("wide").over(along.rowsBetween(Window.unboundedPreceding, 0)).cast("int")
    led = gapped.withColumn("lead", F.coalesce(before, F.lit(0))).withColumn("cell", cell)
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "text"))), lambda t: t["text"]), " ")
    return led.groupBy(*PAGE, "line_ord").agg(
        F.min("x").alias("x"),
        F.min("y").alias("y"),
        (F.max(F.col("x") + F.col("w")) - F.min("x")).alias("w"),
        (F.max(F.col("y") + F.col("h")) - F.min("y")).alias("h"),
        F.min("line_baseline").alias("baseline"),
        F.count("*").alias("n_words"),
        text.alias("text"),
        F.min_by("font_size", "pos").alias("first_size"),
        F.min_by("w", "pos").alias("first_w"),
        F.sum("wide").alias("column_gaps"),
        F.sum(F.length("text") + 1).alias("n_chars"),
        F.array_sort(F.collect_list(F.struct("pos", "word_ord", "text", "x", "y", "w", "h", "lead", "cell"))).alias("words"),
    )
