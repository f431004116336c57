"""Edits made where pages lie, against edits over rows of operations and glyphs."""

import pytest
from pyspark.sql import functions as F

from glyphweave.operators import edits, lines, words
from glyphweave.plans import catalog
from glyphweave.sources import content

STREAMS = [
    b"BT /F1 14 Tf 72 700 Td (SECRET) Tj 0 -100 Td [(PUB) -20 (LIC)] TJ ET",
    b"q 2 0 0 2 5 5 cm BT /F1 9 Tf 0.5 Tc 14 TL 10 90 Td (first line) ' (x\\)y) Tj T* <41> Tj ET Q",
    b"BT /F1 10 Tf 1 0.2 -0.2 1 72 700 Tm [(He) -20 <6c6c6f> 7 (a b)] TJ /F9 7 Tf (unknown) Tj /F1 9 Tf (fi) Tj ET",
    b"BT /F2 8 Tf (two  words) Tj /F1 8 Tf (more) Tj ET",
    b"",
    b"BT /F1 0 Tf (nothing) Tj ET",
]
FONT = (1, 0, "F1", "Type1", "Helvetica", "WinAnsiEncoding", None, None, None, None, False)
WIDE = (3, 0, "F2", "Type0", "Any", None, None, {0x7477: "t", 0x6F20: " ", 0x2077: "w"}, {0x7477: 700.0}, None, True)


@pytest.fixture
def parts(spark):
    pages = spark.createDataFrame([(k, 0, bytearray(s)) for k, s in enumerate(STREAMS)], "doc_id long, page int, content binary")
    fonts = spark.createDataFrame([*((k, *FONT[1:]) for k in range(len(STREAMS))), WIDE], content.FONT_SCHEMA)
    ops = content.parse_operations(pages, piece=None)
    held = pages.join(fonts.groupBy("doc_id", "page").agg(F.collect_list(F.struct(*fonts.columns[2:])).alias("fonts")), ["doc_id", "page"])
    return pages, fonts, ops, content.extract_glyphs(ops, fonts), held


def rows(df):
    return sorted(map(str, df.collect()))


def test_words_read_from_pages(parts):
    _, _, _, glyphs, held = parts
    want = words.detect_words(glyphs)
    assert want.count() > 8
    assert rows(words.read_words(held, None).select(*want.columns)) == rows(want) == rows(words.page_words(glyphs).select(*want.columns))
    placed = lines.read_placed(held, None)
    assert rows(placed) == rows(lines.place_words(want).select(*placed.columns))


def test_strings_and_counts_are_those_of_glyphs(parts):
    _, _, _, glyphs, held = parts
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("glyph_ord", "unicode"))), lambda g: g["unicode"]), "")
    want = glyphs.groupBy("doc_id", "page", "op_index", "item_index").agg(F.min("glyph_ord").alias("glyph_lo"), F.max("glyph_ord").alias("glyph_hi"), text.alias("text"), F.first("height").alias("height"))
    assert rows(content.read_strings(held, None).select(*want.columns)) == rows(want)
    counts = {r[0]: r[1] for r in held.select("doc_id", content.count_glyphs(F.col("content"), F.col("fonts"))).collect()}
    assert counts == {k: 0 for k in range(len(STREAMS))} | {r.doc_id: r["count"] for r in glyphs.groupBy("doc_id").count().collect()}


def test_streams_lexed_in_place_are_edited_as_operations(parts):
    pages, fonts, ops, glyphs, _ = parts
    found = words.detect_words(glyphs).where("word_ord = 0 and font_res = 'F1'")
    for text in ("new text", "Zebra € or wrapped at last", "Świat"):
        targets = found.select("doc_id", "page", "glyph_lo", "glyph_hi", "font_res", "font_size", F.lit(text).alias("new_text"), F.lit(50.0).alias("max_width"), F.lit(9.0).alias("leading"))
        for made in (edits.rewrite_text, lambda *a: (edits.replace_text(*a), None)):
            want, there = made(pages, ops, glyphs, fonts, targets)[0], made(pages, None, glyphs, fonts, targets)[0]
            assert want.count() == 3 and rows(there) == rows(want)


@pytest.mark.parametrize("name", ["content_fallback", "content_redact", "content_reflow", "content_replace", "content_highlight"])
def test_edits_shuffle_neither_operations_nor_whole_pages_of_glyphs(spark, sf, name):
    """Operations and glyphs of all pages were rows, for each of an edit's branches."""
    plan = catalog.QUERIES[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "operands" not in plan and "FlatMapCoGroups" not in plan
    assert plan.count("MapInArrow") + plan.count("ArrowEvalPython") <= 6


def test_pages_of_any_length_are_read_alike(spark, parts):
    """Where they lie up to a length, by pieces and blocks beyond it."""
    pages, _, _, glyphs, held = parts
    lengths = [len(s) for s in STREAMS]
    assert min(lengths) < 60 < max(lengths)
    assert rows(content.read_all_glyphs(held, max(lengths))) == rows(content.read_all_glyphs(held, None, whole=60)) == rows(content.read_all_glyphs(held, max(lengths), whole=60)) == rows(glyphs)


def test_long_pages_are_read_once(spark, sf):
    """Pages of labels were read three times to be cut, and their operations were rows."""
    plan = catalog.content_long_glyphs(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "operands" not in plan and plan.count("MapInArrow") == 1 and plan.count("Exchange hashpartitioning") == 1


def test_bars_read_words_once(spark, sf):
    """Words were read and placed once for the bars and once for the regions without any."""
    plan = catalog.content_redact(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 2
