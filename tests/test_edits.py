"""Edits of page content, read back through the parser."""

import pytest
from pyspark.sql import functions as F

from glyphweave.operators import edits, lines, words
from glyphweave.sources import content

STREAM = b"BT /F1 14 Tf 72 700 Td (SECRET) Tj 0 -100 Td [(PUB) -20 (LIC)] TJ ET"


def test_values_come_back():
    data = rb"/A#20b <</K (x\)y) /L [1 -2.5 true null]>> (\001\n) 0.333333 op"
    ((op, args, _, _),) = content.operations(data)
    again = edits.operation_bytes(op, args)
    assert [x[:2] for x in content.operations(again)] == [(op, args)]


def test_splices():
    assert edits.splice(b"abcdef", [(4, 5, b""), (0, 2, b"XY"), (2, 2, b"-")]) == b"XY-cdf"
    assert edits.splice(b"abcdef", [(0, 5, b"1"), (5, 6, b"2")]) == b"12"
    with pytest.raises(ValueError):
        edits.splice(b"abcdef", [(0, 5, b""), (4, 6, b"")])


@pytest.fixture
def parts(spark):
    pages = spark.createDataFrame([(1, 0, bytearray(STREAM)), (1, 1, bytearray(STREAM))], "doc_id long, page int, content binary")
    row = {"font_res": "F1", "subtype": "Type1", "base_font": "Helvetica", "encoding": "WinAnsiEncoding", "differences": None, "to_unicode": None, "widths": None, "default_width": None, "two_byte": False}
    fonts = spark.createDataFrame([row | {"doc_id": 1, "page": p} for p in (0, 1)], content.FONT_SCHEMA)
    ops = content.parse_operations(pages, piece=None)
    glyphs = content.extract_glyphs(ops, fonts)
    return pages, fonts, ops, glyphs, lines.place_words(words.detect_words(glyphs))


TARGET = "doc_id long, page int, glyph_lo long, glyph_hi long, font_res string, font_size double, new_text string, max_width double, leading double"


def at(op, k):
    return (op << 31) + k


def with_fonts(fonts, more):
    return fonts.unionByName(more.select("*", F.lit(False).alias("two_byte")), allowMissingColumns=True)


def test_wrapping():
    wide = lambda t: 6.0 * len(t) if "?" not in t else None
    assert edits.wrapped("aa bb cc", wide, 30) == ["aa bb", "cc"]
    assert edits.wrapped("abcdefgh b", wide, 30) == ["abcdefgh", "b"]
    assert edits.wrapped("a? bbbbbbbbbb", wide, 30) == ["a? bbbbbbbbbb"]
    assert edits.wrapped("aa bb", wide, None) == ["aa bb"] and edits.wrapped("", wide, 3) == [""]


def test_operations_taken_apart():
    lines = edits.Insert(None, 2, 4, b"", [b"one", b"two"], None, "F1", 12.0, 14.5)
    assert edits.rebuilt_operation("Tj", [{"s": b"abCDef".hex()}], [lines]) == b"(ab) Tj (one) Tj 0 -14.5 Td (two) Tj (ef) Tj"
    assert edits.rebuilt_operation("'", [{"s": b"abCD".hex()}], [lines]) == b"T* (ab) Tj (one) Tj 0 -14.5 Td (two) Tj"
    assert edits.rebuilt_operation('"', [1.0, 2.0, {"s": b"abCD".hex()}], [lines]).startswith(b"1 Tw 2 Tc T* (ab) Tj")
    other = edits.Insert(1, 0, 2, b"", [b"x"], "A2FB", "F1", 9.25)
    gone = edits.Insert(3, 0, 1, b"")
    array = [-5.0, {"s": b"CD".hex()}, 7.0, {"s": b"yz".hex()}]
    assert edits.rebuilt_operation("TJ", [array], [other, gone]) == b"[-5] TJ /A2FB 9.25 Tf (x) Tj /F1 9.25 Tf [7 (z)] TJ"


def test_paragraph_rewraps(spark):
    shown = ["Invoice total", "due on payment", "of the goods"]
    stream = b"BT /F1 12 Tf 2 0 0 2 50 600 Tm " + b" ".join((b"0 -14 Td " if k else b"") + b"(" + t.encode() + b") Tj" for k, t in enumerate(shown)) + b" ET BT /F1 12 Tf 50 100 Td (below) Tj ET"
    pages = spark.createDataFrame([(1, 0, bytearray(stream))], "doc_id long, page int, content binary")
    row = {"doc_id": 1, "page": 0, "font_res": "F1", "subtype": "Type1", "base_font": "Helvetica", "encoding": "WinAnsiEncoding", "differences": None, "to_unicode": None, "widths": None, "default_width": None, "two_byte": False}
    fonts = spark.createDataFrame([row], content.FONT_SCHEMA)
    ops = content.parse_operations(pages, piece=None)
    glyphs = content.extract_glyphs(ops, fonts)
    old = glyphs.where("y > 200").agg(F.min("glyph_ord"), F.max("glyph_ord"), F.max(F.col("x") + F.col("width"))).first()
    text = "This replacement paragraph is deliberately long enough that it cannot possibly fit on a single line and must therefore wrap"
    targets = spark.createDataFrame([(1, 0, old[0], old[1], "F1", 12.0, text, old[2] - 50 + 2, 28.0)], TARGET)
    done, more = edits.rewrite_text(pages, ops, glyphs, fonts, targets)
    assert more.count() == 0 and done.first().error is None
    found = words.detect_words(content.extract_glyphs(content.parse_operations(done, piece=None), fonts)).orderBy("word_ord").collect()
    assert [w.text for w in found] == [*text.split(), "below"]
    rows = sorted({w.baseline for w in found[:-1]}, reverse=True)
    assert len(rows) > 3 and rows[0] == 600 and all(abs(a - b - 28) < 1e-9 for a, b in zip(rows, rows[1:], strict=False))
    for y in rows:
        line = [w for w in found if w.baseline == y]
        assert line[0].x == 50 and max(w.x + w.w for w in line) <= old[2] + 2
    assert (found[-1].x, found[-1].baseline) == (50, 100)


def test_stand_in_font(spark, parts):
    pages, fonts, ops, glyphs, _ = parts
    named = fonts.unionByName(fonts.where("page = 1").withColumn("font_res", F.explode(F.array(F.lit("A2FB"), F.lit("A2FB1"), F.lit("A2FB3"), F.lit("A2FB0"), F.lit("A2FBx")))))
    subset = named.withColumn("subtype", F.lit("Type0")).withColumn("encoding", F.lit(None).cast("string"))
    targets = spark.createDataFrame(
        [(1, 0, at(3, 0), at(3, 5), "F1", 14.0, "Zebra", None, None), (1, 1, at(5, 0), at(5, 5), "F1", 14.0, "Zebra \u20ac x", 55.0, 20.0), (1, 1, at(3, 0), at(3, 2), "F1", 14.0, "\u015awiat", None, None)], TARGET
    )
    done, more = edits.rewrite_text(pages, ops, glyphs, subset, targets)
    assert sorted((r.page, r.font_res, r.base_font) for r in more.collect()) == [(0, "A2FB", "Helvetica"), (1, "A2FB2", "Helvetica")]
    got = {r.page: r for r in done.collect()}
    assert got[0].error is None and b"/A2FB 14 Tf (Zebra) Tj /F1 14 Tf" in bytes(got[0].content)
    assert "encode" in got[1].error and b"/A2FB2 14 Tf (Zebra \\200) Tj 0 -20 Td (x) Tj /F1 14 Tf" in bytes(got[1].content)
    assert texts(done, with_fonts(fonts, more)) == {0: ["Zebra", "PUBLIC"], 1: ["SECRET", "Zebra", "\u20ac", "x"]}


def texts(changed, fonts):
    glyphs = content.extract_glyphs(content.parse_operations(changed, piece=None), fonts)
    return {p: [r.text for r in words.detect_words(glyphs).where(F.col("page") == p).orderBy("word_ord").collect()] for p in (0, 1)}


def region(spark, *box):
    return spark.createDataFrame([(1, 1, 0, *map(float, box))], "region_id long, doc_id long, page int, rx double, ry double, rw double, rh double")


def test_redaction_removes_bytes(spark, parts):
    pages, fonts, ops, glyphs, placed = parts
    done = edits.redact(pages, ops, glyphs, placed, region(spark, 60, 695, 200, 25))
    row = done.first()
    assert (row.page, row.n_removed, row.n_bars, row.error) == (0, 6, 1, None)
    assert b"SECRET" not in bytes(row.content) and b" re f Q" in bytes(row.content)
    assert texts(done, fonts)[0] == ["PUBLIC"]
    empty = edits.redact(pages, ops, glyphs, placed, region(spark, 400, 100, 50, 50)).first()
    assert (empty.n_removed, empty.n_bars) == (0, 1)


def test_highlight(spark, parts):
    pages, fonts, _, _, placed = parts
    done = edits.highlight(pages, placed, region(spark, 60, 595, 200, 25))
    assert done.count() == 1 and bytes(done.first().content).startswith(b"q 1 0.906 0.31 rg ")
    assert texts(done, fonts)[0] == ["SECRET", "PUBLIC"]
    assert edits.highlight(pages, placed, region(spark, 400, 100, 50, 50)).count() == 0


def test_replacement(spark, parts):
    pages, fonts, ops, glyphs, _ = parts
    schema = "doc_id long, page int, glyph_lo long, glyph_hi long, font_res string, new_text string"
    targets = spark.createDataFrame([(1, 0, 5 << 31, (5 << 31) + 5, "F1", " new\n text "), (1, 1, 0, 5, "F1", "Świat")], schema)
    done = edits.replace_text(pages, ops, glyphs, fonts, targets)
    got = {r.page: r.error for r in done.collect()}
    assert got[0] is None and "encode" in got[1]
    assert texts(done, fonts) == {0: ["SECRET", "new", "text"], 1: ["SECRET", "PUBLIC"]}


def test_edits_read_pages_few_times(spark, sf):
    """Pages were parsed and folded for every branch of an edit: 47 Arrow stages in a reflow."""
    from glyphweave.plans.catalog import QUERIES

    plan = QUERIES["content_reflow"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") <= 10
