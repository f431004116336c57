"""Pages lexed and folded where they lie, against operations as rows."""

from glyphweave.plans import catalog
from glyphweave.sources import content, lexing

STREAMS = [
    b"BT /F1 12 Tf 72 700 Td (Hello) Tj ET",
    b"BT /F1 10 Tf 0.5 Tc 3 Tw 1 0.2 -0.2 1 72 700 Tm [(He) -20 <6c6c6f> 7 (a b)] TJ 14 TL (x y) ' 1 2 (q) \" ET 9 9 [1",
    b"(lost) 1 2",
    b"",
    b"0 1 0 1 0 0 cm BT /F1 8 Tf 2 Ts 50 Tz (never closed",
    b"q 2 0 0 2 5 5 cm BT /#461 9 Tf (a\\)b) Tj << /K [1 2] >> BDC T* (c) Tj ET Q Q % note",
    b"% only a note (",
    b"BI /W 1 ID \x00 EI BT /F1 7 Tf /F9 7 Tf (unknown) Tj /F1 7 Tf (known) Tj ET BI /W 2 ID zz",
    b"/ /A/B <41> ] > >> 5-3 true null ] Tj BT /F1 6 Tf (end) Tj",
]
FONT = (1, 0, "F1", "Type1", "Helvetica", "WinAnsiEncoding", None, None, None, None, False)


def test_streams_lexed_at_once_are_as_one_by_one():
    found, bounds = lexing.lex_all(STREAMS)
    offset = 0
    for k, stream in enumerate(STREAMS):
        alone, (a, b) = lexing.lex(stream), bounds[k : k + 2]
        assert found.names[a:b] == alone.names
        assert (found.starts[a:b] - offset).tolist() == alone.starts.tolist() and (found.ends[a:b] - offset).tolist() == alone.ends.tolist()
        at, end = found.offsets[a], found.offsets[b]
        for column in ("arg", "item", "kind", "num"):
            assert str(getattr(found, column)[at:end].tolist()) == str(getattr(alone, column).tolist())
        assert found.raw[at:end] == alone.raw
        offset += len(stream) + 1
    assert bounds[-1] == len(found.names)


def test_glyphs_are_those_of_operations_as_rows(spark):
    rows = [(k // 4, k % 4, bytearray(s)) for k, s in enumerate([*STREAMS, None]) if s is not None]
    pages = spark.createDataFrame([*rows, (7, 0, None), (8, 0, bytearray(STREAMS[0]))], "doc_id long, page int, content binary")
    fonts = spark.createDataFrame([(d, p, *FONT[2:]) for d, p, _ in rows], content.FONT_SCHEMA)
    want = content.extract_glyphs(content.parse_operations(pages, piece=None), fonts)
    for strict in (False, True):
        want = content.extract_glyphs(content.parse_operations(pages, piece=None), fonts, strict)
        assert want.count() > 20
        made = content.read_glyphs(pages, fonts, strict)
        assert made.schema == want.schema and sorted(map(str, made.collect())) == sorted(map(str, want.collect()))
    some = ("unicode", "doc_id", "glyph_ord")
    assert sorted(map(str, content.read_glyphs(pages, fonts, columns=some).collect())) == sorted(map(str, content.extract_glyphs(content.parse_operations(pages, piece=None), fonts).select(*some).collect()))


def test_operations_are_not_shuffled(spark, sf):
    plan = catalog.content_glyphs(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "operands" not in plan and plan.count("MapInArrow") == 1
