"""Content streams: operations, fonts, glyphs, and the whole way to words."""

import json
import random

import pytest
from pyspark.sql import functions as F

from glyphweave.operators import lines, words
from glyphweave.plans import bridge
from glyphweave.sources import content, lexing


def ops(data):
    return [(op, args) for op, args, _, _ in content.operations(data)]


def s(text):
    return {"s": text.encode("latin-1").hex()}


@pytest.mark.parametrize(
    "data, want",
    [
        (b"BT /F1 12 Tf 72 700 Td (Hello World) Tj ET", [("BT", []), ("Tf", [{"n": "F1"}, 12.0]), ("Td", [72.0, 700.0]), ("Tj", [s("Hello World")]), ("ET", [])]),
        (b"[(He) -20 (llo)] TJ", [("TJ", [[s("He"), -20.0, s("llo")]])]),
        (rb"(a\(b\)\\ \101\n(in) \q) Tj", [("Tj", [s("a(b)\\ A\n(in) q")])]),
        (b"(a\\\nb\r\nc) Tj", [("Tj", [s("ab\nc")])]),
        (b"<48 65 7> Tj", [("Tj", [s("Hep")])]),
        (b"/F#31 8 Tf % note (x\n(y) Tj", [("Tf", [{"n": "F1"}, 8.0]), ("Tj", [s("y")])]),
        (b"BI /W 2 ID \x01EI\x02 EI Q", [("BI", []), ("Q", [])]),
        (b"/P <</MCID 3 /X [1 true null]>> BDC", [("BDC", [{"n": "P"}, {"d": [["MCID", 3.0], ["X", [1.0, True, None]]]}])]),
        (b"1 2 (a) \" (b) ' --3 .5- w", [('"', [1.0, 2.0, s("a")]), ("'", [s("b")]), ("w", [0.0, -3.0, 0.5, 0.0])]),
        (b"(open", []),
        (b"", []),
    ],
)
def test_operations(data, want):
    assert ops(data) == want


def test_byte_ranges():
    data = b" q  1 0 0 1 5 5 cm\n(x) Tj"
    assert [data[a:b] for _, _, a, b in content.operations(data)] == [b"q", b"1 0 0 1 5 5 cm", b"(x) Tj"]


def test_cmap():
    cmap = b"2 beginbfchar <01> <0041> <02> <00660069> endbfchar 2 beginbfrange <10> <12> <0061> <20> <21> [<0058> <0059>] endbfrange"
    assert content.parse_cmap(cmap) == {1: "A", 2: "fi", 16: "a", 17: "b", 18: "c", 32: "X", 33: "Y"}


def test_simple_encoding():
    enc = content.simple_encoding("WinAnsiEncoding", [65, "eacute", "nosuchname", 70, "Z"])
    assert (enc[65], enc.get(66), enc[70], enc[0x80]) == ("é", None, "Z", "€")


def tables(spark, stream, font=None):
    pages = spark.createDataFrame([(1, 0, bytearray(stream)), (2, 0, None)], "doc_id long, page int, content binary")
    row = {"doc_id": 1, "page": 0, "font_res": "F1", "subtype": "Type1", "base_font": "Helvetica", "encoding": "WinAnsiEncoding", "differences": None, "to_unicode": None, "widths": None, "default_width": None, "two_byte": False}
    fonts = spark.createDataFrame([row | (font or {})], content.FONT_SCHEMA)
    return content.extract_glyphs(content.parse_operations(pages), fonts)


def test_glyphs_to_words(spark):
    stream = b"BT /F1 12 Tf 14 TL 72 700 Td (Hello World) Tj T* [(He) -20 (llo)] TJ (next) ' ET q 2 0 0 2 0 0 cm BT 10 10 Td (big) Tj /F9 9 Tf (lost) Tj ET Q"
    glyphs = tables(spark, stream)
    found = words.detect_words(glyphs).orderBy("word_ord").collect()
    assert [w.text for w in found] == ["Hello", "World", "Hello", "next", "big"]
    first = found[0]
    assert (first.x, first.baseline, first.font_size) == (72.0, 700.0, 12.0) and abs(first.w - 2.278 * 12) < 1e-9
    assert (found[2].baseline, found[3].baseline, found[4].x, found[4].h) == (686.0, 672.0, 20.0, 24.0)
    spans = glyphs.where("op_index = 6").orderBy("glyph_ord").collect()
    assert [(g.item_index, g.byte_offset) for g in spans] == [(0, 0), (0, 1), (2, 0), (2, 1), (2, 2)]
    assert lines.place_words(words.detect_words(glyphs)).select("line_ord").distinct().count() == 4


def test_spacing_scale_and_rise(spark):
    found = tables(spark, b"BT /F1 10 Tf 1 Tc 5 Tw 50 Tz 3 Ts 0 0 Td (a b) Tj ET").orderBy("glyph_ord").collect()
    assert [round(g.x, 6) for g in found] == [0.0, (5.56 + 1) * 0.5, round((5.56 + 1) * 0.5 + (2.78 + 6) * 0.5, 6)]
    assert {g.y for g in found} == {3.0} and round(found[0].width, 6) == 2.78


def test_two_byte_font(spark):
    font = {"subtype": "Type0", "two_byte": True, "to_unicode": {258: "Ω"}, "widths": {258: 700.0}, "encoding": None}
    found = tables(spark, b"BT /F1 10 Tf <01020103FF> Tj ET", font).orderBy("glyph_ord").collect()
    assert [(g.unicode, g.code, g.byte_offset, g.width) for g in found] == [("Ω", 258, 0, 7.0), ("", 259, 2, 10.0)]


def test_encode():
    font = content.Font({"base_font": "Helvetica", "subtype": "Type1", "differences": json.dumps([200, "A"])})
    assert font.encode("AB") == b"AB" and font.encode("Ω") is None


PARTS = [
    *(b"q", b"Q", b"1", b"-2.5", b"12cm", b"--3", b".5-", b"1.2.3", b"+", b".", b"/F1", b"/", b"/A#20b", b"(", b")", b"\\", b"(a(b)c)", b"(x\\)", b"<48>", b"<", b">", b"<<", b">>", b"["),
    *(b"]", b"{", b"}", b"%c", b"\n", b"\r", b" ", b" ", b" ", b"BI", b"1BI", b"/BI", b"ID", b" EI ", b"EI", b"true", b"null", b"Tj", b"TJ", b"xBI", b"\x00", b"\xff", b"123456789012345678"),
    *(b"0.1", b"<</K 1>>", b"[(a) -20 <41> /N true]", b"[[1] 2]", b"((", b"))"),
]


def stream(rng, n):
    return b"".join(rng.choice(PARTS) + rng.choice([b"", b" "]) for _ in range(rng.randint(0, n)))


def test_whole_arrays_read_as_the_plain_reader():
    rng = random.Random(7)
    for _ in range(4000):
        data = stream(rng, 25)
        found = lexing.lex(data)
        rows = list(zip(found.arg.tolist(), found.item.tolist(), found.kind.tolist(), found.num.tolist(), found.raw, strict=True))
        got = [(n, rows[a:b], s, e) for n, a, b, s, e in zip(found.names, found.offsets[:-1], found.offsets[1:], found.starts.tolist(), found.ends.tolist(), strict=True)]
        assert repr(got) == repr([(op, lexing.leaves(args), a, b) for op, args, a, b in content.operations(data)]), data


def parsed(df):
    return sorted((r.doc_id, r.op_index, r.op, repr(lexing.values_of([o.asDict() for o in r.operands])), r.start, r.end) for r in df.collect())


def test_cut_pages_read_as_whole_ones(spark):
    rng = random.Random(11)
    rows = [(k, 0, bytearray(stream(rng, 300))) for k in range(150)] + [(900, 0, None), (901, 0, bytearray(b"")), (902, 0, bytearray(b"(" * 500)), (903, 0, bytearray(b"(a b) Tj " * 200))]
    pages = spark.createDataFrame(rows, "doc_id long, page int, content binary").repartition(3)
    want = [(k, n, op, repr(args), a, b) for k, _, data in rows for n, (op, args, a, b) in enumerate(content.operations(bytes(data or b"")))]
    assert parsed(content.parse_operations(pages)) == sorted(want)
    assert parsed(content.parse_operations(pages, piece=23)) == sorted(want)


def test_segments_show_as_whole_pages(spark):
    rng = random.Random(3)
    said = ["q", "q", "Q", "Q", "Q", "2 0 0 2 1 1 cm", "0 1 -1 0 3 0 cm", "BT", "ET", "/F1 9 Tf", "/F2 4 Tf", "/F9 4 Tf", "1 0 0 1 5 6 Tm", "3 4 Td", "1 -2 TD", "T*", "12 TL", "1 Tc", "2 Tw", "50 Tz", "3 Ts"]
    shows = ["(ab c) Tj", "(x) '", '1 2 (y) "', "[(p) -120 (q r)] TJ", "<4142> Tj", "[" + "(m)" * 40 + "] TJ"]
    rows = [(k, 0, bytearray(" ".join(rng.choice(said if rng.random() < 0.6 else shows) for _ in range(rng.randint(0, 120))).encode())) for k in range(60)]
    pages = spark.createDataFrame(rows, "doc_id long, page int, content binary")
    font = {"page": 0, "subtype": "Type1", "base_font": "Helvetica", "encoding": "WinAnsiEncoding", "differences": None, "to_unicode": None, "widths": None, "default_width": None, "two_byte": False}
    fonts = spark.createDataFrame([font | {"doc_id": k, "font_res": f, "base_font": b} for k in range(60) for f, b in (("F1", "Helvetica"), ("F2", "Courier"))], content.FONT_SCHEMA)
    parsed_ops = content.parse_operations(pages).cache()
    for strict in (False, True):
        whole = sorted(map(tuple, content.extract_glyphs(parsed_ops, fonts, strict, block=10**6).collect()), key=lambda r: (r[0], r[2]))
        cut = sorted(map(tuple, content.extract_glyphs(parsed_ops, fonts, strict, block=7).collect()), key=lambda r: (r[0], r[2]))
        assert len(whole) > 2000 and len({r[:3] for r in whole}) == len(whole)
        for a, b in zip(whole, cut, strict=True):
            assert a[:5] == b[:5] and a[9:] == b[9:] and b[5:9] == pytest.approx(a[5:9])


@pytest.mark.parametrize("made", [lambda *a: bridge.drawing_pages(*a), lambda *a: bridge.label_pages(*a)[0]])
def test_pages_of_items_do_not_follow_the_order_of_rows(spark, sf, tmp_path, made):
    """Long pages are read several times: they must be the same each time, in whatever order their rows arrive."""
    items, read = spark.read.parquet(f"{sf}/lineitem.parquet"), []
    for n, by in enumerate((F.xxhash64("l_orderkey", "l_partkey"), F.xxhash64("l_partkey", "l_suppkey"))):
        items.repartition(3, by).sortWithinPartitions(by).write.parquet(f"{tmp_path}/{n}/lineitem.parquet")
        read.append({r["doc_id"]: bytes(r["content"]) for r in made(spark, f"{tmp_path}/{n}", 2500).collect()})
    assert read[0] == read[1]
