"""Layout operators against loops that restate their rules, and hand-made pages."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from glyphweave.functions import fontmetrics, geometry, text
from glyphweave.operators import blocks, lines, pageops, placement, records, regions, search, vector, words
from glyphweave.plans import bridge
from glyphweave.plans.bridge import layout


def glyph_rows(spark, runs):
    """runs: (text, x, y, size, font), set with Helvetica widths, in order."""
    rows = []
    for op, (s, x, y, size, font) in enumerate(runs):
        for k, c in enumerate(s):
            w = fontmetrics.standard_width(font, ord(c)) / 1000 * size
            rows.append((1, 0, len(rows), c, x, y, w, size, font, size, op, None, k, 1))
            x += w
    return spark.createDataFrame(rows, "doc_id long, page int, glyph_ord long, unicode string, x double, y double, width double, height double, font_res string, font_size double, op_index int, item_index int, byte_offset int, byte_length int")


PAGE = [
    ("Mixed page heading", 72.0, 730.0, 18.0, "Helvetica"),
    ("Jane Doe", 72.0, 690.0, 12.0, "Helvetica"),
    ("12 Main Street", 72.0, 675.0, 12.0, "Helvetica"),
    ("Item         Qty    Price", 72.0, 620.0, 10.0, "Courier"),
    ("Bird seed    5      20.00", 72.0, 606.0, 10.0, "Courier"),
    ("Anvil        1      99.00", 72.0, 592.0, 10.0, "Courier"),
    ("This paragraph is long enough to wrap over more than one line of", 72.0, 520.0, 12.0, "Helvetica"),
    ("text, because the words keep coming until the measure is full and", 72.0, 505.0, 12.0, "Helvetica"),
    ("the invoice date ends it.", 72.0, 490.0, 12.0, "Helvetica"),
]


def test_kinds_and_cells(spark):
    found = words.detect_words(glyph_rows(spark, PAGE))
    placed, found_lines, found_blocks = layout(found)
    kinds = [r.kind for r in found_blocks.orderBy("block_ord").collect()]
    assert kinds == ["lines", "lines", "table", "paragraph"]
    cells = blocks.group_cells(placed).orderBy("line_ord", "cell").collect()
    by_line = {}
    for c in cells:
        by_line.setdefault(c.line_ord, []).append(c.text)
    assert by_line[4] == ["Bird seed", "5", "20.00"]
    assert len(by_line[6]) == 1
    units = search.search_units(found_lines)
    hits = lambda q, **k: search.find_phrase(units, q, **k).count()
    assert hits("line of text") == 1  # across the wrap of a paragraph
    assert hits("Price Bird") == 0  # but not across table rows
    assert hits("nvoice", whole_word=True) == 0 and hits("nvoice") == 1
    assert hits("INVOICE") == 1 and hits("INVOICE", case_sensitive=True) == 0
    assert hits("   ") == 0


def test_search_uses_up_rejected_hits(spark):
    unit = spark.createDataFrame([(1, 0, 0, 0, "xa a a"), (2, 0, 0, 0, r"a\E b \E"), (3, 0, 0, 0, "aaaa")], "doc_id long, page int, block_ord int, unit int, text string")
    entry = "transform(sequence(0, length(text) - 1), k -> struct(k as offset, substr(text, k + 1, 1) as text, 0D as x, 0D as y, 1D as w, 1D as h, k as word_ord))"
    units = unit.withColumn("words", F.expr(entry))
    got = lambda q, **k: [(r.doc_id, r.offset) for r in search.find_phrase(units, q, **k).orderBy("doc_id", "offset").collect()]
    assert got("a a", whole_word=True) == []
    assert got("a a") == [(1, 1)]
    assert got(r"\E") == [(2, 1), (2, 6)]
    assert got("aa") == [(3, 0), (3, 2)]


def naive_words(rows):
    out, cur = [], []
    for g in rows:
        if g["unicode"] in (" ", " ", ""):
            out += [cur] if cur else []
            cur = []
            continue
        if cur:
            p = cur[-1]
            gap = g["x"] - (p["x"] + p["width"])
            same = g["font_res"] == p["font_res"] and abs(g["font_size"] - p["font_size"]) < 0.01 and abs(g["y"] - p["y"]) < 0.15 * g["height"]
            if not same or gap > 0.19 * g["height"] + 0.5 or gap < -g["height"]:
                out.append(cur)
                cur = []
        cur.append(g)
    return ["".join(g["unicode"] for g in w) for w in out + ([cur] if cur else [])]


def test_words_equal_the_loop(spark):
    rng = np.random.default_rng(3)
    rows, x = [], 0.0
    for k in range(3000):
        x += 6 + rng.choice([0, 0, 0, 2.7, 2.79, 4, -17.9, -18.1])
        rows.append((k // 500, 0, k, str(rng.choice(list("abc") + [" ", " ", ""])), float(x), float(rng.choice([100, 100, 100, 101.7, 101.9])), 6.0, 12.0, str(rng.choice(["F1"] * 9 + ["F2"])), float(rng.choice([12.0] * 8 + [12.009, 12.02]))))
    schema = "doc_id long, page int, glyph_ord long, unicode string, x double, y double, width double, height double, font_res string, font_size double"
    got = words.detect_words(spark.createDataFrame(rows, schema)).orderBy("doc_id", "word_ord").collect()
    want = []
    for d in range(6):
        mine = [dict(zip(("unicode", "x", "y", "width", "height", "font_res", "font_size"), r[3:], strict=True)) for r in rows if r[0] == d]
        want += [(d, w) for w in naive_words(mine)]
    assert [(r.doc_id, r.text) for r in got] == want


@pytest.mark.parametrize("steps", [[0, 12, 24], [0, 0.9, 1.8, 12, 12.95], [0, 2.4, 2.6, 5.0]])
def test_lines_equal_the_fold(spark, steps):
    rng = np.random.default_rng(len(steps))
    rows = [(d, 0, k, f"w{k}", float(rng.integers(0, 500)), 700.0 - float(rng.choice(steps)), float(rng.choice([4.0, 10.0]))) for d in range(4) for k in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, page int, word_ord long, text string, x double, baseline double, font_size double")
    key = ["doc_id", "word_ord", "line_ord", "line_baseline", "pos"]
    plain = [tuple(r) for r in lines.place_words(df).select(*key).orderBy("doc_id", "word_ord").collect()]
    fold = [tuple(r) for r in lines.fold_lines(df).select(*key).orderBy("doc_id", "word_ord").collect()]
    assert plain == fold


def test_first_fit_depends_on_order():
    page = lambda ys: pd.DataFrame({"word_ord": range(len(ys)), "baseline": ys, "font_size": 4.0})
    assert lines.first_fit(page([10.0, 10.9, 11.8]))["line_ord"].nunique() == 2
    assert lines.first_fit(page([10.9, 10.0, 11.8]))["line_ord"].nunique() == 1


def test_redaction(spark):
    glyphs = glyph_rows(spark, [("SECRET", 72.0, 700.0, 14.0, "Helvetica"), ("a b", 72.0, 600.0, 14.0, "Helvetica")])
    region = lambda *r: spark.createDataFrame([(1, 1, 0, *map(float, r))], "region_id long, doc_id long, page int, rx double, ry double, rw double, rh double")
    spans = regions.redaction_spans(glyphs, region(60, 695, 200, 25)).collect()
    assert [(s.op_index, s.span_start, s.span_end, s.n_glyphs) for s in spans] == [(0, 0, 6, 6)]
    assert regions.redaction_spans(glyphs, region(400, 100, 50, 50)).count() == 0
    assert regions.redaction_spans(glyphs, region(60, 680, 200, 19.9)).count() == 0  # only below the baseline
    placed = lines.place_words(words.detect_words(glyphs))
    assert regions.redaction_bars(placed, region(400, 100, 50, 50)).count() == 1
    assert regions.line_bars(placed, region(400, 100, 50, 50)).count() == 0


def pages(spark):
    return spark.createDataFrame([(d, k, f"{d}{c}") for d in (1, 2) for k, c in enumerate("ABCD"[: 4 if d == 1 else 1])], "doc_id long, page int, label string")


def listed(df, doc=1):
    return "".join(r.label[1:] for r in df.where(F.col("doc_id") == doc).orderBy("page").collect())


def test_page_lists(spark):
    p = pages(spark)
    assert listed(pageops.move_page(p, 0, 2)) == "BCAD" and listed(pageops.move_page(p, 3, 1)) == "ADBC"
    assert listed(pageops.move_page(p, 0, 2), 2) == "A"
    chosen = spark.createDataFrame([(1, 1), (1, 3), (2, 0)], "doc_id long, page int")
    assert listed(pageops.delete_pages(p, chosen)) == "AC" and listed(pageops.delete_pages(p, chosen), 2) == "A"
    assert listed(pageops.duplicate_page(p, 0)) == "AABCD"
    assert listed(pageops.extract_pages(p, [2, 0])) == "CA"
    more = spark.createDataFrame([(1, 0, "1x"), (1, 1, "1y")], "doc_id long, page int, label string")
    assert listed(pageops.merge_documents(p, more, 1)) == "AxyBCD"
    parts = pageops.split_documents(p, 2)
    assert listed(parts.where("part = 0")) == "AB" and listed(parts.where("part = 1")) == "CD"


def test_fields_and_comments(spark):
    schema = "doc_id long, page int, name string, kind string, value string, checked boolean, option_value string, options array<string>, read_only boolean"
    rows = [
        (1, 0, "name", "text", "Jane", None, None, None, False),
        (1, 1, "name", "text", "Jane", None, None, None, False),
        (1, 0, "ok", "checkbox", None, True, None, None, False),
        (1, 0, "plan", "radio", "basic", True, "basic", None, False),
        (1, 0, "plan", "radio", "basic", False, "pro", None, False),
        (1, 0, "land", "dropdown", "DE", None, None, ["DE", "US"], False),
    ]
    writes = [(1, "name", "Joe", 1), (1, "name", "Max", 2), (1, "ok", "false", 1), (1, "plan", "pro", 1), (1, "land", "XX", 1), (1, "new", "x", 1)]
    got = records.upsert_fields(spark.createDataFrame(rows, schema), spark.createDataFrame(writes, "doc_id long, name string, value string, seq int")).collect()
    assert [r.value for r in got if r.name == "name"] == ["Max", "Max"]
    assert [r.checked for r in got if r.name == "ok"] == [False]
    assert {r.option_value: (r.value, r.checked) for r in got if r.name == "plan"} == {"basic": ("pro", False), "pro": ("pro", True)}
    assert [r.value for r in got if r.name == "land"] == ["DE"]


def test_history(spark):
    versions = spark.createDataFrame([(1, k) for k in range(40)], "doc_id long, version int")
    new = spark.createDataFrame([(1, 36)], "doc_id long, version int")
    at = spark.createDataFrame([(1, 35)], "doc_id long, version int")
    got = sorted(r.version for r in records.append_version(versions, new, at).collect())
    assert got == list(range(7, 37))
    assert records.as_of(versions, 12).first().version == 12


def test_strokes(spark):
    pts = spark.createDataFrame([(1, 0, 0, 10.0, 50.0), (1, 0, 1, 90.0, 50.0), (1, 1, 0, 10.0, 10.0), (1, 1, 1, 40.0, 10.0)], "img_id long, chain int, ord int, x double, y double")
    cut = spark.createDataFrame([(1, 50.0, 0.0, 50.0, 100.0)], "img_id long, ax double, ay double, bx double, by double")
    parts = vector.cut_chains(pts, cut).orderBy("chain", "part", "ord").collect()
    assert [(r.chain, r.part, r.x) for r in parts] == [(0, 0, 10.0), (0, 0, 50.0), (0, 1, 50.0), (0, 1, 90.0), (1, 0, 10.0), (1, 0, 40.0)]
    join = spark.createDataFrame([(1, 1, 1, 0, 0)], "img_id long, a int, a_end int, b int, b_end int")
    joined = vector.connect_chains(pts, join).orderBy("chain", "ord").collect()
    assert [(r.chain, r.x) for r in joined] == [(0, 10.0), (0, 40.0), (0, 10.0), (0, 90.0)]
    spot = spark.createDataFrame([(1, 1, 50.0, 50.0)], "spot_id long, img_id long, px double, py double")
    near = vector.nearest_end(pts, spot, 50.0).first()
    assert (near.chain, near.which) == (0, 1)
    d = vector.svg_paths(pts).orderBy("chain").first().d
    back = vector.parse_svg_path(spark.createDataFrame([(1, d)], "path long, d string")).orderBy("ord").collect()
    assert [(r.type, r.x, r.y) for r in back] == [("M", 10.0, 50.0), ("C", 90.0, 50.0)]
    placed = vector.place_strokes(pts, spark.createDataFrame([(1, 100.0, 50.0)], "img_id long, vw double, vh double"), (100.0, 200.0, 200.0, 100.0)).orderBy("chain", "ord").first()
    assert (placed.x, placed.y) == (120.0, 200.0)


def test_otsu_takes_the_lowest(spark):
    bins = spark.createDataFrame([(1, 10, 5), (1, 200, 5), (2, 7, 9)], "img_id long, bin int, n long")
    assert {r.img_id: r.threshold for r in vector.otsu(bins).collect()} == {1: 10, 2: 160}


def test_fonts_and_scalars(spark):
    assert sum(fontmetrics.standard_width("Helvetica", ord(c)) for c in "Hello") == 2278
    assert [fontmetrics.glyph_name(n) for n in ("A", "eacute", "Zcaron", "uni00E9", "u1F600", "nope", "Ebreve", "Qring")] == [65, 0xE9, 0x17D, 0xE9, 0x1F600, None, 0x114, None]
    row = spark.range(1).select(
        text.wrap_text(F.lit("aa bb  cc dddddddd"), 5).alias("wrap"),
        text.wrap_text(F.lit("  "), 5).alias("none"),
        text.format_bytes(F.lit(1280)).alias("kb"),
        text.format_number(F.lit(-0.0001), 2).alias("zero"),
        text.format_number(F.lit(12.50), 2).alias("n"),
        text.squeeze(F.lit(" a  b\n")).alias("sq"),
        text.filename_from_url(F.lit("https://a.b/c%20d.pdf?x")).alias("f"),
        F.hex(text.hex_string(F.lit("<7>"))).alias("h"),
        fontmetrics.measure_column(F.lit("Helvetica"), F.lit("Hello")).alias("m"),
        text.date_stamp(F.lit("2024-05-06 23:30:00").cast("timestamp")).alias("day"),
    ).first()
    assert row.wrap == ["aa bb", "cc", "dddddddd"] and row.none == [""]
    assert (row.kb, row.zero, row.n, row.sq, row.f, row.h, row.m, row.day) == ("1.3 KB", "0", "12.5", "a b", "c d.pdf", "70", 2278, "2024-05-06")


def test_singular_matrix_gives_null(spark):
    assert spark.range(1).select(geometry.invert(geometry.matrix([1, 2, 2, 4, 0, 0])).alias("m")).first().m is None


def test_page_keyed_chain_shuffles_once(spark, sf):
    from glyphweave.plans.bridge import bridge_words, table

    spark.conf.set("spark.sql.adaptive.enabled", "true")
    df = layout(bridge_words(table(spark, sf, "documents")))[2]
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_page_and_record_scalars(spark):
    n = lambda v: F.lit(v)
    matrix = geometry.multiply(geometry.matrix([2, 0, 0, 2, 0, 0]), geometry.translate(geometry.identity(), n(3.0), n(4.0)))
    row = spark.range(1).select(
        records.single_filter(F.array(n("DCTDecode"))).alias("one"),
        records.single_filter(F.array(n("A"), n("B"))).alias("two"),
        search.step_hit(n(0), -1, n(3)).alias("back"),
        search.step_hit(n(0), 1, n(0)).alias("none"),
        regions.drag_box(n(10.0), n(20.0), n(4.0), n(9.0)).alias("box"),
        regions.drag_box(n(10.0), n(20.0), n(11.0), n(9.0)).alias("thin"),
        F.array(*(vector.stroke_width(n(a), n(20.0)) for a in (100.0, 1.0, 900.0))).alias("widths"),
        F.array(*(vector.luma(*map(n, c)) for c in ((0.0, 0.0, 0.0, 255.0), (0.0, 0.0, 0.0, 0.0), (10.0, 20.0, 31.0, 255.0)))).alias("luma"),
        F.array(pageops.dropped_index(n(1), n(3)), pageops.dropped_index(n(3), n(1))).alias("drop"),
        pageops.toggle(F.array(n(1), n(3)), n(2)).alias("on"),
        pageops.toggle(F.array(n(1), n(3)), n(3)).alias("off"),
        F.array(text.is_dirty(n(2), n(1)), text.is_dirty(n(1), n(1)), text.is_dirty(n(1), n(None).cast("int"))).alias("dirty"),
        text.data_url_bytes(n("data:text/plain;base64,aGk=")).alias("data"),
        F.array(text.seek(n(0.5), n(4)), text.step_position(n(2), 10, n(4)), text.step_position(n(2), -10, n(4))).alias("at"),
        F.array(text.progress(n(1), n(5)), text.progress(n(0), n(1))).alias("done"),
        F.array(text.change_speed(n(1190), 1), text.change_speed(n(70), -1), text.change_speed(n(300), 2)).alias("speed"),
        F.array(*geometry.apply(matrix, n(1.0), n(1.0))).alias("moved"),
        F.array(*geometry.apply_delta(matrix, n(1.0), n(1.0))).alias("turned"),
    ).first()
    assert (row.one, row.two, row.back, row.none, row.thin) == ("DCTDecode", None, 2, None, None)
    assert tuple(row.box) == (4.0, 9.0, 6.0, 11.0)
    assert (row.widths, row.luma, row["drop"]) == ([5.0, 1.25, 8.0], [0, 255, 20], [2, 1])
    assert (row.on, row.off, row.dirty, bytes(row.data)) == ([1, 2, 3], [1], [True, False, True], b"hi")
    assert (row["at"], row.done, row.speed) == ([2, 3, 0], [25.0, 0.0], [1200, 60, 350])
    assert (row.moved, row.turned) == ([5.0, 6.0], [2.0, 2.0])


def test_references_follow_replacements(spark):
    refs = spark.createDataFrame([(0, "7"), (1, "7"), (1, "8")], "page int, ref string")
    done = records.repointed(refs, spark.createDataFrame([("7", "30")], "old_ref string, new_ref string"))
    assert sorted(tuple(r) for r in done.collect()) == [(0, "30"), (1, "30"), (1, "8")]


def test_field_writes_of_one_page(spark):
    fields = spark.createDataFrame([(1, p, "a", "text", "old", None, None, None, False) for p in (0, 1)], "doc_id long, page int, name string, kind string, value string, checked boolean, option_value string, options array<string>, read_only boolean")
    one = records.upsert_fields(fields, spark.createDataFrame([(1, 1, "a", "new", 1)], "doc_id long, page int, name string, value string, seq int"))
    assert sorted((r.page, r.value) for r in one.collect()) == [(0, "old"), (1, "new")]
    assert [(r.names, r.n_fields) for r in records.field_names(fields).collect()] == [(["a"], 1)]


@pytest.mark.parametrize(
    "chains, drag, want",
    [
        ([[(10, 10), (40, 10)], [(60, 10), (90, 10)]], (40, 10, 60, 10), [4]),  # end to end: joined
        ([[(10, 50), (90, 50)]], (50, 10, 50, 90), [2, 2]),  # across: cut
        ([[(10, 50), (90, 50)]], (10, 80, 90, 80), [2]),  # past it: as it was
        ([[(10, 50), (50, 10), (90, 50)]], (10, 50, 90, 51), [3]),  # both ends of one chain, crossing nothing inside
    ],
)
def test_drags_join_or_cut(spark, chains, drag, want):
    rows = [(1, c, k, float(x), float(y)) for c, chain in enumerate(chains) for k, (x, y) in enumerate(chain)]
    points = spark.createDataFrame(rows + [(2, 0, 0, 0.0, 0.0), (2, 0, 1, 5.0, 5.0)], "img_id int, chain int, ord int, x double, y double")
    drags = spark.createDataFrame([(1, *map(float, drag))], "img_id int, ax double, ay double, bx double, by double")
    got = vector.edit_strokes(points, drags, 4.0).groupBy("img_id", "chain").count().orderBy("img_id", "chain").collect()
    assert [r["count"] for r in got if r.img_id == 1] == want and [r["count"] for r in got if r.img_id == 2] == [2]


def test_measured_wrapping_equals_the_loop(spark):
    texts = ["one two three four five six seven", "", None, "  spaced\u00a0out  words ", "W" * 60 + " end", "i i i i i i i i i i i i i i i i i i i i"]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    got = {}
    for r in placement.wrap_measured(df, ["id"], F.lit("Helvetica"), F.lit(6000.0)).orderBy("id", "line_no").collect():
        got.setdefault(r.id, []).append(r.line)
    for k, t in enumerate(texts):
        lines_, current = [], ""
        for word in (t or "").split():
            longer = f"{current} {word}" if current else word
            if current and sum(fontmetrics.standard_width("Helvetica", ord(c)) for c in longer) > 6000:
                lines_.append(current)
                longer = word
            current = longer
        assert got[k] == [*lines_, current]


def test_boxes_meet_once_in_cells(spark):
    import random

    from glyphweave.operators import grid

    rng = random.Random(6)
    box = lambda k, big: (k % 3, 0, k, rng.uniform(-50, 400), rng.uniform(-50, 400), rng.uniform(0, big), rng.choice([0.0, rng.uniform(0, big)]))
    left = [box(k, 15) for k in range(400)] + [(0, 0, 900, None, 1.0, 1.0, 1.0), (0, 0, 901, float("inf"), 1.0, 1.0, 1.0), (0, 0, 902, -1e6, -1e6, 3e6, 3e6), (7, 0, 903, 1.0, 1.0, 1.0, 1.0)]
    right = [box(k, 40) for k in range(120)] + [(1, 0, 500, -100.0, -100.0, 900.0, 900.0), (2, 0, 501, 0.0, 0.0, -1.0, 5.0), (5, 0, 502, 0.0, 0.0, 5.0, 5.0)]
    a = spark.createDataFrame(left, "doc_id long, page int, a long, x double, y double, w double, h double")
    b = spark.createDataFrame(right, "doc_id long, page int, b long, rx double, ry double, rw double, rh double")
    got = sorted((r.a, r.b) for r in grid.overlapping(a, b, ("x", "y", "w", "h"), ("rx", "ry", "rw", "rh")).collect())
    fine = lambda r: all(v is not None and abs(v) < 1e12 for v in r[3:]) and min(r[5:]) >= 0
    want = [
        (p[2], q[2]) for p in left for q in right
        if fine(p) and fine(q) and p[0] == q[0] and p[3] <= q[3] + q[5] and q[3] <= p[3] + p[5] and p[4] <= q[4] + q[6] and q[4] <= p[4] + p[6]
    ]
    assert got == sorted(want) and len(got) > 150
    assert grid.overlapping(a, b.limit(0), ("x", "y", "w", "h"), ("rx", "ry", "rw", "rh")).count() == 0


def test_measured_wrapping_of_odd_widths(spark, capsys):
    """Random texts against a plain loop; a font without widths and a null limit break nothing; a wide word stands alone."""
    import random

    rng = random.Random(5)
    texts = [" ".join("".join(rng.choice("iWm.a") for _ in range(rng.randint(1, 9))) for _ in range(rng.randint(0, 90))) for _ in range(40)]
    rows = [(k, t, float(rng.choice([500, 3000, 9000, 40000]))) for k, t in enumerate(texts)] + [(98, "a b c", None)]
    df = spark.createDataFrame(rows, "id int, text string, room double")
    done = placement.wrap_measured(df, ["id"], F.lit("Times-Roman"), F.col("room"))
    done.explain()
    assert "Python" not in capsys.readouterr().out
    got = {}
    for r in done.orderBy("id", "line_no").collect():
        assert r.line_no == len(got.setdefault(r.id, []))
        got[r.id].append(r.line)
    for k, t, room in rows:
        lines_, current = [], ""
        for word in t.split():
            longer = f"{current} {word}" if current else word
            if room is not None and current and sum(fontmetrics.standard_width("Times-Roman", ord(c)) for c in longer) > room:
                lines_.append(current)
                longer = word
            current = longer
        assert got[k] == [*lines_, current], k


def test_shed_keeps_the_longest_chains(spark):
    """Of five chains the shortest goes, of two equal ones the later, and a lone one stays."""
    rows = [(1, c, k, float(k * n), 0.0) for c, n in enumerate((3, 1, 4, 1, 5)) for k in range(2)] + [(2, 7, 0, 0.0, 0.0)]
    left = vector.shed(spark.createDataFrame(rows, "img_id int, chain int, ord int, x double, y double"))
    assert sorted((r.img_id, r.chain) for r in left.select("img_id", "chain").distinct().collect()) == [(1, 0), (1, 1), (1, 2), (1, 4), (2, 7)]


def test_tasks_follow_the_text_and_not_its_shuffled_bytes(spark):
    """Ten million characters that pack well: a task lays out two million as words, one million as glyphs."""
    docs = spark.range(40).selectExpr("id AS doc_id", "repeat('word ', 50000) AS text")
    assert bridge.bridge_words(docs).rdd.getNumPartitions() == 5
    assert words.detect_words(bridge.bridge_glyphs(docs)).rdd.getNumPartitions() == 10


def test_words_of_glyphs_that_lie_page_by_page(spark):
    """page_words and number_glyphs shuffle nothing and give what detect_words gives."""
    rng = np.random.default_rng(7)
    rows = []
    for page in range(30):
        x, y = 72.0, 700.0
        for k in range(int(rng.integers(1, 60))):
            jump = rng.random()
            x, y = (72.0, y - 12) if jump < 0.05 else (x + float(rng.choice([6.0, 6.0, 8.4, 9.0, -9.0])), y)
            char = rng.choice(np.array(["a", "b", " ", " ", "", None, "\0", "ff"], object))
            rows.append((page // 7, page % 7, k, char, x, y, 6.0, 10.0, str(rng.choice(["F1", "F1", "F1", "F2"])), float(rng.choice([10.0, 10.0, 10.5]))))
    glyphs = spark.createDataFrame(rows, "doc_id long, page int, glyph_ord long, unicode string, x double, y double, width double, height double, font_res string, font_size double")
    want = words.detect_words(glyphs).orderBy("doc_id", "page", "word_ord").collect()
    lying = glyphs.coalesce(1)
    got = words.page_words(lying)
    assert sorted(got.collect()) == want and got.dtypes == words.detect_words(glyphs).dtypes
    firsts = words.detect_words(words.number_glyphs(lying).where("word_ord = 0").drop("word_ord"))
    assert firsts.orderBy("doc_id", "page").collect() == [w for w in want if w["word_ord"] == 0]
