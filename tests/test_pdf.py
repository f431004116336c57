"""PDF files made by hand, read as tables, and followed to blocks."""

import zlib

import pytest

from glyphweave.operators import records, words
from glyphweave.plans.bridge import layout
from glyphweave.sources import content, pdf


def write(path, objects, packed=()):
    """objects: number to bytes or (dict bytes, stream bytes). No cross-reference table: readers here scan."""
    out = [b"%PDF-1.7\n"]
    for n, body in objects.items():
        if isinstance(body, tuple):
            out.append(b"%d 0 obj\n<<%s /Length %d>>\nstream\n%s\nendstream\nendobj\n" % (n, body[0], len(body[1]), body[1]))
        else:
            out.append(b"%d 0 obj\n%s\nendobj\n" % (n, body))
    path.write_bytes(b"".join(out))


@pytest.fixture
def folder(tmp_path):
    first = zlib.compress(b"BT /F1 14 Tf 72 700 Td (Invoice Number: 12345) Tj ET")
    packed = [(20, b"<</Type /Font /Subtype /Type1 /BaseFont /Helvetica /Encoding <</Differences [65 /eacute]>>>>"), (21, b"[0 0 300 400]")]
    heads, bodies = b"", b""
    for n, body in packed:
        heads += b"%d %d " % (n, len(bodies))
        bodies += body + b" "
    write(
        tmp_path / "one.pdf",
        {
            1: b"<</Type /Catalog /Pages 2 0 R /AcroForm <</Fields [12 0 R 14 0 R]>>>>",
            2: b"<</Type /Pages /Kids [3 0 R 4 0 R] /Count 2 /MediaBox [0 0 612 792] /Resources <</Font <</F1 20 0 R>> /XObject <</I1 15 0 R>>>>>>",
            3: b"<</Type /Page /Parent 2 0 R /Contents [5 0 R 6 0 R] /Annots [12 0 R 13 0 R 16 0 R 17 0 R]>>",
            4: b"<</Type /Page /Parent 2 0 R /Contents 7 0 R /MediaBox 21 0 R /Rotate 90>>",
            5: (b"/Filter /FlateDecode", first),
            6: (b"", b"BT /F1 12 Tf 72 660 Td (Hello A) Tj ET"),
            7: (b"/Filter /FlateDecode", b"not zlib"),
            10: (b"/Type /ObjStm /N 2 /First %d /Filter /FlateDecode" % len(heads), zlib.compress(heads + bodies)),
            12: b"<</Subtype /Widget /FT /Tx /T (name) /V (Jane Doe) /Rect [10 20 110 40] /Ff 4096>>",
            13: b"<</Subtype /Text /Rect [5 6 23 24] /Contents (look here)>>",
            14: b"<</FT /Btn /T (plan) /V /pro /Ff 32768>>",
            15: (b"/Subtype /Image /Width 3 /Height 2 /Filter /DCTDecode", b"\xff\xd8jpeg\xff\xd9"),
            16: b"<</Subtype /Widget /Parent 14 0 R /Rect [0 0 9 9] /AP <</N <</basic 6 0 R /Off 6 0 R>>>>>>",
            17: b"<</Subtype /Widget /Parent 14 0 R /Rect [0 9 9 18] /AP <</N <</pro 6 0 R /Off 6 0 R>>>>>>",
        },
    )
    (tmp_path / "broken.pdf").write_bytes(b"%PDF-1.4\nnothing here")
    (tmp_path / "other.pdf").write_bytes(b"no PDF at all")
    (tmp_path / "note.txt").write_bytes(b"%PDF-1.4 skipped by name")
    return str(tmp_path)


def test_pages_and_geometry(spark, folder):
    rows = pdf.pages(spark, folder).orderBy("page").collect()
    assert [(r.page, r.width, r.height, r.rotation) for r in rows] == [(0, 612.0, 792.0, 0), (1, 300.0, 400.0, 90)]
    assert bytes(rows[0].content).endswith(b"(Hello A) Tj ET\n") and bytes(rows[1].content) == b"not zlib\n"
    assert pdf.geometry(spark, folder).count() == 2


def test_file_to_blocks(spark, folder):
    glyphs = content.extract_glyphs(content.parse_operations(pdf.pages(spark, folder)), pdf.fonts(spark, folder))
    found = words.detect_words(glyphs)
    assert [w.text for w in found.orderBy("word_ord").collect()] == ["Invoice", "Number:", "12345", "Hello", "é"]
    assert layout(found)[2].count() == 2


def test_fields_comments_images(spark, folder):
    fields = {(r.name, r.option_value): r for r in pdf.form_fields(spark, folder).collect()}
    assert fields["name", None].value == "Jane Doe" and fields["name", None].multiline
    assert (fields["plan", "basic"].checked, fields["plan", "pro"].checked) == (False, True)
    note = pdf.comments(spark, folder).first()
    assert (note.contents, note.x, note.w, note.id) == ("look here", 5.0, 18.0, "13")
    images = pdf.images(spark, folder)
    assert images.count() == 2  # both pages inherit the resource
    once = records.distinct_images(images).first()
    assert (once.first_page, once.n_uses, once.n_bytes) == (0, 2, 8)


def test_streams_end_by_their_length(spark, tmp_path):
    data = b"BT (a endobj b) Tj (c\nendstream d) Tj ET"
    write(tmp_path / "marks.pdf", {1: b"<</Type /Catalog /Pages 2 0 R>>", 2: b"<</Type /Pages /Kids [3 0 R] /MediaBox [0 0 9 9]>>", 3: b"<</Type /Page /Parent 2 0 R /Contents 4 0 R>>", 4: (b"", data)})
    assert bytes(pdf.pages(spark, str(tmp_path)).first().content).rstrip() == data


def test_a_malformed_file_is_named(spark, folder, tmp_path):
    bad = b"<</Type /Pages /Kids [3 0 R] /MediaBox [0 0 612 792]>>"
    write(tmp_path / "bad.pdf", {1: b"<</Type /Catalog /Pages 2 0 R>>", 2: bad, 3: b"<</Type /Page /Parent 2 0 R>>", 9: (b"/Type /ObjStm /N 1 /First 4", b"x y z")})
    found = pdf.problems(spark, folder).collect()
    assert [r.path.rsplit("/", 1)[1] for r in found] == ["bad.pdf"] and "Error" in found[0].error
    assert pdf.pages(spark, folder).count() == 2
