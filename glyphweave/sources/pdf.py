"""PDF files as tables: pages, fonts, form fields, comments and images.

Files come through Spark's binaryFile reader, so any store that Spark reads will do
and files are spread over tasks; one small scan of a file's objects feeds all tables.
Only what the layout tables need is read: no encryption, no rendering, no writing.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphweave.sources.content import operations, parse_cmap

PAGE_SCHEMA = "doc_id long, path string, page int, width double, height double, rotation int, content binary"
GEOMETRY_SCHEMA = "doc_id long, path string, page int, width double, height double, rotation int"
FONT_SCHEMA = (
    "doc_id long, page int, font_res string, subtype string, base_font string, encoding string, differences string,"
    " to_unicode map<int,string>, widths map<int,double>, default_width double, two_byte boolean"
)
FIELD_SCHEMA = (
    "doc_id long, page int, name string, kind string, x double, y double, w double, h double, read_only boolean, value string,"
    " checked boolean, options array<string>, option_value string, multiline boolean"
)
COMMENT_SCHEMA = "doc_id long, page int, id string, x double, y double, w double, h double, contents string"
IMAGE_SCHEMA = "doc_id long, page int, ref string, width int, height int, n_bytes long, bytes binary"

_OBJECT = re.compile(rb"(\d+)\s+\d+\s+obj\b")
_BODY_END = re.compile(rb"\bstream\r?\n|\bendobj")
_STREAM_END = re.compile(rb"\r?\n?endstream\b")
_LENGTH = re.compile(rb"/Length\s+(\d+)(?!\s+\d+\s+R)")
_REF = re.compile(rb"(?<![\w.])(\d+)\s+\d+\s+R(?![\w])")


def _value(raw: bytes) -> Any:
    """A PDF value; references become names that start with "R~"."""
    for _, operands, _, _ in operations(_REF.sub(rb"/R~\1", raw) + b" end"):
        return operands[0] if operands else None
    return None


class PdfFile:
    """Objects of one file by number: (value, stream bytes or None)."""

    def __init__(self, data: bytes):
        self.objects: dict[int, tuple[Any, bytes | None]] = {}
        at = 0
        while m := _OBJECT.search(data, at):
            end = _BODY_END.search(data, m.end())
            if not end:
                break
            at, value, stream = end.end(), _value(data[m.end() : end.start()]), None
            if end[0] != b"endobj":
                stream, at = self._stream(data, at, _LENGTH.search(data, m.end(), end.start()))
            self.objects[int(m[1])] = (value, stream)
        for value, stream in list(self.objects.values()):  # objects packed in streams
            if self.name(self.get(value, "Type")) == "ObjStm" and stream is not None:
                plain = self.decoded((value, stream))
                first, count = int(self.get(value, "First") or 0), int(self.get(value, "N") or 0)
                heads = plain[:first].split()
                places = [(int(heads[2 * k]), int(heads[2 * k + 1])) for k in range(count) if 2 * k + 1 < len(heads)]
                for k, (number, at) in enumerate(places):
                    end = places[k + 1][1] if k + 1 < len(places) else len(plain)
                    self.objects.setdefault(number, (_value(plain[first + at : first + end]), None))

    @staticmethod
    def _stream(data: bytes, at: int, length: re.Match | None) -> tuple[bytes, int]:
        """Bytes of a stream and where it ends: by its length if that leads to its end mark, else up to the next mark."""
        if length and (end := _STREAM_END.match(data, at + int(length[1]))):
            return data[at : at + int(length[1])], end.end()
        end = _STREAM_END.search(data, at)
        return (data[at : end.start()], end.end()) if end else (data[at:], len(data))

    @staticmethod
    def name(value: Any) -> str | None:
        return value["n"] if isinstance(value, dict) and "n" in value else None

    def follow(self, value: Any) -> tuple[Any, bytes | None]:
        """What a reference names, else the value itself; chains are followed a few steps."""
        stream = None
        for _ in range(8):
            name = self.name(value)
            if not name or not name.startswith("R~"):
                break
            value, stream = self.objects.get(int(name[2:]), (None, None))
        return value, stream

    def get(self, value: Any, key: str) -> Any:
        value = self.follow(value)[0]
        pairs = value.get("d", []) if isinstance(value, dict) else []
        return next((self.follow(v)[0] for k, v in pairs if k == key), None)

    def raw(self, value: Any, key: str) -> Any:
        """An entry without following its reference."""
        value = self.follow(value)[0]
        return next((v for k, v in (value.get("d", []) if isinstance(value, dict) else []) if k == key), None)

    def decoded(self, found: tuple[Any, bytes | None]) -> bytes:
        """Stream bytes after inflating; as they are, if they can't be inflated."""
        value, stream = found
        filters = self.get(value, "Filter")
        names = [self.name(f) for f in (filters if isinstance(filters, list) else [filters])]
        if stream is None or "FlateDecode" not in names:
            return stream or b""
        try:
            return zlib.decompressobj().decompress(stream)
        except zlib.error:
            return stream

    def text(self, value: Any) -> str | None:
        if not isinstance(value, dict) or "s" not in value:
            return self.name(value)
        raw = bytes.fromhex(value["s"])
        return raw[2:].decode("utf-16-be", "replace") if raw[:2] == b"\xfe\xff" else raw.decode("latin-1")

    def numbers(self, value: Any) -> list[float]:
        return [float(v) if isinstance(v, int | float) else 0.0 for v in (self.follow(v)[0] for v in value)] if isinstance(value, list) else []

    def rect(self, value: Any) -> tuple[float, float, float, float] | None:
        n = self.numbers(value)
        return (min(n[0], n[2]), min(n[1], n[3]), abs(n[2] - n[0]), abs(n[3] - n[1])) if len(n) >= 4 else None

    def pages(self) -> list[tuple[Any, dict]]:
        """(page reference, inherited attributes) in reading order."""
        root = next((v for v, _ in self.objects.values() if self.name(self.get(v, "Type")) == "Catalog"), None)
        out: list[tuple[Any, dict]] = []
        todo: list[tuple[Any, dict, int]] = [(self.raw(root, "Pages"), {}, 0)]
        while todo:
            node, had, depth = todo.pop()
            mine = had | {k: v for k in ("MediaBox", "Resources", "Rotate") if (v := self.get(node, k)) is not None}
            kids = self.get(node, "Kids")
            if isinstance(kids, list) and depth < 64:
                todo += [(kid, mine, depth + 1) for kid in reversed(kids)]
            elif node is not None and self.follow(node)[0] is not None:
                out.append((node, mine))
        return out

    def content(self, page: Any) -> bytes:
        """All content streams of a page, each followed by a line end."""
        listed = self.raw(page, "Contents")
        value, stream = self.follow(listed)
        parts = value if isinstance(value, list) else [listed] if stream is not None else []
        return b"".join(self.decoded(self.follow(p)) + b"\n" for p in parts)


def page_rows(f: PdfFile, doc: int, path: str, with_content: bool = True) -> Iterator[tuple]:
    for n, (page, had) in enumerate(f.pages()):
        box = f.rect(had.get("MediaBox")) or (0.0, 0.0, 612.0, 792.0)
        turn = had.get("Rotate")
        row = (doc, path, n, box[2], box[3], int(turn) if isinstance(turn, int | float) else 0)
        yield (*row, f.content(page)) if with_content else row


def font_rows(f: PdfFile, doc: int, path: str) -> Iterator[tuple]:
    for n, (_, had) in enumerate(f.pages()):
        fonts = f.get(had.get("Resources"), "Font")
        for res, ref in fonts.get("d", []) if isinstance(fonts, dict) else []:
            font = f.follow(ref)[0]
            enc, cmap = f.get(font, "Encoding"), f.follow(f.raw(font, "ToUnicode"))
            base = f.name(enc) or f.name(f.get(enc, "BaseEncoding"))
            listed = [v if isinstance(v, int | float) else f.name(v) for v in f.get(enc, "Differences") or []]
            subtype, default = f.name(f.get(font, "Subtype")), f.get(f.get(font, "FontDescriptor"), "MissingWidth")
            widths: dict[int, float] = {}
            if subtype == "Type0":
                kids = f.get(font, "DescendantFonts")
                kid = kids[0] if isinstance(kids, list) and kids else None
                default, listed_w, k = f.get(kid, "DW") or 1000.0, f.get(kid, "W") or [], 0
                listed_w = [f.follow(v)[0] for v in listed_w]
                while k + 1 < len(listed_w):
                    first, second = listed_w[k], listed_w[k + 1]
                    if isinstance(second, list):
                        widths.update((int(first) + j, w) for j, w in enumerate(f.numbers(second)))
                        k += 2
                    elif k + 2 < len(listed_w):
                        widths.update((c, float(listed_w[k + 2])) for c in range(int(first), min(int(second), int(first) + 65535) + 1))
                        k += 3
                    else:
                        break
            else:
                first = int(f.get(font, "FirstChar") or 0)
                widths.update((first + j, w) for j, w in enumerate(f.numbers(f.get(font, "Widths"))) if w > 0)
            two = subtype == "Type0" and (base is None or base.startswith("Identity") or "UCS2" in base or base.endswith(("-H", "-V")))
            to_unicode = parse_cmap(f.decoded(cmap)) if cmap[1] is not None else None
            yield doc, n, res, subtype, f.name(f.get(font, "BaseFont")), base, json.dumps(listed) if listed else None, to_unicode, widths or None, float(default or 0.0), two


def _annotations(f: PdfFile) -> Iterator[tuple[int, Any, Any]]:
    for n, (page, _) in enumerate(f.pages()):
        for ref in f.get(page, "Annots") or []:
            yield n, ref, f.follow(ref)[0]


def field_rows(f: PdfFile, doc: int, path: str) -> Iterator[tuple]:
    """A row for each widget of a field; attributes may stand with the field's parent."""
    for n, _, widget in _annotations(f):
        if f.name(f.get(widget, "Subtype")) != "Widget":
            continue
        at = lambda key, w=widget: v if (v := f.get(w, key)) is not None else f.get(f.get(w, "Parent"), key)
        flags, type_, rect = int(at("Ff") or 0), f.name(at("FT")), f.rect(f.get(widget, "Rect"))
        states = [k for k, _ in (f.get(f.get(widget, "AP"), "N") or {}).get("d", []) if k != "Off"]
        button = type_ == "Btn"
        kind = "radio" if button and flags & (1 << 15) else "checkbox" if button else "dropdown" if type_ == "Ch" else "text"
        if rect is None or type_ not in ("Btn", "Ch", "Tx") or (button and flags & (1 << 16)):
            continue
        options = [f.text(o[-1] if isinstance(o, list) and o else o) for o in at("Opt") or []] if kind == "dropdown" else None
        value, option = f.text(at("V")), states[0] if button and states else None
        yield doc, n, f.text(at("T")), kind, *rect, bool(flags & 1), value, (value == option if button else None), options, option, bool(kind == "text" and flags & (1 << 12))


def comment_rows(f: PdfFile, doc: int, path: str) -> Iterator[tuple]:
    for n, ref, note in _annotations(f):
        rect = f.rect(f.get(note, "Rect"))
        if f.name(f.get(note, "Subtype")) == "Text" and rect is not None:
            yield doc, n, (f.name(ref) or "").removeprefix("R~"), *rect, f.text(f.get(note, "Contents")) or ""


def image_rows(f: PdfFile, doc: int, path: str) -> Iterator[tuple]:
    """JPEG images that have no other filter, once for each page that shows them."""
    for n, (_, had) in enumerate(f.pages()):
        shown = f.get(had.get("Resources"), "XObject")
        for _, ref in shown.get("d", []) if isinstance(shown, dict) else []:
            value, stream = f.follow(ref)
            filters = f.get(value, "Filter")
            names = [f.name(x) for x in (filters if isinstance(filters, list) else [filters])]
            if stream is not None and names == ["DCTDecode"] and f.name(f.get(value, "Subtype")) == "Image":
                yield doc, n, (f.name(ref) or "").removeprefix("R~"), int(f.get(value, "Width") or 0), int(f.get(value, "Height") or 0), len(stream), stream


def _table(spark: SparkSession, path: str, schema: str, rows: Callable[[PdfFile, int, str], Iterator[tuple]], failed: Callable[[int, str, str], list[tuple]] | None = None) -> DataFrame:
    """Rows of every file. A file that can't be read has no rows but what `failed` says of its error."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.pdf").option("recursiveFileLookup", "true").load(path)
    named = files.where(F.substring("content", 1, 5) == F.lit(b"%PDF-")).select(F.xxhash64("path").alias("doc_id"), "path", "content")
    empty = spark.createDataFrame([], schema)
    shape, arrow = empty.schema, empty.toArrow().schema

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                doc, where, data = (batch.column(c)[k].as_py() for c in ("doc_id", "path", "content"))
                try:
                    found = list(rows(PdfFile(data), doc, where))
                except Exception as error:  # whatever a malformed file leads to is that file's own error
                    found = failed(doc, where, f"{type(error).__name__}: {error}") if failed else []
                if found:
                    columns = []
                    for values, kind in zip(zip(*found, strict=True), arrow, strict=True):
                        columns.append(pa.array([list(v.items()) if isinstance(v, dict) else v for v in values], kind.type))
                    yield pa.RecordBatch.from_arrays(columns, names=arrow.names)

    return named.mapInArrow(scan, shape)


def pages(spark: SparkSession, path: str) -> DataFrame:
    """PAGE_SCHEMA rows of all PDF files under `path`; doc_id is a hash of a file's path."""
    return _table(spark, path, PAGE_SCHEMA, page_rows)


def geometry(spark: SparkSession, path: str) -> DataFrame:
    """Page sizes without contents."""
    return _table(spark, path, GEOMETRY_SCHEMA, lambda f, doc, where: page_rows(f, doc, where, with_content=False))


def fonts(spark: SparkSession, path: str) -> DataFrame:
    return _table(spark, path, FONT_SCHEMA, font_rows)


def form_fields(spark: SparkSession, path: str) -> DataFrame:
    return _table(spark, path, FIELD_SCHEMA, field_rows)


def comments(spark: SparkSession, path: str) -> DataFrame:
    return _table(spark, path, COMMENT_SCHEMA, comment_rows)


def images(spark: SparkSession, path: str) -> DataFrame:
    return _table(spark, path, IMAGE_SCHEMA, image_rows)


def problems(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, path, error of each file that one of the tables can't be read from; those tables have none of its rows."""

    def read(f: PdfFile, doc: int, where: str) -> Iterator[tuple]:
        for rows in (page_rows, font_rows, field_rows, comment_rows, image_rows):
            for _ in rows(f, doc, where):
                pass
        return iter(())

    return _table(spark, path, "doc_id long, path string, error string", read, lambda doc, where, error: [(doc, where, error)])
