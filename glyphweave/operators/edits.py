"""Edits that write page content anew: splices, text replacement, redaction, highlighting.

What to change is found relationally (byte spans, bars); a page's new bytes are made
where the page is. Results are new version rows of `pages`; the old bytes are in no
row of the result. Failures are values in `error`, never exceptions.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from glyphweave.operators import regions
from glyphweave.operators.words import PAGE
from glyphweave.sources.content import Font, font_of, lexed_lots
from glyphweave.sources.lexing import values_of

EDITED = "doc_id long, page int, content binary, n_edits int, error string"
EDIT = "doc_id long, page int, op_index int, item_index int, span_start int, span_end int, replacement binary"
#: Further columns of edits that take an operation apart: lines to show, the font to switch to for them
#: (null: none), the font and size in use, and the step from line to line.
REBUILT = "lines array<binary>, switch string, font_res string, font_size double, leading double"
_ESCAPES = {40: rb"\(", 41: rb"\)", 92: rb"\\", 10: rb"\n", 13: rb"\r", 9: rb"\t", 8: rb"\b", 12: rb"\f"}
_IN_STRING = [_ESCAPES.get(b) or (bytes([b]) if 32 <= b <= 126 else b"\\%03o" % b) for b in range(256)]
_PLAIN_NAME = frozenset(range(0x22, 0x7F)) - frozenset(b"#()<>[]{}/%")


def number_bytes(n: float) -> bytes:
    """Whole numbers plainly, others with at most six decimals."""
    text = str(int(n)) if float(n).is_integer() else f"{n:.6f}".rstrip("0").rstrip(".")
    return (text if text != "-0" else "0").encode()


def value_bytes(value: Any) -> bytes:
    """A parsed operand as content-stream bytes."""
    if value is None:
        return b"null"
    if isinstance(value, bool):
        return b"true" if value else b"false"
    if isinstance(value, int | float):
        return number_bytes(value)
    if isinstance(value, list):
        return b"[" + b" ".join(map(value_bytes, value)) + b"]"
    if "s" in value:
        raw = bytes.fromhex(value["s"])
        return b"(" + b"".join([_IN_STRING[b] for b in raw]) + b")"
    if "n" in value:
        return b"/" + b"".join(bytes([b]) if b in _PLAIN_NAME else b"#%02x" % b for b in value["n"].encode("latin-1", "replace"))
    return b"<<" + b" ".join(value_bytes({"n": k}) + b" " + value_bytes(v) for k, v in value["d"]) + b">>"


def operation_bytes(op: str, operands: list) -> bytes:
    return b" ".join([*map(value_bytes, operands), op.encode("latin-1")])


def splice(data: bytes, parts: list[tuple[int, int, bytes]]) -> bytes:
    """Replace byte ranges. Ranges may touch; overlapping ones are an error."""
    out, at = [], 0
    for start, end, new in sorted(parts, key=lambda p: p[:2]):
        if start < at:
            raise ValueError("overlapping splices")
        out += [data[at:start], new]
        at = end
    return b"".join([*out, data[at:]])


def edited_string(raw: bytes, edits: list[tuple[int, int, bytes]]) -> bytes:
    """Edits (start, end, new bytes) of one string, from the right so that offsets stay true."""
    for start, end, new in sorted(edits, key=lambda e: -e[0]):
        raw = raw[:start] + new + raw[end:]
    return raw


def edited_operation(op: str, operands: list, edits: list[tuple[int | None, int, int, bytes]]) -> bytes:
    """An operation with its shown strings edited; an item number names a string of a TJ array."""

    def change(value: Any, item: int | None) -> Any:
        mine = [(a, b, new) for i, a, b, new in edits if i == item]
        return {"s": edited_string(bytes.fromhex(value["s"]), mine).hex()} if mine and isinstance(value, dict) and "s" in value else value

    out = list(operands)
    for k, value in enumerate(operands):
        if isinstance(value, list) and op == "TJ":
            out[k] = [change(v, n) for n, v in enumerate(value)]
        elif k == len(operands) - 1 or op in ("Tj", "'", '"'):
            out[k] = change(value, None)
    return operation_bytes(op, out)


def short_number(n: float) -> bytes:
    """Whole numbers plainly, others with at most three decimals."""
    text = str(int(n)) if float(n).is_integer() else f"{n:.3f}".rstrip("0").rstrip(".")
    return (text if text != "-0" else "0").encode()


@dataclass
class Insert:
    """What takes the place of bytes start to end of a string (item: of an array): one text in the same font, or lines."""

    item: int | None
    start: int
    end: int
    replacement: bytes
    lines: list[bytes] | None = None
    switch: str | None = None
    font_res: str = ""
    font_size: float = 0.0
    leading: float = 0.0

    def commands(self) -> list[bytes]:
        """The lines as operations: the font and back, if it is another, and a step down before each line but the first."""
        if self.lines is None:
            return [string_bytes(self.replacement) + b" Tj"] if self.replacement else []
        font = lambda name: value_bytes({"n": name}) + b" " + short_number(self.font_size) + b" Tf"
        shown = [string_bytes(line) + b" Tj" for line in self.lines]
        down = b"0 " + short_number(-self.leading) + b" Td "
        body = [shown[0], *(down + line for line in shown[1:])]
        return body if self.switch is None else [font(self.switch), *body, font(self.font_res)]


def string_bytes(raw: bytes) -> bytes:
    return value_bytes({"s": raw.hex()})


def rebuilt_operation(op: str, operands: list, inserts: list[Insert]) -> bytes:
    """A showing operation as several: what stands before, the lines, what stands after, for each insert in order.

    In an array, strings whose inserts are plain stay in it; it is shown in parts around the others.
    """
    parts: list[bytes] = [b"T*"] if op == "'" else []
    if op == '"':
        parts = [value_bytes(operands[0]) + b" Tw " + value_bytes(operands[1]) + b" Tc T*"]

    def taken_apart(raw: bytes, mine: list[Insert]) -> None:
        at = 0
        for insert in sorted(mine, key=lambda i: i.start):
            if raw[at : insert.start]:
                parts.append(string_bytes(raw[at : insert.start]) + b" Tj")
            parts.extend(insert.commands())
            at = insert.end
        if raw[at:]:
            parts.append(string_bytes(raw[at:]) + b" Tj")

    if op != "TJ":
        taken_apart(bytes.fromhex(operands[-1]["s"]), inserts)
        return b" ".join(parts)
    kept: list[Any] = []
    for k, value in enumerate(operands[0]):
        mine = [i for i in inserts if i.item == k]
        if any(i.lines is not None for i in mine):
            if kept:
                parts.append(operation_bytes("TJ", [kept]))
            kept = []
            taken_apart(bytes.fromhex(value["s"]), mine)
        elif mine:
            kept.append({"s": edited_string(bytes.fromhex(value["s"]), [(i.start, i.end, i.replacement) for i in mine]).hex()})
        else:
            kept.append(value)
    if kept:
        parts.append(operation_bytes("TJ", [kept]))
    return b" ".join(parts)


_DONE = "struct<content:binary,n_edits:int,error:string>"
_DONE_TYPE = pa.struct([("content", pa.binary()), ("n_edits", pa.int32()), ("error", pa.string())])


def _insert(change: dict) -> Insert:
    place = change["item_index"], change["span_start"], change["span_end"]
    if change.get("lines") is None:
        return Insert(*place, change["replacement"] or b"")
    return Insert(*place, b"", change["lines"], change["switch"], change["font_res"], change["font_size"], change["leading"])


def _changed(content: bytes, changes: list[dict], why: str | None) -> dict:
    """A page's content with edits made in it, each with its operation's op, values, start and end."""
    failed = any(c.get("failed") for c in changes)
    known = [c for c in changes if not c.get("failed") and c["start"] is not None]
    by_operation: dict[tuple[int, int], list[dict]] = {}
    for change in known:
        by_operation.setdefault((change["start"], change["end"]), []).append(change)
    parts, error = [], None
    for (start, end), group in by_operation.items():
        inserts = [_insert(c) for c in group]
        op, values = group[0]["op"], group[0]["values"]
        if any(i.lines is not None for i in inserts):
            parts.append((start, end, rebuilt_operation(op, values, inserts)))
        else:
            parts.append((start, end, edited_operation(op, values, [(i.item, i.start, i.end, i.replacement) for i in inserts])))
    try:
        content = splice(content, parts)
    except ValueError as broken:
        error = str(broken)
    return {"content": content, "n_edits": len(known), "error": error or (why if failed else None)}


def _once(made: Callable[..., pa.Array], kind: str) -> Callable[..., Column]:
    """A function of columns that a filter on its values must not have made a second time."""
    return arrow_udf(made, kind).asNondeterministic()


def _applied(content: Column, edits: Column, why: str | None = None) -> Column:
    """Struct _DONE of pages and their edits (arrays of EDIT, and of REBUILT and `failed` if they have it); null edits give null.

    Edits that hold op, operands, start and end are of operations as parsed; for others the stream is lexed where it lies.
    """

    def made(contents: pa.Array, edits_: pa.Array) -> pa.Array:
        streams = [c or b"" for c in contents.to_pylist()]
        asked = edits_.to_pylist()
        parsed = "operands" in [f.name for f in edits_.type.value_type]
        out: list[dict | None] = [None] * len(asked)
        if parsed:
            for k, changes in enumerate(asked):
                for c in changes or ():
                    c["values"] = values_of(c["operands"]) if c["start"] is not None else None
                out[k] = None if changes is None else _changed(streams[k], changes, why)
            return pa.array(out, _DONE_TYPE)
        which = [k for k, changes in enumerate(asked) if changes is not None]
        for first, lot, found, bounds in lexed_lots(streams[k] for k in which):
            begins = np.cumsum([0, *(len(x) + 1 for x in lot)]).tolist()
            for j, k in enumerate(which[first : first + len(lot)]):
                for c in asked[k]:
                    n = int(bounds[j]) + c["op_index"] if c["op_index"] is not None else -1
                    there = bounds[j] <= n < bounds[j + 1]
                    c |= {"op": found.names[n], "values": found.values(n), "start": int(found.starts[n]) - begins[j], "end": int(found.ends[n]) - begins[j]} if there else {"start": None}
                out[k] = _changed(streams[k], asked[k], why)
        return pa.array(out, _DONE_TYPE)

    return _once(made, _DONE)(content, edits)


def _by_page(rows: DataFrame, name: str) -> DataFrame:
    """doc_id, page and a list of the other columns of rows."""
    return rows.groupBy(*PAGE).agg(F.collect_list(F.struct(*(c for c in rows.columns if c not in PAGE))).alias(name))


def _with_operations(edits: DataFrame, ops: DataFrame | None) -> DataFrame:
    return edits if ops is None else edits.join(ops.select(*PAGE, "op_index", "op", "operands", "start", "end"), [*PAGE, "op_index"], "left")


def apply_edits(pages: DataFrame, ops: DataFrame | None, edits: DataFrame, why: str | None = None) -> DataFrame:
    """EDITED rows of the pages that `edits` (EDIT, and REBUILT if they have it) name: `pages` (doc_id, page, content), `ops` as parsed from them.

    Without `ops` a page with edits is lexed where it lies; otherwise only named operations are carried along. Pages without edits, and edits without their page, give no row;
    further columns of `pages` stay. Edits that are marked as `failed`, if there is such a column, change nothing and give `why` as the error.
    `edits` is read once.
    """
    held = pages.join(_by_page(_with_operations(edits, ops), "edits"), PAGE)
    more = [c for c in pages.columns if c not in (*PAGE, "content")]
    return held.withColumn("done", _applied(F.col("content"), F.col("edits"), why)).select(*PAGE, "done.*", *more)


def _rectangles() -> Column:
    """Bars (a list of x, y, w, h) as path data."""
    return F.array_join(F.transform("bars", lambda b: F.concat_ws(" ", *(F.format_string("%.3f", b[c]) for c in "xywh"), F.lit("re"))), " ")


def _page_bars(bars: DataFrame) -> DataFrame:
    order = F.array_sort(F.collect_list(F.struct("region_id", F.coalesce("line_ord", F.lit(-1)).alias("line_ord"), "x", "y", "w", "h")))
    return bars.groupBy(*PAGE).agg(order.alias("bars"))


def redact(pages: DataFrame, ops: DataFrame | None, glyphs: DataFrame, placed: DataFrame, areas: DataFrame) -> DataFrame:
    """Delete the text under each region and draw black bars over its lines, or over the region where there is no text.

    Text bytes between the first and the last covered glyph of a string go too. The
    page's own drawing is wrapped so that bars lie in plain page space. `pages`, `glyphs` and `placed` are read once; without `ops` pages
    are lexed where they lie. Returns doc_id, page, content, n_removed, n_bars, error, and further columns of `pages`.
    """
    hit = regions.touched(glyphs, areas).where(F.col("unicode") != "").dropDuplicates([*PAGE, "glyph_ord"])
    spans = _with_operations(regions.source_groups(hit).withColumn("replacement", F.lit(b"").cast("binary")), ops)
    fields = F.struct(*(c for c in spans.columns if c not in (*PAGE, "n_glyphs")))
    stripped = spans.groupBy(*PAGE).agg(F.collect_list(fields).alias("edits"), F.sum("n_glyphs").alias("n_removed"))
    asked = _page_bars(regions.redaction_bars(placed, areas)).join(stripped, PAGE, "left")
    covered = pages.join(asked, PAGE).withColumn("done", _applied(F.col("content"), F.col("edits")))
    body = F.coalesce("done.content", "content", F.lit(b"").cast("binary"))
    cover = F.concat(F.lit("\nQ\nq 0 0 0 rg "), _rectangles(), F.lit(" f Q\n"))
    return covered.select(
        *PAGE,
        F.concat(F.lit("q\n").cast("binary"), body, cover.cast("binary")).alias("content"),
        F.coalesce("n_removed", F.lit(0)).alias("n_removed"),
        F.size("bars").alias("n_bars"),
        F.col("done.error").alias("error"),
        *(c for c in pages.columns if c not in (*PAGE, "content")),
    )


def highlight(pages: DataFrame, placed: DataFrame, areas: DataFrame, color: tuple[float, float, float] = (1, 0.906, 0.31)) -> DataFrame:
    """Draw coloured bars under the lines that regions touch; pages without touched text give no row."""
    under = pages.select(*PAGE, "content").join(_page_bars(regions.line_bars(placed, areas)), PAGE)
    paint = F.concat(F.lit(f"q {' '.join(f'{c:g}' for c in color)} rg "), _rectangles(), F.lit(" f Q\n"))
    return under.select(*PAGE, F.concat(paint.cast("binary"), F.coalesce("content", F.lit(b"").cast("binary"))).alias("content"), F.size("bars").alias("n_bars"))


def wrapped(text: str, measure: Callable[[str], float | None], limit: float | None) -> list[str]:
    """Greedy lines of at most `limit`; a line that can't be measured fits, a longer word has a line of its own."""
    lines: list[str] = []
    for word in text.split():
        longer = f"{lines[-1]} {word}" if lines else word
        width = measure(longer) if lines and limit is not None else None
        if lines and (width is None or width <= limit):
            lines[-1] = longer
        else:
            lines.append(word)
    return lines or [""]


#: The font that stands in where a text's own font can't encode it.
STAND_IN = {"subtype": "Type1", "base_font": "Helvetica", "encoding": "WinAnsiEncoding"}


def free_name(fonts: Column, stem: str = "A2FB") -> Column:
    """The first name of stem, stem1, stem2 ... that none of a page's fonts has."""
    names = F.transform(fonts, lambda f: f["font_res"])
    tried = F.transform(F.sequence(F.lit(0), F.size(fonts)), lambda n: F.when(n == 0, F.lit(stem)).otherwise(F.concat(F.lit(stem), n.cast("string"))))
    return F.get(F.filter(tried, lambda name: ~F.array_contains(names, name)), F.lit(0))


def _coded(asked: Column, fonts: Column) -> Column:
    """For each run's string in `asked` (font_res, new_text, limit and more): the lines to show, and whether the stand-in font shows them; null lines if neither font can."""

    def code(asked_: pa.Array, fonts_: pa.Array) -> pa.Array:
        stand_in, last, coded, out = Font(STAND_IN), None, {}, []
        known, rows = None, {}
        for k, runs in enumerate(asked_.to_pylist()):
            if fonts_[k] != known:
                known, rows = fonts_[k], {f["font_res"]: font_of(f) for f in fonts_[k].as_py() or ()}
            found = []
            for run in runs or ():
                font, text, limit = rows.get(run["font_res"]), run["new_text"], run["limit"]
                if (font, text, limit) != last:  # strings of a run follow each other
                    other = font is None or font.encode(text) is None
                    shows = stand_in if other else font
                    lines = [shows.encode(line) for line in wrapped(text, shows.measure, limit)]
                    last, coded = (font, text, limit), {"lines": None, "other": False} if None in lines else {"lines": lines, "other": other}
                found.append(coded)
            out.append(found)
        return pa.array(out, pa.list_(pa.struct([("lines", pa.list_(pa.binary())), ("other", pa.bool_())])))

    return _once(code, "array<struct<lines:array<binary>,other:boolean>>")(asked, fonts)


_RUN = ("run", "font_res", "font_size", "new_text", "max_width", "leading")


def _spans(runs: DataFrame) -> DataFrame:
    """Strings that runs lie in, from rows of their glyphs, with `leads` for a run's first one, the width to wrap at and the step from line to line."""
    strings = runs.groupBy(*PAGE, *_RUN, "op_index", "item_index").agg(
        F.min("byte_offset").alias("span_start"), F.max(F.col("byte_offset") + F.col("byte_length")).alias("span_end"), F.min(F.struct("glyph_ord", "height")).alias("begin")
    )
    place = F.struct("op_index", F.coalesce("item_index", F.lit(-1)).alias("item"))
    run = Window.partitionBy(*PAGE, "run")
    placed = strings.withColumn("leads", place == F.min(place).over(run)).withColumn("height", F.min("begin").over(run)["height"]).drop("begin")
    scaled = placed.withColumn("scale", F.when(F.col("font_size") > 0, F.col("height") / F.col("font_size")).otherwise(F.lit(1.0)))
    limit = F.when((F.col("scale") > 0) & (F.col("font_size") > 0), F.col("max_width") / (F.col("font_size") * F.col("scale")) * 1000)
    step = F.coalesce(F.col("leading") / F.when(F.col("scale") == 0, 1.0).otherwise(F.col("scale")), F.col("font_size") * 1.25)
    return scaled.select(*PAGE, "run", "font_res", "font_size", "new_text", "op_index", "item_index", "span_start", "span_end", "leads", limit.alias("limit"), step.alias("step"))


def squeezed(text: Column) -> Column:
    """A text with its white space squeezed."""
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def rewrite_runs(pages: DataFrame, runs: DataFrame, ops: DataFrame | None = None, own_font: bool = False) -> DataFrame:
    """rewrite_text where pages lie: `pages` hold their `fonts`, `runs` are rows of the glyphs of runs.

    `runs`: doc_id, page, run, font_res, font_size, new_text (squeezed), max_width, leading, and a glyph's glyph_ord, op_index, item_index, byte_offset,
    byte_length and height; a string's first and last glyph in the run are enough. Runs and pages are read once; without `ops` pages are lexed where they
    lie. With `own_font` texts take the first string's place in their own font or fail. Returns EDITED columns of the pages with runs, `stand_in`, the
    name of the font to add, and further columns of `pages`.
    """
    asked = _by_page(_with_operations(_spans(runs), ops), "asked")
    held = pages.join(asked, PAGE).withColumn("coded", _coded(F.col("asked"), F.col("fonts")))
    shown = held.withColumn("switch", F.coalesce(free_name(F.col("fonts")), F.lit("A2FB"))) if not own_font else held.withColumn("switch", F.lit(None).cast("string"))
    nothing = F.lit(b"").cast("binary")

    def edit(asked: Column, coded: Column) -> Column:
        lines, other = coded["lines"], coded["other"]
        apart = F.lit(False) if own_font else asked["leads"] & (other | (F.size(lines) > 1))
        failed = lines.isNull() | other if own_font else lines.isNull()
        given = [asked[c].alias(c) for c in ("op", "operands", "start", "end")] if ops is not None else []
        return F.struct(
            *(asked[c].alias(c) for c in ("op_index", "item_index", "span_start", "span_end", "font_res", "font_size")), *given,
            F.when(asked["leads"] & ~apart, F.get(lines, F.lit(0))).otherwise(nothing).alias("replacement"),
            F.when(apart, lines).alias("lines"), F.when(apart & other, F.col("switch")).alias("switch"), asked["step"].alias("leading"), failed.alias("failed"),
        )

    met = F.filter(F.zip_with("asked", "coded", edit), lambda e: e["failed"] | e["op_index"].isNotNull())
    edited = shown.withColumn("edits", met).where(F.size("edits") > 0)
    why = "text has characters that its font can't encode" if own_font else "text has characters that no font at hand can encode"
    done = edited.withColumn("done", _applied(F.col("content"), F.col("edits"), why))
    stand_in = F.when(F.exists("coded", lambda c: c["other"]), F.col("switch")).alias("stand_in")
    return done.select(*PAGE, "done.*", stand_in, *(c for c in pages.columns if c not in (*PAGE, "content")))


def _runs(glyphs: DataFrame, wanted: DataFrame, how: str = "inner") -> DataFrame:
    """Rows of the glyphs of the runs of `wanted`; with `how` as left, a run without glyphs has a row without any."""
    needed = glyphs.select(F.col("doc_id").alias("of_doc"), F.col("page").alias("of_page"), "glyph_ord", "op_index", "item_index", "byte_offset", "byte_length", "height")
    return wanted.join(needed, F.expr("doc_id = of_doc and page = of_page and glyph_ord between run and run_end"), how)


def _holding(pages: DataFrame, fonts: DataFrame) -> DataFrame:
    """Pages with their fonts."""
    return pages.select(*PAGE, "content").join(_by_page(fonts, "fonts"), PAGE, "left")


def rewrite_text(pages: DataFrame, ops: DataFrame | None, glyphs: DataFrame, fonts: DataFrame, targets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Replace runs of glyphs by new text: in their own font, else in a stand-in one; wrapped, if a width is given.

    `targets`: doc_id, page, glyph_lo, glyph_hi, font_res, font_size, new_text (white space is squeezed, empty
    texts are left out), max_width and leading in page units (null: one line; a step of 1.25 sizes). A text of one line in its own
    font takes the first string's place, byte for byte; otherwise that string's operation is taken apart, lines go
    down by the leading, and the font is switched and switched back. What the run has in other
    strings goes. Runs of a page must not share glyphs. A text that neither font can encode changes
    nothing and is named in `error`.

    Returns EDITED rows of the pages with targets, and the stand-in fonts (doc_id, page, font_res,
    subtype, base_font, encoding): one for each page that needs it, under a name that no font there has.
    """
    wanted = targets.select(
        *PAGE, F.col("glyph_lo").cast("long").alias("run"), F.col("glyph_hi").cast("long").alias("run_end"), "font_res", F.col("font_size").cast("double").alias("font_size"),
        squeezed(F.col("new_text")).alias("new_text"), F.col("max_width").cast("double").alias("max_width"), F.col("leading").cast("double").alias("leading"),
    ).where("new_text <> ''")
    rows = rewrite_runs(_holding(pages, fonts), _runs(glyphs, wanted), ops)
    names = rows.where("stand_in is not null")
    return rows.drop("stand_in", "fonts"), names.select(*PAGE, F.col("stand_in").alias("font_res"), *(F.lit(v).alias(k) for k, v in STAND_IN.items()))


def replace_text(pages: DataFrame, ops: DataFrame | None, glyphs: DataFrame, fonts: DataFrame, targets: DataFrame) -> DataFrame:
    """rewrite_text of one line for each target (doc_id, page, glyph_lo, glyph_hi, font_res, new_text), in its own font only.

    A text that the font can't encode changes nothing and is named in `error`. Returns EDITED rows of the pages with targets.
    """
    missing = F.lit(None).cast("double")
    wanted = targets.select(
        *PAGE, F.col("glyph_lo").cast("long").alias("run"), F.col("glyph_hi").cast("long").alias("run_end"), "font_res",
        missing.alias("font_size"), squeezed(F.col("new_text")).alias("new_text"), missing.alias("max_width"), missing.alias("leading"),
    ).where("new_text <> ''")
    return rewrite_runs(_holding(pages, fonts), _runs(glyphs, wanted, "left"), ops, own_font=True).drop("stand_in", "fonts")
