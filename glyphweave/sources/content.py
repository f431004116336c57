"""Page content streams to operations, and operations to glyphs.

Both are folds that compose: what a run of bytes does to the lexer's state, and a run of
operations to the graphics state, is a small value of its own, and such values one after the
other say in which state each part of a long page begins. So short pages are folded whole,
and the parts of a long one by as many tasks as it has parts.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable, Iterator, Sequence
from itertools import islice
from typing import Any, NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from glyphweave.functions.fontmetrics import glyph_name, standard, standard_width, win_ansi
from glyphweave.sources import lexing
from glyphweave.sources.lexing import operations

OPERANDS = "array<struct<arg:int,item:int,kind:string,num:double,raw:binary>>"
OPS_SCHEMA = f"doc_id long, page int, op_index int, op string, operands {OPERANDS}, start int, end int"
GLYPH_SCHEMA = (
    "doc_id long, page int, glyph_ord long, unicode string, code int, x double, y double, width double, height double,"
    " font_res string, font_size double, op_index int, item_index int, byte_offset int, byte_length int"
)
FONT_SCHEMA = (
    "doc_id long, page int, font_res string, subtype string, base_font string, encoding string, differences string,"
    " to_unicode map<int,string>, widths map<int,double>, default_width double, two_byte boolean"
)

#: Bytes of a page that one task reads; longer pages are cut.
PIECE = 1 << 18
#: Operations of a page that one task folds; longer pages are cut where a text object or an absolute place begins.
BLOCK = 4096
#: Bytes of a page that one task reads and folds where its stream lies; the pieces and blocks of longer pages go to several tasks.
WHOLE = 1 << 21


def parse_operations(pages: DataFrame, piece: int | None = PIECE) -> DataFrame:
    """OPS_SCHEMA rows of `pages` (doc_id, page, content): op_index counts from 0 in a page.

    An operand is a row of `operands`: arg numbers operands, item the things in an array (null
    outside), kind is n (number), s (string), / (name), b (true, false or null), [ (an array, whose items
    follow) or j (anything else, as JSON). Null contents have no operations. Pages of over
    `piece` bytes are cut where operations end, and their parts are read by several tasks,
    for which `pages` is read three times and must be the same each time; without `piece` every page is read whole, and once.
    """
    kept = pages.select("doc_id", "page", "content").where("content is not null")
    short = kept if piece is None else kept.where(F.octet_length("content") <= piece)
    whole = short.select("doc_id", "page", F.lit(0).alias("at"), F.lit(0).cast("long").alias("ops"), "content")
    if piece is not None:
        whole = whole.unionByName(parts(kept.where(F.octet_length("content") > piece), piece))
    return whole.mapInArrow(_parse, OPS_SCHEMA)


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Operations of (doc_id, page, at, ops, content): a stream, or a part of one that begins `at` bytes and `ops` operations later."""
    for batch in batches:
        held, rows, size = [], [], 0
        for k in range(batch.num_rows):
            found = lexing.lex(batch.column(4)[k].as_buffer().to_pybytes())
            if len(found.names):
                held.append(found)
                rows.append(k)
                size += len(found.names)
            if held and (size > 100_000 or k == batch.num_rows - 1):
                yield _operation_rows(batch, rows, held)
                held, rows, size = [], [], 0
        if held:
            yield _operation_rows(batch, rows, held)


def _operation_rows(batch: pa.RecordBatch, rows: list[int], lexed: list[lexing.Lexed]) -> pa.RecordBatch:
    counts = [len(f.names) for f in lexed]
    of = pa.array(np.repeat(rows, counts))
    at, before = (np.repeat(batch.column(c).to_numpy()[rows], counts) for c in (2, 3))
    index = np.concatenate([np.arange(c) for c in counts]) + before
    names = pa.array([n for f in lexed for n in f.names], pa.string())
    spans = [pa.array((np.concatenate([getattr(f, c) for f in lexed]) + at).astype(np.int32)) for c in ("starts", "ends")]
    columns = [batch.column(0).take(of), batch.column(1).take(of), pa.array(index.astype(np.int32)), names, lexing.operand_array(lexed), *spans]
    return pa.RecordBatch.from_arrays(columns, names=["doc_id", "page", "op_index", "op", "operands", "start", "end"])


def parts(pages: DataFrame, piece: int) -> DataFrame:
    """(doc_id, page, at, ops, content): parts of long streams that begin and end between operations, dealt over the tasks.

    Pieces tell what they do from each begin state; what a page does is these maps one after the other.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc, page, content in zip(*batch.columns, strict=True):
                data, at = content.as_buffer().to_pybytes(), 0
                for end in lexing.piece_ends(data, piece):
                    yield pa.RecordBatch.from_pydict({"doc_id": [doc.as_py()], "page": [page.as_py()], "at": [at], "piece": [data[at:end]]}, _PIECES)
                    at = end

    def tell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                maps, deeper = lexing.transitions(batch.column(3)[k].as_buffer().to_pybytes())
                states = [{"end": e, "n_ops": n, "cut": c} for e, n, c in maps]
                yield pa.RecordBatch.from_arrays([*(c.slice(k, 1) for c in batch.columns[:3]), pa.array([states], _STATES), pa.array([deeper], pa.int32())], names=["doc_id", "page", "at", "states", "deeper"])

    pieces = pages.mapInArrow(cut, "doc_id long, page int, at long, piece binary").repartition("doc_id", "page", "at")
    told = pieces.mapInArrow(tell, "doc_id long, page int, at long, states array<struct<end:int,n_ops:long,cut:long>>, deeper int")
    ordered = F.array_sort(F.collect_list(F.struct("at", "states", "deeper"))).alias("pieces")
    begun = F.struct(F.lit(0).alias("state"), F.lit(0).cast("long").alias("ops"), F.array(F.struct(F.lit(0).cast("long").alias("at"), F.lit(0).cast("long").alias("ops"))).alias("parts"))

    def after(done: Column, p: Column) -> Column:
        known = done["state"] < F.size(p["states"])
        met = p["states"][F.when(known, done["state"]).otherwise(F.lit(0))]
        part = F.struct((p["at"] + met["cut"]).alias("at"), (done["ops"] + 1).alias("ops"))
        more = F.when(known & (met["cut"] >= 0), F.concat(done["parts"], F.array(part))).otherwise(done["parts"])
        return F.struct(
            F.when(known, met["end"]).otherwise(done["state"] + p["deeper"]).cast("int").alias("state"),
            F.when(known, done["ops"] + met["n_ops"]).otherwise(done["ops"]).alias("ops"),
            more.alias("parts"),
        )

    composed = told.groupBy("doc_id", "page").agg(ordered).select("doc_id", "page", F.aggregate("pieces", begun, after)["parts"].alias("parts"))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc, page, content, where in zip(*batch.columns, strict=True):
                data, spots = content.as_buffer(), where.as_py()
                for spot, end in zip(spots, [*(s["at"] for s in spots[1:]), data.size], strict=True):
                    row = {"doc_id": [doc.as_py()], "page": [page.as_py()], "at": [spot["at"]], "ops": [spot["ops"]], "content": [data[spot["at"] : end].to_pybytes()]}
                    yield pa.RecordBatch.from_pydict(row, _PARTS)

    joined = pages.join(composed, ["doc_id", "page"]).select("doc_id", "page", "content", "parts")
    return joined.mapInArrow(deal, "doc_id long, page int, at int, ops long, content binary").repartition("doc_id", "page", "at")


_PIECES = pa.schema({"doc_id": pa.int64(), "page": pa.int32(), "at": pa.int64(), "piece": pa.binary()})
_PARTS = pa.schema({"doc_id": pa.int64(), "page": pa.int32(), "at": pa.int32(), "ops": pa.int64(), "content": pa.binary()})
_STATES = pa.list_(pa.struct({"end": pa.int32(), "n_ops": pa.int64(), "cut": pa.int64()}))


def simple_encoding(base: str | None, differences: list | None) -> dict[int, str]:
    """Code to character of a one-byte font: a base table, then listed differences (numbers set the code, names fill it)."""
    table = standard if base == "StandardEncoding" else win_ansi
    out = {c: chr(u) for c in range(256) if (u := table(c))}
    code = 0
    for d in differences or []:
        if isinstance(d, int | float):
            code = int(d)
            continue
        char = glyph_name(d)
        if char is None:
            out.pop(code, None)
        else:
            out[code] = chr(char)
        code += 1
    return out


class Font:
    """Character and width of codes. Two-byte fonts have only what their maps say."""

    def __init__(self, row: dict):
        row = {k: None if isinstance(v, float) and v != v else v for k, v in row.items()}
        self.base, self.wide = row.get("base_font") or "", bool(row.get("two_byte"))
        cid = row.get("subtype") == "Type0"
        maps = {k: dict(row.get(k) or {}) for k in ("to_unicode", "widths")}
        listed = row.get("differences")
        simple = {} if cid else simple_encoding(row.get("encoding"), json.loads(listed) if listed else None)
        self.chars = simple | maps["to_unicode"]
        self.widths = maps["widths"]
        self.default = row.get("default_width") or (1000.0 if cid else 0.0)
        self.moved: dict[tuple, tuple[np.ndarray, list[float]]] = {}

    def _look(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        chars = [self.chars.get(code, "") for code in codes.tolist()]
        known = [self.widths.get(code) or self.default or standard_width(self.base, ord(char[0]) if char else 32) for code, char in zip(codes.tolist(), chars, strict=True)]
        return np.array([*chars, None], object)[:-1], np.array(known, np.float64)

    def decode(self, data: bytes) -> tuple[int, np.ndarray, np.ndarray, np.ndarray]:
        """(bytes of a code, codes, characters, widths) of a string."""
        if self.wide:
            codes = np.frombuffer(data, ">u2", len(data) // 2).astype(np.int32)
            met, spot = np.unique(codes, return_inverse=True)
            chars, widths = self._look(met)
            return 2, codes, chars[spot], widths[spot]
        codes = np.frombuffer(data, np.uint8).astype(np.int32)
        chars, widths = self.narrow()
        return 1, codes, chars[codes], widths[codes]

    def narrow(self) -> tuple[np.ndarray, np.ndarray]:
        """Characters and widths of the codes of a one-byte font."""
        if not hasattr(self, "bytes"):
            self.bytes = self._look(np.arange(256))
        return self.bytes

    def moves(self, size: float, spacing: float, between: float, scale: float) -> tuple[np.ndarray, list[float]]:
        """How far each code of a one-byte font moves the text: as an array, and as a list for short strings."""
        key = (size, spacing, between, scale)
        if key not in self.moved:
            if len(self.moved) >= 200:
                self.moved.clear()
            forward = (self.narrow()[1] / 1000 * size + spacing + np.where(np.arange(256) == 32, between, 0.0)) * scale
            self.moved[key] = forward, forward.tolist()
        return self.moved[key]

    def encode(self, text: str) -> bytes | None:
        """Codes of a text, the first code of each character; None if one has none."""
        if not hasattr(self, "codes"):
            self.codes: dict[str, bytes] = {}
            for code, char in self.chars.items():
                if len(char) == 1 and char not in self.codes:
                    self.codes[char] = code.to_bytes(2 if self.wide else 1, "big")
        found = [self.codes.get(c) for c in text]
        return None if None in found else b"".join(found)

    def measure(self, text: str) -> float | None:
        """Width of a text in thousandths of an em; None if the font can't encode it."""
        coded = self.encode(text)
        if coded is None:
            return None
        return float((self.decode(coded)[3] if self.wide else self.narrow()[1][np.frombuffer(coded, np.uint8)]).sum())


_FONTS: dict[str, Font] = {}


def font_of(row: dict) -> Font:
    """The font of a row; pages that say the same of a font share it. The store is emptied when it holds 200."""
    said = repr(sorted((k, v) for k, v in row.items() if k not in ("doc_id", "page", "font_res")))
    if said not in _FONTS:
        if len(_FONTS) >= 200:
            _FONTS.clear()
        _FONTS[said] = Font(row)
    return _FONTS[said]


def _times(p: tuple, q: tuple) -> tuple:
    a, b, c, d, e, f = p
    return (
        a * q[0] + b * q[2], a * q[1] + b * q[3], c * q[0] + d * q[2], c * q[1] + d * q[3],
        e * q[0] + f * q[2] + q[4], e * q[1] + f * q[3] + q[5],
    )


_ONE = (1.0, 0.0, 0.0, 1.0, 0.0, 0.0)


#: Text state: what a string is shown with, besides the matrices.
TEXT_STATE = {"res": "", "size": 0.0, "Tc": 0.0, "Tw": 0.0, "Tz": 1.0, "TL": 0.0, "Ts": 0.0}
Leaf = tuple[int, int | None, str, float | None, bytes | None]


def _num(args: list[Leaf], k: int, other: float = 0.0) -> float:
    """Operand k, if it is a number."""
    leaf = args[k] if k < len(args) and args[k][0] == k else next((x for x in args if x[0] == k), None)
    return leaf[3] if leaf is not None and leaf[2] == "n" else other


def _matrix(args: list[Leaf]) -> tuple:
    if len(args) == 6 and all([a[2] == "n" and a[1] is None for a in args]):
        return tuple([a[3] for a in args])
    return _num(args, 0, 1.0), _num(args, 1), _num(args, 2), _num(args, 3, 1.0), _num(args, 4), _num(args, 5)


def said_by(op: str, args: list[Leaf]) -> dict[str, Any] | None:
    """What an operation sets in the text state."""
    if op == "Tf":
        name = args[0][4].decode("latin-1") if args and args[0][2] == "/" else ""
        return {"res": name, "size": _num(args, 1)}
    if op in ("TL", "Tc", "Tw", "Ts"):
        return {op: _num(args, 0)}
    if op == "Tz":
        return {"Tz": _num(args, 0, 100.0) / 100}
    if op == "TD":
        return {"TL": -_num(args, 1)}
    if op == '"':
        return {"Tw": _num(args, 0), "Tc": _num(args, 1)}
    return None


class State:
    """Page matrix, text state, and what q saved. With `strict`, q and Q keep the text state too."""

    def __init__(self, strict: bool, entry: str | None = None):
        self.strict = strict
        ctm, text, saved = json.loads(entry) if entry else (_ONE, TEXT_STATE, [])
        self.ctm, self.text, self.saved = tuple(ctm), dict(text), [(tuple(m), t) for m, t in saved]

    def entry(self) -> str:
        return json.dumps((self.ctm, self.text, self.saved))

    def then(self, effect: dict) -> None:
        """Apply what a run of operations does, as `effect_of` gives it."""
        for said in effect["pops"]:
            self.text |= said
            if self.saved:
                self.ctm, text = self.saved.pop()
                self.text = dict(text) if self.strict else self.text
            else:
                self.ctm = _ONE
        self.saved += [(_times(tuple(m), self.ctm), self.text | said) for m, said in effect["pushes"]]
        self.ctm, self.text = _times(tuple(effect["matrix"]), self.ctm), self.text | effect["said"]


def effect_of(ops: Iterator[tuple[str, list[Leaf]]], strict: bool) -> dict:
    """What operations do to any state: levels popped that they didn't push, and on the level below those a matrix, what they set, and what they pushed."""
    matrix, said, pops, pushes = _ONE, {}, [], []
    for op, args in ops:
        if op == "q":
            pushes.append((matrix, dict(said)))
        elif op == "Q":
            if pushes:
                matrix, before = pushes.pop()
                said = before if strict else said
            else:
                pops.append(said)
                matrix, said = _ONE, {}
        elif op == "cm":
            matrix = _times(_matrix(args), matrix)
        else:
            said |= said_by(op, args) or {}
    return {"matrix": matrix, "said": said, "pops": pops, "pushes": pushes}


#: Strings of up to so many codes are walked code by code; longer ones as arrays.
_SHORT = 16
_NUMBERS = frozenset(("TL", "Tc", "Tw", "Ts"))
_SAYING = frozenset(("Tf", "Tz", "TD", '"'))


class Shown(NamedTuple):
    """A string as it is shown; its glyphs' columns are made for many strings at once."""

    font: Font
    value: bytes
    along: np.ndarray | list[float]  # where each code begins on the line, and where the last one ends
    across: np.ndarray | None  # the same across it; None on a level line, where it stays
    tm: tuple
    ctm: tuple
    res: str
    size: float
    scale: float
    rise: float
    op_index: int
    item: int  # -1 outside an array

    @property
    def n(self) -> int:
        return len(self.along) - 1


def strings_of(ops: Iterable[tuple[int, str, list[Leaf]]], fonts: dict[str, Font], state: State) -> Iterator[Shown]:
    """Strings that operations show from `state` on. One in an unknown font or at size 0 shows and moves nothing."""
    tm = line = _ONE
    ctm, text, saved, strict = state.ctm, dict(state.text), list(state.saved), state.strict

    def show(value: bytes | None, op_index: int, item: int) -> Shown | None:
        nonlocal tm
        font, size = fonts.get(text["res"]), text["size"]
        if not font or not size or not value or font.wide and len(value) < 2:
            return None
        hs, across, before = text["Tz"], None, tm
        if font.wide:
            forward = (font.decode(value)[3] / 1000 * size + text["Tc"] + 0.0) * hs
        elif len(value) <= _SHORT and tm[1] == 0 and ctm[1] == 0:
            wide, at = tm[0], tm[4]
            each, along = font.moves(size, text["Tc"], text["Tw"], hs)[1], [at]
            for code in value:
                at += each[code] * wide
                along.append(at)
            tm = (wide, tm[1], tm[2], tm[3], at, tm[5])
            return Shown(font, value, along, None, before, ctm, text["res"], size, hs, text["Ts"], op_index, item)
        else:
            forward = font.moves(size, text["Tc"], text["Tw"], hs)[0][np.frombuffer(value, np.uint8)]
        along = np.cumsum(np.concatenate([[tm[4]], forward * tm[0]]))
        if tm[1] != 0 or ctm[1] != 0:  # else a level line: all characters have one height
            across = np.cumsum(np.concatenate([[tm[5]], forward * tm[1]]))
        tm = (*tm[:4], float(along[-1]), tm[5] if across is None else float(across[-1]))
        return Shown(font, value, along, across, before, ctm, text["res"], size, hs, text["Ts"], op_index, item)

    for k, op, args in ops:
        if op in _NUMBERS:
            text[op] = _num(args, 0)
        elif op == "q":
            saved.append((ctm, dict(text) if strict else text))
        elif op == "Q":
            ctm, before = saved.pop() if saved else (_ONE, text)
            text = dict(before) if strict else text
        elif op == "cm":
            ctm = _times(_matrix(args), ctm)
        elif op == "Tm":
            tm = line = _matrix(args)
        elif op == "BT":
            tm = line = _ONE
        else:
            if op in _SAYING:
                text |= said_by(op, args) or {}
            moved = None
            if op in ("Td", "TD"):
                moved = _num(args, 0), _num(args, 1)
            elif op in ("T*", "'", '"'):
                moved = 0.0, -text["TL"]
            if moved:
                tm = line = _times((1, 0, 0, 1, *moved), line)
            if op in ("Tj", "'", '"'):
                spot = 2 if op == '"' else 0
                if shown := show(next((x[4] for x in args if x[0] == spot and x[2] == "s"), None), k, -1):
                    yield shown
            elif op == "TJ" and args and args[0][2] == "[":
                for _, item, kind, num, raw in args[1:]:
                    if item is None:
                        break
                    if kind == "n":
                        tm = _times((1, 0, 0, 1, -num / 1000 * text["size"] * text["Tz"], 0), tm)
                    elif kind == "s" and (shown := show(raw, k, item)):
                        yield shown


PLACING = ("q", "Q", "cm", "Tf", "TL", "Tc", "Tw", "Ts", "Tz", "TD", '"')
SHOWING = (*PLACING, "BT", "Td", "Tm", "T*", "Tj", "'", "TJ")
_SHOWING = frozenset(SHOWING)
_KEY = ["doc_id", "page", "segment"]


def key_runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Runs of equal keys in sorted batches, each run whole."""
    held: list[pa.RecordBatch] = []
    before = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(k).to_numpy(zero_copy_only=False) for k in keys]
        edges = np.flatnonzero(np.logical_or.reduce([c[1:] != c[:-1] for c in columns])) + 1
        bounds = [0, *edges.tolist(), batch.num_rows]
        for a, b in zip(bounds[:-1], bounds[1:], strict=True):
            here = tuple(c[a] for c in columns)
            if before is not None and here != before:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
            before = here
    if held:
        yield pa.Table.from_batches(held)


def _leaves(operands: pa.ChunkedArray) -> list[list[Leaf]]:
    """Operands of operations as lists of (arg, item, kind, num, raw)."""
    column = operands.combine_chunks()
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    offsets = column.offsets.to_numpy()
    flat = list(zip(*(c.slice(offsets[0], offsets[-1] - offsets[0]).to_pylist() for c in (column.values.field(k) for k in range(5))), strict=True))
    bounds = (offsets - offsets[0]).tolist()
    return [flat[a:b] for a, b in zip(bounds[:-1], bounds[1:], strict=True)]


def _segments(shown: DataFrame, block: int) -> tuple[DataFrame, DataFrame]:
    """Operations with their segment, the number of the operation that it begins with; and the pages that have several."""
    page = ["doc_id", "page"]
    placed = shown.withColumn("block", F.floor(F.col("op_index") / block).cast("int"))
    resets = F.min(F.when(F.col("op").isin("BT", "Tm"), F.col("op_index"))).alias("cut")
    blocks = placed.where("block > 0").groupBy(*page, "block").agg(resets)
    last = F.last("cut", ignorenulls=True).over(Window.partitionBy(*page).orderBy("block").rowsBetween(Window.unboundedPreceding, -1))
    cuts = blocks.withColumn("before", F.coalesce(last, F.lit(0)))
    segment = F.coalesce(F.when(F.col("op_index") >= F.col("cut"), F.col("cut")), F.col("before"), F.lit(0)).alias("segment")
    kept = placed.join(cuts, [*page, "block"], "left").select(*page, segment, "op_index", "op", "operands")
    return kept, cuts.where("cut is not null").select(*page).distinct()


def _entries(kept: DataFrame, strict: bool) -> DataFrame:
    """(doc_id, page, segment, entry): the state in which each segment of `kept` begins but for the first of a page.

    Effects of segments are found in as many tasks, then applied one after the other, a row for each segment.
    """

    def effects(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for run in key_runs(batches, _KEY):
            effect = effect_of(zip(run.column("op").to_pylist(), _leaves(run.column("operands")), strict=True), strict)
            yield pa.RecordBatch.from_arrays([*(run.column(k).slice(0, 1).combine_chunks() for k in _KEY), pa.array([json.dumps(effect)])], names=[*_KEY, "effect"])

    def compose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for run in key_runs(batches, _KEY[:2]):
            state, found = State(strict), []
            for effect in run.column("effect").to_pylist():
                found.append(state.entry())
                state.then(json.loads(effect))
            rows = run.select(_KEY).append_column("entry", pa.array(found)).slice(1)
            yield from rows.to_batches()

    placing = kept.where(F.col("op").isin(*PLACING, "BT", "Tm")).repartition(*_KEY).sortWithinPartitions(*_KEY, "op_index")
    told = placing.mapInArrow(effects, "doc_id long, page int, segment int, effect string")
    return told.repartition(*_KEY[:2]).sortWithinPartitions(*_KEY).mapInArrow(compose, "doc_id long, page int, segment int, entry string")


def extract_glyphs(ops: DataFrame, fonts: DataFrame, strict: bool = False, block: int | None = None, tasks: int | None = None) -> DataFrame:
    """GLYPH_SCHEMA rows of operations: glyph_ord ascends in the order of a page's strings and characters.

    q and Q keep only the page matrix, as the files this reads expect; with `strict` they
    keep the text state too. Operations that show and move nothing are dropped before the shuffle.
    With `block` (such as BLOCK), a page of over so many operations is cut at text objects (BT) and absolute places (Tm), one a block at
    most; its segments are folded by tasks of their own, from the states that the effects of those before add up to.
    `ops` is read several times then; without `block` every page is one segment, and it is read once: its glyphs follow each other in one task.
    Pages are dealt over so many `tasks`, if given.
    """
    page = ["doc_id", "page"]
    shown = ops.where(ops["op"].isin(*SHOWING)).select(*page, "op_index", "op", "operands")
    known = fonts.groupBy(*page).agg(F.collect_list(F.struct(*(c for c in fonts.columns if c not in page))).alias("fonts"))
    starts = known.select(*page, F.lit(0).alias("segment"), F.lit(None).cast("string").alias("entry"), "fonts")
    if block is None:
        kept = shown.select(*page, F.lit(0).alias("segment"), "op_index", "op", "operands")
    else:
        kept, long = _segments(shown, block)
        entries = _entries(kept.join(long, page, "left_semi"), strict)
        starts = starts.unionByName(entries.join(known, page).select(*_KEY, "entry", "fonts"))
    heads = starts.select(*_KEY, F.lit(-1).alias("op_index"), F.lit(None).cast("string").alias("op"), F.lit(None).cast(OPERANDS).alias("operands"), "entry", "fonts")
    nothing = F.lit(None).cast("string").alias("entry"), F.lit(None).cast(known.schema["fonts"].dataType).alias("fonts")
    dealt = kept.select("*", *nothing).unionByName(heads).repartition(*([tasks] if tasks else []), *_KEY).sortWithinPartitions(*_KEY, "op_index")
    names = [f.split()[0] for f in GLYPH_SCHEMA.split(", ")]

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for run in key_runs(batches, _KEY):
            index = run.column("op_index")
            if index[0].as_py() >= 0:  # a page without fonts shows nothing
                continue
            fonts_ = {r["font_res"]: font_of(r) for r in run.column("fonts")[0].as_py()}
            entry, body = run.column("entry")[0].as_py(), run.slice(1)
            if not body.num_rows:
                continue
            ops_ = zip(body.column("op_index").to_pylist(), body.column("op").to_pylist(), _leaves(body.column("operands")), strict=True)
            shown_ = list(strings_of(ops_, fonts_, State(strict, entry)))
            at = 0
            while at < len(shown_):
                end = min(at + 2000, len(shown_))
                while end < len(shown_) and shown_[end].op_index == shown_[end - 1].op_index:  # strings of an operation stay together
                    end += 1
                yield glyph_rows([(run.column("doc_id")[0].as_py(), run.column("page")[0].as_py(), shown_[at:end])], names)
                at = end

    return dealt.mapInArrow(fold, GLYPH_SCHEMA)


def with_fonts(pages: DataFrame, fonts: DataFrame | None) -> DataFrame:
    """doc_id, page, content and the fonts of pages that have both. Nothing is shuffled if the two are dealt by page alike, or if `fonts` is null and pages hold theirs."""
    page = ["doc_id", "page"]
    if fonts is None:
        return pages.select(*page, "content", "fonts").where("content is not null and fonts is not null")
    known = fonts.groupBy(*page).agg(F.collect_list(F.struct(*(c for c in fonts.columns if c not in page))).alias("fonts"))
    return pages.select(*page, "content").where("content is not null").join(known, page)


Held = list[tuple[int, int, list[Shown]]]


def count_glyphs(content: Column, fonts: Column) -> Column:
    """How many glyphs a page's stream shows with its fonts."""

    def counted(contents: pa.Array, fonts_: pa.Array) -> pa.Array:
        known, have = None, {}
        out = []
        for k, ops in _streams(pc.fill_null(contents, b"")):
            if fonts_[k] != known:
                known = fonts_[k]
                have = {r["font_res"]: font_of(r) for r in known.as_py() or ()}
            out.append(sum(s.n for s in strings_of(ops, have, State(False))))
        return pa.array(out, pa.int64())

    return arrow_udf(counted, "long")(content, fonts)


def shown_pages(batches: Iterator[pa.RecordBatch], strict: bool, whole: bool) -> Iterator[Held]:
    """Strings of the pages of `with_fonts` (doc_id, page, strings), as many pages together as have 100,000 glyphs.

    A page with more goes in several parts, but for `whole`; strings of an operation stay together.
    """
    for batch in batches:
        held: Held = []
        n = 0
        said, known, fonts = batch.column(3), None, {}
        for k, ops in _streams(batch.column(2)):
            doc, page = batch.column(0)[k].as_py(), batch.column(1)[k].as_py()
            if said[k] != known:
                known = said[k]
                fonts = {r["font_res"]: font_of(r) for r in known.as_py()}
            run: list[Shown] = []
            for string in strings_of(ops, fonts, State(strict)):
                if n > 100_000 and not whole and not (run and run[-1].op_index == string.op_index):
                    yield [*held, *([(doc, page, run)] if run else [])]
                    held, run, n = [], [], 0
                run.append(string)
                n += len(string.value)
            if run:
                held.append((doc, page, run))
            if n > 100_000 and held:
                yield held
                held, n = [], 0
        if held:
            yield held


def read_glyphs(pages: DataFrame, fonts: DataFrame | None, strict: bool = False, columns: Sequence[str] | None = None, kept: Callable[[pa.RecordBatch], np.ndarray] | None = None) -> DataFrame:
    """extract_glyphs of all operations of `pages` (doc_id, page, content): a page is lexed and folded where its stream lies.

    A page goes whole to one task, as with parse_operations' piece=None and extract_glyphs' block=None, but operations are no rows: if pages and fonts are
    dealt by page alike, nothing is shuffled. Only `columns` of GLYPH_SCHEMA are made, if given, and only the glyphs are rows for which `kept` is true
    of a batch of all columns of the glyphs of whole pages.
    """
    kinds = {f.split()[0]: f for f in GLYPH_SCHEMA.split(", ")}
    names = list(columns or kinds)

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in shown_pages(batches, strict, kept is not None):
            if kept is None:
                yield glyph_rows(held, names)
            else:
                rows = glyph_rows(held, list(kinds))
                yield rows.select(names).filter(pa.array(kept(rows)))

    return with_fonts(pages, fonts).mapInArrow(fold, ", ".join(kinds[c] for c in names))


def read_all_glyphs(pages: DataFrame, longest: int | None = None, whole: int = WHOLE) -> DataFrame:
    """extract_glyphs of pages (doc_id, page, content, fonts) of any length: those of up to `whole` bytes are read where they lie, the parts of longer ones by several tasks.

    `pages` is read several times then, and must be the same each time; once, if `longest`, the bytes of the longest page, is known and no page is longer.
    """
    if longest is not None and longest <= whole:
        return read_glyphs(pages, None)
    short = F.octet_length("content") <= whole
    long = pages.where(~short)
    fonts = long.select("doc_id", "page", F.inline("fonts"))
    return read_glyphs(pages.where(short), None).unionByName(extract_glyphs(parse_operations(long), fonts, block=BLOCK))


STRING_SCHEMA = (
    "doc_id long, page int, op_index int, item_index int, glyph_lo long, glyph_hi long, text string, n_glyphs int, height double,"
    " byte_length int, code_length int"
)


def read_strings(pages: DataFrame, fonts: DataFrame | None, strict: bool = False, ops: Sequence[int] | None = None) -> DataFrame:
    """STRING_SCHEMA rows of the strings that pages show, those of some operations only if `ops` numbers them; read as read_glyphs does.

    glyph_lo and glyph_hi are the first and last glyph_ord, byte_length the bytes of all codes, code_length those of one.
    """
    fields = [(f.split()[0], {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "string": pa.string()}[f.split()[1]]) for f in STRING_SCHEMA.split(", ")]

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in shown_pages(batches, strict, False):
            rows = []
            for doc, page, strings in held:
                last, at = None, 0
                for s in strings:
                    at = at if s.op_index == last else 0
                    last, at = s.op_index, at + s.n
                    if ops is None or s.op_index in ops:
                        step = 2 if s.font.wide else 1
                        high = float(np.hypot(*(s.size * w for w in _times(s.tm, s.ctm)[2:4])))
                        first = (s.op_index << 31) + at - s.n
                        rows.append((doc, page, s.op_index, None if s.item < 0 else s.item, first, first + s.n - 1, "".join(s.font.decode(s.value)[2]), s.n, high, s.n * step, step))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, (_, kind) in zip(zip(*rows, strict=True), fields, strict=True)], names=[n for n, _ in fields])

    return with_fonts(pages, fonts).mapInArrow(fold, STRING_SCHEMA)


_KINDS = lexing.KINDS.tolist()


def lexed_lots(contents: Iterable[bytes]) -> Iterator[tuple[int, list[bytes], lexing.Lexed, np.ndarray]]:
    """Streams that are lexed at once, PIECE bytes or one: the first one's number, the streams, what they hold, and where the operations of each begin and end."""
    streams: list[bytes] = []
    first = size = 0
    for content in contents:
        streams.append(content)
        size += len(content)
        if size >= PIECE:
            yield first, streams, *lexing.lex_all(streams)
            first, streams, size = first + len(streams), [], 0
    if streams:
        yield first, streams, *lexing.lex_all(streams)


def _streams(contents: pa.Array) -> Iterator[tuple[int, Iterator[tuple[int, str, list[Leaf]]]]]:
    """The operations of each stream that show or move something, with operands as leaves; many short streams are lexed at once. Each must be read to its end, in order."""
    for first, _, found, bounds in lexed_lots(content.as_buffer().to_pybytes() for content in contents):
        counts, names = np.diff(found.offsets).tolist(), found.names
        items = np.where(found.item < 0, None, found.item).tolist()
        leaves = zip(found.arg.tolist(), items, map(_KINDS.__getitem__, found.kind.tolist()), found.num.tolist(), found.raw, strict=True)

        def operations_of(a: int, b: int, leaves: Iterator[Leaf] = leaves, counts: list[int] = counts, names: list[str] = names) -> Iterator[tuple[int, str, list[Leaf]]]:
            for n in range(a, b):
                args = list(islice(leaves, counts[n])) if counts[n] else []
                if names[n] in _SHOWING:
                    yield n - a, names[n], args

        for j, (a, b) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)):
            yield first + j, operations_of(a, b)


def glyph_rows(held: Held, names: Sequence[str]) -> pa.RecordBatch:
    """Rows of the glyphs of the strings that pages (doc_id, page, strings) show, with the columns `names` of GLYPH_SCHEMA."""
    strings = [s for _, _, shown in held for s in shown]
    sizes = np.array([s.n for s in strings], np.int64)
    ends = np.cumsum(sizes)
    n = int(ends[-1]) if len(ends) else 0
    of = np.repeat(np.arange(len(held)), [len(shown) for _, _, shown in held])  # the page of each string
    index = np.array([s.op_index for s in strings], np.int64)
    tm, ctm = (np.array([getattr(s, c) for s in strings], np.float64).reshape(-1, 6).T for c in ("tm", "ctm"))
    size, scale, rise = (np.array([getattr(s, c) for s in strings], np.float64) for c in ("size", "scale", "rise"))
    whole = [tm[0] * ctm[0] + tm[1] * ctm[2], tm[0] * ctm[1] + tm[1] * ctm[3], tm[2] * ctm[0] + tm[3] * ctm[2], tm[2] * ctm[1] + tm[3] * ctm[3]]
    tilted = [k for k, s in enumerate(strings) if s.across is not None]
    wide = [k for k, s in enumerate(strings) if s.font.wide]
    each = lambda column: np.repeat(column, sizes)

    fonts = list({id(s.font): s.font for s in strings if not s.font.wide}.values())
    nth = {id(f): k * 256 for k, f in enumerate(fonts)}
    codes = np.frombuffer(b"".join([bytes(s.n) if s.font.wide else s.value for s in strings]), np.uint8).astype(np.int32)
    spot = codes if len(fonts) < 2 else codes + each(np.array([nth.get(id(s.font), 0) for s in strings], np.int32))

    def looked_up(k: int) -> np.ndarray:
        """Characters (0) or widths (1) of all codes."""
        table = np.concatenate([f.narrow()[k] for f in fonts]) if fonts else np.array([""], object) if k == 0 else np.zeros(1)
        values = table[spot]
        for w in wide:
            values[ends[w] - sizes[w] : ends[w]] = strings[w].font.decode(strings[w].value)[2 + k]
        return values

    def placed(axis: int) -> np.ndarray:
        """x or y of all glyphs: along the line, moved by the rise and by the page's matrix."""
        lift = rise * whole[2 + axis]
        if axis == 0 or tilted:
            along = np.concatenate([s.along[:-1] for s in strings])
            across = each(tm[5])
            for t in tilted:
                across[ends[t] - sizes[t] : ends[t]] = strings[t].across[:-1]
            values = each(lift) + (along * each(ctm[axis]) + across * each(ctm[2 + axis]) + each(ctm[4 + axis]))
        else:
            values = each(lift + (tm[5] * ctm[3] + ctm[5]))
        return values

    def column(name: str) -> pa.Array:
        if name in ("doc_id", "page"):
            keys = np.array([h[name == "page"] for h in held], np.int64)[of]
            return pa.array(each(keys.astype(np.int32) if name == "page" else keys))
        if name == "glyph_ord":
            # strings of one operation follow each other: count on through all of them
            op, at = each(index), each(of)
            place = np.arange(n) - np.maximum.accumulate(np.where(np.append(True, (op[1:] != op[:-1]) | (at[1:] != at[:-1]))[:n], np.arange(n), 0))
            return pa.array((op << 31) + place)
        if name == "unicode":
            if wide or not fonts:
                return pa.array(looked_up(0), pa.string())
            return pa.array(np.concatenate([f.narrow()[0] for f in fonts]), pa.string()).take(pa.array(spot))
        if name == "code":
            values = codes.copy()
            for w in wide:
                values[ends[w] - sizes[w] : ends[w]] = strings[w].font.decode(strings[w].value)[1]
            return pa.array(values)
        if name in ("x", "y"):
            return pa.array(placed(int(name == "y")))
        if name == "width":
            return pa.array(looked_up(1) / 1000 * each(np.hypot(size * scale * whole[0], size * scale * whole[1])))
        if name == "height":
            return pa.array(each(np.hypot(size * whole[2], size * whole[3])))
        if name == "font_res":
            return pa.array([s.res for s in strings], pa.string()).take(pa.array(each(np.arange(len(strings)))))
        if name == "font_size":
            return pa.array(each(size))
        if name == "op_index":
            return pa.array(each(index.astype(np.int32)))
        if name == "item_index":
            item = each(np.array([s.item for s in strings], np.int32))
            return pa.array(item, mask=item < 0)
        step = np.array([2 if s.font.wide else 1 for s in strings], np.int32)
        if name == "byte_length":
            return pa.array(each(step))
        return pa.array(((np.arange(n) - each(ends - sizes)) * each(step)).astype(np.int32))

    return pa.RecordBatch.from_arrays([column(name) for name in names], names=list(names))


def parse_cmap(data: bytes) -> dict[int, str]:
    """Code to text of a ToUnicode map: single codes, and ranges with a first text or a list of texts."""
    out: dict[int, str] = {}
    text = lambda h: bytes.fromhex(h).decode("utf-16-be", "replace")
    for op, args, _, _ in operations(data):
        strings = [a["s"] if isinstance(a, dict) and "s" in a else a for a in args]
        if op == "endbfchar":
            out.update((int(c or "0", 16), text(t)) for c, t in zip(strings[::2], strings[1::2], strict=False) if isinstance(t, str))
        elif op == "endbfrange":
            for lo, hi, to in zip(strings[::3], strings[1::3], strings[2::3], strict=False):
                first, last = int(lo or "0", 16), int(hi or "0", 16)
                if isinstance(to, list):
                    out.update((first + k, text(t["s"])) for k, t in enumerate(to) if first + k <= last and isinstance(t, dict))
                    continue
                head, tail = text(to)[:-1], text(to)[-1:]
                out.update((c, head + chr(ord(tail) + c - first)) for c in range(first, min(last, first + 65535) + 1) if tail)
    return out
