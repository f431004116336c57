"""Content streams to operations, on whole arrays; and where a long stream may be cut.

Strings, comments and inline images are found one by one, as each hides what it
holds; all other tokens come from byte classes at once. An operation in which
arrays or dictionaries nest, or which is not well formed, is read by `operations`,
which says what all of this must give.

A page too long for one task is cut in pieces at white space. What a piece does
depends on the state it begins in: plain, in a comment, a hexadecimal string, an inline
image, or a string of some depth. `transitions` gives the end state, the operations and
the first operation's end for each of them; composing these in order tells where every
piece begins, and so where operations end near each piece's begin: there the page is cut
anew into parts that need nothing of each other.
"""

from __future__ import annotations

import json
import re
from dataclasses import dataclass, field
from typing import Any

import numpy as np
import pyarrow as pa

WHITE = b"\x00\t\n\x0c\r "
DELIMITERS = b"()<>[]{}/%"
NUM, NAME, WORD, TEXT, OPEN, CLOSE, NESTED, OTHER = range(8)
#: Kinds of operands: number, string, name, true, false or null, array (its items follow), and any other value as JSON.
KINDS = np.array(["n", "s", "/", "b", "[", "j"])
PLAIN, COMMENT, HEX, IMAGE, STRING = range(5)  # STRING + depth - 1

_CLASS = np.ones(256, np.uint8)
_CLASS[list(WHITE)] = 0
_CLASS[list(DELIMITERS)] = 2
_NUMERIC = np.zeros(256, bool)
_NUMERIC[list(b"0123456789.+-")] = True
_SPECIAL = re.compile(rb"\([^()\\\r]*\)|<(?:[0-9A-Fa-f]{2})*>|%|\(|<<|<|(?<![^\x00\t\n\x0c\r ()<>\[\]{}%])[0-9.+-]*BI(?![^\x00\t\n\x0c\r ()<>\[\]{}/%])")
_SIMPLE = re.compile(rb"[^()\\\r]*\)")
_LINE_END = re.compile(rb"[\r\n]")
IMAGE_END = re.compile(rb"[\x00\t\n\x0c\r ]EI(?=[\x00\t\n\x0c\r ]|$)")
_IN_TEXT = re.compile(rb"[^()\\\r]+|\\([0-7]{1,3}|\r\n|.)|[()]|\r\n?|\\$", re.S)
_ESCAPE = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}
_PART = re.compile(rb"[+-]?[0-9.]+|[+-]|[^0-9.+-].*", re.S)


def number(raw: bytes) -> float:
    """The longest leading number; 0 if there is none."""
    m = re.match(rb"[+-]?(\d+\.?\d*|\.\d+)", raw)
    return float(m[0]) if m else 0.0


def literal(data: bytes, at: int) -> tuple[bytes, int, int]:
    """A string that starts after its opening parenthesis, where it ends, and the parentheses still open at the data's end."""
    m = _SIMPLE.match(data, at)
    if m:
        return m[0][:-1], m.end(), 0
    out, depth = [], 1
    for m in iter(lambda: _IN_TEXT.match(data, at), None):
        piece, at = m[0], m.end()
        if piece == b"(":
            depth += 1
        elif piece == b")":
            depth -= 1
            if not depth:
                return b"".join(out), at, 0
        if piece[:1] == b"\\":
            e = m[1] or b""
            if e[:1].isdigit() and e < b"8":
                piece = bytes([int(e, 8) & 255])
            else:
                piece = b"" if e in (b"\n", b"\r", b"\r\n") else _ESCAPE.get(e, e)
        elif piece in (b"\r", b"\r\n"):
            piece = b"\n"
        out.append(piece)
    return b"".join(out), len(data), depth


def hexadecimal(raw: bytes) -> bytes:
    digits = re.sub(rb"[^0-9A-Fa-f]", b"", raw)
    return bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode())


def name_of(raw: bytes) -> bytes:
    """A name without its slash, escapes resolved."""
    return re.sub(rb"#([0-9A-Fa-f]{2})", lambda m: bytes([int(m[1], 16)]), raw[1:])


@dataclass
class Hidden:
    """What is opaque to byte classes: spans, and the tokens that they are (position, end, kind, value)."""

    spans: list[tuple[int, int]] = field(default_factory=list)
    tokens: list[tuple[int, int, int, bytes]] = field(default_factory=list)
    images: list[tuple[int, int]] = field(default_factory=list)
    end_state: int = PLAIN


def hidden(data: bytes) -> Hidden:
    """Strings, comments, opening double brackets and inline images of a stream that begins in plain state."""
    found, at = Hidden(), 0
    while m := _SPECIAL.search(data, at):
        here, raw = m.start(), m[0]
        if len(raw) > 1 and raw[0] == 40:  # a string without escapes
            at = m.end()
            found.tokens.append((here, at, TEXT, raw[1:-1]))
            found.end_state = PLAIN
        elif len(raw) > 1 and raw[0] == 60 and raw[1] != 60:
            at = m.end()
            found.tokens.append((here, at, TEXT, bytes.fromhex(raw[1:-1].decode())))
            found.end_state = PLAIN
        elif raw == b"(":
            value, at, depth = literal(data, m.end())
            found.tokens.append((here, at, TEXT, value))
            found.end_state = STRING + depth - 1 if depth else PLAIN
        elif raw == b"<":
            at = data.find(b">", m.end())
            found.end_state = HEX if at < 0 else PLAIN
            at = len(data) if at < 0 else at + 1
            found.tokens.append((here, at, TEXT, hexadecimal(data[here:at])))
        elif raw == b"<<":
            at = m.end()
            found.tokens.append((here, at, NESTED, b""))
        elif raw == b"%":
            end = _LINE_END.search(data, at := m.end())
            found.end_state = PLAIN if end else COMMENT
            at = end.start() if end else len(data)
        else:
            parts = [p[0] for p in _PART.finditer(raw)]
            for part in parts[:-1]:
                found.tokens.append((here, here + len(part), NUM, part))
                here += len(part)
            end = IMAGE_END.search(data, m.end())
            found.end_state = PLAIN if end else IMAGE
            at = end.end() if end else len(data)
            found.images.append((here, at))
            here = m.start()
        found.spans.append((here, at))
    return found


@dataclass
class Lexed:
    """Operations (names, starts, ends) and their operands, those of operation k from offsets[k] up to offsets[k + 1]."""

    names: list[str]
    starts: np.ndarray
    ends: np.ndarray
    offsets: np.ndarray
    arg: np.ndarray
    item: np.ndarray  # -1 outside arrays
    kind: np.ndarray  # numbers of KINDS
    num: np.ndarray  # not a number where there is none
    raw: list[bytes | None]
    hidden: Hidden

    def values(self, k: int) -> list:
        """Operands of operation k, as `operations` gives them."""
        at = range(int(self.offsets[k]), int(self.offsets[k + 1]))
        return values_of([{"arg": int(self.arg[j]), "item": int(self.item[j]) if self.item[j] >= 0 else None, "kind": KINDS[self.kind[j]], "num": float(self.num[j]), "raw": self.raw[j]} for j in at])


def _numbers(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Values of plain decimal numbers of at most 15 digits: a whole number over a power of ten, which rounds once."""
    whole, places, dotted = np.zeros(len(starts)), np.zeros(len(starts), np.int64), np.zeros(len(starts), bool)
    for k in range(int((ends - starts).max(initial=0))):
        c = buf[np.minimum(starts + k, len(buf) - 1)]
        digit = (starts + k < ends) & (c >= 48) & (c <= 57)
        whole = np.where(digit, whole * 10 + (c - 48.0), whole)
        places += digit & dotted
        dotted |= (c == 46) & (starts + k < ends)
    value = whole / 10.0**places
    return np.where(buf[starts] == 45, -value, value) if len(starts) else value


def lex(data: bytes) -> Lexed:
    """All operations of a stream that begins in plain state. What follows the last operator is dropped."""
    return _lexed(data, hidden(data), np.zeros(1, np.int64))


def lex_all(streams: list[bytes]) -> tuple[Lexed, np.ndarray]:
    """`lex` of several streams at once, and where the operations of each begin and end: those of stream k from bounds[k] up to bounds[k + 1].

    Their bytes stand one after the other with white space between, and so do starts and ends.
    """
    begins = np.cumsum([0, *(len(s) + 1 for s in streams)])
    opaque = Hidden()
    for stream, at in zip(streams, begins.tolist(), strict=False):
        own = hidden(stream)
        opaque.spans += [(a + at, b + at) for a, b in own.spans]
        opaque.tokens += [(a + at, b + at, kind, value) for a, b, kind, value in own.tokens]
        opaque.images += [(a + at, b + at) for a, b in own.images]
    found = _lexed(b"\n".join(streams), opaque, begins[:-1])
    return found, np.searchsorted(found.starts, begins)


def _lexed(data: bytes, opaque: Hidden, heads: np.ndarray) -> Lexed:
    """Operations of streams that begin at such places of `data`, each in plain state; what is opaque in them is known."""
    buf = np.frombuffer(data, np.uint8)
    cls = _CLASS[buf]
    for a, b in opaque.spans:
        cls[a:b] = 0
    regular = np.concatenate([[False], cls == 1, [False]])
    edges = np.flatnonzero(regular[1:] != regular[:-1])
    starts, ends = edges[::2], edges[1::2]
    marks = np.flatnonzero(cls == 2)
    slash = marks[buf[marks] == 47]
    before = np.maximum(starts - 1, 0)
    named = (starts > 0) & (cls[before] == 2) & (buf[before] == 47)
    named_at = starts[named] - 1
    empty = slash[~regular[slash + 2]]
    starts_, ends_ = starts[~named], ends[~named]
    # runs that are one number of plain form, runs that are one word, and others
    numeric = _NUMERIC[buf]
    first_numeric = numeric[starts_] if len(starts_) else np.zeros(0, bool)
    total = np.concatenate([[0], np.cumsum(numeric)])
    signs = np.concatenate([[0], np.cumsum((buf == 43) | (buf == 45))])
    dots = np.concatenate([[0], np.cumsum(buf == 46)])
    size = ends_ - starts_
    plain = first_numeric & (total[ends_] - total[starts_] == size) & (signs[ends_] - signs[np.minimum(starts_ + 1, ends_)] == 0) & (dots[ends_] - dots[starts_] <= 1) & (size <= 16)
    odd = first_numeric & ~plain
    angle = marks[buf[marks] == 62]
    begins = np.append(True, angle[1:] != angle[:-1] + 1) if len(angle) else np.zeros(0, bool)
    nth = np.arange(len(angle)) - np.maximum.accumulate(np.where(begins, np.arange(len(angle)), 0))
    paired = (nth % 2 == 0) & (np.append(angle[1:], -1) == angle + 1)
    second = (nth % 2 == 1)
    closing, lonely = angle[paired], angle[~paired & ~second]
    others = marks[(buf[marks] == 41) | (buf[marks] == 123) | (buf[marks] == 125)]
    opens, closes = marks[buf[marks] == 91], marks[buf[marks] == 93]

    slow: list[tuple[int, int, int, bytes]] = []
    for a, b in zip(starts_[odd].tolist(), ends_[odd].tolist(), strict=True):
        for part in _PART.finditer(data[a:b]):
            slow.append((a + part.start(), a + part.end(), NUM if _NUMERIC[part[0][0]] else WORD, part[0]))
    extra = [*slow, *opaque.tokens, *((a, b, WORD, b"BI") for a, b in opaque.images)]
    word_at = starts_[~first_numeric]
    pos = [starts_[plain], named_at, empty, word_at, opens, closes, closing, lonely, others, np.array([e[0] for e in extra], np.int64)]
    end = [ends_[plain], ends[named], empty + 1, ends_[~first_numeric], opens + 1, closes + 1, closing + 2, lonely + 1, others + 1, np.array([e[1] for e in extra], np.int64)]
    kinds = [np.full(len(p), k, np.int8) for p, k in zip(pos[:-1], (NUM, NAME, NAME, WORD, OPEN, CLOSE, NESTED, OTHER, OTHER), strict=True)]
    kinds.append(np.array([e[2] for e in extra], np.int8))
    pos, end, kinds = np.concatenate(pos), np.concatenate(end), np.concatenate(kinds)
    own = np.full(len(pos), -1)
    own[len(pos) - len(extra) :] = np.arange(len(extra))
    order = np.argsort(pos, kind="stable")
    pos, end, kinds, own = pos[order], end[order], kinds[order], own[order]

    words = np.flatnonzero(kinds == WORD)
    texts = [extra[o][3] if o >= 0 else data[a:b] for a, b, o in zip(pos[words].tolist(), end[words].tolist(), own[words].tolist(), strict=True)]
    constant = np.array([t in (b"true", b"false", b"null") for t in texts], bool)
    is_op = np.zeros(len(pos), bool)
    is_op[words[~constant]] = True
    ops = np.flatnonzero(is_op)
    decoded = {t: t.decode("latin-1") for t in set(texts)}
    names = [decoded[t] for t, c in zip(texts, constant.tolist(), strict=True) if not c]
    n = len(ops)
    last = ops[-1] + 1 if n else 0
    pos, end, kinds, own, is_op = pos[:last], end[:last], kinds[:last], own[:last], is_op[:last]
    if n and len(heads) > 1:  # what follows a stream's last operator is of none in the next
        stream = np.searchsorted(heads, pos, "right")
        kept = stream == stream[ops][np.cumsum(is_op) - is_op]
        pos, end, kinds, own, is_op = pos[kept], end[kept], kinds[kept], own[kept], is_op[kept]
        ops = np.flatnonzero(is_op)
    of = np.cumsum(is_op) - is_op  # the operation that a token belongs to
    first = np.concatenate([[0], ops[:-1] + 1]) if n else np.zeros(0, np.int64)

    depth = np.cumsum((kinds == OPEN).astype(np.int64) - (kinds == CLOSE))
    base = (depth[first] - ((kinds[first] == OPEN).astype(np.int64) - (kinds[first] == CLOSE))) if n else depth[:0]
    inner = depth - base[of]
    bad = np.zeros(n, bool)
    bad[of[(kinds == NESTED) | (inner < 0) | (inner > 1)]] = True
    bad |= inner[ops] != 0
    value = ((kinds <= TEXT) | (kinds == OPEN)) & ~is_op & ~bad[of]
    leaf = np.flatnonzero(value)
    top = (inner[leaf] == 0) | (kinds[leaf] == OPEN)
    of_leaf = of[leaf]
    tops = np.cumsum(top)
    counts = np.bincount(of_leaf, minlength=n)
    offsets = np.concatenate([[0], np.cumsum(counts)])
    tops_before = np.concatenate([[0], tops])[offsets[:-1]] if n else tops[:0]
    arg = tops - 1 - tops_before[of_leaf]
    opened = np.maximum.accumulate(np.where(top, np.arange(len(leaf)), 0)) if len(leaf) else np.zeros(0, np.int64)
    item = np.where(top, -1, np.arange(len(leaf)) - opened - 1)
    code = np.array([0, 2, 3, 1, 4], np.int8)[kinds[leaf]] if len(leaf) else np.zeros(0, np.int8)
    num = np.full(len(leaf), np.nan)
    quick = np.flatnonzero((code == 0) & (own[leaf] < 0))
    num[quick] = _numbers(buf, pos[leaf[quick]], end[leaf[quick]])
    raw: list[bytes | None] = [None] * len(leaf)
    for k in np.flatnonzero((code != 4) & ((code != 0) | (own[leaf] >= 0))).tolist():
        t = leaf[k]
        said = extra[own[t]][3] if own[t] >= 0 else data[pos[t] : end[t]]
        if code[k] == 0:
            num[k] = number(said)
        else:
            raw[k] = name_of(said) if code[k] == 2 else said
    found = Lexed(names, pos[first] if n else ops, end[ops] if n else ops, offsets, arg, item, code, num, raw, opaque)
    return _with_nested(found, data, np.flatnonzero(bad)) if bad.any() else found


def _with_nested(found: Lexed, data: bytes, which: np.ndarray) -> Lexed:
    """Fill in the operands of operations that `operations` must read."""
    parts, at = [], 0
    for k in which.tolist():
        parts.append((slice(int(found.offsets[at]), int(found.offsets[k])), []))
        (_, values, _, _), *_ = operations(data[found.starts[k] : found.ends[k]])
        parts.append((slice(0, 0), leaves(values)))
        at = k
    parts.append((slice(int(found.offsets[at]), int(found.offsets[-1])), []))
    counts = np.diff(found.offsets)
    for k, (_, new) in zip(which.tolist(), parts[1::2], strict=True):
        counts[k] = len(new)
    columns = []
    for c, column in enumerate((found.arg, found.item, found.kind, found.num)):
        columns.append(np.concatenate([np.concatenate([column[s], np.array([r[c] for r in new], column.dtype)]) for s, new in parts]))
    raw = [r for s, new in parts for r in (found.raw[s] + [x[4] for x in new])]
    return Lexed(found.names, found.starts, found.ends, np.concatenate([[0], np.cumsum(counts)]), *columns, raw, found.hidden)


def leaves(values: list) -> list[tuple[int, int, int, float, bytes | None]]:
    """(arg, item, kind, num, raw) of operands as `operations` gives them."""

    def one(arg: int, item: int, value: Any) -> tuple[int, int, int, float, bytes | None]:
        if value is None or isinstance(value, bool):
            return arg, item, 3, np.nan, {None: b"null", True: b"true", False: b"false"}[value]
        if isinstance(value, float):
            return arg, item, 0, value, None
        if isinstance(value, dict) and "s" in value:
            return arg, item, 1, np.nan, bytes.fromhex(value["s"])
        if isinstance(value, dict) and "n" in value:
            return arg, item, 2, np.nan, value["n"].encode("latin-1")
        return arg, item, 5, np.nan, json.dumps(value).encode()

    out = []
    for arg, value in enumerate(values):
        if isinstance(value, list):
            out.append((arg, -1, 4, np.nan, None))
            out += [one(arg, k, v) for k, v in enumerate(value)]
        else:
            out.append(one(arg, -1, value))
    return out


def values_of(operands: list[dict]) -> list:
    """Operands as rows hold them, as `operations` gives them."""
    out: list[Any] = []
    for o in operands:
        raw = o["raw"]
        value: Any = {
            "n": lambda: o["num"],
            "s": lambda: {"s": bytes(raw).hex()},
            "/": lambda: {"n": bytes(raw).decode("latin-1")},
            "b": lambda: {b"null": None, b"true": True, b"false": False}[bytes(raw)],
            "[": list,
            "j": lambda: json.loads(raw),
        }[o["kind"]]()
        (out if o["item"] is None else out[o["arg"]]).append(value)
    return out


def operand_array(lexed: list[Lexed]) -> pa.Array:
    """The operands of operations as one Arrow list for each operation."""
    arg, item, kind, num = (np.concatenate([getattr(p, c) for p in lexed]) for c in ("arg", "item", "kind", "num"))
    raws = [r for p in lexed for r in p.raw]
    counts = np.concatenate([np.diff(p.offsets) for p in lexed])
    offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
    raw = pa.array(raws, pa.binary()) if any(r is not None for r in raws) else pa.nulls(len(raws), pa.binary())
    kinds = pa.DictionaryArray.from_arrays(pa.array(kind.astype(np.int8)), pa.array(KINDS.tolist())).cast(pa.string())
    fields = [pa.array(arg.astype(np.int32)), pa.array(item.astype(np.int32), mask=item < 0), kinds, pa.array(num, mask=np.isnan(num)), raw]
    return pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays(fields, names=["arg", "item", "kind", "num", "raw"]))


_TOKEN = re.compile(
    rb"(?P<skip>[\x00\t\n\x0c\r ]+|%[^\r\n]*)|(?P<num>[+-]?[0-9.]+|[+-])|(?P<name>/[^\x00\t\n\x0c\r ()<>\[\]{}/%]*)"
    rb"|(?P<mark><<|>>|\[|\])|(?P<hex><[^>]*>?)|(?P<text>\()|(?P<word>[^\x00\t\n\x0c\r ()<>\[\]{}/%]+)|(?P<other>.)",
    re.S,
)


def operations(data: bytes):
    """(operator, operands, start, end) of a content stream; images given in line are one operation BI.

    Strings are {"s": hex}, names {"n": name}, dictionaries {"d": [[key, value] ...]}; a value that
    can't be read is skipped.
    """
    stack: list[tuple[str, list]] = []
    operands: list[Any] = []
    at, start = 0, None

    def put(value: Any) -> None:
        (stack[-1][1] if stack else operands).append(value)

    while at < len(data):
        m = _TOKEN.match(data, at)
        here, at = at, m.end()
        kind, raw = m.lastgroup, m[0]
        if kind == "skip":
            continue
        start = here if start is None else start
        if kind == "num":
            put(number(raw))
        elif kind == "name":
            put({"n": name_of(raw).decode("latin-1")})
        elif kind == "hex":
            put({"s": hexadecimal(raw).hex()})
        elif kind == "text":
            value, at, _ = literal(data, at)
            put({"s": value.hex()})
        elif raw in (b"[", b"<<"):
            stack.append((raw.decode(), []))
        elif raw in (b"]", b">>"):
            if stack and stack[-1][0] == {b"]": "[", b">>": "<<"}[raw]:
                opened, items = stack.pop()
                pairs = [[k["n"], v] for k, v in zip(items[::2], items[1::2], strict=False) if isinstance(k, dict) and "n" in k]
                put(items if opened == "[" else {"d": pairs})
        elif kind == "word":
            if raw in (b"true", b"false", b"null"):
                put({b"true": True, b"false": False, b"null": None}[raw])
                continue
            if raw == b"BI":
                end = IMAGE_END.search(data, at)
                at = end.end() if end else len(data)
            yield raw.decode("latin-1"), operands, start, at
            stack, operands, start = [], [], None


# cutting long streams


def piece_ends(data: bytes, size: int) -> list[int]:
    """Where pieces of about `size` bytes end: after white space, and at the end."""
    ends, at = [], size
    while at < len(data):
        found = [k for k in (data.find(b" ", at), data.find(b"\n", at)) if k >= 0]
        if not found:
            break
        ends.append(min(found) + 1)
        at = ends[-1] + size
    return [*(e for e in ends if e < len(data)), len(data)]


def transitions(piece: bytes) -> tuple[list[tuple[int, int, int]], int]:
    """((end state, operations, first operation's end or -1) for each begin state, the change of depth of deeper strings)."""
    whole = lex(piece)
    pending = int(whole.hidden.end_state == IMAGE)

    def from_plain(at: int) -> tuple[int, int, int]:
        """What happens if the state is plain from `at` on."""
        seen, spans = whole, whole.hidden.spans
        inside = any(a < at < b for a, b in spans) or (at and at < len(piece) and _CLASS[piece[at - 1]] == 1 and _CLASS[piece[at]] == 1)
        base, open_ = 0, pending
        if inside or (spans and at and piece[at - 1 : at + 1] == b"<<"):
            seen, base = lex(piece[at:]), at
            open_ = int(seen.hidden.end_state == IMAGE)
        ends = seen.ends[: len(seen.ends) - open_] + base
        later = ends[ends > at]
        return seen.hidden.end_state, len(later), int(later[0]) if len(later) else -1

    line = _LINE_END.search(piece)
    angle = piece.find(b">")
    image = IMAGE_END.search(b" " + piece)
    out = [
        from_plain(0),
        from_plain(line.start()) if line else (COMMENT, 0, -1),
        from_plain(angle + 1) if angle >= 0 else (HEX, 0, -1),
        (IMAGE, 0, -1),
    ]
    if image:
        state, n, _ = from_plain(image.end() - 1)
        out[3] = (state, n + 1, image.end() - 1)
    depth, least, at = 0, 0, 0
    for m in iter(lambda: _IN_TEXT.match(piece, at), None):
        at = m.end()
        depth += (m[0] == b"(") - (m[0] == b")")
        if depth < least:
            least = depth
            out.append(from_plain(at))
    return out, depth
