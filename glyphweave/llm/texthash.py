"""Words of UTF-8 texts and their 64-bit hashes, computed on whole Arrow batches with numpy.

ASCII separators are single bytes in UTF-8, so words can be cut on bytes.
A null text has no words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_U = np.uint64
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: Bytes of `[^\x20\x09-\x0D]+` words.
NOT_SPACE = np.ones(256, dtype=bool)
NOT_SPACE[[9, 10, 11, 12, 13, 32]] = False
#: Bytes of `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+` words, after lower-casing.
ALNUM = np.zeros(256, dtype=bool)
ALNUM[48:58] = ALNUM[97:123] = ALNUM[128:] = True

_rng = np.random.default_rng(20240607)
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) | _U(1)
_LANES = _rng.integers(1, 2**63, 64, dtype=np.uint64) | _U(1)
_STEP = 0x9E3779B97F4A7C15
SLICE = 1 << 16
_TABLE = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of unsigned 64-bit values."""
    with np.errstate(over="ignore"):
        x = x ^ (x >> _U(30))
        x = x * _U(0xBF58476D1CE4E5B9)
        x = x ^ (x >> _U(27))
        x = x * _U(0x94D049BB133111EB)
        return x ^ (x >> _U(31))


def chunks(texts: pa.Array, limit: int = 1 << 21, fold: bool = True) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) for runs of rows of about `limit` bytes; `fold` lower-cases A-Z."""
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    if not len(texts):
        return
    _, off, data = texts.buffers()
    offs = np.frombuffer(off, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    row = 0
    while row < len(texts):
        end = int(np.searchsorted(offs, offs[row] + limit, "right")) - 1
        end = min(max(end, row + 1), len(texts))
        part = raw[offs[row] : offs[end]]
        yield row, end, LOWER[part] if fold else part, offs[row : end + 1] - offs[row]
        row = end


def spans(buf: np.ndarray, offs: np.ndarray, wordlike: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and the words before each text (one entry more than texts)."""
    on = wordlike[buf]
    first, last = on.copy(), on.copy()
    first[1:] &= ~on[:-1]
    last[:-1] &= ~on[1:]
    inner = offs[:-1][offs[:-1] < len(buf)]
    first[inner] = on[inner]
    ends_at = offs[1:][offs[1:] > 0] - 1
    last[ends_at] = on[ends_at]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(starts, offs)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd step and of its inverse modulo 2**64."""
    if len(_TABLE[0]) < n:
        for k, base in enumerate((_STEP, pow(_STEP, -1, 1 << 64))):
            x = np.full(n, base, np.uint64)
            x[0] = 1
            with np.errstate(over="ignore"):
                _TABLE[k] = np.multiply.accumulate(x)
    return _TABLE[0], _TABLE[1]


def hash_words(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word: differences of a running polynomial sum, slice by slice."""
    out = np.empty(len(starts), np.uint64)
    at = 0
    while at < len(starts):
        to = max(at + 1, int(np.searchsorted(starts, starts[at] + SLICE)))
        lo, hi = int(starts[at]), int(ends[to - 1])
        up, down = _powers(max(hi - lo, SLICE))
        with np.errstate(over="ignore"):
            run = np.zeros(hi - lo + 1, np.uint64)
            np.cumsum(_BYTE[buf[lo:hi]] * up[: hi - lo], out=run[1:])
            begin, stop = starts[at:to] - lo, ends[at:to] - lo
            out[at:to] = mix((run[stop] - run[begin]) * down[begin] + (stop - begin).astype(np.uint64))
        at = to
    return out


def window_hashes(buf: np.ndarray, width: int) -> np.ndarray:
    """A 64-bit hash of each run of `width` bytes, by where it starts; none if there are fewer bytes."""
    if len(buf) < width:
        return np.zeros(0, np.uint64)
    up, down = _powers(len(buf))
    with np.errstate(over="ignore"):
        run = np.zeros(len(buf) + 1, np.uint64)
        np.cumsum(_BYTE[buf] * up[: len(buf)], out=run[1:])
        return mix((run[width:] - run[:-width]) * down[: len(buf) - width + 1])


def shingle_hashes(words: np.ndarray, width: int) -> np.ndarray:
    """Hashes of each run of `width` words of one text; of the whole text, if it is shorter."""
    if not len(words):
        return words
    width = min(width, len(words))
    total = np.zeros(len(words) - width + 1, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(width):
            total += words[k : len(words) - width + 1 + k] * _LANES[k % len(_LANES)]
        return mix(total + _U(width))
