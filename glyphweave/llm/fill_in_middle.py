"""Fill-in-middle: documents cut in three by units and written in another order.

Units are runs of ASCII letters and single other code points. One Aho-Corasick
automaton over pairs of ASCII characters of different class, and the sentinels,
finds where a text changes class and whether it holds a sentinel. Between two such
events a text is of one class, so a gap of letters is one unit and a gap of others
as many units as code points: sums over gaps say where any unit begins, and nothing
is kept for each unit.
"""

from __future__ import annotations

import string
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache
from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
_TO_OTHER, _TO_LETTER, _SENTINEL = range(3)
#: The columns that a transformation adds.
OWN = {"n": T.LongType(), "form": T.StringType(), "prefix_chars": T.LongType(), "middle_chars": T.LongType(), "output": T.StringType()}


@dataclass(frozen=True)
class FillSpec:
    """Of a hundred documents `plain` stay as they are, and of a hundred others `suffix_first` put the suffix first."""

    salt: str = "1:"
    plain: int = 10
    suffix_first: int = 20


@cache
def automaton() -> ahocorasick.Automaton:
    """Finds every change between ASCII letters and other ASCII characters, and every sentinel."""
    found = ahocorasick.Automaton(ahocorasick.STORE_INTS)
    others = [c for c in map(chr, range(128)) if c not in string.ascii_letters]
    for letter in string.ascii_letters:
        for other in others:
            found.add_word(letter + other, _TO_OTHER)
            found.add_word(other + letter, _TO_LETTER)
    for sentinel in (PREFIX, SUFFIX, MIDDLE):
        found.add_word(sentinel, _SENTINEL)
    found.make_automaton()
    return found


class Units:
    """Where the units of a text begin, from its class changes alone."""

    def __init__(self, text: str):
        # one ASCII character for each code point: the automaton's places are the text's
        folded = text.encode("ascii", "replace").decode("ascii")
        events = np.fromiter(chain.from_iterable(automaton().iter(folded)), np.int64).reshape(-1, 2)
        self.marked = bool((events[:, 1] == _SENTINEL).any())
        changes = events[events[:, 1] != _SENTINEL, 0]
        self.starts = np.concatenate([np.zeros(min(len(folded), 1), np.int64), changes])
        self.lengths = np.diff(np.append(self.starts, len(folded)))
        first = int(folded[:1] in string.ascii_letters)
        self.letters = (np.arange(len(self.starts)) + first) % 2 == 1
        units = np.where(self.letters, 1, self.lengths)
        self.before = np.cumsum(units) - units
        self.n = int(units.sum())

    def place(self, unit: int) -> int:
        """The code point before which `unit` units (0 to n) lie."""
        if not len(self.starts):
            return 0
        gap = int(np.searchsorted(self.before, unit, "right")) - 1
        within = unit - int(self.before[gap])
        return int(self.starts[gap]) + within * (int(self.lengths[gap]) if self.letters[gap] else 1)


def rearranged(text: str, draws: list[int], spec: FillSpec) -> tuple[int, str, int | None, int | None, str]:
    """(units, form, code points of prefix and middle, output) of one text by its four draws."""
    units = Units(text)
    if not text or units.marked or draws[2] % 100 >= 100 - spec.plain:
        return units.n, "plain", None, None, text
    first, second = sorted(d % (units.n + 1) for d in draws[:2])
    a, b = units.place(first), units.place(second)
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    if draws[3] % 100 < spec.suffix_first:
        return units.n, "spm", a, b - a, f"{SUFFIX}{suffix}{PREFIX}{prefix}{MIDDLE}{middle}"
    return units.n, "psm", a, b - a, f"{PREFIX}{prefix}{SUFFIX}{suffix}{MIDDLE}{middle}"


def draws_of(doc_id: Column, salt: str) -> Column:
    """Four numbers below 2**32 from a hash of the salt and the decimal id."""
    digest = F.sha2(F.concat(F.lit(salt), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return F.array(*(F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long") for k in range(4)))


def transform(docs: DataFrame, spec: FillSpec = FillSpec()) -> DataFrame:
    """`docs` (doc_id, text, more) with n, form, prefix_chars, middle_chars and output.

    No shuffle; rows don't depend on each other. A null text counts as the empty one,
    which is plain; a null doc_id draws as an empty one; repeated ids draw alike. A
    column of `docs` with one of the five new names is replaced.
    """
    kept = [c for c in docs.columns if c not in OWN]
    schema = T.StructType([docs.schema[c] for c in kept] + [T.StructField(k, t) for k, t in OWN.items()])
    names = schema.names

    def written_anew(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.large_string())
        for batch in batches:
            texts, draws = batch.column(0), batch.column(1)
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                found = [rearranged(t.as_py(), d.as_py(), spec) for t, d in zip(texts.slice(at, 256), draws.slice(at, 256), strict=True)]
                new = [pa.array(c, k) for c, k in zip(zip(*found, strict=True), kinds, strict=True)]
                new[-1] = new[-1].cast(pa.string())
                yield pa.RecordBatch.from_arrays([*part.columns[2:], *new], names=names)

    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(text, draws_of(F.col("doc_id"), spec.salt), *(F.col(f"`{c}`") for c in kept)).mapInArrow(written_anew, schema)


def restored(output: Column, form: Column) -> Column:
    """The text that an output of a form was made from."""
    parts = F.split(output, "<[PSM]>", -1)
    psm, spm = (F.concat(*(parts[k] for k in order)) for order in ((1, 3, 2), (2, 3, 1)))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)
