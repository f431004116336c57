"""Benchmark decontamination by a prefix-filtered set join.

Each benchmark item gives windows of `window` consecutive words (a shorter item is
one window). A window's shingles are ordered by how rarely they occur in the
corpus. Exact containment needs every shingle, so the necessary prefix is the
rarest one: documents meet a window only through it, length and positional bounds
drop meetings that can't fit, and what is left is verified word by word.

The benchmark is the stated query set. It is taken in blocks of bounded size; each
block passes over all documents, whose rows only gain found spans, so no document
is shuffled and a larger benchmark means more passes, not more memory.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphweave.llm import texthash

#: Words in one benchmark block, which bounds what is broadcast at once.
BLOCK_WORDS = 400_000
_SPANS = "array<struct<item_id:string,first_word:long,end_word:long>>"
_SPAN_TYPE = pa.list_(pa.struct([("item_id", pa.string()), ("first_word", pa.int64()), ("end_word", pa.int64())]))


def cut_words(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(row, end row, bytes, starts, ends, hashes, words before each text) of chunks of texts."""
    for row, end, buf, offs in texthash.chunks(texts):
        starts, ends, before = texthash.spans(buf, offs, texthash.ALNUM)
        yield row, end, buf, starts, ends, texthash.hash_words(buf, starts, ends), before


def runs(words: np.ndarray, width: int) -> np.ndarray:
    """A hash of `width` words from each position; the last width-1 positions have none."""
    return texthash.shingle_hashes(words, width) if len(words) >= width else np.zeros(0, np.uint64)


@dataclass
class Block:
    """Different windows of some benchmark items: window k is words[at[k] : at[k] + size[k]] of the block, and stands in items[k]."""

    words: np.ndarray
    text: list[bytes]
    at: np.ndarray
    size: np.ndarray
    items: list[list[str]]
    width: int

    def key_width(self, size: int) -> int:
        return min(self.width, size)

    def shingles(self) -> dict[int, np.ndarray]:
        """By shingle width, the distinct shingle hashes of the windows that use it."""
        found: dict[int, np.ndarray] = {}
        for width in sorted({self.key_width(int(s)) for s in np.unique(self.size)}):
            mine = np.minimum(self.size, self.width) == width
            spots = np.unique(np.concatenate([a + np.arange(s - width + 1) for a, s in zip(self.at[mine], self.size[mine], strict=True)]))
            found[width] = np.unique(runs(self.words, width)[spots])
        return found


def blocks_of(benchmark: DataFrame, window: int, width: int) -> Iterator[Block]:
    """Read the benchmark item by item; at most BLOCK_WORDS words and one more item are held. Equal windows become one."""
    words: list[np.ndarray] = []
    text: list[bytes] = []
    windows: dict[tuple[bytes, ...], tuple[int, list[str]]] = {}

    def block() -> Block:
        at = np.array([a for a, _ in windows.values()], np.int64)
        size = np.array([len(w) for w in windows], np.int64)
        return Block(np.concatenate([np.zeros(0, np.uint64), *words]), text, at, size, [items for _, items in windows.values()], width)

    for r in benchmark.select(F.col("item_id").cast("string"), F.col("text").cast("string")).toLocalIterator():
        for _, _, buf, starts, ends, hashes, _ in cut_words(pa.array([r["text"]], pa.string())):
            if not len(hashes) or r["item_id"] is None:
                continue
            held, size = len(text), min(window, len(hashes))
            words.append(hashes)
            text += [bytes(buf[a:b]) for a, b in zip(starts, ends, strict=True)]
            for k in range(held, len(text) - size + 1):
                _, items = windows.setdefault(tuple(text[k : k + size]), (k, []))
                if not items or items[-1] != r["item_id"]:
                    items.append(r["item_id"])
        if len(text) >= BLOCK_WORDS:
            yield block()
            words, text, windows = [], [], {}
    if text:
        yield block()


def corpus_counts(docs: DataFrame, wanted: dict[int, np.ndarray]) -> dict[int, np.ndarray]:
    """In how many rows of `docs` each wanted shingle occurs. All rows are read; a task sends one row per shingle it met."""
    shared = docs.sparkSession.sparkContext.broadcast(wanted)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = {w: np.zeros(len(keys), np.int64) for w, keys in shared.value.items()}
        for batch in batches:
            for row, end, _, _, _, hashes, before in cut_words(batch.column(0)):
                for width, keys in shared.value.items():
                    found = runs(hashes, width)
                    spot = np.searchsorted(keys, found)
                    spot[spot == len(keys)] = 0
                    place = np.flatnonzero(keys[spot] == found)
                    doc = np.searchsorted(before, place, "right") - 1
                    place, doc = place[place + width <= before[doc + 1]], doc[place + width <= before[doc + 1]]
                    once = np.unique(spot[place] * np.int64(end - row) + doc)
                    np.add.at(sums[width], once // (end - row), 1)
        for width, n in sums.items():
            met = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(met), width), pa.int32()), pa.array(met), pa.array(n[met])], names=["width", "shingle", "n"]
            )

    counted = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(count, "width int, shingle long, n long")
    out = {w: np.zeros(len(keys), np.int64) for w, keys in wanted.items()}
    for r in counted.groupBy("width", "shingle").agg(F.sum("n").alias("n")).toLocalIterator():
        out[r["width"]][r["shingle"]] = r["n"]
    return out


def rarest(block: Block, wanted: dict[int, np.ndarray], counts: dict[int, np.ndarray]) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """The necessary prefix: by width, (sorted rarest shingles, their windows, where in the window the shingle stands)."""
    out = {}
    for width, keys in wanted.items():
        found = runs(block.words, width)
        mine = np.flatnonzero(np.minimum(block.size, block.width) == width)
        chosen, place = np.empty(len(mine), np.uint64), np.empty(len(mine), np.int64)
        for k, w in enumerate(mine):
            inside = found[block.at[w] : block.at[w] + block.size[w] - width + 1]
            often = counts[width][np.searchsorted(keys, inside)]
            place[k] = np.lexsort((inside, often))[0]  # rarest first, ties by hash
            chosen[k] = inside[place[k]]
        order = np.argsort(chosen, kind="stable")
        out[width] = chosen[order], mine[order], place[order]
    return out


def found_in(block: Block, prefix: dict, buf, starts, ends, hashes, before, rows: int) -> list[list[tuple[str, int, int]]]:
    """(item, first word, end word) of verified windows of each text of a chunk, merged.

    A position meets a window once, however many items hold it; runs of a window's
    meetings are merged before its items are named.
    """
    spans: list[dict[int, list[list[int]]]] = [{} for _ in range(rows)]
    for width, (keys, windows, place) in prefix.items():
        met = runs(hashes, width)
        lo, hi = np.searchsorted(keys, met), np.searchsorted(keys, met, "right")
        at = np.flatnonzero(hi > lo)
        many = hi[at] - lo[at]
        pos = np.repeat(at, many)
        entry = np.repeat(lo[at] - np.cumsum(many) + many, many) + np.arange(many.sum())
        doc = np.searchsorted(before, pos, "right") - 1
        window, first = windows[entry], pos - place[entry]
        size = block.size[window]
        fits = (first >= before[doc]) & (first + size <= before[doc + 1])
        window, first, size, doc = window[fits], first[fits], size[fits], doc[fits]
        for s in np.unique(size):
            same = np.flatnonzero(size == s)
            for k in range(s):  # one word of all remaining pairs at a time
                same = same[hashes[first[same] + k] == block.words[block.at[window[same]] + k]]
            for k in same[np.lexsort((first[same], window[same]))].tolist():
                a, b = int(first[k]), int(block.at[window[k]])
                if all(bytes(buf[starts[a + x] : ends[a + x]]) == block.text[b + x] for x in range(s)):
                    held = spans[int(doc[k])].setdefault(int(window[k]), [])
                    a -= int(before[doc[k]])
                    if held and a <= held[-1][1]:
                        held[-1][1] = a + int(s)
                    else:
                        held.append([a, a + int(s)])
    return [merged([(item, a, b) for w, held in found.items() for item in block.items[w] for a, b in held]) for found in spans]


def merged(spans: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """Overlapping or touching spans of one item as one."""
    out: list[tuple[str, int, int]] = []
    for item, a, b in sorted(set(spans)):
        if out and out[-1][0] == item and a <= out[-1][2]:
            out[-1] = (item, out[-1][1], max(b, out[-1][2]))
        else:
            out.append((item, a, b))
    return out


def _pass(docs: DataFrame, block: Block, prefix: dict, carried: str) -> DataFrame:
    """One block over all documents: `spans` gains what it finds, n_words is set."""
    shared = docs.sparkSession.sparkContext.broadcast((block, prefix))

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blk, pre = shared.value
        for batch in batches:
            names = batch.schema.names
            texts, had = batch.column("text"), batch.column("spans").to_pylist()
            spans: list[list] = []
            counts: list[int] = []
            for row, end, buf, starts, ends, hashes, before in cut_words(texts):
                found = found_in(blk, pre, buf, starts, ends, hashes, before, end - row)
                for old, new in zip(had[row:end], found, strict=True):
                    spans.append((old or []) + [{"item_id": i, "first_word": a, "end_word": b} for i, a, b in new])
                counts += np.diff(before).tolist()
            columns = {"spans": pa.array(spans, _SPAN_TYPE), "n_words": pa.array(counts, pa.int64())}
            yield pa.RecordBatch.from_arrays([columns.get(n, batch.column(n)) for n in names], names=names)

    return docs.mapInArrow(match, carried)


def overlaps(docs: DataFrame, benchmark: DataFrame, window: int = 13, width: int = 3) -> DataFrame:
    """Add n_words and spans (item_id, first_word, end_word: words covered by windows of the item) to `docs`.

    Every row of `docs` (text, any other columns but n_words and spans, which are
    replaced) comes back once. Words are runs of ASCII letters, digits and non-ASCII
    characters, lower-cased in A-Z. A null or wordless text has no spans, nor has
    anything an item without words or without id. Repeated items count by item_id.
    """
    rest = [c for c in docs.columns if c.lower() not in ("n_words", "spans", "text")]
    rows = docs.select(
        *rest,
        F.col("text").cast("string").alias("text"),
        F.lit(0).cast("long").alias("n_words"),
        F.array().cast(_SPANS).alias("spans"),
    )
    shape = rows.schema
    out, passes = rows, 0
    for block in blocks_of(benchmark, window, width):
        wanted = block.shingles()
        counts = corpus_counts(docs, wanted)
        out = _pass(out, block, rarest(block, wanted, counts), shape)
        passes += 1
    if not passes:
        empty = Block(np.zeros(0, np.uint64), [], np.zeros(0, np.int64), np.zeros(0, np.int64), [], width)
        out = _pass(out, empty, {}, shape)
    return out


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = 13, share: tuple[int, int] = (1, 20)) -> DataFrame:
    """overlaps() plus n_hit (words under any span), items (distinct ids, sorted), contaminated.

    A text is contaminated if some word is hit and at least `share` of its words are.
    """
    found = overlaps(docs, benchmark, window)
    return with_hits(found, share)


def with_hits(found: DataFrame, share: tuple[int, int] = (1, 20)) -> DataFrame:
    """n_hit by sweeping the spans in order: a span adds what lies beyond the furthest end so far."""
    ordered = F.array_sort(F.transform("spans", lambda s: F.struct(s["first_word"], s["end_word"])))
    start = F.struct(F.lit(0).cast("long").alias("hit"), F.lit(0).cast("long").alias("reach"))

    def sweep(acc, s):
        fresh = F.greatest(s["end_word"] - F.greatest(acc["reach"], s["first_word"]), F.lit(0).cast("long"))
        return F.struct((acc["hit"] + fresh).alias("hit"), F.greatest(acc["reach"], s["end_word"]).alias("reach"))

    n_hit = F.aggregate(ordered, start, sweep, lambda acc: acc["hit"])
    over, under = share
    return (
        found.withColumn("n_hit", F.when(F.size("spans") == 0, F.lit(0).cast("long")).otherwise(n_hit))
        .withColumn("items", F.array_sort(F.array_distinct(F.col("spans.item_id"))))
        .withColumn("contaminated", (F.col("n_hit") > 0) & (F.col("n_hit") * under >= F.col("n_words") * over))
    )
