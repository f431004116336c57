"""Packing in space-filling-curve order.

Each document becomes a hashed vector of its token ids, projected to a few
dimensions and placed on a Hilbert curve. Documents are range-sorted by that key
and laid end to end, so a sequence holds neighbours along the curve; texts are
cut only where a sequence is full, and only the last sequence is padded.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphweave.llm.encoding import encoder, vocabulary
from glyphweave.llm.workspace import discard, with_running_totals, written


@dataclass(frozen=True)
class PackingSpec:
    length: int = 2048
    end_id: int = 1
    buckets: int = 256
    dimensions: int = 4
    bits: int = 10
    vocabulary: str = ""

    def vocabulary_path(self) -> str:
        return self.vocabulary or vocabulary()


def hilbert_key(cells: np.ndarray, bits: int) -> np.ndarray:
    """Position of each integer point (rows of `cells`, values under 2**bits) on the Hilbert curve.

    Works on all points at once: undo the excess rotations bit by bit, Gray-encode
    across the axes, then interleave the bits, most significant first.
    """
    axes = [cells[:, k].astype(np.int64) for k in range(cells.shape[1])]
    level = 1 << (bits - 1)
    while level > 1:
        low = level - 1
        for k in range(len(axes)):
            high = (axes[k] & level) != 0
            swap = np.where(high, 0, (axes[0] ^ axes[k]) & low)
            axes[0] = np.where(high, axes[0] ^ low, axes[0] ^ swap)
            if k:
                axes[k] = axes[k] ^ swap
        level >>= 1
    for k in range(1, len(axes)):
        axes[k] = axes[k] ^ axes[k - 1]
    flip = np.zeros_like(axes[0])
    level = 1 << (bits - 1)
    while level > 1:
        flip = np.where((axes[-1] & level) != 0, flip ^ (level - 1), flip)
        level >>= 1
    key = np.zeros_like(axes[0])
    for bit in range(bits - 1, -1, -1):
        for axis in axes:
            key = (key << 1) | (((axis ^ flip) >> bit) & 1)
    return key


def curve_keys(ids: np.ndarray, ends: np.ndarray, spec: PackingSpec) -> np.ndarray:
    """Hilbert keys of documents whose token ids lie end to end, from `ends[k]` to `ends[k + 1]`.

    A document without ids sits at the middle of the cube.
    """
    rows = len(ends) - 1
    hashed = (ids.astype(np.int64) * 2654435761 >> 7) % spec.buckets
    where = np.repeat(np.arange(rows) * spec.buckets, np.diff(ends)) + hashed
    counts = np.bincount(where, minlength=rows * spec.buckets).reshape(rows, spec.buckets)
    vectors = np.sqrt(counts)
    vectors /= np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-12)
    rng = np.random.default_rng(7)
    directions = rng.standard_normal((spec.buckets, spec.dimensions))
    directions -= directions.mean(axis=0)  # the common direction of all counts says nothing
    spread = vectors @ directions
    cells = np.floor((np.tanh(spread) + 1) / 2 * (1 << spec.bits)).astype(np.int64)
    return hilbert_key(np.clip(cells, 0, (1 << spec.bits) - 1), spec.bits)


#: Rows that are encoded at once.
ROWS = 1000


def tokenised(docs: DataFrame, spec: PackingSpec) -> DataFrame:
    """(row_no, doc_id, curve_key, doc_tokens, ids): a row for each row of `docs`, written."""
    path, end = spec.vocabulary_path(), spec.end_id
    schema = pa.schema(
        [("row_no", pa.int64()), ("doc_id", pa.int64()), ("curve_key", pa.int64()), ("doc_tokens", pa.int64()), ("ids", pa.large_binary())]
    )

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        kind = np.dtype("<u2" if max(enc.size, end + 1) <= 1 << 16 else "<u4")
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                ids, ends = enc.encode(part.column("text"))
                closed = ends + np.arange(len(ends))
                packed = np.full(closed[-1], end, kind)
                packed[np.arange(len(ids)) + np.repeat(np.arange(part.num_rows), np.diff(ends))] = ids
                binary = pa.Array.from_buffers(pa.large_binary(), part.num_rows, [None, pa.py_buffer(closed * kind.itemsize), pa.py_buffer(packed)])
                yield pa.RecordBatch.from_arrays(
                    [part.column("row_no"), part.column("doc_id"), pa.array(curve_keys(ids, ends, spec)), pa.array(np.diff(closed)), binary],
                    schema=schema,
                )

    rows = docs.select(
        F.monotonically_increasing_id().alias("row_no"),
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col("text").cast("string").alias("text"),
    )
    made = rows.mapInArrow(encode, "row_no long, doc_id long, curve_key long, doc_tokens long, ids binary")
    return written(made, "packing-ids", "zstd")


PIECE = ["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids_crc32"]


def pack(docs: DataFrame, spec: PackingSpec | None = None) -> DataFrame:
    """Pack every row of `docs` (doc_id, text) into sequences of at most `spec.length` tokens.

    Returns a row for each piece: doc_id, start, length, doc_tokens, sequence_id,
    offset, ids_crc32 (CRC-32 of the piece's tokens as little-endian unsigned 32-bit
    numbers), ids (the tokens). Rows are laid out in the order of the curve, so the
    pieces of a sequence are neighbours in the result's partitions, too. Each document
    ends with `end_id`; a null or empty text is that token alone; repeated rows are
    packed each; a null doc_id is kept. Ties on the curve go by row. An empty table
    gives no pieces. Only doc_id and text are read, so other columns can't clash.
    """
    spec = spec or PackingSpec()
    ids = tokenised(docs, spec)
    placed = with_running_totals(ids, ["curve_key", "row_no"], {"laid_at": "doc_tokens"}, "packing-order", "zstd")
    discard(ids)
    size = spec.length
    schema = pa.schema([*((n, pa.int64()) for n in PIECE), ("ids", pa.list_(pa.int32()))])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS):
                batch = whole.slice(at, ROWS)
                doc, total = batch.column("doc_id"), batch.column("doc_tokens").to_numpy()
                laid, packed = batch.column("laid_at").to_numpy(), batch.column("ids").cast(pa.large_binary())
                offs = np.frombuffer(packed.buffers()[1], np.int64)[packed.offset :]
                kind = "<u2" if int(offs[len(total)] - offs[0]) == 2 * total.sum() else "<u4"
                ids = np.frombuffer(packed.buffers()[2], np.uint8)[offs[0] : offs[len(total)]].view(kind).astype("<u4")
                first, last = laid // size, (laid + total - 1) // size
                pieces = last - first + 1
                row = np.repeat(np.arange(len(total)), pieces)
                seq = first[row] + np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
                begin = np.maximum(seq * size, laid[row])
                length = np.minimum((seq + 1) * size, (laid + total)[row]) - begin
                ends = np.concatenate([[0], np.cumsum(length)])
                raw = memoryview(ids).cast("B")
                sums = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
                numbers = [begin - laid[row], length, total[row], seq, begin - seq * size, np.array(sums, np.int64)]
                lists = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(ids.view(np.int32)))
                yield pa.RecordBatch.from_arrays([doc.take(pa.array(row)), *map(pa.array, numbers), lists], schema=schema)

    return placed.select("doc_id", "doc_tokens", "ids", "laid_at").mapInArrow(cut, ", ".join(f"{n} long" for n in PIECE) + ", ids array<int>")


def sequences(pieces: DataFrame, spec: PackingSpec | None = None, pad_id: int = 0) -> DataFrame:
    """The packed sequences themselves: sequence_id, tokens (padded to full length), doc_ids in order."""
    spec = spec or PackingSpec()
    ordered = F.array_sort(F.collect_list(F.struct("offset", "ids", "doc_id")))
    whole = pieces.groupBy("sequence_id").agg(ordered.alias("parts"))
    tokens = F.flatten(F.col("parts.ids"))
    padding = F.array_repeat(F.lit(pad_id), spec.length - F.size(tokens))
    return whole.select("sequence_id", F.concat(tokens, padding).alias("tokens"), F.col("parts.doc_id").alias("doc_ids"))


def piece_digest(pieces: DataFrame) -> DataFrame:
    """Pieces by their numbers and checksum, without the tokens themselves."""
    return pieces.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
