"""Removal of long repeated byte strings, by induced sorting of suffixes.

No suffix is sorted that can't matter. Of the byte runs of `anchor` bytes inside each
window of `length` bytes the smallest by hash is the window's anchor: equal windows have
equal anchors at equal places, so windows that repeat meet under one anchor. Windows in a
row with one anchor form a tuple: the anchor's hash, the bytes from the first window's
begin to the last one's end, and where in them the anchor lies. Tuples whose anchor
occurs only once are dropped before any text is moved.

What is left is sorted by anchor and by the suffix that begins there. This is Spark's
sort, which spills sorted runs and merges them from disk, so a shard may be far larger
than memory. From neighbours come the common prefixes of anchored suffixes, and from these
all other suffixes are induced: those one byte further left are put in order by (class of
the bytes between, rank), and share the least common prefix of the ranks between; a class
of one suffix is never taken further. A window repeats if a suffix beside its own shares
`length` bytes with it. Anchors with too many tuples for a task are split before, by the
bytes that half of their windows have in common, as often as needed.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glyphweave.llm import texthash
from glyphweave.llm.workspace import discard, matched, written

_U = np.uint64
#: Window starts that are looked at in one go.
STEP = 1 << 20


@dataclass(frozen=True)
class RepeatSpec:
    """Strings of `length` bytes; anchors of `anchor` bytes; at most `shard` tuples of one anchor in a task."""

    length: int = 400
    anchor: int = 128
    shard: int = 50_000

    @property
    def reach(self) -> int:
        """Anchor places of a window, and so the most windows of a tuple."""
        return self.length - self.anchor + 1


def sliding_least(keys: np.ndarray, width: int) -> np.ndarray:
    """The least of each `width` keys in a row, from least ones of blocks."""
    n = len(keys) - width + 1
    whole = np.full(-(-len(keys) // width) * width, np.iinfo(_U).max, _U)
    whole[: len(keys)] = keys
    blocks = whole.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, 1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], 1)[:, ::-1].ravel()
    return np.minimum(back[:n], ahead[width - 1 : width - 1 + n])


def tuples(buf: np.ndarray, spec: RepeatSpec) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(hash, place of the anchor, first window, windows) of the tuples of a byte string, piece by piece.

    Anchors are chosen by half a hash and then by place, the first of equal ones.
    """
    for at in range(0, len(buf) - spec.length + 1, STEP):
        hashes = texthash.window_hashes(buf[at : at + STEP + spec.length - 1], spec.anchor)
        keys = (hashes >> _U(32) << _U(32)) | np.arange(len(hashes), dtype=_U)
        spot = (sliding_least(keys, spec.reach) & _U(0xFFFFFFFF)).astype(np.int64)
        first = np.flatnonzero(np.append(True, spot[1:] != spot[:-1]))
        yield hashes[spot[first]], spot[first] + at, first + at, np.diff(np.append(first, len(spot)))


def digest_of(text: Column) -> Column:
    """Half of a text's sha256, in 16 bytes."""
    return F.substring(F.unhex(F.sha2(text, 256)), 1, 16)


def _bytes(docs: DataFrame) -> Column:
    return F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")


def anchors(texts: DataFrame, spec: RepeatSpec) -> DataFrame:
    """(digest, h, many): the anchors of each of `texts` (digest, body), and whether it has several tuples with it."""

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            digests, bodies = batch.column(0), batch.column(1)
            own, of, size = [], [], 0
            for k in range(batch.num_rows):
                buf = np.frombuffer(memoryview(bodies[k].as_buffer()), np.uint8)
                parts = list(tuples(buf, spec))
                if parts:
                    own.append(np.concatenate([p[0] for p in parts]))
                    of.append(np.full(len(own[-1]), k))
                    size += len(own[-1])
                if own and (size > 100_000 or k == batch.num_rows - 1):
                    yield told(digests, np.concatenate(own), np.concatenate(of))
                    own, of, size = [], [], 0
            if own:
                yield told(digests, np.concatenate(own), np.concatenate(of))

    def told(digests: pa.Array, hashes: np.ndarray, of: np.ndarray) -> pa.RecordBatch:
        order = np.lexsort((hashes, of))
        hashes, of = hashes[order], of[order]
        first = np.flatnonzero(np.append(True, (hashes[1:] != hashes[:-1]) | (of[1:] != of[:-1])))
        many = np.diff(np.append(first, len(of))) > 1
        return pa.RecordBatch.from_arrays([digests.take(pa.array(of[first])), pa.array(hashes[first].view(np.int64)), pa.array(many)], names=["digest", "h", "many"])

    return texts.mapInArrow(found, "digest binary, h long, many boolean")


def contents(texts: DataFrame, spec: RepeatSpec) -> DataFrame:
    """(digest, h, cid, p, n, content, starts): tuples of `texts` (digest, body, hs) with one of the anchors hs.

    cid is half a sha256 of the content, p the anchor's place in it, n its windows, starts where it begins in the text.
    """

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                body = batch.column(1)[k].as_buffer()
                wanted = batch.column(2)[k].values.to_numpy().view(_U)
                met: dict[bytes, tuple] = {}
                for hashes, places, firsts, sizes in tuples(np.frombuffer(memoryview(body), np.uint8), spec):
                    keep = np.flatnonzero(np.isin(hashes, wanted))
                    for h, place, a, n in zip(*(c[keep].tolist() for c in (hashes.view(np.int64), places, firsts, sizes)), strict=True):
                        content = body[a : a + n + spec.length - 1].to_pybytes()
                        met.setdefault(content, (h, place - a, n, []))[3].append(a)
                rows = list(met.items())
                for at in range(0, len(rows), 2000):
                    part = rows[at : at + 2000]
                    columns = [
                        pa.array([batch.column(0)[k].as_py()] * len(part), pa.binary()),
                        pa.array([r[0] for _, r in part], pa.int64()),
                        pa.array([hashlib.sha256(c).digest()[:16] for c, _ in part], pa.binary()),
                        pa.array([r[1] for _, r in part], pa.int32()),
                        pa.array([r[2] for _, r in part], pa.int32()),
                        pa.array([c for c, _ in part], pa.binary()),
                        pa.array([r[3] for _, r in part], pa.list_(pa.int64())),
                    ]
                    yield pa.RecordBatch.from_arrays(columns, names=["digest", "h", "cid", "p", "n", "content", "starts"])

    return texts.mapInArrow(found, "digest binary, h long, cid binary, p int, n int, content binary, starts array<long>")


def induced(keys: np.ndarray, bodies: list[bytes], p: np.ndarray, n: np.ndarray, again: np.ndarray, spec: RepeatSpec) -> list[np.ndarray]:
    """For each tuple which of its windows occur again, in it or another one of the same key.

    Tuples are sorted by key, then by the suffix at p; `again` says that a tuple itself occurs again.
    """
    m, length = len(keys), spec.length
    first = np.cumsum(n) - n
    marks = np.repeat(again, n)
    sizes = np.array([len(b) for b in bodies])
    flat = np.frombuffer(b"".join(bodies) + bytes(length), np.uint8)
    begin = np.cumsum(sizes) - sizes
    held = np.minimum(sizes - p, length)
    common = np.zeros(m, np.int64)  # of the suffix before in order; none across keys
    for at in range(1, m, 4096):
        rows = np.arange(at, min(at + 4096, m))
        here, before = (flat[(begin[r] + p[r])[:, None] + np.arange(length)] for r in (rows, rows - 1))
        unlike = here != before
        same = np.where(unlike.any(1), unlike.argmax(1), length)
        common[rows] = np.where(keys[rows] == keys[rows - 1], np.minimum(same, np.minimum(held[rows], held[rows - 1])), -1)
    live, cls = np.arange(m), np.unique(keys, return_inverse=True)[1]
    for left in range(int(p.max(initial=0)) + 1):
        on = live[(p[live] >= left) & (p[live] - n[live] < left)]
        if len(on):
            rank_class = np.cumsum(common < length - left)
            classes = np.zeros(m, np.int64)
            classes[live] = cls
            _, spot, count = np.unique(classes[on] * (m + 1) + rank_class[on], return_inverse=True, return_counts=True)
            seen = on[count[spot] > 1]
            marks[first[seen] + p[seen] - left] = True
        further = p[live] > left
        live, cls = live[further], cls[further]
        if not len(live):
            break
        _, cls, count = np.unique(cls * 256 + flat[begin[live] + p[live] - left - 1], return_inverse=True, return_counts=True)
        kept = count[cls] > 1
        live, cls = live[kept], cls[kept]
    return np.split(marks, first[1:])


def shards(parts: DataFrame, spec: RepeatSpec) -> DataFrame:
    """`parts` (cid, key, p, n, content, base, again) with keys of at most `shard` rows, or of equal single windows.

    A key's windows lie `lo` to `hi` bytes left of the anchor. Those at least `mid` bytes left of
    it share the `mid` bytes before it, the others more of what comes after: each half goes on
    under a key of the bytes that it shares. No window is lost or met twice.
    """
    done = None
    parts = parts.withColumn("lo", F.lit(0)).withColumn("hi", F.lit(spec.reach - 1))
    while True:
        sizes = parts.groupBy("key").agg(F.count("*").alias("rows"), F.max(F.col("hi") - F.col("lo")).alias("width"))
        large = written(sizes.where((F.col("rows") > spec.shard) & (F.col("width") > 0)).select("key"), "repeats-large")
        if not large.limit(1).count():
            return parts if done is None else done.unionByName(parts)
        large = F.broadcast(large)  # fewer than rows / shard
        small = parts.join(large, "key", "left_anti")
        done = small if done is None else done.unionByName(small)
        mid = F.expr("(lo + hi + 1) div 2")
        halves = parts.join(large, "key", "left_semi").withColumn("mid", mid)
        near = F.greatest(F.col("p") - F.col("mid") + 1, F.lit(0))  # the first window less than mid bytes left
        far = F.struct(F.lit(1).alias("side"), F.lit(0).alias("a"), F.least("n", near).alias("b"), F.col("mid").alias("lo"), F.col("hi").alias("hi"))
        by = F.struct(F.lit(0).alias("side"), near.alias("a"), F.col("n").alias("b"), F.col("lo").alias("lo"), (F.col("mid") - 1).alias("hi"))
        cut = halves.select("*", F.explode(F.array(far, by)).alias("half")).where("half.a < half.b")
        core = F.expr(f"substring(content, p - half.lo + 1, {spec.length} - half.hi + half.lo)")
        parts = written(
            cut.select(
                "cid",
                F.xxhash64("key", "half.side", core).alias("key"),
                (F.col("p") - F.col("half.a")).alias("p"),
                (F.col("half.b") - F.col("half.a")).alias("n"),
                F.expr(f"substring(content, half.a + 1, half.b - half.a + {spec.length - 1})").alias("content"),
                (F.col("base") + F.col("half.a")).alias("base"),
                "again",
                F.col("half.lo").alias("lo"),
                F.col("half.hi").alias("hi"),
            ),
            "repeats-halves",
        )


def repeated_windows(tuples_: DataFrame, spec: RepeatSpec) -> DataFrame:
    """(cid, begins, ends): runs of windows [begin, end) that occur again, of tuples (cid, h, p, n, content, again).

    A hash met by chance under one key does no harm: bytes are compared.
    """
    parts = written(tuples_.select("cid", F.col("h").alias("key"), "p", "n", "content", F.lit(0).alias("base"), "again"), "repeats-tuples")
    parts = shards(parts, spec)
    single = F.col("lo") == F.col("hi")
    alike = parts.where(single).groupBy(F.sha2("content", 256).alias("said")).agg(F.count("*").alias("rows"), F.max("again").alias("again"))
    ones = matched(
        parts.where(single).select("cid", "base", F.sha2("content", 256).alias("said")), written(alike.where("rows > 1 or again").select("said"), "repeats-alike"), ["said"]
    ).select("cid", F.array("base").alias("begins"), F.array(F.col("base") + 1).alias("ends"))

    def sort_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            if sum(b.num_rows for b in held) >= 16_384:
                table = pa.Table.from_batches(held)
                keys = table.column("key").to_numpy()
                end = int(np.searchsorted(keys, keys[-1]))
                if end:
                    yield settled(table.slice(0, end))
                held = table.slice(end).combine_chunks().to_batches()
        if sum(b.num_rows for b in held):
            yield settled(pa.Table.from_batches(held))

    def settled(table: pa.Table) -> pa.RecordBatch:
        keys, p, n, base = (table.column(c).to_numpy().astype(np.int64) for c in ("key", "p", "n", "base"))
        again = np.array(table.column("again").to_pylist(), bool)
        marks = induced(keys, table.column("content").to_pylist(), p, n, again, spec)
        cids, begins, ends = [], [], []
        for cid, start, mark in zip(table.column("cid").to_pylist(), base.tolist(), marks, strict=True):
            if mark.any():
                edge = np.diff(np.concatenate([[0], mark.astype(np.int8), [0]]))
                cids.append(cid)
                begins.append(np.flatnonzero(edge == 1) + start)
                ends.append(np.flatnonzero(edge == -1) + start)
        kind = pa.list_(pa.int32())
        return pa.RecordBatch.from_arrays([pa.array(cids, pa.binary()), pa.array(begins, kind), pa.array(ends, kind)], names=["cid", "begins", "ends"])

    suffix = F.expr("substring(content, p + 1)")
    placed = parts.where(~single).select("*", suffix.alias("suffix")).repartition("key").sortWithinPartitions("key", "suffix")
    runs = placed.select("cid", "key", "p", "n", "content", "base", "again").mapInArrow(sort_out, "cid binary, begins array<int>, ends array<int>")
    return runs.unionByName(ones)


def repeated_spans(docs: DataFrame, spec: RepeatSpec = RepeatSpec()) -> DataFrame:
    """(digest, spans): for each different text of `docs` with repeated strings its runs of repeated bytes, in order.

    spans is array<struct<lo, hi>>, from lo up to but without hi. A text of several rows
    that is long enough is one run.
    """
    bodies = docs.select(_bytes(docs).alias("body"))
    keyed = bodies.select(digest_of(F.col("body")).alias("digest"), "body").where(F.octet_length("body") >= spec.length)
    copies = keyed.groupBy("digest").agg(F.count("*").alias("rows"), F.max(F.octet_length("body")).cast("long").alias("hi")).where("rows > 1")
    copied = written(copies, "repeats-copies")
    found = written(anchors(keyed, spec).groupBy("digest", "h").agg(F.max("many").alias("many")), "repeats-anchors")
    ids = F.xxhash64("digest")
    shared = found.groupBy("h").agg(F.max("many").alias("many"), F.min(ids).alias("first"), F.max(ids).alias("last")).where("many or first <> last")
    shared = written(shared.select("h"), "repeats-shared")
    wanted = written(matched(found.select("digest", "h"), shared, ["h"]).groupBy("digest").agg(F.collect_list("h").alias("hs")), "repeats-wanted")
    # one row of each text: copies are folded by the tasks that read them
    once = matched(keyed, wanted, ["digest"]).groupBy("digest").agg(F.first("body").alias("body"), F.first("hs").alias("hs"))
    members = written(contents(once, spec), "repeats-members")
    discard(found, shared, wanted)
    different = members.groupBy("cid").agg(
        F.first("h").alias("h"), F.first("p").alias("p"), F.first("n").alias("n"), F.first("content").alias("content"), (F.sum(F.size("starts")) > 1).alias("again")
    )
    runs = repeated_windows(different, spec).groupBy("cid").agg(F.flatten(F.collect_list("begins")).alias("begins"), F.flatten(F.collect_list("ends")).alias("ends"))
    runs = written(runs, "repeats-runs")
    met = matched(members.select("digest", "cid", "starts"), runs, ["cid"])
    windows = met.select("digest", F.explode("starts").alias("start"), F.arrays_zip("begins", "ends").alias("pairs")).select("digest", "start", F.explode("pairs").alias("pair"))
    bytes_ = windows.select("digest", (F.col("start") + F.col("pair.begins")).alias("lo"), (F.col("start") + F.col("pair.ends") + (spec.length - 1)).alias("hi"))
    everywhere = copied.select("digest", F.lit(0).cast("long").alias("lo"), "hi")
    ranges = bytes_.join(copied, "digest", "left_anti").unionByName(everywhere)
    before = Window.partitionBy("digest").orderBy("lo", "hi").rowsBetween(Window.unboundedPreceding, -1)
    fresh = F.coalesce(F.col("lo") > F.max("hi").over(before), F.lit(True)).cast("int")
    run = F.sum("fresh").over(Window.partitionBy("digest").orderBy("lo", "hi").rowsBetween(Window.unboundedPreceding, 0))
    merged = ranges.withColumn("fresh", fresh).withColumn("run", run).groupBy("digest", "run").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    return merged.groupBy("digest").agg(F.array_sort(F.collect_list(F.struct("lo", "hi"))).alias("spans"))


def without_repeats(docs: DataFrame, spec: RepeatSpec = RepeatSpec()) -> DataFrame:
    """`docs` (text, more) with spans, the runs of bytes to remove, and kept, the other bytes in order.

    A byte goes if it lies in a string of `length` bytes that also starts elsewhere in the table,
    in the same text too; all of them go, copies are not spared. Every row is judged by itself:
    repeated rows are repeats of each other. A null text counts as the empty one, from which
    nothing goes, as from any text shorter than `length`. kept is binary, as cuts may split
    characters. Columns of `docs` named spans or kept are replaced, others stay.
    """
    plan = repeated_spans(docs, spec)
    flat = plan.select("digest", F.col("spans.lo").alias("los"), F.col("spans.hi").alias("his"))
    flat = written(flat, "repeats-plan")
    others = [c for c in docs.columns if c not in ("spans", "kept")]
    plain = docs.select(digest_of(_bytes(docs)).alias("digest"), _bytes(docs).alias("body"), F.struct(*(F.col(f"`{c}`") for c in others)).alias("row"))
    met = matched(plain, flat, ["digest"], "left")
    los, his = F.coalesce("los", F.array().cast("array<bigint>")), F.coalesce("his", F.array().cast("array<bigint>"))
    gaps = F.arrays_zip(
        F.concat(F.array(F.lit(0).cast("bigint")), his).alias("a"), F.concat(los, F.array(F.octet_length("body").cast("bigint"))).alias("b")
    )
    cut = lambda done, gap: F.concat(done, F.call_function("substring", F.col("body"), (gap["a"] + 1).cast("int"), (gap["b"] - gap["a"]).cast("int")))
    kept = F.aggregate(gaps, F.lit(b""), cut)
    return met.select("row", F.arrays_zip(los.alias("lo"), his.alias("hi")).alias("spans"), kept.alias("kept")).select("row.*", "spans", "kept")
