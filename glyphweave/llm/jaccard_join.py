"""N-gram Jaccard join with a count-vector R-tree.

A document is the set of its distinct word shingles. Shingles are hashed into
groups; a document's counts per group are a point, and the summed minima of two
points (or of two boxes' upper corners) bound the overlap of the sets below them.

The tree's top level splits on very fine groups, one shingle wide: with the groups
in one global order, two sets that meet in none of their first few occupied groups
have a summed minimum too small to link, so each set goes only to the nodes of
those groups, and Spark shuffles the nodes. The commoner a group is in the corpus,
the later it comes in the order, so that common ones stay out of the short list.
Below, a node's points are packed into boxes over coarse groups, boxes are joined
top down, and the pairs that survive are verified on the texts.

Equal sets are one class from the start. Links inside a class of near copies are
first found against pivots: a node's pivot meets all its others and leaves it. Nodes
whose documents are then all joined, or of which one is left, need no more work, so
a group of copies costs its size, not its square.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphweave.llm import texthash
from glyphweave.llm.components import components
from glyphweave.llm.workspace import discard, sized, written


@dataclass(frozen=True)
class Rule:
    """Sets of shingles of `width` words link if over * |union| <= under * |intersection|."""

    width: int = 4
    over: int = 85
    under: int = 100

    @property
    def class_ratio(self) -> float:
        """Size classes are a little wider than the linking ratio, so partners are in the same or the next class."""
        return 1 / (self.over / self.under - 0.01)


#: The rule of op9_jaccard_join.
RULE = Rule()
#: Groups of a point, and of the boxes over points; a coarse group is FINE / COARSE of them.
FINE, COARSE = 256, 32
CELL_BITS = 22
#: A fine group is common if so many different documents of BLOCK hold it, and the commoner the more do.
COMMON, BLOCK = 6, 8000
#: Rank below which a group is used for the first pivots.
FIRST = 4
#: Times that every mixed node tries another pivot before box trees are built over what is left of it.
TURNS = 2
LEAF, FAN, TILE = 24, 8, 2048
#: Pairs of boxes or points that a task looks at at once; the group counts it compares at once are eight times as many.
MEETINGS = 1 << 18


def sets_of(texts: pa.Array, width: int) -> Iterator[np.ndarray]:
    """Sorted distinct shingle hashes of each text; empty for null or wordless texts."""
    for row, end, buf, offs in texthash.chunks(texts):
        starts, ends, before = texthash.spans(buf, offs, texthash.NOT_SPACE)
        words = texthash.hash_words(buf, starts, ends)
        for k in range(end - row):
            found = np.sort(texthash.shingle_hashes(words[before[k] : before[k + 1]], width))
            yield found[np.concatenate([[True], found[1:] != found[:-1]])] if len(found) else found


def least_overlap(a: np.ndarray, b: np.ndarray, rule: Rule = RULE) -> np.ndarray:
    """The smallest intersection with which sets of these sizes link."""
    return -(-rule.over * (a + b) // (rule.over + rule.under))


def packed_counts(found: np.ndarray) -> bytes:
    """A set's counts per group, one byte each; 255 stands for that many or more."""
    counts = np.bincount((found % np.uint64(FINE)).astype(np.int64), minlength=FINE)
    return np.minimum(counts, 255).astype(np.uint8).tobytes()


def unpacked_counts(packed: list[bytes], sizes: np.ndarray) -> np.ndarray:
    """Counts per group, never below the true ones: a full byte stands for the set's whole size."""
    counts = np.frombuffer(b"".join(packed), np.uint8).reshape(-1, FINE).astype(np.int32)
    return np.where(counts == 255, np.maximum(sizes, 255)[:, None], counts)


def commonness(docs: DataFrame, rule: Rule) -> np.ndarray:
    """For each cell of fine groups, how common it is at most among any BLOCK documents read in a row: 0, or 1 and up for each doubling of COMMON.

    Every document is read; equal sets of a block count once. What is collected is
    bounded by the number of cells. The levels only choose the order of groups;
    results don't depend on them.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, levels, seen = np.zeros(1 << CELL_BITS, np.uint16), np.zeros(1 << CELL_BITS, np.uint8), set()

        def close() -> None:
            often = np.flatnonzero(sums >= COMMON)
            levels[often] = np.maximum(levels[often], np.log2(sums[often] / COMMON).astype(np.uint8) + 1)
            sums[:] = 0
            seen.clear()

        for batch in batches:
            for found in sets_of(batch.column(0), rule.width):
                if not len(found) or (key := hash(found.tobytes())) in seen:
                    continue
                seen.add(key)
                sums[np.unique(found >> np.uint64(64 - CELL_BITS)).astype(np.int64)] += 1
                if len(seen) == BLOCK:
                    close()
        close()
        met = np.flatnonzero(levels)
        yield pa.RecordBatch.from_arrays([pa.array(met, pa.int64()), pa.array(levels[met], pa.int32())], names=["cell", "level"])

    cells = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(count, "cell long, level int").groupBy("cell").agg(F.max("level").alias("level"))
    found, out = cells.toArrow(), np.zeros(1 << CELL_BITS, np.uint8)
    out[found["cell"].to_numpy()] = found["level"].to_numpy()
    return out


def signatures(docs: DataFrame, rule: Rule) -> tuple[DataFrame, DataFrame]:
    """Two written tables by row_no: the rows themselves (doc), and their signatures.

    A signature has id (doc_id as a number), n_shingles, set_key, counts and groups (the
    short list). Only texts go through Python; whole rows are written once, as they are.
    """
    shared = docs.sparkSession.sparkContext.broadcast(commonness(docs, rule))
    rows = written(docs.select(F.monotonically_increasing_id().alias("row_no"), F.struct("*").alias("doc")), "jaccard-rows", "zstd")

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        levels = shared.value
        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                batch = whole.slice(at, 1000)
                sizes, keys, counts, groups = [], [], [], []
                for found in sets_of(batch.column("text"), rule.width):
                    n = len(found)
                    sizes.append(n)
                    keys.append(hashlib.blake2b(found.tobytes(), digest_size=16).digest())
                    counts.append(packed_counts(found))
                    order = np.argsort(levels[(found >> np.uint64(64 - CELL_BITS)).astype(np.int64)], kind="stable")
                    take = n - -(-rule.over * n // rule.under) + 1 if n else 0
                    groups.append(found[order[:take]].view(np.int64))
                ends = np.cumsum([0, *map(len, groups)]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.zeros(0, np.int64), *groups])))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("row_no"), batch.column("id"), pa.array(sizes, pa.int64()), pa.array(keys, pa.binary()), pa.array(counts, pa.binary()), lists],
                    names=["row_no", "id", "n_shingles", "set_key", "counts", "groups"],
                )

    texts = rows.select("row_no", F.col("doc.doc_id").cast("long").alias("id"), F.col("doc.text").cast("string").alias("text"))
    signed = texts.mapInArrow(sign, "row_no long, id long, n_shingles long, set_key binary, counts binary, groups array<bigint>")
    return rows, written(signed, "jaccard-signatures", "zstd")


def _set_column(texts: pa.Array, width: int) -> list[np.ndarray]:
    """Sets of texts, each text of a run of equal ones hashed once."""
    codes = texts.dictionary_encode()
    sets = list(sets_of(codes.dictionary, width))
    return [sets[k] for k in codes.indices.to_pylist()]


def bounded(pairs: DataFrame, signed: DataFrame, rule: Rule) -> DataFrame:
    """Pairs (a, b) whose points' summed minima still allow a link. Only the points in question are moved."""
    pairs = written(pairs, "jaccard-tried")
    asked = written(pairs.select(F.explode(F.array("a", "b")).alias("row_no")).distinct(), "jaccard-asked")
    signed = signed.join(sized(asked), "row_no", "left_semi")
    left = signed.select(F.col("row_no").alias("a"), F.col("n_shingles").alias("n_a"), F.col("counts").alias("c_a"))
    right = signed.select(F.col("row_no").alias("b"), F.col("n_shingles").alias("n_b"), F.col("counts").alias("c_b"))

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                batch = whole.slice(at, 1000)
                n_a, n_b = batch.column("n_a").to_numpy(), batch.column("n_b").to_numpy()
                x, y = unpacked_counts(batch.column("c_a").to_pylist(), n_a), unpacked_counts(batch.column("c_b").to_pylist(), n_b)
                fits = np.minimum(x, y).sum(1) >= least_overlap(n_a, n_b, rule)
                yield batch.select(["a", "b"]).filter(pa.array(fits))

    return pairs.join(left, "a").join(right, "b").select("a", "b", "n_a", "n_b", "c_a", "c_b").mapInArrow(check, "a long, b long")


def verified(pairs: DataFrame, rows: DataFrame, rule: Rule, label: str) -> DataFrame:
    """Written: the pairs (a, b) that link, by their texts' exact sets.

    Texts of the documents in question are written once, so that both joins move
    only those and not the whole corpus.
    """
    pairs = written(pairs, f"{label}-pairs")
    asked = written(pairs.select(F.explode(F.array("a", "b")).alias("row_no")).distinct(), f"{label}-asked")
    texts = written(rows.select("row_no", F.col("doc.text").cast("string").alias("text")).join(sized(asked), "row_no", "left_semi"), f"{label}-texts", "zstd")
    left = texts.select(F.col("row_no").alias("a"), F.col("text").alias("t_a"))
    right = texts.select(F.col("row_no").alias("b"), F.col("text").alias("t_b"))

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                links = []
                for x, y in zip(_set_column(batch.column("t_a"), rule.width), _set_column(batch.column("t_b"), rule.width), strict=True):
                    both = len(np.intersect1d(x, y, assume_unique=True))
                    links.append(rule.under * both >= rule.over * (len(x) + len(y) - both))
                yield batch.select(["a", "b"]).filter(pa.array(links, pa.bool_()))

    met = pairs.join(left, "a").join(right, "b").select("a", "b", "t_a", "t_b")
    found = written(met.mapInArrow(check, "a long, b long"), label)
    discard(pairs, asked, texts)
    return found


def fits_in_size(n_a, n_b, rule: Rule):
    """Neither size under over / under of the other."""
    return (F.least(n_a, n_b) * rule.under) >= (F.greatest(n_a, n_b) * rule.over)


def beside_pivots(rows: DataFrame, turn: int, label: str) -> DataFrame:
    """Written: the rows of each node with several roots, but for its pivot, beside that pivot.

    The pivot is the document with the least hash of itself, the node and the turn, so
    nodes that hold the same documents try different ones. `rows`: node, row_no, n, root.
    """
    luck = F.xxhash64("row_no", "node", F.lit(turn))
    pivots = rows.groupBy("node").agg(
        F.min("root").alias("low"),
        F.max("root").alias("high"),
        F.min_by("row_no", luck).alias("pivot"),
        F.min_by("n", luck).alias("pivot_n"),
        F.min_by("root", luck).alias("pivot_root"),
    ).where("low < high")
    met = rows.join(pivots, "node").where("row_no <> pivot")
    return written(met.select("node", "row_no", "n", "root", "pivot", "pivot_n", "pivot_root"), label, "zstd")


def pivot_pairs(met: DataFrame, rule: Rule) -> DataFrame:
    """(a, b) of pivots and documents beside them, of another root and fitting size."""
    apart = met.where((F.col("root") != F.col("pivot_root")) & fits_in_size(F.col("n"), F.col("pivot_n"), rule))
    return apart.select(F.least("pivot", "row_no").alias("a"), F.greatest("pivot", "row_no").alias("b")).distinct()


def with_roots(rows: DataFrame, roots: DataFrame | None) -> DataFrame:
    """Set `root` of rows (row_no, ...): their component so far, or themselves."""
    if roots is None:
        return rows.withColumn("root", F.col("row_no"))
    named = roots.select(F.col("node").alias("row_no"), F.col("root").alias("found_root"))
    return rows.drop("root").join(sized(named), "row_no", "left").withColumn("root", F.coalesce("found_root", "row_no")).drop("found_root")


class BoxTree:
    """Points packed into boxes, level over level. A box knows its upper corner over coarse groups, its least size and its only root, if it has just one."""

    def __init__(self, points: np.ndarray, sizes: np.ndarray, roots: np.ndarray, rule: Rule = RULE):
        self.rule = rule
        coarse = points.astype(np.int32).reshape(len(points), COARSE, -1).sum(2)
        heavy = np.argmax(coarse, axis=1) if len(points) else np.zeros(0, int)
        self.order = np.lexsort((heavy, roots, sizes))
        self.points, self.coarse, self.sizes, self.roots = points[self.order].astype(np.int32), coarse[self.order], sizes[self.order], roots[self.order]
        self.levels = []
        corner, low, high, first, last = self.coarse, self.sizes, self.sizes, self.roots, self.roots
        step = LEAF
        while True:
            at = np.arange(0, len(corner), step)
            corner = np.maximum.reduceat(corner, at, axis=0)
            low, high = np.minimum.reduceat(low, at), np.maximum.reduceat(high, at)
            first, last = np.minimum.reduceat(first, at), np.maximum.reduceat(last, at)
            self.levels.append((corner, low, high, first, last, step))
            if len(at) == 1:
                break
            step = FAN

    def pairs(self) -> tuple[np.ndarray, np.ndarray]:
        """Positions (in the given order) of pairs of different roots that size and summed minima allow."""
        x, y = np.zeros(1, np.int64), np.zeros(1, np.int64)
        for depth in range(len(self.levels) - 1, -1, -1):
            corner, low, high, first, last, step = self.levels[depth]
            keep = self._may(corner, low, high, first, last, x, y)
            x, y = x[keep], y[keep]
            below = len(self.levels[depth - 1][0]) if depth else len(self.points)
            parts = []
            much = max(1, MEETINGS // step**2)
            for cut in range(0, len(x), much):
                i = (x[cut : cut + much, None] * step + np.arange(step)[None, :])[:, :, None]
                j = (y[cut : cut + much, None] * step + np.arange(step)[None, :])[:, None, :]
                i, j = np.broadcast_arrays(i, j)
                good = (i < below) & (j < below) & ((i < j) if not depth else (i <= j))
                i, j = i[good], j[good]
                if not depth:
                    for points in (self.coarse, self.points):  # most pairs fail on the shorter one
                        good = self._may(points, self.sizes, self.sizes, self.roots, self.roots, i, j)
                        i, j = i[good], j[good]
                parts.append((i, j))
            x = np.concatenate([np.zeros(0, np.int64), *(p[0] for p in parts)])
            y = np.concatenate([np.zeros(0, np.int64), *(p[1] for p in parts)])
        return self.order[x], self.order[y]

    def _may(self, corner, low, high, first, last, x, y) -> np.ndarray:
        ok = (np.minimum(high[x], high[y]) * self.rule.under >= np.maximum(low[x], low[y]) * self.rule.over)
        ok &= ~((first[x] == last[x]) & (first[y] == last[y]) & (first[x] == first[y]))
        at, much = np.flatnonzero(ok), 8 * MEETINGS // corner.shape[1]
        for cut in range(0, len(at), much):
            k = at[cut : cut + much]
            ok[k] = np.minimum(corner[x[k]], corner[y[k]]).sum(1) >= least_overlap(low[x[k]], low[y[k]], self.rule)
        return ok


def _groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Runs of equal keys in sorted batches, each run whole."""
    held: pa.Table | None = None
    for batch in batches:
        part = pa.Table.from_batches([batch])
        held = pa.concat_tables([held, part]) if held is not None else part
        cols = [held[k].to_numpy() for k in keys]
        edges = np.flatnonzero(np.logical_or.reduce([c[1:] != c[:-1] for c in cols])) + 1
        at = 0
        for e in edges.tolist():
            yield held.slice(at, e - at)
            at = e
        held = held.slice(at)
    if held is not None and held.num_rows:
        yield held


def tree_pairs(rows: DataFrame, signed: DataFrame, rule: Rule) -> DataFrame:
    """Distinct pairs (a, b) of different roots within nodes, by box trees of at most two tiles each.

    `rows`: node, row_no, n, root. A node's documents are split by size class, the
    smaller class visiting the next, where visitors don't meet each other; a large class
    is split into tiles, and every two tiles meet in a task of their own. A pair that
    shares several nodes is told by the least of them only: rows carry the nodes they are in.
    """
    spark: SparkSession = rows.sparkSession
    home = F.floor(F.log(F.col("n").cast("double")) / float(np.log(rule.class_ratio)))
    placed = rows.withColumn("home", home).withColumn("class", F.explode(F.array(F.col("home"), F.col("home") + 1)))
    met = placed.groupBy("node", "class").agg(F.count("*").alias("n_rows"), F.min("root").alias("low"), F.max("root").alias("high"), F.max((F.col("home") == F.col("class")).cast("int")).alias("lived"))
    useful = met.where("low < high and lived = 1").select("node", "class", F.ceil(F.col("n_rows") / TILE).alias("tiles"))
    tiled = placed.join(useful, ["node", "class"]).withColumn("tile", F.pmod(F.xxhash64("row_no"), F.col("tiles")))
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("tiles") - 1))
    spread = tiled.withColumn("other", other).select(
        "node", "class", F.least("tile", "other").alias("i"), F.greatest("tile", "other").alias("j"), "tile", "row_no", "n", "root", (F.col("home") < F.col("class")).alias("visits")
    )
    keys = ["node", "class", "i", "j"]
    lists = written(rows.groupBy("row_no").agg(F.collect_list("node").alias("nodes")), "jaccard-lists")
    counts = signed.select("row_no", "counts").join(sized(lists.select("row_no")), "row_no", "left_semi").join(lists, "row_no")
    width = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    dealt = spread.join(counts, "row_no").repartition(width, *keys).sortWithinPartitions(*keys)

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _groups(batches, keys):
            ids = group["row_no"].to_numpy()
            sizes = group["n"].to_numpy()
            points = unpacked_counts(group["counts"].to_pylist(), sizes)
            x, y = BoxTree(points, sizes, group["root"].to_numpy(), rule).pairs()
            visits = group["visits"].to_numpy()
            apart = group["i"][0].as_py() != group["j"][0].as_py()
            tiles = group["tile"].to_numpy()
            good = ~(visits[x] & visits[y]) & ((tiles[x] != tiles[y]) | (not apart))
            x, y = x[good], y[good]
            node, held = group["node"][0].as_py(), {}
            for k in np.unique(np.concatenate([x, y])).tolist():
                held[k] = set(group["nodes"][k].as_py())
            good = np.array([min(held[i] & held[j]) == node for i, j in zip(x.tolist(), y.tolist(), strict=True)], bool)
            x, y = x[good], y[good]
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(ids[x], ids[y])), pa.array(np.maximum(ids[x], ids[y]))], names=["a", "b"])

    return dealt.mapInArrow(join, "a long, b long").distinct()


#: A class of equal sets with over a HEAVY-th of all rows is joined by broadcast; there can't be more than HEAVY of them.
HEAVY = 1000


def _linked(docs: DataFrame, rule: Rule) -> tuple[DataFrame, DataFrame, DataFrame]:
    """linked_groups, and the written signatures that its first table still reads."""
    rows, signed = signatures(docs, rule)
    keyed = signed.select("row_no", "n_shingles", "set_key", "id")
    worded, alone = keyed.where("n_shingles > 0"), keyed.where("n_shingles = 0")
    best = F.min(F.struct(F.col("id").isNull().alias("unnamed"), "id", "row_no")).alias("best")
    classes = written(worded.groupBy("set_key").agg(F.min("row_no").alias("rep"), best, F.count("*").alias("n_rows")), "jaccard-classes")
    reps = signed.join(sized(classes.select(F.col("rep").alias("row_no"))), "row_no", "left_semi")
    slim = reps.select("row_no", F.col("n_shingles").alias("n"), "groups")

    first = slim.select("row_no", "n", F.explode(F.slice("groups", 1, FIRST)).alias("node"))
    met = beside_pivots(with_roots(first, None), 0, "jaccard-beside-first")
    links = verified(bounded(pivot_pairs(met, rule), signed, rule), rows, rule, "jaccard-links")
    roots = components(links, "jaccard-first")

    nodes = with_roots(slim, roots).select("row_no", "n", "root", F.explode("groups").alias("node"))
    split = nodes.groupBy("node").agg(
        F.min("root").alias("low"),
        F.max("root").alias("high"),
        F.count("*").alias("n_rows"),
        *(F.bit_xor(F.xxhash64("row_no", F.lit(k))).alias(f"held_{k}") for k in range(2)),
    ).where("low < high")
    held = ["low", "high", "n_rows", "held_0", "held_1"]  # nodes that hold the same documents are one
    mixed = split.groupBy(*held).agg(F.min("node").alias("node")).select("node", F.monotonically_increasing_id().alias("node_no"))
    mixed = written(mixed, "jaccard-nodes")  # small numbers are moved from here on, and not hashes
    rest = written(nodes.join(sized(mixed), "node").drop("node").withColumnRenamed("node_no", "node"), "jaccard-shared")
    used = [met, mixed, rest]
    for turn in range(TURNS):  # a pivot has met its node and leaves it
        met = beside_pivots(with_roots(rest, roots) if turn else rest, turn, f"jaccard-beside-{turn}")
        links = links.union(verified(bounded(pivot_pairs(met, rule), signed, rule), rows, rule, f"jaccard-more-{turn}"))
        roots = components(links, f"jaccard-turn-{turn}")
        rest = met.select("node", "row_no", "n")
        used.append(met)
    last = verified(tree_pairs(with_roots(rest, roots), signed, rule), rows, rule, "jaccard-last")
    discard(*used)
    roots = components(links.union(last), "jaccard-roots")

    rooted = with_roots(classes.select(F.col("rep").alias("row_no"), "set_key", "best", "n_rows"), roots)
    firsts = rooted.groupBy("root").agg(F.min("best").alias("first"))
    found = written(rooted.join(firsts, "root").select("set_key", "first", "n_rows"), "jaccard-found")
    every = found.agg(F.sum("n_rows")).first()[0] or 0
    heavy = F.col("n_rows") * HEAVY > every
    known = F.broadcast(found.where(heavy).drop("n_rows"))
    joined = worded.join(known, "set_key").unionByName(
        worded.join(known.select("set_key"), "set_key", "left_anti").join(found.where(~heavy).drop("n_rows"), "set_key")
    )
    own = F.struct(F.col("id").isNull().alias("unnamed"), "id", "row_no").alias("first")
    return joined.unionByName(alone.withColumn("first", own)).select(
        "row_no",
        F.col("id").alias("doc_id"),
        "n_shingles",
        F.col("first.id").alias("component_id"),
        (F.col("first.row_no") == F.col("row_no")).alias("is_first"),
    ), rows, signed


def linked_groups(docs: DataFrame, rule: Rule = RULE) -> tuple[DataFrame, DataFrame]:
    """One row for each row of `docs` (doc_id, text): what it is linked with, directly or over others.

    Returns two tables: row_no, doc_id, n_shingles, component_id (the smallest doc_id reachable),
    is_first (one row of each component, with that doc_id); and the written rows
    themselves (doc) by row_no.
    Rows with equal sets are linked; null and wordless texts are linked with nothing
    and are first. A null doc_id sorts after all others. An empty table gives no rows.
    """
    return _linked(docs, rule)[:2]


def one_of_each(docs: DataFrame, rule: Rule = RULE) -> DataFrame:
    """The rows of `docs` that come first in their component, with their columns."""
    grouped, rows, signed = _linked(docs, rule)
    kept = written(grouped.where("is_first").select("row_no"), "jaccard-kept")
    discard(signed)
    return rows.join(sized(kept), "row_no", "left_semi").select("doc.*")
