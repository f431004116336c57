"""Approximate nearest neighbours over balanced posting lists.

Centroids come from a balanced split of a bounded sample; every vector is indexed.
A vector near a boundary is copied to several lists, centroids are searched through
an in-memory neighbour graph, and a query reads all lists whose centroid is not
much further than its nearest one, however many, and never fewer than a fixed number; a query
that still found too few neighbours reads all lists. Lists are dealt in groups, so a
query is moved once for each group and not for each list. Equal vectors are one point with its smallest
ids, since ties go to the smaller id anyway, so a flood of copies fills no list.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from glyphweave.llm.workspace import written


@dataclass(frozen=True)
class AnnSpec:
    neighbours: int = 5
    #: Points a list should have, and the most points one task reads of a list.
    list_points: int = 192
    block: int = 4096
    #: Centroids are fitted on a fiftieth of the points, but on so many at least and at most.
    #: With up to sample_most / 4 lists, lists keep their size up to about ten million points.
    sample: int = 20_000
    sample_most: int = 200_000
    #: A point goes to the nearest centroids within this ratio of its nearest, at most `copies`.
    spill_ratio: float = 1.08
    copies: int = 2
    #: A query reads lists within this distance ratio of its nearest centroid, and the nearest probe_lists at least:
    #: in a tight cluster the ratio alone leaves out lists that hold the cluster's other half.
    probe_ratio: float = 1.25
    probe_lists: int = 24
    #: Graph degree, and candidates kept while a query or a point walks the graph. A query
    #: whose beam ends inside probe_ratio is compared with all centroids instead.
    degree: int = 24
    probe_beam: int = 128
    index_beam: int = 24


def usable(vectors: list, dim: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(positions, rows) of vectors of one length without null, non-finite or only zero components."""
    kept, rows = [], []
    for k, v in enumerate(vectors):
        if v is None or not len(v) or (dim and len(v) != dim) or any(x is None for x in v):
            continue
        x = np.asarray(v, np.float64)
        if np.isfinite(x).all() and x.any():
            kept.append(k)
            rows.append(x)
    return np.array(kept, np.int64), np.array(rows, np.float64).reshape(len(rows), len(rows[0]) if rows else 0)


def points_of(vectors: DataFrame, dim: int, ids_kept: int) -> DataFrame:
    """Written: point_no, vec (doubles as bytes), ids (its smallest vec_ids). Batches are merged before the shuffle."""

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept, rows = usable(batch.column("embedding").to_pylist(), dim)
            ids = batch.column("vec_id").to_numpy(zero_copy_only=False)[kept]
            found: dict[bytes, list[int]] = {}
            for k in np.argsort(ids, kind="stable").tolist():
                mine = found.setdefault(rows[k].tobytes(), [])
                if len(mine) < ids_kept and (not mine or mine[-1] != ids[k]):
                    mine.append(int(ids[k]))
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(found), pa.binary()), pa.array(list(found.values()), pa.list_(pa.int64()))], names=["vec", "ids"]
            )

    parts = vectors.mapInArrow(merge, "vec binary, ids array<long>")
    ids = F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("ids")))), 1, ids_kept)
    merged = parts.groupBy("vec").agg(ids.alias("ids"))
    return written(merged.select(F.monotonically_increasing_id().alias("point_no"), "vec", "ids"), "ann-points")


def unit_rows(packed: list[bytes], dim: int) -> np.ndarray:
    x = even_rows(packed, dim)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def even_rows(packed: list[bytes], dim: int) -> np.ndarray:
    """Vectors scaled by a power of two each, so that norms neither overflow nor vanish; cosines are exactly those of the vectors."""
    x = np.frombuffer(b"".join(packed), np.float64).reshape(-1, dim)
    return np.ldexp(x, -np.frexp(np.abs(x).max(1, initial=0))[1][:, None])


def balanced_centroids(sample: np.ndarray, lists: int) -> np.ndarray:
    """Halve the fullest part along the line between its two means until there are `lists` parts; their means."""
    rng, parts = np.random.default_rng(11), [np.arange(len(sample))]
    while len(parts) < lists and len(parts[0]) > 1:
        parts.sort(key=len)
        part = parts.pop()
        x = sample[part]
        two = x[rng.choice(len(x), 2, replace=False)]
        for _ in range(6):
            side = ((x[:, None] - two[None]) ** 2).sum(2).argmin(1)
            two = np.stack([x[side == s].mean(0) if (side == s).any() else x[rng.integers(len(x))] for s in (0, 1)])
        order = np.argsort(x @ (two[1] - two[0]), kind="stable")
        half = len(x) // 2
        parts = [part[order[:half]], part[order[half:]], *parts]
        parts.sort(key=lambda p: -len(p))
    return np.stack([sample[p].mean(0) for p in parts if len(p)])


#: Most lists of a group; a bit of a long stands for each.
GROUP_LISTS = 32


class CentroidGraph:
    """Each centroid's nearest others; a walk keeps the best few seen and expands the best not yet expanded."""

    def __init__(self, centroids: np.ndarray, degree: int):
        self.centroids = centroids.astype(np.float32)
        degree = min(degree, len(centroids) - 1)
        near = np.empty((len(centroids), max(degree, 0)), np.int64)
        for at in range(0, len(centroids), 512):
            d = self._distances(self.centroids[at : at + 512])
            d[np.arange(len(d)), at + np.arange(len(d))] = np.inf
            near[at : at + 512] = np.argsort(d, axis=1, kind="stable")[:, :degree]
        ring = (np.arange(len(centroids)) + 1) % len(centroids)  # joins all parts of the graph
        self.near = np.column_stack([near, ring])
        self.starts = np.linspace(0, len(centroids) - 1, min(8, len(centroids))).astype(np.int64)

    def _distances(self, x: np.ndarray) -> np.ndarray:
        c = self.centroids
        return np.maximum((x**2).sum(1)[:, None] + (c**2).sum(1)[None] - 2 * x @ c.T, 0)

    def search(self, x: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """(centroids, distances) of up to `beam` near centroids for each row, nearest first."""
        x, n, beam = x.astype(np.float32), len(x), min(beam, len(self.centroids))
        every = np.arange(n)
        seen = np.zeros((n, len(self.centroids)), bool)
        best = np.full((n, beam), -1, np.int64)
        far = np.full((n, beam), np.inf, np.float32)
        done = np.zeros((n, beam), bool)
        fresh = np.broadcast_to(self.starts, (n, len(self.starts)))
        while True:
            new = ~np.take_along_axis(seen, fresh, 1)
            np.put_along_axis(seen, fresh, True, 1)
            d = ((self.centroids[fresh] - x[:, None]) ** 2).sum(2)
            d[~new] = np.inf
            all_far = np.concatenate([far, d], 1)
            order = np.argsort(all_far, axis=1, kind="stable")[:, :beam]
            far = np.take_along_axis(all_far, order, 1)
            best = np.take_along_axis(np.concatenate([best, fresh], 1), order, 1)
            done = np.take_along_axis(np.concatenate([done, np.zeros_like(new)], 1), order, 1) | ~np.isfinite(far)
            left = ~done
            if not left.any():
                return best, np.sqrt(far)
            pick = left.argmax(1)
            rows = left.any(1)
            done[every[rows], pick[rows]] = True
            fresh = np.where(rows[:, None], self.near[np.where(rows, best[every, pick], 0)], self.starts[0])


def choose_lists(graph: CentroidGraph, x: np.ndarray, beam: int, ratio: float, least: int, most: int | None) -> list[np.ndarray]:
    """Lists of each row, nearest first: those within `ratio` of the nearest, but `least` at least and, for index rows, `most` at most."""
    best, far = graph.search(x, beam)
    out = []
    for row, (lists, d) in enumerate(zip(best, far, strict=True)):
        if most is None and len(d) < len(graph.centroids) and d[-1] <= d[0] * ratio + 1e-9:
            d = np.sqrt(graph._distances(x[row : row + 1].astype(np.float32))[0])
            lists = np.argsort(d, kind="stable")
            d = d[lists]
        near = (d <= d[0] * ratio + 1e-9) | (np.arange(len(d)) < least)
        out.append(lists[near & np.isfinite(d)][:most])
    return out


def placed_in(points: DataFrame, graph, dim: int, beam: int, ratio: float, least: int, most: int | None) -> DataFrame:
    """(group_no, bits, point_no, vec) for each group with lists that a point belongs to; a bit for each of those lists."""

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups = -(-len(graph.value.centroids) // GROUP_LISTS)
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                lists = choose_lists(graph.value, unit_rows(batch.column("vec").to_pylist(), dim), beam, ratio, least, most)
                row, flat = np.repeat(np.arange(batch.num_rows), [len(x) for x in lists]), np.concatenate(lists)
                met, place_of = np.unique(row * groups + flat % groups, return_inverse=True)
                bits = np.zeros(len(met), np.int64)
                np.bitwise_or.at(bits, place_of, np.int64(1) << (flat // groups))
                row = pa.array(met // groups)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(met % groups), pa.array(bits), batch.column("point_no").take(row), batch.column("vec").take(row)],
                    names=["group_no", "bits", "point_no", "vec"],
                )

    return points.select("point_no", "vec").mapInArrow(place, "group_no long, bits long, point_no long, vec binary")


def _tiled(rows: DataFrame, name: str, size: int) -> tuple[DataFrame, DataFrame]:
    """Rows with a tile number in their group, and the tiles of each group."""
    tiles = rows.groupBy("group_no").agg(F.ceil(F.count("*") / size).alias("tiles"))
    return rows.join(tiles, "group_no").withColumn(name, F.pmod(F.xxhash64("point_no"), F.col("tiles"))).drop("tiles"), tiles


def hits_of(stored: DataFrame, probes: DataFrame, points: DataFrame, dim: int, spec: AnnSpec) -> DataFrame:
    """(query_no, point_no, score): the best points of each group's lists for each query that reads them, by exact cosine."""
    k = spec.neighbours + 1
    stored, group_tiles = _tiled(stored, "tile", spec.block)
    probes, probe_tiles = _tiled(probes, "probe_tile", spec.block)
    over = lambda tiles, name: F.explode(F.sequence(F.lit(0).cast("long"), F.col(tiles) - 1)).alias(name)
    left = probes.join(group_tiles, "group_no").select("group_no", "probe_tile", over("tiles", "tile"), "bits", "point_no", "vec")
    firsts = points.select("point_no", F.element_at("ids", 1).alias("first_id"))
    right = stored.join(probe_tiles, "group_no").select("group_no", over("tiles", "probe_tile"), "tile", "bits", "point_no", "vec").join(firsts, "point_no")
    keys = ["group_no", "probe_tile", "tile"]

    def compare(a: pa.Table, b: pa.Table) -> pa.Table:
        empty = pa.table({"query_no": pa.array([], pa.int64()), "point_no": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
        if not a.num_rows or not b.num_rows:
            return empty
        x, y = (even_rows(t["vec"].to_pylist(), dim) for t in (a, b))
        ids, first = b["point_no"].to_numpy(), b["first_id"].to_numpy()
        asked_bits, held_bits = a["bits"].to_numpy(), b["bits"].to_numpy()
        qs, ps, ss = [], [], []
        lx, ly = np.linalg.norm(x, axis=1), np.linalg.norm(y, axis=1)
        for at in range(0, len(x), 256):
            met = (asked_bits[at : at + 256, None] & held_bits[None]) != 0
            rough = np.where(met, x[at : at + 256] @ y.T / (lx[at : at + 256, None] * ly), -np.inf)
            least = np.partition(rough, -k, axis=1)[:, -k] if len(y) > k else np.full(len(rough), -np.inf)
            for q, row in enumerate(x[at : at + 256], at):
                some = np.flatnonzero(met[q - at] & (rough[q - at] >= least[q - at] - 1e-12))
                s = np.einsum("ij,j->i", y[some], row) / (ly[some] * lx[q])
                some = some[np.lexsort((first[some], -s))][:k]
                qs.append(np.full(len(some), a["point_no"][q].as_py()))
                ps.append(ids[some])
                ss.append(np.array([np.dot(y[j], row) / (ly[j] * lx[q]) for j in some]))
        return pa.table({"query_no": np.concatenate(qs), "point_no": np.concatenate(ps), "score": np.concatenate(ss)})

    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(compare, "query_no long, point_no long, score double")


def nearest(vectors: DataFrame, is_query, spec: AnnSpec | None = None) -> DataFrame:
    """For each row of `vectors` (vec_id, embedding) where `is_query` holds, its nearest others by cosine.

    Returns query_id, rank (from 1), vec_id, score: nearest first, ties to the smaller
    vec_id, all candidates if fewer. Vectors that are null, only zeros, of another
    length than most usable ones (of two such, the longer), or with null or non-finite
    components take no part, nor do rows without vec_id. Repeated rows count once; rows that
    share the query's vec_id aren't its neighbours. No usable vectors give no rows.
    """
    spec = spec or AnnSpec()
    spark = vectors.sparkSession
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding")).where(
        "vec_id is not null and embedding is not null"
    )
    fine = rows.where(F.forall("embedding", lambda x: x.isNotNull() & (F.abs(x) < float("inf"))) & F.exists("embedding", lambda x: x != 0))
    lengths = fine.groupBy(F.size("embedding").alias("length")).count()
    dim = lengths.agg(F.max_by("length", F.struct("count", "length"))).first()[0]
    k = spec.neighbours + 1
    if not dim:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    points = points_of(rows, dim, k)
    n = points.count()
    taken = min(max(spec.sample, n // 50), spec.sample_most)
    sample = points.orderBy(F.xxhash64("vec")).select("vec").limit(taken).toArrow()["vec"].to_pylist()
    if not sample:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    lists = max(1, min(-(-n // spec.list_points), len(sample) // 4))
    graph = spark.sparkContext.broadcast(CentroidGraph(balanced_centroids(unit_rows(sample, dim), lists), spec.degree))

    def queries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept, found = usable(batch.column("embedding").to_pylist(), dim)
            yield pa.RecordBatch.from_arrays([batch.column("vec_id").take(pa.array(kept)), pa.array([x.tobytes() for x in found], pa.binary())], names=["query_id", "vec"])

    asked = rows.where(is_query).mapInArrow(queries, "query_id long, vec binary").distinct()
    asked = written(asked.join(points.select("vec", "point_no"), "vec").select("query_id", "point_no"), "ann-queries")
    wanted = points.join(asked.select("point_no").distinct(), "point_no", "left_semi")

    stored = written(placed_in(points, graph, dim, spec.index_beam, spec.spill_ratio, 1, spec.copies), "ann-lists")
    probes = written(placed_in(wanted, graph, dim, spec.probe_beam, spec.probe_ratio, spec.probe_lists, None), "ann-probes")
    first = hits_of(stored, probes, points, dim, spec)
    found = written(points.select("point_no", F.size("ids").alias("n_ids")).join(first, "point_no").groupBy("query_no", "point_no").agg(F.max("score").alias("score"), F.first("n_ids").alias("n_ids")), "ann-found")
    met = found.groupBy("query_no").agg(F.sum("n_ids").alias("n"), F.count("*").alias("n_points"))
    few = wanted.join(met, F.col("point_no") == F.col("query_no"), "left").where((F.coalesce("n", F.lit(0)) < k) & (F.coalesce("n_points", F.lit(0)) < n))
    few = written(few.select("point_no", "vec"), "ann-few")
    if few.limit(1).count():  # an exact pass for queries that are left short
        groups = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(-(-len(graph.value.centroids) // GROUP_LISTS) - 1).cast("long")))
        whole = few.select(groups.alias("group_no"), F.lit(-1).cast("long").alias("bits"), "point_no", "vec")
        found = found.select("query_no", "point_no", "score").unionByName(hits_of(stored, whole, points, dim, spec))
    per_point = found.groupBy("query_no", "point_no").agg(F.max("score").alias("score"))
    ids = per_point.join(points.select("point_no", "ids"), "point_no").select("query_no", "score", F.explode("ids").alias("vec_id"))
    order = Window.partitionBy("query_no").orderBy(F.desc("score"), "vec_id")
    top = ids.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)
    answers = top.groupBy("query_no").agg(F.array_sort(F.collect_list(F.struct("place", "vec_id", "score"))).alias("near"))
    out = asked.join(answers, asked.point_no == answers.query_no)
    others = F.slice(F.filter("near", lambda h: h["vec_id"] != F.col("query_id")), 1, spec.neighbours)
    return out.select("query_id", F.posexplode(others).alias("at", "hit")).select(
        "query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("hit.vec_id").alias("vec_id"), F.col("hit.score").alias("score")
    )
