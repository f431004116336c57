"""Ink masks to strokes: thinning, pruning, chain walking and point reduction, one image to a group.

These walks are sequential inside an image and independent between images, so each
is a grouped map; what follows on the points (smoothing, curves, lengths) is in
`vector`, as windows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame

POINTS = "img_id long, chain int, ord int, x double, y double"
#: Neighbours clockwise from the upper left, the order in which a walk looks round.
AROUND = [(-1, -1), (0, -1), (1, -1), (1, 0), (1, 1), (0, 1), (-1, 1), (-1, 0)]


def thin(mask: np.ndarray) -> np.ndarray:
    """One-pixel skeleton by two alternating passes over the whole mask, until nothing changes. The border is cleared."""
    ink = np.zeros(mask.shape, bool)
    ink[1:-1, 1:-1] = mask[1:-1, 1:-1] != 0
    changed = ink.size > 0
    while changed:
        changed = False
        for turn in (0, 1):
            ring = [np.roll(ink, (-dy, -dx), (0, 1)) for dx, dy in AROUND[1:] + AROUND[:1]]  # clockwise from above
            n, e, s, w = ring[0], ring[2], ring[4], ring[6]
            count = np.sum(ring, axis=0)
            rises = np.sum([~a & b for a, b in zip(ring, ring[1:] + ring[:1], strict=True)], axis=0)
            kept = (n & e & s) | (e & s & w) if turn == 0 else (n & e & w) | (n & s & w)
            gone = ink & (count >= 2) & (count <= 6) & (rises == 1) & ~kept
            if gone.any():
                ink &= ~gone
                changed = True
    return ink


class Skeleton:
    """Live pixels of a skeleton and their neighbours, in reading order."""

    def __init__(self, ink: np.ndarray):
        ys, xs = np.nonzero(ink)
        self.live = dict.fromkeys(zip(xs.tolist(), ys.tolist(), strict=True))

    def near(self, p: tuple[int, int]) -> list[tuple[int, int]]:
        return [q for dx, dy in AROUND if (q := (p[0] + dx, p[1] + dy)) in self.live]

    def prune(self, longest: int) -> None:
        """Erase dead ends of up to `longest` pixels that hang on a junction; strokes that stand alone stay."""
        changed = True
        while changed:
            changed = False
            for p in list(self.live):
                if p not in self.live or len(self.near(p)) != 1:
                    continue
                branch, at, junction = [], p, False
                while len(branch) < longest and not junction:
                    branch.append(at)
                    onward = [q for q in self.near(at) if q not in branch]
                    if not onward:
                        break
                    at = onward[-1]
                    junction = len(self.near(at)) >= 3
                if junction:
                    changed = True
                    for q in branch:
                        del self.live[q]

    def walk(self, p: tuple[int, int]) -> list[tuple[int, int]]:
        """Take pixels from `p` on, straight ahead where there is a choice."""
        path, last = [p], (0, 0)
        del self.live[p]
        while ahead := self.near(path[-1]):
            x, y = path[-1]
            step = max(ahead, key=lambda q: last[0] * (q[0] - x) + last[1] * (q[1] - y))  # first of equal ones
            last = step[0] - x, step[1] - y
            path.append(step)
            del self.live[step]
        return path

    def chains(self) -> Iterator[list[tuple[int, int]]]:
        """Open strokes from their ends, sweep after sweep, then loops from anywhere."""
        found = True
        while found:
            found = False
            for p in list(self.live):
                if p in self.live and len(self.near(p)) <= 1:
                    found = True
                    yield self.walk(p)
        for p in list(self.live):
            if p in self.live:
                yield self.walk(p)


def strokes_of(mask: np.ndarray) -> tuple[list[list[tuple[float, float]]], float]:
    """Centre lines of a mask's strokes, and their width. Dots are very short strokes; no ink gives none."""
    ink = int((mask != 0).sum())
    skeleton = thin(mask)
    if not ink or not skeleton.any():
        return [], 0.0
    width = min(8.0, max(1.25, ink / int(skeleton.sum())))
    pixels = Skeleton(skeleton)
    pixels.prune(max(4, int(np.floor(width * 2 + 0.5))))
    dots = {p for p in pixels.live if not pixels.near(p)}
    out: list[list[tuple[float, float]]] = []
    for chain in pixels.chains():
        if len(chain) == 1:
            if chain[0] in dots:
                x, y = chain[0]
                out.append([(float(x), float(y)), (x + 0.01, float(y))])
            continue
        steps = np.diff(np.array(chain, float), axis=0)
        if np.hypot(steps[:, 0], steps[:, 1]).sum() >= width * 1.5:
            out.append([(float(x), float(y)) for x, y in chain])
    return out, width


def reduce_points(xy: np.ndarray, epsilon: float) -> np.ndarray:
    """Which points to keep so that the rest lie within `epsilon` of the lines between them."""
    keep = np.zeros(len(xy), bool)
    if len(xy) < 3:
        return ~keep
    keep[[0, -1]] = True
    todo = [(0, len(xy) - 1)]
    while todo:
        a, b = todo.pop()
        d = xy[b] - xy[a]
        inner = xy[a + 1 : b]
        if not len(inner):
            continue
        off = np.abs(d[1] * inner[:, 0] - d[0] * inner[:, 1] + xy[b, 0] * xy[a, 1] - xy[b, 1] * xy[a, 0]) / (np.hypot(*d) or 1.0)
        k = int(np.argmax(off))
        if off[k] > epsilon:
            keep[a + 1 + k] = True
            todo += [(a, a + 1 + k), (a + 1 + k, b)]
    return keep


def trace(masks: DataFrame) -> DataFrame:
    """`masks` (img_id, width, height, mask: a byte per pixel) to strokes: POINTS and stroke_width. Images without ink give no rows."""

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                flat = np.frombuffer(row["mask"] or b"", np.uint8)
                if len(flat) != (row["width"] or 0) * (row["height"] or 0) or not len(flat):
                    continue
                found, width = strokes_of(flat.reshape(row["height"], row["width"]))
                points = [(row["img_id"], c, k, x, y, width) for c, chain in enumerate(found) for k, (x, y) in enumerate(chain)]
                if points:
                    kinds = (pa.int64(), pa.int32(), pa.int32(), pa.float64(), pa.float64(), pa.float64())
                    names = ["img_id", "chain", "ord", "x", "y", "stroke_width"]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*points, strict=True), kinds, strict=True)], names=names)

    return masks.select("img_id", "width", "height", "mask").mapInArrow(fold, f"{POINTS}, stroke_width double")


def decimate(points: DataFrame, epsilon: float) -> DataFrame:
    """Point reduction, chain by chain."""

    def fold(chain: pd.DataFrame) -> pd.DataFrame:
        chain = chain.sort_values("ord")
        return chain[reduce_points(chain[["x", "y"]].to_numpy(float), epsilon)]

    return points.select("img_id", "chain", "ord", "x", "y").groupBy("img_id", "chain").applyInPandas(fold, POINTS)


def _smoothed(xy: np.ndarray, strength: float) -> np.ndarray:
    """`vector.smooth` for one chain in memory."""
    for _ in range(3 if strength > 0 and len(xy) > 2 else 0):
        xy = np.concatenate([xy[:1], xy[1:-1] + ((xy[:-2] + xy[2:]) / 2 - xy[1:-1]) * min(1.0, strength) * 0.5, xy[-1:]])
    return xy


def _path(xy: np.ndarray) -> str:
    """`vector.svg_paths` for one chain in memory."""
    around = np.concatenate([xy[:1], xy, xy[-1:]])
    first = xy[:-1] + (around[2:-1] - around[:-3]) / 6
    second = xy[1:] - (around[3:] - around[1:-2]) / 6

    def pair(p: np.ndarray) -> str:
        short = [f"{v:.2f}".rstrip("0").rstrip(".") for v in p]
        return " ".join("0" if v == "-0" else v for v in short)

    return f"M{pair(xy[0])}" + "".join(f"C{pair(a)} {pair(b)} {pair(c)}" for a, b, c in zip(first, second, xy[1:], strict=True))


def svg_within(points: DataFrame, budget: int = 6144, smooth: float = 0.4, epsilon: float = 0.6, grow: float = 1.6, coarsest: float = 64.0) -> DataFrame:
    """Smoothed path data of each image within `budget` bytes: img_id, paths, n_paths, n_bytes, epsilon.

    The tolerance grows until the image fits; if it doesn't at the coarsest, the
    shortest fifth of its strokes goes, again and again, down to one. The search is
    sequential and an image's strokes are few, so each image is a group.
    """

    def fold(image: pd.DataFrame) -> pd.DataFrame:
        chains = [c.sort_values("ord")[["x", "y"]].to_numpy(float) for _, c in image.groupby("chain", sort=True)]
        draw = lambda kept: " ".join(_path(_smoothed(c, smooth)) for c in kept)
        near = epsilon
        kept = [c[reduce_points(c, near)] for c in chains if len(c) > 1]
        paths = draw(kept)
        while len(paths) > budget and near <= coarsest:
            near *= grow
            kept = [c[reduce_points(c, near)] for c in chains if len(c) > 1]
            paths = draw(kept)
        while len(paths) > budget and len(kept) > 1:
            kept.sort(key=lambda c: -np.hypot(*np.diff(c, axis=0).T).sum())
            kept = kept[: max(1, int(len(kept) * 0.8))]
            paths = draw(kept)
        return pd.DataFrame([(image["img_id"].iloc[0], paths, len(kept), len(paths), near)], columns=["img_id", "paths", "n_paths", "n_bytes", "epsilon"])

    return points.select("img_id", "chain", "ord", "x", "y").groupBy("img_id").applyInPandas(fold, "img_id long, paths string, n_paths int, n_bytes int, epsilon double")
