"""Spatial joins by grid cells: boxes meet in the cells that they share, and each pair in one of them.

A join on the page alone compares everything on it with everything. Here the key is the page
and a cell, whose size follows the boxes on the smaller side, so that a page of a
million glyphs and ten thousand regions is dealt over as many tasks as it has cells.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glyphweave.operators.words import PAGE

#: A page has at most so many cells along each side of what its regions cover.
MOST_CELLS = 256


Box = tuple[str, str, str, str]


def cell_sizes(boxes: DataFrame, box: Box, key: list[str]) -> DataFrame:
    """(key, cell, and low_ and high_ of x and y): the mean side of the boxes of a key, no less than a 256th of what they cover; and the cells that they cover."""
    x, y, w, h = map(F.col, box)
    wide, high = F.max(x + w) - F.min(x), F.max(y + h) - F.min(y)
    sides = boxes.groupBy(*key).agg(
        F.greatest(F.avg(w), F.avg(h), wide / MOST_CELLS, high / MOST_CELLS, F.lit(1e-6)).alias("cell"),
        *(f(v).alias(n) for n, f, v in (("low_x", F.min, x), ("high_x", F.max, x + w), ("low_y", F.min, y), ("high_y", F.max, y + h))),
    )
    return sides.select(*key, "cell", *(F.floor(F.col(c) / F.col("cell")).alias(c) for c in ("low_x", "high_x", "low_y", "high_y")))


def overlapping(left: DataFrame, right: DataFrame, left_box: Box, right_box: Box, key: list[str] = PAGE) -> DataFrame:
    """Rows of `left` beside the rows of `right` whose boxes (x, y, w, h columns) overlap or touch theirs, with the same key, once each.

    `right` is the smaller side: cells follow its boxes, and keys without any are dropped first. Boxes with a
    null, a side that isn't finite or a negative one meet nothing. Other columns of the two sides must have different names.
    """

    def usable(side: DataFrame, box: Box) -> DataFrame:
        low = [F.abs(F.col(c)) < 1e12 for c in box[:2]]
        return side.where(low[0] & low[1] & F.col(box[2]).between(0, 1e12) & F.col(box[3]).between(0, 1e12))

    right = usable(right, right_box)
    cells = cell_sizes(right, right_box, key)

    def dealt(side: DataFrame, box: Box) -> DataFrame:
        known = side.join(cells, key)
        for axis, at, size in (("x", box[0], box[2]), ("y", box[1], box[3])):
            first = F.greatest(F.floor(F.col(at) / F.col("cell")), F.col(f"low_{axis}"))
            last = F.least(F.floor((F.col(at) + F.col(size)) / F.col("cell")), F.col(f"high_{axis}"))
            known = known.where(first <= last).withColumn(f"cell_{axis}", F.explode(F.sequence(first, last)))
        return known.drop("low_x", "high_x", "low_y", "high_y")

    met = dealt(usable(left, left_box), left_box).join(dealt(right, right_box).drop("cell"), [*key, "cell_x", "cell_y"])
    # of all shared cells, the one that holds the low corner of what is shared
    lx, ly, lw, lh, rx, ry, rw, rh = map(F.col, (*left_box, *right_box))
    here = (F.floor(F.greatest(lx, rx) / F.col("cell")) == F.col("cell_x")) & (F.floor(F.greatest(ly, ry) / F.col("cell")) == F.col("cell_y"))
    meets = (lx <= rx + rw) & (rx <= lx + lw) & (ly <= ry + rh) & (ry <= ly + lh)
    return met.where(here & meets).drop("cell", "cell_x", "cell_y")
