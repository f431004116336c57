"""Affine matrices and rectangles as column expressions.

A matrix is a struct a..f (or six columns given as a dict); points are row vectors,
so `multiply(m1, m2)` applies m1 first.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

PARTS = "abcdef"


def matrix(values: list) -> Column:
    """A matrix from six numbers or columns."""
    return F.struct(*((v if isinstance(v, Column) else F.lit(float(v))).cast("double").alias(n) for n, v in zip(PARTS, values, strict=True)))


def identity() -> Column:
    return matrix([1, 0, 0, 1, 0, 0])


def multiply(m1: Column, m2: Column) -> Column:
    p, q = ({n: m[n] for n in PARTS} for m in (m1, m2))
    return matrix(
        [
            p["a"] * q["a"] + p["b"] * q["c"],
            p["a"] * q["b"] + p["b"] * q["d"],
            p["c"] * q["a"] + p["d"] * q["c"],
            p["c"] * q["b"] + p["d"] * q["d"],
            p["e"] * q["a"] + p["f"] * q["c"] + q["e"],
            p["e"] * q["b"] + p["f"] * q["d"] + q["f"],
        ]
    )


def apply(m: Column, x: Column, y: Column) -> tuple[Column, Column]:
    return m["a"] * x + m["c"] * y + m["e"], m["b"] * x + m["d"] * y + m["f"]


def apply_delta(m: Column, dx: Column, dy: Column) -> tuple[Column, Column]:
    """Like apply, without the translation."""
    return m["a"] * dx + m["c"] * dy, m["b"] * dx + m["d"] * dy


def translate(m: Column, tx: Column, ty: Column) -> Column:
    """Move by (tx, ty) before `m`."""
    return multiply(F.struct(*(F.lit(v).alias(n) for n, v in zip("abcd", (1.0, 0.0, 0.0, 1.0), strict=True)), tx.cast("double").alias("e"), ty.cast("double").alias("f")), m)


def scale_of(m: Column) -> tuple[Column, Column]:
    """Lengths of the transformed unit vectors."""
    return F.sqrt(m["a"] * m["a"] + m["b"] * m["b"]), F.sqrt(m["c"] * m["c"] + m["d"] * m["d"])


def invert(m: Column) -> Column:
    """The inverse; null for a singular matrix, so that one bad row doesn't end a job."""
    det = m["a"] * m["d"] - m["b"] * m["c"]
    a, b, c, d = m["d"] / det, -m["b"] / det, -m["c"] / det, m["a"] / det
    return F.when(det != 0, matrix([a, b, c, d, -(m["e"] * a + m["f"] * c), -(m["e"] * b + m["f"] * d)]))


def viewport(width: Column, height: Column, rotation: Column, scale: Column) -> dict[str, Column]:
    """Page space to screen space for a page's rotation: matrix, css_width, css_height.

    Rotations are taken modulo 360; anything but right angles counts as 0.
    """
    turn, s, zero = F.pmod(rotation, F.lit(360)), scale, F.lit(0.0)
    upright = matrix([s, zero, zero, -s, zero, height * s])
    turned = (
        F.when(turn == 90, matrix([zero, s, s, zero, zero, zero]))
        .when(turn == 180, matrix([-s, zero, zero, s, width * s, zero]))
        .when(turn == 270, matrix([zero, -s, -s, zero, height * s, width * s]))
        .otherwise(upright)
    )
    sideways = turn.isin(90, 270)
    return {
        "transform": turned,
        "css_width": F.when(sideways, height * s).otherwise(width * s),
        "css_height": F.when(sideways, width * s).otherwise(height * s),
    }


def rect_to_css(m: Column, x: Column, y: Column, w: Column, h: Column) -> dict[str, Column]:
    """Bounding box, on screen, of a rectangle given by its lower left corner."""
    corners = [apply(m, px, py) for px in (x, x + w) for py in (y, y + h)]
    xs, ys = [c[0] for c in corners], [c[1] for c in corners]
    left, top = F.least(*xs), F.least(*ys)
    return {"left": left, "top": top, "width": F.greatest(*xs) - left, "height": F.greatest(*ys) - top}


def union_rect() -> list[Column]:
    """Aggregates that unite rectangles x, y, w, h."""
    return [
        F.min("x").alias("x"),
        F.min("y").alias("y"),
        (F.max(F.col("x") + F.col("w")) - F.min("x")).alias("w"),
        (F.max(F.col("y") + F.col("h")) - F.min("y")).alias("h"),
    ]


def contains(x: Column, y: Column, w: Column, h: Column, px: Column, py: Column) -> Column:
    """Whether a rectangle holds a point; its edges belong to it."""
    return px.between(x, x + w) & py.between(y, y + h)


def overlaps(x: Column, y: Column, w: Column, h: Column, rx: Column, ry: Column, rw: Column, rh: Column) -> Column:
    """Whether two rectangles share more than an edge."""
    return (x < rx + rw) & (x + w > rx) & (y < ry + rh) & (y + h > ry)


def em_box(y: Column, height: Column) -> tuple[Column, Column]:
    """Lower edge and height of a glyph's em box: a descent of 0.22 below the baseline."""
    return y - 0.22 * height, height
