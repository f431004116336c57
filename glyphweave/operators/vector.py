"""Ink and strokes as relations: histogram and threshold, path length, smoothing, curves, cuts and joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glyphweave.operators.grid import overlapping
from glyphweave.functions.text import format_number, half_up

CHAIN = ["img_id", "chain"]


def luma(r: Column, g: Column, b: Column, a: Column) -> Column:
    """Mean of the colours over white, rounded: 0 to 255."""
    over = a / 255.0
    blend = lambda c: c * over + 255 * (1 - over)
    return half_up((blend(r) + blend(g) + blend(b)) / 3).cast("int")


def histogram(pixels: DataFrame) -> DataFrame:
    return pixels.groupBy("img_id", "bin").agg(F.count("*").alias("n"))


def otsu(bins: DataFrame) -> DataFrame:
    """The threshold of each image (img_id, bin, n): the lowest with the largest variance between the classes.

    160 where no threshold leaves both classes some pixels. A class holds the bins up to the threshold.
    """
    every = Window.partitionBy("img_id")
    upto = every.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    weight = (F.col("bin") * F.col("n")).cast("double")
    summed = bins.select(
        "img_id", "bin", F.sum("n").over(upto).cast("double").alias("low"), F.sum(weight).over(upto).alias("low_sum"), F.sum("n").over(every).cast("double").alias("all"), F.sum(weight).over(every).alias("all_sum")
    )
    high = F.col("all") - F.col("low")
    apart = F.col("low_sum") / F.col("low") - (F.col("all_sum") - F.col("low_sum")) / high
    between = F.when((F.col("low") > 0) & (high > 0), F.col("low") * high * apart * apart)
    best = summed.withColumn("between", between).groupBy("img_id").agg(F.max_by("bin", F.struct("between", -F.col("bin"))).alias("bin"), F.max("between").alias("between"))
    return best.select("img_id", F.when(F.col("between") > 0, F.col("bin")).otherwise(160).cast("int").alias("threshold"))


def binarize(pixels: DataFrame) -> DataFrame:
    """Ink of images given as pixels (img_id, px, r, g, b, a): px with mask 1 where luma lies under the image's threshold.

    The thresholds are one row for each image, joined back by img_id.
    """
    lit = pixels.select("img_id", "px", luma(*(F.col(c) for c in "rgba")).alias("bin"))
    found = lit.join(otsu(histogram(lit)), "img_id")
    return found.select("img_id", "px", F.col("bin").alias("luma"), (F.col("bin") < F.col("threshold")).cast("int").alias("mask"))


def stroke_width(ink: Column, skeleton: Column) -> Column:
    return F.greatest(F.lit(1.25), F.least(F.lit(8.0), ink / skeleton))


def path_length(points: DataFrame) -> DataFrame:
    """Length of each chain of points (img_id, chain, ord, x, y)."""
    along = Window.partitionBy(*CHAIN).orderBy("ord")
    dx, dy = (F.col(c) - F.lag(c).over(along) for c in "xy")
    return points.withColumn("d", F.coalesce(F.sqrt(dx * dx + dy * dy), F.lit(0.0))).groupBy(*CHAIN).agg(F.sum("d").alias("length"))


def shed(points: DataFrame, share: float = 0.8) -> DataFrame:
    """Keep the longest `share` of each image's chains, one at least; ties by chain."""
    ranked = path_length(points).withColumn("at", F.row_number().over(Window.partitionBy("img_id").orderBy(F.desc("length"), "chain")))
    kept = ranked.withColumn("n", F.count("*").over(Window.partitionBy("img_id"))).where(F.col("at") <= F.greatest(F.lit(1), F.floor(share * F.col("n"))))
    return points.join(kept.select(*CHAIN), CHAIN, "left_semi")


def smooth(points: DataFrame, strength: float, passes: int = 3) -> DataFrame:
    """Move each inner point towards the middle of its neighbours; ends stay. One exchange for all passes."""
    pull = min(1.0, strength) * 0.5
    along = Window.partitionBy(*CHAIN).orderBy("ord")
    out = points
    for _ in range(passes if pull > 0 else 0):
        near = {c: (F.lag(c).over(along) + F.lead(c).over(along)) / 2 for c in "xy"}
        out = out.select(*CHAIN, "ord", *(F.coalesce(F.col(c) + (near[c] - F.col(c)) * pull, F.col(c)).alias(c) for c in "xy"))
    return out


def bezier_segments(points: DataFrame) -> DataFrame:
    """A cubic from each point to the next, with Catmull-Rom control points; missing neighbours are the ends themselves."""
    along = Window.partitionBy(*CHAIN).orderBy("ord")
    cols = []
    for c in "xy":
        here, after = F.col(c), F.lead(c).over(along)
        before, beyond = F.coalesce(F.lag(c).over(along), here), F.coalesce(F.lead(c, 2).over(along), after)
        cols += [(here + (after - before) / 6).alias(f"{c}1"), (after - (beyond - here) / 6).alias(f"{c}2"), after.alias(f"{c}3")]
    return points.select(*CHAIN, "ord", "x", "y", *cols).where("x3 is not null")


def svg_paths(points: DataFrame) -> DataFrame:
    """Path data of each chain: one M, then C segments, with at most two decimals."""
    n = lambda c: format_number(F.col(c), 2)
    pair = lambda a, b: F.concat(n(a), F.lit(" "), n(b))
    body = F.concat(F.lit("C"), pair("x1", "y1"), F.lit(" "), pair("x2", "y2"), F.lit(" "), pair("x3", "y3"))
    segments = bezier_segments(points).select(*CHAIN, "ord", F.concat(F.lit("M"), pair("x", "y")).alias("head"), body.alias("body"))
    ordered = F.array_sort(F.collect_list(F.struct("ord", "body")))
    return segments.groupBy(*CHAIN).agg(F.concat(F.min_by("head", "ord"), F.array_join(F.transform(ordered, lambda s: s["body"]), "")).alias("d"))


def crossings(points: DataFrame, cuts: DataFrame) -> DataFrame:
    """Where segments of chains strictly cross the cuts (img_id, ax, ay, bx, by); near-parallel ones don't.

    Segments and cuts meet by grid cells of their drawing.
    """
    along = Window.partitionBy(*CHAIN).orderBy("ord")
    segments = points.withColumn("x3", F.lead("x").over(along)).withColumn("y3", F.lead("y").over(along)).where("x3 is not null")
    box = lambda a, b, c, d, n: {f"{n}x": F.least(a, c), f"{n}y": F.least(b, d), f"{n}w": F.abs(F.col(a) - F.col(c)), f"{n}h": F.abs(F.col(b) - F.col(d))}
    boxed = segments.withColumns(box("x", "y", "x3", "y3", "box_"))
    asked = cuts.select("img_id", "ax", "ay", "bx", "by").withColumns(box("ax", "ay", "bx", "by", "cut_"))
    met = overlapping(boxed, asked, ("box_x", "box_y", "box_w", "box_h"), ("cut_x", "cut_y", "cut_w", "cut_h"), ["img_id"])
    rx, ry, sx, sy = (F.col(a) - F.col(b) for a, b in (("x3", "x"), ("y3", "y"), ("bx", "ax"), ("by", "ay")))
    qx, qy = F.col("ax") - F.col("x"), F.col("ay") - F.col("y")
    across = rx * sy - ry * sx
    t, u = (qx * sy - qy * sx) / across, (qx * ry - qy * rx) / across
    inner = lambda v: (v > 1e-6) & (v < 1 - 1e-6)
    found = met.where(F.abs(across) >= 1e-9).withColumn("t", t).withColumn("u", u).where(inner(F.col("t")) & inner(F.col("u")))
    return found.select(*CHAIN, "ord", "t", (F.col("x") + F.col("t") * rx).alias("cx"), (F.col("y") + F.col("t") * ry).alias("cy"))


def cut_chains(points: DataFrame, cuts: DataFrame) -> DataFrame:
    """Chains split at every crossing; both parts get the crossing point. `part` numbers the parts along a chain."""
    hits = crossings(points, cuts)
    ends = hits.select(*CHAIN, F.col("ord").cast("double").alias("at"), "t", F.col("cx").alias("x"), F.col("cy").alias("y"))
    doubled = ends.withColumn("side", F.explode(F.array(F.lit(0), F.lit(1))))
    plain = points.select(*CHAIN, F.col("ord").cast("double").alias("at"), F.lit(0.0).alias("t"), "x", "y", F.lit(None).cast("int").alias("side"))
    along = Window.partitionBy(*CHAIN).orderBy("at", "t", F.coalesce("side", F.lit(0)))
    both = plain.unionByName(doubled)
    part = F.sum((F.coalesce("side", F.lit(0)) == 1).cast("int")).over(along.rowsBetween(Window.unboundedPreceding, 0))
    numbered = both.withColumn("part", part)
    within = Window.partitionBy(*CHAIN, "part").orderBy("at", "t")
    return numbered.select(*CHAIN, "part", (F.row_number().over(within) - 1).alias("ord"), "x", "y")


def nearest_end(points: DataFrame, spots: DataFrame, reach: float) -> DataFrame:
    """The chain end nearest to each spot (spot_id, img_id, px, py) within `reach`; of equal ones the last chain and end."""
    ends = points.groupBy(*CHAIN).agg(
        F.min_by(F.struct("x", "y"), "ord").alias("first"), F.max_by(F.struct("x", "y"), "ord").alias("last")
    ).select(*CHAIN, F.posexplode(F.array("first", "last")).alias("which", "at"))
    dx, dy = F.col("at.x") - F.col("px"), F.col("at.y") - F.col("py")
    met = spots.join(ends, "img_id").withColumn("d", F.sqrt(dx * dx + dy * dy)).where(F.col("d") <= reach)
    best = met.groupBy("spot_id").agg(F.min_by(F.struct("chain", "which", "d"), F.struct("d", -F.col("chain"), -F.col("which"))).alias("b"))
    return best.select("spot_id", F.col("b.chain").alias("chain"), F.col("b.which").alias("which"), F.col("b.d").alias("d"))


def connect_chains(points: DataFrame, joins: DataFrame) -> DataFrame:
    """Join chain a's end to chain b's (img_id, a, a_end, b, b_end; ends 0 first, 1 last): a, then b, as a new last chain."""
    last = points.groupBy("img_id").agg(F.max("chain").alias("last_chain"), F.count("*").alias("n_points"))
    known = points.join(joins, "img_id", "left").join(last, "img_id")
    is_a, is_b = F.col("chain") == F.col("a"), F.col("chain") == F.col("b")
    turned = (is_a & (F.col("a_end") == 0)) | (is_b & (F.col("b_end") == 1))
    ord_ = F.when(turned, -F.col("ord")).otherwise(F.col("ord"))
    joined = F.coalesce(is_a | is_b, F.lit(False))
    placed = known.select(
        "img_id",
        F.when(joined, F.col("last_chain") + 1).otherwise(F.col("chain")).alias("chain"),
        F.when(joined & is_b, 1).otherwise(0).alias("half"),
        F.when(joined, ord_).otherwise(F.col("ord")).alias("at"),
        "x",
        "y",
    )
    order = Window.partitionBy("img_id", "chain").orderBy("half", "at")
    chains = Window.partitionBy("img_id").orderBy("chain")
    return placed.withColumn("ord", F.row_number().over(order) - 1).withColumn("chain", F.dense_rank().over(chains) - 1).select("img_id", "chain", "ord", "x", "y")


def edit_strokes(points: DataFrame, drags: DataFrame, reach: float) -> DataFrame:
    """Apply one drag to each image: from one chain's end to another chain's it joins them, else it cuts what it crosses.

    `drags`: img_id, ax, ay, bx, by, one for each image; images without one stay as they are.
    Returns img_id, chain, ord, x, y, chains numbered anew.
    """
    ends = {}
    for side in "ab":
        spots = drags.select(F.col("img_id").alias("spot_id"), "img_id", F.col(f"{side}x").alias("px"), F.col(f"{side}y").alias("py"))
        ends[side] = nearest_end(points, spots, reach).select(F.col("spot_id").alias("img_id"), F.col("chain").alias(side), F.col("which").alias(f"{side}_end"))
    joins = ends["a"].join(ends["b"], "img_id").where("a <> b")
    together = connect_chains(points.join(joins.select("img_id"), "img_id", "left_semi"), joins)
    cuts = drags.join(joins.select("img_id"), "img_id", "left_anti")
    parts = cut_chains(points.join(joins.select("img_id"), "img_id", "left_anti"), cuts)
    renumbered = parts.withColumn("chain", F.dense_rank().over(Window.partitionBy("img_id").orderBy("chain", "part")) - 1)
    return together.unionByName(renumbered.select("img_id", "chain", "ord", "x", "y"))


def place_strokes(points: DataFrame, view: DataFrame, rect: tuple[float, float, float, float]) -> DataFrame:
    """Points of a view box (img_id, vw, vh) in a page rectangle, upside down as pages count from below; with the width factor."""
    x, y, w, h = rect
    sx, sy = F.lit(w) / F.col("vw"), F.lit(h) / F.col("vh")
    met = points.join(view, "img_id")
    return met.select(*CHAIN, "ord", (F.lit(x) + F.col("x") * sx).alias("x"), (F.lit(y + h) - F.col("y") * sy).alias("y"), ((sx + sy) / 2).alias("stroke_scale"))


def parse_svg_path(paths: DataFrame) -> DataFrame:
    """Commands of path data (path, d): path, ord, type, and the numbers x, y, x1, y1, x2, y2 that the type has."""
    commands = F.regexp_extract_all("d", F.lit(r"([MLC][^MLC]*)"), F.lit(1))
    rows = paths.select("path", F.posexplode(commands).alias("ord", "command"))
    numbers = F.transform(F.regexp_extract_all("command", F.lit(r"(-?[0-9]*\.?[0-9]+(?:[eE][-+]?[0-9]+)?)"), F.lit(1)), lambda s: s.cast("double"))
    kind = F.substring("command", 1, 1)
    parsed = rows.select("path", "ord", kind.alias("type"), numbers.alias("n"))
    curve = F.col("type") == "C"
    at = lambda k: F.try_element_at("n", F.lit(k))
    good = F.size("n") >= F.when(curve, 6).otherwise(2)
    return parsed.where(good).select(
        "path",
        "ord",
        "type",
        F.when(curve, at(5)).otherwise(at(1)).alias("x"),
        F.when(curve, at(6)).otherwise(at(2)).alias("y"),
        *(F.when(curve, at(k)).alias(c) for k, c in enumerate(("x1", "y1", "x2", "y2"), 1)),
    )
