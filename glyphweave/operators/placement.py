"""New text and stamps on pages: where they go, how they wrap, and the glyphs they become."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glyphweave.functions.fontmetrics import measure_column, width_column
from glyphweave.functions.text import squeeze


def stamp_box(width: Column, height: Column, aspect: Column, widest: float, share: float) -> Column:
    """Where a new image or stamp goes on a page: centred, `share` of its width but at most `widest`, near its foot."""
    w = F.least(F.lit(widest), width * share)
    return F.struct(((width - w) / 2).alias("x"), F.greatest(F.lit(40.0), height * 0.15).alias("y"), w.alias("w"), (w / aspect).alias("h"))


def signature_size(height: Column) -> Column:
    """Font size of a typed signature in a box of this height."""
    return F.greatest(F.lit(6.0), F.least(F.lit(140.0), height * 0.85))


def place_text(texts: DataFrame, size: float, font: str = "Helvetica") -> DataFrame:
    """Glyphs of texts set in boxes (text_id, doc_id, page, text, x, y, w, h), lines 1.2 sizes apart from the top.

    Lines break at line feeds only. Returns text_id, doc_id, page, line_no, at, unicode,
    x, y (the baseline), width, height, font_res, font_size.
    """
    lines = texts.select("text_id", "doc_id", "page", "x", "y", "h", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    chars = lines.select("*", F.posexplode(F.filter(F.split("line", ""), lambda c: c != "")).alias("at", "unicode"))
    advance = width_column(F.lit(font), F.ascii("unicode")) * size / 1000
    along = Window.partitionBy("text_id", "line_no").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    wide = chars.withColumn("width", advance)
    return wide.select(
        "text_id",
        "doc_id",
        "page",
        "line_no",
        "at",
        "unicode",
        (F.col("x") + F.coalesce(F.sum("width").over(along), F.lit(0.0))).alias("x"),
        (F.col("y") + F.col("h") - size - 1.2 * size * F.col("line_no")).alias("y"),
        "width",
        F.lit(size).alias("height"),
        F.lit(font).alias("font_res"),
        F.lit(size).alias("font_size"),
    )


def wrap_measured(texts: DataFrame, key: list[str], font: Column, limit: Column) -> DataFrame:
    """Greedy lines (key..., line_no, line) of texts under `limit` thousandths of an em in a font known by name.

    `key` names the rows. Text is split at white space; a word wider than the limit has
    a line of its own; a text without words gives one empty line. A word whose width
    isn't known fits, and so does all that follows on its line; nothing breaks under a null limit.

    A word's next line begins at the first word that ends beyond its begin plus the
    limit. Ends ascend, so one ordered pass over ends and limits tells it for every word; lines are
    then reached from the first word by doubling jumps, in as many steps as their number has binary digits.
    """
    split = texts.select(*key, F.filter(F.split(squeeze(F.coalesce("text", F.lit(""))), " "), lambda w: w != "").alias("words"), font.alias("font"), limit.cast("double").alias("most"))
    gap = width_column(F.col("font"), F.lit(32)).cast("double")
    width = measure_column(F.col("font"), F.col("word")).cast("double")
    rows = split.select(*key, "font", "most", F.posexplode_outer("words").alias("at", "word")).withColumn("width", width).withColumn("gap", gap)
    known = F.col("width").isNotNull() & F.col("gap").isNotNull()
    upto = Window.partitionBy(*key).orderBy("at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    run = rows.withColumns(
        {"known": known, "end": F.sum(F.coalesce("width", F.lit(0.0))).over(upto) + F.col("gap") * F.col("at"), "stretch": F.sum((~known).cast("int")).over(upto)}
    )
    end = F.struct(F.when(F.col("known"), F.col("end")).alias("value"), F.lit(0).alias("asks"))
    reach = F.struct((F.col("end") - F.col("width") + F.col("most")).alias("value"), F.lit(1).alias("asks"))
    events = run.select(*key, "at", "word", "known", "stretch", F.explode(F.array(end, reach)).alias("event")).select("*", "event.value", "event.asks")
    down = Window.partitionBy(*key, "stretch").orderBy(F.desc("value"), F.desc("asks"), F.desc("at")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    beyond = F.last(F.when((F.col("asks") == 0) & F.col("known"), F.col("at")), ignorenulls=True).over(down)
    asked = events.withColumn("beyond", beyond).where("asks = 1")
    following = F.when(F.col("known") & F.col("value").isNotNull(), F.greatest(F.col("beyond"), F.when(F.col("beyond").isNotNull(), F.col("at") + 1)))
    entry = F.when(F.col("at").isNotNull(), F.struct("at", "word", following.alias("next")))
    whole = asked.groupBy(*key).agg(F.array_sort(F.collect_list(entry)).alias("run"))
    n = F.size("run")
    jumps = F.concat(F.transform("run", lambda w: F.coalesce(w["next"], n)), F.array(n))
    met = whole.select(*key, "run", n.alias("n"), _reached(jumps, n).alias("begins"))
    words = lambda a, b: F.array_join(F.transform(F.slice("run", a + 1, b - a), lambda w: w["word"]), " ")
    starts = F.filter("begins", lambda b: b < F.col("n"))
    lines = F.transform(starts, lambda b, k: words(b, F.element_at("begins", k + 2)))
    return met.select(*key, F.posexplode(F.when(F.col("n") == 0, F.array(F.lit(""))).otherwise(lines)).alias("line_no", "line"))


def _reached(jumps: Column, n: Column) -> Column:
    """0, jumps[0], jumps[jumps[0]] ... up to n at least: each step doubles what is reached and how far a jump goes."""
    start = F.struct(F.array(F.lit(0)).alias("met"), jumps.alias("jump"))
    steps = F.sequence(F.lit(1), F.ceil(F.log2(n + 1)).cast("int") + 1)

    def step(acc: Column, _: Column) -> Column:
        after = lambda spots: F.transform(spots, lambda k: F.element_at(acc["jump"], k + 1))
        longer = F.struct(F.concat(acc["met"], after(acc["met"])).alias("met"), after(acc["jump"]).alias("jump"))
        return F.when(F.element_at(acc["met"], -1) >= n, acc).otherwise(longer)

    return F.aggregate(steps, start, step, lambda acc: acc["met"])
