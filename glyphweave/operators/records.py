"""Form fields, comments, images and versions: upserts, duplicates, savings, history."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glyphweave.functions.text import half_up


def last_values(writes: DataFrame, key: list[str], order: list[str], values: list[str]) -> DataFrame:
    """The last write of each key. `order` must leave no ties; partial maxima are taken before the shuffle."""
    last = F.max_by(F.struct(*values), F.struct(*order)).alias("last")
    return writes.groupBy(*key).agg(last).select(*key, *(F.col(f"last.{v}").alias(v) for v in values))


def upsert_fields(fields: DataFrame, writes: DataFrame) -> DataFrame:
    """Set `value` and `checked` of every widget of a written field, on all its pages or, if `writes` has page, on that one.

    `fields`: doc_id, page, name, kind, value, checked, option_value, options, read_only.
    `writes`: doc_id, name, value, seq. Last write wins; writes to unknown fields are
    dropped. Check boxes take "true" and "false", radio buttons are checked where their
    option is the value, lists take only their options.
    """
    key = ["doc_id", "name", *(["page"] if "page" in writes.columns else [])]
    last = last_values(writes.withColumnRenamed("value", "new"), key, ["seq"], ["new"])
    joined = fields.join(last, key, "left")
    allowed = F.col("new").isNotNull() & ((F.col("kind") != "dropdown") | F.array_contains("options", F.col("new")))
    value = F.when(allowed & (F.col("kind") != "checkbox"), F.col("new")).otherwise(F.col("value"))
    checked = (
        F.when(allowed & (F.col("kind") == "checkbox"), F.col("new") == "true")
        .when(allowed & (F.col("kind") == "radio"), F.col("new") == F.col("option_value"))
        .otherwise(F.col("checked"))
    )
    return joined.withColumn("value", value).withColumn("checked", checked).select(*fields.columns)


def field_names(fields: DataFrame) -> DataFrame:
    """The distinct names of each document's fields, sorted, and how many they are. Widgets repeat names; nulls don't count."""
    names = fields.select("doc_id", "name").distinct().groupBy("doc_id").agg(F.sort_array(F.collect_list("name")).alias("names"))
    return names.select("doc_id", "names", F.size("names").alias("n_fields"))


def upsert_comments(comments: DataFrame, writes: DataFrame) -> DataFrame:
    """Apply writes (doc_id, id, action, contents, seq) to comments: the last one of an id stands.

    "delete" removes it; "set" changes the contents, or adds a comment of 18 units at
    the place the write names (page, x, y). Blank contents are ignored.
    """
    useful = writes.where((F.col("action") == "delete") | (F.trim(F.coalesce("contents", F.lit(""))) != ""))
    last = last_values(useful.withColumnRenamed("contents", "new"), ["doc_id", "id"], ["seq"], ["action", "new", "page", "x", "y"])
    both = comments.alias("c").join(last.alias("l"), ["doc_id", "id"], "full").where("l.action is null or l.action <> 'delete'")
    side = F.lit(18.0)
    return both.select(
        "doc_id",
        F.coalesce("c.page", "l.page").alias("page"),
        "id",
        F.coalesce("c.x", "l.x").alias("x"),
        F.coalesce("c.y", "l.y").alias("y"),
        F.coalesce("c.w", side).alias("w"),
        F.coalesce("c.h", side).alias("h"),
        F.coalesce("l.new", "c.contents").alias("contents"),
    )


def distinct_images(images: DataFrame) -> DataFrame:
    """One row for each image of a document (doc_id, ref): the first page that shows it wins."""
    return images.groupBy("doc_id", "ref").agg(F.min("page").alias("first_page"), F.count("*").alias("n_uses"), F.first("n_bytes").alias("n_bytes"))


def single_filter(filters: Column) -> Column:
    """The name of a stream's filter if it has just one."""
    return F.when(F.size(filters) == 1, F.element_at(filters, 1))


def savings(images: DataFrame, only_if_smaller: bool = True) -> DataFrame:
    """Bytes before and after re-encoding, by document. Null `after` means undecodable: skipped."""
    counted = images.where("after is not null")
    if only_if_smaller:
        counted = counted.where("after < before")
    sums = counted.groupBy("doc_id").agg(F.sum("before").alias("before"), F.sum("after").alias("after"), F.count("*").alias("n_images"))
    share = F.when(F.col("before") > 0, half_up((F.col("before") - F.col("after")) / F.col("before") * 100)).otherwise(0)
    return sums.withColumn("saved_percent", share.cast("long"))


def repointed(refs: DataFrame, replaced: DataFrame) -> DataFrame:
    """References with replaced targets (old_ref, new_ref) followed once."""
    return refs.join(replaced, refs["ref"] == replaced["old_ref"], "left").withColumn("ref", F.coalesce("new_ref", "ref")).select(*refs.columns)


def history(versions: DataFrame, kept: int = 30) -> DataFrame:
    """The last `kept` versions of each document."""
    back = Window.partitionBy("doc_id").orderBy(F.desc("version"))
    return versions.withColumn("back", F.row_number().over(back)).where(F.col("back") <= kept).drop("back")


def append_version(versions: DataFrame, new: DataFrame, current: DataFrame, kept: int = 30) -> DataFrame:
    """Drop what was undone (after `current`: doc_id, version), add `new`, keep the last ones."""
    at = current.select("doc_id", F.col("version").alias("at"))
    alive = versions.join(at, "doc_id", "left").where(F.col("at").isNull() | (F.col("version") <= F.col("at"))).drop("at")
    return history(alive.unionByName(new), kept)


def as_of(versions: DataFrame, version: int) -> DataFrame:
    """Each document's latest version up to `version`, as undo and redo read it."""
    return history(versions.where(F.col("version") <= version), 1)
