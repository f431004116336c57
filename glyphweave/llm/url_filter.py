"""URL filter by a temporal list join, in DataFrame functions only.

Dated list entries become validity intervals; every capture is checked against the
entries that were active when it was fetched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glyphweave.llm.workspace import written

ENTRY_SCHEMA = "list_name string, pattern string, category string, action string, dated timestamp, seq int"


def intervals(entries: DataFrame) -> DataFrame:
    """Turn dated entries into (list_name, pattern, category, valid_from, valid_to).

    `entries`: list_name, pattern, category, action ("add" or "remove"), dated, seq.
    An added entry holds until the next entry of the same list and pattern, or for
    good (valid_to null). Of entries of one moment the one of larger seq stands (null: 0),
    of equal seq a removal before an addition, and of additions the category that sorts last
    (null before all); repeated rows are one. Entries with null pattern, date or action are left out;
    patterns are compared in lower case without a leading "*." or "www.".
    """
    pattern = F.regexp_replace(F.lower(F.trim("pattern")), r"^(\*\.|www\.)", "")
    known = (
        entries.withColumn("pattern", pattern)
        .where("pattern is not null and pattern <> '' and dated is not null and action in ('add', 'remove')")
        .groupBy("list_name", "pattern", "dated")
        .agg(F.max(F.struct(F.coalesce("seq", F.lit(0)).alias("seq"), "action", "category")).alias("last"))
    )
    turn = Window.partitionBy("list_name", "pattern").orderBy("dated")
    return (
        known.withColumn("valid_to", F.lead("dated").over(turn))
        .where("last.action = 'add'")
        .select("list_name", "pattern", F.col("last.category").alias("category"), F.col("dated").alias("valid_from"), "valid_to")
    )


def host_of(url: Column) -> Column:
    """Lower-case host without user, port and trailing dot; empty if there is none."""
    place = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)", 1)
    return F.lower(F.regexp_replace(F.regexp_replace(place, r"^.*@", ""), r"\.?(:[0-9]*)?$", ""))


def keys_of(host: Column, url: Column) -> Column:
    """What an entry may name to match: the host, its parent domains, and the host with each leading part of the path."""
    labels = F.split(host, r"\.")
    domains = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    path = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*([^?#]*)", 1)
    parts = F.filter(F.split(path, "/"), lambda s: s != "")
    bare = F.regexp_replace(host, r"^www\.", "")
    count = F.size(parts)
    prefixes = F.when(count > 0, F.transform(F.sequence(F.lit(1), F.greatest(count, F.lit(1))), lambda i: F.concat_ws("/", bare, F.array_join(F.slice(parts, 1, i), "/"))))
    return F.when(host == "", F.array().cast("array<string>")).otherwise(
        F.array_distinct(F.concat(domains, F.coalesce(prefixes, F.array().cast("array<string>"))))
    )


#: Captures that share a host or a domain are dealt over so many parts; every entry goes to each of them.
SALTS = 16


def judge(captures: DataFrame, entries: DataFrame, exempt: str = "allow") -> DataFrame:
    """Evaluate every row of `captures` (page_id, url, fetched_at) at its own time.

    Returns page_id, host, fetched_at, n_active (entries active for it), categories
    (distinct, sorted, comma-joined; empty if none), pattern (the longest active one,
    ties by name), blocked. A capture is blocked if an active entry names it and no
    active entry of category `exempt` is at least as long as every other. Null urls,
    urls without host and null fetch times match nothing. Every row comes back once,
    repeated ones too. Only these three columns are read.
    """
    rows = written(
        captures.select(F.monotonically_increasing_id().alias("row_no"), "page_id", "fetched_at", F.col("url").cast("string").alias("url"))
        .withColumn("host", F.coalesce(host_of(F.col("url")), F.lit(""))),
        "url-captures",
    )
    keyed = rows.select("row_no", "fetched_at", F.explode(keys_of(F.col("host"), F.col("url"))).alias("pattern"))
    salted = intervals(entries).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    met = keyed.withColumn("salt", F.pmod(F.col("row_no"), F.lit(SALTS)).cast("int")).join(salted, ["pattern", "salt"]).where(
        (F.col("fetched_at") >= F.col("valid_from")) & (F.col("valid_to").isNull() | (F.col("fetched_at") < F.col("valid_to")))
    )
    size = F.length("pattern")
    exempted = F.col("category") == exempt
    hits = met.groupBy("row_no").agg(
        F.count("*").alias("n"),
        F.array_join(F.array_sort(F.collect_set("category")), ",").alias("found"),
        F.min(F.struct((-size).alias("k"), F.col("pattern"))).alias("longest"),
        F.max(F.when(exempted, size)).alias("exempt_size"),
        F.max(F.when(~exempted, size)).alias("blocked_size"),
    )
    blocked = F.col("blocked_size").isNotNull() & (F.coalesce("exempt_size", F.lit(-1)) < F.col("blocked_size"))
    return rows.join(hits, "row_no", "left").select(
        "page_id",
        "host",
        "fetched_at",
        F.coalesce("n", F.lit(0)).alias("n_active"),
        F.coalesce("found", F.lit("")).alias("categories"),
        F.col("longest.pattern").alias("pattern"),
        F.coalesce(blocked, F.lit(False)).alias("blocked"),
    )
