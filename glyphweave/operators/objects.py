"""References between a document's objects: replaced images, and what is still reached from the pages.

`refs`: doc_id, source, slot, target. Sources and targets name objects of a document; pages are sources too.
"""

from __future__ import annotations

import tempfile
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: The slot by which an image names its soft mask.
MASK = "SMask"
OBJECT = ["doc_id", "object"]
#: Rows (references, pages and sizes) of a document that one task follows in memory; larger documents are followed by joins.
MOST = 500_000
#: What a row of a document's links is: a page, a reference, or an object's size.
_PAGE, _REF, _SIZE = 0, 1, 2


def _checkpoints(spark: SparkSession) -> None:
    """Checkpoints go to spark.checkpoint.dir; local runs without one get a folder of their own."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="spark-objects-"))


def replace_images(refs: DataFrame, pages: DataFrame, replaced: DataFrame) -> DataFrame:
    """`refs` after images were replaced (`replaced`: doc_id, old_ref, new_ref; one row for each old_ref).

    Pages (doc_id, object) that showed an old image show the new one, which keeps the old one's soft
    mask. Other holders, such as forms, go on with the old image. A replacement is followed once, so
    swapped images are swapped. A null target stays null.
    """
    blank = F.lit(None).cast("string")
    ref, kept = F.lit(True).alias("is_ref"), ("doc_id", "source", "slot", "target")
    known = F.col("doc_id").isNotNull() & F.col("key").isNotNull()
    named = lambda rows, name, new: rows.select("doc_id", F.col(name).alias("key"), *(blank.alias(c) for c in kept[1:]), F.lit(False).alias("is_ref"), F.lit(new is None).alias("shows"), (blank if new is None else F.col(new)).alias("new_ref"))
    rows = lambda refs_, key, *more: refs_.select("doc_id", F.col(key).alias("key"), *kept[1:], ref, F.lit(False).alias("shows"), blank.alias("new_ref"), *more)
    new = named(replaced, "old_ref", "new_ref")
    # windows rather than joins: what is dealt by document stays where it is
    alike = Window.partitionBy("doc_id", "key")
    met = lambda c: F.when(known, F.max(c).over(alike))
    by_source = rows(refs, "source").unionByName(named(pages, "object", None)).unionByName(new)
    sources = by_source.select("is_ref", *kept, met("shows").alias("is_page"), met("new_ref").alias("heir")).where("is_ref")
    by_target = rows(sources, "target", "is_page", "heir").unionByName(new.select("*", F.lit(False).alias("is_page"), blank.alias("heir")))
    targets = by_target.select("is_ref", *kept, "is_page", "heir", met("new_ref").alias("new_target")).where("is_ref")
    target = F.when(F.col("is_page") & F.col("new_target").isNotNull(), F.col("new_target")).otherwise(F.col("target"))
    own = F.struct("source", "slot", target.alias("target"))
    mask = F.when((F.col("slot") == MASK) & F.col("heir").isNotNull(), F.array(own, F.struct(F.col("heir").alias("source"), "slot", "target")))
    return targets.select("doc_id", F.explode(F.coalesce(mask, F.array(own))).alias("r")).select("doc_id", "r.*")


def _links(refs: DataFrame, pages: DataFrame, sizes: DataFrame | None = None) -> DataFrame:
    """doc_id, source, object, n_bytes, link of all references, pages and sizes; references that lead nowhere or come from nowhere go."""
    whole = refs.where("doc_id is not null and source is not null and target is not null")
    nothing = F.lit(None).cast("string"), F.lit(None).cast("long")
    rows = whole.select("doc_id", "source", F.col("target").alias("object"), nothing[1].alias("n_bytes"), F.lit(_REF).alias("link"))
    rows = rows.unionByName(pages.select("doc_id", nothing[0].alias("source"), "object", nothing[1].alias("n_bytes"), F.lit(_PAGE).alias("link")))
    if sizes is None:
        return rows
    return rows.unionByName(sizes.select("doc_id", nothing[0].alias("source"), "object", F.col("n_bytes").cast("long").alias("n_bytes"), F.lit(_SIZE).alias("link")))


def _hops(rows: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """(hops, node) of each row's object in its document: how many references lead there from a page, -1 if none do; equal objects are one node."""
    n = rows.num_rows
    objects = rows["object"].combine_chunks()
    names = pa.concat_arrays([rows["source"].combine_chunks(), objects]).dictionary_encode()
    docs = rows["doc_id"].combine_chunks().dictionary_encode()
    codes = lambda c: c.indices.fill_null(len(c.dictionary)).to_numpy(zero_copy_only=False).astype(np.int64)
    link, unnamed = rows["link"].to_numpy(), (pc.is_null(rows["doc_id"]).to_numpy() | objects.is_null().to_numpy(zero_copy_only=False))
    nodes, at = np.unique(np.tile(codes(docs), 2) * (len(names.dictionary) + 1) + codes(names), return_inverse=True)
    order = np.argsort(at[:n][link == _REF], kind="stable")
    source, target = at[:n][link == _REF][order], at[n:][link == _REF][order]
    begin = np.searchsorted(source, np.arange(len(nodes) + 1))
    hops, fresh, far = np.full(len(nodes), -1), np.unique(at[n:][link == _PAGE]), 0
    while len(fresh):
        hops[fresh] = far
        far += 1
        many = begin[fresh + 1] - begin[fresh]
        onward = np.repeat(begin[fresh] - np.cumsum(many) + many, many) + np.arange(many.sum())
        met = np.unique(target[onward])
        fresh = met[hops[met] < 0]
    found = hops[at[n:]]
    found[unnamed & (link != _PAGE)] = -1
    return found, at[n:]


def _followed(links: DataFrame, most: int, out: list[str], kept: Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray]) -> DataFrame:
    """Columns `out` and hops of the links that `kept` (hops, node, link) tells, of documents with at most so many.

    A document's links meet in one task, in order of documents: one exchange, or none if they are dealt by document.
    """

    def follow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: list[pa.RecordBatch] = []
        for batch in batches:
            docs = batch.column("doc_id").dictionary_encode(null_encoding="encode").indices.to_numpy()
            if not len(docs):
                continue
            others = np.flatnonzero(docs != docs[-1])
            if not len(others) and rest and rest[-1].column("doc_id")[-1].as_py() == batch.column("doc_id")[-1].as_py():
                rest.append(batch)
                continue
            cut = int(others[-1]) + 1 if len(others) else 0
            yield from results([*rest, batch.slice(0, cut)])
            rest = [batch.slice(cut)]
        yield from results(rest)

    def results(parts: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(parts) if parts else None
        if rows is not None and rows.num_rows:
            hops, node = _hops(rows)
            chosen = kept(hops, node, rows["link"].to_numpy())
            yield from rows.select(out).append_column("hops", pa.array(hops.astype(np.int32))).filter(pa.array(chosen)).to_batches()

    counted = links.withColumn("n", F.count("*").over(Window.partitionBy("doc_id")))
    shape = links.select(*out, F.lit(0).alias("hops")).schema
    return counted.where(F.col("n") <= most).drop("n").mapInArrow(follow, shape)


def _crowded(links: DataFrame, most: int) -> DataFrame | None:
    """Documents (crowded) with more links, if there are any."""
    found = links.groupBy("doc_id").agg(F.count("*").alias("n")).where(F.col("n") > most).select(F.col("doc_id").alias("crowded"))
    return None if found.isEmpty() else found


def _of(rows: DataFrame, crowded: DataFrame) -> DataFrame:
    return rows.join(crowded, F.col("doc_id").eqNullSafe(F.col("crowded")), "left_semi")


def reached(refs: DataFrame, pages: DataFrame, most: int = MOST) -> DataFrame:
    """Objects (doc_id, object, hops) that chains of references lead to from `pages` (doc_id, object), which are 0 hops away.

    A document's references are followed where they lie, after one exchange on the document; cycles end. Documents with
    over `most` references and pages are followed by joins, round by round.
    """
    links = _links(refs, pages)

    def first_met(hops: np.ndarray, node: np.ndarray, link: np.ndarray) -> np.ndarray:
        there = np.flatnonzero(hops >= 0)
        chosen = np.zeros(len(hops), bool)
        chosen[there[np.unique(node[there], return_index=True)[1]]] = True
        return chosen

    met, crowded = _followed(links, most, OBJECT, first_met), _crowded(links, most)
    return met if crowded is None else met.unionByName(_reached_by_joins(_of(refs, crowded), _of(pages, crowded)))


def _reached_by_joins(refs: DataFrame, pages: DataFrame) -> DataFrame:
    """`reached` of documents of any size.

    A round follows the references of the objects met last, so an object's references are read
    once and rounds are as many as the longest shortest chain. Each round is checkpointed.
    """
    spark = refs.sparkSession
    _checkpoints(spark)
    edges = refs.where("target is not null").select("doc_id", F.col("source").alias("object"), "target").distinct().checkpoint()
    fresh = pages.select(*OBJECT).distinct().withColumn("hops", F.lit(0)).checkpoint()
    known, hops = fresh, 0
    while not fresh.isEmpty():
        hops += 1
        onward = fresh.join(edges, OBJECT).select("doc_id", F.col("target").alias("object")).distinct()
        fresh = onward.join(known, OBJECT, "left_anti").withColumn("hops", F.lit(hops)).checkpoint()
        known = known.unionByName(fresh)
    return known


def kept_and_freed(objects: DataFrame, refs: DataFrame, pages: DataFrame, most: int = MOST) -> DataFrame:
    """By document, how many objects (doc_id, object, n_bytes) are reached from its pages, and the bytes kept and freed.

    An object without a size counts no bytes; a document without objects gives no row. Documents with over `most`
    references, pages and objects are followed by joins.
    """
    links = _links(refs, pages, objects)
    met = _followed(links, most, ["doc_id", "n_bytes"], lambda hops, node, link: link == _SIZE).select("doc_id", "n_bytes", (F.col("hops") >= 0).alias("alive"))
    crowded = _crowded(links, most)
    if crowded is not None:
        alive = _reached_by_joins(_of(refs, crowded), _of(pages, crowded)).select(*OBJECT, F.lit(True).alias("alive"))
        joined = _of(objects, crowded).join(alive, OBJECT, "left")
        met = met.unionByName(joined.select("doc_id", F.col("n_bytes").cast("long").alias("n_bytes"), F.coalesce("alive", F.lit(False)).alias("alive")))
    size = F.coalesce("n_bytes", F.lit(0))
    return met.groupBy("doc_id").agg(
        F.count_if("alive").alias("n_kept"), F.sum(F.when(F.col("alive"), size).otherwise(0)).alias("kept_bytes"), F.sum(F.when(~F.col("alive"), size).otherwise(0)).alias("freed_bytes")
    )
