"""Written tables in the folder all executors share, and distributed prefix sums.

Lineage is cut by writing a table and reading it again, never by a local
checkpoint, so a lost executor costs only the tasks it was running.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_DIR = "spark.checkpoint.dir"


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder. Where none is named: a temporary one in local mode, as in tests, else an error."""
    named = spark.conf.get(_DIR, None)
    if not named:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError(f"{_DIR} must name a folder that all executors share")
        named = tempfile.mkdtemp(prefix="glyphweave-")
        spark.conf.set(_DIR, named)
    return named.rstrip("/")


#: While a table is written: shuffle files go once the query has ended, and batches for Python hold at most
#: so many rows, since rows carry whole texts.
_WHILE_WRITTEN = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.execution.arrow.maxRecordsPerBatch": "1000"}


def written(df: DataFrame, label: str, compression: str = "snappy") -> DataFrame:
    """Write `df` as Parquet in the shared folder and return a reader of it."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    before = {k: spark.conf.get(k, None) for k in _WHILE_WRITTEN}
    try:
        for k, v in _WHILE_WRITTEN.items():
            spark.conf.set(k, v)
        df.write.parquet(path, compression=compression)
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    return spark.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Free the space of written tables that no plan reads any more: each is overwritten by a table without rows."""
    for table in tables:
        for folder in {name.rsplit("/", 1)[0] for name in table.inputFiles()}:
            table.sparkSession.createDataFrame([], "nothing int").write.mode("overwrite").parquet(folder)


def sized(small: DataFrame, rows: int = 1_000_000) -> DataFrame:
    """A written table of a few numbers a row, as a broadcast side if its rows are counted and few; else as it is, to be shuffled."""
    return F.broadcast(small) if small.count() <= rows else small


#: A side that is broadcast holds at most so many bytes.
BROADCAST_BYTES = 64 << 20


def row_bytes(df: DataFrame) -> Column:
    """The size of a row in bytes: eight for each number, and what arrays and strings hold."""
    sizes = []
    for field in df.schema:
        kind = field.dataType.typeName()
        held = {"array": F.size(field.name) * 8, "string": F.octet_length(field.name), "binary": F.octet_length(field.name)}.get(kind)
        sizes.append(F.lit(8) if held is None else F.coalesce(held, F.lit(0)) + 16)
    return sum(sizes[1:], sizes[0])


def fits(small: DataFrame, most: int = BROADCAST_BYTES) -> bool:
    """Whether a written table, of numbers, strings and arrays of numbers, may be broadcast."""
    return (small.agg(F.sum(row_bytes(small))).first()[0] or 0) <= most


def matched(many: DataFrame, one: DataFrame, on: list[str], how: str = "inner", most: int = BROADCAST_BYTES) -> DataFrame:
    """Join `many` with `one`, a written table with a row for each key.

    `one` is broadcast if its bytes are counted and few. Else keys with over a thousandth of
    `many`'s rows, of which there are fewer than a thousand, are met by a broadcast and the
    others by a shuffle, so that no task gets a hot key. `many` is read three times then.
    """
    if fits(one, most):
        return many.join(F.broadcast(one), on, how)
    total = many.count()
    hot = written(many.groupBy(*on).count().where(F.col("count") * 1000 > total).drop("count").na.drop(), "hot-keys")
    marked = many.join(F.broadcast(hot.withColumn("is_hot", F.lit(True))), on, "left")
    known = one.join(F.broadcast(hot), on, "left_semi")
    some = marked.where("is_hot").drop("is_hot").join(F.broadcast(known), on, how)
    rest = marked.where("is_hot is null").drop("is_hot").join(one, on, how)
    return some.unionByName(rest)


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def with_running_totals(
    df: DataFrame, order: list[str], totals: dict[str, str], label: str, compression: str = "snappy"
) -> DataFrame:
    """Add, for each `new: column` of `totals`, the sum of `column` over all rows before this one.

    Rows are range-partitioned by `order` (which must have no ties), summed
    within each partition by a stream of Arrow batches, and written. Only one row
    for each partition goes to the driver; the bases come back as a join with as
    many rows.
    """
    spark = df.sparkSession
    local = [f"local_{k}" for k in totals]
    columns = list(totals.values())
    schema = spark.createDataFrame([], df.schema).selectExpr("*", *(f"0L as {k}" for k in local), "0 as part_no").schema

    def running(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        base = dict.fromkeys(columns, 0)
        for batch in batches:
            sums = []
            for name in columns:
                values = batch.column(name).to_numpy().astype(np.int64)
                after = values.cumsum() + base[name]
                sums.append(pa.array(after - values))
                base[name] = int(after[-1]) if len(after) else base[name]
            parts = pa.array(np.full(batch.num_rows, part, np.int32))
            yield pa.RecordBatch.from_arrays([*batch.columns, *sums, parts], names=[*batch.schema.names, *local, "part_no"])

    width = shuffle_width(spark)
    placed = written(
        df.repartitionByRange(width, *order)
        .sortWithinPartitions(*order)
        .mapInArrow(running, schema),
        label,
        compression,
    )
    sums = placed.groupBy("part_no").agg(*(F.sum(c).alias(c) for c in columns))
    found = sorted(sums.collect(), key=lambda r: r["part_no"])  # a row for each partition
    at, bases = dict.fromkeys(columns, 0), []
    for r in found:
        bases.append((r["part_no"], *(at[c] for c in columns)))
        at = {c: at[c] + r[c] for c in columns}
    named = ", ".join(f"base_{k} bigint" for k in totals)
    base_df = spark.createDataFrame(bases, f"part_no int, {named}")
    joined = placed.join(F.broadcast(base_df), "part_no")
    return joined.select(
        *df.columns,
        *((F.col(f"local_{k}") + F.col(f"base_{k}")).alias(k) for k in totals),
    )
