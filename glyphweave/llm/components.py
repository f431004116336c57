"""Connected components of an edge table, by smallest labels and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphweave.llm.workspace import written


def components(edges: DataFrame, label: str) -> DataFrame:
    """(node, root) for every node of `edges` (a, b): root is the smallest node it is joined to.

    Each round takes the smallest root among neighbours and then the root's root,
    so chains shrink by half; every round is a written table, and only the number
    of changed rows comes to the driver. No edges give no rows.
    """
    pairs = edges.select("a", "b").where("a <> b")
    both = written(pairs.union(pairs.select("b", "a")).distinct(), f"{label}-edges")
    state = written(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("root")), f"{label}-state")
    while True:
        near = both.join(state, F.col("b") == F.col("node")).groupBy("a").agg(F.min("root").alias("near"))
        merged = state.join(near, F.col("node") == F.col("a")).select("node", F.col("root").alias("was"), F.least("root", "near").alias("root"))
        up = state.select(F.col("node").alias("parent"), F.col("root").alias("above"))
        jumped = merged.join(up, F.col("root") == F.col("parent"), "left").select(
            "node", "was", F.least("root", F.coalesce("above", "root")).alias("root")
        )
        after = written(jumped, f"{label}-round")
        state = after.select("node", "root")
        if not after.where("was <> root").limit(1).count():
            return state
