"""Resharding by minimum-cost flow.

Old shard sizes are supplies, new shard capacities are demands, and moving a byte
between two shards costs its price (0 to stay). The flow that moves the fewest
bytes is cut into blocks of whole documents, and only the files of shards that
give or take a block are written again.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glyphweave.llm.workspace import with_running_totals


def min_cost_flow(supply: list[int], demand: list[int], price: Callable[[int, int], int]) -> dict[tuple[int, int], int]:
    """Bytes to send from each old to each new shard, at the least total price.

    Successive cheapest augmenting paths over the residual graph; the graph has a
    node for each shard, so it is small whatever the data. Totals must agree. Prices are
    any numbers of 0 or more; `stay_or_move` is quicker where staying is free and every move costs the same.
    """
    if sum(supply) != sum(demand):
        raise ValueError("supplies and demands differ")
    n, m = len(supply), len(demand)
    flow = {(i, j): 0 for i in range(n) for j in range(m)}
    left, need = list(supply), list(demand)
    while any(left):
        cost: dict[tuple[str, int], float] = {("old", i): 0 for i in range(n) if left[i]}
        via: dict[tuple[str, int], tuple[str, int] | None] = dict.fromkeys(cost)
        changed = True
        while changed:
            changed = False
            for (i, j), sent in flow.items():
                a, b, p = ("old", i), ("new", j), price(i, j)
                if a in cost and cost[a] + p < cost.get(b, float("inf")):
                    cost[b], via[b], changed = cost[a] + p, a, True
                if sent and b in cost and cost[b] - p < cost.get(a, float("inf")):
                    cost[a], via[a], changed = cost[b] - p, b, True
        end = min((("new", j) for j in range(m) if need[j] and ("new", j) in cost), key=lambda x: (cost[x], x[1]))
        path, at = [], end
        while (before := via[at]) is not None:
            path.append((before, at))
            at = before
        amount = min([left[at[1]], need[end[1]], *(flow[b[1], a[1]] for a, b in path if a[0] == "new")])
        for a, b in path:
            if a[0] == "old":
                flow[a[1], b[1]] += amount
            else:
                flow[b[1], a[1]] -= amount
        left[at[1]] -= amount
        need[end[1]] -= amount
    return {k: v for k, v in flow.items() if v}


def stay_or_move(supply: list[int], demand: list[int]) -> dict[tuple[int, int], int]:
    """The cheapest flow where staying is free and moving costs the same for every pair of shards.

    A byte that can stay stays: sending it elsewhere frees a place that another byte must then be moved
    to. What is left over goes from the shards that have too much to those that have too little, in
    order; every such flow costs the same. So only those shards are in the graph, and it
    takes as many steps as there are shards.
    """
    if sum(supply) != sum(demand):
        raise ValueError("supplies and demands differ")
    n, m = len(supply), len(demand)
    flow = {(k, k): min(supply[k], demand[k]) for k in range(min(n, m))}
    over = [[i, s - flow.get((i, i), 0)] for i, s in enumerate(supply)]
    under = [[j, d - flow.get((j, j), 0)] for j, d in enumerate(demand)]
    over, under = [x for x in over if x[1]], [x for x in under if x[1]]
    at = 0
    for i, much in over:
        while much:
            amount = min(much, under[at][1])
            flow[i, under[at][0]] = amount
            much -= amount
            under[at][1] -= amount
            at += not under[at][1]
    return {k: v for k, v in flow.items() if v}


def even_capacities(total: int, shards: int) -> list[int]:
    return [total // shards + (k < total % shards) for k in range(shards)]


def reshard(
    docs: DataFrame,
    old_shard: Column,
    old_shards: int,
    new_shards: int,
    carry: list[str],
    capacities: Callable[[int], list[int]] | None = None,
    price: Callable[[int, int], int] | None = None,
) -> DataFrame:
    """Move documents from `old_shards` to `new_shards` shards of given byte capacities.

    `docs` needs doc_id and size; only `carry` goes along (add text to move whole
    rows). Returns carry, size, old_shard, shard, slot (gapless from 0 in a shard).
    `price` of a byte moved between two shards: nothing to stay and one otherwise, if not given.
    Within an old shard documents lie by falling size, so the bytes that stay are
    its largest documents and every cut falls among small ones. A document goes
    where its middle byte falls. Ties go by row, repeated rows stay apart; a null old
    shard counts as shard 0, any other outside 0 to old_shards - 1 is an error; a null, zero
    or negative size counts as one byte when rows are placed; an empty table gives no rows.
    Columns to carry may have any names but those of the result, which is an error.
    """
    spark = docs.sparkSession
    taken = {"size", "old_shard", "shard", "slot"} & set(carry)
    if taken:
        raise ValueError(f"columns of the result can't be carried: {', '.join(sorted(taken))}")
    carried = [f"carried_{k}" for k in range(len(carry))]
    capacities = capacities or (lambda total: even_capacities(total, new_shards))
    rows = docs.select(
        *(F.col(f"`{c}`").alias(k) for c, k in zip(carry, carried, strict=True)),
        "size",
        F.coalesce(old_shard.cast("int"), F.lit(0)).alias("old_shard"),
        F.greatest(F.coalesce(F.col("size").cast("long"), F.lit(1)), F.lit(1)).alias("weight"),
        (-F.greatest(F.coalesce(F.col("size").cast("long"), F.lit(1)), F.lit(1))).alias("by_size"),
        F.monotonically_increasing_id().alias("row_no"),
        F.lit(1).cast("long").alias("one"),
    )
    laid = with_running_totals(
        rows, ["old_shard", "by_size", "row_no"], {"bytes_before": "weight", "rows_before": "one"}, "reshard"
    )
    sums = laid.groupBy("old_shard").agg(F.sum("weight").alias("b"), F.count("*").alias("n")).collect()  # a row per shard
    outside = sorted(r["old_shard"] for r in sums if not 0 <= r["old_shard"] < old_shards)
    if outside:
        raise ValueError(f"old shards outside 0 to {old_shards - 1}: {outside[:10]}")
    supply = [0] * old_shards
    for r in sums:
        supply[r["old_shard"]] = r["b"]
    target = capacities(sum(supply))
    sent = min_cost_flow(supply, target, price) if price else stay_or_move(supply, target)
    leaving: dict[int, list[int]] = {}
    for i, j in sent:
        leaving.setdefault(i, []).append(j)
    blocks, byte_base = [], 0
    for i in range(old_shards):
        at = byte_base
        for j in sorted(leaving.get(i, []), key=lambda j: (j != i, j)):
            blocks.append((i, j, at, at + sent[i, j]))
            at += sent[i, j]
        byte_base += supply[i]
    plan = spark.createDataFrame(blocks, "old_shard int, shard int, begin long, stop long")
    middle = F.col("bytes_before") + F.expr("weight div 2")
    cut = laid.join(
        F.broadcast(plan.withColumnRenamed("old_shard", "from_shard")),
        (F.col("old_shard") == F.col("from_shard")) & (middle >= F.col("begin")) & (middle < F.col("stop")),
    )
    # One row per block: where its rows begin in its shard.
    order = Window.partitionBy("shard").orderBy("from_shard").rowsBetween(Window.unboundedPreceding, -1)
    sizes = cut.groupBy("from_shard", "shard").agg(F.count("*").alias("n"), F.min("rows_before").alias("first_row"))
    slots = sizes.select("from_shard", "shard", "first_row", F.coalesce(F.sum("n").over(order), F.lit(0)).alias("slot_base"))
    return cut.join(F.broadcast(slots), ["from_shard", "shard"]).select(
        *(F.col(k).alias(c) for c, k in zip(carry, carried, strict=True)),
        "size",
        "old_shard",
        "shard",
        (F.col("slot_base") + F.col("rows_before") - F.col("first_row")).alias("slot"),
    )


def moves(assigned: DataFrame) -> DataFrame:
    """Bytes and documents of each block: old_shard, shard, bytes, documents."""
    return assigned.groupBy("old_shard", "shard").agg(F.sum("size").alias("bytes"), F.count("*").alias("documents"))


def rewrite(assigned: DataFrame, path: str, writers_per_shard: int = 8) -> DataFrame:
    """Write the shards that give or take documents under `path`/shard=k; returns a list of those shards.

    Shards whose documents all stay, and that nothing enters, keep their files.
    """
    crossing = moves(assigned).where("old_shard <> shard")
    touched = crossing.select(F.explode(F.array("old_shard", "shard")).alias("shard")).distinct()
    spread = F.floor(F.col("slot") % writers_per_shard)
    (
        assigned.join(F.broadcast(touched), "shard", "left_semi")
        .repartition("shard", spread)
        .sortWithinPartitions("shard", "slot")
        .write.partitionBy("shard")
        .parquet(path)
    )
    return touched
