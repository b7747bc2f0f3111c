"""Resharding by minimum-cost flow.

Old shards hold bytes, new shards have capacities. A minimum-cost flow between
them, in which a byte that stays costs nothing, says how many bytes go where;
blocks of rows in a fixed order carry the flow out, and only blocks that change
their shard are rewritten. The flow is solved over shards, whose number is a
parameter; rows and blocks stay distributed.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fleetpulse.llm.common import attach, small, table
from fleetpulse.session import work_path, written

BLOCK_ROWS = 4096
OLD_SHARDS = 12
NEW_SHARDS = 8


def min_cost_flow(supply: Sequence[int], capacity: Sequence[int], cost: Sequence[Sequence[int]] | None = None) -> list[list[int]]:
    """Cheapest flow that ships all ``supply`` into ``capacity``; ``flow[i][j]`` units go from i to j.

    ``cost[i][j]`` is the price of a unit, by default 0 if i == j and 1 otherwise.
    Successive shortest paths with Bellman-Ford over the residual graph.
    """
    if sum(supply) > sum(capacity):
        raise ValueError("the new shards are too small")
    m, n = len(supply), len(capacity)
    price = cost or [[int(i != j) for j in range(n)] for i in range(m)]
    flow = [[0] * n for _ in range(m)]
    left, room = list(supply), list(capacity)
    while any(left):
        # distances from all old shards that still hold something; forward arcs i -> j, backward arcs j -> i
        far = [0 if left[i] else None for i in range(m)]
        near: list[int | None] = [None] * n
        via_new: list[int] = [-1] * n
        via_old: list[int] = [-1] * m
        changed = True
        while changed:
            changed = False
            for i in range(m):
                if far[i] is None:
                    continue
                for j in range(n):
                    if near[j] is None or far[i] + price[i][j] < near[j]:
                        near[j], via_new[j], changed = far[i] + price[i][j], i, True
            for j in range(n):
                if near[j] is None:
                    continue
                for i in range(m):
                    if flow[i][j] and (far[i] is None or near[j] - price[i][j] < far[i]):
                        far[i], via_old[i], changed = near[j] - price[i][j], j, True
        end = min((j for j in range(n) if room[j]), key=lambda j: near[j])
        path, j = [], end
        while True:
            i = via_new[j]
            path.append((i, j, 1))
            if via_old[i] < 0:
                break
            path.append((i, via_old[i], -1))
            j = via_old[i]
        amount = min([left[path[-1][0]], room[end], *(flow[i][j] for i, j, sign in path if sign < 0)])
        for i, j, sign in path:
            flow[i][j] += sign * amount
        left[path[-1][0]] -= amount
        room[end] -= amount
    return flow


def even(total: int, parts: int) -> list[int]:
    return [total // parts + (i < total % parts) for i in range(parts)]


def intervals(sizes: dict[int, int], shards: int) -> list[tuple[int, int, int, int]]:
    """(old, new, from, to): the byte range of an old shard that goes to a new one; what stays comes first."""
    olds = sorted(sizes)
    cost = [[int(old != j) for j in range(shards)] for old in olds]
    flow = min_cost_flow([sizes[o] for o in olds], even(sum(sizes.values()), shards), cost)
    out = []
    for old, row in zip(olds, flow):
        at = 0
        for j in sorted(range(shards), key=lambda j: (j != old, j)):
            if row[j]:
                out.append((old, j, at, at + row[j]))
                at += row[j]
    return out


def with_blocks(rows: DataFrame, counts: dict[int, int]) -> DataFrame:
    """``rows`` (old_shard, place, any more) with block; ``counts``: the rows of each old shard."""
    parts = F.lit(1).cast("long")
    for old, n in counts.items():
        parts = F.when(F.col("old_shard") == old, F.lit(-(-n // BLOCK_ROWS)).cast("long")).otherwise(parts)
    share = F.conv(F.substring("place", 1, 8), 16, 10).cast("double") / 2.0**32
    return rows.withColumn("block", F.floor(share * parts).cast("long"))


def reshard(rows: DataFrame, shards: int = NEW_SHARDS) -> DataFrame:
    """Rows (old_shard int, size long > 0, place: a hex digest that orders a shard, any more) with block, shard, slot.

    A row goes where the middle of its bytes lies, so a new shard misses its
    capacity by at most half a row for each of its cuts. ``slot`` counts from 0
    without gaps within a shard. Blocks hold about BLOCK_ROWS rows of an old
    shard, whatever its size; rows that have a block already keep it. Rows that agree
    in place may swap slots.
    """
    spark = rows.sparkSession
    held = {r[0]: (r[1], r[2]) for r in rows.groupBy("old_shard").agg(F.sum("size"), F.count("*")).collect()}
    cuts = intervals({o: b for o, (b, _) in held.items()}, shards)
    arcs = spark.createDataFrame(cuts, "old_shard int, shard int, lo long, hi long")
    blocked = rows if "block" in rows.columns else with_blocks(rows, {o: n for o, (_, n) in held.items()})

    blocks = blocked.groupBy("old_shard", "block").agg(F.sum("size").alias("bytes"))
    n_blocks = sum(-(-n // BLOCK_ROWS) for _, n in held.values())
    ahead = W.partitionBy("old_shard").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    starts = written(blocks.select("old_shard", "block", F.coalesce(F.sum("bytes").over(ahead), F.lit(0)).alias("start")), "shard-blocks")
    inside = W.partitionBy("old_shard", "block").orderBy("place", "size").rowsBetween(W.unboundedPreceding, -1)
    middle = F.col("size") + 2 * (F.col("start") + F.coalesce(F.sum("size").over(inside), F.lit(0)))
    placed = (
        blocked.join(small(starts, n_blocks * 64), ["old_shard", "block"])
        .withColumn("middle", middle)
        .join(F.broadcast(arcs), "old_shard")  # at most old times new shards
        .where("middle >= 2 * lo AND middle < 2 * hi")
        .drop("start", "middle", "lo", "hi")
    )
    numbered = placed.withColumn(
        "nth", F.row_number().over(W.partitionBy("old_shard", "block", "shard").orderBy("place", "size")).cast("long") - 1
    )
    numbered = written(numbered, "shard-rows")
    pieces = numbered.groupBy("shard", "old_shard", "block").agg(F.count("*").alias("n"))
    before = W.partitionBy("shard").orderBy("old_shard", "block").rowsBetween(W.unboundedPreceding, -1)
    offsets = pieces.withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    return (
        numbered.join(small(offsets, (n_blocks + len(cuts)) * 64), ["shard", "old_shard", "block"])
        .withColumn("slot", F.col("base") + F.col("nth"))
        .drop("base", "nth")
    )


def affected(plan: DataFrame) -> DataFrame:
    """(old_shard, block, rewritten): a block is left alone if all of its rows stay in the shard they are in."""
    return plan.groupBy("old_shard", "block").agg(F.bool_or(F.col("shard") != F.col("old_shard")).alias("rewritten"))


def numbered_in_place(rows: DataFrame) -> DataFrame:
    """``rows`` with their number among the rows of the same place, by size."""
    return rows.withColumn("nth", F.row_number().over(W.partitionBy("old_shard", "block", "place").orderBy("size")))


def rewrite(plan: DataFrame, layout: str, name: str = "resharded", target: str | None = None) -> DataFrame:
    """Rewrite the affected files of ``layout``; returns the new manifest (shard, path, rewritten).

    ``layout`` is a folder of Parquet files in partitions old_shard=/block=, and
    ``plan`` gives old_shard, block, place, size, shard and slot of every row in it. Blocks that
    stay keep their files; the rest is read, joined to its plan and written, with slots, below
    the shared work folder (or to ``target``) in partitions shard=. Rows are told apart by a column
    ``row`` if both have it, otherwise by place, size and their number among equals.
    """
    spark = plan.sparkSession
    target = target or work_path(spark, name)
    state = written(affected(plan), "shard-affected")
    moving = state.where("rewritten").drop("rewritten")
    stored = spark.read.parquet(layout)
    stored = stored.withColumns({"old_shard": F.col("old_shard").cast("int"), "block": F.col("block").cast("long")})
    rows = stored.join(moving, ["old_shard", "block"], "left_semi")
    where = plan.join(moving, ["old_shard", "block"], "left_semi")
    on = ["row"]
    if not ("row" in plan.columns and "row" in stored.columns):
        rows, where, on = numbered_in_place(rows), numbered_in_place(where), ["old_shard", "block", "place", "nth"]
    (
        rows.join(where.select(*on, "shard", "slot"), on)
        .drop("block", "nth")
        .write.partitionBy("shard")
        .parquet(target)
    )
    kept = state.where("NOT rewritten").select(
        F.col("old_shard").cast("int").alias("shard"),
        F.format_string(f"{layout}/old_shard=%d/block=%d", "old_shard", "block").alias("path"),
        F.lit(False).alias("rewritten"),
    )
    shards = plan.join(moving, ["old_shard", "block"], "left_semi").select("shard").distinct()
    moved = shards.select("shard", F.format_string(f"{target}/shard=%d", "shard").alias("path"), F.lit(True).alias("rewritten"))
    return kept.unionByName(moved)


def text_size(text: Column) -> Column:
    """UTF-8 bytes plus one; a null has no bytes."""
    return (F.octet_length(F.coalesce(text, F.lit(""))) + 1).cast("long")


def place_of(key: str) -> Column:
    """Where a row stands in its shard, as a hex digest; to be taken from the scanned table, before any shuffle."""
    scanned = F.monotonically_increasing_id().cast("string")
    return F.md5(F.concat_ws(":", F.lit("place"), F.coalesce(F.col(key).cast("string"), F.lit("null")), scanned).cast("binary"))


def stored_layout(rows: DataFrame) -> tuple[str, DataFrame]:
    """Folder of ``rows`` (old_shard, place, any more) in partitions old_shard=/block=, and its rows, each with a unique ``row``."""
    spark = rows.sparkSession
    layout = work_path(spark, "shard-layout")
    counts = {r[0]: r[1] for r in rows.groupBy("old_shard").agg(F.count("*")).collect()}
    blocked = with_blocks(rows, counts).repartition("old_shard", "block").withColumn("row", F.monotonically_increasing_id())
    blocked.write.partitionBy("old_shard", "block").parquet(layout)
    return layout, spark.read.schema(blocked.schema).parquet(layout)


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents moved from 12 shards by source to 8 shards of nearly equal bytes.

    The place of a row is a digest of its id and its number in the scan, so rows that
    share an id, or have none, are spread over the blocks like any others.

    The old shards are written as files, the affected ones are rewritten, and the
    result is read from the files. A null doc_id or text is placed like any other
    value; rows that repeat a document are rows of their own.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = table(spark, sf_dir, "documents").select(
        "doc_id",
        "text",
        text_size(F.col("text")).alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.pmod(F.crc32(F.coalesce(F.col("source"), F.lit("")).cast("binary")), F.lit(OLD_SHARDS)).cast("int").alias("old_shard"),
        place_of("doc_id").alias("place"),
    )
    layout, stored = stored_layout(rows)
    if stored.isEmpty():
        moved = stored.withColumns({"shard": F.lit(0), "slot": F.lit(0).cast("long")})
    else:
        plan = written(reshard(stored.select("row", "size", "old_shard", "block", "place")), "shard-plan")
        target = work_path(spark, "resharded")
        left = rewrite(plan, layout, target=target).where("NOT rewritten").select("path")
        columns = ["doc_id", "size", "text_crc32", "old_shard", "slot", "shard"]
        schema = ", ".join(f"{c} {dict(stored.dtypes + plan.dtypes)[c]}" for c in columns)
        moved = spark.read.schema(schema).parquet(target)
        path = F.format_string(f"{layout}/old_shard=%d/block=%d", "old_shard", "block")
        kept = stored.withColumn("path", path).join(left, "path", "left_semi").join(plan.select("row", "shard", "slot"), "row")
        moved = moved.unionByName(kept.select(*columns))
    return moved.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
        "old_shard",
    )
