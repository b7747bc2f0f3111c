"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetpulse.session import free_finished, written

#: The six characters of ``[\x20\x09-\x0D]``.
BLANKS = " \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"

#: A key with more than one row in HOT_SHARE is hot: there are fewer than HOT_SHARE of them.
HOT_SHARE = 256
SALTS = 64
#: Upper bound of anything sent to all executors on purpose.
BROADCAST_BYTES = 64 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small(df: DataFrame, bytes_proven: int) -> DataFrame:
    """``df`` marked for broadcast if its proven size is within the bound."""
    return F.broadcast(df) if bytes_proven <= BROADCAST_BYTES else df


def hot_keys(facts: DataFrame, key: str, weight: str) -> list:
    """Keys that hold more than one in HOT_SHARE of all rows: fewer than HOT_SHARE by construction."""
    total = facts.agg(F.sum(weight)).first()[0] or 0
    return [r[0] for r in facts.where(F.col(weight) * HOT_SHARE > F.lit(total)).select(key).collect() if r[0] is not None]


def attach(rows: DataFrame, facts: DataFrame, key: str, weight: str, salt_by: Sequence[str], how: str = "inner") -> DataFrame:
    """Join ``facts`` (one row per ``key``; ``weight``: rows that carry the key) to ``rows``.

    Hot keys are salted: their single fact is repeated SALTS times and their rows
    are dealt over the copies by a hash of ``salt_by``. ``facts`` should be stored.
    """
    hot = hot_keys(facts, key, weight)
    if not hot:
        return rows.join(facts, key, how)
    is_hot = F.col(key).isin(hot)
    dealt = rows.withColumn("_salt", F.when(is_hot, F.pmod(F.xxhash64(*salt_by), F.lit(SALTS))).otherwise(0).cast("int"))
    copies = facts.withColumn("_salt", F.explode(F.when(is_hot, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))))
    return dealt.join(copies, [key, "_salt"], how).drop("_salt")


def null_last(column: Column | str) -> list[Column]:
    """Fields for a struct whose minimum ignores nulls unless there is nothing else."""
    column = F.col(column) if isinstance(column, str) else column
    return [column.isNull().alias("absent"), column.alias("value")]


def worker_cache(owner: str) -> dict:
    """A dict that lives as long as the Python worker, across its tasks.

    It holds what one ``owner`` keeps. When another one asks, that is let go: workers are used again by later
    stages, and would carry the tables of all earlier ones.
    """
    import types

    name = "_fleetpulse_worker_cache"
    if name not in sys.modules:
        sys.modules[name] = types.ModuleType(name)
        sys.modules[name].owner = None
    held = sys.modules[name]
    if held.owner != owner:
        held.owner, held.items = owner, {}
    return held.items


def release_memory() -> None:
    """Give memory that Python and Arrow have freed back to the system; idle workers would keep it."""
    import ctypes

    import pyarrow

    pyarrow.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def released(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """``run`` over the batches of a task, with its memory given back at the end."""

    def whole(parts: Iterator) -> Iterator:
        yield from run(parts)
        release_memory()

    return whole


def components(edges: DataFrame, name: str) -> DataFrame:
    """Connected components of ``edges`` (src, dst: long): (node, label), label being the smallest node.

    Alternating large-star and small-star rounds; each round is written to the
    shared folder, so lineage stays short. Minima are combined before shuffling
    and the joins on a node are left to the adaptive skew join.
    """
    links = edges.select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")).where("u <> v").distinct()
    links = written(links, name)
    while True:
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        # large star: every larger neighbour of u points at the least of u's neighbourhood
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = written(large, name)
        # small star: u and all its smaller neighbours point at the least of them
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small_star = (
            large.join(low, "u")
            .select(F.col("v").alias("a"), F.col("m").alias("b"))
            .unionByName(low.select(F.col("u").alias("a"), F.col("m").alias("b")))
            .where("a <> b")
            .select(F.col("a").alias("u"), F.col("b").alias("v"))
            .distinct()
        )
        after = written(small_star, name)
        # done when every node has one neighbour, and that neighbour points nowhere
        ends = after.select(F.col("u").alias("node"), F.lit(1).alias("out"), F.lit(0).alias("in_"))
        ends = ends.unionByName(after.select(F.col("v").alias("node"), F.lit(0).alias("out"), F.lit(1).alias("in_")))
        open_ = ends.groupBy("node").agg(F.sum("out").alias("out"), F.max("in_").alias("in_")).where("out > 1 OR out > 0 AND in_ > 0")
        if open_.isEmpty():
            roots = after.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("label"))
            return after.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(roots)
        links = after
        free_finished(edges.sparkSession)
