"""Connected components by contraction rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetpulse.session import written


def components(links: DataFrame) -> DataFrame:
    """``(node, label)`` of all nodes of ``links`` (src, dst: bigint); the label is the smallest node of the component.

    In each round every node moves to the neighbour of least hash, itself
    included, and links between nodes that met vanish. The hash changes from
    round to round, so chains shrink by a constant share whatever their numbers.
    Rounds are written to the shared folder; minima are combined before they are shuffled.
    """
    links = written(links.select("src", "dst").filter("src <> dst").distinct(), "links")
    place = written(
        links.select(F.col("src").alias("node")).unionByName(links.select(F.col("dst").alias("node"))).distinct().withColumn("at", F.col("node")),
        "places",
    )
    turn = 0
    while not links.isEmpty():
        turn += 1
        both = links.unionByName(links.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
        rank = lambda c: F.struct(F.xxhash64(F.col(c), F.lit(turn)).alias("h"), F.col(c).alias("to"))
        least = both.groupBy("src").agg(F.min(rank("dst")).alias("other"))
        moves = written(least.select(F.col("src").alias("at"), F.least(rank("src"), F.col("other"))["to"].alias("to")), "moves")
        place = written(
            place.join(moves, "at", "left").select("node", F.coalesce("to", "at").alias("at")),
            "places",
        )
        first = moves.select(F.col("at").alias("src"), F.col("to").alias("a"))
        second = moves.select(F.col("at").alias("dst"), F.col("to").alias("b"))
        moved = links.join(first, "src").join(second, "dst").filter("a <> b")
        links = written(moved.select(F.least("a", "b").alias("src"), F.greatest("a", "b").alias("dst")).distinct(), "links")
    names = place.groupBy("at").agg(F.min("node").alias("label"))
    return place.join(names, "at").select("node", "label")
