"""Connected components of a link table by alternating large-star and small-star."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import materialise


def _state(edges: DataFrame):
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    return tuple(row)


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component) for every node of ``edges`` (a, b long), where component is
    the smallest node reachable.

    Each half round is one partially aggregated minimum per node and one equi-join
    back, so a hub's links stay spread over tasks (the join may split a hot node).
    Every round is written to the shared folder; only a row count and a checksum
    reach the driver. Null ends and loops are ignored."""
    e = (edges.where("a is not null and b is not null and a <> b")
         .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    e = materialise(e)
    before = _state(e)
    for _ in range(max_rounds if before[0] else 0):
        both = e.unionAll(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        # written first: then both sides of the join are dealt anew, and Spark may split a hub
        low = materialise(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")))
        large = (both.join(low, "a").where("b > a and b <> m")
                 .select(F.col("b").alias("a"), F.col("m").alias("b")).distinct())
        large = materialise(large)
        low = materialise(large.groupBy("a").agg(F.min("b").alias("m")))
        small = large.join(low, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        e = materialise(small.unionAll(low.select("a", F.col("m").alias("b"))).distinct())
        after = _state(e)
        if after == before:
            break
        before = after
    else:
        if before[0]:
            raise RuntimeError("components did not settle")
    roots = e.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return e.select(F.col("a").alias("node"), F.col("b").alias("component")).unionAll(roots)
