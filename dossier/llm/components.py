"""Connected components by alternating large-star and small-star steps, each step cut off as a written table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.stages import settle


def components(edges: DataFrame, rounds: int = 50) -> DataFrame:
    """``node`` and ``label``, the smallest node it is connected with, for every node of ``edges`` (a, b).

    Every step links nodes to the least of their neighbours. Minima combine on the map side, and a
    node of any degree meets its minimum in a join whose large side can be split.
    """
    current = settle(_tidy(edges.select("a", "b")), "edges")
    before = None
    for _ in range(rounds):
        both = current.unionByName(current.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        # Large star: larger neighbours of a node move to its minimum.
        large = _tidy(both.filter("b > a").join(least, "a").select(F.col("m").alias("a"), "b"))
        # Small star: a node and its smaller neighbours move to the least of them.
        least = large.groupBy("b").agg(F.min("a").alias("m"))
        small = large.join(least, "b").select(F.col("m").alias("a"), F.explode(F.array("a", "b")).alias("b"))
        current = settle(_tidy(small), "edges")
        state = current.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first()
        if state == before:
            break
        before = state
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    labels = current.select(F.col("b").alias("node"), F.col("a").alias("label"))
    return labels.unionByName(current.select(F.col("a").alias("node"), F.col("a").alias("label"))).distinct()


def _tidy(edges: DataFrame) -> DataFrame:
    return edges.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
