"""Connected components over an edge table, by alternating large-star and small-star steps, each a pair of shuffles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexloom.llm import util


def _step(edges: DataFrame, large: bool) -> DataFrame:
    """large: each node links its larger neighbours to its least neighbour; small: its smaller ones and itself."""
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    # Materialised, so that the join reads two plain shuffles and a hub's rows can be split.
    least = util.cut_bare(both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m")))
    joined = both.join(least, "a")
    if large:
        out = joined.filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
    out = util.cut_bare(out.filter("a <> b").distinct())
    util.drop(least)
    return out


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first())


def stars(edges: DataFrame) -> DataFrame:
    """(a, b): each node that is not the least of its component, and the least. Input: (a, b), any order, no nulls."""
    edges = util.cut_bare(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct())
    state = _state(edges)
    while state[0]:
        large = _step(edges, True)
        util.drop(edges)
        edges = _step(large, False)
        util.drop(large)
        if (new := _state(edges)) == state:
            break
        state = new
    return edges
