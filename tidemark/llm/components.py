"""Connected components of a stored edge table, by alternating large-star and small-star steps.

Every round is written to shared storage, so nothing is lost with an executor and plans stay short. Only edges are
shuffled; a hub's rows are split by the engine's skewed joins.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common


def _star(edges: DataFrame, larger: bool) -> DataFrame:
    """Point neighbours to the least node around: those larger than the centre, or the centre and those smaller."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if larger else edges
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    met = both.join(least, "u")
    if larger:
        out = met.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = met.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return out.where("u <> v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """node, label: the least node of its component, for every node that an edge touches. ``edges`` has longs a and b."""
    now = common.cut(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    state = None
    while True:
        now = common.cut(_star(_star(now, True).select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), False), "edges")
        new = now.agg(F.count("*"), F.expr("bit_xor(xxhash64(u, v))")).first()
        if new == state:
            break
        state = new
    return now.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct())
