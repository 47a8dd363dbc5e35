"""Connected components of an edge table, by joins only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bitloom.plans.storage import materialize


def _minima(edges: DataFrame) -> DataFrame:
    """The smallest of a node's neighbours and itself."""
    return edges.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("_m")).withColumnRenamed("u", "_u")


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    met = both.filter("v > u").join(_minima(both), F.col("u") == F.col("_u"))
    return met.select(F.col("v").alias("u"), F.col("_m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """``edges`` point from the larger to the smaller node."""
    least = edges.groupBy("u").agg(F.min("v").alias("_m")).withColumnRenamed("u", "_u")
    moved = edges.join(least, F.col("u") == F.col("_u")).filter("v <> _m").select(F.col("v").alias("u"), F.col("_m").alias("v"))
    kept = least.select(F.col("_u").alias("u"), F.col("_m").alias("v"))
    return moved.unionByName(kept).distinct()


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``node, root`` for every node of ``edges(u, v)``: root is the smallest node it can reach.

    Alternating large-star and small-star steps (Kiveris et al. 2014): every
    round hangs neighbours under smaller nodes until all components are stars,
    after O(log² n) rounds. A hub's edges are joined, never collected, so the
    optimizer can split them; each round is a written table. Nulls and loops
    are ignored; no edges give an empty table.
    """
    clean = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    stars = materialize(clean.filter("u <> v").distinct(), "stars")
    seen = None
    for _ in range(max_rounds):
        stars = materialize(_small_star(_large_star(stars)), "stars")
        state = tuple(stars.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())
        if state == seen or not state[0]:
            break
        seen = state
    else:
        raise RuntimeError("the components did not settle")
    members = stars.select(F.col("u").alias("node"), F.col("v").alias("root"))
    roots = stars.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return members.unionByName(roots)
