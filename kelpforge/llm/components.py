"""Connected components of an edge table by alternating large-star and small-star rounds, without a driver-side graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kelpforge.llm._common import join_heavy
from kelpforge.sources.shared import remove, scratch, settle_at


def _with_least(pairs: DataFrame, total: int, folder: str) -> DataFrame:
    """pairs (u, v) with m, the smallest of u and its neighbours; the pairs of a hub stay where they are."""
    least = settle_at(pairs.groupBy("u").agg(F.least("u", F.min("v")).alias("m"), F.count(F.lit(1)).alias("degree")), folder)
    return join_heavy(pairs, least, "u", "degree", total).drop("degree")


def _large_star(edges: DataFrame, total: int, folder: str) -> DataFrame:
    pairs = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    return _with_least(pairs, 2 * total, folder).where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(edges: DataFrame, total: int, folder: str) -> DataFrame:
    pairs = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    moved = _with_least(pairs, total, folder).select(F.col("u"), F.col("v").alias("a"), F.col("m").alias("b"))
    return moved.select("a", "b").union(moved.select(F.col("u").alias("a"), "b")).where("a <> b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """a, b for edges a, b (64-bit integers): each node that isn't the smallest of its component, with that smallest node.

    Loops and repeated edges don't matter; no edges give no rows. Rounds grow with the logarithm of a component's size;
    each is written to the shared folder, so a lost executor costs one round at most, and removes what the one before it
    wrote.
    """
    spark = edges.sparkSession
    state = lambda df: df.agg(F.count(F.lit(1)), F.sum((F.xxhash64("a", "b") % 1_000_003).cast("long"))).first()
    folder = scratch(spark, "components")
    edges = settle_at(edges.where("a <> b").select("a", "b").distinct(), f"{folder}/0")
    before, turn = None, 0
    while (now := state(edges)) != before and now[0]:
        before, turn = now, turn + 1
        large = settle_at(_large_star(edges, now[0], f"{folder}/{turn}-large-least"), f"{folder}/{turn}-large")
        edges = settle_at(_small_star(large, now[0], f"{folder}/{turn}-small-least"), f"{folder}/{turn}")
        for done in (f"{turn - 1}", f"{turn}-large-least", f"{turn}-large", f"{turn}-small-least"):
            remove(spark, f"{folder}/{done}")
    return edges
