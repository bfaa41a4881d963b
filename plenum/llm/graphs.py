"""Connected components of an edge table by alternating large-star and small-star steps (Kiveris et al.)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plenum.llm.tables import Scratch


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """Each node's neighbours (greater ones, or smaller ones) move to the least node that it knows.

    The least is a pre-aggregated minimum that is joined back, so a hub's neighbours are never gathered in one place.
    """
    both = edges if not large else edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    if not large:
        both = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = both.groupBy("u").agg(F.min("v").alias("least")).select(F.col("u").alias("of"), F.least("u", "least").alias("least"))
    moved = both.join(least, both["u"] == least["of"]).select("u", "v", "least")
    if large:
        return moved.filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("least").alias("v")).filter("u != v").distinct()
    to = moved.select(F.col("v").alias("u"), F.col("least").alias("v")).unionByName(moved.select("u", F.col("least").alias("v")))
    return to.filter("u != v").distinct()


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, component): the least node reachable of every node that has an edge (u, v); edges hold no nulls."""
    # A count and two sums of edge hashes: the same on both sides of a step only if it changed nothing.
    sums = {"n": F.count(F.lit(1)), "x": F.bit_xor(F.xxhash64("u", "v")), "y": F.bit_xor(F.xxhash64("v", "u"))}
    edges, before = scratch.counted(edges.filter("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), **sums)
    while before["n"]:
        moved, now = scratch.counted(_stars(_stars(edges, True), False), **sums)
        scratch.drop(edges)
        edges = moved
        if now == before:
            break
        before = now
    nodes = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return nodes.unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
