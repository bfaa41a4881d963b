"""Dedup, ranking, top-k and paging (D1-D9). Every first or last follows an explicit order, ties included."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plenum.functions.text import quote_key
from plenum.sources.shared import new_folder

RANGES = 256


def first_per_key(rows: DataFrame, key: Column, *order: Column | str) -> DataFrame:
    """Of rows with one key the first."""
    keyed = rows.withColumn("_key", key)
    return keyed.withColumn("_n", F.row_number().over(Window.partitionBy("_key").orderBy(*order))).filter("_n = 1").drop("_n", "_key")


def exact_dedup(moments: DataFrame, *, quote: str = "quote", order: str = "pos") -> DataFrame:
    """D1 by the normalised quote."""
    return first_per_key(moments, quote_key(F.col(quote)), order)


def overlap_dedup(moments: DataFrame, *, quote: str = "quote", order: str = "pos", overlap: str = "is_in_overlap_region") -> DataFrame:
    """One row per quote: the place of the first, the content of the last that lies outside an overlap, else of the first; with the number removed."""
    keyed = moments.withColumn("_key", quote_key(F.col(quote)))
    row = F.struct(*moments.columns)
    outside = F.max_by(row, F.when(~F.col(overlap), F.col(order)))
    groups = keyed.groupBy("_key").agg(F.coalesce(outside, F.min_by(row, order)).alias("r"), F.min(order).alias("first_pos"), (F.count(F.lit(1)) - 1).alias("n_removed"))
    return groups.select("r.*", "first_pos", "n_removed")


def _decided(block):
    """Of one block's edges (earlier, later, kept: whether the earlier row is known to stay) the later rows that these decide."""
    import pandas as pd

    before: dict = {}
    for earlier, later, kept in zip(block["earlier"], block["later"], block["kept"], strict=True):
        before.setdefault(later, []).append((earlier, None if pd.isna(kept) else bool(kept)))
    out, more = {}, True
    while more:  # once, and once more to see that it is done, as rows come in order
        more = False
        for later, rows in before.items():
            if later not in out:
                states = [out.get(e) if k is None else k for e, k in rows]
                if any(states) or None not in states:
                    out[later], more = not any(states), True
    return pd.DataFrame({"id": pd.Series(list(out), dtype=block["later"].dtype), "kept": pd.Series(list(out.values()), dtype=bool)})


def semantic_dedup(rows: DataFrame, edges: DataFrame, *, id_column: str, order: str, checkpoint, block_edges: int = 200_000) -> tuple[DataFrame, DataFrame]:
    """D3: in order, a row goes if it is similar to a kept earlier one; (kept rows, decision log).

    ``edges`` has (earlier, later, similarity) of ids over the threshold. They are dealt by the later row's place into ranges
    of about ``block_edges``. In each round every range decides what its own edges and the decisions so far allow: a row goes
    if an earlier neighbour stays, and stays if all of them go, which gives what the greedy pass gives. A chain is followed
    within a range at once, so there are as many rounds as ranges that one chain of open decisions crosses. ``checkpoint``
    cuts the lineage of each round.
    """
    import math

    places = rows.select(F.col(id_column).alias("later"), F.col(order).alias("_at"))
    placed = edges.select("earlier", "later").distinct().join(places, "later")
    blocks = max(1, math.ceil(placed.count() / block_edges))
    # Partition numbers are those of the written table.
    held = checkpoint(placed.repartitionByRange(blocks, "_at", "later").sortWithinPartitions("_at", "later").withColumn("block", F.spark_partition_id()))
    kind = dict(rows.dtypes)[id_column]
    first = held.select(F.col("earlier").alias("id")).distinct().join(held.select(F.col("later").alias("id")).distinct(), "id", "left_anti")
    known = checkpoint(first.withColumn("kept", F.lit(True)))
    while not held.isEmpty():
        told = held.join(known.select(F.col("id").alias("earlier"), "kept"), "earlier", "left")
        new = checkpoint(told.groupBy("block").applyInPandas(lambda block: _decided(block.sort_values(["_at", "later"])), f"id {kind}, kept boolean"))
        if new.isEmpty():
            raise ValueError("edges have to lead from earlier to later rows")
        known, held = known.unionByName(new), checkpoint(held.join(new.select(F.col("id").alias("later")), "later", "left_anti"))
    gone = known.filter("NOT kept").select("id")
    kept = rows.join(gone.withColumnRenamed("id", id_column), id_column, "left_anti")
    starts = rows.select(F.col(id_column).alias("earlier"), F.col(order).alias("_at"))
    log = edges.join(gone.withColumnRenamed("id", "later"), "later", "left_semi").join(gone.withColumnRenamed("id", "earlier"), "earlier", "left_anti").join(starts, "earlier")
    best_of = log.groupBy("later").agg(F.min_by(F.struct("earlier", "similarity"), F.struct("_at", "earlier")).alias("b"))
    return kept, best_of.select(F.col("b.earlier").alias("kept"), F.col("later").alias("removed"), F.col("b.similarity").alias("similarity"))


def best(rows: DataFrame, *, group: str | Sequence[str], score: str, order: str, limit: int, least: float | None = None, keep: dict[str, Sequence[str]] | None = None) -> DataFrame:
    """Filter by least score and allowed values, then the best ``limit`` of each group; ties by ``order``. Adds rank."""
    out = rows if least is None else rows.filter(F.col(score) >= least)
    for column, values in (keep or {}).items():
        out = out.filter(F.col(column).isin(*values))
    w = Window.partitionBy(*([group] if isinstance(group, str) else group)).orderBy(F.desc(score), order)
    return out.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= limit)


def rescored(moments: DataFrame, scores: DataFrame, *, id_column: str = "moment_id", group: str | None = None, initial: str = "viral_score", order: str = "pos") -> DataFrame:
    """External scores by id: initial_score, final_score and rank. Moments without one are dropped; without any score at all the initial ones rank.

    Without a group the rank is over all rows: these are dealt by score and order into ranges of about equal size, written to
    the shared folder, ranked within each, and each range goes on from the number of rows above it.
    """
    if scores.isEmpty():
        joined = moments.withColumn("final_score", F.col(initial))
    else:
        joined = moments.join(scores.select(id_column, "final_score"), id_column)
    joined = joined.withColumn("initial_score", F.col(initial))
    if group is not None:
        return joined.withColumn("rank", F.row_number().over(Window.partitionBy(group).orderBy(F.desc("final_score"), order)))
    # Ranges of score and order together, so that many rows of one score are several; their numbers are those of the written table.
    path, spark = new_folder(moments.sparkSession, "ranges"), moments.sparkSession
    joined.repartitionByRange(RANGES, F.desc("final_score"), F.col(order)).withColumn("_range", F.spark_partition_id()).write.parquet(path)
    ranged = spark.read.parquet(path)
    sizes = ranged.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))  # at most RANGES rows
    above = sizes.select("_range", F.coalesce(F.sum("_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_above"))
    own = F.row_number().over(Window.partitionBy("_range").orderBy(F.desc("final_score"), order))
    return ranged.join(F.broadcast(above), "_range").withColumn("rank", (own + F.col("_above")).cast("int")).drop("_range", "_above")


def final_cut(moments: DataFrame, *, score: str = "viral_score", order: str = "pos", above: float = 7.5, limit: int = 20) -> DataFrame:
    """The best of those above a score; a global top-k, which Spark takes per task first."""
    return moments.filter(F.col(score) > above).orderBy(F.desc(score), order).limit(limit)


def trending(moments: DataFrame, *, as_of: str, days: int = 7, score: str = "viral_score", created: str = "created_at", order: str, least: float = 7.0, limit: int = 10) -> DataFrame:
    """The best of a time frame that ends at ``as_of``."""
    at = F.lit(as_of).cast("timestamp")
    fresh = moments.filter((F.col(created).cast("timestamp") >= at - F.make_dt_interval(F.lit(days))) & (F.col(created).cast("timestamp") <= at) & (F.col(score) >= least))
    return fresh.orderBy(F.desc(score), order).limit(limit)


def newest(rows: DataFrame, *, day: str, order: str, limit: int) -> DataFrame:
    """Newest first, by date and not by its text."""
    return rows.orderBy(F.desc(day), order).limit(limit)


def page(rows: DataFrame, *, key: str, offset: int, limit: int) -> tuple[DataFrame, DataFrame]:
    """A page by offset, and (total, next_offset, progress in per cent)."""
    end = F.least(F.lit(offset + limit), F.col("total"))
    totals = rows.agg(F.count(F.lit(1)).alias("total")).select("total", F.when(F.lit(offset + limit) < F.col("total"), F.lit(offset + limit).cast("long")).alias("next_offset"), F.round(F.try_divide(end * 100.0, F.col("total")), 2).alias("progress"))
    return rows.orderBy(key).offset(offset).limit(limit), totals


def page_after(rows: DataFrame, *, key: str, after, limit: int) -> DataFrame:
    """D9 for deep pages: the rows after a key, without counting those before it."""
    return rows.filter(F.col(key) > F.lit(after)).orderBy(key).limit(limit)
