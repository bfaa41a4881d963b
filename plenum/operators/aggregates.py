"""Aggregations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plenum.functions.text import count_words


def distinct_in_order(rows: DataFrame, *, group: str, value: str, order: str, name: str) -> DataFrame:
    """(group, name): distinct values of a group in the order of their first place; nulls and empty ones left out."""
    firsts = rows.filter(F.col(value).isNotNull() & (F.col(value).cast("string") != "")).groupBy(group, value).agg(F.min(order).alias("_at"))
    return firsts.groupBy(group).agg(F.transform(F.array_sort(F.collect_list(F.struct("_at", value))), lambda x: x[value]).alias(name))


def roll_up(segments: DataFrame, *, session: str = "session", order: str = "ord", speaker: str = "speaker", text: str = "text", topic: str | None = None) -> DataFrame:
    """A1: one row per session: segments, words, speakers (and topics) in first-seen order."""
    out = segments.groupBy(session).agg(F.count(F.lit(1)).alias("n_segments"), F.sum(count_words(F.col(text))).alias("n_words"))
    for value, name in ((speaker, "speakers"), (topic, "topics")):
        if value:
            out = out.join(distinct_in_order(segments, group=session, value=value, order=order, name=name), session, "left")
    return out


def extraction_stats(moments: DataFrame, *, score: str = "viral_score", by: tuple[str, ...] = ("topic", "speaker", "emotional_tone")) -> DataFrame:
    """A2 in long form: (kind, key, n, mean_score): a row for all, and one per value of each column."""
    return merged_stats(partial_stats(moments, score=score, by=by))


def partial_stats(moments: DataFrame, *, chunk: str | None = None, score: str = "viral_score", by: tuple[str, ...] = ("topic", "speaker", "emotional_tone")) -> DataFrame:
    """A2's state, of each ``chunk`` or of all: (kind, key, n, n_scored, total). A chunk writes its rows when it is done; they merge in any order and number.

    ``n`` counts moments, ``n_scored`` those with a score, ``total`` adds these up. A value that is null has no row.
    """
    keys = F.array(F.struct(F.lit("all").alias("kind"), F.lit("").alias("key")), *(F.struct(F.lit(c).alias("kind"), F.col(c).cast("string").alias("key")) for c in by))
    of = [chunk] if chunk else []
    long = moments.select(*of, F.explode(keys).alias("k"), F.col(score).cast("double").alias("_s")).select(*of, "k.*", "_s").filter("key IS NOT NULL")
    return long.groupBy(*of, "kind", "key").agg(F.count(F.lit(1)).alias("n"), F.count("_s").alias("n_scored"), F.coalesce(F.sum("_s"), F.lit(0.0)).alias("total"))


def merged_states(states: DataFrame) -> DataFrame:
    """A2: states of several chunks, or of merged ones, as one."""
    return states.groupBy("kind", "key").agg(*(F.sum(c).alias(c) for c in ("n", "n_scored", "total")))


def merged_stats(states: DataFrame) -> DataFrame:
    """A2: the statistics of states: (kind, key, n, mean_score), the mean 0 where nothing has a score."""
    return merged_states(states).select("kind", "key", "n", F.coalesce(F.try_divide("total", "n_scored"), F.lit(0.0)).alias("mean_score"))


def consolidation_stats(candidates: DataFrame, *, stage: str = "stage") -> DataFrame:
    """A3: one row over candidates tagged with the stage that removed them (``exact``, ``semantic``) or ``final``."""
    s, final = F.col(stage), F.when(F.col(stage) == "final", F.lit(True))
    return candidates.agg(
        F.count(F.lit(1)).alias("candidates"), F.count_if(s == "exact").alias("removed_exact"), F.count_if(s == "semantic").alias("removed_semantic"), F.count(final).alias("n_final"),
        F.coalesce(F.avg(F.when(final, F.col("initial_score"))), F.lit(0.0)).alias("mean_initial"), F.coalesce(F.avg(F.when(final, F.col("final_score"))), F.lit(0.0)).alias("mean_final"), F.max(F.when(final, F.col("final_score"))).alias("top_score"))


def chunk_summary(chunks: DataFrame, moments: DataFrame, *, chunk: str = "chunk_id", start: str = "start_time", end: str = "end_time") -> DataFrame:
    """A4: per chunk its duration, captions, moments extracted and whether it overlaps the next."""
    counts = moments.groupBy(chunk).agg(F.count(F.lit(1)).alias("n_moments"))
    return chunks.join(counts, chunk, "left").select(chunk, (F.col(end) - F.col(start)).alias("duration"), "caption_count", F.coalesce("n_moments", F.lit(0)).alias("n_moments"), F.col("overlap_start").isNotNull().alias("has_overlap"))


def match_rate(rows: DataFrame, *, group: str, matched: Column, category: Column) -> DataFrame:
    """A5: rows, matches, their rate (null without rows) and the rows of a category."""
    return rows.groupBy(group).agg(F.count(F.lit(1)).alias("n"), F.count_if(matched).alias("n_matched"), F.count_if(category).alias("n_category")).withColumn("rate", F.try_divide("n_matched", "n"))


def compare_runs(runs: DataFrame, *, model: str = "model", session: str = "session") -> DataFrame:
    """Per session first, then per model: sessions, successes, moments, cost, mean latency, match rate."""
    per = runs.groupBy(model, session).agg(F.max("ok").alias("ok"), F.sum("n_moments").alias("m"), F.sum("cost").alias("c"), F.avg("latency").alias("l"), F.sum("n_matched").alias("x"))
    return per.groupBy(model).agg(F.count(F.lit(1)).alias("n_sessions"), F.count_if("ok").alias("n_ok"), F.sum("m").alias("n_moments"), F.sum("c").alias("cost"), F.avg("l").alias("mean_latency"), F.try_divide(F.sum("x"), F.sum("m")).alias("match_rate"))


def per_year(sessions: DataFrame, *, day: str, done: Column) -> DataFrame:
    """Sessions per year, those done, and the latest."""
    return sessions.groupBy(F.year(day).cast("long").alias("year")).agg(F.count(F.lit(1)).alias("n"), F.count_if(done).alias("n_done"), F.max(day).alias("latest"))


def outcomes(rows: DataFrame, *, batch: str, ok: Column, error: Column, order: str) -> DataFrame:
    """Per batch the successes, failures and the errors in order."""
    return rows.groupBy(batch).agg(F.count_if(ok).alias("n_ok"), F.count_if(~ok).alias("n_failed"), F.transform(F.array_sort(F.collect_list(F.when(~ok, F.struct(F.col(order).alias("o"), error.alias("e"))))), lambda x: x["e"]).alias("errors"))


def retention_report(objects: DataFrame, *, prefix: str, before: Column) -> DataFrame:
    """Objects under a prefix that are older than a time: how many, and megabytes. A report; nothing is deleted."""
    old = objects.filter(F.col("key").startswith(prefix) & (F.col("uploaded") < before))
    return old.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes")).select("n", (F.col("bytes") / 1048576).alias("mb"))


def coverage(rows: DataFrame, **flags: Column) -> DataFrame:
    """A10: per cent of rows with each flag; null without rows."""
    return rows.agg(*(F.round(F.avg(f.cast("double")) * 100, 4).alias(name) for name, f in flags.items()))


def timeline(moments: DataFrame, video: Column, *, at: str, order: str) -> DataFrame:
    """The moments of a video by time."""
    return moments.filter(video).orderBy(at, order)
