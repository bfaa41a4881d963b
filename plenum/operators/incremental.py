"""Set logic, incremental work and state (I1-I13). Times are parameters (``as_of``), never the clock."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def calendar(spark: SparkSession, first: str, last: str) -> DataFrame:
    """Every day from first to last."""
    return spark.range(1).select(F.explode(F.sequence(F.lit(first).cast("date"), F.lit(last).cast("date"))).alias("date"))


def work_list(days: DataFrame, stored: DataFrame, checks: DataFrame, *, as_of: str, recheck_days: int = 14) -> DataFrame:
    """Days not stored and not checked, and days found without a session at most ``recheck_days`` ago: (date, reason)."""
    open_days = days.join(stored.select("date").distinct(), "date", "left_anti")
    joined = open_days.join(checks.select("date", "status").dropDuplicates(["date"]), "date", "left")
    recent = F.datediff(F.lit(as_of).cast("date"), F.col("date")) <= recheck_days
    reason = F.when(F.col("status").isNull(), "new").when((F.col("status") == "no_session") & recent, "recheck")
    return joined.select("date", reason.alias("reason")).filter("reason IS NOT NULL")


def since_latest(spark: SparkSession, stored: DataFrame, *, as_of: str, otherwise_days: int = 7) -> DataFrame:
    """Days after the latest stored one (or the last few, if none) to ``as_of``."""
    end = F.lit(as_of).cast("date")
    first = stored.agg(F.coalesce(F.date_add(F.max("date"), 1), F.date_sub(end, otherwise_days)).alias("first"))
    return first.filter(F.col("first") <= end).select(F.explode(F.sequence("first", end)).alias("date"))


def backfill(days: DataFrame, stored: DataFrame) -> DataFrame:
    """I4: every day with whether a session is stored."""
    joined = days.join(stored.select("date").distinct().withColumn("_s", F.lit(True)), "date", "left")
    return joined.select("date", F.when(F.col("_s"), "has_session").otherwise("no_session").alias("status"))


def unprocessed(rows: DataFrame, ledger: DataFrame, key: str | Sequence[str], *, force: bool = False) -> DataFrame:
    """Rows whose key the ledger does not hold; all of them if forced."""
    return rows if force else rows.join(ledger.select(key), key, "left_anti")


def processing_status(wanted: DataFrame, ledger: DataFrame, found: DataFrame, *, key: str, error: str = "error", n: str = "n_segments") -> DataFrame:
    """What became of each wanted session: already, not_found, no_content, error or embedded."""
    joined = wanted.select(key).join(ledger.select(key).distinct().withColumn("_done", F.lit(True)), key, "left").join(found.select(key, n, error, F.lit(True).alias("_found")), key, "left")
    status = F.when(F.col("_done"), "already").when(F.col("_found").isNull(), "not_found").when(F.col(error).isNotNull(), "error").when(F.col(n) == 0, "no_content").otherwise("embedded")
    return joined.select(key, status.alias("status"))


def in_dates(rows: DataFrame, *, day: str, first: str | None = None, last: str | None = None, ids: Sequence | None = None, id_column: str | None = None) -> DataFrame:
    """Rows of a range of dates (both ends in) and of some ids."""
    out = rows
    if first:
        out = out.filter(F.col(day) >= F.lit(first).cast("date"))
    if last:
        out = out.filter(F.col(day) < F.date_add(F.lit(last).cast("date"), 1))
    return out.filter(F.col(id_column).isin(*ids)) if ids is not None else out


def key_overlap(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Keys on the left, on the right, on both, and by how many per cent the left shrinks to them."""
    a, b = left.select(key).distinct().withColumn("_a", F.lit(1)), right.select(key).distinct().withColumn("_b", F.lit(1))
    both = a.join(b, key, "full")
    counts = both.agg(F.count("_a").alias("n_left"), F.count("_b").alias("n_right"), F.count_if(F.col("_a").isNotNull() & F.col("_b").isNotNull()).alias("n_both"))
    return counts.withColumn("reduction", F.round((1 - F.try_divide(F.col("n_both"), F.col("n_left"))) * 100, 4))


def upsert(stored: DataFrame, updates: DataFrame, *, key: str, version: str) -> DataFrame:
    """I8: one row per key; of each column the latest value that is not null, so that partial updates merge."""
    return latest(stored.unionByName(updates, allowMissingColumns=True), key, version=version)


def latest(rows: DataFrame, *keys: str, version: str, whole: bool = False) -> DataFrame:
    """I8 over all versions of rows: the latest values of each column that are not null, or the latest row as it is."""
    others = [c for c in rows.columns if c not in (*keys, version)]
    if whole:
        return rows.groupBy(*keys).agg(F.max_by(F.struct(version, *others), version).alias("_r")).select(*keys, "_r.*")
    values = [F.max_by(c, F.when(F.col(c).isNotNull(), F.col(version))).alias(c) for c in others]
    return rows.groupBy(*keys).agg(F.max(version).alias(version), *values)


def insert_new(stored: DataFrame, found: DataFrame, key: str) -> DataFrame:
    """Stored rows and those found whose key is new."""
    return stored.unionByName(found.join(stored.select(key), key, "left_anti").dropDuplicates([key]), allowMissingColumns=True)


def mark_linked(sessions: DataFrame, videos: DataFrame, *, key: str, video: str = "video_id") -> DataFrame:
    """Sessions with the video newly found for them, where they had none."""
    new = videos.groupBy(key).agg(F.min(video).alias("_new"))
    return sessions.join(new, key, "left").withColumn(video, F.coalesce(video, "_new")).drop("_new")


def pending(rows: DataFrame, waiting: Column, *, order: Sequence[Column], limit: int) -> DataFrame:
    """What waits, first things first."""
    return rows.filter(waiting).orderBy(*order).limit(limit)


def retried(jobs: DataFrame, *, most: int = 3) -> DataFrame:
    """Failed jobs under the retry limit go back to the queue with one more retry."""
    again = (F.col("status") == "failed") & (F.col("retry_count") < most)
    return jobs.withColumns({"retry_count": F.when(again, F.col("retry_count") + 1).otherwise(F.col("retry_count")), "status": F.when(again, F.lit("pending")).otherwise(F.col("status"))})


def from_sources(**sources: DataFrame) -> DataFrame:
    """Rows of several sources, with the source's name; columns that one lacks are null."""
    out = None
    for name, rows in sources.items():
        part = rows.withColumn("origin", F.lit(name))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out


def fresh(rows: DataFrame, *, at: str, as_of: str, seconds: int) -> DataFrame:
    """Rows no older than so many seconds at a time."""
    age = F.unix_timestamp(F.lit(as_of).cast("timestamp")) - F.unix_timestamp(F.col(at).cast("timestamp"))
    return rows.filter((age >= 0) & (age <= seconds))


def fan_out(items: DataFrame, values: Sequence[str], name: str, *, at: str | None = None, as_of: str | None = None) -> DataFrame:
    """One row per item and value; with a time, whether it is due or scheduled."""
    rows = items.withColumn(name, F.explode(F.array(*map(F.lit, values))))
    if at is None:
        return rows
    return rows.withColumn("state", F.when(F.col(at).cast("timestamp") > F.lit(as_of).cast("timestamp"), "scheduled").otherwise("due"))
