"""Stored tables with one row per key (I8, V7): upserts rewrite only the buckets of keys that they touch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plenum.operators.incremental import latest
from plenum.sources.readers import validate
from plenum.sources.shared import delete, exists

BUCKET = "key_bucket"
#: Ends the name of the column that holds the version of another column's value.
AT = "__version"
#: Files of a bucket, so that a task writes a part of it.
PARTS = 4


def _staged(path: str) -> str:
    return f"{path.rstrip('/')}_staged"


def _put_in_place(spark: SparkSession, path: str) -> None:
    """Puts the staged buckets in their places; done again after a failure it gives the same."""
    rows = spark.read.parquet(_staged(path))
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(BUCKET).parquet(path)
    delete(spark, _staged(path))


def _settled(spark: SparkSession, path: str) -> bool:
    """Whether the table exists; an upsert that was staged whole but not put in place is finished first."""
    if exists(spark, f"{_staged(path)}/_SUCCESS"):
        _put_in_place(spark, path)
    return exists(spark, path)


def stored(spark: SparkSession, path: str) -> DataFrame:
    """The table's rows, one per key."""
    _settled(spark, path)
    rows = spark.read.option("mergeSchema", True).parquet(path)
    return rows.drop(BUCKET, *(c for c in rows.columns if c.endswith(AT)))


def _merged(rows: DataFrame, *keys: str, version: str) -> DataFrame:
    """Of each column the value of its greatest version, with that version, whatever the order in which they came."""
    others = [c for c in rows.columns if c not in (*keys, version) and not c.endswith(AT)]
    values = [x for c in others for x in (F.max_by(c, c + AT).alias(c), F.max(c + AT).alias(c + AT))]
    return rows.groupBy(*keys).agg(F.max(version).alias(version), *values)


def upsert_stored(updates: DataFrame, path: str, *, key: str, version: str, buckets: int = 256, whole: bool = False) -> None:
    """I8: merges updates into the table at ``path``: of each column the latest value that is not null, or ``whole`` rows, latest wins.

    Updates may come in any order: columns keep the version of their value. Keys are dealt into ``buckets``, which a table keeps for good. The buckets that the updates touch are read, merged and
    staged beside the table, then put in place of the old ones; others are neither read nor written. A row of the same
    version as the stored one changes nothing or all of it at random: versions should differ. A null key is a key of its own.
    """
    spark = updates.sparkSession
    place = lambda df: df.withColumn(BUCKET, F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int"))
    placed = place(updates)
    if not whole:
        placed = placed.withColumns({c + AT: F.when(F.col(c).isNotNull(), F.col(version)) for c in updates.columns if c not in (key, version)})
    rows = placed
    if _settled(spark, path):
        touched = [r[0] for r in placed.select(BUCKET).distinct().collect()]  # at most ``buckets``
        before = spark.read.option("mergeSchema", True).parquet(path).filter(F.col(BUCKET).isin(touched))
        rows = before.unionByName(placed, allowMissingColumns=True)
    dealt = rows.withColumn("_part", F.pmod(F.xxhash64(key, F.lit(1)), F.lit(PARTS))).repartition(BUCKET, "_part")
    merged = latest(dealt, BUCKET, "_part", key, version=version, whole=True) if whole else _merged(dealt, BUCKET, "_part", key, version=version)
    merged.drop("_part").write.mode("overwrite").partitionBy(BUCKET).parquet(_staged(path))
    _put_in_place(spark, path)


def store_vectors(vectors: DataFrame, path: str, *, id_column: str, vector: str = "embedding", width: int, version: str, buckets: int = 256) -> DataFrame:
    """V7: upserts vectors by id, the latest version of each, and returns the rejects: other widths, missing components, no id."""
    holds_null = F.exists(vector, lambda x: x.isNull() | F.isnan(x))
    rules = {"no_id": F.col(id_column).isNull(), "no_vector": F.col(vector).isNull(), "width": F.size(vector) != width, "component": holds_null}
    good, rejects = validate(vectors, rules)
    upsert_stored(good, path, key=id_column, version=version, buckets=buckets, whole=True)
    return rejects
