"""Reading of the given tables, and tables that an operator writes on its way."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from plenum.sources.shared import new_folder

FILTER_BITS = 25

_scopes: list[list[Scratch]] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


class Scratch:
    """Tables of one run of an operator, in a folder of their own within the shared folder.

    A table that is written and read again cuts lineage and survives lost executors. ``drop`` deletes those that are done
    with; the ones that the operator's result reads stay until ``scope`` ends or the folder is cleared.
    """

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.folder, self.written = spark, new_folder(spark, "scratch"), {}
        for scope in _scopes[-1:]:
            scope.append(self)

    def cut(self, df: DataFrame) -> DataFrame:
        """``df`` written to the folder and read from there from now on."""
        return self.counted(df)[0]

    def counted(self, df: DataFrame, **sums: Column) -> tuple[DataFrame, dict]:
        """As ``cut``, with aggregates of its rows that are gathered while they are written."""
        path, seen = f"{self.folder}/{uuid.uuid4().hex}", Observation()
        (df.observe(seen, *(c.alias(k) for k, c in sums.items())) if sums else df).write.parquet(path)
        back = self.spark.read.schema(df.schema).parquet(path)
        self.written[id(back)] = (back, path)
        return back, seen.get if sums else {}

    def drop(self, *tables: DataFrame) -> None:
        for t in tables:
            delete(self.spark, self.written.pop(id(t))[1])

    def clear(self) -> None:
        self.written = {}
        delete(self.spark, self.folder)


def delete(spark: SparkSession, path: str) -> None:
    """Deletes a folder that an operator or the pipeline wrote."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


@contextmanager
def scope() -> Iterator[None]:
    """What operators write within it is deleted at its end; results have to be written by then."""
    _scopes.append([])
    try:
        yield
    finally:
        for scratch in _scopes.pop():
            scratch.clear()


def slot_of(column: str, bits: int = FILTER_BITS) -> Column:
    return F.shiftrightunsigned(F.xxhash64(column), 64 - bits)


def bit_set(slots: DataFrame, bits: int = FILTER_BITS) -> np.ndarray:
    """The bit set of a column ``slot`` of numbers below ``2 ** bits``: 64-bit words, of a fixed size whatever the rows.

    Words are put together in the cluster; the driver gets at most ``2 ** (bits - 6)`` of them, as one Arrow table.
    """
    words = slots.groupBy(F.shiftright("slot", 6).alias("part")).agg(F.bit_or(F.expr("shiftleft(1L, cast(slot % 64 as int))")).alias("word")).toArrow()
    out = np.zeros(1 << (bits - 6), np.int64)
    out[words["part"].to_numpy()] = words["word"].to_numpy()
    return out.view(np.uint64)


def held(bits: np.ndarray, slots: np.ndarray) -> np.ndarray:
    """Which slots a bit set holds."""
    return (bits[slots >> 6] >> (slots & 63).astype(np.uint64)) & np.uint64(1) > 0
