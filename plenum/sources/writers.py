"""Sinks (S9, S10, S12)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plenum.functions.text import hms_millis


def write_by_month(rows: DataFrame, path: str, *, day: str, mode: str = "overwrite") -> None:
    """Parquet by year and month of a date. Rows are first dealt by these, so that a month is not one file per task."""
    dated = rows.withColumns({"year": F.year(day), "month": F.month(day)})
    dated.repartition("year", "month", F.pmod(F.xxhash64(*rows.columns), F.lit(8))).write.mode(mode).partitionBy("year", "month").parquet(path)


def caption_text(cues: DataFrame, *, session: str, order: str = "seq", start: str = "t_start", end: str = "t_end", text: str = "text") -> DataFrame:
    """One caption text per session: (session, value)."""
    cue = F.concat(hms_millis(F.col(start)), F.lit(" --> "), hms_millis(F.col(end)), F.lit("\n"), F.col(text))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, cue.alias("cue")))), lambda x: x["cue"]), "\n\n")
    return cues.groupBy(session).agg(F.concat(F.lit("WEBVTT\n\n"), joined).alias("value"))


def write_captions(cues: DataFrame, path: str, *, session: str, **names) -> None:
    """A text file per session, in a folder of its own."""
    caption_text(cues, session=session, **names).write.mode("overwrite").partitionBy(session).text(path)


def session_documents(rows: DataFrame, *, session: str, order: str, columns: tuple[str, ...]) -> DataFrame:
    """Rows back to one JSON document per session: (session, document)."""
    held = F.array_sort(F.collect_list(F.struct(F.col(order).alias("_o"), F.struct(*columns).alias("s"))))
    return rows.groupBy(session).agg(F.to_json(F.transform(held, lambda x: x["s"])).alias("document"))
