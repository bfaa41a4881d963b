"""Session documents that arrive as files become segments, chunks and roll-ups, batch by batch.

Each batch writes its tables into folders of its own and then a row of the ledger. Readers see the batches that the ledger
holds, and of a session that came again the latest; so a batch that fails before its ledger row is invisible, and one that
runs again replaces its own rows. What the rules of session documents reject goes to a table of its own, with the reasons.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plenum.functions.text import count_words, transcript_id
from plenum.operators import aggregates as A
from plenum.operators import chunking as C
from plenum.operators import parsing as P
from plenum.operators.ranking import first_per_key
from plenum.sources import readers
from plenum.sources.shared import exists

#: What a batch writes besides its ledger row.
TABLES = ("segments", "chunks", "transcripts", "rejects")


def accepted(sessions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(good documents with their ``session`` id, rejects with reasons); of one session's documents that of the last file, then the greatest text, counts."""
    good, rejects = readers.validate(sessions, readers.session_rules())
    named = good.withColumn("session", transcript_id(F.col("session_date"), F.col("metadata.parlimentNO"), F.col("metadata.sessionNO")))
    body = F.to_json(F.struct("metadata", "takesSectionVOList", "attendanceList", "cleanedContent"))
    told = rejects.select("file", "session_date", F.col("metadata.sessionNO").alias("session_no"), "reasons", F.col("_corrupt_record").alias("text"))
    return first_per_key(named, F.col("session"), F.desc("file"), F.desc(body)), told


def sections_of(good: DataFrame) -> DataFrame:
    """(session, section_no, section_title, section_type, page, html), null sections left out."""
    rows = good.select("session", F.posexplode("takesSectionVOList").alias("section_no", "s")).filter("s IS NOT NULL")
    return rows.select("session", "section_no", F.col("s.title").alias("section_title"), F.col("s.sectionType").alias("section_type"), F.col("s.startPgNo").alias("page"), F.col("s.content").alias("html"))


def segments_of(sections: DataFrame) -> DataFrame:
    """Speeches of all sections, numbered over the session, with titles and word counts."""
    spoken = P.speeches(sections, session="session", section="section_no").join(sections.drop("html"), ["session", "section_no"])
    numbered = P.numbered(spoken, session="session", order=("section_no", "speech_no"))
    return numbered.select("session", "segment_index", "section_no", "section_title", "section_type", "page", "speaker", "clock", "text", count_words(F.col("text")).alias("word_count"))


def transcripts_of(good: DataFrame, sections: DataFrame, segments: DataFrame) -> DataFrame:
    """A1: one row per document, also of one without speeches; topics count sections without speech, members those present."""
    rolled = A.roll_up(segments, order="segment_index")
    topics = A.distinct_in_order(sections, group="session", value="section_title", order="section_no", name="topics")
    head = good.select("session", "session_date", F.col("metadata.sessionNO").alias("session_no"), P.present_members(F.coalesce("attendanceList", F.array().cast("array<struct<mpName:string,attendance:boolean>>"))).alias("members"))
    joined = head.join(rolled, "session", "left").join(topics, "session", "left")
    none = F.array().cast("array<string>")
    return joined.withColumns({"n_segments": F.coalesce("n_segments", F.lit(0)), "n_words": F.coalesce("n_words", F.lit(0)), "speakers": F.coalesce("speakers", none), "topics": F.coalesce("topics", none)})


def write_batch(batch: DataFrame, number: int, store: str, *, most: int = 500, overlap: int = 50) -> None:
    """The tables and then the ledger row of one batch of S1's documents; a batch that the ledger holds is left as it is."""
    spark = batch.sparkSession
    if exists(spark, f"{store}/ledger/batch={number}/_SUCCESS"):
        return
    batch = batch.persist()
    good, rejects = accepted(batch)
    sections = sections_of(good)

    def write(name: str, rows: DataFrame) -> DataFrame:
        path = f"{store}/{name}/batch={number}"
        rows.write.mode("overwrite").parquet(path)
        return spark.read.schema(rows.schema).parquet(path)

    rejects = write("rejects", rejects)
    segments = write("segments", segments_of(sections))
    write("chunks", C.by_tokens(segments, order="segment_index", most=most, overlap=overlap, carried=("section_title",)))
    transcripts = write("transcripts", transcripts_of(good, sections, segments))
    counts = transcripts.agg(F.count(F.lit(1)).alias("n_sessions"), F.coalesce(F.sum("n_segments"), F.lit(0)).alias("n_segments"))
    counts.crossJoin(rejects.agg(F.count(F.lit(1)).alias("n_rejects"))).write.mode("overwrite").parquet(f"{store}/ledger/batch={number}")
    batch.unpersist()


def ingest_sessions(spark: SparkSession, source: str, store: str, *, checkpoint: str, files: int = 10, multi_line: bool = True, every: str | None = None, **sizes: int):
    """A stream of session files into ``store``, ``files`` to a batch: all there are and then an end, or every so often (``60 seconds``)."""
    stream = readers.sessions(spark, source, multi_line=multi_line, files=files)
    writer = stream.writeStream.foreachBatch(lambda batch, number: write_batch(batch, number, store, **sizes)).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def stored(spark: SparkSession, store: str, name: str) -> DataFrame:
    """A table of the store: rows of finished batches, for each session those of its latest; ``ledger`` itself; all rejects."""
    ledger = spark.read.parquet(f"{store}/ledger")
    if name == "ledger":
        return ledger
    rows = spark.read.parquet(f"{store}/{name}").join(ledger.select("batch"), "batch", "left_semi")
    if name == "rejects":
        return rows
    latest = spark.read.parquet(f"{store}/transcripts").join(ledger.select("batch"), "batch", "left_semi").groupBy("session").agg(F.max("batch").alias("batch"))
    return rows.join(latest, ["session", "batch"], "left_semi")
