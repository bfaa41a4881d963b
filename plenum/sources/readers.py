"""Sources (S1, S4-S8, S11), validation (S2) and routing (S3)."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plenum import schemas
from plenum.functions.text import cue_seconds, id_date, parse_date


def sessions(spark: SparkSession, path: str, *, multi_line: bool = True, files: int | None = None) -> DataFrame:
    """Session documents; the date comes from the document, else from the file's name. Broken ones keep their text in ``_corrupt_record``.

    A file is one JSON document or a list of them, or without ``multi_line`` one document a line. With ``files`` it is a
    stream that takes so many files a batch.
    """
    reader = spark.read if files is None else spark.readStream.option("maxFilesPerTrigger", files)
    rows = reader.schema(schemas.RAW_SESSION + ", _corrupt_record STRING").option("multiLine", multi_line).option("mode", "PERMISSIVE").json(path)
    return rows.withColumns({"file": F.col("_metadata.file_path"), "session_date": F.coalesce(parse_date(F.col("metadata.sittingDate")), id_date(F.col("_metadata.file_path")))})


def validate(rows: DataFrame, rules: Mapping[str, Column]) -> tuple[DataFrame, DataFrame]:
    """(good rows, rejects with ``reasons``); a rule names what is wrong where its condition holds. An unknown (null) condition does not reject."""
    marked = rows.withColumn("reasons", F.array_compact(F.array(*(F.when(bad, F.lit(name)) for name, bad in rules.items()))))
    return marked.filter(F.size("reasons") == 0).drop("reasons"), marked.filter(F.size("reasons") > 0)


def session_rules() -> dict[str, Column]:
    """S2's rules of session documents."""
    return {"not_json": F.col("_corrupt_record").isNotNull(), "no_metadata": F.col("metadata").isNull() & F.col("format").isNull(), "no_date": F.col("session_date").isNull(), "no_sections": F.col("takesSectionVOList").isNull() & F.col("cleanedContent").isNull()}


def analysis_rules() -> dict[str, Column]:
    """S2's rules of model answers."""
    n = F.length("quote")
    return {"no_quote": F.col("quote").isNull(), "quote_length": ~n.between(15, 300), "no_speaker": F.col("speaker").isNull(), "score_range": F.col("ai_score").isNull() | ~F.col("ai_score").between(0, 10)}


def routed(rows: DataFrame) -> DataFrame:
    """S3: adds ``route``: structured, old (full text) or unknown."""
    return rows.withColumn("route", F.when(F.size("takesSectionVOList") > 0, "structured").when((F.col("format") == "old") | F.col("cleanedContent.fullText").isNotNull(), "old").otherwise("unknown"))


def captions(spark: SparkSession, path: str, *, multi_line: bool = True, strip_tags: bool = True, times: bool = True) -> DataFrame:
    """Caption files, one row per cue: (file, session_date, seq, t_start, t_end, text).

    ``multi_line``: all text lines of a cue, blank-joined, else the first; ``strip_tags``: inline tags and ``&gt;&gt;`` go.
    Cues without text are dropped. Without ``times`` cues are told apart by blank lines only.
    """
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), "value")
    return cues(files, multi_line=multi_line, strip_tags=strip_tags, times=times)


def cues(files: DataFrame, *, multi_line: bool = True, strip_tags: bool = True, times: bool = True) -> DataFrame:
    """S4 over a table (file, value)."""
    arrow = r"(?m)^\s*((?:\d+:)?\d{1,2}:\d{2}[.,]\d{1,3})\s*-->\s*((?:\d+:)?\d{1,2}:\d{2}[.,]\d{1,3})[^\n]*$"
    blocks = files.select("file", F.posexplode(F.split(F.regexp_replace("value", "\r", ""), r"\n\s*\n")).alias("_pos", "_b"))
    if times:
        blocks = blocks.filter(F.col("_b").rlike(arrow))
        body = F.regexp_replace("_b", r"(?s)^.*?-->[^\n]*\n?", "")
    else:
        body = F.col("_b")
    if strip_tags:
        body = F.regexp_replace(F.regexp_replace(F.regexp_replace(body, r"<[^>]+>", ""), "&gt;&gt;", ""), "&amp;", "&")
    lines = F.filter(F.transform(F.split(body, "\n"), lambda x: F.trim(x)), lambda x: x != "")
    text = F.array_join(lines, " ") if multi_line else F.coalesce(F.get(lines, F.lit(0)), F.lit(""))
    at = lambda i: cue_seconds(F.regexp_extract("_b", arrow, i)) if times else F.lit(None).cast("double")
    rows = blocks.select("file", "_pos", at(1).alias("t_start"), at(2).alias("t_end"), F.trim(F.regexp_replace(text, r"\s+", " ")).alias("text")).filter("text <> ''")
    from pyspark.sql import Window

    return rows.select("file", id_date(F.col("file")).alias("session_date"), (F.row_number().over(Window.partitionBy("file").orderBy("_pos")) - 1).alias("seq"), "t_start", "t_end", "text")


def caption_lists(spark: SparkSession, path: str) -> DataFrame:
    """JSON caption lists as segments, with default speaker and section."""
    rows = spark.read.schema(schemas.CAPTION_LIST).option("multiLine", True).json(path).select(F.col("_metadata.file_path").alias("file"), F.posexplode("segments").alias("segment_index", "s"))
    return rows.select("file", id_date(F.col("file")).alias("session_date"), "segment_index", F.format_string("seg-%05d", "segment_index").alias("segment_id"), F.lit("Unknown").alias("speaker"), F.lit("Parliamentary Session").alias("section_title"), F.col("s.start").alias("t_start"), F.col("s.end").alias("t_end"), F.trim("s.text").alias("text"))


def words(rows: DataFrame, *, key: str) -> DataFrame:
    """Word-timed transcripts, one row per word; a segment without words has none."""
    segments = rows.select(key, F.explode_outer("segments").alias("s"))
    return segments.select(key, F.col("s.id").alias("segment_id"), F.posexplode("s.words").alias("word_no", "w")).select(key, "segment_id", "word_no", F.trim("w.word").alias("word"), F.col("w.start").alias("t_start"), F.col("w.end").alias("t_end"), "w.probability")


def playlist(spark: SparkSession, path: str) -> DataFrame:
    """``id|title|...`` lines: (pos, video_id, title); other lines, deleted and private videos are skipped.

    The place within the file follows the reading of each file's lines in order: files are read whole.
    """
    files = spark.read.text(path, wholetext=True)
    lines = files.select(F.col("_metadata.file_path").alias("file"), F.posexplode(F.split("value", r"\r?\n")).alias("pos", "line"))
    parts = F.split("line", r"\|")
    good = (F.size(parts) >= 2) & parts[0].rlike(r"^[A-Za-z0-9_-]{11}$") & ~parts[1].rlike(r"^\[(?:Private|Deleted) video\]$")
    return lines.filter(good).select("file", "pos", parts[0].alias("video_id"), F.trim(parts[1]).alias("title"))


def date_list(spark: SparkSession, path: str) -> DataFrame:
    """Lists of dates with ``#`` comments."""
    return spark.read.text(path).select(F.trim(F.regexp_replace("value", "#.*", "")).alias("v")).filter("v <> ''").select(parse_date(F.col("v")).alias("date"))


def keyed_objects(text: Column, schema: str = schemas.VIDEO_MAP) -> Column:
    """The entries of a JSON object keyed by date."""
    return F.map_entries(F.from_json(text, schema))


def listing(spark: SparkSession, path: str, *, limit: int | None = None) -> DataFrame:
    """Stored objects: (key, size, uploaded, date), newest first if limited. Only file metadata is read."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select(F.col("path").alias("key"), F.col("length").alias("size"), F.col("modificationTime").alias("uploaded"), id_date(F.col("path")).alias("date"))
    return rows if limit is None else rows.orderBy(F.desc("uploaded"), "key").limit(limit)
