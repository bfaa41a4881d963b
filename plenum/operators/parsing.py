"""Parsing jobs (P1-P6): nested documents to rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plenum.functions.text import is_clock_heading, strip_html


def speeches(sections: DataFrame, *, session: str, section: str, html: str = "html", heading: str = "h6", block: str = "p", mark: str = "strong") -> DataFrame:
    """(session, section, speech_no, speaker, clock, text).

    Blocks are taken in document order: a clock heading holds until the next, a block that begins with a marked name opens
    a speech, other blocks go on with it, and those before the first speech of a section are dropped. State is per section.
    """
    pattern = rf"(?is)<({heading}|{block})(?:\s[^>]*)?>(.*?)</\1>"
    name = rf"(?is)<{mark}(?:\s[^>]*)?>(.*?)</{mark}>"
    blocks = F.arrays_zip(F.regexp_extract_all(html, F.lit(pattern), F.lit(1)).alias("tag"), F.regexp_extract_all(html, F.lit(pattern), F.lit(2)).alias("inner"))
    rows = sections.select(session, section, F.posexplode(blocks).alias("pos", "b")).select(session, section, "pos", F.lower("b.tag").alias("tag"), F.col("b.inner").alias("inner"))
    plain = strip_html(F.col("inner"), " ")
    is_heading = F.col("tag") == heading.lower()
    speaker = F.when(~is_heading & F.col("inner").rlike(name), F.nullif(F.regexp_replace(strip_html(F.regexp_extract("inner", name, 1), " "), r"\s*:\s*$", ""), F.lit("")))
    w = Window.partitionBy(session, section).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    told = rows.select(session, section, "pos", "tag", plain.alias("plain"), speaker.alias("speaker"), F.when(is_heading & is_clock_heading(plain), plain).alias("clock"))
    placed = told.select("*", F.count("speaker").over(w).alias("speech_no"), F.last("clock", ignorenulls=True).over(w).alias("clock_now")).filter((F.col("tag") == block.lower()) & (F.col("speech_no") > 0) & (F.col("plain") != ""))
    grouped = placed.groupBy(session, section, "speech_no").agg(F.array_sort(F.collect_list(F.struct("pos", "plain", "speaker", "clock_now"))).alias("p"))
    return grouped.select(session, section, "speech_no", F.col("p")[0]["speaker"].alias("speaker"), F.col("p")[0]["clock_now"].alias("clock"), F.array_join(F.transform("p", lambda x: x["plain"]), " ").alias("text"))


def retrieval_segments(html: Column, *, mark: str = "strong", block: str = "p", least: int = 20, least_plain: int = 50) -> Column:
    """``array<struct<speaker,text>>`` of the speaker paragraphs of a section; without any, its whole text if long enough.

    A speaker paragraph begins with a marked name; a colon may follow the name within the mark or after it. What is left of
    the paragraph, without tags, is the text.
    """
    name = rf"(?is)^<{mark}>([^<]*)</{mark}>"
    inner = F.regexp_extract_all(html, F.lit(rf"(?is)<{block}(?:\s[^>]*)?>(.*?)(?:</{block}>|$)"), F.lit(1))

    def told(b: Column) -> Column:
        speaker = F.trim(F.regexp_replace(F.regexp_extract(b, name, 1), r":\s*$", ""))
        text = F.regexp_replace(F.regexp_replace(b, name, ""), r"^\s*:?\s*", "")
        return F.struct(speaker.alias("speaker"), strip_html(text).alias("text"))

    marked = F.transform(F.filter(inner, lambda b: b.rlike(name)), told)
    good = F.filter(marked, lambda s: (F.length(s["text"]) > least) & ~F.contains(s["speaker"], F.lit(":")) & (s["speaker"] != ""))
    plain = strip_html(html, " ")
    one = F.array(F.struct(F.lit(None).cast("string").alias("speaker"), plain.alias("text")))
    return F.when(F.size(good) > 0, good).when(F.length(plain) > least_plain, one).otherwise(F.array().cast("array<struct<speaker:string,text:string>>"))


def session_segments(sessions: DataFrame, *, session: str, sections: str = "takesSectionVOList") -> DataFrame:
    """P2 over sessions: sections and subsections in document order, with default titles and a running index."""
    title = lambda c, other: F.coalesce(F.nullif(c, F.lit("")), F.lit(other))
    own = F.transform(sections, lambda s: F.struct(title(s["title"], "Untitled Section").alias("section_title"), F.lit(None).cast("string").alias("subsection_title"), s["content"].alias("content")))
    below = F.transform(sections, lambda s: F.transform(F.coalesce(s["subsections"], F.array().cast("array<struct<title:string,content:string>>")), lambda x: F.struct(title(s["title"], "Untitled Section").alias("section_title"), title(x["title"], "Untitled Subsection").alias("subsection_title"), x["content"].alias("content"))))
    parts = F.flatten(F.zip_with(own, below, lambda a, b: F.concat(F.array(a), b)))
    rows = sessions.select(session, F.posexplode(parts).alias("_p", "x")).filter(F.length(F.trim("x.content")) > 0)
    told = rows.select(session, "_p", "x.section_title", "x.subsection_title", F.posexplode(retrieval_segments(F.col("x.content"))).alias("_q", "y"))
    index = F.row_number().over(Window.partitionBy(session).orderBy("_p", "_q")) - 1
    return told.select(session, index.alias("segment_index"), "section_title", "subsection_title", "y.speaker", "y.text")


def numbered(rows: DataFrame, *, session: str, order: tuple[str, ...], name: str = "segment_index") -> DataFrame:
    """A running index over a session's rows in document order, from 0."""
    return rows.withColumn(name, F.row_number().over(Window.partitionBy(session).orderBy(*order)) - 1)


def present_members(attendance: Column) -> Column:
    """Names of those present, in order."""
    return F.transform(F.filter(attendance, lambda a: F.coalesce(a["attendance"], F.lit(False))), lambda a: a["mpName"])


def repaired_json(content: Column, item_schema: str) -> Column:
    """P5: the array of a model's answer: fences go; a single object counts as one; an array cut off is closed after its last whole object; else empty.

    An answer is cut at its last ``}`` when the braces up to there balance.
    """
    bare = F.trim(F.regexp_replace(F.regexp_replace(content, r"(?s)^\s*```(?:json)?\s*", ""), r"(?s)\s*```\s*$", ""))
    kind = f"array<{item_schema}>"
    array = F.when(F.left(bare, F.lit(1)) == "{", F.concat(F.lit("["), bare, F.lit("]"))).otherwise(bare)
    head = F.regexp_extract(array, r"(?s)^(.*)\}", 1)
    balanced = F.regexp_count(head, F.lit(r"\{")) == F.regexp_count(head, F.lit(r"\}")) + 1
    whole = F.from_json(array, kind)
    cut = F.when(balanced, F.from_json(F.concat(head, F.lit("}]")), kind))
    # A last object that is cut within: everything up to the object before it.
    shorter = F.from_json(F.concat(F.regexp_extract(array, r"(?s)^(.*\})\s*,\s*\{", 1), F.lit("]")), kind)
    ok = lambda x: F.when(x.isNotNull() & (F.size(F.filter(x, lambda y: y.isNotNull())) > 0), x)
    return F.coalesce(ok(whole), ok(cut), ok(shorter), F.array().cast(kind))


def question_pairs(blocks: DataFrame, *, session: str, section: str, section_type: str = "section_type", written: tuple[str, ...] = ("WA", "WANA")) -> DataFrame:
    """Written answers as one row per question and answer, other sections whole: (session, section, part, chunk_id, speakers, first_page, last_page, text).

    ``blocks`` are P1's speeches with section_type and page; a speech that begins with a number and a name opens a pair.
    """
    w = Window.partitionBy(session, section).orderBy("speech_no").rowsBetween(Window.unboundedPreceding, 0)
    opens = F.col(section_type).isin(*written) & F.col("text").rlike(r"^\d+\.?\s")
    rows = blocks.withColumn("part", F.when(F.col(section_type).isin(*written), F.sum(opens.cast("int")).over(w)).otherwise(0))
    grouped = rows.groupBy(session, section, "part").agg(F.array_sort(F.collect_list(F.struct("speech_no", "speaker", "text"))).alias("p"), F.min("page").alias("first_page"), F.max("page").alias("last_page"))
    return grouped.select(session, section, "part", F.concat_ws("-", F.col(session).cast("string"), F.col(section).cast("string"), F.col("part").cast("string")).alias("chunk_id"), F.array_distinct(F.array_compact(F.transform("p", lambda x: x["speaker"]))).alias("speakers"), "first_page", "last_page", F.array_join(F.transform("p", lambda x: x["text"]), "\n").alias("text"))
