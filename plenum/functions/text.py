"""Column functions on dates, clocks and text (T1-T21). All are native expressions: ``Column`` in, ``Column`` out."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The six entities that transcripts use.
ENTITIES = (("&nbsp;", " "), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"))
#: Limits of posts by platform (body, and title where the platform has one).
POST_LIMITS = {"tiktok": (2200, None), "instagram": (2200, None), "youtube": (5000, 100)}
#: Words that name parliamentary recordings.
PARLIAMENT_WORDS = ("parliament", "parliamentary", "sitting", "session", "debate", "minister", "mp", "question", "bill", "motion", "singapore")


def parse_date(c: Column) -> Column:
    """Day-month-year or year-month-day with one- or two-digit parts; null if neither."""
    return F.coalesce(F.try_to_date(c, "d-M-yyyy"), F.try_to_date(c, "yyyy-M-d"))


def parse_sitting_date(c: Column) -> Column:
    """Strict day-month-year from the year 2000 on, with its display form; null parts if out of range."""
    d = F.try_to_date(c, "d-M-yyyy")
    d = F.when(F.year(d) >= 2000, d)
    return F.struct(d.alias("date"), F.date_format(d, "d MMMM yyyy").alias("formatted"))


def date_key(d: Column) -> Column:
    """The key form of a date."""
    return F.date_format(d, "dd-MM-yyyy")


def date_variants(d: Column) -> Column:
    """Five ways in which titles write a date."""
    return F.array(*(F.date_format(d, p) for p in ("d MMMM yyyy", "d MMM yyyy", "dd-MM-yyyy", "dd/MM/yyyy", "yyyy-MM-dd")))


def title_date(title: Column) -> Column:
    """T4: the first ``18 February 2025`` of a title."""
    return F.try_to_date(F.nullif(F.regexp_extract(title, r"(\d{1,2} [A-Za-z]+ \d{4})", 1), F.lit("")), "d MMMM yyyy")


def id_date(name: Column) -> Column:
    """T5: the date within an id or file name."""
    return F.try_to_date(F.nullif(F.regexp_extract(name, r"(\d{2}-\d{2}-\d{4})", 1), F.lit("")), "dd-MM-yyyy")


def transcript_id(d: Column, parliament: Column | None = None, session: Column | None = None) -> Column:
    """``YYYY-MM-DD`` with parliament and session where known."""
    parts = [F.date_format(d, "yyyy-MM-dd")]
    if parliament is not None:
        parts.append(F.concat(F.lit("parliament-"), parliament.cast("string")))
    if session is not None:
        parts.append(F.concat(F.lit("session-"), session.cast("string")))
    return F.concat_ws("-", *parts)


def numbered_id(owner: Column, number: Column, mark: str = "-", digits: int = 0) -> Column:
    """An owner's id and a running number, padded if wished."""
    n = number.cast("string")
    return F.concat(owner.cast("string"), F.lit(mark), F.lpad(n, digits, "0") if digits else n)


def video_url(video_id: Column, seconds: Column | None = None, base: str = "https://www.youtube.com/watch?v=") -> Column:
    """A video's address, from whole seconds on; the start is left out at zero or if unknown."""
    url = F.concat(F.lit(base), video_id)
    if seconds is None:
        return url
    at = F.floor(seconds)
    return F.when(at > 0, F.concat(url, F.lit("&t="), at.cast("string"), F.lit("s"))).otherwise(url)


def iso_duration(c: Column) -> Column:
    """Seconds of ``PT1H2M3S``; 0 if it is none."""
    part = lambda unit: F.coalesce(F.nullif(F.regexp_extract(c, rf"^PT(?:\d+[HMS])*?(\d+){unit}", 1), F.lit("")).cast("long"), F.lit(0))
    return F.when(c.rlike(r"^PT(?:\d+H)?(?:\d+M)?(?:\d+S)?$"), part("H") * 3600 + part("M") * 60 + part("S")).otherwise(F.lit(0).cast("long"))


def clock_seconds(c: Column) -> Column:
    """Seconds of ``2:30 PM`` or ``14:30``, ``.`` or ``:`` between; null if it is no clock."""
    pattern = r"(?i)^\s*(\d{1,2})[:.](\d{2})\s*(am|pm|noon)?\s*$"
    part = lambda i: F.regexp_extract(c, pattern, i)
    hour, half = part(1).cast("long"), F.lower(part(3))
    hour = F.when((half == "pm") & (hour < 12), hour + 12).when((half == "am") & (hour == 12), 0).otherwise(hour)
    return F.when(c.rlike(pattern), hour * 3600 + part(2).cast("long") * 60)


def is_clock_heading(c: Column) -> Column:
    """Whether a heading is a clock (``1.30 pm``, ``12.00 noon``)."""
    return c.rlike(r"(?i)^\s*\d{1,2}[.:]\d{2}\s*(?:am|pm|noon)\s*$")


def cue_seconds(c: Column) -> Column:
    """Seconds of ``[HH:]MM:SS[.mmm]``."""
    parts = F.split(F.replace(c, F.lit(","), F.lit(".")), ":")
    value = F.aggregate(parts, F.lit(0.0), lambda s, x: s * 60 + x.try_cast("double"))
    return F.when(F.size(parts).between(2, 3), value)


def hms(seconds: Column) -> Column:
    """``HH:MM:SS``, not wrapped at a day."""
    s = F.floor(seconds)
    hours = F.floor(s / 3600)
    return F.concat_ws(":", F.concat(F.when(hours < 10, "0").otherwise(""), hours.cast("string")), F.lpad((F.floor(s / 60) % 60).cast("string"), 2, "0"), F.lpad((s % 60).cast("string"), 2, "0"))


def hms_millis(seconds: Column) -> Column:
    """``HH:MM:SS.mmm``, rounded to the millisecond."""
    ms = F.round(seconds * 1000).cast("long")
    return F.concat(hms(F.floor(ms / 1000)), F.lit("."), F.lpad((ms % 1000).cast("string"), 3, "0"))


def short_clock(seconds: Column) -> Column:
    """``H:MM:SS``, or ``M:SS`` under an hour."""
    s = F.floor(seconds)
    two = lambda x: F.lpad(x.cast("string"), 2, "0")
    return F.when(s >= 3600, F.concat_ws(":", F.floor(s / 3600).cast("string"), two(F.floor(s / 60) % 60), two(s % 60))).otherwise(F.concat_ws(":", F.floor(s / 60).cast("string"), two(s % 60)))


def strip_html(c: Column, tag_to: str = "") -> Column:
    """Tags go (to nothing, or to a blank), six entities are decoded, white space collapses."""
    out = F.regexp_replace(c, r"<[^>]*>", tag_to)
    for name, to in ENTITIES:
        out = F.replace(out, F.lit(name), F.lit(to))
    return F.trim(F.regexp_replace(out, r"(?U)\s+", " "))


def match_form(c: Column) -> Column:
    """Lower case, what is no ASCII word character or blank to a blank, blanks collapsed."""
    return F.trim(F.regexp_replace(F.lower(c), r"[^a-z0-9_]+", " "))


def quote_key(c: Column) -> Column:
    """The key of exact quote dedup."""
    return F.trim(F.lower(c))


def count_words(c: Column) -> Column:
    """Non-empty pieces between white space."""
    return F.size(F.filter(F.split(c, r"(?U)\s+"), lambda w: w != "")).cast("long")


def count_pieces(c: Column) -> Column:
    """Pieces of a plain split, 1 for an empty text."""
    return F.size(F.split(c, r"(?U)\s+", -1)).cast("long")


def estimate_tokens(c: Column) -> Column:
    """A quarter of the characters, rounded up."""
    return F.ceil(F.length(c) / 4)


def contains_any(c: Column, lexicon: Sequence[str]) -> Column:
    """Whether the lower-cased text contains any term. One test per term, in generated code."""
    low, found = F.lower(c), F.lit(False)
    for term in lexicon:
        found = found | F.contains(low, F.lit(term.lower()))
    return found


def titled_names(c: Column) -> Column:
    """Titled person names, distinct, in the order of their first place."""
    return F.array_distinct(F.regexp_extract_all(c, F.lit(r"((?:Mr|Ms|Mrs|Dr|Prof)\s+[A-Z][a-z]+(?:\s+[A-Z][a-z]+)*)"), F.lit(1)))


def chapter_lines(description: Column) -> Column:
    """``array<struct<seconds,label,raw>>`` of the chapter lines of a description; blank labels are dropped."""
    raw = F.filter(F.split(description, r"\r?\n"), lambda s: s.rlike(r"^\s*\[?\d{1,2}:\d{2}(?::\d{2})?\]?"))
    rows = F.transform(raw, lambda s: F.struct(cue_seconds(F.regexp_extract(s, r"(\d{1,2}:\d{2}(?::\d{2})?)", 1)).alias("seconds"), F.trim(F.regexp_replace(s, r"^\s*\[?\d{1,2}:\d{2}(?::\d{2})?\]?\s*[-–:]?\s*", "")).alias("label"), s.alias("raw")))
    return F.filter(rows, lambda x: x["label"] != "")


def cut_text(c: Column, most: int, mark: str = "...") -> Column:
    """At most ``most`` characters, the mark counted."""
    return F.when(F.length(c) > most, F.concat(F.left(c, F.lit(most - len(mark))), F.lit(mark))).otherwise(c)


def post_text(title: Column, body: Column, tags: Column, platform: str) -> Column:
    """Title, body and hash tags within the platform's limit."""
    text = F.concat_ws("\n\n", title, body, F.nullif(F.array_join(F.transform(tags, lambda t: F.concat(F.lit("#"), F.regexp_replace(t, r"\s+", ""))), " "), F.lit("")))
    return cut_text(text, POST_LIMITS[platform][0])


def speech_safe(c: Column) -> Column:
    """Without emoji and markdown marks."""
    out = F.regexp_replace(c, r"[\x{1F300}-\x{1FAFF}\x{2600}-\x{27BF}\x{FE0F}]", "")
    return F.trim(F.regexp_replace(F.regexp_replace(out, r"[*_`#~]", ""), r"\s+", " "))


def spoken_seconds(script: Column, words_per_second: Column) -> Column:
    """Words over the rate, with pauses for emoji (.3), exclamations (.2), questions (.2) and ellipses (.5), rounded."""
    count = lambda pattern: F.regexp_count(script, F.lit(pattern))
    pauses = count(r"[\x{1F300}-\x{1F9FF}]") * 0.3 + count("!") * 0.2 + count(r"\?") * 0.2 + count(r"\.\.\.") * 0.5
    return F.floor(count_pieces(script) / words_per_second + pauses + 0.5).cast("long")


def plain_seconds(script: Column, words_per_minute: float = 150.0, speed: float = 1.0) -> Column:
    """The plain variant."""
    return F.ceil(count_words(script) / F.lit(words_per_minute) * 60 / F.lit(speed))


def cut_quote(c: Column, most: int = 200) -> Column:
    """The first characters; the mark follows only a longer text."""
    return F.when(F.length(c) > most, F.concat(F.left(c, F.lit(most)), F.lit("..."))).otherwise(c)
