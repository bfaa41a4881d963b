"""Chunkers (C1-C14): a session's ordered rows to bounded pieces.

Greedy packing depends on order, so each session is folded once, over its sorted array of lengths only: the fold's state
is a pair of numbers and the places where chunks begin, which grow by one for each chunk. Texts are put together
afterwards, by chunk.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plenum.functions.text import estimate_tokens


def _fold(rows: DataFrame, session: str, order: str, size: Column, state: str, flush: str, after: str, more: str) -> DataFrame:
    """(session, order, size, chunk): ``flush`` tells whether a row of size x.size opens a chunk when ``s.size`` is held; ``after`` and ``more`` are the held size then and otherwise.

    A row's chunk is the number of chunks opened at or before its place; the rows between two such places are cut out of the
    sorted array as one slice.
    """
    sized = rows.select(session, order, size.cast("long").alias("size"))
    held = sized.groupBy(session).agg(F.sort_array(F.collect_list(F.struct(order, "size"))).alias("rows"))
    fold = f"""aggregate(rows, named_struct('size', {state}, 'at', 0, 'opened', cast(array() as array<int>)),
        (s, x) -> named_struct('size', CASE WHEN {flush} THEN {after} ELSE {more} END, 'at', s.at + 1,
            'opened', CASE WHEN {flush} THEN array_append(s.opened, s.at) ELSE s.opened END), s -> s.opened)"""
    bounds = held.select(session, "rows", F.concat(F.array(F.lit(0)), F.expr(fold), F.array(F.size("rows"))).alias("bounds"))
    parts = F.transform(F.slice("bounds", F.lit(1), F.size("bounds") - 1), lambda b, k: F.slice("rows", b + 1, F.element_at("bounds", k + 2) - b))
    chunks = bounds.select(session, F.posexplode(parts).alias("chunk", "part"))
    return chunks.select(session, F.col("chunk").cast("long").alias("chunk"), F.explode("part").alias("x")).select(session, F.col(f"x.{order}").alias(order), "x.size", "chunk")


def by_tokens(segments: DataFrame, *, session: str = "session", order: str = "ord", speaker: str = "speaker", text: str = "text", most: int = 500, overlap: int = 50, carried: Sequence[str] = ()) -> DataFrame:
    """Chunks of about ``most`` tokens, each begun with the last ``4 * overlap`` characters of the one before it.

    One row per chunk: session, chunk_index, text, speaker, n_segments and the ``carried`` columns (section and subsection
    titles); speaker and these are the last known ones, empty strings counting as unknown. A segment is never split, so a
    chunk passes its budget only by one segment; null speakers are left out of the text and carried from before.
    """
    labels = {f"label_{i}": F.nullif(F.col(c).cast("string"), F.lit("")) for i, c in enumerate((speaker, *carried))}
    told = F.concat(F.when(labels["label_0"].isNotNull(), F.concat(F.col(speaker), F.lit(": "))).otherwise(""), F.coalesce(text, F.lit("")))
    rows = segments.select(session, order, told.alias("told"), *(c.alias(n) for n, c in labels.items()))
    tail = 4 * overlap
    flush = f"ceil(s.size / 4) + ceil(x.size / 4) > {most} AND s.size > 0"
    chunks = _fold(rows, session, order, F.length("told"), "0L", flush, f"least(s.size, {tail}L) + 1 + x.size + 1", "s.size + x.size + 1")
    known = Window.partitionBy(session).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    joined = rows.withColumns({n: F.last(n, ignorenulls=True).over(known) for n in labels}).join(chunks, [session, order])
    parts = joined.groupBy(session, "chunk").agg(F.array_sort(F.collect_list(F.struct(order, "told", *labels))).alias("p"))
    last = F.element_at("p", -1)
    own = parts.select(session, "chunk", F.array_join(F.transform("p", lambda x: x["told"]), " ").alias("own"), *(last[n].alias(n) for n in labels), F.size("p").cast("long").alias("n_segments"))
    # The tail that a chunk begins with may reach further back than the chunk before it, so tails are carried over a
    # session's chunks; no more of a chunk than its own last characters takes part.
    ends = own.groupBy(session).agg(F.array_sort(F.collect_list(F.struct("chunk", F.right(F.concat("own", F.lit(" ")), F.lit(tail)).alias("end"), (F.length("own") + 1 >= tail).alias("full")))).alias("c"))
    tails = f"""aggregate(c, named_struct('tail', '', 'out', cast(array() as array<string>)), (s, x) -> named_struct(
        'tail', CASE WHEN x.full THEN x.end ELSE right(concat(s.tail, CASE WHEN x.chunk > 0 THEN ' ' ELSE '' END, x.end), {tail}) END, 'out', array_append(s.out, s.tail)), s -> s.out)"""
    before = ends.select(session, F.explode(F.arrays_zip("c", F.expr(tails).alias("tail"))).alias("z")).select(session, F.col("z.c.chunk").alias("chunk"), F.col("z.tail").alias("tail"))
    text_of = F.trim(F.concat("tail", F.when(F.col("chunk") > 0, " ").otherwise(""), "own"))
    named = [F.col(f"label_{i}").alias(c) for i, c in enumerate(("speaker", *carried))]
    return own.join(before, [session, "chunk"]).select(session, F.col("chunk").alias("chunk_index"), text_of.alias("text"), *named, "n_segments").filter("text <> ''")


def by_rows(segments: DataFrame, *, session: str, index: str, most: int = 4000) -> DataFrame:
    """Fixed numbers of rows per chunk; adds chunk_index and chunk_id."""
    chunk = F.floor(F.col(index) / most)
    return segments.withColumns({"chunk_index": chunk, "chunk_id": F.concat(F.col(session).cast("string"), F.lit("-chunk-"), chunk.cast("string"))})


def by_sections(sections: DataFrame, *, session: str, order: str, size: Column, most: int = 60_000, large: int = 80_000) -> DataFrame:
    """Packs sections; one of more than ``large`` stands alone, after a flush. (session, order, size, chunk, kind).

    The state's size is -1 while nothing is held after a large section.
    """
    flush = f"(x.size > {large} AND s.size >= 0) OR (x.size <= {large} AND (s.size = -1 OR s.size + x.size > {most}))"
    kept = _fold(sections, session, order, size, "0L", f"s.size <> -2 AND ({flush})", f"CASE WHEN x.size > {large} THEN -1L ELSE x.size END", f"CASE WHEN x.size > {large} THEN -1L ELSE greatest(s.size, 0L) + x.size END")
    # A session's first row opens no chunk of its own when nothing is held: numbers then begin at one, or twice after large ones.
    numbered = kept.withColumn("chunk", F.dense_rank().over(Window.partitionBy(session).orderBy("chunk", F.when(F.col("size") > large, F.col(order)))) - 1)
    return numbered.withColumn("kind", F.when(F.col("size") > large, "large").otherwise("combined"))


def by_paragraphs(texts: DataFrame, *, id_column: str, text: str = "text", most: int = 60_000, whole: int = 80_000) -> DataFrame:
    """C4: texts of more than ``whole`` characters are packed by paragraphs (blank lines); others stay whole. (id, pos, size, chunk)."""
    rows = texts.select(id_column, F.length(text).alias("_n"), F.posexplode(F.split(text, "\n\n")).alias("pos", "_p"))
    sized = rows.select(id_column, "pos", F.when(F.col("_n") <= whole, F.lit(0)).otherwise(F.length("_p")).alias("w"), F.length("_p").cast("long").alias("chars"))
    chunks = _fold(sized, id_column, "pos", F.col("w"), "0L", f"s.size > 0 AND s.size + x.size > {most}", "x.size", "s.size + x.size")
    return chunks.drop("size").join(sized.select(id_column, "pos", F.col("chars").alias("size")), [id_column, "pos"])


def by_weight(rows: DataFrame, *, session: str, order: str, weight: Column, most: int, initial: int = 0) -> DataFrame:
    """Packs rows by a weight (tokens of their JSON, characters) with a cost that every chunk has from the start."""
    return _fold(rows, session, order, weight, f"{initial}L", f"s.size + x.size > {most} AND s.size > {initial}", f"{initial} + x.size", "s.size + x.size")


def json_tokens(*columns: str) -> Column:
    """Token estimate of the JSON of some columns."""
    return estimate_tokens(F.to_json(F.struct(*columns)))


def by_time(captions: DataFrame, *, session: str, start: str = "t_start", end: str = "t_end", text: str = "text", seconds: float = 600.0) -> DataFrame:
    """Captions of fixed time ranges; the last ends with the session's last caption. Empty ranges give no row."""
    last = captions.groupBy(session).agg(F.max_by(end, F.struct(start, end)).alias("_last"))
    bucket = F.floor(F.col(start) / seconds)
    grouped = captions.groupBy(session, bucket.alias("range_index")).agg(F.count(F.lit(1)).alias("caption_count"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(start, end, text))), lambda x: x[text]), " ").alias("text"))
    joined = grouped.join(last, session)
    return joined.select(session, "range_index", (F.col("range_index") * F.lit(seconds)).alias("start_time"), F.least((F.col("range_index") + 1) * F.lit(seconds), F.col("_last")).alias("end_time"), "caption_count", "text")


def pauses(captions: DataFrame, *, session: str, start: str = "t_start", end: str = "t_end", longer: float = 3.0) -> DataFrame:
    """Ends of captions followed by a pause of more than ``longer`` seconds: (session, at, pause)."""
    gap = F.lead(start).over(Window.partitionBy(session).orderBy(start, end)) - F.col(end)
    return captions.select(session, F.col(end).alias("at"), gap.alias("pause")).filter(F.col("pause") > longer)


def nearest_pause(targets: DataFrame, found: DataFrame, *, session: str, target: str = "target", window: float = 120.0) -> DataFrame:
    """The pause nearest to each target within the window, the longest of equally near ones; else the target itself.

    Pauses meet targets by session and window-wide time bucket.
    """
    near = targets.withColumn("_b", F.explode(F.transform(F.array(F.lit(-1), F.lit(0), F.lit(1)), lambda o: F.floor(F.col(target) / window) + o)))
    joined = near.join(found.withColumn("_b", F.floor(F.col("at") / window)), [session, "_b"], "left").withColumn("_d", F.abs(F.col("at") - F.col(target)))
    best = F.min_by("at", F.when(F.col("_d") <= window, F.struct("_d", -F.col("pause"))))
    return joined.groupBy(*targets.columns).agg(F.coalesce(best, F.col(target)).alias("at"))


def windows(captions: DataFrame, *, session: str, start: str = "t_start", end: str = "t_end", length: float = 9000.0, overlap: float = 1200.0, window: float = 180.0, longer: float = 3.0) -> DataFrame:
    """Long overlapping windows whose ends snap to a pause: (session, window_index, window_start, window_end, overlap_start).

    A session's recurrence runs over its pauses only, a small sorted array; captions join afterwards by :func:`in_windows`.
    """
    if overlap + window >= length:
        raise ValueError("windows must advance: the overlap and the snap window together must be shorter than a window")
    last = captions.groupBy(session).agg(F.max_by(end, F.struct(start, end)).alias("last"))
    found = pauses(captions, session=session, start=start, end=end, longer=longer).groupBy(session).agg(F.array_sort(F.collect_list(F.struct("at", "pause"))).alias("pauses"))
    rows = last.join(found, session, "left").withColumn("pauses", F.coalesce("pauses", F.array().cast("array<struct<at:double,pause:double>>")))
    steps = f"cast(ceil(last / {length - overlap - window}) as int) + 1"
    best = f"array_min(transform(filter(pauses, p -> abs(p.at - (s.next + {length}D)) <= {window}D), p -> named_struct('d', abs(p.at - (s.next + {length}D)), 'p', -p.pause, 'at', p.at))).at"
    stop = f"CASE WHEN s.next + {length}D < last THEN coalesce({best}, s.next + {length}D) ELSE cast(last as double) END"
    fold = f"""aggregate(sequence(0, {steps}), named_struct('next', 0D, 'done', last <= 0, 'out', cast(array() as array<struct<a:double,b:double>>)),
        (s, i) -> CASE WHEN s.done THEN s ELSE named_struct('next', {stop} - {overlap}D, 'done', {stop} >= last,
            'out', array_append(s.out, named_struct('a', s.next, 'b', {stop}))) END, s -> s.out)"""
    out = rows.select(session, "last", F.posexplode(F.expr(fold)).alias("window_index", "w"))
    return out.select(session, F.col("window_index").cast("long").alias("window_index"), F.col("w.a").alias("window_start"), F.col("w.b").alias("window_end"), F.when(F.col("w.b") < F.col("last"), F.greatest(F.lit(0.0), F.col("w.b") - overlap)).alias("overlap_start"))


def in_windows(captions: DataFrame, found: DataFrame, *, session: str, start: str = "t_start") -> DataFrame:
    """Captions with each window that holds them; one may lie in two."""
    return captions.join(found, session).filter((F.col(start) >= F.col("window_start")) & (F.col(start) < F.col("window_end")))


def with_context(segments: DataFrame, *, session: str, order: str, speaker: str = "speaker", text: str = "text", k: int = 1) -> DataFrame:
    """Adds context_before and context_after: ``speaker: text`` of k neighbours, blank-joined."""
    told = F.concat(F.col(speaker), F.lit(": "), F.col(text))
    w = Window.partitionBy(session).orderBy(order)
    return segments.withColumns({"context_before": F.array_join(F.collect_list(told).over(w.rowsBetween(-k, -1)), " "), "context_after": F.array_join(F.collect_list(told).over(w.rowsBetween(1, k)), " ")})


def content_profile(pages: DataFrame, *, id_column: str, html: str = "html", over: int = 80_000) -> DataFrame:
    """C11: characters with and without tags, overhead in per cent, whether over the limit, paragraphs and speaker lines."""
    from plenum.functions.text import strip_html

    n, plain = F.length(html), F.length(strip_html(F.col(html), " "))
    return pages.select(id_column, n.cast("long").alias("html_chars"), plain.cast("long").alias("text_chars"), F.round(F.try_divide((n - plain) * 100.0, n), 4).alias("overhead"), (plain > over).alias("over_limit"), F.regexp_count(html, F.lit(r"<p[\s>]")).cast("long").alias("paragraphs"), F.regexp_count(html, F.lit(r"(?m)^[A-Z][A-Za-z .]+:")).cast("long").alias("speaker_lines"))


def truncated(texts: DataFrame, *, text: str = "text", most: int = 200_000) -> DataFrame:
    """The plain baseline, the first characters."""
    return texts.withColumn(text, F.left(text, F.lit(most)))


def route(tokens: Column, *, direct: int = 190_000, wide: int = 900_000) -> Column:
    """How a session of so many tokens is processed."""
    return F.when(tokens <= direct, "direct").when(tokens <= wide, "wide").otherwise("chunked")


def prompts(segments: DataFrame, *, session: str, order: str, speaker: str = "speaker", text: str = "text") -> DataFrame:
    """C14: ``[i] speaker: text`` of a session's rows, one per line."""
    line = F.format_string("[%d] %s: %s", F.col(order), F.col(speaker), F.col(text))
    return segments.groupBy(session).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, line.alias("line")))), lambda x: x["line"]), "\n").alias("prompt"))


def source_context(hits: DataFrame, *, query: str, rank: str = "rank", score: str = "score", text: str = "text") -> DataFrame:
    """C14: search hits of a question as numbered sources with their confidence."""
    block = F.format_string("--- Source %d (Confidence: %.1f%%) ---\n%s", F.col(rank), F.col(score) * 100, F.col(text))
    return hits.groupBy(query).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(rank, block.alias("b")))), lambda x: x["b"]), "\n\n").alias("context"))
