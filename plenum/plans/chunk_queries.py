"""Queries of parsing (P1-P6) and chunkers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plenum.functions.text import estimate_tokens
from plenum.operators import chunking as C
from plenum.operators import parsing as P
from plenum.plans.registry import query, table

# Captions of a user: an event is a cue that begins with its time and lasts as many seconds as its value.
_T = "(epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01')) / 1000000.0::DOUBLE"


def captions(spark: SparkSession, sf_dir: str) -> DataFrame:
    start = (F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(F.lit("2024-01-01").cast("timestamp"))) / 1000000.0
    return table(spark, sf_dir, "events").select("user_id", "event_id", start.alias("t_start"), (start + F.least("value", F.lit(60.0))).alias("t_end"), F.col("event_type").alias("text"))


_CAPTIONS = f"cap AS (SELECT user_id, event_id, {_T} AS t_start, {_T} + least(value, 60.0::DOUBLE) AS t_end, event_type AS text FROM events)"


def _folded(weight: str, most: int) -> str:
    """A greedy packing in SQL, row by row."""
    return f"""WITH RECURSIVE r AS (SELECT conv_id, turn, ({weight})::BIGINT AS w, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM conversations),
f AS (SELECT conv_id, turn, n, w AS held, 0::BIGINT AS chunk FROM r WHERE n = 1 UNION ALL
SELECT r.conv_id, r.turn, r.n, CASE WHEN f.held + r.w > {most} AND f.held > 0 THEN r.w ELSE f.held + r.w END, f.chunk + CASE WHEN f.held + r.w > {most} AND f.held > 0 THEN 1 ELSE 0 END FROM f JOIN r ON r.conv_id = f.conv_id AND r.n = f.n + 1)
SELECT conv_id, turn, chunk FROM f"""


@query(r"""WITH b AS (SELECT page_id, unnest(regexp_extract_all(replace(html, '<br><p>', '</b></p><p>'), '(?is)<p(?:\s[^>]*)?>(.*?)</p>', 1)) AS inner_html, generate_subscripts(regexp_extract_all(replace(html, '<br><p>', '</b></p><p>'), '(?is)<p(?:\s[^>]*)?>(.*?)</p>', 1), 1) AS pos FROM pages),
c AS (SELECT page_id, pos, regexp_matches(inner_html, '(?is)<b(?:\s[^>]*)?>(.*?)</b>') AS opens, trim(regexp_replace(replace(replace(replace(replace(replace(replace(regexp_replace(inner_html, '<[^>]*>', ' ', 'g'), '&nbsp;', ' '), '&amp;', '&'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '\s+', ' ', 'g')) AS plain FROM b),
d AS (SELECT *, sum(opens::INTEGER) OVER (PARTITION BY page_id ORDER BY pos) AS speech_no FROM c)
SELECT page_id, speech_no::BIGINT AS speech_no, md5(string_agg(plain, ' ' ORDER BY pos)) AS text FROM d WHERE speech_no > 0 AND plain <> '' GROUP BY page_id, speech_no""")
def p1_speeches(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", F.replace("html", F.lit("<br><p>"), F.lit("</b></p><p>")).alias("html"), F.lit(0).alias("section"))
    return P.speeches(pages, session="page_id", section="section", mark="b").select("page_id", "speech_no", F.md5("text").alias("text"))


# Every second page gets marked names at its paragraphs, with the colon within the mark or after it; the others have none.
_NAMED = """SELECT page_id, CASE WHEN page_id % 2 = 1 THEN html WHEN page_id % 4 = 0 THEN replace(replace(html, '<b>', '<i>'), '<p>', '<p><b>Member ' || page_id::VARCHAR || ':</b> ') ELSE replace(replace(html, '<b>', '<i>'), '<p>', '<p><b>Member ' || page_id::VARCHAR || '</b>: ') END AS html FROM pages"""


def _plain(column: str, tag_to: str) -> str:
    out = f"regexp_replace({column}, '<[^>]*>', '{tag_to}', 'g')"
    for name, to in (("&nbsp;", " "), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''")):
        out = f"replace({out}, '{name}', '{to}')"
    return rf"trim(regexp_replace({out}, '\s+', ' ', 'g'))"


_SAID = _plain(r"regexp_replace(regexp_replace(i, '(?is)^<b>([^<]*)</b>', ''), '^\s*:?\s*', '')", "")


@query(rf"""WITH n AS ({_NAMED}), b AS (SELECT page_id, unnest(regexp_extract_all(html, '(?is)<p(?:\s[^>]*)?>(.*?)(?:</p>|$)', 1)) AS i FROM n),
s AS (SELECT page_id, trim(regexp_replace(regexp_extract(i, '(?is)^<b>([^<]*)</b>', 1), ':\s*$', '')) AS speaker, {_SAID} AS text FROM b WHERE regexp_matches(i, '(?is)^<b>([^<]*)</b>')),
g AS (SELECT * FROM s WHERE length(text) > 20 AND speaker <> '' AND NOT contains(speaker, ':'))
SELECT page_id, speaker, md5(text) AS text FROM g UNION ALL SELECT page_id, NULL, md5({_plain("html", " ")}) FROM n WHERE page_id NOT IN (SELECT page_id FROM g) AND length({_plain("html", " ")}) > 50""")
def p2_retrieval_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    html, name = F.col("html"), F.concat(F.lit("<p><b>Member "), F.col("page_id").cast("string"))
    bare = F.replace(html, F.lit("<b>"), F.lit("<i>"))
    named = F.when(F.col("page_id") % 2 == 1, html).when(F.col("page_id") % 4 == 0, F.replace(bare, F.lit("<p>"), F.concat(name, F.lit(":</b> ")))).otherwise(F.replace(bare, F.lit("<p>"), F.concat(name, F.lit("</b>: "))))
    rows = table(spark, sf_dir, "pages").select("page_id", F.explode(P.retrieval_segments(named, mark="b")).alias("s"))
    return rows.select("page_id", "s.speaker", F.md5("s.text").alias("text"))


@query("""SELECT conv_id % 10 AS session, conv_id, turn, row_number() OVER (PARTITION BY conv_id % 10 ORDER BY conv_id, turn) - 1 AS segment_index FROM conversations""")
def p3_segment_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").withColumn("session", F.col("conv_id") % 10)
    return P.numbered(rows, session="session", order=("conv_id", "turn")).select("session", "conv_id", "turn", F.col("segment_index").cast("long").alias("segment_index"))


@query("""SELECT conv_id, string_agg(role || turn::VARCHAR, '|' ORDER BY turn) FILTER (WHERE turn % 2 = 0) AS members FROM conversations GROUP BY conv_id""")
def p4_present_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = F.array_sort(F.collect_list(F.struct("turn", F.concat("role", F.col("turn").cast("string")).alias("mpName"), (F.col("turn") % 2 == 0).alias("attendance"))))
    rows = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(held.alias("a"))
    return rows.select("conv_id", F.array_join(P.present_members(F.col("a")), "|").alias("members"))


@query("""SELECT conv_id, turn, md5(text) AS quote, turn::DOUBLE AS ai_score FROM conversations WHERE conv_id % 4 < 3 OR turn < (SELECT max(turn) FROM conversations c WHERE c.conv_id = conversations.conv_id)""")
def p5_repaired_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers written from turns: whole, in a fence, whole, and cut within the last object."""
    item = F.struct(F.col("text").alias("quote"), F.col("turn").cast("double").alias("ai_score"), F.col("turn").alias("turn"))
    rows = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.to_json(F.transform(F.array_sort(F.collect_list(F.struct("turn", item.alias("i")))), lambda x: x["i"])).alias("j"))
    kind = F.col("conv_id") % 4
    told = F.when(kind == 1, F.concat(F.lit("```json\n"), "j", F.lit("\n```"))).when(kind == 3, F.substring("j", F.lit(1), F.length("j") - 6)).otherwise(F.col("j"))
    found = rows.select("conv_id", F.explode(P.repaired_json(told, "STRUCT<quote: STRING, ai_score: DOUBLE, turn: BIGINT>")).alias("x"))
    return found.select("conv_id", "x.turn", F.md5("x.quote").alias("quote"), "x.ai_score")


@query("""WITH r AS (SELECT conv_id, turn, CASE WHEN conv_id % 2 = 0 THEN 'WA' ELSE 'OA' END AS t, CASE WHEN role = 'user' THEN (turn + 1)::VARCHAR || '. ' || text ELSE text END AS body, role = 'user' AS opens FROM conversations),
n AS (SELECT *, CASE WHEN t = 'WA' THEN sum(opens::INTEGER) OVER (PARTITION BY conv_id ORDER BY turn) ELSE 0 END::BIGINT AS part FROM r)
SELECT conv_id, part, conv_id::VARCHAR || '-0-' || part::VARCHAR AS chunk_id, min(turn) AS first_page, max(turn) AS last_page, md5(string_agg(body, chr(10) ORDER BY turn)) AS text FROM n GROUP BY conv_id, part""")
def p6_question_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = F.when(F.col("role") == "user", F.concat((F.col("turn") + 1).cast("string"), F.lit(". "), "text")).otherwise(F.col("text"))
    blocks = table(spark, sf_dir, "conversations").select("conv_id", F.lit(0).alias("section"), F.col("turn").alias("speech_no"), F.col("role").alias("speaker"), told.alias("text"), F.when(F.col("conv_id") % 2 == 0, "WA").otherwise("OA").alias("section_type"), F.col("turn").alias("page"))
    return P.question_pairs(blocks, session="conv_id", section="section").select("conv_id", F.col("part").cast("long").alias("part"), "chunk_id", "first_page", "last_page", F.md5("text").alias("text"))


@query("""WITH RECURSIVE r AS (SELECT conv_id, role || ': ' || text AS s, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM conversations),
f AS (SELECT conv_id, n, s || ' ' AS held, 0::BIGINT AS chunk FROM r WHERE n = 1 UNION ALL
SELECT r.conv_id, r.n, CASE WHEN ceil(length(f.held) / 4) + ceil(length(r.s) / 4) > 200 THEN right(f.held, 200) || ' ' || r.s || ' ' ELSE f.held || r.s || ' ' END, f.chunk + CASE WHEN ceil(length(f.held) / 4) + ceil(length(r.s) / 4) > 200 THEN 1 ELSE 0 END FROM f JOIN r ON r.conv_id = f.conv_id AND r.n = f.n + 1)
SELECT conv_id, chunk AS chunk_index, count(*)::BIGINT AS n_segments, md5(trim(arg_max(held, n))) AS text, (max(n) - 1) // 3 AS section_no FROM f GROUP BY conv_id, chunk""")
def c1_by_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every third turn begins a section, whose title its chunks carry."""
    rows = table(spark, sf_dir, "conversations").withColumn("section_title", F.when(F.col("turn") % 3 == 0, (F.col("turn") / 3).cast("long").cast("string")))
    chunks = C.by_tokens(rows, session="conv_id", order="turn", speaker="role", most=200, overlap=50, carried=("section_title",))
    return chunks.select("conv_id", "chunk_index", "n_segments", F.md5("text").alias("text"), F.col("section_title").cast("long").alias("section_no"))


@query("""SELECT conv_id, turn, turn // 3 AS chunk_index, conv_id::VARCHAR || '-chunk-' || (turn // 3)::VARCHAR AS chunk_id FROM conversations""")
def c2_by_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.by_rows(table(spark, sf_dir, "conversations"), session="conv_id", index="turn", most=3).select("conv_id", "turn", "chunk_index", "chunk_id")


@query("""WITH RECURSIVE r AS (SELECT conv_id, turn, length(text) AS w, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM conversations),
f AS (SELECT conv_id, turn, n, w, 1::BIGINT AS chunk, CASE WHEN w > 1000 THEN NULL ELSE w END AS held FROM r WHERE n = 1 UNION ALL
SELECT r.conv_id, r.turn, r.n, r.w, f.chunk + CASE WHEN r.w > 1000 OR f.held IS NULL OR f.held + r.w > 800 THEN 1 ELSE 0 END, CASE WHEN r.w > 1000 THEN NULL WHEN f.held IS NULL OR f.held + r.w > 800 THEN r.w ELSE f.held + r.w END FROM f JOIN r ON r.conv_id = f.conv_id AND r.n = f.n + 1)
SELECT conv_id, turn, chunk - 1 AS chunk, CASE WHEN w > 1000 THEN 'large' ELSE 'combined' END AS kind FROM f""")
def c3_by_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = C.by_sections(table(spark, sf_dir, "conversations"), session="conv_id", order="turn", size=F.length("text"), most=800, large=1000)
    return chunks.select("conv_id", "turn", F.col("chunk").cast("long").alias("chunk"), "kind")


@query("""WITH RECURSIVE p AS (SELECT doc_id, length(text) AS n_all, unnest(string_split(replace(text, chr(10), chr(10) || chr(10)), chr(10) || chr(10))) AS t, generate_subscripts(string_split(replace(text, chr(10), chr(10) || chr(10)), chr(10) || chr(10)), 1) AS n FROM documents),
r AS (SELECT doc_id, n, CASE WHEN n_all + (SELECT 0) <= 0 THEN 0 ELSE length(t) END AS w, length(t) AS chars FROM p),
f AS (SELECT doc_id, n, w AS held, chars, 0::BIGINT AS chunk FROM r WHERE n = 1 UNION ALL
SELECT r.doc_id, r.n, CASE WHEN f.held > 0 AND f.held + r.w > 500 THEN r.w ELSE f.held + r.w END, r.chars, f.chunk + CASE WHEN f.held > 0 AND f.held + r.w > 500 THEN 1 ELSE 0 END FROM f JOIN r ON r.doc_id = f.doc_id AND r.n = f.n + 1)
SELECT doc_id, chunk, count(*)::BIGINT AS n_paragraphs, sum(chars)::BIGINT AS chars FROM f GROUP BY doc_id, chunk""")
def c4_by_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = table(spark, sf_dir, "documents").select("doc_id", F.replace("text", F.lit("\n"), F.lit("\n\n")).alias("text"))
    return C.by_paragraphs(texts, id_column="doc_id", most=500, whole=0).groupBy("doc_id", "chunk").agg(F.count(F.lit(1)).alias("n_paragraphs"), F.sum("size").alias("chars"))


@query(_folded("ceil((length(text) + length(role)) / 4)", 150).replace("f.held > 0", "f.held > 0"))
def c5_by_weight(spark: SparkSession, sf_dir: str) -> DataFrame:
    weight = F.ceil((F.length("text") + F.length("role")) / 4)
    return C.by_weight(table(spark, sf_dir, "conversations"), session="conv_id", order="turn", weight=weight, most=150).select("conv_id", "turn", "chunk")


@query(_folded("length(text)", 1000))
def c6_by_characters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.by_weight(table(spark, sf_dir, "conversations"), session="conv_id", order="turn", weight=F.length("text"), most=1000).select("conv_id", "turn", "chunk")


@query(f"""WITH {_CAPTIONS}, m AS (SELECT user_id, arg_max(t_end, t_start) AS last FROM cap GROUP BY user_id)
SELECT cap.user_id, floor(t_start / 86400)::BIGINT AS range_index, count(*)::BIGINT AS caption_count, round(least((floor(t_start / 86400) + 1) * 86400, max(last)), 3) AS end_time, md5(string_agg(text, ' ' ORDER BY t_start)) AS text FROM cap JOIN m USING (user_id) GROUP BY cap.user_id, floor(t_start / 86400)""")
def c7_by_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.by_time(captions(spark, sf_dir), session="user_id", seconds=86400.0).select("user_id", "range_index", "caption_count", F.round("end_time", 3).alias("end_time"), F.md5("text").alias("text"))


@query(f"""WITH RECURSIVE {_CAPTIONS}, m AS (SELECT user_id, arg_max(t_end, t_start) AS last FROM cap GROUP BY user_id),
p AS (SELECT * FROM (SELECT user_id, t_end AS brk, lead(t_start) OVER (PARTITION BY user_id ORDER BY t_start, t_end) - t_end AS pause FROM cap) WHERE pause > 3),
f AS (SELECT user_id, last, 0::BIGINT AS n, 0::DOUBLE AS a, CASE WHEN 600000 < last THEN coalesce((SELECT arg_min(brk, row(abs(brk - 600000), -pause)) FROM p WHERE p.user_id = m.user_id AND abs(brk - 600000) <= 20000), 600000) ELSE last END::DOUBLE AS b FROM m UNION ALL
SELECT f.user_id, last, n + 1, b - 80000, CASE WHEN b + 520000 < last THEN coalesce((SELECT arg_min(brk, row(abs(brk - (f.b + 520000)), -pause)) FROM p WHERE p.user_id = f.user_id AND abs(brk - (f.b + 520000)) <= 20000), b + 520000) ELSE last END::DOUBLE FROM f WHERE b < last)
SELECT f.user_id, n AS window_index, round(a, 3) AS window_start, round(b, 3) AS window_end, (SELECT count(*) FROM cap c WHERE c.user_id = f.user_id AND t_start >= a AND t_start < b)::BIGINT AS caption_count FROM f""")
def c8_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = captions(spark, sf_dir)
    found = C.windows(rows, session="user_id", length=600_000.0, overlap=80_000.0, window=20_000.0)
    return C.in_windows(rows, found, session="user_id").groupBy("user_id", "window_index", F.round("window_start", 3).alias("window_start"), F.round("window_end", 3).alias("window_end")).agg(F.count(F.lit(1)).alias("caption_count"))


@query(f"""WITH {_CAPTIONS}, p AS (SELECT * FROM (SELECT user_id, t_end AS brk, lead(t_start) OVER (PARTITION BY user_id ORDER BY t_start, t_end) - t_end AS pause FROM cap) WHERE pause > 3),
t AS (SELECT DISTINCT user_id, 200000.0::DOUBLE * k AS target FROM cap, range(1, 6) r(k))
SELECT t.user_id, target, round(coalesce((SELECT arg_min(brk, row(abs(brk - target), -pause)) FROM p WHERE p.user_id = t.user_id AND abs(brk - target) <= 7200), target), 3) AS break_at FROM t""")
def c9_nearest_pause(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = captions(spark, sf_dir)
    targets = rows.select("user_id").distinct().withColumn("target", F.explode(F.array(*(F.lit(200000.0 * k) for k in range(1, 6)))))
    return C.nearest_pause(targets, C.pauses(rows, session="user_id"), session="user_id", window=7200.0).select("user_id", "target", F.round("at", 3).alias("break_at"))


@query("""SELECT conv_id, turn, md5(concat_ws(' ', lag(role || ': ' || text, 2) OVER w, lag(role || ': ' || text) OVER w)) AS context_before, md5(concat_ws(' ', lead(role || ': ' || text) OVER w, lead(role || ': ' || text, 2) OVER w)) AS context_after FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)""")
def c10_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = C.with_context(table(spark, sf_dir, "conversations"), session="conv_id", order="turn", speaker="role", k=2)
    return rows.select("conv_id", "turn", F.md5("context_before").alias("context_before"), F.md5("context_after").alias("context_after"))


@query(r"""WITH p AS (SELECT page_id, html, length(html) AS n, length(trim(regexp_replace(replace(replace(replace(replace(replace(replace(regexp_replace(html, '<[^>]*>', ' ', 'g'), '&nbsp;', ' '), '&amp;', '&'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '\s+', ' ', 'g'))) AS m FROM pages)
SELECT page_id, n::BIGINT AS html_chars, m::BIGINT AS text_chars, round((n - m) * 100.0::DOUBLE / n, 4) AS overhead, m > 1000 AS over_limit, len(regexp_extract_all(html, '<p[\s>]'))::BIGINT AS paragraphs FROM p""")
def c11_content_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.content_profile(table(spark, sf_dir, "pages"), id_column="page_id", over=1000).drop("speaker_lines")


@query("SELECT doc_id, md5(left(text, 300)) AS text FROM documents")
def c12_truncated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.truncated(table(spark, sf_dir, "documents"), most=300).select("doc_id", F.md5("text").alias("text"))


@query("""SELECT source, sum(ceil(length(text) / 4))::BIGINT AS tokens, CASE WHEN sum(ceil(length(text) / 4)) <= 12000 THEN 'direct' WHEN sum(ceil(length(text) / 4)) <= 40000 THEN 'wide' ELSE 'chunked' END AS route FROM documents GROUP BY source""")
def c13_route(spark: SparkSession, sf_dir: str) -> DataFrame:
    totals = table(spark, sf_dir, "documents").groupBy("source").agg(F.sum(estimate_tokens(F.col("text"))).cast("long").alias("tokens"))
    return totals.withColumn("route", C.route(F.col("tokens"), direct=12_000, wide=40_000))


@query("""SELECT conv_id, md5(string_agg('[' || turn::VARCHAR || '] ' || role || ': ' || text, chr(10) ORDER BY turn)) AS prompt FROM conversations GROUP BY conv_id""")
def c14_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.prompts(table(spark, sf_dir, "conversations"), session="conv_id", order="turn", speaker="role").select("conv_id", F.md5("prompt").alias("prompt"))
