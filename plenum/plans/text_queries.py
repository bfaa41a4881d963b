"""Queries of the column functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plenum.functions import text as X
from plenum.plans.registry import query, table

def _day():
    return F.to_date("o_orderdate")


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 2 THEN NULL ELSE o_orderdate::DATE END AS day FROM orders""")
def t1_parse_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    written = F.when(F.col("o_orderkey") % 3 == 0, F.date_format("o_orderdate", "d-M-yyyy")).when(F.col("o_orderkey") % 3 == 1, F.date_format("o_orderdate", "yyyy-M-d")).otherwise(F.lit("31-02-2025"))
    return o.select("o_orderkey", X.parse_date(written).alias("day"))


@query("""SELECT o_orderkey, CASE WHEN year(o_orderdate) >= 2000 THEN o_orderdate::DATE END AS day,
CASE WHEN year(o_orderdate) >= 2000 THEN strftime(o_orderdate, '%-d %B %Y') END AS formatted FROM orders""")
def t2_sitting_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = X.parse_sitting_date(F.date_format("o_orderdate", "dd-MM-yyyy"))
    return table(spark, sf_dir, "orders").select("o_orderkey", d["date"].alias("day"), d["formatted"].alias("formatted"))


@query("""SELECT o_orderkey, strftime(o_orderdate, '%d-%m-%Y') AS day_key, concat_ws('|', strftime(o_orderdate, '%-d %B %Y'), strftime(o_orderdate, '%-d %b %Y'),
strftime(o_orderdate, '%d-%m-%Y'), strftime(o_orderdate, '%d/%m/%Y'), strftime(o_orderdate, '%Y-%m-%d')) AS variants FROM orders""")
def t3_date_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey", X.date_key(_day()).alias("day_key"), F.array_join(X.date_variants(_day()), "|").alias("variants"))


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 5 > 0 THEN o_orderdate::DATE END AS day FROM orders""")
def t4_title_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    title = F.when(F.col("o_orderkey") % 5 > 0, F.concat(F.lit("Parliament Sitting "), F.date_format("o_orderdate", "d MMMM yyyy"), F.lit(" (English)"))).otherwise("Budget Debate")
    return table(spark, sf_dir, "orders").select("o_orderkey", X.title_date(title).alias("day"))


@query("""SELECT o_orderkey, o_orderdate::DATE AS day FROM orders""")
def t5_id_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.concat(F.lit("parliament-"), F.date_format("o_orderdate", "dd-MM-yyyy"), F.lit("-moment-3"))
    return table(spark, sf_dir, "orders").select("o_orderkey", X.id_date(name).alias("day"))


@query("""SELECT conv_id, turn, conv_id::VARCHAR || '-' || turn::VARCHAR AS segment_id, 'seg-' || lpad(turn::VARCHAR, 5, '0') AS padded_id,
strftime(DATE '2024-01-01' + (conv_id % 300)::INTEGER, '%Y-%m-%d') || '-parliament-14-session-' || (conv_id % 3)::VARCHAR AS transcript_id FROM conversations""")
def t6_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.date_add(F.lit("2024-01-01").cast("date"), (F.col("conv_id") % 300).cast("int"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", X.numbered_id(F.col("conv_id"), F.col("turn")).alias("segment_id"), X.numbered_id(F.lit("seg"), F.col("turn"), "-", 5).alias("padded_id"), X.transcript_id(day, F.lit(14), F.col("conv_id") % 3).alias("transcript_id"))


@query("""SELECT event_id, 'https://www.youtube.com/watch?v=' || 'v' || user_id::VARCHAR || CASE WHEN floor(value) > 0 THEN '&t=' || floor(value)::BIGINT::VARCHAR || 's' ELSE '' END AS url FROM events""")
def t7_video_url(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", X.video_url(F.concat(F.lit("v"), F.col("user_id").cast("string")), F.col("value")).alias("url"))


@query("""SELECT event_id, CASE WHEN event_id % 4 = 3 THEN 0 ELSE (CASE WHEN event_id % 4 = 0 THEN (user_id % 7) * 3600 ELSE 0 END) + (event_id % 60) * 60 + CASE WHEN event_id % 4 < 2 THEN user_id % 60 ELSE 0 END END::BIGINT AS seconds FROM events""")
def t8_iso_duration(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, u, k = F.col("event_id"), F.col("user_id"), F.col("event_id") % 4
    text = F.when(k == 3, F.lit("1:02:03")).otherwise(F.concat(F.lit("PT"), F.when(k == 0, F.concat((u % 7).cast("string"), F.lit("H"))).otherwise(""), (e % 60).cast("string"), F.lit("M"), F.when(k < 2, F.concat((u % 60).cast("string"), F.lit("S"))).otherwise("")))
    return table(spark, sf_dir, "events").select("event_id", X.iso_duration(text).alias("seconds"))


@query("""SELECT event_id, (hour(ts) * 3600 + minute(ts) * 60)::BIGINT AS seconds, event_id % 2 = 0 AS heading FROM events""")
def t9_clock(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = F.when(F.col("event_id") % 2 == 0, F.date_format("ts", "h.mm a")).otherwise(F.date_format("ts", "H:mm"))
    return table(spark, sf_dir, "events").select("event_id", X.clock_seconds(told).alias("seconds"), X.is_clock_heading(told).alias("heading"))


@query("""WITH s AS (SELECT event_id, (epoch_us(ts) // 1000 - epoch_us(TIMESTAMP '2024-01-01') // 1000) / 1000.0::DOUBLE AS x FROM events)
SELECT event_id, round(x, 3) AS seconds,
lpad(floor(x / 3600)::BIGINT::VARCHAR, greatest(2, length(floor(x / 3600)::BIGINT::VARCHAR))::INTEGER, '0') || ':' || lpad((floor(x / 60)::BIGINT % 60)::VARCHAR, 2, '0') || ':' || lpad((floor(x)::BIGINT % 60)::VARCHAR, 2, '0') AS clock FROM s""")
def t10_cue_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = (F.unix_millis(F.col("ts").cast("timestamp")) - F.unix_millis(F.lit("2024-01-01").cast("timestamp"))) / 1000.0
    e = table(spark, sf_dir, "events").select("event_id", x.alias("x"))
    return e.select("event_id", F.round(X.cue_seconds(X.hms_millis(F.col("x"))), 3).alias("seconds"), X.hms(F.col("x")).alias("clock"))


@query("""SELECT o_orderkey, CASE WHEN o_orderdate < DATE '1995-01-01' THEN 7 WHEN o_orderdate < DATE '1997-01-03' THEN 8 ELSE 9 END::BIGINT AS parliament FROM orders""")
def t11_parliament_number(spark: SparkSession, sf_dir: str) -> DataFrame:
    from plenum.operators.matching import by_ranges

    terms = spark.createDataFrame([(7, None, "1995-01-01"), (8, "1995-01-01", "1997-01-03"), (9, "1997-01-03", None)], "parliament long, since string, until string").select("parliament", F.to_date("since").alias("since"), F.to_date("until").alias("until"))
    return by_ranges(table(spark, sf_dir, "orders").select("o_orderkey", _day().alias("day")), terms, "day").select("o_orderkey", "parliament")


@query(r"""SELECT page_id, trim(regexp_replace(replace(replace(replace(replace(replace(replace(regexp_replace(html, '<[^>]*>', '', 'g'), '&nbsp;', ' '), '&amp;', '&'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '\s+', ' ', 'g')) AS plain FROM pages""")
def t12_strip_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", X.strip_html(F.col("html")).alias("plain"))


@query(r"""SELECT doc_id, md5(trim(regexp_replace(regexp_replace(lower(text), '[^a-z0-9_\s]', ' ', 'g'), '\s+', ' ', 'g'))) AS form, md5(trim(lower(text))) AS key FROM documents""")
def t13_match_form(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(X.match_form(F.col("text"))).alias("form"), F.md5(X.quote_key(F.col("text"))).alias("key"))


@query(r"""SELECT doc_id, len(list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> ''))::BIGINT AS words, len(regexp_split_to_array(text, '\s+'))::BIGINT AS pieces, length(text)::BIGINT AS chars, ceil(length(text) / 4)::BIGINT AS tokens FROM documents""")
def t14_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("text")
    return table(spark, sf_dir, "documents").select("doc_id", X.count_words(t).alias("words"), X.count_pieces(t).alias("pieces"), F.length(t).cast("long").alias("chars"), X.estimate_tokens(t).cast("long").alias("tokens"))


@query("""SELECT doc_id, contains(lower(text), 'thation') OR contains(lower(text), 'license') OR contains(lower(text), 'ciónja') AS found FROM documents""")
def t15_contains_any(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", X.contains_any(F.col("text"), ("thation", "License", "ciónja")).alias("found"))


@query(r"""SELECT conv_id, turn, CASE WHEN regexp_extract(text, '^[A-Z][a-z]+') <> '' THEN 'Mr ' || regexp_extract(text, '^[A-Z][a-z]+') END AS names FROM conversations""")
def t16_titled_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.regexp_extract("text", "^[A-Z][a-z]+", 0)
    told = F.concat(F.lit("then Mr "), name, F.lit(" said; Mr "), name, F.lit(", again"))
    found = F.nullif(F.array_join(X.titled_names(told), "|"), F.lit(""))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", found.alias("names"))


@query("""SELECT user_id, ((event_id % 90) * 60 + event_id % 60)::DOUBLE AS seconds, event_type AS label FROM events WHERE event_id % 3 > 0""")
def t17_chapters(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_id")
    line = F.concat(F.lpad((e % 90).cast("string"), 2, "0"), F.lit(":"), F.lpad((e % 60).cast("string"), 2, "0"), F.lit(" - "), F.when(e % 3 > 0, F.col("event_type")).otherwise(""))
    described = table(spark, sf_dir, "events").groupBy("user_id").agg(F.array_join(F.sort_array(F.collect_list(F.struct("event_id", line.alias("line"))))["line"], "\n").alias("description"))
    return described.select("user_id", F.explode(X.chapter_lines(F.concat(F.lit("Watch:\n"), F.col("description")))).alias("c")).select("user_id", "c.seconds", "c.label")


@query("""WITH p AS (SELECT doc_id, source || chr(10) || chr(10) || text || chr(10) || chr(10) || '#' || lang || ' #news' AS t FROM documents)
SELECT doc_id, md5(CASE WHEN length(t) > 2200 THEN left(t, 2197) || '...' ELSE t END) AS short_post, md5(CASE WHEN length(t) > 5000 THEN left(t, 4997) || '...' ELSE t END) AS long_post FROM p""")
def t18_posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    tags = F.array("lang", F.lit("news"))
    post = lambda p: F.md5(X.post_text(F.col("source"), F.col("text"), tags, p))
    return table(spark, sf_dir, "documents").select("doc_id", post("tiktok").alias("short_post"), post("youtube").alias("long_post"))


@query(r"""SELECT doc_id, md5(trim(regexp_replace(regexp_replace(text, '[*_`#~]', '', 'g'), '\s+', ' ', 'g'))) AS spoken FROM documents""")
def t19_speech_safe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(X.speech_safe(F.concat(F.col("text"), F.lit(" \U0001f600")))).alias("spoken"))


@query(r"""WITH w AS (SELECT doc_id, text, len(regexp_split_to_array(text, '\s+')) AS n FROM documents), r(persona, rate) AS (VALUES ('gen_z', 3.5), ('kopitiam_uncle', 3.2), ('auntie', 3.0), ('attenborough', 2.5))
SELECT doc_id, persona, floor(n / rate::DOUBLE + (length(text) - length(replace(text, '!', ''))) * 0.2::DOUBLE + (length(text) - length(replace(text, '?', ''))) * 0.2::DOUBLE + len(regexp_extract_all(text, '\.\.\.')) * 0.5::DOUBLE + 0.5::DOUBLE)::BIGINT AS seconds FROM w, r""")
def t20_spoken_seconds(spark: SparkSession, sf_dir: str) -> DataFrame:
    from plenum.functions.lexicons import WORDS_PER_SECOND

    rates = F.explode(F.array(*(F.struct(F.lit(p).alias("persona"), F.lit(r).alias("rate")) for p, r in WORDS_PER_SECOND.items())))
    rows = table(spark, sf_dir, "documents").select("doc_id", "text", rates.alias("r"))
    return rows.select("doc_id", "r.persona", X.spoken_seconds(F.col("text"), F.col("r.rate")).alias("seconds"))


@query("""SELECT doc_id, md5(CASE WHEN length(text) > 200 THEN left(text, 200) || '...' ELSE text END) AS quote, CASE WHEN length(text) > 150 THEN left(text, 150) || '...' ELSE text END AS brief FROM documents""")
def t21_cut_quote(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(X.cut_quote(F.col("text"))).alias("quote"), X.cut_quote(F.col("text"), 150).alias("brief"))
