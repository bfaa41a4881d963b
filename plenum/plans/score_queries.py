"""Queries of the scoring rules (K1-K13). Invented prose holds no word of the default lexicons, so frequent ones stand in."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plenum.operators import scoring as S
from plenum.plans.registry import query, table

JARGON = ("thation", "ering", "tion", "nterth", "ciónja", "queeau")
PAIRS = ((("thation", "erin"), ("nter", "stou")), (("queeau",), ("leeau", "ment")))
DAILY = ("hation", "ciudad", "eaueau", "lich")
TONES = (("src1", "src2"), ("src3", "src4"))
_HITS = " + ".join(f"(contains(lower(text), '{t}'))::INTEGER" for t in JARGON)
_PIECES = r"len(regexp_split_to_array(text, '\s+'))"
_JARGON = f"least(({_HITS}) / greatest({_PIECES} / 10.0::DOUBLE, 1.0::DOUBLE), 1.0::DOUBLE)"
_ANY = lambda c, words: "(" + " OR ".join(f"contains(lower({c}), '{w}')" for w in words) + ")"
_CONTRA = "(" + " OR ".join(f"({_ANY('text', a)} AND {_ANY('text', b)})" for a, b in PAIRS) + ")"
_QUOTE = f"CASE WHEN {_PIECES} < 10 THEN 0.3 WHEN {_PIECES} < 15 THEN 0.6 + ({_PIECES} - 10) / 5.0 * 0.4 WHEN {_PIECES} <= 40 THEN 1.0 WHEN {_PIECES} <= 60 THEN 0.7 ELSE 0.4 END::DOUBLE"
_TONE = f"CASE WHEN {_ANY('source', TONES[0])} THEN 1.0 WHEN {_ANY('source', TONES[1])} THEN 0.6 ELSE 0.3 END::DOUBLE"
_AI = "(doc_id % 11)::DOUBLE"
_FINAL = f"least({_AI} * 0.4::DOUBLE + {_JARGON} * 2.0::DOUBLE + CASE WHEN {_CONTRA} THEN 2.0 ELSE 0.0 END::DOUBLE + ({_QUOTE}) + CASE WHEN {_ANY('text', DAILY)} THEN 1.5 ELSE 0.0 END::DOUBLE + ({_TONE}) * 3.0::DOUBLE, 10.0::DOUBLE)"


def _text():
    return F.col("text")


def _ai():
    return (F.col("doc_id") % 11).cast("double")


def _final():
    return S.final_score(_ai(), S.jargon_score(_text(), JARGON), S.contradicts(_text(), PAIRS), S.quotability(_text()), S.everyday(_text(), DAILY), S.tone_strength(F.col("source"), *TONES))


@query(f"SELECT doc_id, round({_JARGON}, 6) AS jargon FROM documents")
def k1_jargon(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.round(S.jargon_score(_text(), JARGON), 6).alias("jargon"))


@query(f"SELECT doc_id, {_CONTRA} AS contradiction FROM documents")
def k2_contradiction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", S.contradicts(_text(), PAIRS).alias("contradiction"))


@query(f"SELECT doc_id, {_ANY('text', DAILY)} AS everyday FROM documents")
def k3_everyday(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", S.everyday(_text(), DAILY).alias("everyday"))


@query(f"SELECT conv_id, turn, round({_QUOTE}, 6) AS quotability FROM conversations")
def k4_quotability(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.round(S.quotability(_text()), 6).alias("quotability"))


@query(f"SELECT doc_id, {_TONE} AS tone FROM documents")
def k5_tone(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", S.tone_strength(F.col("source"), *TONES).alias("tone"))


@query(f"SELECT doc_id, round({_FINAL}, 6) AS score FROM documents")
def k6_final_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.round(_final(), 6).alias("score"))


@query(f"SELECT doc_id, round(greatest(0::DOUBLE, least({_FINAL} + CASE WHEN doc_id % 3 = 0 THEN 0.5 ELSE 0 END::DOUBLE - CASE WHEN length(text) > 250 THEN 1.0 ELSE 0 END::DOUBLE, 10::DOUBLE)), 6) AS score FROM documents")
def k7_adjusted_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    group = F.when(F.col("doc_id") % 3 == 0, "Gen Z and others").otherwise("All")
    return table(spark, sf_dir, "documents").select("doc_id", F.round(S.adjusted_score(_final(), group, _text()), 6).alias("score"))


@query(f"SELECT doc_id, least({_AI} + CASE WHEN doc_id % 2 = 0 THEN 1.0 ELSE 0 END::DOUBLE + CASE WHEN {_CONTRA} THEN 1.5 ELSE 0 END::DOUBLE + CASE WHEN {_ANY('text', DAILY)} THEN 1.0 ELSE 0 END::DOUBLE, 10::DOUBLE) AS score FROM documents")
def k8_boosted_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", S.boosted_score(_ai(), F.col("doc_id") % 2 == 0, S.contradicts(_text(), PAIRS), S.everyday(_text(), DAILY)).alias("score"))


_MARKERS = {"first": ("thation", "ering", "the"), "second": ("que", "ment", "leeau", "eau"), "third": ("und", "lich"), "silent": ()}
_NEEDED = {"first": 2, "second": 3, "third": 2}


@query("WITH m(persona, pos, marker, needed, total) AS (VALUES " + ", ".join(f"('{p}', {i}, '{m}', {_NEEDED[p]}, {len(ms)})" for p, ms in _MARKERS.items() for i, m in enumerate(ms)) + """)
SELECT doc_id, persona, coalesce(string_agg(CASE WHEN contains(lower(text), marker) THEN marker END, '|' ORDER BY pos), '') AS markers, count(CASE WHEN contains(lower(text), marker) THEN 1 END)::BIGINT AS n_found,
round(least(count(CASE WHEN contains(lower(text), marker) THEN 1 END) / max(total)::DOUBLE * 10, 10::DOUBLE), 6) AS score, count(CASE WHEN contains(lower(text), marker) THEN 1 END) >= max(needed) AS valid FROM documents, m GROUP BY doc_id, persona
UNION ALL SELECT doc_id, 'silent', '', 0, 10.0::DOUBLE, true FROM documents""")
def k9_marker_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = S.marker_coverage(table(spark, sf_dir, "documents"), S.marker_table(spark, _MARKERS, _NEEDED), id_column="doc_id")
    return found.select("doc_id", "persona", F.array_join("markers_found", "|").alias("markers"), "n_found", F.round("score", 6).alias("score"), "valid")


_RULES = ((("src1",), ("view", "click")), (("src2", "src3"), ("error",)))


@query("""WITH s AS (SELECT user_id AS moment_id, 'src' || (user_id % 5)::VARCHAR AS topic, event_type AS persona, round(max(value), 4) AS persona_score, min(event_id) AS pos FROM events GROUP BY user_id, event_type),
r AS (SELECT *, CASE WHEN contains(topic, 'src1') THEN persona IN ('view', 'click') WHEN contains(topic, 'src2') OR contains(topic, 'src3') THEN persona = 'error' ELSE false END AS liked FROM s)
SELECT moment_id, persona, persona_score, CASE WHEN moment_id % 2 = 0 AND persona = 'error' THEN 7.5 ELSE 0.0 END::DOUBLE AS judge_score FROM (SELECT *, row_number() OVER (PARTITION BY moment_id ORDER BY (moment_id % 7 = 0 AND persona = 'purchase')::INTEGER DESC, liked::INTEGER DESC, persona_score DESC, pos) AS n FROM r) WHERE n = 1""")
def k10_winner(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    scripts = e.groupBy(F.col("user_id").alias("moment_id"), F.col("event_type").alias("persona")).agg(F.round(F.max("value"), 4).alias("persona_score"), F.min("event_id").alias("pos"))
    scripts = scripts.withColumns({"topic": F.concat(F.lit("src"), (F.col("moment_id") % 5).cast("string")), "override": F.when(F.col("moment_id") % 7 == 0, "purchase")})
    judged = e.filter("user_id % 2 = 0").select(F.col("user_id").alias("moment_id"), F.lit("error").alias("persona"), F.lit(7.5).alias("judge_score")).distinct()
    return S.pick_winner(scripts, rules=_RULES, judged=judged).select("moment_id", "persona", "persona_score", "judge_score")


@query(r"""WITH w AS (SELECT doc_id, len(list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '')) AS n FROM documents), d AS (SELECT doc_id, n, ceil(n / 150.0::DOUBLE * 60) AS s FROM w)
SELECT doc_id, concat_ws('|', CASE WHEN n < 80 THEN 'too_few_words' END, CASE WHEN n > 170 THEN 'too_many_words' END, CASE WHEN s < 25 THEN 'too_short' END, CASE WHEN s > 50 THEN 'too_long' END) AS warnings FROM d""")
def k11_script_warnings(spark: SparkSession, sf_dir: str) -> DataFrame:
    from plenum.functions.text import count_words, plain_seconds

    rows = table(spark, sf_dir, "documents").select("doc_id", count_words(_text()).alias("word_count"), plain_seconds(_text()).alias("estimated_duration"))
    return S.script_warnings(rows).select("doc_id", F.array_join("warnings", "|").alias("warnings"))


@query("""WITH v AS (SELECT event_id, ts, DATE '2024-01-15' AS day, CASE WHEN user_id % 2 = 0 THEN 'Parliament Sitting' ELSE 'News' END AS title, (user_id % 4) * 1800 AS s, event_id % 5 = 0 AS live, CASE WHEN event_id % 3 = 0 THEN 'debate by Mr Tan' ELSE 'x' END AS d FROM events),
k AS (SELECT *, abs(floor((epoch_us(ts) // 1000000 - epoch(day)) / 86400.0)) AS days FROM v)
SELECT event_id, CASE WHEN days = 0 THEN 4.0 WHEN days <= 1 THEN 3.0 WHEN days <= 2 THEN 1.0 ELSE 0.0 END::DOUBLE + CASE WHEN title = 'News' THEN 0.0 ELSE 2.0 END::DOUBLE + CASE WHEN s >= 3600 THEN 2.0 WHEN s >= 1800 THEN 1.0 ELSE 0.0 END::DOUBLE + CASE WHEN live THEN 1.0 ELSE 0.0 END::DOUBLE + CASE WHEN d = 'x' THEN 0.0 ELSE 1.0 END::DOUBLE AS confidence,
concat_ws('|', CASE WHEN days <= 2 THEN 'date_match' END, CASE WHEN title <> 'News' THEN 'title_keywords_match' END, CASE WHEN s >= 3600 THEN 'duration_appropriate' END, CASE WHEN live THEN 'is_livestream' END, CASE WHEN d <> 'x' THEN 'description_keywords' END) AS criteria FROM k""")
def k12_match_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    u, e = F.col("user_id"), F.col("event_id")
    title = F.when(u % 2 == 0, "Parliament Sitting").otherwise("News")
    factors = S.match_factors(F.col("ts"), F.lit("2024-01-15").cast("date"), title, F.concat(F.lit("PT"), ((u % 4) * 30).cast("string"), F.lit("M")), F.when(e % 5 == 0, F.col("ts")), F.when(e % 3 == 0, "debate by Mr Tan").otherwise("x"), F.array(F.lit("Mr Tan")))
    confidence, criteria = S.match_confidence(factors)
    return table(spark, sf_dir, "events").select("event_id", confidence.alias("confidence"), F.array_join(criteria, "|").alias("criteria"))


@query("""SELECT event_id, event_type AS model, round(event_id / 1e6 * CASE event_type WHEN 'view' THEN 0.25 WHEN 'click' THEN 1.0 END, 9) AS input_cost, round(event_id / 1e6 * CASE event_type WHEN 'view' THEN 0.25 WHEN 'click' THEN 1.0 END + user_id / 1e6 * CASE event_type WHEN 'view' THEN 2.0 WHEN 'click' THEN 4.0 END, 9) AS total_cost FROM events""")
def k13_usage_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    usage = table(spark, sf_dir, "events").select("event_id", F.col("event_type").alias("model"), F.col("event_id").alias("prompt_tokens"), F.col("user_id").alias("completion_tokens"))
    return S.usage_cost(usage, S.price_table(spark, (("view", 0.25, 2.0), ("click", 1.0, 4.0)))).select("event_id", "model", F.round("input_cost", 9).alias("input_cost"), F.round("total_cost", 9).alias("total_cost"))


@query(rf"""WITH c AS (SELECT conv_id, turn, role, text, {_JARGON} * 2 + ({_QUOTE}) + CASE WHEN {_CONTRA} THEN 2.0 ELSE 0.0 END::DOUBLE + CASE WHEN {_ANY('text', DAILY)} THEN 1.5 ELSE 0.0 END::DOUBLE + 0.9::DOUBLE AS raw, len(list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '')) AS n FROM conversations),
s AS (SELECT *, round(least(raw, 10::DOUBLE), 6) AS score, coalesce(lag(role || ': ' || text) OVER (PARTITION BY conv_id ORDER BY turn), '') AS b, coalesce(lead(role || ': ' || text) OVER (PARTITION BY conv_id ORDER BY turn), '') AS a,
sum(n) OVER (PARTITION BY conv_id)::BIGINT AS n_words, count(*) OVER (PARTITION BY conv_id)::BIGINT AS n_segments FROM c),
r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY score DESC, turn) AS rank FROM s)
SELECT conv_id, turn, score, rank::INTEGER AS rank, md5(b) AS context_before, md5(a) AS context_after, n_segments, n_words FROM r WHERE rank <= 3""")
def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three best-scored turns of each conversation, with their context and the conversation's totals."""
    from plenum.operators.aggregates import roll_up
    from plenum.operators.chunking import with_context
    from plenum.operators.ranking import best

    turns = table(spark, sf_dir, "conversations")
    none = F.lit(0.0)
    score = F.round(S.final_score(none, S.jargon_score(_text(), JARGON), S.contradicts(_text(), PAIRS), S.quotability(_text()), S.everyday(_text(), DAILY), F.lit(0.3)), 6)
    scored = with_context(turns, session="conv_id", order="turn", speaker="role").withColumn("score", score)
    totals = roll_up(turns, session="conv_id", order="turn", speaker="role").select("conv_id", "n_segments", "n_words")
    top = best(scored, group="conv_id", score="score", order="turn", limit=3)
    return top.join(totals, "conv_id").select("conv_id", "turn", "score", "rank", F.md5("context_before").alias("context_before"), F.md5("context_after").alias("context_after"), "n_segments", "n_words")
