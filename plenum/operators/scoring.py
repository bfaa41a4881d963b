"""Scoring rules (K1-K13) as native expressions; lexicons, weights and scales are parameters."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plenum.functions import lexicons as L
from plenum.functions.text import contains_any, count_pieces, iso_duration

MARKERS_MOST = 10_000


def hits(text: Column, lexicon: Sequence[str]) -> Column:
    """How many different terms the lower-cased text contains; a sum of tests stays in generated code."""
    low, total = F.lower(text), F.lit(0)
    for term in lexicon:
        total = total + F.contains(low, F.lit(term.lower())).cast("int")
    return total


def jargon_score(text: Column, lexicon: Sequence[str] = L.JARGON) -> Column:
    """K1: terms per ten words, 1 at most."""
    return F.least(hits(text, lexicon) / F.greatest(count_pieces(text) / 10.0, F.lit(1.0)), F.lit(1.0))


def contradicts(text: Column, pairs: Sequence[tuple[Sequence[str], Sequence[str]]] = L.CONTRADICTIONS) -> Column:
    """K2: whether a pair of word groups has a word of either group in the text."""
    found = F.lit(False)
    for first, second in pairs:
        found = found | (contains_any(text, first) & contains_any(text, second))
    return found


def everyday(topic: Column, lexicon: Sequence[str] = L.EVERYDAY) -> Column:
    """K3."""
    return contains_any(topic, lexicon)


def quotability(text: Column) -> Column:
    """K4: by word count; best from 15 to 40."""
    n = count_pieces(text)
    return F.when(n < 10, 0.3).when(n < 15, 0.6 + (n - 10) / 5.0 * 0.4).when(n <= 40, 1.0).when(n <= 60, 0.7).otherwise(0.4)


def tone_strength(tone: Column, strong: Sequence[str] = L.STRONG_TONES, medium: Sequence[str] = L.MEDIUM_TONES) -> Column:
    """K5."""
    return F.when(contains_any(tone, strong), 1.0).when(contains_any(tone, medium), 0.6).otherwise(0.3)


WEIGHTS = {"ai": 0.4, "jargon": 2.0, "contradiction": 2.0, "quotability": 1.0, "everyday": 1.5, "tone": 3.0}


def final_score(ai: Column, jargon: Column, contradiction: Column, quote: Column, daily: Column, tone: Column, weights: Mapping[str, float] = WEIGHTS) -> Column:
    """K6: weighted sum of the parts, 10 at most."""
    flag = lambda c, w: F.when(c, F.lit(w)).otherwise(F.lit(0.0))
    total = ai * weights["ai"] + jargon * weights["jargon"] + flag(contradiction, weights["contradiction"]) + quote * weights["quotability"] + flag(daily, weights["everyday"]) + tone * weights["tone"]
    return F.least(total, F.lit(10.0))


def adjusted_score(base: Column, demographic: Column, quote: Column) -> Column:
    """K7: a favoured audience adds .5, a quote of over 250 characters costs 1; kept within 0 and 10."""
    gain = F.when(F.coalesce(F.contains(demographic, F.lit("Gen Z")), F.lit(False)), 0.5).otherwise(0.0)
    loss = F.when(F.coalesce(F.length(quote) > 250, F.lit(False)), 1.0).otherwise(0.0)
    return F.greatest(F.lit(0.0), F.least(base + gain - loss, F.lit(10.0)))


def boosted_score(ai: Column, jargon: Column, contradiction: Column, daily: Column) -> Column:
    """K8."""
    flag = lambda c, w: F.when(c, F.lit(w)).otherwise(F.lit(0.0))
    return F.least(ai + flag(jargon, 1.0) + flag(contradiction, 1.5) + flag(daily, 1.0), F.lit(10.0))


def score_moments(analyses: DataFrame) -> DataFrame:
    """K6 over the ``analyses`` table: adds ``viral_score``."""
    c = F.col
    contradiction = F.coalesce(c("has_contradiction"), F.lit(False)) | contradicts(c("quote"))
    daily = F.coalesce(c("affects_everyday_life"), F.lit(False)) | everyday(c("topic"))
    return analyses.withColumn("viral_score", final_score(c("ai_score"), jargon_score(c("quote")), contradiction, quotability(c("quote")), daily, tone_strength(c("emotional_tone"))))


def marker_table(spark: SparkSession, markers: Mapping[str, Sequence[str]] = L.PERSONA_MARKERS, needed: Mapping[str, int] = L.MARKERS_NEEDED) -> DataFrame:
    """(persona, position, marker, needed, total): a lexicon as a table; a persona without markers has one row, whose marker is null."""
    rows = [(p, i, m if m is None else m.lower(), needed.get(p, 2), len(ms)) for p, ms in markers.items() for i, m in enumerate(ms or [None])]
    return spark.createDataFrame(rows, "persona string, position int, marker string, needed int, total int")


def marker_coverage(texts: DataFrame, markers: DataFrame, *, id_column: str, text_column: str = "text", scale: float = 10.0) -> DataFrame:
    """K9: per text and persona the markers found, their count, score on the scale, and whether there are enough.

    A persona without markers is always valid and has the full score. The lexicon, of at most ``MARKERS_MOST`` rows (more
    are an error), is folded into one array per persona, so texts are widened by persona only and never shuffled.
    """
    rows = markers.select("persona", "needed", "total", "position", "marker").limit(MARKERS_MOST + 1).collect()
    if len(rows) > MARKERS_MOST:
        raise ValueError(f"a lexicon has at most {MARKERS_MOST} markers")
    held: dict[tuple, list] = {}
    for r in sorted(rows, key=lambda r: (r["persona"], r["position"])):
        held.setdefault((r["persona"], r["needed"], r["total"]), []).extend([r["marker"]] if r["marker"] is not None else [])
    low = F.lower(text_column)
    found = F.array(*(
        F.struct(F.lit(persona).alias("persona"), F.array_compact(F.array(*(F.when(F.contains(low, F.lit(m)), F.lit(m)) for m in own))).cast("array<string>").alias("markers_found"), F.lit(needed).alias("needed"), F.lit(total).alias("total"))
        for (persona, needed, total), own in held.items()
    ))
    told = texts.select(id_column, F.explode(found).alias("p")).select(id_column, "p.*")
    n, none = F.size("markers_found"), F.col("total") == 0
    score = F.when(none, F.lit(scale)).otherwise(F.least(n / F.nullif(F.col("total"), F.lit(0)) * scale, F.lit(scale)))
    return told.select(id_column, "persona", "markers_found", n.cast("long").alias("n_found"), score.alias("score"), (none | (n >= F.col("needed"))).alias("valid"))


def affinity(topic: Column, persona: Column, rules: Sequence = L.AFFINITIES) -> Column:
    """Whether the first rule that the topic meets favours the persona."""
    out = None
    for words, favoured in rules:
        out = (F.when if out is None else out.when)(contains_any(topic, words), persona.isin(*favoured))
    return out.otherwise(F.lit(False))


def pick_winner(scripts: DataFrame, *, item: str = "moment_id", rules: Sequence = L.AFFINITIES, judged: DataFrame | None = None) -> DataFrame:
    """One script per item: a manual override if any, else a favoured persona, else the best score; ties to the first position.

    ``scripts`` has item, topic, persona, persona_score, pos and may have ``override``; ``judged`` (item, persona,
    judge_score) adds the judge's score, 0 where it gave none.
    """
    forced = F.coalesce(F.col("override") == F.col("persona"), F.lit(False)) if "override" in scripts.columns else F.lit(False)
    order = Window.partitionBy(item).orderBy(forced.desc(), affinity(F.col("topic"), F.col("persona"), rules).desc(), F.desc("persona_score"), "pos")
    best = scripts.withColumn("_n", F.row_number().over(order)).filter("_n = 1").drop("_n")
    if judged is not None:
        best = best.join(judged.select(item, "persona", "judge_score"), [item, "persona"], "left").withColumn("judge_score", F.coalesce("judge_score", F.lit(0.0)))
    return best


def script_warnings(scripts: DataFrame) -> DataFrame:
    """What is out of bounds (80 to 170 words, 25 to 50 seconds), as an array."""
    words, seconds = F.col("word_count"), F.col("estimated_duration")
    rules = [F.when(words < 80, "too_few_words"), F.when(words > 170, "too_many_words"), F.when(seconds < 25, "too_short"), F.when(seconds > 50, "too_long")]
    return scripts.withColumn("warnings", F.array_compact(F.array(*rules)))


def day_distance(at: Column, day: Column) -> Column:
    """Whole days between a time and the start of a day, floored before the sign goes: an hour before midnight is one day off."""
    return F.abs(F.floor((F.unix_timestamp(at.cast("timestamp")) - F.unix_timestamp(day.cast("timestamp"))) / 86400))


def match_factors(at: Column, day: Column, title: Column, duration: Column, live: Column, description: Column, speakers: Column | None = None) -> dict[str, tuple[Column, Column]]:
    """Points and truth of each factor of a video's match with a session."""
    from plenum.functions.text import PARLIAMENT_WORDS

    days, seconds = day_distance(at, day), iso_duration(duration)
    named = F.lit(False) if speakers is None else F.coalesce(F.exists(speakers, lambda s: F.contains(description, s) | F.contains(title, s)), F.lit(False))
    told = F.coalesce(contains_any(description, PARLIAMENT_WORDS), F.lit(False))
    titled = F.coalesce(contains_any(title, PARLIAMENT_WORDS), F.lit(False))
    return {
        "date_match": (F.when(days == 0, 4.0).when(days <= 1, 3.0).when(days <= 2, 1.0).otherwise(0.0), days <= 2),
        "title_keywords_match": (F.when(titled, 2.0).otherwise(0.0), titled),
        "duration_appropriate": (F.when(seconds >= 3600, 2.0).when(seconds >= 1800, 1.0).otherwise(0.0), seconds >= 3600),
        "is_livestream": (F.when(live.isNotNull(), 1.0).otherwise(0.0), live.isNotNull()),
        "description_keywords": (F.when(told, 0.5).otherwise(0.0) + F.when(named, 0.5).otherwise(0.0), told | named),
    }


def match_confidence(factors: dict[str, tuple[Column, Column]]) -> tuple[Column, Column]:
    """The capped sum of points and the list of true factors."""
    total = F.lit(0.0)
    for points, _ in factors.values():
        total = total + F.coalesce(points, F.lit(0.0))
    return F.least(total, F.lit(10.0)), F.array_compact(F.array(*(F.when(true, F.lit(name)) for name, (_, true) in factors.items())))


def price_table(spark: SparkSession, prices: Sequence = L.PRICES) -> DataFrame:
    return spark.createDataFrame(list(prices), "model string, input_price double, output_price double")


def usage_cost(usage: DataFrame, prices: DataFrame) -> DataFrame:
    """Adds input_cost, output_cost and total_cost by a price table per million tokens; null for a model without price.

    The price table is small by nature; Spark broadcasts it when its own size estimate says so.
    """
    joined = usage.join(prices, "model", "left").withColumns({"input_cost": F.col("prompt_tokens") / 1e6 * F.col("input_price"), "output_cost": F.col("completion_tokens") / 1e6 * F.col("output_price")})
    return joined.withColumn("total_cost", F.col("input_cost") + F.col("output_cost")).drop("input_price", "output_price")
