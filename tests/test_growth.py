"""Steps whose work has to grow with their rows, and not with pairs of them."""

from __future__ import annotations

import datetime
import random

import numpy as np
from pyspark.sql import Window
from pyspark.sql import functions as F

from plenum.operators import matching as M
from plenum.operators import vectors as V


def test_best_in_window_meets_a_day_and_not_its_sessions(spark):
    """sessions of one day share one best video, so scores are computed by day; ties, nulls and bounds as by all pairs."""
    day = datetime.date(2024, 1, 10)
    at = lambda n: day + datetime.timedelta(days=n)
    sessions = [(i, at(i % 3)) for i in range(120)] + [(500, None), (501, at(400))]
    videos = [(i, at(i % 9 - 3), float(i % 7)) for i in range(120)] + [(900, None, 9.0), (901, at(0), None)]
    met = spark.sparkContext.accumulator(0)

    def counted(q):
        met.add(1)
        return q

    days = F.abs(F.datediff("published", "day"))
    frame = spark.createDataFrame(sessions, "session int, day date")
    found = M.best_in_window(frame, spark.createDataFrame(videos, "video int, published date, q double"), session="session", day="day", video="video", published="published", score=F.udf(counted, "double")("q") + 5 - days)
    got = {r.session: (r.video, r.confidence) for r in found.collect()}
    expected = {}
    for session, d in sessions:
        near = [(-(q + 5 - abs((p - d).days)), v) for v, p, q in videos if d and p and q is not None and -2 <= (p - d).days <= 3]
        score, video = min((x for x in near if -x[0] >= 5), default=(None, None))
        expected[session] = (video, None if score is None else -score)
    assert got == expected
    assert met.value < 3000, "120 videos and 3 days, not 120 sessions"


def test_top_k_scores_blocks_and_gives_what_all_pairs_give(spark, monkeypatch):
    """Odd vectors, copies and ties across blocks as by every pair; no pair becomes a row."""
    rng = np.random.default_rng(3)
    rows = [(i, i % 2, [float(x) for x in rng.normal(size=6)]) for i in range(90)]
    rows += [(100 + i, i % 2, rows[i % 3][2]) for i in range(40)] + [(200 + i, 0, [2 * x for x in rows[0][2]]) for i in range(9)]
    rows += [(300, 0, None), (301, 1, []), (302, 0, [0.0] * 6), (303, 0, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (304, 1, [float("nan")] + [1.0] * 5), (305, 0, [float("inf")] + [1.0] * 5)]
    rows += [(306, 0, [1.0, 2.0]), (307, 1, [1e200] * 6), (308, None, rows[1][2]), (309, 0, [1e-170] * 6), (310, 1, [0.0, 0.0]), (None, 0, rows[0][2])]
    frame = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>").repartition(3)
    asked = frame.filter("vec_id % 4 = 0 OR vec_id >= 300").select(F.col("vec_id").alias("query_id"), "label", "embedding")
    monkeypatch.setattr(V, "ROW_BLOCK", 40)
    monkeypatch.setattr(V, "QUERY_BLOCK", 16)
    for on, least, k in ((["label"], None, 5), ([], None, 7), ([], 0.3, 5)):
        q = asked.select("query_id", *on, F.col("embedding").alias("q"))
        met = (frame.join(q, on) if on else frame.crossJoin(q)).withColumn("score", V.cosine(F.col("embedding"), F.col("q")))
        met = met if least is None else met.filter(F.col("score") >= least)
        ranked = met.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))).filter(F.col("rank") <= k)
        found = V.top_k(asked if on else asked.drop("label"), frame, k, on=on, least=least)
        told = lambda df: sorted((r.query_id, r["rank"], str(r.vec_id), r.label, str(r.score)) for r in df.collect())
        assert told(found) == told(ranked) and told(found)
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "FlatMapCoGroupsInArrow" in plan and "zip_with" not in plan
    assert V.top_k(asked.drop("label"), frame.limit(0)).count() == 0


def test_matching_sends_no_exploded_side_to_the_driver(spark):
    """sides that an explode or a run of texts makes large looked small to Spark and were broadcast."""
    quotes = spark.createDataFrame([("a", 1, "of the house"), ("b", 1, "the"), ("c", 2, "x y")], "quote_id string, session int, text string")
    cues = spark.createDataFrame([(1, 0, 0.0, 1.0, "speaker of the"), (1, 1, 1.0, 2.0, "house sits"), (2, 0, 0.0, 1.0, "ax yard")], "session int, idx int, t_start double, t_end double, text string")
    for match in (M.exact_match, M.overlap_match, M.fuzzy_match, M.single_cue_match):
        assert "BroadcastHashJoin" not in match(quotes, cues)._jdf.queryExecution().executedPlan().toString()
    assert {r.quote_id: (r["at"], r["size"]) for r in M.exact_match(quotes, cues).collect()} == {"a": (0, 2), "b": (0, 1), "c": (0, 1)}


def test_pair_searches_hold_two_blocks(spark, monkeypatch):
    """a task takes one meeting of two blocks at a time; blocks and strips do not change the pairs."""
    monkeypatch.setattr(V, "PAIR_BLOCK", 16)
    rng = np.random.default_rng(4)
    rows = [(i, i % 2, [float(x) for x in rng.normal(size=4)]) for i in range(120)]
    frame = spark.createDataFrame(rows, "id long, g int, embedding array<double>")
    near = lambda a, b: np.dot(a, b) / np.linalg.norm(a) / np.linalg.norm(b) > 0.8
    for found, one in ((V.similar_pairs(frame, id_column="id", group="g", threshold=0.8), True), (V.similar_pairs_of_all(frame, id_column="id", threshold=0.8, pivots=5), False)):
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "FlatMapGroupsInArrow" in plan and "collect_list" not in plan
        assert sorted((r.a, r.b) for r in found.collect()) == [(i, j) for i, g, v in rows for j, h, w in rows[i + 1 :] if (not one or g == h) and near(v, w)]


def test_fuzzy_match_scores_blocks_and_not_starts(spark):
    """a quote met every start of a session, with the texts of its run; now it meets blocks of cues, whose size changes nothing."""
    from test_blocks import words_and_cues
    from test_gold import slow_fuzzy

    quotes, cues = words_and_cues(7, 70)
    cues += [(2, i, t) for i, t in enumerate(["the Fores", *[""] * 40, "ts' gar", "den-house", "", "forests gar", *["a be"] * 45])] + [(3, 0, ""), (3, 1, None)]
    quotes += [("inner", 2, "orests ga"), ("far", 2, "fores ts"), ("part", 2, "or"), ("two", 2, "ts gar"), ("end", 2, "a be a be a be"), ("none", 2, "--"), ("null", 2, None), ("bare", 3, "a be"), ("lost", 9, "a be")]
    told = [(s, i, t or "") for s, i, t in cues]
    expected = {name: slow_fuzzy(text, [c[2] for c in told if c[0] == s], 9) for name, s, text in quotes if text not in (None, "--")}
    expected = {name: (best, round(score, 9)) for name, (best, score) in expected.items() if best}
    q, c = spark.createDataFrame(quotes, "quote_id string, session int, text string"), spark.createDataFrame(cues, "session int, idx int, text string")
    for block in (4, 128):
        found = M.fuzzy_match(q, c, most=9, block=block)
        assert {r.quote_id: ((r["at"], r["size"]), round(r.score, 9)) for r in found.collect()} == expected
    assert len(expected) > 50 and "collect_list(c#" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_single_cue_match_moves_texts_and_no_parts_of_words(spark):
    """words were cut into runs of four letters, many times their text; blocks of any size give what a plain pass gives."""
    rng = random.Random(8)
    words = ["a", "cat", "door", "indoor", "every", "forest", "forests", "garden", "house"]
    cues = [(s, i, float(i), i + 0.5, " ".join(rng.choice(words) for _ in range(rng.choice([0, 1, 3, 6, 9])))) for s in range(2) for i in range(50)] + [(2, 0, 0.0, 1.0, None), (2, 1, 1.0, None, "Every-door"), (2, 2, 2.0, 3.0, "")]
    quotes = [(f"q{k}", k % 2, " ".join(rng.choice([*words, "fore", "unknown"]) for _ in range(rng.randrange(1, 9)))) for k in range(80)]
    quotes += [("odd", 2, "ever, very"), ("short", 2, "a be"), ("bare", 2, ""), ("null", 2, None), ("lost", 9, "door")]
    form = lambda t: " ".join("".join(x if x.isalnum() else " " for x in t.lower()).split())
    q, c = spark.createDataFrame(quotes, "quote_id string, session int, text string"), spark.createDataFrame(cues, "session int, idx int, t_start double, t_end double, text string")
    for share, block in ((0.7, 7), (0.7, 512), (0.0, 7)):
        expected = {}
        for name, s, text in quotes:
            own, w = [x for x in cues if x[0] == s], form(text or "").split(" ")
            hits = [i for i, x in enumerate(own) if text is not None and sum(len(y) > 3 and y in form(x[4] or "") for y in w) >= len(w) * share]
            if hits:
                ends = [x[3] for x in own[hits[0] : hits[0] + 6]]
                expected[name] = (hits[0], own[hits[0]][2], ends[-1])
        found = M.single_cue_match(q, c, share=share, block=block)
        assert {r.quote_id: (r["at"], r.start, r.end) for r in found.collect()} == expected and len(expected) > 20
    assert "substring(" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_pair_searches_write_vectors_once(spark, monkeypatch):
    """each vector was written once for every cell and block that it met; blocks are, and meet by reading, or with their group."""
    monkeypatch.setattr(V, "PAIR_BLOCK", 8)
    monkeypatch.setattr(V, "PAIR_HELD", 2, raising=False)
    rng = np.random.default_rng(6)
    rows = [(f"v{i:03}", i % 3, [float(x) for x in rng.normal(size=3 + (i % 5 == 0))]) for i in range(300)] + [("same", 0, [1.0, 2.0, 3.0])] * 30 + [("none", None, None), ("zero", 1, [0.0] * 3)]
    frame = spark.createDataFrame(rows, "id string, g int, embedding array<double>")
    near = lambda a, b: len(a) == len(b) and np.dot(a, b) / np.linalg.norm(a) / np.linalg.norm(b) > 0.6
    good = [(i, g, v) for i, g, v in rows if v and any(v)]
    for found, one in ((V.similar_pairs(frame, id_column="id", group="g", threshold=0.6), True), (V.similar_pairs_of_all(frame, id_column="id", threshold=0.6, pivots=7), False)):
        assert sorted((r.a, r.b) for r in found.collect()) == sorted((min(i, j), max(i, j)) for k, (i, g, v) in enumerate(good) for j, h, w in good[k + 1 :] if i != j and (not one or g == h) and near(v, w))
        plan = found._jdf.queryExecution().executedPlan().toString()
        # What repeats rows to let them meet repeats blocks, which stand below it.
        assert plan.find("Generate") < plan.find("FlatMapGroupsInArrow") and ("CartesianProduct" in plan) != one
    assert V.similar_pairs_of_all(frame.limit(0), id_column="id").count() == 0 and V.similar_pairs(frame.limit(0), id_column="id", group="g").count() == 0
