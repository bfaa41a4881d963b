"""Operators that work in blocks, ranges and sweeps, against plain passes; projections and clusters against linear algebra."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from plenum.operators import matching as M
from plenum.operators import vectors as V
from plenum.operators.ranking import rescored, semantic_dedup


def counted_cut(spark, tmp_path):
    seen = []

    def cut(df):
        path = f"{tmp_path}/{len(seen)}"
        seen.append(path)
        df.write.parquet(path)
        return spark.read.schema(df.schema).parquet(path)

    return cut, seen


@pytest.mark.parametrize("block_edges", [200_000, 1500])
def test_a_long_chain_takes_few_rounds(spark, tmp_path, block_edges):
    n = 10_000
    rows = spark.range(n).withColumn("pos", F.col("id"))
    edges = spark.range(n - 1).select(F.col("id").alias("earlier"), (F.col("id") + 1).alias("later"), F.lit(0.9).alias("similarity"))
    cut, seen = counted_cut(spark, tmp_path)
    kept, log = semantic_dedup(rows, edges, id_column="id", order="pos", checkpoint=cut, block_edges=block_edges)
    assert kept.filter("id % 2 = 1").count() == 0 and kept.count() == n // 2 and log.filter("kept <> removed - 1").count() == 0 and log.count() == n // 2
    # Two tables a round, and two at the start: a round for each range that the chain crosses.
    assert len(seen) <= 2 + 2 * (n // block_edges + 2)


def test_ranges_decide_as_the_greedy_pass(spark, tmp_path):
    for seed in range(2):
        rng = random.Random(seed)
        place = list(range(300))
        rng.shuffle(place)
        edges = sorted({(a, b) for a, b in ((rng.randrange(300), rng.randrange(300)) for _ in range(900)) if place[a] < place[b]})
        kept = []
        for i in sorted(range(300), key=place.__getitem__):
            if not any((k, i) in edges for k in kept):
                kept.append(i)
        cut, _ = counted_cut(spark, tmp_path / str(seed))
        rows = spark.createDataFrame([(i, p) for i, p in enumerate(place)], "id long, pos int")
        got, _ = semantic_dedup(rows, spark.createDataFrame([(a, b, 0.9) for a, b in edges], "earlier long, later long, similarity double"), id_column="id", order="pos", checkpoint=cut, block_edges=100)
        assert sorted(r.id for r in got.collect()) == sorted(kept)
    with pytest.raises(ValueError, match="earlier to later"):
        semantic_dedup(rows, spark.createDataFrame([(1, 2, 0.9), (2, 1, 0.9)], "earlier long, later long, similarity double"), id_column="id", order="pos", checkpoint=cut)


def test_pairs_of_all_rows_are_exact(spark, monkeypatch):
    monkeypatch.setattr(V, "PAIR_BLOCK", 50)
    rng = np.random.default_rng(3)
    middles = rng.normal(size=(12, 6))
    rows = [(i, [float(x) for x in middles[i % 12] + 0.4 * rng.normal(size=6)]) for i in range(500)]
    rows += [(1000 + i, [float(x) for x in rng.normal(size=3)]) for i in range(40)] + [(2000, None), (None, [1.0] * 6), (2001, [0.0] * 6), (2002, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (2003, [float("nan")] * 6), (2004, [1e200] * 6)]
    frame = spark.createDataFrame(rows, "id long, embedding array<double>").repartition(3)
    good = [(i, np.array(v) / np.abs(v).max()) for i, v in rows[:540]]
    good = [(i, v / np.linalg.norm(v)) for i, v in good]
    for threshold, pivots in ((0.95, 64), (0.8, 5), (0.3, 20)):
        expected = {(a, b) for a, v in good for b, w in good if a < b and len(v) == len(w) and v @ w > threshold}
        got = [(r.a, r.b) for r in V.similar_pairs_of_all(frame, id_column="id", threshold=threshold, pivots=pivots).collect() if 2004 not in (r.a, r.b)]
        assert len(got) == len(set(got)) and set(got) == expected


def test_clustered_vectors_visit_few_cells(spark):
    rng = np.random.default_rng(5)
    middles = rng.normal(size=(40, 32))
    rows = [(i, [float(x) for x in middles[i % 40] + 0.05 * rng.normal(size=32)]) for i in range(2000)]
    frame = spark.createDataFrame(rows, "id long, embedding array<double>")
    plan_rows = V.similar_pairs_of_all(frame, id_column="id", threshold=0.95)
    assert plan_rows.count() == 40 * 50 * 49 // 2


def test_projection_is_that_of_the_covariance(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(300, 5)) @ np.diag([5.0, 3.0, 1.0, 0.5, 0.1]) @ np.linalg.qr(rng.normal(size=(5, 5)))[0]
    got = V.project(spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "id long, embedding array<double>"), id_column="id").orderBy("id").collect()
    values, axes = np.linalg.eigh(np.cov(x.T))
    plain = x @ axes[:, ::-1][:, :2]
    found = np.array([r.projection for r in got])
    assert found.shape == (300, 2)
    for k in range(2):
        assert min(np.abs(found[:, k] - plain[:, k]).max(), np.abs(found[:, k] + plain[:, k]).max()) < 1e-6


def test_clusters_have_the_means_of_their_members(spark):
    rng = np.random.default_rng(9)
    middles = rng.normal(size=(4, 8)) * 10
    x = np.array([middles[i % 4] + rng.normal(size=8) for i in range(400)])
    found, centers = V.cluster(spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "id long, embedding array<double>"), 4, id_column="id")
    of = {r.id: r.cluster_id for r in found.collect()}
    held = {r.cluster_id: np.array(r.centroid) for r in centers.collect()}
    assert len(held) == 4 and all(len({of[i] for i in range(k, 400, 4)}) == 1 for k in range(4))
    for c, middle in held.items():
        members = [i for i in of if of[i] == c]
        assert np.abs(x[members].mean(axis=0) - middle).max() < 1e-6
        assert all(min(held, key=lambda o: ((x[i] - held[o]) ** 2).sum()) == c for i in members)


def test_ranks_over_all_rows_of_one_score(spark):
    rows = spark.range(5000).select(F.col("id").alias("moment_id"), F.lit(7.0).alias("viral_score"), (F.col("id") * 7919 % 5003).alias("pos"))
    got = rescored(rows, rows.limit(0).select("moment_id", F.lit(1.0).alias("final_score"))).select("pos", "rank").collect()
    assert [r["rank"] for r in sorted(got, key=lambda r: r.pos)] == list(range(1, 5001))


def words_and_cues(seed, n=60):
    rng = random.Random(seed)
    words = ["a", "be", "cat", "door", "every", "forest", "garden", "house"]
    cues = [(s, i, " ".join(rng.choice(words) for _ in range(rng.choice([0, 1, 2, 3, 5])))) for s in range(2) for i in range(n)]
    quotes = [(f"q{k}", rng.randrange(2), " ".join(rng.choice([*words, "unknown"]) for _ in range(rng.randrange(1, 9)))) for k in range(60)]
    return quotes, cues


def test_overlap_match_against_a_plain_pass(spark):
    quotes, cues = words_and_cues(4)
    expected = {}
    for name, s, text in quotes:
        own, q = [set(c[2].split()) for c in cues if c[0] == s], set(text.split())
        scores = [len(q & set().union(*own[i : i + 10])) for i in range(len(own))]
        if max(scores):
            expected[name] = (scores.index(max(scores)), round(max(scores) / len(q), 9))
    got = M.overlap_match(spark.createDataFrame(quotes, "quote_id string, session int, text string"), spark.createDataFrame(cues, "session int, idx int, text string"))
    assert {r.quote_id: (r["at"], round(r.score, 9)) for r in got.collect()} == expected


def test_frequent_words_take_a_row_for_each_cue(spark):
    cues = spark.range(20_000).select(F.lit(1).alias("session"), F.col("id").cast("int").alias("idx"), F.concat(F.lit("the of and word"), (F.col("id") % 500).cast("string")).alias("text"))
    quotes = spark.range(200).select(F.col("id").cast("string").alias("quote_id"), F.lit(1).alias("session"), F.concat(F.lit("the of word"), (F.col("id") % 500).cast("string")).alias("text"))
    got = {r.quote_id: (r["at"], r.score) for r in M.overlap_match(quotes, cues).collect()}
    assert len(got) == 200 and got["150"] == (141, 1.0) and got["3"] == (0, 1.0)


def test_runs_of_thirty_cues_against_a_plain_pass(spark):
    from test_gold import slow_fuzzy

    quotes, cues = words_and_cues(6, 40)
    got = M.fuzzy_match(spark.createDataFrame(quotes, "quote_id string, session int, text string"), spark.createDataFrame(cues, "session int, idx int, text string"), most=30)
    found = {r.quote_id: ((r["at"], r["size"]), round(r.score, 9)) for r in got.collect()}
    expected = {name: slow_fuzzy(text, [c[2] for c in cues if c[0] == s], 30) for name, s, text in quotes}
    assert found == {name: (best, round(score, 9)) for name, (best, score) in expected.items() if best}


def longest(a, b):
    n, last = 0, [0] * (len(b) + 1)
    for x in a:
        now = [0] * (len(b) + 1)
        for j, y in enumerate(b, 1):
            if x == y:
                now[j] = last[j - 1] + 1
                n = max(n, now[j])
        last = now
    return n


def test_common_substrings_of_all_lengths(spark):
    rng = random.Random(1)
    pairs = [(i, "".join(rng.choice("abü") for _ in range(rng.randrange(0, 40))), "".join(rng.choice("abü") for _ in range(rng.randrange(0, 40)))) for i in range(150)]
    pairs += [(900, "x" * 33, "x" * 70), (901, "", "abc"), (902, "abc", ""), (903, None, "a"), (904, "a", None), (905, "same text", "same text"), (906, "ab" * 600 + "Q" + "cd" * 500, "zz" + "b" + "ab" * 599 + "Q" + "cd" * 300)]
    got = {r.id: r.ratio for r in M.substring_ratio(spark.createDataFrame(pairs, "id int, a string, b string"), pair_id="id").collect()}
    assert got == {i: (longest(a, b) / len(a) if a and b else 0.0) for i, a, b in pairs}
