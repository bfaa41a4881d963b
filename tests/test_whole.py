"""Queries over whole texts and tables against plain passes."""

from plenum import plans

DATA = "/root/testdata/sf0.001"


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


def test_substring_ratio_of_whole_adjacent_turns(spark, tmp_path):
    rows = [(0, 0, "x" * 50 + "common part of both"), (0, 1, "y" * 70 + "common part of both!"), (0, 2, "part of both, once more"), (1, 0, ""), (1, 1, "z")]
    spark.createDataFrame(rows, "conv_id long, turn long, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    text = {r[:2]: r[2] for r in rows}
    expected = {f"{c}-{t}": round(longest(a, text[c, t + 1]) / len(a), 6) if a else 0.0 for (c, t), a in text.items() if (c, t + 1) in text}
    assert {r.pair_id: r.ratio for r in plans.queries()["j14_substring_ratio"](spark, str(tmp_path)).collect()} == expected


def test_attempts_of_all_users(spark, tmp_path):
    rows = [(1, 5, "2024-01-01 10:00:00", "error"), (2, 5000, "2024-01-02 10:00:00", "view")]
    spark.createDataFrame(rows, "event_id long, user_id long, ts string, event_type string").selectExpr("event_id", "user_id", "ts::timestamp AS ts", "event_type").write.parquet(f"{tmp_path}/events.parquet")
    got = plans.queries()["w2_attempt_outcomes"](spark, str(tmp_path)).collect()
    assert sorted((str(r.date), r.status) for r in got) == [("2024-01-01", "no_session"), ("2024-01-02", "done")]


def test_quotes_are_whole_turns(spark, tmp_path):
    lines = [f"line{i} has words{i} of its{i} own{i}" for i in range(10)]
    spark.createDataFrame([(0, 0, "\n".join(lines)), (0, 1, "short end here now")], "conv_id long, turn long, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = {r.quote_id: (r.pos, r["size"], r.score) for r in plans.queries()["j10_fuzzy_match"](spark, str(tmp_path)).collect()}
    # The first strictly best run, by start and then from long to short, holds both.
    assert got == {"0-0": (0, 11, 1.0), "0-1": (0, 11, 1.0)}
    assert {r.quote_id for r in plans.queries()["j9_exact_match"](spark, str(tmp_path)).collect()} == {"0-0", "0-1"}
