"""Stream twins on redelivered and unknown events, chunkers over long sessions, matchers against plain passes."""

import random
import time
from datetime import datetime

from pyspark.sql import functions as F

from plenum.operators import chunking as C
from plenum.operators import matching as M
from plenum.operators import scoring as S
from plenum.operators import vectors as V
from plenum.streaming import state as W


def at(second):
    return datetime(2024, 1, 1, 0, 0, second)


def run(spark, make, frames, folder, name):
    for frame in frames:
        frame.coalesce(1).write.mode("append").parquet(f"{folder}/in")
    stream = spark.readStream.schema(frames[0].schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    make(stream).writeStream.outputMode("update").format("memory").queryName(name).option("checkpointLocation", f"{folder}/c").trigger(availableNow=True).start().awaitTermination()
    return spark.table(name).collect()


def test_redelivered_attempts_are_the_same_in_batch_and_stream(spark, tmp_path):
    schema = "date string, attempt long, result string, at timestamp"
    rows = [[("a", 1, "error", at(1)), ("b", 1, "error", at(1)), ("c", 2, "ok", at(9))], [("a", 1, "ok", at(2)), ("b", 1, "ok", at(0)), ("c", 1, "error", at(3))], [("b", 2, "server_error", at(5)), ("b", 2, "server_error", at(5))]]
    got = run(spark, W.stream_attempts, [spark.createDataFrame(r, schema) for r in rows], tmp_path, "redelivered")
    last = {r.date: (r.status, r.attempts, r.last_checked) for r in sorted(got, key=lambda r: r.attempts)}
    whole = spark.createDataFrame(sum(rows, []), schema)
    assert last == {r.date: (r.status, r.attempts, r.last_checked) for r in W.attempt_outcomes(whole).collect()}
    assert {k: v[:2] for k, v in last.items()} == {"a": ("retry", 1), "b": ("no_session", 2), "c": ("done", 2)}


def test_unknown_job_events_are_the_same_in_batch_and_stream(spark, tmp_path):
    schema = "job_id string, at timestamp, event string, progress double, detail string"
    rows = [("1", at(0), "progress", 40.0, None), ("1", at(1), "ping", None, "hello"), ("2", at(0), "ping", 100.0, None), ("3", at(0), "fail", None, "boom"), ("3", at(1), "ping", None, None)]
    frame = spark.createDataFrame(rows, schema)
    got = {r.job_id: (r.status, r.progress, r.error) for r in run(spark, W.stream_jobs, [frame], tmp_path, "unknown") if r.error != "timeout"}
    twin = {r.job_id: (r.status, r.progress, r.error) for r in W.job_states(frame).collect()}
    assert {k: (s, None if p != p else p, e) for k, (s, p, e) in got.items()} == twin == {"1": ("rendering", None, None), "2": ("completed", None, None), "3": ("rendering", None, None)}


def test_token_chunks_carry_titles_and_tails(spark):
    rng = random.Random(5)
    rows = [("s", i, rng.choice(["A", "B", None, ""]), "w" * rng.randrange(1, 30), rng.choice([None, f"title {i}", ""])) for i in range(120)]
    frame = spark.createDataFrame(rows, "session string, ord int, speaker string, text string, title string")
    for most, overlap in ((20, 3), (8, 10), (50, 1)):
        held, speaker, title, chunks, n = "", None, None, [], 0
        for _, _, who, text, head in rows:
            told = f"{who}: {text}" if who else text
            if -(-len(held) // 4) + -(-len(told) // 4) > most and held:
                chunks.append((held.strip(), speaker, title, n))
                held, n = held[-4 * overlap :] + " ", 0
            held, n = held + told + " ", n + 1
            speaker, title = who or speaker, head or title
        chunks.append((held.strip(), speaker, title, n))
        got = C.by_tokens(frame, most=most, overlap=overlap, carried=("title",)).orderBy("chunk_index").collect()
        assert [(r.text, r.speaker, r.title, r.n_segments) for r in got] == chunks and [r.chunk_index for r in got] == list(range(len(chunks)))


def test_long_sessions_take_linear_time(spark):
    def seconds(n):
        rows = spark.range(n).select(F.lit("s").alias("session"), F.col("id").alias("ord"), F.lit("A").alias("speaker"), F.repeat(F.lit("w"), (F.col("id") % 40 + 10).cast("int")).alias("text"))
        start = time.perf_counter()
        assert C.by_tokens(rows).agg(F.sum("n_segments")).first()[0] == n
        return time.perf_counter() - start

    seconds(1000)
    small = min(seconds(10_000) for _ in range(2))
    assert seconds(40_000) < 5 * small + 2


def test_persona_without_markers_is_always_valid(spark):
    texts = spark.createDataFrame([(1, "lah and lor"), (2, None)], "id long, text string")
    got = S.marker_coverage(texts, S.marker_table(spark, {"none": (), "some": ("lah", "lor")}), id_column="id").collect()
    assert {(r.id, r.persona): (r.n_found, r.score, r.valid) for r in got} == {(1, "none"): (0, 10.0, True), (2, "none"): (0, 10.0, True), (1, "some"): (2, 10.0, True), (2, "some"): (0, 0.0, False)}


def quotes_and_cues(spark, seed):
    rng = random.Random(seed)
    words = ["a", "be", "cat", "door", "every", "forest", "garden", "house", "forests", "xhousey"]
    cues = [(s, i, float(i), i + 0.5, " ".join(rng.choice(words) for _ in range(rng.choice([0, 1, 1, 2, 3, 4, 6])))) for s in range(3) for i in range(25)]
    quotes = []
    for k in range(90):
        s = rng.randrange(3)
        own = [c[4] for c in cues if c[0] == s]
        i, n = rng.randrange(25), rng.randrange(1, 5)
        text = " ".join(own[i : i + n])
        cut = rng.randrange(0, 3)
        quotes.append((f"q{k}", s, rng.choice([text, text[cut:], text[: len(text) - cut], " ".join(rng.choice(words) for _ in range(rng.randrange(1, 7))), f"{rng.choice(words)} {text} {rng.choice(words)}"])))
    return quotes, cues, spark.createDataFrame(quotes, "quote_id string, session int, text string"), spark.createDataFrame(cues, "session int, idx int, t_start double, t_end double, text string")


def test_exact_match_against_a_plain_pass(spark):
    for seed in range(3):
        quotes, cues, q, c = quotes_and_cues(spark, seed)
        expected = {}
        for name, s, text in quotes:
            own, text = [x for x in cues if x[0] == s], " ".join(text.lower().split())
            for i in range(len(own)):
                runs = [" ".join(" ".join(x[4].split()) for x in own[i : i + n]) for n in range(1, min(10, len(own) - i) + 1)]
                hit = [n for n, run in enumerate(runs, 1) if text in run or run in text]
                if hit:
                    expected[name] = (i, hit[0], own[i][2], own[i + hit[0] - 1][3])
                    break
        assert {r.quote_id: (r["at"], r["size"], r.start, r.end) for r in M.exact_match(q, c).collect()} == expected and len(expected) > 60


def test_single_cue_match_against_a_plain_pass(spark):
    for seed in range(3):
        quotes, cues, q, c = quotes_and_cues(spark, seed)
        expected = {}
        for name, s, text in quotes:
            own, w = [x for x in cues if x[0] == s], " ".join(text.split()).split(" ")
            for i, x in enumerate(own):
                if sum(len(y) > 3 and y in " ".join(x[4].split()) for y in w) >= len(w) * 0.7:
                    expected[name] = (i, x[2], own[min(i + 5, len(own) - 1)][3])
                    break
        assert {r.quote_id: (r["at"], r.start, r.end) for r in M.single_cue_match(q, c).collect()} == expected and expected


def test_similar_pairs_meet_across_blocks(spark, monkeypatch):
    monkeypatch.setattr(V, "PAIR_BLOCK", 7)
    rng = random.Random(2)
    rows = [(i, i % 2, [rng.gauss(0, 1) for _ in range(4)] if i != 5 else [0.0] * 4) for i in range(60)] + [(100, 0, None), (None, 0, [1.0] * 4), (101, None, [1.0] * 4), (102, 0, [1.0, 2.0])]
    got = V.similar_pairs(spark.createDataFrame(rows, "id long, g int, embedding array<double>"), id_column="id", group="g", threshold=0.5).collect()
    cos = lambda a, b: sum(x * y for x, y in zip(a, b)) / (sum(x * x for x in a) * sum(y * y for y in b)) ** 0.5
    expected = {(a, b) for a, g, v in rows[:60] for b, h, w in rows[:60] if a < b and g == h and 5 not in (a, b) and cos(v, w) > 0.5}
    assert {(r.a, r.b) for r in got} == expected and len(got) == len(expected)
