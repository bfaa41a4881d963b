"""Hand-made frames: sources, parsing, windows, matching, dedup, state and streams."""

import datetime
import json

import pytest
from pyspark.sql import functions as F

from plenum.functions import text as X
from plenum.operators import chunking as C
from plenum.operators import matching as M
from plenum.operators import parsing as P
from plenum.operators import vectors as V
from plenum.operators.ranking import overlap_dedup, semantic_dedup
from plenum.sources import readers, writers
from plenum.streaming import state as W


def one(spark, expr, **values):
    return spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values)).select(expr.alias("x")).first()["x"]


def cut(df):
    return df.checkpoint()


@pytest.fixture(autouse=True)
def folder(spark, tmp_path_factory):
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("checkpoints")))


@pytest.mark.parametrize(("s", "n"), [("PT1H2M10S", 3730), ("PT45M", 2700), ("PT30S", 30), ("PT0S", 0), ("junk", 0)])
def test_iso_duration(spark, s, n):
    assert one(spark, X.iso_duration(F.col("s")), s=s) == n


@pytest.mark.parametrize(("s", "n"), [("12:00 AM", 0), ("12:00 PM", 43200), ("2:30 pm", 52200), ("12.00 noon", 43200), ("x", None)])
def test_clock(spark, s, n):
    assert one(spark, X.clock_seconds(F.col("s")), s=s) == n


def test_chapter_lines(spark):
    got = one(spark, X.chapter_lines(F.col("s")), s="Watch\n12:34 - Opening\n1:23:45 Debate\n[12:34] Close\n00:10 \nnone")
    assert [(r["seconds"], r["label"]) for r in got] == [(754.0, "Opening"), (5025.0, "Debate"), (754.0, "Close")]


def test_titled_names_keep_order(spark):
    assert one(spark, X.titled_names(F.col("s")), s="Ms Rahayu Mahzam and Mr Yip Hon Weng, then Ms Rahayu Mahzam") == ["Ms Rahayu Mahzam", "Mr Yip Hon Weng"]


def test_speeches_reset_by_section(spark):
    html = "<p>orphan</p><h6>1.30 pm</h6><p><strong>A:</strong> one</p><p>two</p><h6>Bill</h6><h6>1.32 pm</h6><p><strong>B</strong>: three <strong>x</strong></p><pre>no</pre>"
    rows = spark.createDataFrame([("s", 0, html), ("s", 1, "<p><strong>C</strong> four</p>")], "session string, section int, html string")
    got = P.speeches(rows, session="session", section="section").orderBy("section", "speech_no").collect()
    assert [(r.section, r.speaker, r.clock, r.text) for r in got] == [(0, "A", "1.30 pm", "A: one two"), (0, "B", "1.32 pm", "B : three x"), (1, "C", None, "C four")]


def test_session_files(spark, tmp_path):
    doc = {"metadata": {"sittingDate": "22-09-2025"}, "takesSectionVOList": [{"title": "T", "content": "<p><strong>A:</strong> something long enough to count here</p>", "subsections": [{"title": "", "content": "plain text without any marks that is long enough to be kept as one"}]}, {"title": "E", "content": ""}], "attendanceList": [{"mpName": "A", "attendance": True}, {"mpName": "B", "attendance": False}]}
    (tmp_path / "22-09-2025.json").write_text(json.dumps(doc))
    (tmp_path / "23-09-2025.json").write_text("{broken")
    (tmp_path / "24-09-2025.json").write_text(json.dumps({"format": "old", "cleanedContent": {"fullText": "x"}}))
    rows = readers.sessions(spark, str(tmp_path)).cache()
    good, bad = readers.validate(rows, readers.session_rules())
    assert {str(r.session_date) for r in good.collect()} == {"2025-09-22", "2025-09-24"}
    assert bad.first()["reasons"][0] == "not_json"
    assert {(str(r.session_date), r.route) for r in readers.routed(good).collect()} == {("2025-09-22", "structured"), ("2025-09-24", "old")}
    segments = P.session_segments(good.filter("takesSectionVOList IS NOT NULL"), session="session_date").orderBy("segment_index").collect()
    assert [(r.segment_index, r.speaker, r.subsection_title) for r in segments] == [(0, "A", None), (1, None, "Untitled Subsection")]
    assert good.filter("attendanceList IS NOT NULL").select(P.present_members(F.col("attendanceList")).alias("m")).first()["m"] == ["A"]


def test_caption_files_round_trip(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/parliament-22-09-2025.vtt").write_text("WEBVTT\nKind: captions\n\n00:00:01.000 --> 00:00:02.500 align:start\n&gt;&gt; Hello <c>there</c>\nsecond line\n\n00:01:00.000 --> 00:01:01.000\n \n\n1:00:00.000 --> 1:00:01.000\nlast\n")
    rows = readers.captions(spark, str(tmp_path / "in"))
    got = rows.orderBy("seq").collect()
    assert [(r.seq, r.t_start, r.t_end, r.text) for r in got] == [(0, 1.0, 2.5, "Hello there second line"), (1, 3600.0, 3601.0, "last")]
    assert str(got[0].session_date) == "2025-09-22"
    first = readers.captions(spark, str(tmp_path / "in"), multi_line=False, strip_tags=False).orderBy("seq").first()
    assert first["text"] == "&gt;&gt; Hello <c>there</c>"
    writers.write_captions(rows.withColumn("day", F.col("session_date").cast("string")), str(tmp_path / "out"), session="day")
    again = readers.captions(spark, str(tmp_path / "out/*")).orderBy("seq").collect()
    assert [(r.t_start, r.text) for r in again] == [(r.t_start, r.text) for r in got]


def test_lists_words_playlists(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a/x-01-02-2025.json").write_text(json.dumps({"segments": [{"start": 0, "end": 1, "text": " a "}, {"start": 1, "end": 2, "text": "b"}]}))
    assert [(r.segment_id, r.text, r.speaker) for r in readers.caption_lists(spark, str(tmp_path / "a")).orderBy("segment_index").collect()] == [("seg-00000", "a", "Unknown"), ("seg-00001", "b", "Unknown")]
    rows = spark.createDataFrame([("s", [(1, 0.0, 1.0, "t", [(" hi", 0.0, 0.5, 0.9)]), (2, 1.0, 2.0, "u", None)])], "k string, segments array<struct<id:int,start:double,end:double,text:string,words:array<struct<word:string,start:double,end:double,probability:double>>>>")
    assert [(r.segment_id, r.word) for r in readers.words(rows, key="k").collect()] == [(1, "hi")]
    (tmp_path / "p").mkdir()
    (tmp_path / "p/list.txt").write_text("WARNING: x\nabcdefghijk|Sitting 18 February 2025|NA\nbbbbbbbbbbb|[Private video]|NA\n# c\n")
    assert [(r.pos, r.video_id) for r in readers.playlist(spark, str(tmp_path / "p")).collect()] == [(1, "abcdefghijk")]
    (tmp_path / "d").mkdir()
    (tmp_path / "d/dates.txt").write_text("# dates\n22-09-2025\n\n2025-09-23 # second\n")
    assert sorted(str(r.date) for r in readers.date_list(spark, str(tmp_path / "d")).collect()) == ["2025-09-22", "2025-09-23"]
    entries = one(spark, readers.keyed_objects(F.col("s")), s='{"2025-01-01": {"video_id": "a", "has_hansard": true}}')
    assert entries[0]["key"] == "2025-01-01" and entries[0]["value"]["video_id"] == "a"
    assert readers.listing(spark, str(tmp_path / "p"), limit=1).first()["size"] > 0


def test_month_partitions_round_trip(spark, tmp_path):
    rows = spark.range(100).select("id", F.date_add(F.lit("2025-01-01").cast("date"), F.col("id").cast("int")).alias("day"))
    writers.write_by_month(rows, str(tmp_path / "t"), day="day")
    assert {r.id for r in spark.read.parquet(str(tmp_path / "t")).filter("year = 2025 AND month = 2").collect()} == set(range(31, 59))


def test_json_repair(spark):
    kind = "STRUCT<q: STRING, s: DOUBLE>"
    cases = {'[{"q":"a","s":1}]': 1, '```json\n[{"q":"a","s":1},{"q":"b","s":2}]\n```': 2, '{"q":"a","s":1}': 1, '[{"q":"a","s":1},{"q":"b","s"': 1, '[{"q":"a","s":1},{"q":"b","s":2}': 2, "no": 0, "": 0, "[{{{": 0}
    for content, n in cases.items():
        assert len(one(spark, P.repaired_json(F.col("c"), kind), c=content)) == n, content


@pytest.mark.parametrize(("hours", "n"), [(1, 1), (2.5, 1), (6, 3), (11, 5)])
def test_long_windows(spark, hours, n):
    rows, t = [], 0.0
    while t + 2.5 <= hours * 3600:
        rows.append((1, t, t + 2.5, "x"))
        t += 3
        if int(t) % 600 < 3:
            t += 5
    captions = spark.createDataFrame(rows, "session int, t_start double, t_end double, text string")
    found = C.windows(captions, session="session")
    assert found.count() == n
    covered = C.in_windows(captions, found, session="session").select("t_start").distinct().count()
    assert covered == len(rows)


def test_token_chunks_cover_and_keep_labels(spark):
    rows = spark.createDataFrame([("s", 0, "A", "x" * 30), ("s", 1, None, "y" * 30), ("s", 2, "B", "z" * 300), ("t", 0, None, None)], "session string, ord int, speaker string, text string")
    got = C.by_tokens(rows, most=20, overlap=2).orderBy("session", "chunk_index").collect()
    assert [(r.chunk_index, r.speaker) for r in got if r.session == "s"] == [(0, "A"), (1, "B")]
    assert got[1].text.startswith("yyyyyyy  B: zzz")


def slow_fuzzy(quote, cues, most):
    import re

    norm = lambda t: re.sub(r"\s+", " ", re.sub(r"[^a-z0-9_\s]", " ", t.lower())).strip()
    q = norm(quote).split()
    best, score = None, 0
    for i in range(len(cues)):
        for size in range(min(most, len(cues) - i), 0, -1):
            text = norm(" ".join(cues[i : i + size]))
            w, top = text.split(), 0
            for a in range(len(w)):
                count = 0
                for j in range(a, len(w)):
                    if count == len(q):
                        break
                    if w[j] == q[count]:
                        count += 1
                    elif count and j - (a + count) > 2:
                        break
                top = max(top, count)
            s = 1.0 if norm(quote) in text else max(top / len(q) * 0.9, sum(x in w for x in q) / len(q) * 0.7)
            if s > score and s >= (0.5 if len(q) < 10 else 0.35):
                best, score = (i, size), s
    return best, score


def test_fuzzy_match_equals_plain_pass(spark):
    import random

    rng = random.Random(5)
    cues = [" ".join(rng.choice("abcdefghij") * 2 for _ in range(rng.randint(0, 4))) for _ in range(14)]
    quotes = [(str(k), "s", " ".join(rng.choice("abcdefghij") * 2 for _ in range(rng.randint(1, 12)))) for k in range(25)]
    cue_rows = spark.createDataFrame([("s", i, 3.0 * i, 3.0 * i + 2, t) for i, t in enumerate(cues)], "session string, idx int, t_start double, t_end double, text string")
    quote_rows = spark.createDataFrame(quotes, "quote_id string, session string, text string")
    got = {r.quote_id: ((r.at, r.size), r.score) for r in M.fuzzy_match(quote_rows, cue_rows, most=5).collect()}
    for name, _, text in quotes:
        best, score = slow_fuzzy(text, cues, 5)
        assert (got.get(name) is None) == (best is None), (text, got.get(name), best)
        if best:
            assert got[name][0] == best and abs(got[name][1] - score) < 1e-9


def test_overlap_dedup(spark):
    rows = spark.createDataFrame([(0, "A ", True, "x"), (1, "b", False, "y"), (2, "a", False, "z"), (3, "a", True, "w")], "pos int, quote string, is_in_overlap_region boolean, c string")
    got = overlap_dedup(rows).orderBy("first_pos").collect()
    assert [(r.first_pos, r.c, r.n_removed) for r in got] == [(0, "z", 2), (1, "y", 0)]


def test_semantic_dedup_is_the_greedy_pass(spark):
    import random

    for seed in range(3):
        rng = random.Random(seed)
        edges = sorted({(a, b) for a, b in ((rng.randrange(20), rng.randrange(20)) for _ in range(30)) if a < b})
        kept = []
        for i in range(20):
            if not any((k, i) in edges for k in kept):
                kept.append(i)
        rows = spark.range(20).withColumn("pos", F.col("id"))
        frame = spark.createDataFrame([(a, b, 0.9) for a, b in edges], "earlier long, later long, similarity double")
        got, log = semantic_dedup(rows, frame, id_column="id", order="pos", checkpoint=cut)
        assert sorted(r.id for r in got.collect()) == kept
        assert {r.removed: r.kept for r in log.collect()} == {i: min(k for k in kept if (k, i) in edges) for i in range(20) if i not in kept}
    got, log = semantic_dedup(rows, frame.limit(0), id_column="id", order="pos", checkpoint=cut)
    assert got.count() == 20 and log.count() == 0


def test_embedding_slots(spark):
    rows = spark.createDataFrame([(1, "a b"), (2, None), (3, "c")], "id long, text string")
    sizes = spark.sparkContext.accumulator(0)

    def broken(texts):
        sizes.add(1)
        assert len(texts) <= 2
        return [None for _ in texts]

    got = V.embed(rows.coalesce(1), broken, id_column="id", width=8, batch=2, fallback=V.hashing_embedder(8))
    assert {len(r.embedding) for r in got.collect()} == {8} and sizes.value == 2
    with pytest.raises(Exception, match="width"):
        V.embed(rows, V.hashing_embedder(4), id_column="id", width=8).collect()
    assert V.respond(rows.filter("text IS NOT NULL"), lambda p: [x.upper() for x in p], id_column="id", prompt="text").filter("response = 'A B'").count() == 1
    vectors = spark.createDataFrame([(i, [float(i % 3 == 0), float(i % 3 == 1), float(i % 3 == 2), 0.01 * i]) for i in range(30)], "id long, embedding array<double>")
    found, centers = V.cluster(vectors, 3, id_column="id")
    assert centers.count() == 3 and found.select("cluster_id").distinct().count() == 3
    assert V.project(vectors, id_column="id").first()["projection"].__len__() == 2


def at(seconds):
    return datetime.datetime(2024, 1, 1) + datetime.timedelta(seconds=seconds)


def test_streams_equal_batch(spark, tmp_path):
    rows = [("a", 0, "error", at(0)), ("a", 1, "error", at(5)), ("b", 0, "server_error", at(1)), ("c", 0, "error", at(2)), ("c", 0, "error", at(3)), ("d", 0, "error", at(1)), ("d", 1, "ok", at(9))]
    frame = spark.createDataFrame(rows, "date string, attempt int, result string, at timestamp")
    for k in range(2):
        frame.filter(F.col("attempt") == k).coalesce(1).write.mode("append").parquet(str(tmp_path / "attempts"))
    stream = spark.readStream.schema(frame.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "attempts"))
    W.stream_attempts(stream).writeStream.outputMode("update").format("memory").queryName("attempts").option("checkpointLocation", str(tmp_path / "c1")).trigger(availableNow=True).start().awaitTermination()
    last = {}
    for r in spark.table("attempts").collect():
        if r.attempts >= last.get(r.date, ("", 0))[1]:
            last[r.date] = (r.status, r.attempts)
    assert last == {r.date: (r.status, r.attempts) for r in W.attempt_outcomes(frame).collect()}
    assert last == {"a": ("no_session", 2), "b": ("no_session", 1), "c": ("retry", 1), "d": ("done", 2)}

    jobs = [("1", at(0), "progress", -5.0, None), ("1", at(1), "progress", 150.0, None), ("2", at(0), "progress", 100.0, None), ("3", at(0), "progress", 50.0, None), ("3", at(2), "fail", None, "boom"), ("4", at(0), "complete", None, None)]
    frame = spark.createDataFrame(jobs, "job_id string, at timestamp, event string, progress double, detail string")
    frame.coalesce(1).write.parquet(str(tmp_path / "jobs"))
    stream = spark.readStream.schema(frame.schema).parquet(str(tmp_path / "jobs"))
    W.stream_jobs(stream).writeStream.outputMode("update").format("memory").queryName("jobs").option("checkpointLocation", str(tmp_path / "c2")).trigger(availableNow=True).start().awaitTermination()
    twin = {r.job_id: (r.status, r.progress, r.error) for r in W.job_states(frame).collect()}
    assert {r.job_id: (r.status, r.progress, r.error) for r in spark.table("jobs").filter("error IS NULL OR error <> 'timeout'").collect()} == twin
    assert twin == {"1": ("rendering", 100.0, None), "2": ("completed", 100.0, None), "3": ("failed", None, "boom"), "4": ("completed", 100.0, None)}
    assert {r.job_id: r.error for r in W.job_states(frame, as_of="2024-01-02 00:00:00").collect()}["1"] == "timeout"


def test_event_windows_equal_twin(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet").select("user_id", F.col("ts").cast("timestamp").alias("ts"), "event_type", "value")
    events.coalesce(1).write.parquet(str(tmp_path / "e"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "e"))
    W.running_stats(stream, by="event_type", score="value").writeStream.outputMode("complete").format("memory").queryName("stats").option("checkpointLocation", str(tmp_path / "c3")).trigger(availableNow=True).start().awaitTermination()
    assert {(r.event_type, r.n) for r in spark.table("stats").collect()} == {(r.event_type, r.n) for r in W.running_stats(events, by="event_type", score="value").collect()}
    batch = {(r.user_id, r.caption_count) for r in W.caption_windows(events, session="user_id", at="ts", text="event_type", length="1 day").collect()}
    W.caption_windows(stream, session="user_id", at="ts", text="event_type", length="1 day").writeStream.outputMode("append").format("memory").queryName("windows").option("checkpointLocation", str(tmp_path / "c4")).trigger(availableNow=True).start().awaitTermination()
    got = {(r.user_id, r.caption_count) for r in spark.table("windows").collect()}
    assert got and got <= batch
    assert W.caption_runs(events, session="user_id", at="ts", gap="1 hour").count() == W.runs_twin(events, session="user_id", at="ts", gap_seconds=3600).count()
    assert {r.s for r in spark.createDataFrame([("SUCCESS",), ("odd",)], "x string").select(W.map_status(F.col("x")).alias("s")).collect()} == {"completed", "queued"}
