"""Session ingest, stored tables and streaming state over restarts, failures and the horizon."""

import json
import os
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from plenum.operators import aggregates as A
from plenum.plans import queries
from plenum.sources import keyed, readers
from plenum.streaming import ingest
from plenum.streaming import state as W


def document(number, speeches, day="05-03-2024", **more):
    html = "".join(f"<p><strong>{who}</strong> {text}</p>" for who, text in speeches)
    sections = [{"title": "Empty", "content": ""}, {"title": "Answers", "sectionType": "OA", "startPgNo": 3, "content": "<h6>1.30 pm</h6>" + html}]
    return {"metadata": {"parlimentNO": 14, "sessionNO": number, "sittingDate": day}, "takesSectionVOList": sections, **more}


def put(folder, name, value):
    os.makedirs(folder, exist_ok=True)
    with open(f"{folder}/{name}.json", "w") as f:
        f.write(value if isinstance(value, str) else json.dumps(value))


def held(spark, store):
    return {n: sorted((tuple(r) for r in ingest.stored(spark, store, n).drop("batch", "file").collect()), key=str) for n in ingest.TABLES}


def run(spark, tmp_path, **options):
    ingest.ingest_sessions(spark, f"{tmp_path}/in", f"{tmp_path}/store", checkpoint=f"{tmp_path}/c", files=1, most=8, overlap=1, **options).awaitTermination()


def batch_twin(spark, tmp_path):
    ingest.write_batch(readers.sessions(spark, f"{tmp_path}/in"), 0, f"{tmp_path}/twin", most=8, overlap=1)
    return held(spark, f"{tmp_path}/twin")


def test_files_become_segments_chunks_and_roll_ups(spark, tmp_path):
    put(f"{tmp_path}/in", "a", document(1, [("Ms A", "said one thing"), ("Mr B", "asked"), ("Ms A", "answered at length, which takes more than a chunk")], attendanceList=[{"mpName": "Ms A", "attendance": True}, {"mpName": "Mr C", "attendance": False}]))
    put(f"{tmp_path}/in", "b", [document(2, []), document(3, [("X", "y")], day="31-02-2024")])
    put(f"{tmp_path}/in", "c", '{"metadata": {"sess')
    run(spark, tmp_path)
    got = held(spark, f"{tmp_path}/store")
    assert got == batch_twin(spark, tmp_path)
    first = ingest.stored(spark, f"{tmp_path}/store", "segments").filter("session LIKE '%session-1'").orderBy("segment_index").collect()
    assert [(r.segment_index, r.section_no, r.section_title, r.section_type, r.page, r.speaker, r.clock, r.word_count) for r in first] == [
        (0, 1, "Answers", "OA", 3, "Ms A", "1.30 pm", 5), (1, 1, "Answers", "OA", 3, "Mr B", "1.30 pm", 3), (2, 1, "Answers", "OA", 3, "Ms A", "1.30 pm", 11)]
    told = {r.session_no: (r.n_segments, r.n_words, r.speakers, r.topics, r.members) for r in ingest.stored(spark, f"{tmp_path}/store", "transcripts").collect()}
    assert told == {1: (3, 19, ["Ms A", "Mr B"], ["Empty", "Answers"], ["Ms A"]), 2: (0, 0, [], ["Empty", "Answers"], [])}
    assert sorted((r.session_no or 0, r.reasons) for r in ingest.stored(spark, f"{tmp_path}/store", "rejects").collect()) == [(0, ["not_json", "no_metadata", "no_date", "no_sections"]), (3, ["no_date"])]
    assert {len(got[n]) for n in ("chunks",)} == {len(batch_twin(spark, tmp_path)["chunks"])} and len(got["chunks"]) > 1


def test_a_failed_batch_is_invisible_and_runs_again(spark, tmp_path, monkeypatch):
    for k in range(3):
        put(f"{tmp_path}/in", f"s{k}", document(k, [(f"P{k}", f"speech number {k}")] * (k + 1)))
        os.utime(f"{tmp_path}/in/s{k}.json", (k + 1, k + 1))
    whole, left = ingest.C.by_tokens, [1]

    def broken(*a, **b):
        left[0] -= 1
        if left[0] < 0:
            raise RuntimeError("stopped between tables")
        return whole(*a, **b)

    monkeypatch.setattr(ingest.C, "by_tokens", broken)
    with pytest.raises(Exception, match="stopped between tables"):
        run(spark, tmp_path)
    # The second batch wrote its segments but no ledger row.
    assert os.path.isdir(f"{tmp_path}/store/segments/batch=1") and ingest.stored(spark, f"{tmp_path}/store", "ledger").count() == 1
    assert len(held(spark, f"{tmp_path}/store")["segments"]) == 1
    monkeypatch.setattr(ingest.C, "by_tokens", whole)
    run(spark, tmp_path)
    assert held(spark, f"{tmp_path}/store") == batch_twin(spark, tmp_path) and ingest.stored(spark, f"{tmp_path}/store", "ledger").count() == 3
    # A batch that the ledger holds is not written again.
    before = os.stat(f"{tmp_path}/store/segments/batch=1").st_mtime_ns
    ingest.write_batch(readers.sessions(spark, f"{tmp_path}/in"), 1, f"{tmp_path}/store")
    assert os.stat(f"{tmp_path}/store/segments/batch=1").st_mtime_ns == before


def test_a_session_that_comes_again_replaces_the_first(spark, tmp_path):
    put(f"{tmp_path}/in", "a", document(1, [("A", "first version"), ("B", "of two speeches")]))
    run(spark, tmp_path)
    put(f"{tmp_path}/in", "b", document(1, [("A", "second version")]))
    put(f"{tmp_path}/in", "c", document(2, [("C", "another")]))
    run(spark, tmp_path)
    got = held(spark, f"{tmp_path}/store")
    assert [r[-2] for r in got["segments"]] == ["A second version", "C another"] and len(got["transcripts"]) == 2 and len(got["chunks"]) == 2


def files_of(path):
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, names in os.walk(path) for f in names if f.endswith(".parquet")}


def test_upserts_leave_other_buckets_alone(spark, tmp_path):
    path = str(tmp_path / "t")
    first = spark.range(200).select("id", F.lit(1).cast("long").alias("v"), F.col("id").cast("string").alias("a"), F.lit(None).cast("string").alias("b"))
    keyed.upsert_stored(first, path, key="id", version="v", buckets=16)
    before = files_of(path)
    update = spark.createDataFrame([(3, 2, None, "new", 1.5), (900, 2, "x", None, None), (900, 3, None, "y", None), (None, 1, "n", "n", None)], "id long, v long, a string, b string, c double")
    keyed.upsert_stored(update, path, key="id", version="v", buckets=16)
    after = files_of(path)
    kept = {f for f in before if after.get(f) == before[f]}
    touched = {os.path.dirname(f) for f in set(before) - kept}
    assert 1 <= len(touched) <= 3 and len(kept) > 0.5 * len(before) and not any(os.path.dirname(f) in touched for f in kept)
    rows = {r.id: (r.v, r.a, r.b, r.c) for r in keyed.stored(spark, path).collect()}
    assert len(rows) == 202 and rows[3] == (2, "3", "new", 1.5) and rows[900] == (3, "x", "y", None) and rows[4] == (1, "4", None, None) and rows[None] == (1, "n", "n", None)
    # An older update changes only what is not known.
    keyed.upsert_stored(spark.createDataFrame([(3, 1, "old", "old", 9.0), (4, 0, "old", "late", 7.0)], update.schema), path, key="id", version="v", buckets=16)
    rows = {r.id: (r.v, r.a, r.b, r.c) for r in keyed.stored(spark, path).filter("id IN (3, 4)").collect()}
    assert rows[3][0] == 2 and rows[3][2:] == ("new", 1.5) and rows[4] == (1, "4", "late", 7.0)


def test_an_upsert_that_stopped_is_finished_by_the_next_reader(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "t")
    rows = spark.createDataFrame([(1, 1, "a"), (2, 1, "b")], "id long, v long, a string")
    keyed.upsert_stored(rows, path, key="id", version="v", buckets=4)
    whole = keyed._put_in_place
    monkeypatch.setattr(keyed, "_put_in_place", lambda *a: (_ for _ in ()).throw(RuntimeError("lost")))
    with pytest.raises(RuntimeError, match="lost"):
        keyed.upsert_stored(spark.createDataFrame([(2, 2, "c"), (3, 2, "d")], rows.schema), path, key="id", version="v", buckets=4)
    monkeypatch.setattr(keyed, "_put_in_place", whole)
    assert {r.id: r.a for r in keyed.stored(spark, path).collect()} == {1: "a", 2: "c", 3: "d"}
    assert not os.path.exists(f"{path}_staged")


def test_vectors_are_checked_and_the_latest_of_an_id_stays(spark, tmp_path):
    schema = "id string, embedding array<double>, v long"
    rows = [("a", [1.0, 2.0], 1), ("b", [1.0], 1), ("c", None, 1), ("d", [1.0, None], 1), (None, [0.0, 0.0], 1), ("e", [float("nan"), 0.0], 1), ("f", [0.0, 1.0], 3), ("f", [9.0, 9.0], 2)]
    rejects = keyed.store_vectors(spark.createDataFrame(rows, schema), str(tmp_path / "v"), id_column="id", width=2, version="v", buckets=4)
    assert sorted((r.id or "", r.reasons) for r in rejects.collect()) == [("", ["no_id"]), ("b", ["width"]), ("c", ["no_vector"]), ("d", ["component"]), ("e", ["component"])]
    keyed.store_vectors(spark.createDataFrame([("a", [5.0, 5.0], 2), ("f", [7.0, 7.0], 1)], schema), str(tmp_path / "v"), id_column="id", width=2, version="v", buckets=4)
    assert {r.id: list(r.embedding) for r in keyed.stored(spark, str(tmp_path / "v")).collect()} == {"a": [5.0, 5.0], "f": [0.0, 1.0]}


def test_chunk_statistics_merge_as_the_direct_ones(spark):
    rows = [(i % 4, "t" if i % 3 else None, f"s{i % 2}", "calm", float(i) if i % 5 else None) for i in range(60)]
    moments = spark.createDataFrame(rows, "chunk int, topic string, speaker string, emotional_tone string, viral_score double")
    told = lambda df: {(r.kind, r.key): (r.n, round(r.mean_score, 9)) for r in df.collect()}
    states = A.partial_stats(moments, chunk="chunk")
    assert told(A.merged_stats(states)) == told(A.extraction_stats(moments))
    merged = A.merged_states(states.filter("chunk < 2")).unionByName(A.merged_states(states.filter("chunk >= 2")))
    assert told(A.merged_stats(merged)) == told(A.extraction_stats(moments)) and told(A.extraction_stats(moments))["all", ""][0] == 60
    empty = told(A.extraction_stats(moments.filter("chunk = 9")))
    assert empty == {}


def test_state_of_dates_is_forgotten_after_the_horizon(spark, tmp_path):
    start, schema = datetime(2024, 1, 1), "date string, attempt long, result string, at timestamp"
    batches = [[("a", 1, "error", start), ("b", 1, "error", start + timedelta(hours=1))], [("a", 2, "ok", start + timedelta(days=2)), ("b", 1, "ok", start)], [("c", 1, "ok", start + timedelta(days=40))], [("d", 1, "ok", start + timedelta(days=41))], [("e", 1, "ok", start + timedelta(days=42))]]
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    q = W.stream_attempts(stream).writeStream.outputMode("update").format("memory").queryName("horizon").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
    q.awaitTermination()
    # Out of order, the redelivered attempt that came first in time counts.
    last = {}
    for r in sorted(spark.table("horizon").collect(), key=lambda r: (r.attempts, -r.last_checked.timestamp())):
        last[r.date] = (r.attempts, r.status)
    assert last == {"a": (2, "done"), "b": (1, "done"), "c": (1, "done"), "d": (1, "done"), "e": (1, "done")}
    held = [p["stateOperators"][0]["numRowsTotal"] for p in map(lambda p: json.loads(p.json), q.recentProgress) if p["stateOperators"]]
    # Attempts and a due time for each date: a and b are told with the third batch, and gone by the fourth.
    assert held[2] == 7 and held[3] == 4


@pytest.mark.parametrize("tie", [None, "n"])
def test_late_and_tied_job_events_are_the_same_in_batch_and_stream(spark, tmp_path, tie):
    at = lambda m: datetime(2024, 1, 1, 12) + timedelta(minutes=m)
    schema = "job_id string, n long, at timestamp, event string, progress double, detail string"
    rows = [
        [("a", 2, at(5), "progress", 40.0, None), ("b", 1, at(0), "complete", None, None), ("c", 1, at(1), "progress", 10.0, None)],
        # Late by less than the hour that both sides take: older than what was seen, and tied with it.
        [("a", 1, at(5), "progress", 70.0, None), ("a", 0, at(3), "fail", None, "old"), ("b", 2, at(0), "fail", None, "tied"), ("c", 2, at(1), "progress", 10.0, None)],
        [("c", 0, at(1), "complete", None, None), ("b", 3, at(-20), "progress", 1.0, None), ("d", 1, at(6), "ping", None, None)],
    ]
    for batch in rows:
        spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    name = f"jobs_{tie}"
    W.stream_jobs(stream, tie=tie).writeStream.outputMode("update").format("memory").queryName(name).option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start().awaitTermination()
    last = {}
    for r in sorted(spark.table(name).collect(), key=lambda r: r.n_events):
        last[r.job_id] = (r.status, r.progress, r.error, r.n_events)
    twin = {r.job_id: (r.status, r.progress, r.error, r.n_events) for r in W.job_states(spark.createDataFrame(sum(rows, []), schema), tie=tie).collect()}
    assert last == twin
    assert twin["a"][1] == (40.0 if tie else 70.0) and twin["b"][0] == "failed" and twin["c"][0] == "rendering" and twin["d"][3] == 1


@pytest.mark.parametrize("name", ["v7_vector_store", "i8_stored_upsert", "a2_merged_stats", "w1_ingest"])
def test_flow_queries_are_registered(name):
    assert name in queries()
