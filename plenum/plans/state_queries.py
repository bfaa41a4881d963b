"""Queries of vectors (V, D3), sources and sinks (S), incremental work (I) and batch twins of streams (W)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plenum.operators import incremental as I
from plenum.operators import vectors as V
from plenum.operators.ranking import semantic_dedup
from plenum.plans.registry import query, table
from plenum.sources import readers, writers
from plenum.sources.shared import new_folder, shared_folder
from plenum.streaming import state as W

_COS = "list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[])"


@query(f"SELECT a.vec_id, round({_COS}, 6) AS similarity FROM embeddings a, embeddings b WHERE b.vec_id = 0")
def v1_cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    first = rows.filter("vec_id = 0").select(F.lit(1).alias("k"), F.col("embedding").alias("q"))
    return rows.withColumn("k", F.lit(1)).join(first, "k").select("vec_id", F.round(V.cosine(F.col("embedding"), F.col("q")), 6).alias("similarity"))


@query(f"SELECT a.vec_id AS a, b.vec_id AS b, round({_COS}, 6) AS similarity FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id < b.vec_id WHERE {_COS} > 0.3")
def v2_similar_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.similar_pairs(table(spark, sf_dir, "embeddings"), id_column="vec_id", group="label", threshold=0.3).withColumn("similarity", F.round("similarity", 6))


@query(f"SELECT a.vec_id AS a, b.vec_id AS b, round({_COS}, 6) AS similarity FROM embeddings a JOIN embeddings b ON a.vec_id < b.vec_id WHERE {_COS} > 0.35")
def v2_pairs_of_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.similar_pairs_of_all(table(spark, sf_dir, "embeddings"), id_column="vec_id", threshold=0.35).withColumn("similarity", F.round("similarity", 6))


_TOP = f"""SELECT query_id, vec_id, label, rank, round(score, 6) AS score FROM (SELECT b.vec_id AS query_id, a.vec_id, a.label, {_COS} AS score, row_number() OVER (PARTITION BY b.vec_id ORDER BY {_COS} DESC, a.vec_id)::INTEGER AS rank FROM embeddings a JOIN embeddings b ON WHERE_ ) WHERE rank <= 5"""


def _questions(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").filter("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "embedding", "label")


@query(_TOP.replace("WHERE_", "b.vec_id % 50 = 0 AND a.label = b.label"))
def v3_filtered_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = V.top_k(_questions(spark, sf_dir), table(spark, sf_dir, "embeddings"), 5, on=["label"])
    return found.select("query_id", "vec_id", "label", "rank", F.round("score", 6).alias("score"))


@query(_TOP.replace("WHERE_", "b.vec_id % 50 = 0"))
def v4_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = V.top_k(_questions(spark, sf_dir).drop("label"), table(spark, sf_dir, "embeddings"), 5)
    return found.select("query_id", "vec_id", "label", "rank", F.round("score", 6).alias("score"))


@query(_TOP.replace("WHERE_", f"b.vec_id % 50 = 0 AND {_COS} >= 0.3"))
def v5_top_k_over(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = V.top_k(_questions(spark, sf_dir).drop("label"), table(spark, sf_dir, "embeddings"), 5, least=0.3)
    return found.select("query_id", "vec_id", "label", "rank", F.round("score", 6).alias("score"))


@query("WITH h AS (" + _TOP.replace("WHERE_", "b.vec_id % 50 = 0") + ") SELECT query_id, rank, vec_id, CASE WHEN length(text) > 120 THEN left(text, 120) || '...' ELSE text END AS excerpt FROM h JOIN documents ON doc_id = vec_id")
def v6_citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = V.top_k(_questions(spark, sf_dir).drop("label"), table(spark, sf_dir, "embeddings"), 5)
    told = V.citations(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("vec_id"), "text"), most=120).select("vec_id", "excerpt")
    return hits.join(told, "vec_id").select("query_id", "rank", "vec_id", "excerpt")


@query(r"SELECT doc_id, 256 AS width, CASE WHEN regexp_matches(text, '\S') THEN 1.0 ELSE 0.0 END::DOUBLE AS norm FROM documents")
def v7_embed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By the hashing embedder: vectors of unit length, but for texts without words."""
    found = V.embed(table(spark, sf_dir, "documents"), V.hashing_embedder(256), id_column="doc_id", width=256)
    return found.select("doc_id", F.size("embedding").alias("width"), F.round(V.norm(F.col("embedding")), 4).alias("norm"))


@query("WITH u AS (SELECT label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS d FROM embeddings) SELECT label::BIGINT AS label, (d - 1)::BIGINT AS place, round(avg(x), 6) AS mean, (SELECT count(*) FROM embeddings e WHERE e.label = u.label) AS size FROM u GROUP BY label, d")
def v8_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = V.centroids(table(spark, sf_dir, "embeddings"), group="label")
    return found.select(F.col("label").cast("long").alias("label"), "size", F.posexplode("centroid").alias("place", "mean")).select("label", F.col("place").cast("long").alias("place"), F.round("mean", 6).alias("mean"), "size")


_CENTERS = "c AS (SELECT label, list(m ORDER BY d) AS embedding FROM (SELECT label, d, avg(x) AS m FROM (SELECT label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS d FROM embeddings) GROUP BY label, d) GROUP BY label)"


@query(f"WITH {_CENTERS} SELECT vec_id, cluster_id, round(score, 6) AS score FROM (SELECT a.vec_id, b.label::BIGINT AS cluster_id, {_COS} AS score, row_number() OVER (PARTITION BY vec_id ORDER BY {_COS} DESC, b.label) AS n FROM embeddings a, c b) WHERE n = 1")
def v9_nearest_centroid(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    centers = V.centroids(rows, group="label").select(F.col("label").cast("long").alias("cluster_id"), "centroid")
    return V.nearest_centroid(rows, centers, id_column="vec_id").withColumn("score", F.round("score", 6))


def _half(name: str, odd: int) -> str:
    return f"{name} AS (SELECT label, list(m ORDER BY d) AS embedding FROM (SELECT label, d, avg(x) AS m FROM (SELECT label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS d FROM embeddings WHERE vec_id % 2 = {odd}) GROUP BY label, d) GROUP BY label)"


@query(f"""WITH {_half('o', 0)}, {_half('w', 1)}, p AS (SELECT a.label AS old_id, b.label AS new_id, {_COS} AS s FROM o a, w b), m AS (SELECT old_id, arg_max(new_id, s) AS new_id, max(s) AS s FROM p GROUP BY old_id HAVING max(s) > 0.1), k AS (SELECT new_id, arg_max(old_id, s) AS old_id FROM p GROUP BY new_id HAVING max(s) > 0.1)
SELECT 'consistent' AS kind, old_id::BIGINT AS old_id, new_id::BIGINT AS new_id, round(s, 6) AS similarity FROM m UNION ALL SELECT 'new', NULL, label, NULL FROM w WHERE label NOT IN (SELECT new_id FROM m) UNION ALL SELECT 'removed', label, NULL, NULL FROM o WHERE label NOT IN (SELECT old_id FROM m)
UNION ALL SELECT 'merged', NULL, new_id, NULL FROM m GROUP BY new_id HAVING count(*) > 1 UNION ALL SELECT 'split', old_id, NULL, NULL FROM k GROUP BY old_id HAVING count(*) > 1""")
def v10_evolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    half = lambda odd: V.centroids(rows.filter(F.col("vec_id") % 2 == odd), group="label").select(F.col("label").cast("long").alias("cluster_id"), "centroid")
    return V.evolution(half(0), half(1), threshold=0.1).withColumn("similarity", F.round("similarity", 6))


@query(f"WITH {_CENTERS} SELECT cluster_id, vec_id, rank, round(score, 6) AS score FROM (SELECT a.vec_id, a.label::BIGINT AS cluster_id, {_COS} AS score, row_number() OVER (PARTITION BY a.label ORDER BY {_COS} DESC, vec_id)::INTEGER AS rank FROM embeddings a JOIN c b ON a.label = b.label) WHERE rank <= 10")
def v11_sample_of_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    centers = V.centroids(rows, group="label").select(F.col("label").cast("long").alias("cluster_id"), "centroid")
    return V.sample_of_clusters(rows.withColumn("cluster_id", F.col("label").cast("long")), centers, id_column="vec_id").withColumn("score", F.round("score", 6))


@query(f"""WITH RECURSIVE r AS (SELECT vec_id, label, embedding, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS n FROM embeddings),
e AS (SELECT a.vec_id AS x, b.vec_id AS y, {_COS} AS s FROM r a JOIN r b ON a.label = b.label AND a.vec_id < b.vec_id WHERE {_COS} > 0.3),
k AS (SELECT r.vec_id, label, n, coalesce(list(x) FILTER (WHERE x IS NOT NULL), []) AS near FROM r LEFT JOIN e ON y = r.vec_id GROUP BY r.vec_id, label, n),
g AS (SELECT label, n, [vec_id] AS kept FROM k WHERE n = 1 UNION ALL SELECT k.label, k.n, CASE WHEN list_has_any(g.kept, k.near) THEN g.kept ELSE list_append(g.kept, k.vec_id) END FROM g JOIN k ON k.label = g.label AND k.n = g.n + 1),
f AS (SELECT unnest(kept) AS vec_id FROM (SELECT label, arg_max(kept, n) AS kept FROM g GROUP BY label))
SELECT x AS kept, y AS removed, round(s, 6) AS similarity FROM (SELECT *, row_number() OVER (PARTITION BY y ORDER BY x) AS m FROM e WHERE x IN (SELECT vec_id FROM f) AND y NOT IN (SELECT vec_id FROM f)) WHERE m = 1""")
def d3_semantic_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The decision log of the greedy pass."""
    rows = table(spark, sf_dir, "embeddings")
    edges = V.similar_pairs(rows, id_column="vec_id", group="label", threshold=0.3).select(F.col("a").alias("earlier"), F.col("b").alias("later"), "similarity")
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_folder(spark))
    return semantic_dedup(rows, edges, id_column="vec_id", order="vec_id", checkpoint=lambda df: df.checkpoint())[1].withColumn("similarity", F.round("similarity", 6))


@query("""WITH r AS (SELECT doc_id, concat_ws('|', CASE WHEN length(text) < 100 THEN 'short' END, CASE WHEN lang = 'fr' THEN 'language' END, CASE WHEN contains(text, '!!') THEN 'shouting' END) AS reasons FROM documents) SELECT doc_id, reasons FROM r WHERE reasons <> ''""")
def s2_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = {"short": F.length("text") < 100, "language": F.col("lang") == "fr", "shouting": F.contains("text", F.lit("!!"))}
    return readers.validate(table(spark, sf_dir, "documents"), rules)[1].select("doc_id", F.array_join("reasons", "|").alias("reasons"))


@query("""WITH c AS (SELECT user_id, event_id, (epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01')) // 1000 AS a, event_type FROM events)
SELECT user_id, md5('WEBVTT' || chr(10) || chr(10) || string_agg(lpad((a // 3600000)::VARCHAR, greatest(2, length((a // 3600000)::VARCHAR))::INTEGER, '0') || ':' || lpad((a // 60000 % 60)::VARCHAR, 2, '0') || ':' || lpad((a // 1000 % 60)::VARCHAR, 2, '0') || '.' || lpad((a % 1000)::VARCHAR, 3, '0') || ' --> ' || lpad(((a + 2000) // 3600000)::VARCHAR, greatest(2, length(((a + 2000) // 3600000)::VARCHAR))::INTEGER, '0') || ':' || lpad(((a + 2000) // 60000 % 60)::VARCHAR, 2, '0') || ':' || lpad(((a + 2000) // 1000 % 60)::VARCHAR, 2, '0') || '.' || lpad((a % 1000)::VARCHAR, 3, '0') || chr(10) || event_type, chr(10) || chr(10) ORDER BY event_id)) AS vtt FROM c GROUP BY user_id""")
def s10_caption_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    start = (F.unix_millis(F.col("ts").cast("timestamp")) - F.unix_millis(F.lit("2024-01-01").cast("timestamp"))) / 1000.0
    rows = table(spark, sf_dir, "events").select("user_id", F.col("event_id").alias("seq"), start.alias("t_start"), (start + 2).alias("t_end"), F.col("event_type").alias("text"))
    return writers.caption_text(rows, session="user_id").select("user_id", F.md5("value").alias("vtt"))


@query("""SELECT conv_id, '[' || string_agg('{"turn":' || turn::VARCHAR || ',"role":"' || role || '"}', ',' ORDER BY turn) || ']' AS document FROM conversations GROUP BY conv_id""")
def s12_session_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return writers.session_documents(table(spark, sf_dir, "conversations"), session="conv_id", order="turn", columns=("turn", "role"))


_STORED = "SELECT DISTINCT o_orderdate::DATE AS date FROM orders WHERE o_orderstatus = 'P'"


def _stored(spark, sf_dir):
    return table(spark, sf_dir, "orders").filter("o_orderstatus = 'P'").select(F.to_date("o_orderdate").alias("date")).distinct()


@query("SELECT unnest(generate_series(min(o_orderdate)::DATE, max(o_orderdate)::DATE, INTERVAL 1 DAY))::DATE AS date FROM orders")
def i1_calendar(spark: SparkSession, sf_dir: str) -> DataFrame:
    ends = table(spark, sf_dir, "orders").agg(F.min(F.to_date("o_orderdate")), F.max(F.to_date("o_orderdate"))).first()
    return I.calendar(spark, str(ends[0]), str(ends[1]))


@query(f"""WITH d AS (SELECT unnest(generate_series(DATE '1995-01-01', DATE '1998-12-31', INTERVAL 1 DAY))::DATE AS date), s AS ({_STORED}), k AS (SELECT DISTINCT o_orderdate::DATE AS date FROM orders)
SELECT d.date, CASE WHEN k.date IS NULL THEN 'new' ELSE 'recheck' END AS reason FROM d LEFT JOIN k USING (date) WHERE d.date NOT IN (SELECT date FROM s) AND (k.date IS NULL OR DATE '1998-12-31' - d.date <= 365)""")
def i2_work_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    stored = o.filter("o_orderstatus = 'P'").select(F.to_date("o_orderdate").alias("date"))
    checks = o.select(F.to_date("o_orderdate").alias("date"), F.lit("no_session").alias("status"))
    return I.work_list(I.calendar(spark, "1995-01-01", "1998-12-31"), stored, checks, as_of="1998-12-31", recheck_days=365)


@query("SELECT unnest(generate_series(max(o_orderdate)::DATE + 1, max(o_orderdate)::DATE + 9, INTERVAL 1 DAY))::DATE AS date FROM orders")
def i3_since_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = table(spark, sf_dir, "orders").select(F.to_date("o_orderdate").alias("date"))
    end = stored.agg(F.date_add(F.max("date"), 9)).first()[0]
    return I.since_latest(spark, stored, as_of=str(end))


@query(f"WITH d AS (SELECT unnest(generate_series(DATE '1996-01-01', DATE '1998-12-31', INTERVAL 1 DAY))::DATE AS date) SELECT date, CASE WHEN date IN ({_STORED}) THEN 'has_session' ELSE 'no_session' END AS status FROM d")
def i4_backfill(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.backfill(I.calendar(spark, "1996-01-01", "1998-12-31"), _stored(spark, sf_dir))


@query("""SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 THEN 'already' WHEN n IS NULL THEN 'not_found' WHEN n % 7 = 0 THEN 'error' WHEN n % 3 = 0 THEN 'no_content' ELSE 'embedded' END AS status FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) ON o_custkey = c_custkey""")
def i5_processing_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = table(spark, sf_dir, "customer").select("c_custkey")
    found = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count(F.lit(1)).alias("n"))
    found = found.select("c_custkey", F.when(F.col("n") % 3 == 0, 0).otherwise(F.col("n")).alias("n_segments"), F.when(F.col("n") % 7 == 0, "failed").alias("error"))
    return I.processing_status(wanted, wanted.filter("c_custkey % 5 = 0"), found, key="c_custkey")


@query("SELECT o_orderkey FROM orders WHERE o_orderdate >= DATE '1996-03-01' AND o_orderdate < DATE '1996-06-01' AND o_orderpriority IN ('1-URGENT', '5-LOW')")
def i6_in_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.in_dates(table(spark, sf_dir, "orders"), day="o_orderdate", first="1996-03-01", last="1996-05-31", ids=("1-URGENT", "5-LOW"), id_column="o_orderpriority").select("o_orderkey")


@query("SELECT n_left, n_right, n_both, round((1 - n_both / n_left::DOUBLE) * 100, 4) AS reduction FROM (SELECT (SELECT count(*) FROM customer) AS n_left, (SELECT count(DISTINCT o_custkey) FROM orders WHERE o_orderstatus = 'P') AS n_right, (SELECT count(*) FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')) AS n_both)")
def i7_key_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    right = table(spark, sf_dir, "orders").filter("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey"))
    return I.key_overlap(table(spark, sf_dir, "customer"), right, "c_custkey")


@query("""SELECT user_id, max(event_id) AS version, arg_max(event_type, event_id) AS event_type, arg_max(value, event_id) FILTER (WHERE event_id % 2 = 0) AS value FROM events GROUP BY user_id""")
def i8_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("user_id", F.col("event_id").alias("version"), "event_type", F.when(F.col("event_id") % 2 == 0, F.col("value")).alias("value"))
    return I.upsert(rows.filter("version < 5000"), rows.filter("version >= 5000"), key="user_id", version="version")


@query("""WITH s AS (SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN c_custkey END AS video_id FROM customer), v AS (SELECT o_custkey, min(o_orderkey) AS v FROM orders WHERE o_orderstatus = 'P' GROUP BY 1) SELECT c_custkey, coalesce(video_id, v) AS video_id FROM s LEFT JOIN v ON o_custkey = c_custkey""")
def i9_mark_linked(spark: SparkSession, sf_dir: str) -> DataFrame:
    sessions = table(spark, sf_dir, "customer").select("c_custkey", F.when(F.col("c_custkey") % 2 == 0, F.col("c_custkey")).alias("video_id"))
    videos = table(spark, sf_dir, "orders").filter("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey"), F.col("o_orderkey").alias("video_id"))
    return I.mark_linked(sessions, videos, key="c_custkey").select("c_custkey", "video_id")


@query("""SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' AND o_orderkey % 5 < 3 THEN 'pending' WHEN o_orderstatus = 'F' THEN 'failed' ELSE 'done' END AS status, o_orderkey % 5 + CASE WHEN o_orderstatus = 'F' AND o_orderkey % 5 < 3 THEN 1 ELSE 0 END AS retry_count FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 100""")
def i10_pending(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate", F.when(F.col("o_orderstatus") == "F", "failed").otherwise("done").alias("status"), (F.col("o_orderkey") % 5).alias("retry_count"))
    return I.pending(I.retried(rows), F.lit(True), order=[F.desc("o_orderdate"), F.col("o_orderkey")], limit=100).select("o_orderkey", "status", "retry_count")


@query("SELECT 'recorded' AS origin, doc_id AS id, lang AS kind FROM documents UNION ALL SELECT 'spoken', conv_id * 100 + turn, NULL FROM conversations")
def i11_from_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("lang").alias("kind"))
    b = table(spark, sf_dir, "conversations").select((F.col("conv_id") * 100 + F.col("turn")).alias("id"))
    return I.from_sources(recorded=a, spoken=b).select("origin", "id", "kind")


@query("SELECT event_id FROM events WHERE epoch_us(TIMESTAMP '2024-01-20') // 1000000 - epoch_us(ts) // 1000000 BETWEEN 0 AND 86400")
def i12_fresh(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.fresh(table(spark, sf_dir, "events"), at="ts", as_of="2024-01-20 00:00:00", seconds=86400).select("event_id")


@query("SELECT event_id, platform, CASE WHEN ts > TIMESTAMP '2024-01-20' THEN 'scheduled' ELSE 'due' END AS state FROM events, (VALUES ('tiktok'), ('youtube')) p(platform)")
def i13_fan_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.fan_out(table(spark, sf_dir, "events"), ("tiktok", "youtube"), "platform", at="ts", as_of="2024-01-20 00:00:00").select("event_id", "platform", "state")


@query("""WITH a AS (SELECT ts::DATE AS date, user_id % 4 AS attempt, arg_min(CASE event_type WHEN 'view' THEN 'ok' WHEN 'error' THEN 'server_error' ELSE 'error' END, event_id) AS result FROM events GROUP BY 1, 2),
l AS (SELECT date, arg_max(result, attempt) AS result, count(*) AS attempts FROM a GROUP BY date) SELECT date, attempts, CASE WHEN result = 'ok' THEN 'done' WHEN result = 'server_error' OR attempts >= 2 THEN 'no_session' ELSE 'retry' END AS status FROM l""")
def w2_attempt_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    result = F.when(F.col("event_type") == "view", "ok").when(F.col("event_type") == "error", "server_error").otherwise("error")
    rows = table(spark, sf_dir, "events").select(F.to_date("ts").alias("date"), (F.col("user_id") % 4).alias("attempt"), result.alias("result"), F.col("event_id").alias("at"))
    return W.attempt_outcomes(rows).select("date", "attempts", "status")


@query("""WITH l AS (SELECT user_id, arg_max(event_type, event_id) AS e, arg_max(value, event_id) AS v, max(event_id) AS n, count(*) AS n_events FROM events GROUP BY user_id)
SELECT user_id, n_events, CASE WHEN e = 'error' THEN 'failed' WHEN e = 'purchase' OR v * 4 = 100 THEN 'completed' ELSE 'rendering' END AS status, round(CASE WHEN e = 'purchase' THEN 100 WHEN e = 'error' THEN NULL ELSE greatest(0, least(100, v * 4)) END, 6)::DOUBLE AS progress FROM l""")
def w3_job_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("event_type") == "error", "fail").when(F.col("event_type") == "purchase", "complete").otherwise("progress")
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("job_id"), F.col("event_id").alias("at"), kind.alias("event"), (F.col("value") * 4).alias("progress"), F.lit("x").alias("detail"))
    return W.job_states(rows).select(F.col("job_id").alias("user_id"), "n_events", "status", F.round("progress", 6).alias("progress"))


@query("SELECT event_type, count(*) AS n, round(avg(value), 6) AS mean_score FROM events GROUP BY event_type")
def w4_running_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return W.running_stats(table(spark, sf_dir, "events"), by="event_type", score="value").withColumn("mean_score", F.round("mean_score", 6))


@query("""WITH o AS (SELECT user_id, ts, coalesce(epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts)) >= 3600000000, true) AS opens FROM events), r AS (SELECT *, sum(opens::INTEGER) OVER (PARTITION BY user_id ORDER BY ts) AS run FROM o)
SELECT user_id, count(*) AS caption_count, epoch_us(min(ts)) AS first_at FROM r GROUP BY user_id, run""")
def w5_caption_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = W.runs_twin(table(spark, sf_dir, "events"), session="user_id", at="ts", gap_seconds=3600)
    return rows.select("user_id", "caption_count", F.unix_micros(F.col("first_at").cast("timestamp")).alias("first_at"))


@query("SELECT doc_id, CASE lang WHEN 'en' THEN 'structured' WHEN 'de' THEN 'old' ELSE 'unknown' END AS route FROM documents")
def s3_routed(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", F.when(F.col("lang") == "en", F.array("text")).alias("takesSectionVOList"), F.when(F.col("lang") == "de", "old").alias("format"), F.struct(F.lit(None).cast("string").alias("fullText")).alias("cleanedContent"))
    return readers.routed(rows).select("doc_id", "route")


@query("""SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS seq, round(((epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01')) // 1000) / 1000.0::DOUBLE, 3) AS t_start, event_type AS text FROM events""")
def s4_cues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Captions written as files' texts and read back."""
    start = (F.unix_millis(F.col("ts").cast("timestamp")) - F.unix_millis(F.lit("2024-01-01").cast("timestamp"))) / 1000.0
    rows = table(spark, sf_dir, "events").select("user_id", F.col("event_id").alias("seq"), start.alias("t_start"), (start + 2).alias("t_end"), F.col("event_type").alias("text"))
    files = writers.caption_text(rows, session="user_id").select(F.col("user_id").cast("string").alias("file"), "value")
    return readers.cues(files).select(F.col("file").cast("long").alias("user_id"), F.col("seq").cast("long").alias("seq"), F.round("t_start", 3).alias("t_start"), "text")


@query(r"""SELECT conv_id, turn AS segment_id, unnest(regexp_split_to_array(text, '\s+')) AS word, generate_subscripts(regexp_split_to_array(text, '\s+'), 1)::BIGINT - 1 AS word_no FROM conversations WHERE role = 'user'""")
def s6_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    timed = F.transform(F.split("text", r"(?U)\s+", -1), lambda w: F.struct(F.concat(F.lit(" "), w).alias("word"), F.lit(0.0).alias("start"), F.lit(1.0).alias("end"), F.lit(0.9).alias("probability")))
    segment = F.struct(F.col("turn").alias("id"), F.when(F.col("role") == "user", timed).alias("words"))
    rows = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.collect_list(segment).alias("segments"))
    return readers.words(rows, key="conv_id").select("conv_id", "segment_id", "word", F.col("word_no").cast("long").alias("word_no"))


@query("SELECT o_custkey, strftime(o_orderdate, '%Y-%m-%d') AS date, max(o_orderkey)::VARCHAR AS video_id FROM orders GROUP BY o_custkey, strftime(o_orderdate, '%Y-%m-%d')")
def s8_keyed_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = table(spark, sf_dir, "orders").groupBy("o_custkey", F.date_format("o_orderdate", "yyyy-MM-dd").alias("date")).agg(F.max("o_orderkey").cast("string").alias("video_id"))
    objects = held.groupBy("o_custkey").agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("date", F.struct("video_id"))))).alias("j"))
    entries = objects.select("o_custkey", F.explode(readers.keyed_objects(F.col("j"), "MAP<STRING, STRUCT<video_id: STRING>>")).alias("e"))
    return entries.select("o_custkey", F.col("e.key").alias("date"), F.col("e.value.video_id").alias("video_id"))


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderdate >= DATE '1996-01-01' AND o_orderdate < DATE '1996-03-01'")
def s9_month_partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Written by year and month to a shared folder, and two months read back."""
    path = new_folder(spark, "months")
    writers.write_by_month(table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", F.to_date("o_orderdate").alias("day")), path, day="day")
    return spark.read.parquet(path).filter("year = 1996 AND month IN (1, 2)").select("o_orderkey", "o_totalprice")


@query()
def s11_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored files of the events table; times differ between copies of the tables, so there is no SQL."""
    return readers.listing(spark, f"{sf_dir}/events.parquet").select("key", "size")
