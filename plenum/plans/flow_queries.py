"""Queries of whole flows: a session stream with its ledger (W1), stored tables with upserts (I8, V7), statistics merged over chunks (A2)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plenum.operators import aggregates as A
from plenum.plans.registry import query, table
from plenum.sources import keyed
from plenum.sources.shared import new_folder
from plenum.streaming import ingest

# Sessions are conversations: every two turns are a section. Of eleven the fifth has no date and the sixth is cut off; every
# seventh comes again, corrected.
_SESSION = "CASE WHEN conv_id % 7 = 0 THEN 'Corrected: ' ELSE '' END || text"
_TOLD = rf"trim(regexp_replace(role || ' : ' || {_SESSION}, '\s+', ' ', 'g'))"


@query(rf"""WITH c AS (SELECT conv_id, turn, role, {_TOLD} AS told FROM conversations), g AS (SELECT * FROM c WHERE conv_id % 11 NOT IN (5, 6)),
s AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS n, role, turn // 2 AS part, told FROM g),
w AS (SELECT conv_id, role, min(turn) AS t FROM g GROUP BY conv_id, role), k AS (SELECT conv_id, string_agg(role, '|' ORDER BY t) AS roles FROM w GROUP BY conv_id)
SELECT 'segment' AS kind, conv_id AS session_no, n, role || ' in Part ' || part::VARCHAR AS label, md5(told) AS text FROM s
UNION ALL SELECT 'transcript', s.conv_id, count(*), max(roles), sum(len(regexp_split_to_array(told, '\s+')))::VARCHAR FROM s JOIN k USING (conv_id) GROUP BY s.conv_id
UNION ALL SELECT 'reject', CASE WHEN conv_id % 11 = 5 THEN conv_id END, CASE WHEN conv_id % 7 = 0 THEN 2 ELSE 1 END, CASE WHEN conv_id % 11 = 5 THEN 'no_date' ELSE 'not_json|no_metadata|no_date|no_sections' END, NULL FROM (SELECT DISTINCT conv_id FROM conversations) WHERE conv_id % 11 IN (5, 6)
UNION ALL SELECT 'ledger', NULL, count(DISTINCT conv_id), NULL, NULL FROM g""")
def w1_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Session files through the stream in two runs, the second of which goes on where the first ended; what the store then holds."""
    rows = table(spark, sf_dir, "conversations")
    text = lambda corrected: F.concat(F.lit("Corrected: "), "text") if corrected else F.col("text")

    def documents(corrected: bool) -> DataFrame:
        speech = F.concat(F.lit("<p><strong>"), "role", F.lit("</strong>: "), text(corrected), F.lit("</p>"))
        sections = rows.groupBy("conv_id", F.expr("turn div 2").alias("part")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", speech.alias("s")))), lambda x: x["s"]), "").alias("html"))
        held = F.transform(F.array_sort(F.collect_list(F.struct("part", "html"))), lambda x: F.struct(F.concat(F.lit("Part "), x["part"].cast("string")).alias("title"), x["html"].alias("content")))
        day = F.date_format(F.date_add(F.lit("2020-01-01").cast("date"), (F.col("conv_id") % 1000).cast("int")), "dd-MM-yyyy")
        head = F.struct(F.col("conv_id").cast("int").alias("sessionNO"), F.when(F.col("conv_id") % 11 != 5, day).alias("sittingDate"))
        told = sections.groupBy("conv_id").agg(held.alias("s")).select("conv_id", F.to_json(F.struct(head.alias("metadata"), F.col("s").alias("takesSectionVOList"))).alias("j"))
        return told.select("conv_id", F.when(F.col("conv_id") % 11 == 6, F.left("j", F.length("j") - 2)).otherwise(F.col("j")).alias("value"))

    path = new_folder(spark, "ingest")
    run = lambda: ingest.ingest_sessions(spark, f"{path}/in", f"{path}/store", checkpoint=f"{path}/checkpoint", multi_line=False, files=40).awaitTermination()
    documents(False).select("value").write.text(f"{path}/in")
    run()
    documents(True).filter("conv_id % 7 = 0").select("value").write.mode("append").text(f"{path}/in")
    run()
    held = {name: ingest.stored(spark, f"{path}/store", name) for name in ("segments", "transcripts", "rejects")}
    numbers = held["transcripts"].select("session", "session_no")
    segments = held["segments"].join(numbers, "session").select(F.lit("segment").alias("kind"), F.col("session_no").cast("long").alias("session_no"), F.col("segment_index").cast("long").alias("n"), F.concat("speaker", F.lit(" in "), "section_title").alias("label"), F.md5("text").alias("text"))
    transcripts = held["transcripts"].select(F.lit("transcript"), F.col("session_no").cast("long"), "n_segments", F.array_join("speakers", "|"), F.col("n_words").cast("string"))
    # A document that is cut off has no number; one that came twice was rejected twice.
    told = held["rejects"].select("session_no", F.array_join("reasons", "|").alias("label"), F.coalesce("text", F.col("session_no").cast("string")).alias("x"))
    told = told.withColumn("x", F.coalesce(F.get(F.regexp_extract_all("x", F.lit(r'"sessionNO":(\d+)')), F.lit(0)), "x"))
    rejects = told.groupBy("x", "session_no", "label").agg(F.count(F.lit(1)).alias("n")).select(F.lit("reject"), F.col("session_no").cast("long"), "n", "label", F.lit(None).cast("string"))
    counted = held["transcripts"].agg(F.count(F.lit(1))).select(F.lit("ledger"), F.lit(None).cast("long"), F.col("count(1)"), F.lit(None).cast("string"), F.lit(None).cast("string"))
    return segments.union(transcripts).union(rejects).union(counted)


@query("""SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN 2 ELSE 1 END::BIGINT AS version, round(CASE WHEN vec_id % 7 = 0 THEN -1 ELSE 1 END * embedding[1]::DOUBLE, 6) AS first FROM embeddings WHERE vec_id % 5 <> 0 OR vec_id % 7 = 0
UNION ALL SELECT vec_id + 1000000, 2, round(embedding[64]::DOUBLE, 6) FROM embeddings WHERE vec_id % 3 = 0""")
def v7_vector_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors stored, and upserted by id: rows of a wrong width are rejected, every seventh is turned round, others are new."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"))
    path = new_folder(spark, "vectors")
    short = F.when(F.col("vec_id") % 5 == 0, F.slice("embedding", 1, 32)).otherwise(F.col("embedding"))
    keyed.store_vectors(rows.select("vec_id", short.alias("embedding"), F.lit(1).cast("long").alias("version")), path, id_column="vec_id", width=64, version="version", buckets=16)
    turned = rows.filter("vec_id % 7 = 0").select("vec_id", F.transform("embedding", lambda x: -x).alias("embedding"), F.lit(2).cast("long").alias("version"))
    new = rows.filter("vec_id % 3 = 0").select(F.col("vec_id") + 1000000, F.reverse("embedding"), F.lit(2).cast("long"))
    keyed.store_vectors(turned.union(new), path, id_column="vec_id", width=64, version="version", buckets=16)
    return keyed.stored(spark, path).select("vec_id", "version", F.round(F.col("embedding")[0], 6).alias("first"))


@query("""SELECT user_id, max(event_id) AS version, arg_max(event_type, event_id) AS event_type, arg_max(value, event_id) FILTER (WHERE event_id % 2 = 0) AS value FROM events GROUP BY user_id""")
def i8_stored_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Partial updates of users merged into a stored table in two upserts."""
    rows = table(spark, sf_dir, "events").select("user_id", F.col("event_id").alias("version"), "event_type", F.when(F.col("event_id") % 2 == 0, F.col("value")).alias("value"))
    path = new_folder(spark, "users")
    for part in (rows.filter("version % 3 <> 1"), rows.filter("version % 3 = 1")):
        keyed.upsert_stored(part, path, key="user_id", version="version", buckets=16)
    return keyed.stored(spark, path).select("user_id", "version", "event_type", "value")


@query("""WITH m AS (SELECT lang, source, n_chars % 11 AS score FROM documents) SELECT 'all' AS kind, '' AS key, count(*) AS n, round(avg(score), 6) AS mean_score FROM m
UNION ALL SELECT 'lang', lang, count(*), round(avg(score), 6) FROM m WHERE lang IS NOT NULL GROUP BY lang UNION ALL SELECT 'source', source, count(*), round(avg(score), 6) FROM m WHERE source IS NOT NULL GROUP BY source""")
def a2_merged_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics that chunks wrote, and a second merge of merged ones."""
    rows = table(spark, sf_dir, "documents").select((F.col("doc_id") % 13).alias("chunk"), "lang", "source", (F.col("n_chars") % 11).cast("double").alias("score"))
    path = new_folder(spark, "states")
    A.partial_stats(rows, chunk="chunk", score="score", by=("lang", "source")).write.partitionBy("chunk").parquet(path)
    states = spark.read.parquet(path)
    first, rest = A.merged_states(states.filter("chunk < 5")), states.filter("chunk >= 5").drop("chunk")
    return A.merged_stats(first.unionByName(rest)).withColumn("mean_score", F.round("mean_score", 6))
