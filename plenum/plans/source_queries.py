"""Queries of readers (S1, S5, S7, S11), whose files are written from the tables first, of user functions (U1-U3), and of operators beside the main ones of their row."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plenum.operators import chunking as C
from plenum.operators import incremental as I
from plenum.operators import ranking as R
from plenum.operators import scoring as S
from plenum.operators import vectors as V
from plenum.plans.registry import query, table
from plenum.sources import readers
from plenum.sources.shared import new_folder

@query("""SELECT conv_id::INTEGER AS session_no, DATE '2020-01-01' + (conv_id % 1000)::INTEGER AS session_date, count(*) AS n_sections, md5(string_agg(role || text, '|' ORDER BY turn)) AS text FROM conversations GROUP BY conv_id""")
def s1_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations written as JSON session documents, one a line of the tasks' files, and read back by the reader."""
    day = F.date_format(F.date_add(F.lit("2020-01-01").cast("date"), (F.col("conv_id") % 1000).cast("int")), "dd-MM-yyyy")
    sections = F.transform(F.array_sort(F.collect_list(F.struct("turn", F.col("role").alias("title"), F.col("text").alias("content")))), lambda x: F.struct(x["title"].alias("title"), x["content"].alias("content")))
    rows = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(sections.alias("s"))
    told = rows.select(F.to_json(F.struct(F.struct(F.col("conv_id").cast("int").alias("sessionNO"), day.alias("sittingDate")).alias("metadata"), F.col("s").alias("takesSectionVOList"))).alias("j"))
    path = new_folder(spark, "sessions")
    told.select(F.col("j").alias("value")).write.text(path)
    found = readers.sessions(spark, path, multi_line=False)
    text = F.array_join(F.transform("takesSectionVOList", lambda s: F.concat(s["title"], s["content"])), "|")
    return found.select(F.col("metadata.sessionNO").alias("session_no"), "session_date", F.size("takesSectionVOList").cast("long").alias("n_sections"), F.md5(text).alias("text"))


@query("""WITH e AS (SELECT ts::DATE AS session_date, event_id, user_id, event_type, row_number() OVER (PARTITION BY ts::DATE ORDER BY event_id) - 1 AS n FROM events)
SELECT session_date, n AS segment_index, 'seg-' || lpad(n::VARCHAR, greatest(5, length(n::VARCHAR))::INTEGER, '0') AS segment_id, event_id::DOUBLE AS t_start, (event_id + 2)::DOUBLE AS t_end, event_type || ' ' || user_id::VARCHAR AS text, 'Unknown' AS speaker FROM e""")
def s5_caption_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each day's events written as a JSON caption list whose name holds the date, and read back as segments."""
    start = F.col("event_id").cast("double")
    item = F.struct("event_id", F.struct(start.alias("start"), (start + 2).alias("end"), F.concat(F.lit(" "), "event_type", F.lit(" "), F.col("user_id").cast("string"), F.lit(" ")).alias("text")).alias("s"))
    lists = table(spark, sf_dir, "events").groupBy(F.date_format("ts", "dd-MM-yyyy").alias("day")).agg(F.array_sort(F.collect_list(item)).alias("x"))
    path = new_folder(spark, "captions")
    lists.select("day", F.to_json(F.struct(F.transform("x", lambda x: x["s"]).alias("segments"))).alias("value")).write.partitionBy("day").text(path)
    found = readers.caption_lists(spark, f"{path}/day=*")
    return found.select("session_date", F.col("segment_index").cast("long").alias("segment_index"), "segment_id", "t_start", "t_end", "text", "speaker")


@query("""SELECT lpad(doc_id::VARCHAR, 11, '0') AS video_id, source AS title, NULL::DATE AS date FROM documents WHERE doc_id % 5 NOT IN (0, 1) UNION ALL SELECT NULL, NULL, o_orderdate::DATE FROM orders""")
def s7_playlist(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Playlist lines of all documents, with private videos and warnings among them, and a date list of all orders, read back."""
    doc = F.col("doc_id")
    line = F.when(doc % 5 == 0, F.concat(F.lpad(doc.cast("string"), 11, "0"), F.lit("|[Private video]|NA"))).when(doc % 5 == 1, F.lit("WARNING: no such video")).otherwise(F.concat(F.lpad(doc.cast("string"), 11, "0"), F.lit("| "), "source", F.lit("|NA")))
    lists, dates = new_folder(spark, "playlist"), new_folder(spark, "dates")
    # The reader takes files whole, as playlists are short; so none gets many lines.
    table(spark, sf_dir, "documents").select(line.alias("value")).write.option("maxRecordsPerFile", 10_000).text(lists)
    table(spark, sf_dir, "orders").select(F.concat(F.date_format("o_orderdate", "d-M-yyyy"), F.lit("  # order "), F.col("o_orderkey").cast("string")).alias("value")).write.text(dates)
    found = readers.playlist(spark, lists).select("video_id", "title", F.lit(None).cast("date").alias("date"))
    return found.unionByName(readers.date_list(spark, dates).select(F.lit(None).cast("string").alias("video_id"), F.lit(None).cast("string").alias("title"), "date"))


@query("SELECT date_trunc('month', o_orderdate)::DATE AS date, (count(*) * 9)::BIGINT AS size FROM orders GROUP BY 1")
def s11_stored_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One stored object for each month of the orders, of nine bytes an order, found by its metadata alone."""
    path = new_folder(spark, "objects")
    held = table(spark, sf_dir, "orders").groupBy(F.date_format("o_orderdate", "01-MM-yyyy").alias("day")).agg(F.count(F.lit(1)).alias("n"))
    held.select("day", F.array_join(F.array_repeat(F.lit("order ok"), F.col("n").cast("int")), "\n").alias("value")).write.partitionBy("day").text(path)
    return readers.listing(spark, path).filter("date IS NOT NULL").groupBy("date").agg(F.sum("size").alias("size"))


@query("SELECT doc_id, CASE WHEN contains(text, '!!') THEN -1 ELSE length(text) END::DOUBLE AS n_chars, CASE WHEN contains(text, '!!') THEN 0 ELSE length(text) - length(replace(text, ' ', '')) END::DOUBLE AS n_blanks FROM documents")
def u1_user_embedding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's embedding function, which gives nothing for some texts, and a fallback for these."""
    own = lambda texts: [None if "!!" in t else [float(len(t)), float(t.count(" "))] for t in texts]
    found = V.embed(table(spark, sf_dir, "documents"), own, id_column="doc_id", width=2, fallback=lambda texts: [[-1.0, 0.0] for _ in texts])
    return found.select("doc_id", F.col("embedding")[0].cast("double").alias("n_chars"), F.col("embedding")[1].cast("double").alias("n_blanks"))


@query("""WITH p AS (SELECT conv_id, string_agg('[' || turn::VARCHAR || '] ' || role || ': ' || text, chr(10) ORDER BY turn) AS prompt FROM conversations GROUP BY conv_id) SELECT conv_id, 'answer to ' || length(prompt)::VARCHAR AS response FROM p""")
def u2_user_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's model function over the prompts of all conversations."""
    rows = C.prompts(table(spark, sf_dir, "conversations"), session="conv_id", order="turn", speaker="role")
    return V.respond(rows, lambda prompts: [f"answer to {len(p)}" for p in prompts], id_column="conv_id")


_OWN = ("tion", "und", "que")
_OWN_HITS = " + ".join(f"(contains(lower(text), '{w}'))::INTEGER" for w in _OWN)


@query(rf"SELECT doc_id, round(least(({_OWN_HITS}) / greatest(len(regexp_split_to_array(text, '\s+')) / 10.0::DOUBLE, 1.0::DOUBLE), 1.0::DOUBLE), 6) AS jargon, contains(lower(text), 'und') AND contains(lower(text), 'que') AS contradiction FROM documents")
def u3_user_lexicon(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scoring rules with a user's lexicons."""
    rules = ((("und",), ("que",)),)
    return table(spark, sf_dir, "documents").select("doc_id", F.round(S.jargon_score(F.col("text"), _OWN), 6).alias("jargon"), S.contradicts(F.col("text"), rules).alias("contradiction"))


_COS = "list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[])"


@query(f"""WITH h AS (SELECT query_id, rank, vec_id, round(score, 6) AS score FROM (SELECT b.vec_id AS query_id, a.vec_id, {_COS} AS score, row_number() OVER (PARTITION BY b.vec_id ORDER BY {_COS} DESC, a.vec_id) AS rank FROM embeddings a JOIN embeddings b ON b.vec_id % 50 = 0) WHERE rank <= 3)
SELECT query_id, md5(string_agg('--- Source ' || rank::VARCHAR || ' (Confidence: ' || printf('%.1f', score * 100) || '%) ---' || chr(10) || text, chr(10) || chr(10) ORDER BY rank)) AS context FROM h JOIN documents ON doc_id = vec_id GROUP BY query_id""")
def c14_source_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best documents of each question as numbered sources."""
    rows = table(spark, sf_dir, "embeddings")
    asked = rows.filter("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    hits = V.top_k(asked, rows, 3).withColumn("score", F.round("score", 6)).join(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("vec_id"), "text"), "vec_id")
    return C.source_context(hits, query="query_id").select("query_id", F.md5("context").alias("context"))


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')")
def i5_unprocessed(spark: SparkSession, sf_dir: str) -> DataFrame:
    ledger = table(spark, sf_dir, "orders").filter("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey"))
    return I.unprocessed(table(spark, sf_dir, "customer").select("c_custkey"), ledger, "c_custkey")


@query("""SELECT c_custkey AS id, 'stored' AS origin FROM customer WHERE c_custkey % 3 > 0 UNION ALL SELECT DISTINCT o_custkey, 'found' FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 3 > 0)""")
def i9_insert_new(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = table(spark, sf_dir, "customer").filter("c_custkey % 3 > 0").select(F.col("c_custkey").alias("id"), F.lit("stored").alias("origin"))
    return I.insert_new(stored, table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("id"), F.lit("found").alias("origin")), "id")


@query("SELECT o_orderkey FROM orders WHERE o_orderkey > (SELECT max(o_orderkey) // 2 FROM orders) ORDER BY o_orderkey LIMIT 50")
def d9_page_after(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select("o_orderkey")
    return R.page_after(rows, key="o_orderkey", after=rows.agg(F.floor(F.max("o_orderkey") / 2)).first()[0], limit=50)


@query("""SELECT d.doc_id, d.n_chars AS initial_score, l.quality * 10 + l.toxic AS final_score, row_number() OVER (ORDER BY l.quality * 10 + l.toxic DESC, d.doc_id)::INTEGER AS rank FROM documents d JOIN labels l USING (doc_id)""")
def d5_rescored_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rank over all rows, without a window that holds them all."""
    scores = table(spark, sf_dir, "labels").select("doc_id", (F.col("quality") * 10 + F.col("toxic")).alias("final_score"))
    return R.rescored(table(spark, sf_dir, "documents"), scores, id_column="doc_id", initial="n_chars", order="doc_id").select("doc_id", "initial_score", "final_score", "rank")


@query("""SELECT vec_id, round(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]), 3) AS energy FROM embeddings""")
def v8_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Principal components as many as the vectors are wide: a turned frame, in which every vector keeps its length."""
    rows = table(spark, sf_dir, "embeddings")
    width = rows.select(F.max(F.size("embedding"))).first()[0]
    turned = V.project(rows, id_column="vec_id", dimensions=width)
    return turned.select("vec_id", F.round(V.dot(F.col("projection"), F.col("projection")), 3).alias("energy"))


@query("""SELECT vec_id, true AS nearest FROM embeddings""")
def v9_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """k-means: whether each vector's cluster is the one whose centre is nearest to it."""
    rows = table(spark, sf_dir, "embeddings")
    found, centers = V.cluster(rows, 8, id_column="vec_id")
    away = lambda c: F.aggregate(F.zip_with("embedding", c, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)
    held = rows.join(found, "vec_id").join(F.broadcast(centers.agg(F.collect_list(F.struct(F.col("cluster_id").alias("i"), F.col("centroid").alias("c"))).alias("all"))))
    told = held.select("vec_id", "cluster_id", F.transform("all", lambda x: F.struct(away(x["c"]).alias("d"), x["i"].alias("i"))).alias("d"))
    own = F.filter("d", lambda x: x["i"] == F.col("cluster_id"))[0]["d"]
    return told.select("vec_id", (own <= F.array_min(F.transform("d", lambda x: x["d"])) + 1e-6).alias("nearest"))
