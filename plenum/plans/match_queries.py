"""Queries of matching (J), ranking (D) and aggregates (A)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plenum.functions.text import clock_seconds
from plenum.operators import aggregates as A
from plenum.operators import matching as M
from plenum.operators import ranking as R
from plenum.operators.chunking import by_time
from plenum.plans.chunk_queries import captions
from plenum.plans.registry import query, table

_DAYS = """s AS (SELECT o_orderkey AS session, o_orderdate::DATE AS day FROM orders WHERE o_orderstatus = 'P'), v AS (SELECT DISTINCT l_orderkey * 10 + l_linenumber AS video, l_shipdate AS published, l_quantity AS q FROM lineitem WHERE l_returnflag = 'R')"""


def _sessions(spark, sf_dir):
    return table(spark, sf_dir, "orders").filter("o_orderstatus = 'P'").select(F.col("o_orderkey").alias("session"), F.to_date("o_orderdate").alias("day"))


def _videos(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").filter("l_returnflag = 'R'")
    return rows.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("video"), F.col("l_shipdate").alias("published"), F.col("l_quantity").alias("q")).distinct()


@query(f"""WITH {_DAYS}, m AS (SELECT session, video, CASE WHEN published::DATE = day THEN 4.0 WHEN abs(date_diff('day', day, published::DATE)) = 1 THEN 3.0 WHEN abs(date_diff('day', day, published::DATE)) = 2 THEN 1.0 ELSE 0 END::DOUBLE + q / 25 AS confidence FROM s, v WHERE published::DATE BETWEEN day - 2 AND day + 3),
b AS (SELECT *, row_number() OVER (PARTITION BY session ORDER BY confidence DESC, video) AS n FROM m WHERE confidence >= 5)
SELECT s.session, b.video, b.confidence FROM s LEFT JOIN b ON b.session = s.session AND n = 1""")
def j1_best_video(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = F.abs(F.datediff(F.to_date("published"), F.col("day")))
    score = F.when(days == 0, 4.0).when(days == 1, 3.0).when(days == 2, 1.0).otherwise(0.0) + F.col("q") / 25
    return M.best_in_window(_sessions(spark, sf_dir), _videos(spark, sf_dir), session="session", day="day", video="video", published="published", score=score).select("session", "video", "confidence")


@query("""WITH v AS (SELECT o_orderkey, o_orderdate::DATE AS day, o_orderpriority LIKE '1%' AS interpreted FROM orders)
SELECT day, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY day ORDER BY interpreted DESC, CASE WHEN interpreted THEN -o_orderkey ELSE o_orderkey END) AS n FROM v) WHERE n = 1""")
def j2_one_per_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("day"), F.col("o_orderpriority").startswith("1").alias("interpreted"))
    return M.one_per_date(rows, day="day", order="o_orderkey", preferred="interpreted").select("day", "o_orderkey")


@query("SELECT c_custkey, EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P') AS has_orders FROM customer")
def j3_flagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").filter("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey"))
    return M.flagged(table(spark, sf_dir, "customer").select("c_custkey"), orders, "c_custkey", "has_orders")


_CH = """q AS (SELECT conv_id, turn, lower(text) AS quote, lower(role) AS speaker FROM conversations), c AS (SELECT conv_id, turn AS pos, turn * 60 AS seconds, lower(CASE WHEN turn % 2 = 0 THEN text ELSE role || ' speaks' END) AS label FROM conversations),
t AS (SELECT conv_id, turn, 0 AS r, quote AS term FROM q UNION ALL SELECT conv_id, turn, 1, speaker FROM q),
h AS (SELECT t.conv_id, t.turn, arg_min(seconds, r * 1000 + pos) AS start FROM t JOIN c ON c.conv_id = t.conv_id AND contains(label, left(term, 30)) GROUP BY t.conv_id, t.turn)"""


def _chapters(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations")
    quotes = rows.select(F.concat_ws("-", "conv_id", "turn").alias("quote_id"), F.col("conv_id").alias("video_id"), F.col("text").alias("quote"), F.col("role").alias("speaker"), "conv_id", "turn")
    chapters = rows.select(F.col("conv_id").alias("video_id"), F.col("turn").alias("pos"), (F.col("turn") * 60).alias("seconds"), F.when(F.col("turn") % 2 == 0, F.col("text")).otherwise(F.concat("role", F.lit(" speaks"))).alias("label"))
    return quotes, M.in_chapters(quotes, chapters)


@query(f"WITH {_CH} SELECT conv_id::VARCHAR || '-' || turn::VARCHAR AS quote_id, start::BIGINT AS start, start::BIGINT + 30 AS stop FROM h")
def j4_chapters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _chapters(spark, sf_dir)[1].select("quote_id", "start", F.col("end").alias("stop"))


_CLOCK = """SELECT event_id, x, greatest(0, x - CASE WHEN abs(x - 36000) <= abs(x - 48600) AND abs(x - 36000) <= abs(x - 68400) THEN 36000 WHEN abs(x - 48600) <= abs(x - 68400) THEN 48600 ELSE 68400 END) AS o FROM (SELECT event_id, hour(ts) * 3600 + minute(ts) * 60 AS x FROM events)"""


@query(f"SELECT event_id, greatest(0, o - 60)::BIGINT AS start, (o + 60)::BIGINT AS stop FROM ({_CLOCK})")
def j5_from_clock(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = M.from_clock(clock_seconds(F.date_format("ts", "h:mm a")))
    return table(spark, sf_dir, "events").select("event_id", m["start"].alias("start"), m["end"].alias("stop"))


@query(f"""WITH {_CH}, k AS (SELECT conv_id, turn, CASE WHEN turn % 3 = 0 THEN 36000 + turn * 100 END AS x FROM q)
SELECT k.conv_id::VARCHAR || '-' || k.turn::VARCHAR AS quote_id, coalesce(h.start, CASE WHEN x IS NOT NULL THEN greatest(0, x - 36060) END, 0)::BIGINT AS start, CASE WHEN h.start IS NOT NULL THEN 'description' WHEN x IS NOT NULL THEN 'approximate' ELSE 'fallback' END AS method FROM k LEFT JOIN (SELECT * FROM h WHERE turn % 2 = 0) h ON h.conv_id = k.conv_id AND h.turn = k.turn""")
def j6_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    quotes, hits = _chapters(spark, sf_dir)
    hits = hits.filter(F.split("quote_id", "-")[1].cast("int") % 2 == 0)
    return M.cascade(quotes, hits, clock=F.when(F.col("turn") % 3 == 0, 36000 + F.col("turn") * 100)).select("quote_id", "start", "method")


@query("SELECT event_id, value - 5 >= 0 AND value - 5 < user_id AND user_id <= 100 AS valid FROM events")
def j7_valid_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", M.valid_range(F.col("value") - 5, F.col("user_id"), F.lit(100)).alias("valid"))


def _quotes_and_cues(spark, sf_dir):
    """Cues are the lines of a conversation's turns; quotes the whole turns, found back among them."""
    rows = table(spark, sf_dir, "conversations")
    cues = rows.select("conv_id", "turn", F.posexplode(F.split("text", "\n")).alias("p", "text"))
    from pyspark.sql import Window

    idx = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "p")) - 1
    cues = cues.select(F.col("conv_id").alias("session"), idx.alias("idx"), (idx * 3.0).alias("t_start"), (idx * 3.0 + 2.5).alias("t_end"), "text")
    return rows.select(F.concat_ws("-", "conv_id", "turn").alias("quote_id"), F.col("conv_id").alias("session"), "text"), cues


_QC = r"""l AS (SELECT conv_id AS session, turn, unnest(string_split(text, chr(10))) AS text, generate_subscripts(string_split(text, chr(10)), 1) AS p FROM conversations),
cue AS (SELECT session, row_number() OVER (PARTITION BY session ORDER BY turn, p) - 1 AS idx, text FROM l),
quote AS (SELECT conv_id::VARCHAR || '-' || turn::VARCHAR AS quote_id, conv_id AS session, text FROM conversations)"""


@query(rf"""WITH {_QC}, qw AS (SELECT DISTINCT quote_id, session, unnest(list_filter(regexp_split_to_array(lower(text), '\s+'), lambda x: x <> '')) AS w FROM quote), n AS (SELECT quote_id, count(*) AS n FROM qw GROUP BY quote_id),
cw AS (SELECT DISTINCT session, idx, unnest(list_filter(regexp_split_to_array(lower(text), '\s+'), lambda x: x <> '')) AS w FROM cue),
m AS (SELECT quote_id, s.idx AS pos, count(DISTINCT qw.w) AS c FROM qw JOIN cw USING (session, w) JOIN cue s ON s.session = qw.session AND s.idx BETWEEN cw.idx - 9 AND cw.idx GROUP BY quote_id, s.idx),
b AS (SELECT *, row_number() OVER (PARTITION BY quote_id ORDER BY c DESC, pos) AS k FROM m)
SELECT b.quote_id, pos, round(c / n::DOUBLE, 6) AS score FROM b JOIN n USING (quote_id) WHERE k = 1""")
def j8_overlap_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.overlap_match(*_quotes_and_cues(spark, sf_dir)).select("quote_id", F.col("at").alias("pos"), F.round("score", 6).alias("score"))


@query(rf"""WITH {_QC}, k AS (SELECT a.session, a.idx, b.idx - a.idx + 1 AS size, trim(regexp_replace(lower(string_agg(c.text, ' ' ORDER BY c.idx)), '\s+', ' ', 'g')) AS t FROM cue a JOIN cue b ON b.session = a.session AND b.idx BETWEEN a.idx AND a.idx + 9 JOIN cue c ON c.session = a.session AND c.idx BETWEEN a.idx AND b.idx GROUP BY a.session, a.idx, b.idx),
m AS (SELECT quote_id, k.idx, size FROM quote q JOIN k ON k.session = q.session AND (contains(t, trim(regexp_replace(lower(q.text), '\s+', ' ', 'g'))) OR contains(trim(regexp_replace(lower(q.text), '\s+', ' ', 'g')), t)))
SELECT quote_id, idx AS pos, size FROM (SELECT *, row_number() OVER (PARTITION BY quote_id ORDER BY idx, size) AS n FROM m) WHERE n = 1""")
def j9_exact_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.exact_match(*_quotes_and_cues(spark, sf_dir)).select("quote_id", F.col("at").alias("pos"), "size")


_FORM = r"trim(regexp_replace(regexp_replace(lower(text), '[^a-z0-9_\s]', ' ', 'g'), '\s+', ' ', 'g'))"


@query(rf"""WITH RECURSIVE {_QC}, f AS (SELECT session, idx, {_FORM} AS t FROM cue),
w AS (SELECT session, idx, word, row_number() OVER (PARTITION BY session ORDER BY idx, p) AS j FROM (SELECT session, idx, unnest(string_split(t, ' ')) AS word, generate_subscripts(string_split(t, ' '), 1) AS p FROM f WHERE t <> '')),
q AS (SELECT quote_id, session, t, string_split(t, ' ') AS w, len(string_split(t, ' ')) AS n FROM (SELECT quote_id, session, {_FORM} AS t FROM quote) WHERE t <> ''),
walk AS (SELECT quote_id, q.session, w.j AS i, w.idx AS c0, w.j, w.idx, 1 AS met, true AS hit, false AS stop FROM q JOIN w ON w.session = q.session AND w.word = q.w[1]
UNION ALL SELECT walk.quote_id, walk.session, walk.i, walk.c0, w.j, w.idx, walk.met + (w.word = q.w[walk.met + 1])::INTEGER, w.word = q.w[walk.met + 1], w.word <> q.w[walk.met + 1] AND w.j - (walk.i + walk.met) > 2
FROM walk JOIN q ON q.quote_id = walk.quote_id JOIN w ON w.session = walk.session AND w.j = walk.j + 1 AND w.idx <= walk.c0 + 29 WHERE NOT walk.stop AND walk.met < q.n),
h AS (SELECT quote_id, c0, idx, max(met) AS met FROM walk WHERE hit GROUP BY quote_id, c0, idx),
r AS (SELECT a.session, a.idx AS s, b.idx AS e, trim(string_agg(c.t, ' ' ORDER BY c.idx) FILTER (WHERE c.t <> '')) AS t FROM f a JOIN f b ON b.session = a.session AND b.idx BETWEEN a.idx AND a.idx + 29 JOIN f c ON c.session = a.session AND c.idx BETWEEN a.idx AND b.idx GROUP BY a.session, a.idx, b.idx),
k AS (SELECT q.quote_id, s, e, q.n, contains(coalesce(r.t, ''), q.t) AS whole FROM q JOIN r ON r.session = q.session),
o AS (SELECT k.quote_id, k.s, k.e, max(h.met) AS met FROM k JOIN h ON h.quote_id = k.quote_id AND h.c0 >= k.s AND h.idx <= k.e GROUP BY k.quote_id, k.s, k.e),
u AS (SELECT quote_id, session, word, count(*) AS m FROM (SELECT quote_id, session, unnest(w) AS word FROM q) GROUP BY quote_id, session, word),
d AS (SELECT quote_id, s, e, sum(m) AS held FROM (SELECT DISTINCT k.quote_id, k.s, k.e, u.word, u.m FROM k JOIN u ON u.quote_id = k.quote_id JOIN w ON w.session = u.session AND w.word = u.word AND w.idx BETWEEN k.s AND k.e) GROUP BY quote_id, s, e),
z AS (SELECT k.quote_id, k.s, k.e, k.n, CASE WHEN whole THEN 1.0::DOUBLE ELSE greatest(coalesce(o.met, 0) / k.n::DOUBLE * 0.9::DOUBLE, coalesce(d.held, 0) / k.n::DOUBLE * 0.7::DOUBLE) END AS score FROM k LEFT JOIN o ON o.quote_id = k.quote_id AND o.s = k.s AND o.e = k.e LEFT JOIN d ON d.quote_id = k.quote_id AND d.s = k.s AND d.e = k.e)
SELECT quote_id, s AS pos, e - s + 1 AS size, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY quote_id ORDER BY score DESC, s, e DESC) AS x FROM z WHERE score >= CASE WHEN n < 10 THEN 0.5::DOUBLE ELSE 0.35::DOUBLE END) WHERE x = 1""")
def j10_fuzzy_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The in-order walk of the SQL carries its state from word to word; also tested against a plain pass over all runs."""
    return M.fuzzy_match(*_quotes_and_cues(spark, sf_dir)).select("quote_id", F.col("at").alias("pos"), "size", F.round("score", 6).alias("score"))


@query(rf"""WITH {_QC}, f AS (SELECT session, idx, trim(regexp_replace(regexp_replace(lower(text), '[^a-z0-9_\s]', ' ', 'g'), '\s+', ' ', 'g')) AS t FROM cue), g AS (SELECT quote_id, session, string_split(trim(regexp_replace(regexp_replace(lower(text), '[^a-z0-9_\s]', ' ', 'g'), '\s+', ' ', 'g')), ' ') AS w FROM quote),
x AS (SELECT quote_id, g.session, idx, t, unnest(w) AS word, len(w) AS n FROM g JOIN f ON f.session = g.session), m AS (SELECT quote_id, idx FROM x GROUP BY quote_id, idx HAVING count(CASE WHEN length(word) > 3 AND contains(t, word) THEN 1 END) >= max(n) * 0.7::DOUBLE)
SELECT quote_id, min(idx) AS pos FROM m GROUP BY quote_id""")
def j11_single_cue(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.single_cue_match(*_quotes_and_cues(spark, sf_dir)).select("quote_id", F.col("at").alias("pos"))


@query("""WITH a AS (SELECT conv_id, [max(turn), 0, 99, min(turn) + 1] AS idx FROM conversations GROUP BY conv_id), u AS (SELECT conv_id, unnest(idx) AS turn, generate_subscripts(idx, 1) AS p FROM a)
SELECT a.conv_id, a.idx[1] AS main_index, string_agg(c.conv_id::VARCHAR || '-' || c.turn::VARCHAR, '|' ORDER BY p) AS ids, min(c.turn) AS first_index, max(c.turn) AS last_index FROM a JOIN u USING (conv_id) JOIN conversations c ON c.conv_id = u.conv_id AND c.turn = u.turn GROUP BY a.conv_id, a.idx""")
def j12_resolve_indices(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations")
    analyses = rows.groupBy(F.col("conv_id").alias("session")).agg(F.array(F.max("turn"), F.lit(0), F.lit(99), F.min("turn") + 1).alias("segment_indices")).withColumn("item", F.col("session"))
    segments = rows.select(F.col("conv_id").alias("session"), F.col("turn").alias("segment_index"), F.concat_ws("-", "conv_id", "turn").alias("segment_id"))
    found = M.resolve_indices(analyses, segments, item="item", session="session")
    return found.select(F.col("session").alias("conv_id"), "main_index", F.array_join("segment_ids", "|").alias("ids"), "first_index", "last_index")


@query("""SELECT o_orderkey, l_linenumber::BIGINT AS line FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey AND l_linenumber = 1 WHERE o_orderdate >= DATE '1997-01-01' ORDER BY o_orderdate DESC, o_orderkey, line LIMIT 50""")
def j13_sessions_videos(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = table(spark, sf_dir, "lineitem").filter("l_linenumber = 1").select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_linenumber").cast("long").alias("line"))
    return M.sessions_with_videos(table(spark, sf_dir, "orders"), first, key="o_orderkey", day="o_orderdate", since="1997-01-01", order=("line",)).select("o_orderkey", "line")


@query("""WITH p AS (SELECT a.conv_id::VARCHAR || '-' || a.turn::VARCHAR AS pair_id, a.text AS a, b.text AS b FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1),
x AS (SELECT pair_id, i, a[i] AS ch FROM (SELECT pair_id, a, unnest(range(1, length(a) + 1)) AS i FROM p)), y AS (SELECT pair_id, j, b[j] AS ch FROM (SELECT pair_id, b, unnest(range(1, length(b) + 1)) AS j FROM p)),
s AS (SELECT x.pair_id, i, i - j AS d FROM x JOIN y ON x.pair_id = y.pair_id AND x.ch = y.ch), g AS (SELECT pair_id, d, i - row_number() OVER (PARTITION BY pair_id, d ORDER BY i) AS k FROM s),
m AS (SELECT pair_id, max(n) AS n FROM (SELECT pair_id, d, k, count(*) AS n FROM g GROUP BY pair_id, d, k) GROUP BY pair_id)
SELECT p.pair_id, round(coalesce(n / nullif(length(a), 0)::DOUBLE, 0), 6) AS ratio FROM p LEFT JOIN m ON m.pair_id = p.pair_id""")
def j14_substring_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All adjacent turns and their whole texts."""
    rows = table(spark, sf_dir, "conversations")
    a = rows.select("conv_id", "turn", F.concat_ws("-", "conv_id", "turn").alias("pair_id"), F.col("text").alias("a"))
    b = rows.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("b"))
    return M.substring_ratio(a.join(b, ["conv_id", "turn"]), pair_id="pair_id").select("pair_id", F.round("ratio", 6).alias("ratio"))


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey % 50 = 0")
def j15_by_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.concat(F.lit("parliament-"), F.date_format("o_orderdate", "dd-MM-yyyy"), F.lit("-"), F.col("o_orderkey").cast("string"))
    rows = table(spark, sf_dir, "orders").select(key.alias("moment_id"), F.to_date("o_orderdate").alias("day"), "o_orderkey", "o_totalprice")
    return M.by_ids(rows, rows.filter("o_orderkey % 50 = 0").select("moment_id"), key="moment_id", partition="day").select("o_orderkey", "o_totalprice")


@query("SELECT doc_id FROM (SELECT doc_id, row_number() OVER (PARTITION BY trim(lower(text)) ORDER BY doc_id) AS n FROM documents) WHERE n = 1")
def d1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.exact_dedup(table(spark, sf_dir, "documents"), quote="text", order="doc_id").select("doc_id")


@query("""WITH d AS (SELECT doc_id, trim(lower(text)) AS k, doc_id % 3 = 0 AS o FROM documents)
SELECT min(doc_id) AS first_pos, coalesce(max(CASE WHEN NOT o THEN doc_id END), min(doc_id)) AS doc_id, count(*) - 1 AS n_removed FROM d GROUP BY k""")
def d2_overlap_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("quote"), (F.col("doc_id") % 3 == 0).alias("in_overlap"))
    return R.overlap_dedup(rows, order="doc_id", overlap="in_overlap").select("first_pos", "doc_id", "n_removed")


@query("""SELECT source, doc_id, rank FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id)::INTEGER AS rank FROM documents WHERE n_chars >= 500 AND lang IN ('en', 'de')) WHERE rank <= 5""")
def d4_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.best(table(spark, sf_dir, "documents"), group="source", score="n_chars", order="doc_id", limit=5, least=500, keep={"lang": ("en", "de")}).select("source", "doc_id", "rank")


@query("""SELECT d.source, d.doc_id, d.n_chars AS initial_score, l.quality * 10 + l.toxic AS final_score, row_number() OVER (PARTITION BY source ORDER BY l.quality * 10 + l.toxic DESC, d.doc_id)::INTEGER AS rank FROM documents d JOIN labels l USING (doc_id)""")
def d5_rescored(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = table(spark, sf_dir, "labels").select("doc_id", (F.col("quality") * 10 + F.col("toxic")).alias("final_score"))
    return R.rescored(table(spark, sf_dir, "documents"), scores, id_column="doc_id", group="source", initial="n_chars", order="doc_id").select("source", "doc_id", "initial_score", "final_score", "rank")


@query("SELECT event_id, value FROM events WHERE value > 7.5 ORDER BY value DESC, event_id LIMIT 20")
def d6_final_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.final_cut(table(spark, sf_dir, "events"), score="value", order="event_id").select("event_id", "value")


@query("SELECT event_id, value FROM events WHERE ts >= TIMESTAMP '2024-01-13' AND ts <= TIMESTAMP '2024-01-20' AND value >= 7 ORDER BY value DESC, event_id LIMIT 10")
def d7_trending(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.trending(table(spark, sf_dir, "events"), as_of="2024-01-20 00:00:00", score="value", created="ts", order="event_id").select("event_id", "value")


@query("SELECT o_orderkey, o_orderdate::DATE AS day FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 25")
def d8_newest(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("day"))
    return R.newest(rows, day="day", order="o_orderkey", limit=25)


@query("""SELECT o_orderkey, t.total, CASE WHEN 150 < t.total THEN 150 END::BIGINT AS next_offset, round(least(150, t.total) * 100.0::DOUBLE / t.total, 2) AS progress FROM (SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 50 OFFSET 100), (SELECT count(*) AS total FROM orders) t""")
def d9_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, totals = R.page(table(spark, sf_dir, "orders").select("o_orderkey"), key="o_orderkey", offset=100, limit=50)
    return rows.join(F.broadcast(totals))


@query(r"""WITH t AS (SELECT *, len(list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '')) AS n FROM conversations), f AS (SELECT conv_id, role, min(turn) AS first FROM conversations GROUP BY conv_id, role)
SELECT conv_id, count(*) AS n_segments, sum(n)::BIGINT AS n_words, (SELECT string_agg(role, '|' ORDER BY first) FROM f WHERE f.conv_id = t.conv_id) AS speakers FROM t GROUP BY conv_id""")
def a1_roll_up(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = A.roll_up(table(spark, sf_dir, "conversations"), session="conv_id", order="turn", speaker="role")
    return rows.select("conv_id", "n_segments", "n_words", F.array_join("speakers", "|").alias("speakers"))


@query("""WITH d AS (SELECT lang, source, n_chars FROM documents), x AS (SELECT 'all' AS kind, '' AS key, n_chars FROM d UNION ALL SELECT 'lang', lang, n_chars FROM d UNION ALL SELECT 'source', source, n_chars FROM d)
SELECT kind, key, count(*) AS n, round(avg(n_chars), 6) AS mean_score FROM x GROUP BY kind, key""")
def a2_extraction_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.extraction_stats(table(spark, sf_dir, "documents"), score="n_chars", by=("lang", "source")).withColumn("mean_score", F.round("mean_score", 6))


_STAGE = "CASE WHEN doc_id % 7 = 0 THEN 'exact' WHEN doc_id % 11 = 0 THEN 'semantic' ELSE 'final' END"


@query(f"""WITH c AS (SELECT {_STAGE} AS stage, n_chars AS i, n_chars % 100 AS f FROM documents) SELECT count(*) AS candidates, count(CASE WHEN stage = 'exact' THEN 1 END) AS removed_exact, count(CASE WHEN stage = 'semantic' THEN 1 END) AS removed_semantic, count(CASE WHEN stage = 'final' THEN 1 END) AS n_final,
round(avg(CASE WHEN stage = 'final' THEN i END), 6) AS mean_initial, round(avg(CASE WHEN stage = 'final' THEN f END), 6) AS mean_final, max(CASE WHEN stage = 'final' THEN f END) AS top_score FROM c""")
def a3_consolidation(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select(F.expr(_STAGE).alias("stage"), F.col("n_chars").alias("initial_score"), (F.col("n_chars") % 100).alias("final_score"))
    return A.consolidation_stats(rows).withColumns({c: F.round(c, 6) for c in ("mean_initial", "mean_final")})


@query("""WITH t AS (SELECT user_id, event_id, event_type, (epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01')) / 1000000.0::DOUBLE AS a, least(value, 60.0::DOUBLE) AS v FROM events), c AS (SELECT user_id, floor(a / 86400)::BIGINT AS r, count(*) AS n, count(CASE WHEN event_type = 'error' THEN 1 END) AS m FROM t GROUP BY 1, 2), l AS (SELECT user_id, arg_max(a + v, a) AS last FROM t GROUP BY user_id)
SELECT user_id::VARCHAR || '-' || r::VARCHAR AS chunk_id, round(least((r + 1) * 86400, last) - r * 86400, 3) AS duration, n AS caption_count, m AS n_moments, r % 2 = 0 AS has_overlap FROM c JOIN l USING (user_id)""")
def a4_chunk_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = captions(spark, sf_dir)
    chunk = F.concat_ws("-", "user_id", F.col("range_index"))
    chunks = by_time(rows, session="user_id", seconds=86400.0).select(chunk.alias("chunk_id"), "start_time", "end_time", "caption_count", F.when(F.col("range_index") % 2 == 0, 0.0).alias("overlap_start"))
    moments = rows.filter("text = 'error'").select(F.concat_ws("-", "user_id", F.floor(F.col("t_start") / 86400)).alias("chunk_id"))
    return A.chunk_summary(chunks, moments).withColumn("duration", F.round("duration", 3))


@query("SELECT user_id, count(*) AS n, count(CASE WHEN event_type = 'click' THEN 1 END) AS n_matched, count(CASE WHEN event_type = 'error' THEN 1 END) AS n_category, round(count(CASE WHEN event_type = 'click' THEN 1 END) / count(*)::DOUBLE, 6) AS rate FROM events GROUP BY user_id")
def a5_match_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.match_rate(table(spark, sf_dir, "events"), group="user_id", matched=F.col("event_type") == "click", category=F.col("event_type") == "error").withColumn("rate", F.round("rate", 6))


@query("""WITH p AS (SELECT event_type AS model, user_id, max(value > 5) AS ok, sum(event_id % 5)::BIGINT AS m, sum(value) AS c, avg(value) AS l, sum(event_id % 2)::BIGINT AS x FROM events GROUP BY 1, 2)
SELECT model, count(*) AS n_sessions, count(CASE WHEN ok THEN 1 END) AS n_ok, sum(m)::BIGINT AS n_moments, round(sum(c), 3) AS cost, round(avg(l), 5) AS mean_latency, round(sum(x) / sum(m)::DOUBLE, 6) AS match_rate FROM p GROUP BY model""")
def a6_compare_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select(F.col("event_type").alias("model"), F.col("user_id").alias("session"), (F.col("value") > 5).alias("ok"), (F.col("event_id") % 5).alias("n_moments"), F.col("value").alias("cost"), F.col("value").alias("latency"), (F.col("event_id") % 2).alias("n_matched"))
    return A.compare_runs(rows).withColumns({"cost": F.round("cost", 3), "mean_latency": F.round("mean_latency", 5), "match_rate": F.round("match_rate", 6)})


@query("SELECT year(o_orderdate) AS year, count(*) AS n, count(CASE WHEN o_orderstatus = 'F' THEN 1 END) AS n_done, max(o_orderdate)::DATE AS latest FROM orders GROUP BY 1")
def a7_per_year(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").withColumn("day", F.to_date("o_orderdate"))
    return A.per_year(rows, day="day", done=F.col("o_orderstatus") == "F")


@query("""SELECT user_id, count(CASE WHEN event_type <> 'error' THEN 1 END) AS n_ok, count(CASE WHEN event_type = 'error' THEN 1 END) AS n_failed, coalesce(string_agg(CASE WHEN event_type = 'error' THEN event_id::VARCHAR END, ',' ORDER BY event_id), '') AS errors FROM events GROUP BY user_id""")
def a8_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = A.outcomes(table(spark, sf_dir, "events"), batch="user_id", ok=F.col("event_type") != "error", error=F.col("event_id").cast("string"), order="event_id")
    return rows.withColumn("errors", F.array_join("errors", ","))


@query("SELECT count(*) AS n, round(coalesce(sum(n_chars), 0) / 1048576.0::DOUBLE, 6) AS mb FROM documents WHERE source LIKE 'src1%' AND doc_id < 600")
def a9_retention(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select(F.concat("source", F.lit("/"), F.col("doc_id").cast("string")).alias("key"), F.col("n_chars").alias("size"), F.col("doc_id").alias("uploaded"))
    return A.retention_report(rows, prefix="src1", before=F.lit(600)).withColumn("mb", F.round("mb", 6))


@query("SELECT round(avg((quality = 1)::INTEGER) * 100, 4) AS good, round(avg((toxic = 1)::INTEGER) * 100, 4) AS toxic FROM labels")
def a10_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.coverage(table(spark, sf_dir, "labels"), good=F.col("quality") == 1, toxic=F.col("toxic") == 1)


@query("SELECT event_id, ts, value FROM events WHERE user_id = 7")
def a11_timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.timeline(table(spark, sf_dir, "events"), F.col("user_id") == 7, at="ts", order="event_id").select("event_id", "ts", "value")
