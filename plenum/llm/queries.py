"""Registered queries of the numbered operators, with the SQL that states their results where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plenum.llm import clustering, contamination, language_id, licenses, line_dedup, near_dedup, neighbours, packing, passages, phrases, pii, quality, vector_dedup
from plenum.llm.tables import table


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", held.alias("held_out"))
    found = language_id.identify(texts, language_id.train(language_id.sample(docs)))
    return found.select("doc_id", "held_out", "lang_pred", F.col("lang_score").alias("score"), F.col("lang_rejected").alias("rejected"))


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.repeated_passages(table(spark, sf_dir, "documents"))


def op3_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return neighbours.nearest(vectors, vectors.filter("vec_id % 100 = 0"))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.detect(table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["kind"].isin(*pii.BASE_KINDS))
    counts = [F.size(pii.of_kind(F.col("spans"), k)).cast("long").alias(f"n_{k}") for k in pii.BASE_KINDS]
    score = F.coalesce(F.array_max(F.transform("spans", lambda s: s["score"])), F.lit(0.0))
    return found.select("doc_id", *counts, F.sha2(pii.listing(base), 256).alias("base_sha256"), pii.listing(F.col("spans")).alias("spans"), score.alias("score"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(table(spark, sf_dir, "documents"))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = line_dedup.repeated_lines(docs).withColumnsRenamed({"doc_id": "of", "copy": "of_copy"})
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.col("text").cast("string")).alias("copy"))
    joined = rows.join(found, (F.col("doc_id") == F.col("of")) & (F.col("copy") == F.col("of_copy")), "left")
    gone = F.coalesce("gone", F.array().cast("array<int>"))
    return joined.select("doc_id", F.coalesce("n_lines", F.lit(0)).alias("n_lines"), F.size(gone).cast("long").alias("n_gone"), F.array_join(gone.cast("array<string>"), ",").alias("gone_lines"))


def op8_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path())


def op10_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan(table(spark, sf_dir, "documents"))
    base, both = F.transform("base", lambda b: b["label"]), F.concat(F.transform("base", lambda b: b["label"]), F.transform("detections", lambda d: d["label"]))
    listed = lambda labels: F.array_join(F.sort_array(F.array_distinct(labels)), ",")
    weight = F.coalesce(F.array_max(F.transform("detections", lambda d: d["weight"])), F.lit(0.0))
    return found.select(
        "doc_id", F.col("n_words").cast("long").alias("n_words"), F.size("base").cast("long").alias("n_base"),
        F.array_min(F.transform("base", lambda b: b["start"])).cast("long").alias("first_word"), F.array_max(F.transform("base", lambda b: b["start"])).cast("long").alias("last_word"),
        listed(base).alias("base_labels"), listed(both).alias("labels"), F.greatest(weight, F.when(F.size("base") > 0, F.lit(0.5)).otherwise(F.lit(0.0))).alias("score"),
    )


def op11_vector_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_dedup.near_equal_vectors(table(spark, sf_dir, "embeddings"))


def op12_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = clustering.with_inertia(clustering.cluster(table(spark, sf_dir, "embeddings")))
    return found.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", F.sha2("centroid", 256).alias("centroid_sha256"))


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_language_id, op2_substring_dedup, op3_neighbours, op4_decontamination, op5_pii, op6_quality, op7_line_dedup, op8_near_dedup, op9_packing, op10_licenses, op11_vector_dedup, op12_clustering, op13_collocations)}


_LOW = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = rf"regexp_extract_all({_LOW}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

_OP4 = f"""WITH dw AS (SELECT doc_id, {_WORDS} AS w FROM documents), iw AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
win AS (SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[p:p + least(len(w), 10) - 1], ' ') AS g FROM iw, unnest(generate_series(1, greatest(len(w) - 9, 1))) t(p) WHERE len(w) > 0),
dg AS (SELECT doc_id, p, n, array_to_string(w[p:p + n - 1], ' ') AS g FROM dw, (SELECT DISTINCT n FROM win), unnest(generate_series(1, len(w) - n + 1)) t(p)),
m AS (SELECT doc_id, p, dg.n, item_id FROM dg JOIN win ON dg.n = win.n AND dg.g = win.g),
hit AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(generate_series(p, p + n - 1)) AS q FROM m) GROUP BY doc_id),
it AS (SELECT doc_id, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS ids FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS i FROM m) GROUP BY doc_id)
SELECT dw.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN hit ON hit.doc_id = dw.doc_id LEFT JOIN it ON it.doc_id = dw.doc_id"""

_OP8 = rf"""WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({_LOW}, '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[p:p + 4], ' ') AS g FROM d, unnest(generate_series(1, greatest(len(w) - 4, 1))) t(p) WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id),
l AS (SELECT x, y FROM c JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * c >= 75 * (a.n + b.n - c)),
e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
r AS (SELECT doc_id AS x, doc_id AS y FROM d UNION SELECT r.x, e.y FROM r JOIN e ON e.x = r.y),
k AS (SELECT x, min(y) AS component_id FROM r GROUP BY x)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, component_id, d.doc_id = component_id AS kept FROM d LEFT JOIN n ON n.doc_id = d.doc_id JOIN k ON k.x = d.doc_id"""


_DECIMAL = "CAST(floor(256 * x) AS BIGINT)"
_ROUND = """d{r} AS (SELECT vec_id, n, sum((v.x - c.x) * (v.x - c.x))::BIGINT AS d FROM long v JOIN c{r} c USING (i) GROUP BY vec_id, n),
a{r} AS (SELECT vec_id, n, d FROM d{r} QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY d, n) = 1)"""
_MOVE = """s{r} AS (SELECT n, i, sum(x) AS s, count(*) AS m FROM a{r} JOIN long USING (vec_id) GROUP BY n, i),
c{t} AS (SELECT c.n, c.i, CASE WHEN m IS NULL THEN c.x ELSE ((s - (((s % m) + m) % m)) // m)::BIGINT END AS x FROM c{r} c LEFT JOIN s{r} s ON s.n = c.n AND s.i = c.i)"""

_OP12 = f"""WITH kept AS (SELECT vec_id, embedding FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64),
long AS (SELECT vec_id, i, {_DECIMAL} AS x FROM (SELECT vec_id, unnest(range(1, 65)) AS i, unnest(embedding)::DOUBLE AS x FROM kept)),
c0 AS (SELECT n, i, x FROM (SELECT vec_id, row_number() OVER (ORDER BY sha256('2:' || vec_id::VARCHAR)) - 1 AS n FROM kept QUALIFY n < 40) JOIN long USING (vec_id)),
{", ".join(_ROUND.format(r=r) + ("," + _MOVE.format(r=r, t=r + 1) if r < 5 else "") for r in range(6))},
h AS (SELECT n, sha256(string_agg(x::VARCHAR, ',' ORDER BY i)) AS centroid_sha256 FROM c5 GROUP BY n)
SELECT vec_id, n::INTEGER AS cluster, d AS distance, (sum(d) OVER (PARTITION BY n))::BIGINT AS cluster_inertia, (sum(d) OVER ())::BIGINT AS inertia, centroid_sha256 FROM a5 JOIN h USING (n)"""


_OP13 = rf"""WITH p AS (SELECT lang, string_split_regex(trim(piece, ' ' || chr(9)), '[\x20\x09]+') AS w
FROM (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex({_LOW}, '[.,;:!?\x0A-\x0D]')) AS piece FROM documents) WHERE trim(piece, ' ' || chr(9)) <> ''),
n AS (SELECT lang, sum(len(w))::BIGINT AS n FROM p GROUP BY lang),
f AS (SELECT lang, k, g, count(*) AS f FROM (SELECT lang, k, w[i:i + k - 1] AS g FROM p, (SELECT unnest([1, 2, 3, 4]) AS k), unnest(generate_series(1, len(w) - k + 1)) t(i)) GROUP BY lang, k, g HAVING count(*) >= 30),
cut AS (SELECT c.lang, c.g, c.f AS a, j, l.f AS l, r.f AS r, 2000000 * c.f::HUGEINT // (l.f::HUGEINT + r.f) AS score
FROM (SELECT *, unnest(generate_series(1, k - 1)) AS j FROM f WHERE k > 1) c JOIN f l ON l.lang = c.lang AND l.g = c.g[1:j] JOIN f r ON r.lang = c.lang AND r.g = c.g[j + 1:c.k]),
low AS (SELECT * FROM cut QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, j) = 1),
sub AS (SELECT lang, h, max(f) AS f FROM (SELECT lang, f, g[i:i + m - 1] AS h FROM (SELECT *, unnest(generate_series(2, k - 1)) AS m FROM f WHERE k > 2), unnest(generate_series(1, k - m + 1)) t(i)) GROUP BY lang, h),
kept AS (SELECT low.*, array_to_string(low.g, ' ') AS phrase FROM low LEFT JOIN sub ON sub.lang = low.lang AND sub.h = low.g WHERE sub.f IS NULL OR 100 * sub.f::HUGEINT < 80 * a::HUGEINT)
SELECT lang, rank, phrase, a, l, r, n, score FROM (SELECT kept.lang, row_number() OVER (PARTITION BY kept.lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score::BIGINT AS score FROM kept JOIN n ON n.lang = kept.lang) WHERE rank <= 2000"""


def oracle_sql() -> dict[str, str]:
    return {"op13_collocations": _OP13, "op12_clustering": _OP12, "op4_decontamination": _OP4, "op8_near_dedup": _OP8}
