"""The pipeline's stages on rows with nulls, repeated ids, clashing names and an empty table, each against a plain pass."""

import random
import re

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from plenum.llm import line_dedup, packing

DATA = "/root/testdata/sf0.001"
STAGES = dict(corpus_pipeline.STAGES)
#: Names that stages use within themselves, or that a user may have given to columns of their own.
CLASHES = ["lang_pred", "lang_score", "lang_rejected", "row", "own", "gone", "left", "of", "of_copy", "own_copy", "copy", "bad", "gone_id", "doc", "_text", "whole", "column_0", "component_id", "kept"]


def frame(spark, rows):
    made = spark.createDataFrame([(i, t, "en", len(t) if t is not None else None) for i, t in rows], "doc_id long, text string, lang string, n_chars long").repartition(3)
    return made.withColumns({c: F.lit(f"user {c}") for c in CLASHES})


@pytest.fixture(scope="module")
def sentences():
    rng = random.Random(21)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randrange(3, 8)))
    return lambda n: " ".join(word() for _ in range(n))


def told(df):
    return sorted(((r.doc_id, r.text) for r in df.collect()), key=repr)


@pytest.mark.parametrize("name", list(STAGES))
def test_stage_keeps_columns_and_takes_an_empty_table(spark, sentences, name):
    rows = frame(spark, [(1, sentences(30)), (None, sentences(30)), (2, None), (3, ""), (1, sentences(20)), (4, "x" * 30_000)])
    out = STAGES[name](spark, rows, DATA)
    if name != "packing":
        assert out.schema.simpleString() == rows.schema.simpleString()
        for r in out.collect():
            assert all(r[c] == f"user {c}" for c in CLASHES)
    assert STAGES[name](spark, rows.filter("false"), DATA).count() == 0
    assert out.count() > 0 or name == "language_id"


def test_language_stage_keeps_text_with_letters(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    odd = docs.limit(1).select(F.lit(9001).cast("long").alias("doc_id"), F.lit(None).cast("string").alias("text"), *[c for c in docs.columns if c not in ("doc_id", "text")])
    odd = odd.unionByName(odd.withColumn("text", F.lit("123 ... 456")).withColumn("doc_id", F.lit(None).cast("long")))
    kept = STAGES["language_id"](spark, docs.unionByName(odd), DATA)
    without = {r.doc_id for r in docs.collect() if not re.search(r"[^\W\d_]", r.text or "")}
    ids = {r.doc_id for r in kept.collect()}
    assert not ids & ({9001, None} | without) and len(ids) >= 0.98 * (docs.count() - len(without))


def test_line_stage_tells_rows_of_one_id_apart(spark, sentences):
    a, b, c = (sentences(8) for _ in range(3))
    rows = [(1, f"{a}\n{b}"), (2, a), (2, c), (2, c), (3, f"{b}\n{sentences(8)}"), (None, a), (4, None), (5, "")]
    kept = told(STAGES["line_dedup"](spark, frame(spark, rows), DATA))
    expected = [(1, rows[0][1]), (2, c), (2, c), (3, rows[4][1].split("\n")[1]), (None, a), (4, None), (5, "")]
    assert kept == sorted(expected, key=repr)
    again = STAGES["line_dedup"](spark, frame(spark, rows), DATA).filter("doc_id = 3").first()
    assert again.n_chars == len(again.text)
    assert {(r.doc_id, tuple(r.gone)) for r in line_dedup.repeated_lines(frame(spark, rows)).collect()} == {(1, ()), (2, (0,)), (2, ()), (3, (0,))}


def test_near_stage_keeps_one_of_each_group(spark, sentences):
    base = sentences(100).split()
    near = [*base[:50], "other", *base[51:]]
    rows = [(5, " ".join(base)), (3, " ".join(near)), (7, " ".join(base)), (8, sentences(60)), (None, " ".join(base)), (9, None), (10, ""), (11, sentences(50)), (11, " ".join(base))]
    kept = [k for k, _ in told(STAGES["near_dedup"](spark, frame(spark, rows), DATA))]
    assert sorted(kept, key=repr) == sorted([3, 8, None, 9, 10], key=repr)  # 11 is one document, which has a near copy


def test_benchmark_stage_judges_rows_by_their_texts(spark, sentences):
    item = next(r.text for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect() if len(r.text.split()) >= 12)
    bad, good = f"{sentences(10)} {' '.join(item.split()[:11])} {sentences(10)}", sentences(30)
    rows = [(1, bad), (1, good), (2, good), (None, bad), (None, good), (3, None), (4, "")]
    assert told(STAGES["decontamination"](spark, frame(spark, rows), DATA)) == sorted([(1, good), (2, good), (None, good), (3, None), (4, "")], key=repr)


def test_packing_stage_takes_every_row(spark, sentences):
    rows = [(1, sentences(30)), (1, sentences(30)), (None, sentences(5)), (2, None), (3, ""), (4, sentences(3000))]
    got = STAGES["packing"](spark, frame(spark, rows), DATA).collect()
    assert sum(r.start == 0 for r in got) == len(rows) and {r.doc_tokens for r in got if r.doc_id in (2, 3)} == {1}
    assert max(r.offset + r.length for r in got) <= packing.WINDOW


def test_whole_run_equals_its_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, DATA).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
    rows = lambda df: sorted((r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in df.collect() if r.start == 0)
    heads = lambda found: [(a, b, e) for a, b, _, _, e in found]
    assert heads(rows(corpus_pipeline.run(spark, DATA))) == heads(rows(docs))
