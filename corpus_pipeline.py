"""Corpus pipeline over ``documents``: each stage's rows are written as Parquet and read by the next.

Language ID drops what it rejects; line dedup drops repeated lines, and documents of which nothing is left; near dedup
keeps one document of each group; decontamination drops documents that share a window with the benchmark; packing
returns the pieces of token sequences. All stages but the last return the columns of ``documents``, whatever others there
are besides ``doc_id`` and ``text``, and none gives rows for an empty table. Nulls are handled as each stage states.

Stages run in one session, whose Arrow batches they hold to ``BATCH_BYTES``: a task has several batches at once, in the
JVM beside its heap and in Python, and executors keep the most that any stage took.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plenum.llm import contamination, language_id, line_dedup, near_dedup, packing
from plenum.llm.queries import tokenizer_path
from plenum.llm.tables import delete, scope, table
from plenum.sources.shared import new_folder

BATCH_BYTES = 8 << 20


def bounded(spark: SparkSession) -> None:
    """Arrow batches of at most ``BATCH_BYTES`` from now on; a longer row is a batch of its own."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised; the model learns from the labelled documents of the stage's input.

    A text that is null or has no letter is rejected; where nothing could be learned, all are. A null ``doc_id`` and
    repeated rows are judged by their texts.
    """
    bounded(spark)
    names = {c: "text" if c == "text" else f"column_{i}" for i, c in enumerate(docs.columns)}
    rows = docs.select(*(docs[f"`{c}`"].alias(n) for c, n in names.items()))
    found = language_id.identify(rows, language_id.train(language_id.sample(docs)))
    return found.filter("NOT lang_rejected").select(*(F.col(n).alias(c) for c, n in names.items()))


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that stand in an earlier one, up to two edits; rows with a null ``doc_id`` or text stay whole."""
    bounded(spark)
    return line_dedup.drop_repeated_lines(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates; rows with a null ``doc_id`` or without words stay."""
    bounded(spark)
    return near_dedup.drop_near_duplicates(docs)


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that share no window of words with the benchmark; each row is judged by its own text, null ones stay."""
    bounded(spark)
    return contamination.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences; a null or empty text is the end id alone, and every row is a document of its own."""
    bounded(spark)
    return packing.pack(docs, tokenizer_path())


STAGES = [("language_id", language_stage), ("line_dedup", line_stage), ("near_dedup", near_stage), ("decontamination", benchmark_stage), ("packing", packing_stage)]

#: A fitted classifier, an edit join, components and tokenisation are beyond SQL; the stages are tested by brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage. What a stage wrote on its way goes when its result stands, and that when the next one does."""
    folder = new_folder(spark, "pipeline")
    docs, before = table(spark, sf_dir, "documents"), None
    for k, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{k}-{name}"
        with scope():
            stage(spark, docs, sf_dir).write.parquet(path)
        if before is not None:
            delete(spark, before)
        docs, before = spark.read.parquet(path), path
    return docs
