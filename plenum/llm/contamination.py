"""Operator 4: benchmark decontamination by winnowing.

Of every run of ``window - k + 1`` consecutive k-word hashes the smallest is kept (the leftmost on ties), for benchmark
items and documents alike. A run of ``window`` shared words therefore keeps the same hash at the same place on both
sides, so that the join on these fingerprints misses no shared run of that length. Each hit carries the few words around
it and is extended over them word by word, which confirms it and gives the hit words. Items shorter than a window are
fingerprinted whole, by their own length.

Scale: documents are read once and never shuffled. Before the join, document fingerprints pass a bit set of the
benchmark's, of a fixed size whatever the benchmark's, so what is joined follows the number of hits and not the corpus.
Spark picks the strategy of that join by the size of the benchmark.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plenum.llm.bytetext import gram_hashes, lower_table, signed, span_hashes, text_slices, token_spans, words_table
from plenum.llm.tables import bit_set

WINDOW = 10
K = 5
FILTER_BITS = 25

_GRAMS = "length int, fp long, at int, around binary"
_ITEM_SCHEMA = f"item_id string, {_GRAMS}"
_DOC_SCHEMA = f"row_key long, doc_id long, n_words long, {_GRAMS}"


def _winnow(grams: np.ndarray, inside: np.ndarray, span: int) -> np.ndarray:
    """Places of the kept hashes: the leftmost smallest of each run of ``span`` of them within one row."""
    n = len(grams) - span + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    at, best = np.arange(n), grams[:n].copy()
    for j in range(1, span):
        less = grams[j : j + n] < best
        best[less] = grams[j : j + n][less]
        at[less] = np.arange(n)[less] + j
    kept = np.zeros(len(grams), bool)
    kept[at[inside[:n]]] = True
    return np.flatnonzero(kept)


def _fingerprints(words: np.ndarray, rows: np.ndarray, lengths: list[int], window: int, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(length, hashes, first words): 0 for winnowed k-grams of the window, else all runs of an item's whole length."""
    grams, _ = gram_hashes(words, rows, k)
    n = len(words) - window + 1
    if n > 0:
        at = _winnow(grams, np.concatenate([rows[:n] == rows[window - 1 :], np.zeros(window - k, bool)]), window - k + 1)
        yield 0, grams[at], at
    for length in lengths:
        grams, inside = gram_hashes(words, rows, length)
        at = np.flatnonzero(inside)
        yield length, grams[at], at


def _slots(hashes: np.ndarray, lengths: int) -> np.ndarray:
    return ((hashes ^ np.uint64(lengths * 0x9E37)) >> np.uint64(64 - FILTER_BITS)).astype(np.int64)


def _around(data: bytes, starts: np.ndarray, ends: np.ndarray, first: np.ndarray, last: np.ndarray, at: int, length: int, window: int, k: int, row: int) -> tuple[int, bytes]:
    """Place of a fingerprint in the words around it, and these words."""
    low, high = (at, at + length) if length else (max(first[row], at - (window - k)), min(last[row], at + window))
    return at - low, b" ".join([data[a:b] for a, b in zip(starts[low:high].tolist(), ends[low:high].tolist(), strict=True)])


def _items(benchmark: DataFrame, item_id: str, window: int, k: int) -> DataFrame:
    lower, member = lower_table(), words_table()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, out = batch.column(0).to_pylist(), []
            for i, _, data, offsets in text_slices(batch.column(1)):
                data = lower[data]
                starts, ends, rows = token_spans(data, offsets, member)
                first, last = np.searchsorted(rows, np.arange(len(offsets) - 1)), np.searchsorted(rows, np.arange(len(offsets) - 1), "right")
                words, raw = span_hashes(data, starts, ends), data.tobytes()
                short = sorted({int(x) for x in last - first if 0 < x < window})
                for length, hashes, places in _fingerprints(words, rows, short, window, k):
                    for h, at in zip(signed(hashes).tolist(), places.tolist(), strict=True):
                        row = rows[at]
                        if not length or last[row] - first[row] == length:
                            out.append((names[i + row], length, h, *_around(raw, starts, ends, first, last, at, length, window, k, row)))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.string(), pa.int32(), pa.int64(), pa.int32(), pa.binary()), strict=True)], names=["item_id", "length", "fp", "at", "around"])

    return benchmark.select(F.col(item_id).cast("string").alias("item_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, _ITEM_SCHEMA)


def _filter(items: DataFrame) -> tuple[dict[int, None], np.ndarray]:
    """The lengths of short items (0: windows), at most ``window`` of them, and the bit set of the fingerprints, of fixed size."""
    slot = F.shiftrightunsigned(F.col("fp").bitwiseXOR((F.col("length") * F.lit(0x9E37)).cast("long")), 64 - FILTER_BITS)
    lengths = [r["length"] for r in items.select("length").distinct().collect()]
    return dict.fromkeys(lengths), bit_set(items.select(slot.alias("slot")), FILTER_BITS)


def hits(docs: DataFrame, benchmark: DataFrame, *, item_id: str = "item_id", window: int = WINDOW, k: int = K) -> DataFrame:
    """Confirmed runs: row_key, doc_id, n_words, item_id, first_word, end_word (exclusive).

    A document without a confirmed run has one row, whose item_id and words are null. ``row_key`` tells input rows
    apart, also those that repeat a ``doc_id``. Runs of one document may overlap.
    """
    items = _items(benchmark, item_id, window, k)
    found, bits = _filter(items)
    shared = docs.sparkSession.sparkContext.broadcast(bits)
    short, lower, member = sorted(found.keys() - {0}), lower_table(), words_table()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, bits = TaskContext.get().partitionId() << 40, shared.value
        types = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.binary())
        for batch in batches:
            names = batch.column(0).to_pylist()
            for i, j, data, offsets in text_slices(batch.column(1)):
                data = lower[data]
                starts, ends, rows = token_spans(data, offsets, member)
                first, last = np.searchsorted(rows, np.arange(j - i)), np.searchsorted(rows, np.arange(j - i), "right")
                counts = (last - first).tolist()
                out: list[tuple] = [(key + r, names[i + r], counts[r], None, None, None, None) for r in range(j - i)]
                words, raw = span_hashes(data, starts, ends), data.tobytes()
                for length, hashes, places in _fingerprints(words, rows, short, window, k):
                    slot = _slots(hashes, length)
                    likely = (bits[slot >> 6] >> (slot & 63).astype(np.uint64)) & np.uint64(1) > 0
                    for h, at in zip(signed(hashes[likely]).tolist(), places[likely].tolist(), strict=True):
                        r = int(rows[at])
                        out.append((key + r, names[i + r], counts[r], length, h, at - int(first[r]), _around(raw, starts, ends, first, last, at, length, window, k, r)[1]))
                key += j - i
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=["row_key", "doc_id", "n_words", "length", "fp", "at", "around"])

    marked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, _DOC_SCHEMA)
    # Rows without a fingerprint get a key of their own, so that they do not meet in one partition if the join shuffles.
    marked = marked.withColumns({"of": F.coalesce("length", F.lit(-1)), "key": F.coalesce("fp", F.xxhash64("row_key"))})
    right = items.select("item_id", F.col("length").alias("of"), F.col("fp").alias("key"), F.col("at").alias("item_at"), F.col("around").alias("item_around"))
    joined = marked.join(right, ["of", "key"], "left")
    # Only the words just before a fingerprint that lie in the document count as its left side.
    left = F.least(F.col("at"), F.lit(window - k))
    joined = joined.select("row_key", "doc_id", "n_words", "item_id", "of", "at", F.when(F.col("of") > 0, 0).otherwise(left).alias("doc_left"), "around", "item_at", "item_around")

    def extend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols = {n: batch.column(n).to_pylist() for n in ("of", "at", "doc_left", "around", "item_at", "item_around")}
            begins, stops = [], []
            for of, at, x, mine, y, theirs in zip(*cols.values(), strict=True):
                begin = stop = None
                if theirs is not None and of > 0:
                    if mine == theirs:
                        begin, stop = at, at + of
                elif theirs is not None:
                    a, b = mine.split(b" "), theirs.split(b" ")
                    if a[x : x + k] == b[y : y + k]:
                        low, high = 0, k
                        while low < min(x, y) and a[x - low - 1] == b[y - low - 1]:
                            low += 1
                        while x + high < len(a) and y + high < len(b) and a[x + high] == b[y + high]:
                            high += 1
                        if low + high >= window:
                            begin, stop = at - low, at + high
                begins.append(begin)
                stops.append(stop)
            found = pa.array([b is not None for b in begins])
            yield pa.RecordBatch.from_arrays(
                [batch.column("row_key"), batch.column("doc_id"), batch.column("n_words"), pa.compute.if_else(found, batch.column("item_id"), pa.scalar(None, batch.column("item_id").type)), pa.array(begins, pa.int64()), pa.array(stops, pa.int64())],
                names=["row_key", "doc_id", "n_words", "item_id", "first_word", "end_word"],
            )

    return joined.mapInArrow(extend, "row_key long, doc_id long, n_words long, item_id string, first_word long, end_word long")


def contamination(docs: DataFrame, benchmark: DataFrame, *, item_id: str = "item_id", window: int = WINDOW, k: int = K) -> DataFrame:
    """One row per row of ``docs``: row_key, doc_id, n_words, n_hit, items (sorted as strings), spans, contaminated.

    A null text has no words; an item with a null id still marks words but is not listed; repeated rows and null
    ``doc_id`` keep their rows. An empty benchmark marks nothing.
    """
    runs = hits(docs, benchmark, item_id=item_id, window=window, k=k)
    spans = F.sort_array(F.collect_set(F.when(F.col("first_word").isNotNull(), F.struct("first_word", "end_word"))))
    by_doc = runs.groupBy("row_key", "doc_id").agg(F.max("n_words").alias("n_words"), spans.alias("spans"), F.sort_array(F.collect_set("item_id")).alias("items"))
    # Sorted runs are merged by the furthest end so far.
    covered = F.expr("aggregate(spans, named_struct('n', 0L, 'end', 0L), (s, x) -> named_struct('n', s.n + greatest(0L, x.end_word - greatest(s.end, x.first_word)), 'end', greatest(s.end, x.end_word))).n")
    return by_doc.withColumn("n_hit", covered).withColumn("contaminated", F.col("n_hit") > 0)


def decontaminate(docs: DataFrame, benchmark: DataFrame, *, window: int = WINDOW, k: int = K) -> DataFrame:
    """``docs`` without the rows that share a window with the benchmark.

    Each row is judged by its own text, whatever its ``doc_id``; a null or empty text stays, an empty benchmark leaves all,
    and an empty table gives none. Columns of any name stay as they are.
    """
    text = F.col("text").cast("string")
    own = F.xxhash64(text)
    bad = contamination(docs.select(own.alias("doc_id"), text.alias("text")), benchmark, window=window, k=k).filter("contaminated").select(F.col("doc_id").alias("bad")).distinct()
    rows = docs.select(F.struct("*").alias("row"), own.alias("own")).join(bad, F.col("own") == F.col("bad"), "left_anti")
    return rows.select(*(F.col("row").getField(c).alias(c) for c in docs.columns))
