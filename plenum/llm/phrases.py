"""Operator 13: collocated phrases by dynamic itemset counting (Brin, Motwani, Ullman and Tsur), per language.

1. Texts are dealt into shards, which are scanned in cycles. A phrase is counted from the scan on after that in which both
   its subphrases, without its last and without its first word, have reached the least count, for one full cycle; words
   are counted from the first scan on. So lengths interleave: common phrases grow while rare words are still counted, and
   scans end when no phrase is left within its cycle.
2. When a phrase reached the least count is kept in a table of fixed size, at two slots by hash, of which the later scan
   holds; tasks look subphrases up there. Slots that phrases share only make more phrases counted than needed.
3. Counts go by 62-bit hashes (of a hundred million phrases two share one with a probability of a thousandth), summed
   within a task first, with the first row that holds the phrase. Those within their cycle are one written table, which
   each scan adds to; what has completed its cycle leaves it, and is kept if it has the least count.
4. Each phrase that is kept gets its text from that row alone. Cuts, containment and ranks follow as joins.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from plenum.llm.bytetext import arrow_text, gram_hashes, lower_table, mix, signed, span_hashes, text_slices, token_spans
from plenum.llm.tables import Scratch, bit_set, delete, held, slot_of

LONGEST = 4
LEAST = 30
WITHIN_PERCENT = 80
FIRST = 2000
SCALE = 2_000_000
SHARDS = 3
SLOT_BITS = 24
#: Occurrences that a task sums before it passes counts on.
SUMMED = 3 << 20
NEVER = 127

_ALL = np.uint64(0x51ED270B0A1F39C7)
_LOWER = lower_table()
_CUTS = np.zeros(256, bool)
_CUTS[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
_MEMBER = ~_CUTS
_MEMBER[[0x20, 0x09]] = False


class _Slots:
    """When the phrases of each slot reached the least count; packed on its way to tasks, as most slots are alike."""

    def __init__(self, when: np.ndarray) -> None:
        self.when = when

    def __getstate__(self) -> bytes:
        return zlib.compress(self.when.tobytes(), 1)

    def __setstate__(self, packed: bytes) -> None:
        self.when = np.frombuffer(zlib.decompress(packed), np.int8)


class _Words:
    """Words of a slice of texts, with hashes of all phrases by length."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, langs: np.ndarray) -> None:
        self.data = _LOWER[data]
        self.starts, self.ends, self.rows = token_spans(self.data, offsets, _MEMBER)
        # Rows and cuts before a word both only grow, so their sum tells pieces apart.
        self.pieces = np.cumsum(_CUTS[self.data])[self.starts] + self.rows if len(self.data) else self.rows
        self.hashes, self.langs = span_hashes(self.data, self.starts, self.ends), langs

    def phrases(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the k words from each word on, which hold k in their last bits, and whether these are in one piece."""
        grams, inside = gram_hashes(self.hashes, self.pieces, k)
        return (mix(grams ^ self.langs[self.rows[: len(grams)]]) & ~np.uint64(3)) | np.uint64(k - 1), inside

    def totals(self) -> np.ndarray:
        """Of each word the hash under which all words of its language are counted."""
        return mix(self.langs ^ _ALL)[self.rows] & ~np.uint64(3)

    def texts(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Bytes in which one space stands after each word, with the words' starts and ends: each phrase is a slice."""
        lengths = self.ends - self.starts
        ends = np.cumsum(lengths + 1) - 1
        out = np.full(int(ends[-1]) + 1 if len(ends) else 0, 0x20, np.uint8)
        keep = np.ones(len(out), bool)
        keep[ends] = False
        out[keep] = self.data[_MEMBER[self.data]]
        return out, ends - lengths, ends


def _when(table: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """The scan at which phrases reached the least count, or an earlier one; ``NEVER`` if they have not."""
    bits, mask = np.uint64(len(table).bit_length() - 1), np.uint64(len(table) - 1)
    first = table[((hashes >> np.uint64(2)) & mask).astype(np.int64)]
    return np.maximum(first, table[((hashes >> (bits + np.uint64(2))) & mask).astype(np.int64)])


def _lang_hashes(column: pa.Array) -> np.ndarray:
    data, offsets = arrow_text(column)
    return span_hashes(data, offsets[:-1], offsets[1:])


def _scan(docs: DataFrame, shared: Broadcast, step: int, shards: int, longest: int) -> DataFrame:
    """(h, n, row): counts of the phrases of a shard that are within their cycle at this step, and a row that holds each."""

    def summed(parts: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        hashes, rows = (np.concatenate(x) for x in zip(*parts, strict=True))
        hashes, first, counts = np.unique(hashes, return_index=True, return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(signed(hashes)), pa.array(counts.astype(np.int64)), pa.array(rows[first])], names=["h", "n", "row"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        when, parts, waiting = shared.value.when, [], 0
        for batch in batches:
            langs, names = _lang_hashes(batch.column(1)), np.asarray(batch.column(0), np.int64)
            for i, j, data, offsets in text_slices(batch.column(2)):
                words, before = _Words(data, offsets, langs[i:j]), None
                rows = names[i:j][words.rows]
                if step < shards:
                    parts.append((words.totals(), rows))
                    waiting += len(rows)
                for k in range(1, longest + 1):
                    hashes, active = words.phrases(k)
                    if k == 1:
                        active &= step < shards
                    elif len(hashes):
                        since = _when(when, before)
                        start = np.maximum(since[:-1], since[1:]).astype(np.int16) + 1
                        active &= (start <= step) & (step < start + shards)
                    before = hashes
                    if active.any():
                        parts.append((hashes[active], rows[: len(hashes)][active]))
                        waiting += len(parts[-1][0])
                if waiting > SUMMED:
                    yield summed(parts)
                    parts, waiting = [], 0
        if waiting:
            yield summed(parts)

    return docs.select("row", "lang", "text").mapInArrow(run, "h long, n long, row long")


def _found(docs: DataFrame, scratch: Scratch, least: int, longest: int, shards: int, bits: int) -> DataFrame:
    """(h, n, row) of all phrases with the least count, and of the words of each language together."""
    spark = docs.sparkSession
    reached, step, end, running, done = np.full(1 << bits, NEVER, np.int8), 0, shards, None, []
    while step < end:
        shared = spark.sparkContext.broadcast(_Slots(reached))
        new = _scan(docs.filter(F.col("shard") == step % shards), shared, step, shards, longest).withColumn("seen", F.lit(step))
        rows = new if running is None else new.unionByName(running.filter(F.col("seen") > step - shards))
        sums = scratch.cut(rows.groupBy("h").agg(F.sum("n").alias("n"), F.min("row").alias("row"), F.min("seen").alias("seen")))
        if running is not None:
            scratch.drop(running)
        running = sums
        shared.destroy()
        frequent = running.filter(F.col("n") >= least)
        slots = F.array(*(F.shiftrightunsigned("h", by).bitwiseAND((1 << bits) - 1) for by in (2, bits + 2)))
        now = bit_set(frequent.select(F.explode(slots).alias("slot")), bits)
        fresh = (np.unpackbits(now.view(np.uint8), bitorder="little") > 0) & (reached == NEVER)
        if fresh.any():
            reached[fresh] = step
            end = step + 1 + shards
        # What is in its last scan when the loop ends has completed its cycle, or would get nothing more.
        over = F.col("seen") <= step - shards + 1 if step + 1 < end else F.lit(True)
        done.append(scratch.cut(frequent.filter(over).select("h", "n", "row")))
        step += 1
    out = scratch.cut(reduce(DataFrame.unionByName, done))
    scratch.drop(running, *done)
    return out


def _gathered(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    """A string array of slices of bytes."""
    lengths = ends - starts
    offsets = np.concatenate([[0], np.cumsum(lengths)])
    at = np.repeat(starts - offsets[:-1], lengths) + np.arange(offsets[-1])
    return pa.Array.from_buffers(pa.string(), len(starts), [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(data[at])])


def _texts(docs: DataFrame, found: DataFrame, longest: int) -> DataFrame:
    """(lang, k, phrase, f) of what was found, by the texts of the rows that hold it; k = 0 has the number of all words of a language."""
    # A bit set of fixed size lets rows that are not wanted stay in their task; the join after it is exact.
    shared = docs.sparkSession.sparkContext.broadcast(bit_set(found.select(slot_of("row").alias("slot"))))

    def wanted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(held(shared.value, np.asarray(batch.column(3), np.int64)))).select([0, 1, 2])

    few = docs.select("row", "lang", "text", slot_of("row").alias("slot")).mapInArrow(wanted, "row long, lang string, text string")
    of_row = found.groupBy("row").agg(F.collect_list(F.struct("h", "n")).alias("found"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashed = _lang_hashes(batch.column(0))
            for r in range(batch.num_rows):
                data, offsets = arrow_text(batch.column(1).slice(r, 1))
                words, rows = _Words(data, offsets, hashed[r : r + 1]), batch.column(2)[r].values
                hashes, counts = np.asarray(rows.field("h"), np.int64).view(np.uint64), np.asarray(rows.field("n"), np.int64)
                order = np.argsort(hashes)
                hashes, counts = hashes[order], counts[order]
                text, starts, ends = words.texts()
                for k in range(longest + 1):
                    own, inside = words.phrases(k) if k else (words.totals(), np.ones(len(words.starts), bool))
                    at = np.flatnonzero(inside & np.isin(own, hashes))
                    at = at[np.unique(own[at], return_index=True)[1]]
                    if len(at):
                        phrase = _gathered(text, starts[at], ends[at + k - 1]) if k else pa.array([""] * len(at))
                        lang = pa.array([batch.column(0)[r].as_py()] * len(at), pa.string())
                        yield pa.RecordBatch.from_arrays([lang, pa.array(np.full(len(at), k, np.int32)), phrase, pa.array(counts[np.searchsorted(hashes, own[at])])], names=["lang", "k", "phrase", "f"])

    return few.join(of_row, "row").select("lang", "text", "found").mapInArrow(run, "lang string, k int, phrase string, f long")


def collocations(docs: DataFrame, *, text_col: str = "text", lang_col: str = "lang", longest: int = LONGEST, least: int = LEAST, within_percent: int = WITHIN_PERCENT, first: int = FIRST, shards: int = SHARDS, bits: int = SLOT_BITS) -> DataFrame:
    """The first phrases of each language: lang, rank (from 1), phrase, a, l, r, n, score.

    A-Z are lower-cased; ``.,;:!?`` and line breaks cut texts into pieces, spaces and tabs pieces into words. n counts the
    words of a language, a the occurrences of a phrase of 2 to ``longest`` words within pieces, l and r those of its parts
    at the cut of the lowest score floor(SCALE * a / (l + r)), the first such. Phrases of a < ``least`` are none, and those
    within a longer one that has ``within_percent`` of their count are left out. Ranks go by score, a, then phrase.

    A null language is ``und``, as is that name itself; a null or empty text has no words. Repeated rows count each. An
    empty table, or one without frequent phrases, gives none. Other columns are ignored, whatever their names.
    """
    if longest > 4:
        raise ValueError("hashes have room for phrases of up to 4 words")
    scratch = Scratch(docs.sparkSession)
    rows = docs.select(F.coalesce(docs[f"`{lang_col}`"].cast("string"), F.lit("und")).alias("lang"), F.coalesce(docs[f"`{text_col}`"].cast("string"), F.lit("")).alias("text"))
    path = f"{scratch.folder}/shards"
    # Rows are dealt in turn, so that copies of one text are spread over the shards; the written number names a row from here on.
    numbered = rows.withColumn("row", F.monotonically_increasing_id())
    numbered.withColumn("shard", F.pmod("row", F.lit(shards)).cast("int")).write.partitionBy("shard").parquet(path)
    dealt = docs.sparkSession.read.schema("lang string, text string, row long, shard int").parquet(path)
    found = _found(dealt, scratch, least, longest, shards, bits)
    counts = scratch.cut(_texts(dealt, found, longest))
    delete(docs.sparkSession, path)
    return ranked(counts, within_percent, first)


def ranked(counts: DataFrame, within_percent: int = WITHIN_PERCENT, first: int = FIRST) -> DataFrame:
    """The rows of ``collocations`` from (lang, k, phrase, f) of all frequent phrases and, at k = 0, of all words."""
    words = F.split("phrase", " ")
    joined = lambda part: F.array_join(part, " ")
    candidates = counts.filter("k >= 2").select("lang", "phrase", "k", F.col("f").alias("a"), words.alias("words"))
    of = lambda name, value: counts.filter("k >= 1").select("lang", F.col("phrase").alias(name), F.col("f").alias(value))
    cuts = candidates.select("lang", "phrase", "a", "k", "words", F.explode(F.sequence(F.lit(1), F.col("k") - 1)).alias("cut"))
    cuts = cuts.select("lang", "phrase", "a", "cut", joined(F.slice("words", F.lit(1), F.col("cut"))).alias("head"), joined(F.slice("words", F.col("cut") + 1, F.col("k"))).alias("tail"))
    parts = cuts.join(of("head", "l"), ["lang", "head"]).join(of("tail", "r"), ["lang", "tail"])
    wide = lambda c: F.col(c).cast("decimal(19,0)")
    score = F.call_function("div", F.lit(SCALE).cast("decimal(7,0)") * wide("a"), wide("l") + wide("r"))
    lowest = parts.groupBy("lang", "phrase").agg(F.min(F.struct(score.alias("score"), "cut", "l", "r", "a")).alias("best")).select("lang", "phrase", "best.*")
    longer = candidates.filter("k >= 3").select("lang", "a", "k", "words", F.explode(F.sequence(F.lit(2), F.col("k") - 1)).alias("size"))
    longer = longer.select("lang", "a", "words", "size", F.explode(F.sequence(F.lit(1), F.col("k") - F.col("size") + 1)).alias("at"))
    most = longer.groupBy("lang", joined(F.slice("words", F.col("at"), F.col("size"))).alias("phrase")).agg(F.max("a").alias("longer"))
    inside = F.coalesce(F.lit(100) * wide("longer") >= F.lit(within_percent) * wide("a"), F.lit(False))
    kept = lowest.join(most, ["lang", "phrase"], "left").filter(~inside)
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    best = kept.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= first)
    # One row for each language that has words.
    totals = counts.filter("k = 0").select("lang", F.col("f").alias("n"))
    return best.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
