"""Operator 7: line dedup by a segment-partition edit join (Pass-Join; Li, Deng, Wang and Feng).

A line goes if a line within ``EDITS`` edits (insertions, deletions and replacements of code points) stands earlier, by
``doc_id``, then a hash of the text (rows that repeat a ``doc_id`` with other texts are told apart by it), then line
number. Lines of fewer than ``MIN_CHARS`` code points stay.

1. Two lines within t edits share, whole, one of t+1 segments of the shorter: every line gives index keys (length, place
   and content of its segments) and probe keys (the substrings that could match a segment of each length from its own
   down to t less; the multi-match-aware choice leaves 12 for t = 2, of which 3 are its index keys).
2. One shuffle by key brings lines together. Within sorted partitions, groups of bounded size give candidate pairs at
   once; members of larger groups are dealt anew. Those of more than a block, as many variants of one template give, are
   first split by the rarest of their grams of three code points: lines within t edits share all but 3t of these, so that
   of the first 3t+1 of each in any one order, here by count, they share one. What is left meets in blocks, every two of a
   key under a key of their own. Inside a block pair only rows are compared that a 16-bucket count sketch allows (t edits
   move it by 2t at most).
3. Candidates are verified on the lines themselves by banded bit-parallel edit distance (Myers, Hyyro), many at a time.

Equal lines are one class from the start: a line that stands in a third of all documents is one key set per task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plenum.llm.bytetext import arrow_text, mix, row_slices, signed
from plenum.llm.tables import Scratch, bit_set

EDITS = 2
MIN_CHARS = 20
GROUP = 64
BLOCK = 512
TOGETHER = 1 << 16
GRAM = 3
GRAM_BITS = 16
FILTER_BITS = 25
_ODD = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


class _Powers:
    """Powers of an odd multiplier and of its inverse, grown as needed."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    def grow(self, n: int) -> None:
        if len(self.up) < n:
            size = max(n, 1 << 20)
            for name, base in (("up", _ODD), ("down", _INVERSE)):
                steps = np.full(size, base, np.uint64)
                steps[0] = 1
                setattr(self, name, np.cumprod(steps))


_POWERS = _Powers()


class Lines:
    """The lines of some rows as code points, with hashes of any part of them."""

    def __init__(self, codes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> None:
        self.codes, self.starts, self.ends, self.sizes = codes, starts, ends, ends - starts
        _POWERS.grow(len(codes) + 1)
        self.sums = np.concatenate([[np.uint64(0)], np.cumsum((codes.astype(np.uint64) + np.uint64(1)) * _POWERS.up[: len(codes)])])
        self.hashes = (self.part(starts, ends) & ~np.uint64(1)) if len(starts) else np.zeros(0, np.uint64)

    def part(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mix((self.sums[ends] - self.sums[starts]) * _POWERS.down[starts] + (ends - starts).astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))

    def sketches(self, lines: np.ndarray) -> np.ndarray:
        """Of some lines sixteen counts modulo 16 of their code points by bucket, packed. Four counts share one running sum."""
        starts, ends = self.starts[lines], self.ends[lines]
        bucket = ((self.codes * np.uint32(0x9E3779B1)) >> np.uint32(28)).astype(np.uint8)
        out, total = np.zeros(len(lines), np.uint64), np.zeros(len(bucket) + 1, np.uint64)
        for lane in range(4):
            ones = np.zeros(16, np.uint64)
            ones[4 * lane : 4 * lane + 4] = np.uint64(1) << np.arange(0, 64, 16, dtype=np.uint64)
            np.cumsum(ones[bucket], out=total[1:])
            held = total[ends] - total[starts]
            for field in range(4):
                out |= (held >> np.uint64(16 * field) & np.uint64(15)) << np.uint64(16 * lane + 4 * field)
        for i in np.flatnonzero(ends - starts >= 1 << 16):  # whose counts may not fit
            counts = np.bincount(bucket[starts[i] : ends[i]], minlength=16).astype(np.uint64) & np.uint64(15)
            out[i] = np.bitwise_or.reduce(counts << np.arange(0, 64, 4, dtype=np.uint64))
        return out


def _split(column: pa.Array, least: int) -> Iterator[tuple[np.ndarray, np.ndarray, Lines]]:
    """(rows, line numbers, lines) of the lines of at least ``least`` code points, in slices of bounded size."""
    data, offsets = arrow_text(column)
    for i, j in row_slices(offsets):
        raw, at = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        codes = np.frombuffer(raw.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
        places = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])[at]
        if places[-1] != len(codes):  # bytes that are no UTF-8
            texts = [raw[a:b].tobytes().decode("utf-8", "replace") for a, b in zip(at[:-1], at[1:], strict=True)]
            places = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
            codes = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
        breaks = np.flatnonzero(codes == 10)
        row_of = np.searchsorted(places, breaks, "right") - 1
        filled = np.flatnonzero(places[:-1] < places[1:])
        starts = np.concatenate([places[:-1][filled], breaks + 1])
        rows = np.concatenate([filled, row_of])
        order = np.lexsort((starts, rows))
        starts, rows = starts[order], rows[order]
        ends = np.where(np.append(rows[1:] == rows[:-1], False), np.append(starts[1:] - 1, 0), places[1:][rows]) if len(rows) else starts
        first = np.searchsorted(rows, rows)
        numbers = np.arange(len(rows)) - first
        good = ends - starts >= least
        yield rows[good] + i, numbers[good], Lines(codes, starts[good], ends[good])


def occurrences(docs: DataFrame, *, least: int = MIN_CHARS) -> DataFrame:
    """(doc_id, copy, line_no, h) of every line considered; ``copy`` is a hash of the text; rows with a null ``doc_id`` take no part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, numbers, lines in _split(batch.column(1), least):
                own = pa.array(rows)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(own), batch.column(2).take(own), pa.array(numbers.astype(np.int32)), pa.array(signed(lines.hashes))], names=["doc_id", "copy", "line_no", "h"])

    return _texts(docs).mapInArrow(run, "doc_id long, copy long, line_no int, h long")


def _texts(docs: DataFrame) -> DataFrame:
    text = F.col("text").cast("string")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("copy")).filter("doc_id IS NOT NULL")


def probes(edits: int) -> list[tuple[int, int, int]]:
    """(how much shorter, segment, shift) of the substrings to look up, by the multi-match-aware choice."""
    return [(less, i, o) for less in range(edits + 1) for i in range(edits + 1) for o in range(max(-i, less - (edits - i)), min(i, less + edits - i) + 1)]


def _keys(docs: DataFrame, edits: int, least: int) -> DataFrame:
    """(key, h, sketch) of the distinct lines of each batch; the last bit of h is set if the key is an index key, too."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            known = np.zeros(0, np.uint64)
            for _, _, lines in _split(batch.column(0), least):
                new, at = np.unique(lines.hashes, return_index=True)
                fresh = ~np.isin(new, known)
                known = np.concatenate([known, new[fresh]])
                at = at[fresh]
                sketch, h = lines.sketches(at), lines.hashes[at]
                starts, sizes = lines.starts[at], lines.sizes[at]
                out = []
                for less, i, shift in probes(edits):
                    size = sizes - less
                    base, longer = size // (edits + 1), size % (edits + 1)
                    plain = edits + 1 - longer  # so many segments of the base size come first
                    begin = base * i + np.maximum(0, i - plain)
                    length = base + (i >= plain)
                    p = begin + shift
                    good = (p >= 0) & (p + length <= sizes) & (size >= edits + 1)
                    key = mix(lines.part((starts + p)[good], (starts + p + length)[good]) ^ mix((size[good] * 16 + i).astype(np.uint64)))
                    out.append((key, h[good] | np.uint64(less == 0 and shift == 0), sketch[good]))
                yield pa.RecordBatch.from_arrays([pa.array(signed(np.concatenate(c))) for c in zip(*out, strict=True)], names=["key", "h", "sketch"])

    return _texts(docs).select("text").mapInArrow(run, "key long, h long, sketch long")


def _close(x: np.ndarray, y: np.ndarray, edits: int) -> np.ndarray:
    total = np.zeros(len(x), np.int64)
    for b in range(16):
        d = (((x >> np.uint64(4 * b)) - (y >> np.uint64(4 * b))) & np.uint64(15)).astype(np.int64)
        total += np.minimum(d, 16 - d)
    return total <= 2 * edits


def _pairs(key: np.ndarray, h: np.ndarray, sketch: np.ndarray, edits: int) -> tuple[np.ndarray, np.ndarray]:
    """Candidate pairs of rows sorted by key: one an index key, lines different, sketches close."""
    left, right, d = [np.zeros(0, np.uint64)], [np.zeros(0, np.uint64)], 1
    at = np.arange(len(key))
    while True:
        at = at[at + d < len(key)]
        at = at[key[at] == key[at + d]]
        if not len(at):
            break
        x, y = h[at], h[at + d]
        good = ((x | y) & np.uint64(1) > 0) & ((x ^ y) > np.uint64(1))
        good[good] = _close(sketch[at][good], sketch[at + d][good], edits)
        x, y = x[good] & ~np.uint64(1), y[good] & ~np.uint64(1)
        left.append(np.minimum(x, y))
        right.append(np.maximum(x, y))
        d += 1
    both = np.unique(np.stack([np.concatenate(left), np.concatenate(right)], axis=1), axis=0)
    return both[:, 0], both[:, 1]


def _unsigned(column: pa.Array) -> np.ndarray:
    return np.asarray(column).astype(np.int64).view(np.uint64)


def grams_of(lines: Lines, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the grams of some lines, the n-th of equal ones told from the others, and how many each line has."""
    counts = np.maximum(lines.sizes[at] - GRAM + 1, 0)
    owner = np.repeat(np.arange(len(at)), counts)
    starts = lines.starts[at][owner] + np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
    grams = lines.part(starts, starts + GRAM)
    order = np.lexsort((grams, owner))
    same = np.concatenate([[False], (owner[order][1:] == owner[order][:-1]) & (grams[order][1:] == grams[order][:-1])]) if len(owner) else np.zeros(0, bool)
    heads = np.flatnonzero(~same)
    nth = np.arange(len(owner)) - np.repeat(heads, np.diff(np.append(heads, len(owner))))
    out = np.empty_like(grams)
    out[order] = np.where(nth > 0, mix(grams[order] + nth.astype(np.uint64) * _ODD), grams[order])
    return out, counts


def _by_rare_grams(docs: DataFrame, members: DataFrame, scratch: Scratch, edits: int, least: int) -> DataFrame:
    """(key, h, sketch): members of large groups under keys of their group and each of their rarest grams."""
    needed = members.select(F.col("h").bitwiseAND(F.lit(-2).cast("long")).alias("h")).distinct()
    shared = docs.sparkSession.sparkContext.broadcast(bit_set(needed.select(F.shiftrightunsigned("h", 64 - FILTER_BITS).alias("slot")), FILTER_BITS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = shared.value
        for batch in batches:
            for _, _, lines in _split(batch.column(0), least):
                h, at = np.unique(lines.hashes, return_index=True)
                slot = _slots(h)
                good = (bits[slot >> 6] >> (slot & 63).astype(np.uint64)) & np.uint64(1) > 0
                grams, counts = grams_of(lines, at[good])
                ends = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(signed(h[good])), pa.ListArray.from_arrays(pa.array(ends), pa.array(signed(grams)))], names=["h", "grams"])

    found = _texts(docs).select("text").mapInArrow(run, "h long, grams array<long>").join(needed, "h", "left_semi").groupBy("h").agg(F.first("grams").alias("grams"))
    held = scratch.cut(found)
    # Counts of all grams of these lines by slots of fixed number; any order does, this one makes groups small.
    slot = F.shiftrightunsigned("g", 64 - GRAM_BITS)
    counted = held.select(F.explode("grams").alias("g")).groupBy(slot.alias("slot")).agg(F.count(F.lit(1)).alias("n")).toArrow()
    often = np.zeros(1 << GRAM_BITS, np.int64)
    often[np.asarray(counted["slot"])] = np.asarray(counted["n"])
    first = edits * GRAM + 1

    def picked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = np.asarray(batch.column(1).value_lengths(), np.int64)
            grams = _unsigned(batch.column(1).flatten())
            owner = np.repeat(np.arange(len(counts)), counts)
            order = np.lexsort((grams, often[(grams >> np.uint64(64 - GRAM_BITS)).astype(np.int64)], owner))
            rank = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
            keep = order[rank < first]
            # Lines with fewer grams than edits can change meet each other, too.
            short = np.flatnonzero(counts < first)
            owners, values = np.concatenate([owner[keep], short]), np.concatenate([grams[keep], np.zeros(len(short), np.uint64)])
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(owners)), pa.array(signed(values))], names=["line", "gram"])

    picks = held.mapInArrow(picked, "line long, gram long")
    split = members.join(picks, F.col("h").bitwiseAND(F.lit(-2).cast("long")) == F.col("line"))
    return split.select(F.xxhash64("key", "gram").alias("key"), "h", "sketch")


def candidates(docs: DataFrame, scratch: Scratch, *, edits: int = EDITS, least: int = MIN_CHARS) -> DataFrame:
    """Distinct pairs (a, b) of line hashes that share a segment and whose sketches allow ``edits``; written to ``scratch``."""

    def grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.zeros(0, np.uint64)] * 3
        large: int | None = None  # the key whose members are passed on

        def flush(done: list[np.ndarray]) -> pa.RecordBatch:
            key, h, sketch = done
            first = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
            sizes = np.diff(np.append(first, len(key)))
            big = np.repeat(sizes > GROUP, sizes)
            if large is not None and len(key):
                big |= key == large
            a, b = _pairs(key[~big], h[~big], sketch[~big], edits)
            n, m = len(a), int(big.sum())
            return pa.RecordBatch.from_arrays(
                [pa.array([None] * n + signed(key[big]).tolist(), pa.int64()), pa.array(np.concatenate([signed(a), signed(h[big])])), pa.array(signed(b).tolist() + [None] * m, pa.int64()), pa.array([None] * n + signed(sketch[big]).tolist(), pa.int64())],
                names=["key", "a", "b", "sketch"],
            )

        for batch in batches:
            held = [np.concatenate([x, _unsigned(batch.column(c))]) for c, x in enumerate(held)]
            if not len(held[0]):
                continue
            last = held[0][-1]
            cut_at = int(np.argmax(held[0] == last))
            if len(held[0]) - cut_at > GROUP:  # the last group is large already: none of it has to wait
                cut_at = len(held[0])
            yield flush([x[:cut_at] for x in held])
            if cut_at == len(held[0]):
                large = last
            held = [x[cut_at:] for x in held]
        yield flush(held)

    dealt = _keys(docs, edits, least).repartition("key").sortWithinPartitions("key")
    met = scratch.cut(dealt.mapInArrow(grouped, "key long, a long, b long, sketch long"))

    def kept(found: DataFrame) -> DataFrame:
        out = scratch.cut(found.distinct())
        scratch.drop(met)
        return out

    pairs = met.filter("key IS NULL").select("a", "b")
    members = met.filter("key IS NOT NULL").select("key", F.col("a").alias("h"), "sketch").distinct()
    if members.isEmpty():
        return kept(pairs)
    sizes = members.groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    placed = members.join(sizes, "key")
    crowded, seen = scratch.counted(placed.filter(F.col("n") > BLOCK).select("key", "h", "sketch"), n=F.count(F.lit(1)))
    rows = placed.filter(F.col("n") <= BLOCK).select("key", "h", "sketch")
    if seen["n"]:
        rows = rows.unionByName(scratch.cut(_by_rare_grams(docs, crowded, scratch, edits, least)))
    counts = rows.groupBy("key").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))
    blocks = rows.join(counts, "key").withColumn("block", F.pmod(F.xxhash64("h"), F.col("blocks")).cast("int"))
    meets = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda o: F.struct(F.least(o, F.col("block")).alias("x"), F.greatest(o, F.col("block")).alias("y")))
    held = blocks.select("key", F.explode(meets).alias("m"), "h", "sketch").groupBy("key", "m").agg(F.collect_list("h").alias("h"), F.collect_list("sketch").alias("sketch")).select("h", "sketch")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = np.asarray(batch.column(0).value_lengths(), np.int64)
            ends = np.concatenate([[0], np.cumsum(sizes)])
            h, sketch = (_unsigned(batch.column(c).flatten()) for c in (0, 1))
            for i, j in row_slices(ends, TOGETHER):  # many small groups at once
                part = slice(ends[i], ends[j])
                a, b = _pairs(np.repeat(np.arange(i, j), sizes[i:j]), h[part], sketch[part], edits)
                yield pa.RecordBatch.from_arrays([pa.array(signed(a)), pa.array(signed(b))], names=["a", "b"])

    return kept(pairs.unionByName(held.mapInArrow(compare, "a long, b long")))


def within(left: list[np.ndarray], right: list[np.ndarray], edits: int) -> np.ndarray:
    """Whether each two arrays of code points are within ``edits`` (31 at most) edits: banded, bit-parallel, all at once."""
    pairs = []
    for a, b in zip(left, right, strict=True):
        a, b = (a, b) if len(a) >= len(b) else (b, a)
        n = len(b)
        differ = np.flatnonzero(a[:n] != b)
        lead = int(differ[0]) if len(differ) else n
        a, b = a[lead:], b[lead:]
        differ = np.flatnonzero(a[len(a) - len(b) :][::-1] != b[::-1]) if len(b) else np.zeros(0, int)
        tail = int(differ[0]) if len(differ) else len(b)
        pairs.append((a[: len(a) - tail], b[: len(b) - tail]))
    rows, columns = np.array([len(a) for a, _ in pairs]), np.array([len(b) for _, b in pairs])
    distance = rows - columns
    result = distance <= edits
    live = np.flatnonzero(result & (columns > 0))
    live = live[np.argsort(-columns[live], kind="stable")]
    one, full = np.uint64(1), ~np.uint64(0)
    while len(live):
        width = int(columns[live[0]]) + 2 * edits + 1
        ids, live = live[: max(1, (1 << 22) // width)], live[max(1, (1 << 22) // width) :]
        long, short = np.full((len(ids), width), 0xFFFFFFFF, np.uint32), np.full((len(ids), int(columns[ids[0]])), 0xFFFFFFFE, np.uint32)
        for k, i in enumerate(ids):
            a, b = pairs[i]
            long[k, edits : edits + len(a)][: width - edits] = a[: width - edits]
            short[k, : len(b)] = b
        gap = (rows - columns)[ids]
        score = gap.copy()
        watched = one << (edits + gap).astype(np.uint64)  # the diagonal that ends in the last cell
        rise, fall = np.full(len(ids), full << np.uint64(edits), np.uint64), np.zeros(len(ids), np.uint64)
        n = len(ids)
        for j in range(short.shape[1]):
            while columns[ids[n - 1]] <= j:  # ids fall by length: those that have ended are at the back
                n -= 1
            equal = np.zeros(n, np.uint64)
            for k in range(2 * edits + 1):
                equal |= (long[:n, j + k] == short[:n, j]).astype(np.uint64) << np.uint64(k)
            p, m = rise[:n], fall[:n]
            met = equal | m
            diagonal = (((met & p) + p) ^ p) | met
            plus, minus = m | ~(diagonal | p), diagonal & p
            score[:n] += (diagonal & watched[:n]) == 0
            diagonal >>= one
            rise[:n], fall[:n] = minus | ~(diagonal | plus), diagonal & plus
        result[ids] = score <= edits
    return result


def _slots(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(64 - FILTER_BITS)).astype(np.int64)


def links(docs: DataFrame, scratch: Scratch, *, edits: int = EDITS, least: int = MIN_CHARS) -> DataFrame:
    """Verified pairs (a, b) of hashes of different lines within ``edits``."""
    pairs = candidates(docs, scratch, edits=edits, least=least)
    needed = pairs.select(F.col("a").alias("h")).unionByName(pairs.select(F.col("b").alias("h"))).distinct()
    # A bit set of fixed size lets most other lines stay in their task; the join below is exact.
    slot = F.shiftrightunsigned("h", 64 - FILTER_BITS)
    shared = docs.sparkSession.sparkContext.broadcast(bit_set(needed.select(slot.alias("slot")), FILTER_BITS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = shared.value
        for batch in batches:
            for _, _, lines in _split(batch.column(0), least):
                h, at = np.unique(lines.hashes, return_index=True)
                slot = _slots(h)
                good = (bits[slot >> 6] >> (slot & 63).astype(np.uint64)) & np.uint64(1) > 0
                values = [lines.codes[s:e].tobytes().decode("utf-32-le", "replace") for s, e in zip(lines.starts[at[good]].tolist(), lines.ends[at[good]].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(signed(h[good])), pa.array(values, pa.string())], names=["h", "line"])

    found = _texts(docs).select("text").mapInArrow(run, "h long, line string").join(needed, "h", "left_semi").groupBy("h").agg(F.min("line").alias("line"))
    left, right = (found.select(F.col("h").alias(x), F.col("line").alias(f"line_{x}")) for x in "ab")
    both = pairs.join(left, "a").join(right, "b").select("a", "b", "line_a", "line_b")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for i in range(0, whole.num_rows, 1024):
                batch = whole.slice(i, 1024)
                sides = [[np.frombuffer(t.encode("utf-32-le"), np.uint32) for t in batch.column(c).to_pylist()] for c in (2, 3)]
                good = pa.array(within(*sides, edits))
                yield pa.RecordBatch.from_arrays([batch.column(0).filter(good), batch.column(1).filter(good)], names=["a", "b"])

    return both.mapInArrow(verify, "a long, b long")


def repeated_lines(docs: DataFrame, *, edits: int = EDITS, least: int = MIN_CHARS) -> DataFrame:
    """(doc_id, copy, n_lines, gone): lines considered and the sorted numbers (from 0) of those that go, for documents that have any line considered.

    ``copy`` is ``xxhash64`` of the text: rows that repeat a ``doc_id`` are documents of their own if their texts differ,
    and one document if not, which has one row here. Rows with a null ``doc_id``, null or empty texts and short lines take
    no part; an empty table gives none. Ties cannot arise: places are distinct.
    """
    scratch = Scratch(docs.sparkSession)
    places = occurrences(docs, least=least)
    place = F.struct("doc_id", "copy", "line_no")
    classes = scratch.cut(places.groupBy("h").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("n")))
    near = links(docs, scratch, edits=edits, least=least)
    firsts = classes.select("h", "first")
    told = near.join(firsts.select(F.col("h").alias("a"), F.col("first").alias("first_a")), "a").join(firsts.select(F.col("h").alias("b"), F.col("first").alias("first_b")), "b")
    later = told.select(F.when(F.col("first_a") < F.col("first_b"), F.col("b")).otherwise(F.col("a")).alias("h")).distinct().withColumn("near", F.lit(True))
    # Written, so that the join with all places is between plain exchanges, of which Spark splits a line that stands everywhere.
    known = scratch.cut(classes.join(later, "h", "left").filter("n > 1 OR near").select(F.col("h").alias("of"), "first", F.coalesce("near", F.lit(False)).alias("near")))
    marked = places.join(known, places["h"] == known["of"], "left")
    gone = F.when(F.col("near") | (place > F.col("first")), F.col("line_no"))
    return marked.groupBy("doc_id", "copy").agg(F.count_distinct("line_no").alias("n_lines"), F.sort_array(F.collect_set(gone)).alias("gone"))


def drop_repeated_lines(docs: DataFrame, *, edits: int = EDITS, least: int = MIN_CHARS) -> DataFrame:
    """``docs`` without repeated lines; ``n_chars``, if there, follows.

    A document of which no line but blank ones is left goes; one that lost none stays, as do rows with a null ``doc_id`` or
    text. Rows of one ``doc_id`` are told apart by their texts. Columns of any name stay as they are; an empty table gives none.
    """
    gone = repeated_lines(docs, edits=edits, least=least).filter(F.size("gone") > 0).select(F.col("doc_id").alias("of"), F.col("copy").alias("of_copy"), "gone")
    rows = docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("own"), F.col("text").cast("string").alias("whole"))
    rows = rows.withColumn("own_copy", F.xxhash64("whole"))
    joined = rows.join(gone, (F.col("own") == F.col("of")) & (F.col("own_copy") == F.col("of_copy")), "left")
    left = F.array_join(F.filter(F.split("whole", "\n", -1), lambda x, i: ~F.array_contains(F.col("gone"), i)), "\n")
    joined = joined.select("row", "gone", F.when(F.col("gone").isNotNull(), left).alias("left"))
    changed = {"text": F.col("left"), "n_chars": F.length("left")}
    columns = [F.when(F.col("gone").isNotNull(), changed[f.name].cast(f.dataType)).otherwise(F.col("row").getField(f.name)).alias(f.name) if f.name in changed else F.col("row").getField(f.name).alias(f.name) for f in docs.schema]
    return joined.filter(F.col("gone").isNull() | (F.trim(F.translate("left", "\n\r\t", "   ")) != "")).select(*columns)
