"""Operator 6: quality from a weak-label model and a hashed linear scorer.

Overlapping heuristic labellers vote good, bad or nothing on every document. What they say together is one of at most
3^10 patterns; the counts of the patterns over all documents are a sufficient table for expectation-maximisation of the
latent-class model, which estimates each labeller's accuracy and gives every pattern a posterior. On a bounded sample
(``SAMPLE`` documents, the least by a hash of their texts) the posteriors train a logistic scorer over hashed words and
word shapes. Every document is then scored whole. Documents are read three times and never shuffled; the driver sees pattern counts and the
sample only.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plenum.llm.bytetext import lower_table, not_space_table, span_hashes, text_slices, token_spans

SAMPLE = 6000
SAMPLE_TOKENS = 256
BUCKETS = 1 << 16
EPOCHS = 6
LABELLERS = ("length", "word_length", "symbols", "capitals", "variety", "repeated_lines", "function_words", "letters", "sentences", "stutter")
#: Frequent words of the languages at hand.
FUNCTION_WORDS = "the of and to in is that it for with der die und das ist von mit den zu nicht le la les de des et en un une que el los las y es por con se"

_LOWER, _SOLID, _IN_LINE = lower_table(), not_space_table(), np.arange(256) != 10
_FUNCTION = np.sort(span_hashes(*(lambda w: (np.frombuffer("".join(w).encode(), np.uint8), np.cumsum([0, *map(len, w)])[:-1], np.cumsum([len(x) for x in w])))(FUNCTION_WORDS.split())))
_SHAPES = np.full(256, ord("o"), np.uint8)
_SHAPES[0x61:0x7B], _SHAPES[0x41:0x5B], _SHAPES[0x30:0x3A] = ord("a"), ord("A"), ord("0")
_SHAPES[0x80:] = ord("a")
_UPPER, _LETTERS, _SYMBOLS, _STOPS = (np.zeros(256, np.uint64) for _ in range(4))
_UPPER[0x41:0x5B] = _LETTERS[0x41:0x5B] = _LETTERS[0x61:0x7B] = _LETTERS[0x80:] = 1
_SYMBOLS[list(b"#$%&*|<>{}[]\\^~=_+@")] = _STOPS[list(b".!?")] = 1


def _counts(classes: np.ndarray, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Of each row the sums of a table over its bytes."""
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(classes[data], out=total[1:])
    return total[offsets[1:]] - total[offsets[:-1]]


def _two(first: np.ndarray, second: np.ndarray, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Counts of two classes of bytes in one pass, as halves of one number."""
    both = _counts(first + (second << np.uint64(32)), data, offsets)
    return (both & np.uint64(0xFFFFFFFF)).astype(np.int64), (both >> np.uint64(32)).astype(np.int64)


def _distinct(hashes: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
    """Number of distinct hashes of each of n rows; 44 bits of a hash tell."""
    bits = np.uint64(64 - 44) if n < 1 << 20 else np.uint64(32)
    keys = np.sort(rows.astype(np.uint64) << (np.uint64(64) - bits) | hashes >> bits)
    new = np.ones(len(keys), bool)
    new[1:] = keys[1:] != keys[:-1]
    return np.bincount((keys[new] >> (np.uint64(64) - bits)).astype(np.int64), minlength=n)


class Words:
    """Words of a slice: runs of anything but ASCII white space, with hashes of their lower case."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray) -> None:
        self.data, self.offsets, self.n = data, offsets, len(offsets) - 1
        self.starts, self.ends, self.rows = token_spans(data, offsets, _SOLID)
        self.counts = np.bincount(self.rows, minlength=self.n)
        self.hashes = span_hashes(_LOWER[data], self.starts, self.ends)


def votes(words: Words) -> np.ndarray:
    """Votes (1 good, 0 bad, -1 none) of all labellers on each row."""
    data, offsets, rows, hashes, n, count = words.data, words.offsets, words.rows, words.hashes, words.n, words.counts
    size, some = np.maximum(np.diff(offsets), 1), np.maximum(count, 1)
    variety = _distinct(hashes, rows, n) / some
    lines_from, lines_to, line_rows = token_spans(data, offsets, _IN_LINE)
    lines = span_hashes(_LOWER[data], lines_from, lines_to)
    n_lines = np.maximum(np.bincount(line_rows, minlength=n), 1)
    doubled = 1 - _distinct(lines, line_rows, n) / n_lines
    upper, letters = _two(_UPPER, _LETTERS, data, offsets)
    symbols, stops = _two(_SYMBOLS, _STOPS, data, offsets)
    shouts = np.bincount(np.searchsorted(offsets, np.flatnonzero(data == 0x21), "right") - 1, minlength=n)
    known = _FUNCTION[np.minimum(np.searchsorted(_FUNCTION, hashes), len(_FUNCTION) - 1)] == hashes
    function = np.bincount(rows[known], minlength=n) / some
    again = np.zeros(len(hashes), bool)
    again[1:] = (hashes[1:] == hashes[:-1]) & (rows[1:] == rows[:-1])
    stutter = np.bincount(rows[again], minlength=n) / some
    mean = letters / some
    out = np.full((n, len(LABELLERS)), -1, np.int8)

    def say(labeller: str, good: np.ndarray, bad: np.ndarray) -> None:
        out[good, LABELLERS.index(labeller)] = 1
        out[bad, LABELLERS.index(labeller)] = 0

    say("length", count >= 20, count < 1)
    say("word_length", (mean >= 2.5) & (mean <= 9), (mean < 1.5) | (mean > 14))
    say("symbols", symbols / size < 0.01, symbols / size > 0.05)
    say("capitals", upper / np.maximum(letters, 1) < 0.15, upper / np.maximum(letters, 1) > 0.4)
    say("variety", (count >= 20) & (variety > 0.45), (count >= 20) & (variety < 0.25))
    say("repeated_lines", (n_lines > 1) & (doubled == 0), doubled > 0.3)
    say("function_words", function > 0.08, (count >= 20) & (function < 0.02))
    say("letters", letters / size > 0.7, letters / size < 0.55)
    say("sentences", (stops > 0) & (shouts / some < 0.1), (stops == 0) & (count > 20) | (shouts / some > 0.5))
    say("stutter", (count >= 20) & (stutter < 0.05), (count >= 5) & (stutter > 0.2))
    return out


def _pattern(given: np.ndarray) -> np.ndarray:
    return ((given + 1).astype(np.int64) * 3 ** np.arange(given.shape[1])).sum(axis=1)


def _votes_of(patterns: np.ndarray) -> np.ndarray:
    return (patterns[:, None] // 3 ** np.arange(len(LABELLERS)) % 3 - 1).astype(int)


def expectation_maximisation(given: np.ndarray, counts: np.ndarray, rounds: int = 200) -> tuple[np.ndarray, np.ndarray, float]:
    """Posterior of good for each vote pattern, tables P(vote | class, voted) of labeller x class x vote, and the prior of good.

    It begins from the share of good among the votes given, which also fixes which class is the good one.
    """
    cast = np.maximum((given >= 0).sum(axis=1), 1)
    good = ((given == 1).sum(axis=1) + 0.5) / (cast + 1)
    held = np.stack([given == v for v in (0, 1)], axis=2).astype(float)  # pattern x labeller x vote; no vote says nothing
    for _ in range(rounds):
        weights = np.stack([1 - good, good], axis=1) * counts[:, None]
        tables = np.einsum("pc,plv->lcv", weights, held) + 1.0
        tables /= tables.sum(axis=2, keepdims=True)
        prior = (weights[:, 1].sum() + 1) / (weights.sum() + 2)
        log = np.einsum("plv,lcv->pc", held, np.log(tables)) + np.log([1 - prior, prior])
        new = 1 / (1 + np.exp(np.clip(log[:, 0] - log[:, 1], -50, 50)))
        done = np.abs(new - good).max(initial=0) < 1e-9
        good = new
        if done:
            break
    return good, tables, float(prior)


def _features(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Hashed words and shapes (the classes of the first twelve bytes, and the last two) of all rows: buckets and rows."""
    data, starts, ends = words.data, words.starts, words.ends
    shapes = span_hashes(_SHAPES[data], starts, np.minimum(ends, starts + 12)) ^ span_hashes(data, np.maximum(starts, ends - 2), ends)
    both = np.concatenate([words.hashes, shapes ^ np.uint64(0x5151)])
    return (both >> np.uint64(40)).astype(np.int64) & (BUCKETS - 1), np.concatenate([words.rows, words.rows])


def _train(sampled: list[tuple[bytes, float]], seed: int = 3) -> tuple[np.ndarray, float]:
    weights, bias, rng = np.zeros(BUCKETS), 0.0, np.random.default_rng(seed)
    parts = []
    for text, target in sampled:
        buckets, _ = _features(Words(np.frombuffer(text, np.uint8), np.array([0, len(text)])))
        if len(buckets):
            parts.append((buckets, target))
    for epoch in range(EPOCHS):
        rate = 4.0 / (1 + epoch)
        for i in rng.permutation(len(parts)):
            buckets, target = parts[i]
            wrong = target - 1 / (1 + np.exp(-np.clip(weights[buckets].mean() + bias, -30, 30)))
            np.add.at(weights, buckets, rate * wrong / np.sqrt(len(buckets)))
            bias += 0.05 * wrong
    return weights.astype(np.float32), bias


def quality(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_votes, p_weak (posterior of the votes), score (linear scorer), keep.

    ``keep`` holds if the mean of both is at least one half. A null or empty text is judged by its votes, as any other;
    repeated rows and null ``doc_id`` keep their rows; an empty table gives none. Other columns are ignored.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))

    def patterns(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [_pattern(votes(Words(data, offsets))) for _, _, data, offsets in text_slices(batch.column(0))]
            values, counts = np.unique(np.concatenate([np.zeros(0, np.int64), *found]), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(values), pa.array(counts)], names=["pattern", "n"])

    table = texts.select("text").mapInArrow(patterns, "pattern long, n long").groupBy("pattern").agg(F.sum("n").alias("n")).orderBy("pattern").collect()
    seen = np.array([r["pattern"] for r in table], np.int64)
    posterior, _, _ = expectation_maximisation(_votes_of(seen), np.array([r["n"] for r in table], float)) if len(seen) else (np.zeros(0), None, 0)
    total = max(1, sum(r["n"] for r in table))

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for _, _, data, offsets in text_slices(batch.column(0)):
                words = Words(data, offsets)
                given, starts, ends = _pattern(votes(words)), words.starts, words.ends
                at = np.concatenate([[0], np.cumsum(words.counts)])
                for r in range(len(offsets) - 1):
                    own = np.arange(at[r], at[r + 1])
                    if len(own) > SAMPLE_TOKENS:
                        own = np.sort(np.random.default_rng(int(offsets[r + 1] - offsets[r])).choice(own, SAMPLE_TOKENS, replace=False))
                    out.append((b" ".join(data[a : min(b, a + 64)].tobytes() for a, b in zip(starts[own].tolist(), ends[own].tolist(), strict=True)), int(given[r])))
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in out], pa.binary()), pa.array([p for _, p in out], pa.int64())], names=["words", "pattern"])

    share = min(1.0, 2 * SAMPLE / total)
    drawn = texts.filter(F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30)) < share * (1 << 30)).select("text").mapInArrow(draw, "words binary, pattern long")
    sampled = [(bytes(r["words"]), float(posterior[np.searchsorted(seen, r["pattern"])])) for r in drawn.orderBy(F.xxhash64("words"), "words").limit(SAMPLE).collect()]
    model = spark.sparkContext.broadcast((*_train(sampled), seen, posterior))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, bias, seen, posterior = model.value
        for batch in batches:
            for i, j, data, offsets in text_slices(batch.column(1)):
                words = Words(data, offsets)
                given = votes(words)
                weak = posterior[np.searchsorted(seen, _pattern(given))]
                buckets, rows = _features(words)
                mean = np.bincount(rows, weights=weights[buckets], minlength=j - i) / np.maximum(2 * words.counts, 1)
                linear = np.where(words.counts > 0, 1 / (1 + np.exp(-np.clip(mean + bias, -30, 30))), weak)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array((given >= 0).sum(axis=1).astype(np.int64)), pa.array(weak), pa.array(linear), pa.array(weak + linear >= 1)], names=["doc_id", "n_votes", "p_weak", "score", "keep"])

    return texts.mapInArrow(score, "doc_id long, n_votes long, p_weak double, score double, keep boolean")
