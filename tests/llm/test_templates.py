"""Many variants of one line: lines that share segments in large groups."""

import random
import time

import numpy as np

from plenum.llm import line_dedup


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        left, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            left, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, left + (x != y))
    return row[-1]


def gone(spark, lines, per=50):
    docs = spark.createDataFrame([(i // per, "\n".join(lines[i : i + per])) for i in range(0, len(lines), per)], "doc_id long, text string").repartition(4)
    return {(r.doc_id * per + n) for r in line_dedup.repeated_lines(docs).collect() for n in r.gone}


def test_variants_of_one_template_are_found_exactly(spark, monkeypatch):
    monkeypatch.setattr(line_dedup, "BLOCK", 40)
    monkeypatch.setattr(line_dedup, "GROUP", 10)
    rng = random.Random(3)
    lines = [f"Order number {rng.randrange(10**5):05d} was shipped to the customer today" for _ in range(240)]
    for k in range(80):
        line = list(rng.choice(lines))
        for _ in range(rng.randrange(1, 4)):
            at = rng.randrange(len(line))
            line[at : at + rng.randrange(2)] = rng.choice(["", "x", "yz"])
        lines.append("".join(line))
    expected = {i for i, b in enumerate(lines) if any(abs(len(a) - len(b)) <= 2 and distance(a, b) <= 2 for a in lines[:i])}
    assert gone(spark, lines) == expected and 30 < len(expected) < 300


def test_grams_of_lines_within_edits_share_one_of_the_first(spark):
    rng = random.Random(4)
    for _ in range(300):
        a = "".join(rng.choice("ab ") for _ in range(rng.randrange(20, 30)))
        b = list(a)
        for _ in range(2):
            at = rng.randrange(len(b))
            b[at : at + rng.randrange(2)] = rng.choice(["", "a", "b"])
        codes = np.frombuffer((a + "".join(b)).encode("utf-32-le"), np.uint32)
        lines = line_dedup.Lines(codes, np.array([0, len(a)]), np.array([len(a), len(codes)]))
        grams, counts = line_dedup.grams_of(lines, np.array([0, 1]))
        assert list(counts) == [len(a) - 2, len(b) - 2] and len(np.unique(grams[: counts[0]])) == counts[0]
        first = [set(sorted(x.tolist())[:7]) for x in (grams[: counts[0]], grams[counts[0] :])]
        assert first[0] & first[1]


def test_time_follows_the_number_of_variants(spark):
    def seconds(n):
        rng = random.Random(n)
        lines = [f"Reference {rng.randrange(10**9):09d} has been recorded in the register of entries" for _ in range(n)]
        start = time.perf_counter()
        gone(spark, lines, 100)
        return time.perf_counter() - start

    seconds(1000)
    assert seconds(16_000) < 4 * seconds(4_000)
