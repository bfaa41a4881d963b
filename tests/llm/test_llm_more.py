"""Copies and clusters of vectors, the share of pieces that packing moves, license bodies, many spans, labellers and scorer by plain passes."""

import random
import time
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from plenum.llm import licenses, neighbours, packing, pii, quality
from plenum.llm.bytetext import span_hashes

DATA = "/root/testdata/sf0.001"


def recall(spark, values, ids, queries, kind="float"):
    frame = spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids, values, strict=True)], f"vec_id long, embedding array<{kind}>").repartition(4)
    got = defaultdict(list)
    for r in neighbours.nearest(frame, frame.filter(F.col("vec_id").isin([int(q) for q in queries]))).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    hit = 0
    exact = values.astype(np.float64)
    for q in queries:
        away = np.sqrt(((exact - exact[q]) ** 2).sum(axis=1))
        away[q] = np.inf
        best = np.lexsort((ids, away))[:10]
        assert [s for _, s in got[q]] == sorted(s for _, s in got[q]) and len(got[q]) == 10
        assert all(s == pytest.approx(away[i], abs=1e-12) for i, s in got[q])
        hit += sum(s <= away[best[-1]] + 1e-12 for _, s in got[q])
    return hit / (10 * len(queries))


def test_neighbours_beside_thousands_of_copies(spark):
    rng = np.random.default_rng(4)
    values = rng.normal(size=(8000, 32)).astype(np.float32)
    values[rng.permutation(8000)[:6000]] = values[0]
    others = np.flatnonzero((values != values[0]).any(axis=1))
    assert recall(spark, values, np.arange(8000), [*others[:60], 0]) >= 0.95


def test_neighbours_in_tight_clusters(spark):
    rng = np.random.default_rng(5)
    centers = rng.normal(size=(30, 32)) * 4
    values = (centers[rng.integers(0, 30, 4000)] + rng.normal(size=(4000, 32)) * 0.01).astype(np.float32)
    values[:2500] = (centers[0] + rng.normal(size=(2500, 32)) * 0.001).astype(np.float32)
    assert recall(spark, values, np.arange(4000), range(0, 4000, 80)) >= 0.9


def test_neighbours_of_double_vectors_and_repeated_ids(spark):
    base = np.random.default_rng(6).normal(size=(40, 4))
    values = base + np.arange(40)[:, None] * 1e-9  # told apart in double precision only where bases repeat
    values[20:] = values[:20] + 1e-10
    assert recall(spark, values, np.arange(40), range(40), "double") == 1.0
    rows = [(0, [1.0, 0.0]), (0, [1.0, 0.0]), (0, [1.0, 1.0]), (100, [5.0, 0.0])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = [(r.query_id, r["rank"], r.vec_id, r.score) for r in neighbours.nearest(frame, frame.filter("vec_id = 0")).orderBy("rank").collect()]
    assert got == [(0, 1, 0, 0.0), (0, 2, 0, 1.0), (0, 3, 100, 4.0)]  # only the query's own row is left out


@pytest.mark.parametrize("tasks", [1, 16])
def test_few_pieces_move_when_windows_are_drained(tasks):
    sizes = np.random.default_rng(1).lognormal(6, 1.2, 10_000).astype(int) + 1
    moved = total = windows = 0
    for t in range(tasks):
        levels, filled = packing.Levels(packing.WINDOW, packing.OPEN_WINDOWS, 0), Counter()
        for i, s in enumerate(sizes[t::tasks]):
            if s % packing.WINDOW:
                total += s % packing.WINDOW
                for r in levels.place((("d", s), 0, np.zeros(s % packing.WINDOW, np.uint32))):
                    filled[r[5]] += r[2]
        for r in levels.drain(True):
            filled[r[5]] += r[2]
        moved += levels.moved
        windows += len(filled)
        assert sum(v < packing.WINDOW for v in filled.values()) <= 1 and max(filled.values()) <= packing.WINDOW
    assert moved <= 0.1 * total and windows <= total / packing.WINDOW + tasks


BODIES = {
    "mit": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction",
    "isc": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that",
    "bsd": "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "bsd-3-clause": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without",
    "apache-2.0": "you may not use this file except in compliance with the License. You may obtain a copy",
    "gpl": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by",
    "cc-by": "You must give appropriate credit, provide a link to the license, and indicate if changes were made.",
    "unlicense": "This is free and unencumbered software released into the public domain.",
}


def test_license_bodies(spark):
    rows = spark.createDataFrame(list(enumerate(BODIES.values())), "doc_id long, text string")
    found = {r.doc_id: [d.label for d in r.detections] for r in licenses.scan(rows).collect()}
    assert all(label in found[i] for i, label in enumerate(BODIES))


def test_covered_detections_go(spark):
    """One pass over the sorted detections against all with all, on random spans."""
    rng = random.Random(3)
    text = " ".join(rng.choice(["mit license", "apache license 2 0", "apache license", "released under the mit license", "licensed under the apache license version 2 0", "public domain", "word"]) for _ in range(400))
    got = licenses.scan(spark.createDataFrame([(1, text)], "doc_id long, text string")).first().detections
    spans = [(d.start, d.end, d.priority, d.label) for d in got]
    assert len(spans) > 200 and [s[0] for s in spans] == sorted(s[0] for s in spans)
    for a in spans:
        assert not any(b != a and b[0] <= a[0] and b[1] >= a[1] and (b[1] - b[0] > a[1] - a[0]) and b[2] >= a[2] for b in spans)
    # Phrasings win over the bare names within them.
    assert all(p >= 50 for _, _, p, label in spans if label == "mit" and p != 10)


def test_many_spans_in_one_document_take_linear_time(spark):
    def seconds(n):
        rows = spark.createDataFrame([(1, " ".join(f"mail user{i}@host{i}.example.org now," for i in range(n)))], "doc_id long, text string")
        start = time.perf_counter()
        spans = pii.detect(rows).first().spans
        assert [s.kind for s in spans] == ["email"] * n
        return time.perf_counter() - start

    seconds(500)
    small = min(seconds(8000) for _ in range(2))
    assert min(seconds(16000) for _ in range(2)) < 3 * small + 1
    text = " ".join("all rights reserved under the mit license and" for _ in range(8000))
    start = time.perf_counter()
    assert len(licenses.scan(spark.createDataFrame([(1, text)], "doc_id long, text string")).first().detections) == 16000
    assert time.perf_counter() - start < 30


def plain_votes(text):
    data = (text or "").encode()
    low = bytes(c + 32 if 65 <= c <= 90 else c for c in data)
    words = [w for w in low.replace(b"\t", b" ").replace(b"\n", b" ").replace(b"\x0b", b" ").replace(b"\x0c", b" ").replace(b"\r", b" ").split(b" ") if w]
    n, some, size = len(words), max(len(words), 1), max(len(data), 1)
    lines = [x for x in low.split(b"\n") if x]
    doubled, n_lines = 1 - len(set(lines)) / max(len(lines), 1), max(len(lines), 1)
    upper, letters = sum(65 <= c <= 90 for c in data), sum(65 <= c <= 90 or 97 <= c <= 122 or c >= 128 for c in data)
    symbols, stops, shouts = sum(c in b"#$%&*|<>{}[]\\^~=_+@" for c in data), sum(c in b".!?" for c in data), data.count(b"!")
    variety, mean = len(set(words)) / some, letters / some
    function = sum(w in {x.encode() for x in quality.FUNCTION_WORDS.split()} for w in words) / some
    stutter = sum(a == b for a, b in zip(words, words[1:])) / some
    told = [  # good, bad, by labeller
        (n >= 20, n < 1), (2.5 <= mean <= 9, mean < 1.5 or mean > 14), (symbols / size < 0.01, symbols / size > 0.05), (upper / max(letters, 1) < 0.15, upper / max(letters, 1) > 0.4),
        (n >= 20 and variety > 0.45, n >= 20 and variety < 0.25), (n_lines > 1 and doubled == 0, doubled > 0.3), (function > 0.08, n >= 20 and function < 0.02), (letters / size > 0.7, letters / size < 0.55),
        (stops > 0 and shouts / some < 0.1, stops == 0 and n > 20 or shouts / some > 0.5), (n >= 20 and stutter < 0.05, n >= 5 and stutter > 0.2),
    ]
    return [0 if bad else 1 if good else -1 for good, bad in told]


def test_labellers_and_scorer_by_plain_passes(spark):
    given = [(r.doc_id, r.text) for r in spark.read.parquet(f"{DATA}/documents.parquet").orderBy("doc_id").collect() if len(r.text.split()) <= quality.SAMPLE_TOKENS]
    rows = [*given, (9000, None), (9001, ""), (9002, "a"), (9003, "WORD " * 30), (9004, "x\nx\ny\ny!!!"), (9005, "the the of of é"), (9005, "repeated id")]
    frame = spark.createDataFrame(rows, "doc_id long, text string").withColumn("pattern", F.lit("clash")).repartition(3)
    got = Counter((r.doc_id, r.n_votes, round(r.p_weak, 9), round(r.score, 6), r.keep) for r in quality.quality(frame).collect())
    votes = np.array([plain_votes(t) for _, t in rows])
    patterns, inverse, counts = np.unique((votes + 1) @ 3 ** np.arange(10), return_inverse=True, return_counts=True)
    posterior, _, _ = quality.expectation_maximisation(quality._votes_of(patterns), counts.astype(float))
    drawn = [(b" ".join(w[:64] for w in (t or "").encode().split()), float(posterior[p])) for (_, t), p in zip(rows, inverse, strict=True)]
    order = spark.createDataFrame([(bytearray(w), i) for i, (w, _) in enumerate(drawn)], "words binary, i int").orderBy(F.xxhash64("words"), "words").collect()
    weights, bias = quality._train([drawn[r.i] for r in order])
    bucket = lambda h: int(h >> np.uint64(40)) & (quality.BUCKETS - 1)
    own = lambda b: span_hashes(np.frombuffer(b, np.uint8), np.array([0]), np.array([len(b)]))[0]
    expected = Counter()
    for (k, t), v, p in zip(rows, votes, inverse, strict=True):
        held = []
        for w in (t or "").encode().split():
            low = bytes(c + 32 if 65 <= c <= 90 else c for c in w)
            shape = bytes(97 if 97 <= c <= 122 or c >= 128 else 65 if 65 <= c <= 90 else 48 if 48 <= c <= 57 else 111 for c in w[:12])
            held += [weights[bucket(own(low))], weights[bucket(own(shape) ^ own(w[-2:]) ^ np.uint64(0x5151))]]
        weak = float(posterior[p])
        score = 1 / (1 + np.exp(-np.clip(np.mean(np.array(held, float)) + bias, -30, 30))) if held else weak
        expected[(k, int((v >= 0).sum()), round(weak, 9), round(float(score), 6), bool(weak + score >= 1))] += 1
    assert got == expected
