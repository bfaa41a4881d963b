"""Collocations against a plain pass over all phrases."""

import re
from collections import Counter

import numpy as np
import pytest

from plenum.llm import phrases

SCHEMA = "doc_id long, text string, lang string, f long, k string"
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain(rows, least=30, within=80, first=2000, longest=4):
    counts, totals = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOW)):
            words = re.findall(r"[^\x20\x09]+", piece)
            totals[lang] += len(words)
            for k in range(1, longest + 1):
                for i in range(len(words) - k + 1):
                    counts[lang, tuple(words[i : i + k])] += 1
    candidates = {p: a for p, a in counts.items() if len(p[1]) > 1 and a >= least}
    gone = {(lang, w[i : i + m]) for (lang, w), f in candidates.items() for m in range(2, len(w)) for i in range(len(w) - m + 1) if 100 * f >= within * counts[lang, w[i : i + m]]}
    out = {}
    for (lang, w), a in candidates.items():
        if (lang, w) not in gone:
            score, k, l, r = min((2_000_000 * a // (counts[lang, w[:k]] + counts[lang, w[k:]]), k, counts[lang, w[:k]], counts[lang, w[k:]]) for k in range(1, len(w)))
            out.setdefault(lang, []).append((-score, -a, " ".join(w).encode(), l, r))
    return sorted((lang, n, p.decode(), -a, l, r, totals[lang], -s) for lang, found in out.items() for n, (s, a, p, l, r) in enumerate(sorted(found)[:first], 1))


def found(spark, rows, **parameters):
    df = spark.createDataFrame([(i, t, g, 1, "x") for i, (t, g) in enumerate(rows)], SCHEMA).repartition(3)
    return sorted(tuple(r) for r in phrases.collocations(df, **parameters).collect())


def texts(n, seed):
    rng = np.random.default_rng(seed)
    vocabulary = [f"w{i}" for i in range(60)] + ["Ünï", "x y", "日本"]
    weights = 1 / np.arange(1, len(vocabulary) + 1)
    out = []
    for i in range(n):
        words = list(rng.choice(vocabulary, rng.integers(0, 60), p=weights / weights.sum()))
        if i % 3 == 0:
            words += ["one", "two", "three", "four"]
        if i % 5 == 0:
            words += ["two", "three", "four,", "new", "york", "city"]
        out.append("".join(w + rng.choice([" ", "  ", "\t", " \t ", ". ", ",", "\n", "? "], p=[0.72, 0.05, 0.05, 0.03, 0.05, 0.04, 0.03, 0.03]) for w in words))
    return out


@pytest.mark.parametrize("shards", [1, 3, 4])
def test_equals_a_plain_pass(spark, shards):
    rows = [(t, ["en", "de", None, "und"][i % 4]) for i, t in enumerate(texts(600, shards))]
    rows += [("Same Copy of a line", "en")] * 100 + [(None, "en"), ("", None), (" \t.,;", "fr"), ("a " * 20000, "xx")]
    assert found(spark, rows, shards=shards) == plain(rows)


def test_ranks_are_cut_and_full_slots_change_nothing(spark):
    rows = [(t, "en") for t in texts(300, 9)]
    assert found(spark, rows, first=7, least=5, within_percent=60) == plain(rows, 5, 60, 7)
    assert found(spark, rows, bits=6) == plain(rows)  # 64 slots for all phrases
    assert found(spark, rows, longest=2) == plain(rows, longest=2)


def test_tasks_pass_on_parts(spark, monkeypatch):
    monkeypatch.setattr(phrases, "SUMMED", 50)
    rows = [(t, "en") for t in texts(120, 3)]
    df = spark.createDataFrame([(i, t, g, 1, "x") for i, (t, g) in enumerate(rows)], SCHEMA).coalesce(1)
    assert sorted(tuple(r) for r in phrases.collocations(df, least=10).collect()) == plain(rows, 10)


def test_rare_words_join_late_and_empty_tables_give_none(spark):
    # A pair that only reaches the least count in the last shard of a cycle is still counted in all.
    rows = [(f"lead {i} rare pair", "en") for i in range(31)] + [(f"filler text {i}", "en") for i in range(29)]
    assert found(spark, rows) == plain(rows) and any(r[2] == "rare pair" for r in plain(rows))
    assert found(spark, []) == [] and found(spark, [(None, None)]) == []


def test_products_may_pass_64_bits(spark):
    big = 6_000_000_000_000_000_000
    counts = spark.createDataFrame([("en", 0, "", big), ("en", 1, "a", big), ("en", 1, "b", big), ("en", 2, "a b", big - 1), ("en", 3, "a b a", big // 2), ("en", 2, "b a", big - 7)], "lang string, k int, phrase string, f long")
    got = {r.phrase: (r.score, r.rank) for r in phrases.ranked(counts).collect()}
    assert got == {"a b": (2_000_000 * (big - 1) // (2 * big), 1), "b a": (2_000_000 * (big - 7) // (2 * big), 2), "a b a": (2_000_000 * (big // 2) // (2 * big - 1), 3)}
