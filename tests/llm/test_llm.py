"""The numbered operators against brute force on small documents, with nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from plenum.llm import contamination, language_id, licenses, line_dedup, near_dedup, neighbours, packing, passages, pii, quality
from plenum.llm.queries import tokenizer_path

DATA = "/root/testdata/sf0.001"
WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
#: Columns that operators use within themselves.
CLASHES = ["id", "rank", "label", "length", "key", "n", "a", "b", "h", "score", "rows", "spans", "pattern", "_text", "fp"]


def low(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def words(text):
    return WORDS.findall(low(text))


@pytest.fixture(scope="module")
def docs(spark):
    """Given documents with odd ones: null and empty texts, null and repeated ids, very long lines, and columns with clashing names."""
    rng = random.Random(3)
    rows = [(r.doc_id, r.text, r.lang) for r in spark.read.parquet(f"{DATA}/documents.parquet").orderBy("doc_id").collect()]
    base = " ".join("".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(120))
    near = base.split()
    near[7] = "changed"
    odd = [None, "", "   ", "...", "a", "one two", "one two", base, " ".join(near), base.upper(), "x" * 3000, "word " * 4000, "été naïve 漢字 test", "line that repeats here and there\nshort", "line that repeats here and there.\nother line that stands alone", "1 " * 3000]
    rows += [(1000 + i, t, None) for i, t in enumerate(odd)]
    rows += [(1007, base, None), (None, base, None), (None, None, None)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    return frame.withColumns({c: F.lit("clash") for c in CLASHES}).cache()


@pytest.fixture(scope="module")
def benchmark(spark):
    given = [(r.item_id, r.text) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    return spark.createDataFrame([*given, (900, "one two"), (901, None), (902, ""), (None, "a"), (903, "one two")], "item_id long, text string").withColumn("fp", F.lit(1))


@pytest.fixture(scope="module")
def empty(docs):
    return docs.filter("false")


def test_language_id(spark, docs, empty):
    rows = language_id.sample(docs)
    assert rows == language_id.sample(docs)
    model = language_id.train(rows)
    got = language_id.identify(docs, model).withColumn("held_out", F.crc32(F.col("doc_id").cast("string")) % 5 == 0).collect()
    assert len(got) == docs.count()
    known = [r for r in got if r.lang is not None and r.held_out]
    assert np.mean([r.lang == r.lang_pred for r in known]) > 0.95
    for r in got:
        assert 0 <= r.lang_score <= 1 and r.label == "clash"
        assert (r.lang_pred == "und") == (not re.search(r"[^\W\d_]", r.text or ""))
    assert language_id.identify(empty, model).count() == 0
    assert {r.lang_pred for r in language_id.identify(docs, language_id.train([])).collect()} == {"und"}


def test_contamination(docs, benchmark, empty):
    windows, owners = set(), defaultdict(set)
    for b in benchmark.collect():
        w = words(b.text)
        for i in range(max(1, len(w) - 9)) if w else []:
            windows.add(tuple(w[i : i + 10]))
            if b.item_id is not None:
                owners[tuple(w[i : i + 10])].add(str(b.item_id))
    lengths = {len(w) for w in windows}
    expected = Counter()
    for d in docs.collect():
        w, hit, items = words(d.text), set(), set()
        for n in lengths:
            for i in range(len(w) - n + 1):
                if tuple(w[i : i + n]) in windows:
                    hit |= set(range(i, i + n))
                    items |= owners[tuple(w[i : i + n])]
        expected[(d.doc_id, len(w), len(hit), ",".join(sorted(items)), bool(hit))] += 1
    got = contamination.contamination(docs, benchmark).collect()
    assert Counter((r.doc_id, r.n_words, r.n_hit, ",".join(r["items"]), r.contaminated) for r in got) == expected
    assert contamination.contamination(empty, benchmark).count() == 0
    assert contamination.contamination(docs, benchmark.filter("false")).filter("contaminated").count() == 0
    kept = contamination.decontaminate(docs, benchmark)
    assert kept.columns == docs.columns and kept.count() == sum(n for k, n in expected.items() if not k[4])
    assert contamination.decontaminate(empty, benchmark).count() == 0


PERSONAL = [
    "a@b.c_d@e.f x@y.zz_w@q.r a@b..c a@b.c.", "1.2.3.4.5.6.7.8 256.1.1.1 1.1.1.1", "4785380592391139 12--34 4 7 8 5 3 8 0 5 9 2 3 9 1 1 3 9", "+1 (555) 123-4567 x +12 +1    +49 170 1234567-",
    " é@a.b ü a@b-.c-", "\x01a@b.c\x011.1.1.1", "0000 0000 0000 0000 ", "1 " * 5000, "a." * 2000 + "@" + "b." * 2000, None, "", "漢4785380592391139",
]


def luhn(s):
    d = [int(c) for c in s if c.isdigit()][::-1]
    return sum(x if i % 2 == 0 else x * 2 - 9 * (x > 4) for i, x in enumerate(d)) % 10 == 0


def test_pii(spark, docs, empty):
    extra = spark.createDataFrame([(5000 + i, t) for i, t in enumerate(PERSONAL)], "doc_id long, text string").withColumn("spans", F.lit(0))
    rows = docs.select("doc_id", "text", F.lit(0).alias("spans")).unionByName(extra)
    patterns = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}
    digits = lambda s: sum("0" <= c <= "9" for c in s)
    good = {"email": lambda m: True, "ip": lambda m: all(int(x) <= 255 for x in m.split(".")), "card": lambda m: 13 <= digits(m) <= 19 and luhn(m), "phone": lambda m: 9 <= digits(m) <= 15}
    expected = Counter((d.doc_id, ",".join(f"{k}:{m.start()}:{m.end()}" for k, p in patterns.items() for m in re.finditer(p, d.text or "") if good[k](m[0]))) for d in rows.collect())
    base = F.filter("spans", lambda s: s["kind"].isin(*pii.BASE_KINDS))
    assert Counter(tuple(r) for r in pii.detect(rows).select("doc_id", pii.listing(base)).collect()) == expected
    told = spark.createDataFrame([(1, "my bank account DE89 3704 0044 0532 0130 00 ok"), (2, "DE89 3704 0044 0532 0130 01"), (3, "social security 123-45-6789"), (4, "part 123-45-6789"), (5, "mail me: a@b.c")], "doc_id long, text string")
    found = {r.doc_id: r.spans for r in pii.detect(told).collect()}
    assert [s.kind for s in found[1]] == ["iban"] and not found[2] and [s.kind for s in found[3]] == ["ssn"] and not found[4] and found[5][0].score == 1.0
    assert {r.text for r in pii.redact(told).filter("doc_id = 5").collect()} == {"mail me: <email>"}
    assert pii.detect(empty).count() == 0
    plan = pii.detect(spark.read.parquet(f"{DATA}/documents.parquet"))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Exchange" not in plan


def test_licenses(spark, docs, empty):
    extra = spark.createDataFrame([(6000, "GNU General Public License. CC-BY cc by, ALL RIGHTS reserved"), (6001, "all rights reserved all rights reserved"), (6002, "KK İ cc by"), (6003, "Licensed under the Apache License, Version 2.0"), (6004, "SPDX-License-Identifier: MIT license")], "doc_id long, text string")
    rows = docs.select("doc_id", "text").unionByName(extra)
    expected = Counter()
    for d in rows.collect():
        w = words(d.text)
        places = [(i, label) for phrase, label in licenses.BASE.items() for i in range(len(w)) if w[i : i + len(phrase.split())] == phrase.split()]
        expected[(d.doc_id, len(w), tuple(sorted(places)))] += 1
    got = licenses.scan(rows).collect()
    assert Counter((r.doc_id, r.n_words, tuple(sorted((b.start, b.label) for b in r.base))) for r in got) == expected
    labels = {r.doc_id: [(d.label, d.priority) for d in r.detections] for r in got}
    assert labels[6003] == [("apache-2.0", 50)] and labels[6004] == [("mit", 60)]
    assert licenses.scan(empty).count() == 0 and len(licenses.rules()) > 200
    assert "Python" not in licenses.scan(spark.read.parquet(f"{DATA}/documents.parquet"))._jdf.queryExecution().toString()


def union(pairs, nodes):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            root[x] = x = root[root[x]]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return find


def near_expected(rows):
    sets = defaultdict(list)
    for d in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", low(d.text))
        s = set() if not w else {tuple(w)} if len(w) < 5 else {tuple(w[i : i + 5]) for i in range(len(w) - 4)}
        sets[d.doc_id].append(s)
    flat = [(k, s) for k, v in sets.items() if k is not None for s in v if s]
    holders = defaultdict(list)
    for i, (_, s) in enumerate(flat):
        for x in s:
            holders[x].append(i)
    pairs = []
    for i, (k, s) in enumerate(flat):
        for j, n in Counter(j for x in s for j in holders[x] if j < i).items():
            if 100 * n >= 75 * (len(s) + len(flat[j][1]) - n):
                pairs.append((k, flat[j][0]))
    find = union(pairs, [k for k in sets if k is not None])
    return Counter((k, len(s), None if k is None else find(k), k is None or find(k) == k) for k, v in sets.items() for s in v)


def test_near_dedup(spark, docs, empty):
    rng = random.Random(9)
    base = [f"w{rng.randrange(10**6)}" for _ in range(160)]
    grown = []
    for i in range(150):  # a large group of near copies, from very close to far
        w = list(base)
        for _ in range(rng.randrange(0, 12)):
            w[rng.randrange(len(w))] = f"x{rng.randrange(10**6)}"
        grown.append((20_000 + i, " ".join(w)))
    rows = docs.select("doc_id", "text", "label").unionByName(spark.createDataFrame(grown, "doc_id long, text string").withColumn("label", F.lit("clash")))
    other = [f"y{rng.randrange(10**6)}" for _ in range(80)]
    texts = [(20_000, other), (40_000, [*other[:40], "z", *other[41:]]), (40_001, other[:30]), (40_000, other[:30]), (40_002, ["alone", *other[50:]]), (40_002, base)]  # ids that repeat with other texts
    rows = rows.unionByName(spark.createDataFrame([(k, " ".join(w)) for k, w in texts], "doc_id long, text string").withColumn("label", F.lit("clash")))
    assert Counter(tuple(r) for r in near_dedup.near_duplicates(rows).collect()) == near_expected(rows.collect())
    once = rows.filter("doc_id <> 1007")
    assert Counter(tuple(r) for r in near_dedup.near_duplicates(once).collect()) == near_expected(once.collect())
    kept = near_dedup.drop_near_duplicates(docs)
    assert kept.columns == docs.columns and kept.filter("doc_id IS NULL").count() == 2
    assert near_dedup.near_duplicates(empty).count() == 0


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        old, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            old, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, old + (x != y))
    return row[-1]


def test_banded_distance():
    rng = np.random.default_rng(1)
    left, right = [], []
    for _ in range(400):
        a = list(rng.integers(0, 3, rng.integers(0, 25)))
        b = list(a)
        for _ in range(rng.integers(0, 5)):
            b.insert(rng.integers(0, len(b) + 1), rng.integers(0, 3)) if rng.random() < 0.5 or not b else b.pop(rng.integers(0, len(b)))
        left.append(np.array(a, np.uint32))
        right.append(np.array(b, np.uint32))
    for edits in (1, 2, 4):
        assert (line_dedup.within(left, right, edits) == np.array([distance(a, b) <= edits for a, b in zip(left, right, strict=True)])).all()


def test_line_dedup(spark, docs, empty):
    rng = random.Random(4)
    lines = ["".join(rng.choice("abcd é漢") for _ in range(rng.randint(15, 60))) for _ in range(40)]
    noisy = []
    for i in range(120):
        c = list(rng.choice(lines))
        for _ in range(rng.randrange(4)):
            p = rng.randrange(len(c))
            c[p : p + rng.randrange(2)] = rng.choice(["", "z", "é"])
        noisy.append((30_000 + i // 3, "".join(c)))
    texts = defaultdict(list)
    for k, t in noisy:
        texts[k].append(t)
    # Many variants of one line, far from each other: one large group of a shared segment.
    for i in range(90):
        texts[31_000 + i].append("the same beginning of a line, and then " + "".join(rng.choice("abcdefghijklmnop") for _ in range(12)))
    extra = spark.createDataFrame([(k, "\n".join(v)) for k, v in texts.items()], "doc_id long, text string").withColumn("h", F.lit("clash"))
    rows = docs.select("doc_id", "text", "h").filter("doc_id IS NULL OR doc_id >= 1000").unionByName(extra)
    places = sorted({(d.doc_id, n, t) for d in rows.collect() if d.doc_id is not None for n, t in enumerate((d.text or "").split("\n")) if len(t) >= 20})
    first = {}
    for k, n, t in places:
        first.setdefault(t, (k, n))
    near = {max(a, b, key=first.get) for a in first for b in first if a < b and abs(len(a) - len(b)) <= 2 and (Counter(a) - Counter(b)).total() <= 2 and distance(a, b) <= 2}
    expected = {k: [n for kk, n, t in places if kk == k and (t in near or (k, n) > first[t])] for k, _, _ in places}
    got = {r.doc_id: r.gone for r in line_dedup.repeated_lines(rows).collect()}
    assert got == expected and near
    kept = line_dedup.drop_repeated_lines(docs)
    assert kept.columns == docs.columns
    left = {r.doc_id: r.text for r in kept.filter("doc_id BETWEEN 1013 AND 1014").collect()}
    assert left[1014] == "other line that stands alone" and left[1013].startswith("line that repeats")
    assert line_dedup.repeated_lines(empty).count() == 0 and line_dedup.drop_repeated_lines(empty).count() == 0


def test_passages(spark, docs, empty):
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(6))
    passage = [word() for _ in range(70)]
    rows = []
    for i in range(6):
        p = list(passage)
        p[20 + i] = word()
        if i % 2:
            del p[45]
        rows.append((i, " ".join([word() for _ in range(30 + i)] + p + [word() for _ in range(20)])))
    rows += [(100 + i, " ".join(word() for _ in range(120))) for i in range(10)] + [(200, None), (None, " ".join(passage)), (201, "")]
    got = passages.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string").withColumn("seed", F.lit(1)).repartition(4)).collect()
    assert {r.doc_id for r in got} == set(range(1, 6)) and {r.other_id for r in got} <= set(range(5))
    for r in got:
        assert r.identity >= 0.9 and abs(r.start - (30 + r.doc_id)) <= 1 and 68 <= r.end - r.start <= 72
    # Any 50 words that stand in an earlier document, too.
    first, repeats = {}, set()
    for d in docs.filter("doc_id < 1000").orderBy("doc_id").collect():
        w = words(d.text)
        for i in range(len(w) - 49):
            if first.setdefault(tuple(w[i : i + 50]), d.doc_id) != d.doc_id:
                repeats.add(d.doc_id)
    assert repeats <= {r.doc_id for r in passages.repeated_passages(docs).collect()}
    assert passages.repeated_passages(empty).count() == 0


def test_chains_keep_order():
    seeds = [(0, 50), (10, 60), (20, 5), (20, 70), (30, 15), (40, 25)]
    found = passages.chains(seeds, least=3)
    assert sorted(map(tuple, found)) == [((0, 50), (10, 60), (20, 70)), ((20, 5), (30, 15), (40, 25))]


def test_neighbours(spark):
    rng = np.random.default_rng(2)
    vectors = rng.normal(size=(600, 16)).astype(np.float32)
    vectors[5] = vectors[300]
    rows = [(i, v.tolist(), "c") for i, v in enumerate(vectors)] + [(700, None, "c"), (800, [0.0] * 16, "c"), (900, [float("nan")] * 16, "c"), (1000, [1.0, None] * 8, "c"), (300, vectors[300].tolist(), "c"), (1100, [1.0, 2.0], "c")]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>, rank string")
    found = neighbours.search(neighbours.build_index(frame, shard=150), frame.filter("vec_id % 100 = 0"))
    got = defaultdict(list)
    for r in found.orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    ids, values = np.append(np.arange(600), 300), np.concatenate([vectors, vectors[300:301]]).astype(float)
    hit = 0
    for q in range(0, 600, 100):
        away = np.sqrt(((values - values[q]) ** 2).sum(axis=1))
        away[ids == q] = np.inf
        best = np.lexsort((ids, away))[:10]
        hit += len({(ids[i], away[i]) for i in best} & set(got[q]))
    assert hit >= 57 and set(got) == set(range(0, 600, 100))
    assert neighbours.search(neighbours.build_index(frame.filter("false")), frame).count() == 0


def test_quality(spark, docs, empty):
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{DATA}/labels.parquet").collect()}
    got = {r.doc_id: r for r in quality.quality(docs).filter("doc_id < 1000").collect()}
    right = [bool(q) == got[k].keep for k, q in labels.items() if k in got]
    assert np.mean(right) > 0.9
    assert quality.quality(docs).count() == docs.count() and quality.quality(empty).count() == 0


def test_expectation_maximisation_finds_accuracies():
    rng = np.random.default_rng(6)
    truth = rng.random(20_000) < 0.7
    accuracy = np.array([0.95, 0.9, 0.8, 0.7, 0.65])
    votes = np.where(rng.random((20_000, 5)) < accuracy, truth[:, None], ~truth[:, None]).astype(int)
    votes[rng.random(votes.shape) < 0.2] = -1
    patterns, counts = np.unique(votes, axis=0, return_counts=True)
    _, tables, prior = quality.expectation_maximisation(patterns, counts.astype(float))
    assert abs(prior - 0.7) < 0.03 and np.abs(tables[:, 1, 1] - accuracy).max() < 0.04


def test_packing(spark, docs, empty):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokenizer_path())
    odd = ["  a  b\n\nc", "it's ok 's", "\t x  ", "foo<|endoftext|>bar", "12 34a5 !!  ?\n?", "…x –y z", "\x1ca\x1fb c\x85d"]
    rows = docs.select("doc_id", "text").filter("doc_id IS NOT NULL AND doc_id <> 1007").unionByName(spark.createDataFrame([(7000 + i, t) for i, t in enumerate(odd)], "doc_id long, text string"))
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in packing.pack(rows, tokenizer_path()).collect():
        pieces[r.doc_id].append(r)
        sequences[r.sequence_id].append(r)
    held = {d.doc_id: tokenizer.encode(d.text or "", add_special_tokens=False).ids + [1] for d in rows.collect()}
    assert set(held) == set(pieces)
    for k, ids in held.items():
        at = 0
        for r in sorted(pieces[k], key=lambda r: r.start):
            assert (r.start, r.doc_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(np.array(ids[at : at + r.length], "<u4").tobytes()))
            at += r.length
        assert at == len(ids)
    unfilled = 0
    for own in sequences.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        unfilled += at < packing.WINDOW
        assert at <= own[0].padded_length
    assert unfilled <= rows.rdd.getNumPartitions()
    assert packing.pack(docs, tokenizer_path()).filter("start = 0").count() == docs.count()
    assert packing.pack(docs, tokenizer_path(), open_windows=3).filter("start = 0").count() == docs.count()
    assert packing.pack(empty, tokenizer_path()).count() == 0


def test_items_digest_is_sha256_of_joined_ids(spark):
    from plenum.llm.queries import op4_decontamination

    rows = op4_decontamination(spark, DATA).collect()
    assert {r.items_sha256 for r in rows if r.n_items == 0} == {hashlib.sha256(b"").hexdigest()}


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, DATA).write.parquet(str(tmp_path / name))
        out = spark.read.parquet(str(tmp_path / name))
        if name != "packing":
            assert out.columns == columns and out.dtypes == docs.dtypes
            assert out.join(docs, "doc_id", "left_anti").count() == 0 and 0 < out.count() <= docs.count()
        docs = out
    assert docs.count() > 0
