"""Links between near-equal vectors against all pairs."""

import numpy as np

from plenum.llm import vector_dedup

SCHEMA = "vec_id long, embedding array<double>, cell string, id int"


def plain(rows, threshold=0.9):
    """Row by row: id, links, component, kept."""
    good = [k for k, (_, v) in enumerate(rows) if v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    linked = {k: set() for k in range(len(rows))}
    for n in {len(rows[k][1]) for k in good}:
        own = [k for k in good if len(rows[k][1]) == n]
        x = np.array([rows[k][1] for k in own])
        x = x / np.abs(x).max(axis=1, keepdims=True)
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        for a in range(len(own)):
            for b in np.flatnonzero(x @ x[a] >= threshold):
                if a != b:
                    linked[own[a]].add(own[b])
    out, seen = [None] * len(rows), set()
    for k in range(len(rows)):
        if k not in seen:
            todo, group = [k], {k}
            while todo:
                for o in linked[todo.pop()] - group:
                    group.add(o)
                    todo.append(o)
            seen |= group
            least = min((rows[o][0] for o in group if rows[o][0] is not None), default=None)
            for o in group:
                out[o] = (rows[o][0], len(linked[o]), least, least is None or rows[o][0] == least)
    return sorted(out, key=str)


def found(spark, rows):
    df = spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], "x", 1) for i, v in rows], SCHEMA).repartition(3)
    return sorted(((r.vec_id, r.n_links, r.component_id, r.kept) for r in vector_dedup.near_equal_vectors(df).collect()), key=str)


def near(rng, v, cosine):
    aside = rng.normal(size=len(v))
    u = v / np.linalg.norm(v)
    aside -= (aside @ u) * u
    return cosine * u + np.sqrt(1 - cosine**2) * aside / np.linalg.norm(aside)


def test_copies_groups_pairs_at_all_cosines_nulls_and_lengths(spark):
    rng = np.random.default_rng(2)
    base = [rng.normal(size=32) for _ in range(400)]
    rows = [list(v) for v in base]
    rows += [list(base[0])] * 60 + [list(3.0 * base[1])] * 5  # copies, and another length of the same direction
    rows += [list(near(rng, base[2], c)) for c in rng.uniform(0.97, 0.9999, 150)]  # one crowd of near copies
    rows += [list(near(rng, base[k % 100 + 10], c)) for k, c in enumerate(rng.uniform(0.905, 0.99, 200))]
    rows += [list(rng.normal(size=7)) for _ in range(20)] + [None, [], [0.0] * 32, [1.0, None], [float("nan")] * 32, [float("inf")] + [0.0] * 31]
    rows = list(enumerate(rows)) + [(None, list(base[0])), (3, list(near(rng, base[3], 0.95))), (None, list(rng.normal(size=32))), (2000, [1e-200] * 32), (2001, [2e200] * 32)]
    expected, got = plain(rows), found(spark, rows)
    assert sum(r[1] for r in got) >= 0.98 * sum(r[1] for r in expected)
    # None is linked below the threshold, and almost all rows are as all pairs say.
    assert all(g[1] <= e[1] for g, e in zip(sorted(got, key=lambda r: str(r[0])), sorted(expected, key=lambda r: str(r[0])), strict=True))
    assert len(set(got) & set(expected)) >= 0.97 * len(set(expected))


def test_recall_at_the_threshold_and_crowds_of_two_cells(spark):
    rng = np.random.default_rng(4)
    base = [rng.normal(size=64) for _ in range(600)]
    rows = list(enumerate([list(v) for v in base] + [list(near(rng, v, 0.9005)) for v in base]))
    got = {r[0]: r for r in found(spark, rows)}
    assert sum(got[i][1] for i in range(600)) >= 0.95 * 600
    # Two tight crowds at 0.93 of each other, and one whose members lie around the threshold.
    other = near(rng, base[0], 0.93)
    crowd = [near(rng, v, c) for v in (base[0], other) for c in rng.uniform(0.996, 0.9999, 80)] + [near(rng, base[5], c) for c in rng.uniform(0.93, 0.97, 80)]
    rows = list(enumerate(list(v) for v in crowd))
    expected, got = plain(rows), found(spark, rows)
    assert sum(r[1] for r in got) >= 0.99 * sum(r[1] for r in expected) and [r[2] for r in got] == [r[2] for r in expected]


def test_pairs_do_not_follow_the_size_of_a_crowd(spark, monkeypatch):
    rng = np.random.default_rng(6)
    middle, met = rng.normal(size=64), []
    judged = vector_dedup._judged
    monkeypatch.setattr(vector_dedup, "_judged", lambda pairs, *a: met.append(pairs.count()) or judged(pairs, *a))
    n = 1500
    rows = [(i, list(near(rng, middle, 0.995))) for i in range(n)]
    assert all(r[1] == n - 1 and r[2] == 0 for r in found(spark, rows))
    assert met[0] < 20 * n


def test_codes_are_balanced_and_an_empty_table_gives_none(spark):
    rng = np.random.default_rng(1)
    units = rng.normal(size=(2000, 48)) + 0.5
    units /= np.linalg.norm(units, axis=1, keepdims=True)
    coder = vector_dedup.fit(units, 50_000)
    assert np.abs(coder.code(units).mean(axis=0) - 0.5).max() < 0.01 and coder.recall >= 0.995 and coder.bits == 16
    assert found(spark, []) == [] and found(spark, [(1, None), (None, None)]) == [(1, 0, 1, True), (None, 0, None, True)]
