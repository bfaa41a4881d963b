"""Operator 8: near-duplicate documents by a chosen-path set similarity join (Christiani, Pagh and Sivertsen).

1. Texts become sets of hashed word shingles with a minwise signature. Equal sets form one class, and only one document
   of each goes on: thousands of copies cost one aggregation.
2. Stars: of the sets that have a signature value a few are pivots (the least, the greatest, one by hash); sets that share
   many of the first values with a pivot are paired with it and confirmed. The components of these links give a large
   group of near copies one label, by a few pairs for each document instead of all pairs of the group.
3. Trees: several independent trees begin with nodes of three minwise values, ``ROOT_BRANCHES`` to a tree; a node that is
   large branches on by one more value, twice, chosen by its own path. Nodes of one label end. Small nodes are compared
   exhaustively, between labels, and pairs whose signatures agree enough are confirmed on the full sets. Nodes that hold
   much of the node above, or of which much has one label, so that branching does not take them apart, and those of the last level are compared
   exhaustively on full sets, in blocks of bounded size, within tasks that return only links that join labels; sets of the
   label that most of a dense node has meet the others only. Nodes of several paths that hold the same sets are compared once. A pair at similarity 0.75 meets in a tree's first nodes with
   probability 0.96, and stays together at each further level with 0.94; four trees of all levels miss it with 1e-3 at
   most, those of the usual one or two levels with 1e-4.
4. Components of the confirmed links follow.

All sets are compared as sorted 64-bit hashes, made once for those that a stage needs. Each stage's tables are deleted
when the next one stands.

Signatures only propose: no link is taken without the full sets.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plenum.llm.bytetext import gram_hashes, lower_table, mix, not_space_table, signed, span_hashes, text_slices, token_spans
from plenum.llm.graphs import components
from plenum.llm.tables import Scratch, bit_set, held, slot_of

SHINGLE = 5
THRESHOLD_PERCENT = 75
SIGNATURE = 128
STAR_VALUES = 16
STAR_SHARED = 8
TREES = 4
ROOT_VALUES = 3
ROOT_BRANCHES = 6
BRANCHES = 2
SMALL_NODE = 24
LEVELS = 5
ALIKE = 0.3
SIGNS = 3
BLOCK = 512
BLOCK_HASHES = 1 << 20
#: A pair at the threshold agrees in fewer signature values than this with probability 4e-5.
AGREEING = 77

_LOWER, _MEMBER = lower_table(), not_space_table()


def _shingles(data: np.ndarray, offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes and their rows, ordered by row, then hash; a row of 1 to k-1 words has one, of all its words."""
    data = _LOWER[data]
    starts, ends, rows = token_spans(data, offsets, _MEMBER)
    words = span_hashes(data, starts, ends)
    grams, inside = gram_hashes(words, rows, k)
    hashes, owners = grams[inside], rows[: len(grams)][inside]
    n = len(offsets) - 1
    first, last = np.searchsorted(rows, np.arange(n)), np.searchsorted(rows, np.arange(n), "right")
    short = np.flatnonzero((last > first) & (last - first < k))
    if len(short):
        whole = [int(mix(words[first[r] : last[r]] + np.arange(1, last[r] - first[r] + 1, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93)).sum(dtype=np.uint64)) for r in short]
        hashes, owners = np.concatenate([hashes, mix(np.array(whole, np.uint64) ^ np.uint64(0xA5A5))]), np.concatenate([owners, short])
    order = np.lexsort((hashes, owners))
    hashes, owners = hashes[order], owners[order]
    new = np.ones(len(hashes), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (owners[1:] != owners[:-1])
    return hashes[new], owners[new]


def _ids(hashes: np.ndarray, owners: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of n rows the set sizes, ids of the sets, and which rows have a set at all; equal sets have one id."""
    counts = np.bincount(owners, minlength=n)
    filled = np.flatnonzero(counts)
    sums, crosses = np.zeros(n, np.uint64), np.zeros(n, np.uint64)
    if len(filled):
        at = np.cumsum(counts)[filled] - counts[filled]
        sums[filled] = np.add.reduceat(hashes, at)
        crosses[filled] = np.bitwise_xor.reduceat(mix(hashes + np.uint64(77)), at)
    return counts, signed(mix(sums + mix(crosses ^ mix(counts.astype(np.uint64))))), filled


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def features(docs: DataFrame, *, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, n_shingles, id (a hash of the whole set; null without one) and signature of every row of ``docs``."""
    seeds = np.random.default_rng(20240601).integers(1, 1 << 32, (2, SIGNATURE), dtype=np.uint64).astype(np.uint32) | np.uint32(1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, data, offsets in text_slices(batch.column(1)):
                n = j - i
                hashes, owners = _shingles(data, offsets, shingle)
                counts, ids, filled = _ids(hashes, owners, n)
                signature = np.zeros((n, SIGNATURE), np.uint32)
                if len(filled):
                    at = np.cumsum(counts)[filled] - counts[filled]
                    short = (hashes >> np.uint64(32)).astype(np.uint32)
                    for v in range(SIGNATURE):
                        values = (short ^ seeds[0, v]) * seeds[1, v]
                        signature[filled, v] = np.minimum.reduceat(values, at)
                values = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * SIGNATURE), pa.array(signature.reshape(-1).view(np.int32)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, n), pa.array(counts.astype(np.int64)), pa.array(ids, mask=counts == 0), values], names=["doc_id", "n_shingles", "id", "signature"])

    return _texts(docs).mapInArrow(run, "doc_id long, n_shingles long, id long, signature array<int>")


def _sets(docs: DataFrame, wanted: DataFrame, shingle: int) -> DataFrame:
    """(id, hashes): the sorted hashes of each set in ``wanted`` (id, doc_id of one document that has it; no row twice).

    A bit set of fixed size lets other texts stay in their task, unread; the join after it is exact.
    """
    shared = docs.sparkSession.sparkContext.broadcast(bit_set(wanted.select(slot_of("doc_id").alias("slot"))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.filter(pa.array(held(shared.value, np.asarray(batch.column(2), np.int64))))
            for i, j, data, offsets in text_slices(batch.column(1)):
                hashes, owners = _shingles(data, offsets, shingle)
                counts, ids, _ = _ids(hashes, owners, j - i)
                ends = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32) * 8
                values = pa.Array.from_buffers(pa.binary(), j - i, [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(hashes)])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(ids), values], names=["doc_id", "id", "hashes"])

    found = _texts(docs).filter("doc_id IS NOT NULL").select("doc_id", "text", slot_of("doc_id").alias("slot")).mapInArrow(run, "doc_id long, id long, hashes binary")
    return found.join(wanted, ["doc_id", "id"], "left_semi").groupBy("id").agg(F.first("hashes").alias("hashes"))


def confirm(pairs: DataFrame, sets: DataFrame, percent: int = THRESHOLD_PERCENT) -> DataFrame:
    """The pairs (a, b) whose sets (id, hashes) reach the threshold."""
    left, right = (sets.select(F.col("id").alias(x), F.col("hashes").alias(f"set_{x}")) for x in "ab")
    both = pairs.join(left, "a").join(right, "b").select("a", "b", "set_a", "set_b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = np.zeros(batch.num_rows, bool)
            for r, sides in enumerate(zip(batch.column(2), batch.column(3), strict=True)):
                x, y = (np.frombuffer(s.as_buffer(), np.uint64) for s in sides)
                shared = np.count_nonzero(y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x)
                good[r] = 100 * shared >= percent * (len(x) + len(y) - shared)
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(good)), batch.column(1).filter(pa.array(good))], names=["a", "b"])

    return both.mapInArrow(run, "a long, b long")


def _value(node: Column, branch: int) -> Column:
    """The signature value by which a node branches: a function of its path alone."""
    return F.get(F.col("signature"), F.pmod(F.xxhash64(node, F.lit(branch)), F.lit(SIGNATURE)).cast("int"))


def _roots(sets: DataFrame) -> DataFrame:
    """The first nodes of all trees, each by ``ROOT_VALUES`` minwise values: node, id, label, size, parent."""
    nodes = []
    for tree in range(TREES):
        for branch in range(ROOT_BRANCHES):
            path = F.xxhash64(F.lit(tree), F.lit(branch))
            nodes.append(F.xxhash64(path, *(_value(path, v) for v in range(ROOT_VALUES))))
    return sets.select(F.explode(F.array(*nodes)).alias("node"), "id", "label", "size", F.lit(None).cast("long").alias("parent"))


def _children(rows: DataFrame) -> DataFrame:
    """The children of each row's node, each by one more minwise value."""
    node = F.col("node")
    children = F.array(*(F.xxhash64(node, F.lit(b), _value(node, b)) for b in range(BRANCHES)))
    return rows.select(F.explode(F.array_distinct(children)).alias("node"), "id", "label", "size", F.col("n").alias("parent"))


def _stars(classes: DataFrame, scratch: Scratch) -> DataFrame:
    """Pairs (a, b), a < b, of each set and the pivots with which it meets in enough signature values."""
    values = F.transform(F.sequence(F.lit(0), F.lit(STAR_VALUES - 1)), lambda j: F.xxhash64(j, F.get(F.col("signature"), j)))
    nodes = classes.select(F.explode(values).alias("node"), "id")
    by_hash = F.min(F.struct(F.xxhash64("id").alias("h"), "id"))["id"]
    held = nodes.groupBy("node").agg(F.min("id").alias("low"), F.max("id").alias("high"), by_hash.alias("other")).filter("low < high")
    # Written, so that both sides of the join are plain exchanges, of which Spark splits what is skewed.
    pivots = scratch.cut(held.select("node", F.array_distinct(F.array("low", "high", "other")).alias("pivots")))
    met = nodes.join(pivots, "node").select("id", F.explode("pivots").alias("pivot")).filter("id <> pivot")
    often = met.groupBy("id", "pivot").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= STAR_SHARED)
    pairs = scratch.cut(often.select(F.least("id", "pivot").alias("a"), F.greatest("id", "pivot").alias("b")).distinct())
    scratch.drop(pivots)
    return pairs


def _small_nodes(members: DataFrame, signatures: DataFrame) -> DataFrame:
    """Pairs (a, b), a < b, between the labels of nodes of bounded size whose signatures agree enough; ``members`` has key, id, label."""
    rows = members.join(signatures, "id")
    grouped = rows.groupBy("key").agg(F.collect_list("id").alias("ids"), F.collect_list("label").alias("labels"), F.collect_list("signature").alias("signatures")).select("ids", "labels", "signatures")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for ids, labels, found in zip(*(batch.column(c) for c in range(3)), strict=True):
                i, own = np.asarray(ids.values), np.asarray(labels.values)
                values = np.asarray(found.values.flatten()).reshape(len(i), SIGNATURE)
                x, y = np.nonzero(np.triu(own[:, None] != own, 1))
                good = (values[x] == values[y]).sum(axis=1) >= AGREEING
                left.append(np.minimum(i[x], i[y])[good])
                right.append(np.maximum(i[x], i[y])[good])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(left)), pa.array(np.concatenate(right))], names=["a", "b"])

    return grouped.mapInArrow(run, "a long, b long").distinct()


def _blocks(members: DataFrame) -> DataFrame:
    """Members of large nodes (key, low, id, label, size) under the keys of pairs of blocks of bounded size, in sets and in hashes.

    The least label of a node, which is that of a group if the node holds one, is left out of account within itself: its
    blocks meet those of all other labels, and these meet each other.
    """
    main = F.col("label") == F.col("low")
    blocks = lambda own: F.ceil(F.greatest(F.count_if(own) / BLOCK, F.sum(F.when(own, F.col("size")).otherwise(0)) / BLOCK_HASHES)).cast("int")
    counts = members.groupBy("key").agg(blocks(main).alias("mains"), blocks(~main).alias("others"))
    placed = members.join(counts, "key").withColumn("block", F.pmod(F.xxhash64("id"), F.when(main, F.col("mains")).otherwise(F.col("others"))).cast("int"))
    each = lambda n, key: F.transform(F.sequence(F.lit(0), F.col(n) - 1), key)
    across = lambda i, j: F.xxhash64("key", F.lit(0), i, j)
    among = each("others", lambda o: F.xxhash64("key", F.lit(1), F.least(o, F.col("block")), F.greatest(o, F.col("block"))))
    keys = F.when(main, each("others", lambda j: across(F.col("block"), j))).otherwise(F.concat(each("mains", lambda i: across(i, F.col("block"))), F.when(F.col("others") > 1, among).otherwise(F.array().cast("array<bigint>"))))
    return placed.select(F.explode(keys).alias("key"), "id", "label")


def _large_nodes(blocks: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Confirmed links (a, b) within pairs of blocks; full sets are compared within the task, so that no pair leaves it but links that join labels."""
    grouped = blocks.join(sets, "id").groupBy("key").agg(F.collect_list("id").alias("ids"), F.collect_list("label").alias("labels"), F.collect_list("hashes").alias("hashes")).select("ids", "labels", "hashes")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, labels, found in zip(*(batch.column(c) for c in range(3)), strict=True):
                i, own = np.asarray(ids.values), np.asarray(labels.values)
                if (own == own[0]).all():
                    continue
                parts = [np.frombuffer(h.as_buffer(), np.uint64) for h in found.values]
                rows = np.repeat(np.arange(len(parts)), [len(p) for p in parts])
                x, y = np.nonzero(np.triu(_linked(np.concatenate(parts), rows, len(i), percent) & (own[:, None] != own), 1))
                keep = _spanning(own[x], own[y])
                x, y = i[x[keep]], i[y[keep]]
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y))], names=["a", "b"])

    return grouped.mapInArrow(run, "a long, b long")


def _linked(hashes: np.ndarray, rows: np.ndarray, n: int, percent: int) -> np.ndarray:
    """Matrix of the pairs of n sets that reach the threshold: sizes of all intersections by products over shared elements."""
    sizes = np.bincount(rows, minlength=n)
    _, column, counts = np.unique(hashes, return_inverse=True, return_counts=True)
    several = counts > 1
    place = np.cumsum(several) - 1
    good = several[column]
    column, owners = place[column[good]], rows[good]
    shared = np.zeros((n, n), np.float32)
    order = np.argsort(column, kind="stable")
    column, owners = column[order], owners[order]
    for a in range(0, int(several.sum()), 4096):
        part = slice(*np.searchsorted(column, [a, a + 4096]))
        held = np.zeros((n, 4096), np.float32)
        held[owners[part], column[part] - a] = 1
        shared += held @ held.T
    both = shared.astype(np.int64)
    return (100 * both >= percent * (sizes[:, None] + sizes - both)) & (both > 0)


def _spanning(x: np.ndarray, y: np.ndarray) -> list[int]:
    """Places of links that join labels not joined by those before."""
    root: dict[int, int] = {}

    def find(v: int) -> int:
        while root.get(v, v) != v:
            root[v] = v = root.get(root[v], root[v])
        return v

    kept = []
    for k, (u, v) in enumerate(zip(x.tolist(), y.tolist(), strict=True)):
        u, v = find(u), find(v)
        if u != v:
            root[max(u, v)] = min(u, v)
            kept.append(k)
    return kept


def _links(labelled: DataFrame, sets_of, scratch: Scratch, percent: int) -> DataFrame:
    """Confirmed links between labels from all trees; ``labelled`` has id, label, size, signature, and ``sets_of`` gives the sets of ids."""
    signatures = labelled.select("id", "signature")
    rows, found = _roots(labelled), []
    for level in range(LEVELS):
        # Random signs of labels cancel out unless one label has much of the sum (a sketch of the second moment).
        signs = [F.sum(F.when(F.col("label") != F.col("id"), F.pmod(F.shiftright(F.xxhash64("label"), j), F.lit(2)) * 2 - 1).otherwise(0)).alias(f"sign_{j}") for j in range(SIGNS)]
        nodes = rows.groupBy("node").agg(*signs, F.count(F.lit(1)).alias("n"), F.sum("size").alias("total"), F.bit_xor(F.xxhash64("id")).alias("who"), F.min("label").alias("low"), F.max("label").alias("high"), F.max("parent").alias("above"))
        # A node that holds much of the node above it, or of which much has one label, will not fall apart by branching.
        one_label = F.array_max(F.array(*(F.abs(F.col(f"sign_{j}")) for j in range(SIGNS)))) >= ALIKE * F.col("n")
        branch = F.lit(level < LEVELS - 1) & (F.col("n") > SMALL_NODE) & ~one_label & (F.lit(level == 0) | (F.col("n") < ALIKE * F.col("above")))
        nodes = nodes.filter("low <> high").select("node", "n", "total", "low", F.xxhash64("n", "total", "who").alias("key"), branch.alias("branch"))
        live, seen = scratch.counted(rows.drop("parent").join(nodes, "node"), deeper=F.count_if("branch"))
        found.append(live)
        if not seen["deeper"]:
            break
        rows = _children(live.filter("branch").select("node", "id", "label", "size", "n").join(signatures, "id"))
    # Nodes of different paths that hold the same sets have one key, and are compared once.
    members = reduce(DataFrame.unionByName, [t.filter("NOT branch").select("key", "n", "low", "id", "label", "size") for t in found]).distinct()
    pairs = scratch.cut(_small_nodes(members.filter(F.col("n") <= SMALL_NODE).select("key", "id", "label"), signatures))
    blocks, seen = scratch.counted(_blocks(members.filter(F.col("n") > SMALL_NODE)), n=F.count(F.lit(1)))
    scratch.drop(*found)
    sets = scratch.cut(sets_of(pairs.select(F.explode(F.array("a", "b")).alias("id")).unionByName(blocks.select("id"))))
    links = confirm(pairs, sets, percent)
    links = scratch.cut(links.unionByName(_large_nodes(blocks, sets, percent)) if seen["n"] else links)
    scratch.drop(pairs, blocks, sets)
    return links


def near_duplicates(docs: DataFrame, *, shingle: int = SHINGLE, percent: int = THRESHOLD_PERCENT) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id, kept.

    Words are runs of anything but ASCII white space, A-Z lower-cased. A document without words is linked with nothing.
    Rows that repeat a ``doc_id`` are one document of the graph, which has the links of all their texts, and keep their
    rows; a null ``doc_id`` is linked with nothing and kept. An empty table gives none. Other columns are ignored.
    """
    scratch = Scratch(docs.sparkSession)
    made = scratch.cut(features(docs, shingle=shingle))
    linked = made.filter("doc_id IS NOT NULL AND id IS NOT NULL")
    classes = scratch.cut(linked.groupBy("id").agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("size"), F.first("signature").alias("signature")))
    reps = classes.select("id", "rep")

    def sets_of(ids: DataFrame) -> DataFrame:
        wanted = scratch.cut(ids.distinct().join(reps, "id").select("id", F.col("rep").alias("doc_id")))
        return _sets(docs, wanted, shingle)

    proposed = _stars(classes, scratch)
    sets = scratch.cut(sets_of(proposed.select(F.explode(F.array("a", "b")).alias("id"))))
    stars = scratch.cut(confirm(proposed, sets, percent))
    scratch.drop(proposed, sets)
    label = components(stars.select(F.col("a").alias("u"), F.col("b").alias("v")), scratch).withColumnsRenamed({"node": "id", "component": "label"})
    labelled = scratch.cut(classes.join(label, "id", "left").select("id", F.coalesce("label", "id").alias("label"), "size", "signature"))
    links = _links(labelled, sets_of, scratch, percent)
    scratch.drop(labelled)
    ends = [reps.select(F.col("id").alias(x), F.col("rep").alias(y)) for x, y in ("au", "bv")]
    edges = stars.unionByName(links).join(ends[0], "a").join(ends[1], "b").select("u", "v")
    # A doc_id with several texts joins the groups of all of them.
    several = linked.groupBy("doc_id").agg(F.min("id").alias("low"), F.max("id").alias("high")).filter("low <> high").select("doc_id")
    own = linked.select("doc_id", "id").join(several, "doc_id").join(reps, "id").select(F.col("doc_id").alias("u"), F.col("rep").alias("v"))
    found = components(edges.unionByName(own), scratch)
    groups = reps.join(found, F.col("rep") == F.col("node"), "left").select("id", F.coalesce("component", "rep").alias("group"))
    joined = made.select("doc_id", "n_shingles", "id").join(groups, "id", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("group", "doc_id"))
    return joined.select("doc_id", "n_shingles", component.alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def drop_near_duplicates(docs: DataFrame, **parameters) -> DataFrame:
    """``docs`` with one document of each component: the one of least ``doc_id``, with all its rows.

    Documents without words and rows with a null ``doc_id`` stay; an empty table gives none. Columns of any name stay as
    they are: the rows that go are found by ``doc_id`` alone.
    """
    gone = near_duplicates(docs, **parameters).filter(~F.col("kept")).select(F.col("doc_id").alias("gone_id")).distinct()
    return docs.join(gone, docs["doc_id"] == gone["gone_id"], "left_anti")
