"""Operator 3: approximate nearest neighbours by one hierarchical navigable small-world graph per shard.

Rows are dealt by hash of their id into shards of about ``SHARD`` vectors of one width. A shard's graph is built in one
task, by insertion (Malkov and Yashunin): levels are drawn geometrically from a hash of the id; batches of nodes search the
graph as it stands from the top level down; on each of its levels a node is linked to the diverse ones of what it found and
of its own batch, and these are linked back, each keeping its diverse ones up to a fixed degree. Equal vectors are one node
with all their ids, so that a vector of which there are thousands does not fill the links of others. In the end every node
that cannot be reached from the entry of its level gets a link from the nearest one that can. A graph is one row of flat
arrays: ids, vectors, and for every level node numbers and a neighbour matrix.

Queries come in blocks of bounded size; every block visits every graph of its width, which is loaded once for all of the
block, and the shards' results are merged. What is found is scored in double precision on the original vectors.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plenum.llm.bytetext import mix
from plenum.llm.tables import Scratch

SHARD = 8192
DEGREE = 24  # links of a node on upper levels; twice as many on the lowest
SPARE = 4  # places beside them for links that make nodes reachable
CANDIDATES = 64
BATCH = 1024
BEAM = 160
QUERY_BLOCK = 4096
STEP = 256

_GRAPH = "width int, shard int, ids binary, ends binary, vectors binary, level_sizes array<int>, nodes binary, links binary"


def usable(vectors: DataFrame, *, id_column: str = "vec_id", column: str = "embedding") -> DataFrame:
    """(id, vector, width) of the rows that take part: not null, no null or non-finite component, not zero."""
    kind = vectors.schema[column].dataType
    single = isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.FloatType)
    v = F.col(column).cast("array<float>" if single else "array<double>")
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(math.inf)))
    rows = vectors.select(F.col(id_column).cast("long").alias("id"), v.alias("vector")).filter("id IS NOT NULL AND vector IS NOT NULL")
    return rows.filter(finite & F.exists("vector", lambda x: x != 0)).withColumn("width", F.size("vector"))


class Graph:
    """Vectors and, for every level from the lowest, the place of each node in it and the matrix of its links, padded with -1."""

    def __init__(self, vectors: np.ndarray, members: list[np.ndarray], links: list[np.ndarray] | None = None) -> None:
        self.vectors, self.members, self.entry = vectors, members, int(members[-1][0])
        self.links = links or [np.full((len(m), (DEGREE if level else 2 * DEGREE) + SPARE), -1, np.int32) for level, m in enumerate(members)]
        self.row_of = []
        for m in members:
            self.row_of.append(np.full(len(vectors), -1, np.int32))
            self.row_of[-1][m] = np.arange(len(m))

    def search(self, queries: np.ndarray, beam: int) -> np.ndarray:
        """Nodes of each query's beam, nearest first, padded with -1."""
        found = np.full((len(queries), 1), self.entry, np.int64)
        for level in range(len(self.links) - 1, -1, -1):
            found = self.descend(queries, found, level, beam if level == 0 else 8)
        return found

    def away(self, queries: np.ndarray, nodes: np.ndarray) -> np.ndarray:
        between = self.vectors[nodes] - queries[:, None]
        return np.where(nodes < 0, np.inf, np.einsum("qnd,qnd->qn", between, between))

    def descend(self, queries: np.ndarray, start: np.ndarray, level: int, beam: int) -> np.ndarray:
        row_of, links = self.row_of[level], self.links[level]
        q, every = len(queries), np.arange(len(queries))[:, None]
        seen = np.zeros((q, len(self.vectors) + 1), bool)
        nodes = np.full((q, beam), -1, np.int64)
        nodes[:, : start.shape[1]] = start[:, :beam]
        seen[every, nodes] = True
        seen[:, -1] = True
        away, open_ = self.away(queries, nodes), nodes >= 0
        while True:
            rank = np.where(open_, away, np.inf)
            step = np.argpartition(rank, 3, axis=1)[:, :4] if beam > 4 else np.argsort(rank, axis=1)[:, :1]
            picked = np.take_along_axis(nodes, step, 1)
            picked[~np.take_along_axis(open_, step, 1)] = -1
            np.put_along_axis(open_, step, False, 1)
            if not (picked >= 0).any():
                break
            near = links[np.maximum(row_of[picked], 0)].reshape(q, -1).astype(np.int64)
            near[np.repeat(picked < 0, links.shape[1], axis=1)] = -1
            near[seen[every, near]] = -1
            near.sort(axis=1)
            near[:, 1:][near[:, 1:] == near[:, :-1]] = -1
            near = near[:, (near >= 0).any(axis=0)]
            if not near.shape[1]:
                continue
            seen[every, near] = True
            seen[:, -1] = True
            both, far = np.concatenate([nodes, near], axis=1), np.concatenate([away, self.away(queries, near)], axis=1)
            fresh = np.concatenate([open_, near >= 0], axis=1)
            best = np.argpartition(far, beam - 1, axis=1)[:, :beam]
            nodes, away, open_ = (np.take_along_axis(x, best, 1) for x in (both, far, fresh))
        order = np.argsort(away, axis=1)
        return np.take_along_axis(nodes, order, 1)

    def _diverse(self, own: np.ndarray, candidates: np.ndarray, degree: int) -> np.ndarray:
        """Of each node's candidates (-1: none) those nearer to it than to any kept one, up to ``degree``; places left go to the nearest others."""
        out = np.full((len(own), degree), -1, np.int32)
        for a in range(0, len(own), STEP):
            near = np.sort(candidates[a : a + STEP], axis=1)
            near[:, 1:][near[:, 1:] == near[:, :-1]] = -1
            away = self.away(self.vectors[own[a : a + STEP]], near)
            order = np.argsort(away, axis=1, kind="stable")[:, :CANDIDATES]
            near, away = np.take_along_axis(near, order, 1), np.take_along_axis(away, order, 1)
            others = self.vectors[near] - self.vectors[own[a : a + STEP]][:, None]
            norms = np.einsum("qnd,qnd->qn", others, others)
            between = norms[:, :, None] + norms[:, None, :] - 2 * others @ others.transpose(0, 2, 1)
            keep, room = np.zeros(away.shape, bool), max(1, degree * 3 // 4)
            closest = np.full(away.shape, np.inf)
            for c in range(away.shape[1]):
                keep[:, c] = (near[:, c] >= 0) & (away[:, c] < closest[:, c]) & (keep.sum(axis=1) < room)
                closest = np.where(keep[:, c : c + 1], np.minimum(closest, between[:, c]), closest)
            fill = ~keep & (near >= 0)
            keep |= fill & (np.cumsum(fill, axis=1) <= (degree - keep.sum(axis=1))[:, None])
            rows, places = np.nonzero(keep)
            out[a + rows, np.arange(len(rows)) - np.searchsorted(rows, rows)] = near[rows, places]
        return out

    def link(self, level: int, nodes: np.ndarray, found: np.ndarray) -> None:
        """Links nodes to what they found and to each other, and back."""
        row_of, links = self.row_of[level], self.links[level]
        degree = links.shape[1] - SPARE
        peers = np.where(np.eye(len(nodes), dtype=bool), -1, nodes[None, :])
        own = self._diverse(nodes, np.concatenate([found, peers], axis=1), degree)
        links[row_of[nodes], :degree] = own
        at, place = np.nonzero(own >= 0)
        target, source = own[at, place].astype(np.int64), nodes[at]
        away = ((self.vectors[target] - self.vectors[source]) ** 2).sum(axis=1)
        order = np.lexsort((away, target))
        target, source = target[order], source[order]
        rank = np.arange(len(target)) - np.searchsorted(target, target)
        good = rank < CANDIDATES  # no more of them can stay
        target, source, rank = target[good], source[good], rank[good]
        names, where = np.unique(target, return_inverse=True)
        if len(names):
            new = np.full((len(names), int(rank.max()) + 1), -1, np.int64)
            new[where, rank] = source
            links[row_of[names], :degree] = self._diverse(names, np.concatenate([links[row_of[names], :degree].astype(np.int64), new], axis=1), degree)

    def connect(self, level: int) -> None:
        """Links what cannot be reached from the level's entry to the nearest node that can."""
        row_of, links, members = self.row_of[level], self.links[level], self.members[level]
        degree = links.shape[1] - SPARE
        reached = np.zeros(len(self.vectors), bool)
        best, via = np.full(len(self.vectors), np.inf), np.full(len(self.vectors), -1, np.int64)
        front = np.array([self.entry])
        while True:
            new = []
            while len(front):
                reached[front] = True
                new.append(front)
                front = np.unique(links[row_of[front]])
                front = front[front >= 0]
                front = front[~reached[front]]
            left = members[~reached[members]]
            if not len(left):
                return
            room = np.concatenate(new)
            for a in range(0, len(left), 512):
                some = left[a : a + 512]
                for b in range(0, len(room), 2048):
                    there = room[b : b + 2048]
                    d = ((self.vectors[some] ** 2).sum(axis=1)[:, None] + (self.vectors[there] ** 2).sum(axis=1) - 2 * self.vectors[some] @ self.vectors[there].T)
                    least = d.argmin(axis=1)
                    d = d[np.arange(len(some)), least]
                    less = d < best[some]
                    best[some[less]], via[some[less]] = d[less], there[least[less]]
            # Nearest first; a node whose spare places are taken passes the link on to the last one that it was given to.
            u = int(left[best[left].argmin()])
            r = int(via[u])
            while links[row_of[r], -1] >= 0:
                r = int(links[row_of[r], -1])
            free = degree + int(np.argmax(links[row_of[r], degree:] < 0))
            links[row_of[r], free] = u
            front = np.array([u])


def build(vectors: np.ndarray, keys: np.ndarray) -> Graph:
    """The graph of distinct vectors; ``keys`` are hashes that give levels and order."""
    draw = (mix(keys) >> np.uint64(11)).astype(float) / (1 << 53)
    top = np.floor(-np.log(draw + 1e-18) / math.log(DEGREE)).astype(int)
    order = np.argsort(mix(keys ^ np.uint64(0x33)), kind="stable")
    entry = int(order[top[order].argmax()])
    order = np.concatenate([[entry], order[order != entry]])
    members = [(lambda m: np.concatenate([[entry], m[m != entry]]))(np.flatnonzero(top >= level)).astype(np.int32) for level in range(int(top.max()) + 1)]
    graph, at = Graph(vectors, members), 0
    while at < len(order):
        batch = order[at : at + min(BATCH, max(STEP, at))]
        found = np.full((len(batch), 1), entry if at else -1, np.int64)
        for level in range(len(members) - 1, -1, -1):
            here = top[batch] >= level
            if at:
                found = np.concatenate([graph.descend(vectors[batch[i : i + STEP]], found[i : i + STEP], level, CANDIDATES if here.any() else 8) for i in range(0, len(batch), STEP)])
            if here.any():
                graph.link(level, batch[here], found[here])
        at += len(batch)
    for level in range(len(members)):
        graph.connect(level)
    return graph


def build_index(vectors: DataFrame, *, id_column: str = "vec_id", column: str = "embedding", shard: int = SHARD) -> DataFrame:
    """One row per shard: the graph as flat arrays. Every usable row is indexed; repeated ids are rows of their own."""
    rows = usable(vectors, id_column=id_column, column=column)
    kind = np.float32 if rows.schema["vector"].dataType == T.ArrayType(T.FloatType()) else np.float64
    counts = {r["width"]: -(-r["count"] // shard) for r in rows.groupBy("width").count().collect()}
    if not counts:
        return rows.sparkSession.createDataFrame([], _GRAPH)
    shards = F.create_map(*(F.lit(v) for pair in counts.items() for v in pair))
    dealt = rows.withColumn("shard", F.pmod(F.xxhash64("id"), F.element_at(shards, F.col("width"))).cast("int"))

    def run(group: pa.Table) -> pa.Table:
        ids = np.asarray(group["id"].combine_chunks(), np.int64)
        width = group["width"][0].as_py()
        values = np.concatenate([np.asarray(c.flatten(), kind) for c in group["vector"].chunks]).reshape(-1, width) + kind(0)  # -0 is 0
        _, first, node = np.unique(values.view(np.dtype((np.void, width * values.itemsize))).ravel(), return_index=True, return_inverse=True)
        order = np.lexsort((ids, node))
        ids, ends = ids[order], np.cumsum(np.bincount(node))
        own = ids[np.concatenate([[0], ends[:-1]])]  # a node's least id
        graph = build(values[first], own.view(np.uint64))
        sizes = [len(m) for m in graph.members]
        return pa.table({"width": pa.array([width], pa.int32()), "shard": pa.array([group["shard"][0].as_py()], pa.int32()), "ids": [ids.tobytes()], "ends": [ends.astype(np.int64).tobytes()], "vectors": [values[first].astype(np.float64).tobytes()], "level_sizes": pa.array([sizes], pa.list_(pa.int32())), "nodes": [np.concatenate(graph.members).tobytes()], "links": [np.concatenate([x.reshape(-1) for x in graph.links]).tobytes()]})

    return dealt.groupBy("width", "shard").applyInArrow(run, _GRAPH)


def _loaded(vectors: np.ndarray, sizes: list[int], nodes: bytes, links: bytes) -> Graph:
    flat, members, matrices, a, b = np.frombuffer(links, np.int32), np.frombuffer(nodes, np.int32), [], 0, 0
    held = np.split(members, np.cumsum(sizes)[:-1])
    for level, size in enumerate(sizes):
        degree = (DEGREE if level else 2 * DEGREE) + SPARE
        matrices.append(flat[b : b + size * degree].reshape(size, degree))
        b += size * degree
    return Graph(vectors, held, matrices)


def search(index: DataFrame, queries: DataFrame, k: int = 10, *, id_column: str = "vec_id", column: str = "embedding", beam: int = BEAM) -> DataFrame:
    """(query_id, rank from 1, vec_id, score): the k nearest found of each query, ties to the smaller id, its own row left out.

    Its own row is one with its id and its vector; another row of that id is found as any other. Of queries that repeat an
    id the least vector counts. Queries meet vectors of their own width only; fewer than k candidates give all that are
    found; an empty index or query table gives no row.
    """
    asked = usable(queries, id_column=id_column, column=column).select("id", F.col("vector").cast("array<double>").alias("vector")).groupBy("id").agg(F.min("vector").alias("vector")).withColumn("width", F.size("vector"))
    blocks = -(-asked.count() // QUERY_BLOCK) or 1
    packed = asked.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(blocks))).groupBy("width", "block").agg(F.collect_list(F.struct("id", "vector")).alias("asked"))
    shards = index.groupBy("width").agg(F.collect_list("shard").alias("shards"))  # numbers only: one per SHARD rows
    visits = packed.join(shards, "width").select("width", F.explode("shards").alias("shard"), "asked")
    met = visits.join(index, ["width", "shard"]).select("width", "ids", "ends", "vectors", "level_sizes", "nodes", "links", "asked")

    def answers(graph: Graph, exact: np.ndarray, ids: np.ndarray, ends: np.ndarray, names: np.ndarray, wanted: np.ndarray) -> list[np.ndarray]:
        found = graph.search(wanted.astype(graph.vectors.dtype), min(beam, max(k + 2, len(exact))))
        q, place = np.nonzero(found >= 0)
        node = found[q, place]
        away = ((exact[node] - wanted[q]) ** 2).sum(axis=1)
        begin = np.where(node > 0, ends[node - 1], 0)
        n = np.minimum(ends[node] - begin, k + 1)  # of equal vectors no more can be among the nearest
        at = np.repeat(begin - np.cumsum(n) + n, n) + np.arange(n.sum())
        q, away, who = np.repeat(q, n), np.repeat(away, n), ids[at]
        own = (who == names[q]) & (away == 0)
        own[own] = np.concatenate([[True], q[own][1:] != q[own][:-1]]) if own.any() else False  # one row is the query's own
        q, away, who = q[~own], away[~own], who[~own]
        order = np.lexsort((who, away, q))
        q, away, who = q[order], away[order], who[order]
        good = np.arange(len(q)) - np.searchsorted(q, q) < k
        return [names[q[good]], who[good], np.sqrt(away[good])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                width, ids, ends, vectors, sizes, nodes, links = (batch.column(c)[r].as_py() for c in range(7))
                exact, block = np.frombuffer(vectors, np.float64).reshape(-1, width), batch.column(7)[r].values
                graph = _loaded(exact.astype(np.float32) if (exact == exact.astype(np.float32)).all() else exact, sizes, nodes, links)
                names = np.asarray(block.field("id"), np.int64)
                wanted = np.asarray(block.field("vector").flatten(), np.float64).reshape(len(names), width)
                for i in range(0, len(names), STEP):
                    out = answers(graph, exact, np.frombuffer(ids, np.int64), np.frombuffer(ends, np.int64), names[i : i + STEP], wanted[i : i + STEP])
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in out], names=["query_id", "vec_id", "score"])

    found = met.mapInArrow(run, "query_id long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 10, **names) -> DataFrame:
    return search(Scratch(vectors.sparkSession).cut(build_index(vectors, **names)), queries, k, **names)
