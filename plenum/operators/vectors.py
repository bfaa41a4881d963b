"""Vectors (V1-V11): similarity, pair search, top-k, embedding slots, centroids, clusters and their evolution."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

#: Rows of a block of a pair search, of a strip of it, and blocks that a task of a meeting holds on one side; components that rows are counted by.
PAIR_BLOCK, PAIR_STRIP, PAIR_HELD, PAIR_WIDTH = 4096, 256, 32, 64
#: Rows and queries that meet in one task of a search.
ROW_BLOCK, QUERY_BLOCK = 8192, 4096
#: Rows up to which a centroid table is sent to every task; a larger one is dealt in blocks.
SMALL = 4096


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def cosine(a: Column, b: Column, norm_a: Column | None = None, norm_b: Column | None = None) -> Column:
    """V1: 0 when a norm is 0. Norms that are computed once per row can be passed."""
    n = (norm(a) if norm_a is None else norm_a) * (norm(b) if norm_b is None else norm_b)
    return F.when(n == 0, 0.0).otherwise(dot(a, b) / n)


def _matrix(lists: pa.ChunkedArray, width: int) -> np.ndarray:
    """Vectors of one width as rows; null components are NaN."""
    return np.concatenate([np.asarray(c.flatten().fill_null(np.nan), np.float64) for c in lists.chunks]).reshape(len(lists), width)


def _over(left: tuple[np.ndarray, pa.Array], right: tuple[np.ndarray, pa.Array], threshold: float, same: bool) -> Iterator[pa.RecordBatch]:
    """(a, b, similarity) over the threshold of two blocks, or of one with itself, in strips, so that only pairs of one strip are held."""
    (v, own), (w, other) = left, right
    for s in range(0, len(v), PAIR_STRIP):
        strip = v[s : s + PAIR_STRIP] @ w.T
        i, j = np.nonzero(strip > threshold)
        if same:
            i, j = i[i + s < j], j[i + s < j]
        if len(i):
            a, b = own.take(pa.array(i + s)), other.take(pa.array(j))
            turned = pc.greater(a, b)
            yield pa.RecordBatch.from_arrays([pc.if_else(turned, b, a), pc.if_else(turned, a, b), pa.array(strip[i, j])], names=["a", "b", "similarity"])


def _blocks(rows: DataFrame, on: Sequence[str], units: Callable[[pa.Table, np.ndarray], tuple[np.ndarray, list[int]]]) -> DataFrame:
    """Rows (``on``, width, id, v), equal in ``on`` and width, as few rows of about ``PAIR_BLOCK`` ids and one matrix, which is all that meets.

    (``on``, width, block, blocks, ids, v, visits): ``units`` gives the unit vectors of a block and what cells it visits.
    """
    kinds = dict(rows.dtypes)
    weight = F.sum(F.greatest("width", F.lit(PAIR_WIDTH)).cast("long"))
    counts = rows.groupBy(*on, "width").agg(F.ceil(weight / (PAIR_BLOCK * PAIR_WIDTH)).cast("int").alias("blocks"))
    dealt = rows.join(counts, [*on, "width"]).withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    keys = [*on, "width", "block", "blocks"]

    def pack(held: pa.Table) -> pa.Table:
        ids = held.column("id").combine_chunks()
        ids = ids.combine_chunks() if isinstance(ids, pa.ChunkedArray) else ids
        v, visits = units(held, _matrix(held.column("v"), held.column("width")[0].as_py()))
        listed = pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids)
        return held.select(keys).slice(0, 1).append_column("ids", listed).append_column("v", pa.array([v.tobytes()], pa.binary())).append_column("visits", pa.array([visits], pa.list_(pa.int32())))

    told = ", ".join(f"{k} {kinds[k]}" for k in (*on, "width"))
    return dealt.groupBy(*keys).applyInArrow(pack, f"{told}, block int, blocks int, ids array<{kinds['id']}>, v binary, visits array<int>")


def _sides(packed: DataFrame, extra: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """A table of blocks as the two sides of a meeting; both read one shuffle."""
    return tuple(packed.select(*(F.col(c).alias(f"{side}_{c}") for c in (*extra, "width", "block", "ids", "v"))) for side in "xy")


def _compared(met: DataFrame, kind: str, threshold: float, toward: Callable[[np.ndarray, int, int], np.ndarray] | None = None) -> DataFrame:
    """(a, b, similarity) of blocks that met, pair by pair of blocks. ``toward`` leaves rows of a cell out that have no partner in another."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                width, same = (batch.column(c)[r].as_py() for c in ("x_width", "same"))
                sides = []
                for own, other in ("xy", "yx"):
                    ids = batch.column(f"{own}_ids")[r].values
                    v = np.frombuffer(batch.column(f"{own}_v")[r].as_buffer() or b"", np.float64).reshape(len(ids), width)
                    if toward is not None:
                        near = toward(v, *(batch.column(f"{c}_home")[r].as_py() for c in (own, other)))
                        v, ids = v[near], ids.filter(pa.array(near))
                    sides.append((v, ids))
                yield from _over(*sides, threshold, same)

    return met.mapInArrow(compare, f"a {kind}, b {kind}, similarity double").filter("a < b")


def similar_pairs(rows: DataFrame, *, id_column: str, group: str, vector: str = "embedding", threshold: float = 0.85) -> DataFrame:
    """V2: (a, b, similarity) of a < b in one group with cosine over the threshold. The group (a session) bounds the pairs.

    A group is dealt into blocks of about ``PAIR_BLOCK`` rows, by a count, each of which becomes one row. Blocks of one group
    meet by a join and are compared as matrices within the task, which gives only pairs over the threshold. A group is moved
    once for each ``PAIR_HELD`` blocks that it has, so a task holds no more of them. Rows without a group or vector, and
    vectors of another width, meet nothing.
    """
    kept = rows.select(F.col(id_column).alias("id"), F.col(group).alias("g"), F.col(vector).cast("array<double>").alias("v")).filter("id IS NOT NULL AND g IS NOT NULL AND v IS NOT NULL").withColumn("width", F.size("v"))

    def units(held: pa.Table, v: np.ndarray) -> tuple[np.ndarray, list[int]]:
        norms = np.sqrt((v * v).sum(axis=1))
        return v / np.where(norms == 0, 1, norms)[:, None], []

    packed = _blocks(kept, ["g"], units).withColumn("part", F.floor(F.col("block") / PAIR_HELD)).withColumn("parts", F.ceil(F.col("blocks") / PAIR_HELD))
    x, y = _sides(packed, ["g", "part", "parts"])
    x = x.withColumn("with", F.explode(F.sequence("x_part", F.col("x_parts") - 1)))
    y = y.withColumn("of", F.explode(F.sequence(F.lit(0), "y_part")))
    meet = [F.col("x_g") == F.col("y_g"), F.col("x_width") == F.col("y_width"), F.col("x_part") == F.col("of"), F.col("with") == F.col("y_part"), F.col("x_block") <= F.col("y_block")]
    met = x.join(y, meet).select("x_width", (F.col("x_block") == F.col("y_block")).alias("same"), "x_ids", "x_v", "y_ids", "y_v")
    return _compared(met, dict(kept.dtypes)["id"], threshold)


def similar_pairs_of_all(rows: DataFrame, *, id_column: str, vector: str = "embedding", threshold: float = 0.85, pivots: int = 64) -> DataFrame:
    """V2 without a group: (a, b, similarity) of all a < b with cosine over the threshold, exactly.

    Unit vectors go to the cell of the nearest of some rows taken as pivots. Two of a similarity over the threshold lie
    within a known distance, so a vector can only have partners beyond the plane between its own pivot and another if it
    is as near to that plane. Cells are dealt into blocks, each of which becomes one row, and every two blocks that can hold
    pairs are compared as matrices in tasks, which give only pairs. Blocks meet in a product of partitions of ``PAIR_HELD``
    blocks at most: they are written once, however many meet, and only read again; a task holds the blocks of one partition.
    Rows without an id, and vectors that are null, zero or hold components null or not finite, meet nothing.
    """
    kind = dict(rows.select(F.col(id_column).alias("id")).dtypes)["id"]
    finite = F.coalesce(F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < F.lit(float("inf")))), F.lit(False))
    whole = rows.filter(finite & F.col(id_column).isNotNull()).filter(norm(F.col(vector)) > 0).select(F.col(id_column).alias("id"), F.col(vector).cast("array<double>").alias("v"))
    to_unit = lambda v: v / np.sqrt((v * v).sum(axis=-1, keepdims=True))
    chosen = [to_unit(np.array(r.v)) for r in whole.orderBy(F.xxhash64("id"), "v").limit(pivots).select("v").collect()]
    far = float(np.sqrt(max(0.0, 2 - 2 * threshold))) + 1e-9

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = batch.column(1)
            widths, flat, offsets = np.asarray(pc.list_value_length(v)), np.array(v.values, np.float64), np.asarray(v.offsets)
            homes = np.full(len(v), -1, np.int32)
            for width in np.unique(widths):
                # Pivots of another width are of no use to a vector; without any, all of a width are one cell.
                same, own = np.flatnonzero([len(p) == width for p in chosen]), np.flatnonzero(widths == width)
                at = offsets[:-1][own][:, None] + np.arange(width)
                flat[at] = to_unit(flat[at])
                if len(same):
                    points = np.array([chosen[k] for k in same])
                    homes[own] = same[((points**2).sum(axis=1) - 2 * flat[at] @ points.T).argmin(axis=1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat)), pa.array(homes)], names=["id", "v", "home"])

    def toward(v: np.ndarray, own: int, other: int) -> np.ndarray:
        """Which vectors of a cell are near enough to the plane between its pivot and another."""
        if own == other:
            return np.ones(len(v), bool)
        p, q = chosen[own], chosen[other]
        return ((v - q) ** 2).sum(axis=1) - ((v - p) ** 2).sum(axis=1) <= 2 * far * np.sqrt(((p - q) ** 2).sum()) + 1e-12

    def units(held: pa.Table, v: np.ndarray) -> tuple[np.ndarray, list[int]]:
        own = held.column("home")[0].as_py()
        return v, [k for k, p in enumerate(chosen) if own >= 0 and len(p) == v.shape[1] and toward(v, own, k).any()]

    placed = whole.mapInArrow(place, f"id {kind}, v array<double>, home int").withColumn("width", F.size("v"))
    weight = rows.agg(F.sum(F.greatest(F.size(vector), F.lit(PAIR_WIDTH)).cast("long"))).first()[0] or 0
    # As many partitions as hold few blocks each, and as many as keep all cores busy; without a key, so that blocks are dealt evenly.
    busy = math.ceil(math.sqrt(4 * rows.sparkSession.sparkContext.defaultParallelism))
    parts = max(1, min(busy, math.ceil(weight / PAIR_WIDTH)), math.ceil(2 * weight / (PAIR_BLOCK * PAIR_WIDTH * PAIR_HELD)))
    x, y = _sides(_blocks(placed, ["home"], units).repartition(parts), ["home", "visits"])
    earlier = F.struct("x_home", "x_block") <= F.struct(F.col("y_home").alias("x_home"), F.col("y_block").alias("x_block"))
    can = (F.col("x_home") == F.col("y_home")) | (F.array_contains("x_visits", F.col("y_home")) & F.array_contains("y_visits", F.col("x_home")))
    met = x.join(y.hint("shuffle_replicate_nl"), (F.col("x_width") == F.col("y_width")) & earlier & can)
    same = (F.col("x_home") == F.col("y_home")) & (F.col("x_block") == F.col("y_block"))
    return _compared(met.select("x_width", same.alias("same"), "x_home", "x_ids", "x_v", "y_home", "y_ids", "y_v"), kind, threshold, toward)


class _Held:
    """The vectors of a block as rows of one matrix, with widths, norms as :func:`norm` gives them, and whether they are whole."""

    def __init__(self, lists: pa.ChunkedArray, width: int) -> None:
        lists = lists.combine_chunks()
        flat, offsets = lists.flatten(), np.concatenate([[0], np.cumsum(pc.fill_null(pc.list_value_length(lists), 0))]).astype(np.int64)
        self.widths = np.diff(offsets)
        holes = np.concatenate([[0], np.cumsum(np.asarray(flat.is_null(), bool))])
        self.whole = np.asarray(lists.is_valid(), bool) & (holes[offsets[1:]] == holes[offsets[:-1]])
        self.v = np.zeros((len(lists), width))
        of = np.repeat(np.arange(len(lists)), self.widths)
        self.v[of, np.arange(len(of)) - offsets[of]] = np.asarray(pc.fill_null(pc.cast(flat, pa.float64()), 0.0))
        with np.errstate(over="ignore", invalid="ignore"):
            self.norms = np.sqrt(_in_order(self.v * self.v))
        # Those that a product of unit vectors ranks but for rounding.
        self.plain = self.whole & (self.norms > 1e-100) & (self.norms < 1e100)


def _in_order(x: np.ndarray) -> np.ndarray:
    """Sums of rows from left to right, as ``aggregate`` adds them up."""
    return np.add.accumulate(x, axis=1)[:, -1] + 0.0 if x.shape[1] else np.zeros(len(x))


def _scored(r: _Held, q: _Held, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """:func:`cosine` of pairs of rows and queries, to the last bit, and where it is null."""
    with np.errstate(all="ignore"):
        n = r.norms[i] * q.norms[j]
        dots = np.concatenate([_in_order(r.v[i[s : s + 32768]] * q.v[j[s : s + 32768]]) for s in range(0, len(i), 32768)] or [np.zeros(0)])
        score = np.where(n == 0, 0.0, dots / n)
    return score, ~(r.whole[i] & q.whole[j] & ((r.widths[i] == q.widths[j]) | (n == 0)))


def _candidates(r: _Held, q: _Held, place: np.ndarray, queries: np.ndarray, k: int, least: float | None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows and queries among which the k best of each query are: by products of unit vectors, with a margin for rounding."""
    odd = queries[~q.plain[queries]]
    for j in odd:
        yield np.arange(len(place)), np.full(len(place), j)
    for width in np.unique(q.widths[queries[q.plain[queries]]]):
        own = queries[q.plain[queries] & (q.widths[queries] == width)]
        fits = r.whole & (r.widths == width)
        near = np.flatnonzero(fits & r.plain)
        few = lambda mask: (lambda x: x[np.argsort(place[x])[:k]])(np.flatnonzero(mask))
        # All rows with a norm of 0 have one score, so have all that can have none; the first k of each will do.
        zero = r.whole & (r.norms == 0)
        others = np.concatenate([few(zero), few(~fits & ~zero & (~r.whole | (r.norms > 1e-100))), np.flatnonzero(~r.plain & fits & ~zero), np.flatnonzero(~fits & r.whole & ~zero & ~(r.norms > 1e-100))])
        yield np.tile(others, len(own)), np.repeat(own, len(others))
        if len(near):
            found = (q.v[own] / q.norms[own][:, None]) @ (r.v[near] / r.norms[near][:, None]).T
            bound = np.partition(found, len(near) - k, axis=1)[:, len(near) - k] if len(near) > k else np.full(len(own), -2.0)
            if least is not None:
                bound = np.maximum(bound, least)
            j, i = np.nonzero(found >= bound[:, None] - 1e-9)
            yield near[i], own[j]


def top_k(queries: DataFrame, rows: DataFrame, k: int = 5, *, query_id: str = "query_id", id_column: str = "vec_id", vector: str = "embedding", on: Sequence[str] = (), least: float | None = None, rank_by: str = "similarity") -> DataFrame:
    """The k rows most similar to each query, among rows equal in the ``on`` columns (filtered before scoring), ties to the smaller id.

    Many questions are one job. Rows and queries equal in ``on`` are dealt into blocks by their counts, and every block of
    rows meets every block of queries under a key of its own. A task finds the k best of two blocks: products of unit
    vectors leave out what lies below the k-th by more than rounding, the rest is scored as :func:`cosine` does, and only
    k rows a query and block go on. Each pair of vectors costs a product, all else grows with rows, and a task holds two blocks.
    """
    kept = [c for c in rows.columns if c != vector]
    known = lambda df: df.filter(F.lit(True) if not on else F.forall(F.array(*(F.col(c).isNotNull() for c in on)), lambda x: x))
    r, q = known(rows), known(queries).select(F.col(query_id).alias("_query"), *(F.col(c).alias(c) for c in on), F.col(vector).alias("_v"))
    counted = lambda df, block, name: df.groupBy(*on).agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias(name))
    sizes = (counted(r, ROW_BLOCK, "_rows"), counted(q, QUERY_BLOCK, "_queries"))
    blocks = (sizes[0].join(sizes[1], list(on)) if on else F.broadcast(sizes[0].join(F.broadcast(sizes[1])))).filter("_rows > 0 AND _queries > 0")
    deal = lambda df, own, by, n, other, m: df.join(blocks, list(on) or None).withColumn(own, F.pmod(F.xxhash64(by), F.col(n)).cast("int")).withColumn(other, F.explode(F.sequence(F.lit(0), F.col(m) - 1))).drop("_rows", "_queries")
    keys = (*on, "_x", "_y")
    dealt = deal(r, "_x", id_column, "_rows", "_y", "_queries").groupBy(*keys), deal(q, "_y", "_query", "_queries", "_x", "_rows").groupBy(*keys)

    def nearest(block: pa.Table, asked: pa.Table) -> pa.Table:
        width = max((pc.max(pc.list_value_length(t.column(c))).as_py() or 0 for t, c in ((block, vector), (asked, "_v"))), default=0)
        held, wanted = _Held(block.column(vector), width), _Held(asked.column("_v"), width)
        place = np.empty(block.num_rows, np.int64)
        place[np.asarray(pc.array_sort_indices(block.column(id_column).combine_chunks()))] = np.arange(block.num_rows)
        nulls = np.asarray(block.column(id_column).is_null(), bool)
        place[nulls] -= block.num_rows
        best: list[tuple[np.ndarray, ...]] = []
        for s in range(0, asked.num_rows, 256):
            of = np.arange(s, min(s + 256, asked.num_rows))
            if not block.num_rows:
                break
            parts = [(i, j, *_scored(held, wanted, i, j)) for i, j in _candidates(held, wanted, place, of, k, least)]
            i, j, score, none = (np.concatenate(c) for c in zip(*parts, strict=True))
            order = np.lexsort((place[i], np.where(none, 0.0, -np.where(np.isnan(score), np.inf, score)), none, j))
            first = np.searchsorted(j[order], j[order])
            order = order[np.arange(len(order)) - first < k]
            best.append((i[order], j[order], score[order], none[order]))
        i, j, score, none = (np.concatenate(c) for c in zip(*best, strict=True)) if best else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0), np.zeros(0, bool))
        return block.select(kept).take(pa.array(i)).append_column(query_id, asked.column("_query").take(pa.array(j))).append_column("score", pa.array(score, mask=none, from_pandas=False))

    fields = StructType([*(rows.schema[c] for c in kept), StructField(query_id, queries.schema[query_id].dataType), StructField("score", DoubleType())])
    scored = dealt[0].cogroup(dealt[1]).applyInArrow(nearest, fields)
    if least is not None:
        scored = scored.filter(F.col("score") >= least)
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy(query_id).orderBy(F.desc("score"), id_column))).filter(F.col("rank") <= k)


def citations(hits: DataFrame, *, text: str = "text", most: int = 200) -> DataFrame:
    """V6: hits with their excerpt."""
    from plenum.functions.text import cut_quote

    return hits.withColumn("excerpt", cut_quote(F.col(text), most))


def hashing_embedder(width: int = 64) -> Callable[[list[str]], list[list[float]]]:
    """A model-free embedder for tests: signed hashed words, unit length."""
    import math
    import zlib

    def embed(texts: list[str]) -> list[list[float]]:
        out = []
        for text in texts:
            v = [0.0] * width
            for word in (text or "").lower().split():
                h = zlib.crc32(word.encode())
                v[h % width] += 1.0 if h >> 31 else -1.0
            size = math.sqrt(sum(x * x for x in v)) or 1.0
            out.append([x / size for x in v])
        return out

    return embed


def embed(rows: DataFrame, function: Callable[[list[str]], list[list[float]]], *, id_column: str, text: str = "text", width: int, batch: int = 100, fallback: Callable[[list[str]], list[list[float]]] | None = None) -> DataFrame:
    """(id, embedding) by a user's function over batches of at most ``batch`` texts.

    A vector of another width is an error. A batch that fails, or a null vector, goes to the fallback function if there is
    one. Store the result before it is used twice: a re-run would call the model again.
    """
    import pandas as pd

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for i in range(0, len(frame), batch):
                part = frame.iloc[i : i + batch]
                texts = [x if isinstance(x, str) else "" for x in part["text"]]
                try:
                    found = list(function(texts))
                except Exception:
                    if fallback is None:
                        raise
                    found = [None] * len(texts)
                missing = [k for k, v in enumerate(found) if v is None]
                if missing and fallback is not None:
                    for k, v in zip(missing, fallback([texts[k] for k in missing]), strict=True):
                        found[k] = v
                if any(v is not None and len(v) != width for v in found) or len(found) != len(texts):
                    raise ValueError(f"the embedding function must give one vector of width {width} for each text")
                yield pd.DataFrame({"id": part["id"].to_numpy(), "embedding": found})

    kind = dict(rows.dtypes)[id_column]
    return rows.select(F.col(id_column).alias("id"), F.col(text).alias("text")).mapInPandas(run, f"id {kind}, embedding array<float>").withColumnRenamed("id", id_column)


def respond(prompts: DataFrame, function: Callable[[list[str]], list[str]], *, id_column: str, prompt: str = "prompt", batch: int = 20) -> DataFrame:
    """(id, response) by a user's function over batches of prompts; store the result before it is used twice."""
    import pandas as pd

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for i in range(0, len(frame), batch):
                part = frame.iloc[i : i + batch]
                yield pd.DataFrame({"id": part["id"].to_numpy(), "response": list(function(part["prompt"].tolist()))})

    kind = dict(prompts.dtypes)[id_column]
    return prompts.select(F.col(id_column).alias("id"), F.col(prompt).alias("prompt")).mapInPandas(run, f"id {kind}, response string").withColumnRenamed("id", id_column)


def centroids(rows: DataFrame, *, group: str, vector: str = "embedding") -> DataFrame:
    """V8: the mean vector and size of each group; sums are pre-aggregated by (group, place)."""
    sizes = rows.groupBy(group).agg(F.count(F.lit(1)).alias("size"))
    means = rows.select(group, F.posexplode(vector).alias("_d", "_x")).groupBy(group, "_d").agg(F.avg(F.col("_x").cast("double")).alias("_m"))
    return means.groupBy(group).agg(F.transform(F.array_sort(F.collect_list(F.struct("_d", "_m"))), lambda x: x["_m"]).alias("centroid")).join(sizes, group)


def project(rows: DataFrame, *, id_column: str, vector: str = "embedding", dimensions: int = 2) -> DataFrame:
    """V8: principal components of the vectors: (id, projection)."""
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector, vector_to_array

    n = rows.select(id_column, array_to_vector(F.col(vector).cast("array<double>")).alias("_v"))
    return PCA(k=dimensions, inputCol="_v", outputCol="_p").fit(n).transform(n).select(id_column, vector_to_array("_p").alias("projection"))


def cluster(rows: DataFrame, k: int, *, id_column: str, vector: str = "embedding", seed: int = 5) -> tuple[DataFrame, DataFrame]:
    """V9: k-means: (id, cluster_id) and (cluster_id, centroid)."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    n = rows.select(id_column, array_to_vector(F.col(vector).cast("array<double>")).alias("features"))
    model = KMeans(k=k, seed=seed, predictionCol="cluster_id").fit(n)
    centers = rows.sparkSession.createDataFrame([(i, [float(x) for x in c]) for i, c in enumerate(model.clusterCenters())], "cluster_id int, centroid array<double>")
    return model.transform(n).select(id_column, "cluster_id"), centers


def nearest_centroid(rows: DataFrame, centers: DataFrame, *, id_column: str, cluster_id: str = "cluster_id", vector: str = "embedding") -> DataFrame:
    """V9: each row with its most similar centroid: (id, cluster_id, score). It is V3 with k = 1, rows as the queries."""
    packed = centers.agg(F.collect_list(F.struct(cluster_id, "centroid", norm(F.col("centroid")).alias("n"))).alias("_all"))
    n = rows.select(id_column, F.col(vector).alias("_v"), norm(F.col(vector)).alias("_n"))
    best = F.array_max(F.transform("_all", lambda c: F.struct(cosine(F.col("_v"), c["centroid"], F.col("_n"), c["n"]).alias("score"), (-c[cluster_id]).alias("i"))))
    if centers.limit(SMALL + 1).count() > SMALL:
        return top_k(n.select(F.col(id_column).alias("query_id"), F.col("_v").alias("embedding")), centers.select(cluster_id, F.col("centroid").alias("embedding")), 1, id_column=cluster_id).select(F.col("query_id").alias(id_column), cluster_id, "score")
    return n.join(F.broadcast(packed)).select(id_column, best.alias("b")).select(id_column, (-F.col("b.i")).alias(cluster_id), F.col("b.score").alias("score"))


def evolution(before: DataFrame, after: DataFrame, *, threshold: float = 0.7) -> DataFrame:
    """(kind, old_id, new_id, similarity): consistent, new, removed, merged and split clusters of two snapshots (cluster_id, centroid).

    An old cluster is consistent with its most similar new one if that is over the threshold; a new one that no old one
    maps to is new; an old one without such is removed; a new one that several old ones map to is merged; an old one is
    split if it is the most similar one of several new ones.
    """
    old, new = before.select(F.col("cluster_id").alias("old_id"), F.col("centroid").alias("a")), after.select(F.col("cluster_id").alias("new_id"), F.col("centroid").alias("b"))
    maps = top_k(old.select(F.col("old_id").alias("query_id"), F.col("a").alias("embedding")), new.select("new_id", F.col("b").alias("embedding")), 1, id_column="new_id").filter(F.col("score") > threshold).select(F.col("query_id").alias("old_id"), "new_id", F.col("score").alias("similarity"))
    back = top_k(new.select(F.col("new_id").alias("query_id"), F.col("b").alias("embedding")), old.select("old_id", F.col("a").alias("embedding")), 1, id_column="old_id").filter(F.col("score") > threshold).select(F.col("query_id").alias("new_id"), "old_id", F.col("score").alias("similarity"))
    none_id, none = F.lit(None).cast("long"), F.lit(None).cast("double")
    row = lambda df, kind, a, b, s: df.select(F.lit(kind).alias("kind"), a.cast("long").alias("old_id"), b.cast("long").alias("new_id"), s.alias("similarity"))
    parts = [
        row(maps, "consistent", F.col("old_id"), F.col("new_id"), F.col("similarity")),
        row(new.join(maps, "new_id", "left_anti"), "new", none_id, F.col("new_id"), none),
        row(old.join(maps, "old_id", "left_anti"), "removed", F.col("old_id"), none_id, none),
        row(maps.groupBy("new_id").count().filter("count > 1"), "merged", none_id, F.col("new_id"), none),
        row(back.groupBy("old_id").count().filter("count > 1"), "split", F.col("old_id"), none_id, none),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def sample_of_clusters(rows: DataFrame, centers: DataFrame, n: int = 10, *, id_column: str, cluster_id: str = "cluster_id", vector: str = "embedding") -> DataFrame:
    """The n members nearest to each centroid: (cluster_id, id, rank, score). ``rows`` has the cluster of each row."""
    joined = rows.join(centers.select(cluster_id, "centroid"), cluster_id).withColumn("score", cosine(F.col(vector), F.col("centroid")))
    w = Window.partitionBy(cluster_id).orderBy(F.desc("score"), id_column)
    return joined.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n).select(cluster_id, id_column, "rank", "score")
