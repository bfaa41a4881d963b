"""Operator 12: exact integer k-means whose comparisons are filtered by an n-simplex projection (Connor, Vadicamo and others).

1. Vectors of the wanted width become integers ``floor(scale * x)``. The centroids start as the vectors of least hash.
2. Pivots are chosen among the first centroids, each the farthest from the span of those before. A vector's distances to the pivots
   are taken once and kept as the apex of a simplex over the pivots: its coordinates over the base, and its height above
   it. Centroids get their apexes each round. Of two apexes, the distance with heights on one side is a lower bound of
   the Euclidean distance, that with heights on opposite sides an upper bound.
3. The centroid of the least lower bound is compared first. Those whose lower bound passes the least upper bound, or the
   distance found, are left out; the others are compared exactly, in integers. Bounds are doubles and get a margin, so
   that rounding never leaves out a nearest centroid.
4. A round is one pass: tasks return a row for each centroid with sums of its vectors in limbs of 30 bits, which Spark
   adds as longs, and the driver gets as many rows as centroids and limbs, whatever the number of vectors.

Integers that could pass 64 bits in a comparison take Python's whole numbers in the same task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plenum.llm.tables import Scratch

WIDTH = 64
SCALE = 256
CENTROIDS = 40
ROUNDS = 5
PIVOTS = 16
SEED = "2"
ROWS = 1 << 15
LIMB = 30
#: Whole numbers up to this size give squared distances of up to a thousand components within 62 bits.
FAST = 1 << 25
#: Part of the squared size of the numbers compared by which bounds may be off.
MARGIN = 1e-9


def kept_vectors(vectors: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", width: int = WIDTH) -> DataFrame:
    """(vec_id, embedding) of the vectors that have ``width`` components, none of them null or not finite."""
    rows = vectors.select(vectors[f"`{id_col}`"].cast("long").alias("vec_id"), vectors[f"`{vector_col}`"].cast("array<double>").alias("embedding"))
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return rows.filter((F.size("embedding") == width) & F.coalesce(finite, F.lit(False)))


def whole_numbers(values: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x) of a matrix: 64-bit where all are small enough for exact comparisons, else Python's numbers."""
    scaled = np.floor(values * float(scale))
    if not scaled.size or np.abs(scaled).max() <= FAST:
        return scaled.astype(np.int64)
    with np.errstate(over="ignore"):
        return np.array([[int(v) if np.isfinite(v) else scale * int(x) for v, x in zip(r, s, strict=True)] for r, s in zip(scaled, values, strict=True)], dtype=object).reshape(values.shape)


def first_centroids(kept: DataFrame, n: int, seed: str, scale: int) -> list[list[int]]:
    """The n vectors whose ``seed:vec_id`` has the least sha256; a null vec_id has none, and rows of one vec_id go by their components."""
    named = kept.filter("vec_id IS NOT NULL").withColumn("hash", F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256))
    rows = named.orderBy("hash", "embedding").limit(n).select("embedding").collect()
    return [[int(x) for x in r] for r in whole_numbers(np.array([r[0] for r in rows], np.float64).reshape(len(rows), -1), scale)] if rows else []


class Simplex:
    """A base of pivots: ``apex`` gives a point's coordinates over it, the height last."""

    def __init__(self, points: list[list[int]], n: int) -> None:
        rows = np.array([[float(x) for x in p] for p in points])
        chosen, axes = [0], []
        with np.errstate(all="ignore"):
            rest = rows - rows[0]
            least = 1e-6 * np.sqrt((rest**2).sum(axis=1)).max()
            while len(chosen) < n:
                # The next pivot is the highest above the base so far, so that the base never degenerates.
                heights = np.sqrt((rest**2).sum(axis=1))
                if not heights.max() > least:
                    break
                chosen.append(int(heights.argmax()))
                axes.append(rest[chosen[-1]] / heights.max())
                rest = rest - np.outer(rest @ axes[-1], axes[-1])
            self.pivots = rows[chosen]
            # The base in coordinates of its own, with the first pivot at 0: the rows of a lower triangular matrix.
            self.base = np.tril((self.pivots[1:] - rows[0]) @ np.array(axes).T) if axes else np.zeros((0, 0))
            self.lengths = (self.base**2).sum(axis=1)

    def apex(self, points: np.ndarray) -> np.ndarray:
        """Coordinates from squared distances to the pivots alone."""
        points = points.astype(np.float64)
        with np.errstate(all="ignore"):  # numbers too large for squares give apexes that are no numbers, and leave nothing out
            squares = np.stack([((points - p) ** 2).sum(axis=1) for p in self.pivots], axis=1)
            first = squares[:, 0]
            # |x - p_i|^2 = |x|^2 - 2 x.p_i + |p_i|^2 with the first pivot at 0.
            along = np.linalg.solve(self.base, ((first[:, None] + self.lengths - squares[:, 1:]) / 2).T).T if len(self.base) else np.zeros((len(points), 0))
            height = np.sqrt(np.maximum(first - (along**2).sum(axis=1), 0.0))
            return np.concatenate([along, height[:, None]], axis=1)


def nearest(x: np.ndarray, apexes: np.ndarray, centroids: np.ndarray, tops: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Number of and squared distance to the nearest centroid of each row (ties: the smaller number), and the comparisons made."""
    wide = x.dtype == object or centroids.dtype == object
    x, centroids = (v.astype(object if wide else np.int64) for v in (x, centroids))
    with np.errstate(all="ignore"):
        sizes, top_sizes = (apexes**2).sum(axis=1)[:, None], (tops**2).sum(axis=1)[None, :]
        lower = sizes + top_sizes - 2 * (apexes @ tops.T)
        upper, off = lower + 4 * np.outer(apexes[:, -1], tops[:, -1]), MARGIN * (sizes + top_sizes)
        # The centroid of the least lower bound is compared first; its distance is a bound as well, and a closer one.
        at = np.nan_to_num(lower, nan=np.inf).argmin(axis=1)
        least, done = ((x - centroids[at]) ** 2).sum(axis=1), len(x)
        bound = (upper + off).min(axis=1)
        if not wide:
            bound = np.fmin(bound, least * (1 + MARGIN))
        out = lower - off > bound[:, None]  # a comparison with a number that is none leaves nothing out
    out[np.arange(len(x)), at] = True
    for c in range(len(centroids)):
        rows = np.flatnonzero(~out[:, c])
        d = ((x[rows] - centroids[c]) ** 2).sum(axis=1)
        better = (d < least[rows]) | ((d == least[rows]) & (c < at[rows]))
        at[rows[better]], least[rows[better]] = c, d[better]
        done += len(rows)
    return at, least, done


def _matrix(column: pa.Array, kind, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(len(column), width)


def _limbs(values: list[int]) -> list[list[int]]:
    """Signed limbs: lists of the same length as ``values``, the k-th to be multiplied by 2 ** (LIMB * k)."""
    out, rest = [], list(values)
    while any(rest):
        out.append([(abs(v) & ((1 << LIMB) - 1)) * (1 if v >= 0 else -1) for v in rest])
        rest = [(abs(v) >> LIMB) * (1 if v >= 0 else -1) for v in rest]
    return out or [[0] * len(rest)]


def _array(values: list[list[int]]) -> np.ndarray:
    return np.array(values, np.int64 if all(abs(v) <= FAST for r in values for v in r) else object)


def _prepared(kept: DataFrame, simplex: Simplex, scale: int, width: int) -> DataFrame:
    """vec_id, the vector as doubles, and its apex, each packed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, ROWS):
                part = batch.slice(i, ROWS)
                values = np.asarray(part.column(1).flatten(), np.float64).reshape(part.num_rows, width)
                apexes = simplex.apex(whole_numbers(values, scale))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([v.tobytes() for v in values], pa.binary()), pa.array([a.tobytes() for a in apexes], pa.binary())], names=["vec_id", "vector", "apex"])

    return kept.mapInArrow(run, "vec_id long, vector binary, apex binary")


def _sums(rows: DataFrame, simplex: Simplex, centroids: list[list[int]], scale: int, width: int) -> list[tuple[int, list[int]]]:
    """Of each centroid the number and the sum of its vectors."""
    held, depth = _array(centroids), len(simplex.base) + 1
    tops = simplex.apex(held)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums = [0] * len(held), [[0] * width for _ in held]
        for batch in batches:
            for i in range(0, batch.num_rows, ROWS):
                part = batch.slice(i, ROWS)
                x = whole_numbers(_matrix(part.column(0), np.float64, width), scale)
                at, _, _ = nearest(x, _matrix(part.column(1), np.float64, depth), held, tops)
                for c in np.unique(at):
                    own = x[at == c]
                    n[c] += len(own)
                    sums[c] = [a + int(b) for a, b in zip(sums[c], own.sum(axis=0), strict=True)]
        found = [(c, k, n[c] if k == 0 else 0, part) for c in range(len(held)) if n[c] for k, part in enumerate(_limbs(sums[c]))]
        yield pa.RecordBatch.from_pydict({"cluster": [f[0] for f in found], "limb": [f[1] for f in found], "n": [f[2] for f in found], "sums": [f[3] for f in found]}, schema=pa.schema([("cluster", pa.int32()), ("limb", pa.int32()), ("n", pa.int64()), ("sums", pa.list_(pa.int64()))]))

    parts = rows.select("vector", "apex").mapInArrow(run, "cluster int, limb int, n long, sums array<long>")
    places = parts.select("cluster", "limb", "n", F.posexplode("sums").alias("place", "part"))
    merged = places.groupBy("cluster", "limb", "place").agg(F.sum("n").alias("n"), F.sum("part").alias("part")).toArrow()
    counts, sums = [0] * len(held), [[0] * width for _ in held]
    for c, limb, i, n, part in zip(*(merged[x].to_pylist() for x in ("cluster", "limb", "place", "n", "part")), strict=True):
        counts[c] += n if i == 0 else 0
        sums[c][i] += part << (LIMB * limb)
    return list(zip(counts, sums, strict=True))


def _assigned(rows: DataFrame, simplex: Simplex, centroids: list[list[int]], scale: int, width: int) -> DataFrame:
    held, depth = _array(centroids), len(simplex.base) + 1
    tops = simplex.apex(held)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, ROWS):
                part = batch.slice(i, ROWS)
                x = whole_numbers(_matrix(part.column(1), np.float64, width), scale)
                at, least, _ = nearest(x, _matrix(part.column(2), np.float64, depth), held, tops)
                fits = [int(v) if v < 1 << 63 else None for v in least]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(at.astype(np.int32)), pa.array(fits, pa.int64())], names=["vec_id", "cluster", "distance"])

    return rows.mapInArrow(run, "vec_id long, cluster int, distance long")


def cluster(vectors: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", width: int = WIDTH, k: int = CENTROIDS, rounds: int = ROUNDS, seed: str = SEED, scale: int = SCALE, pivots: int = PIVOTS) -> DataFrame:
    """One row per vector of ``width`` finite components: vec_id, cluster, distance (squared, of whole numbers), centroid.

    ``centroid`` lists the final centroid's components as decimals. Other vectors give no row; an empty table, or one
    without such vectors, gives none. Where fewer than ``k`` vectors are kept, all are centroids. Equal centroids stay:
    ties go to the smaller number, so the greater one is empty and stays as it is. Repeated rows count each. A null
    ``vec_id`` starts no centroid and is assigned like others. A distance beyond 64 bits is null. Other columns are
    ignored, whatever their names.
    """
    spark = vectors.sparkSession
    kept = kept_vectors(vectors, id_col=id_col, vector_col=vector_col, width=width)
    centroids = first_centroids(kept, k, seed, scale)
    if not centroids:
        return spark.createDataFrame([], "vec_id long, cluster int, distance long, centroid string")
    simplex, scratch = Simplex(centroids, pivots), Scratch(spark)
    rows = scratch.cut(_prepared(kept, simplex, scale, width))
    for _ in range(rounds):
        found = _sums(rows, simplex, centroids, scale, width)
        centroids = [[s // n for s in sums] if n else old for (n, sums), old in zip(found, centroids, strict=True)]
    texts = F.create_map(*(F.lit(x) for c, v in enumerate(centroids) for x in (c, ",".join(map(str, v)))))
    return _assigned(rows, simplex, centroids, scale, width).withColumn("centroid", texts[F.col("cluster")])


def with_inertia(clusters: DataFrame) -> DataFrame:
    """``clusters`` with cluster_inertia and inertia, the sums of ``distance`` over a row's cluster and over all; null beyond 64 bits."""
    rows = Scratch(clusters.sparkSession).cut(clusters)
    # One row for each cluster, as many as the parameter k says.
    per = rows.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s"), F.count_if(F.col("distance").isNull()).alias("no"))
    long = lambda s, no: F.when(no == 0, s.try_cast("long"))
    total = per.agg(long(F.sum("s"), F.sum("no")).alias("inertia"))
    sums = per.select(F.col("cluster").alias("of"), long(F.col("s"), F.col("no")).alias("cluster_inertia")).crossJoin(F.broadcast(total))
    return rows.join(F.broadcast(sums), F.col("cluster") == F.col("of")).drop("of")
