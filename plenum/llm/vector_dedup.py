"""Operator 11: links between near-equal vectors by iterative quantisation and multi-index Hamming tables.

1. Equal vectors form one class. Classes are coded by rotations that are learned by iterative quantisation (Gong and
   Lazebnik) on a bounded sample: directions of most variance are rotated so that signs lose least, and each bit is cut at
   its median, so that codes are balanced. A sample so crowded that this parts near vectors gets rotations about the
   origin as well. Several rotations give a code as long as the tables need.
2. The code is cut into substrings of about the logarithm of the number of classes, one table each. Two codes meet in a
   table if their substrings differ in at most two bits: each is entered under its own substring and all that differ in
   one. The number of tables follows from the recall that is measured on partners made at the threshold.
3. Cells: of the vectors of a table's entry the one of least hash is a pivot. A vector goes to the pivot with most votes
   within half the angle of the threshold; so all of a cell are linked with each other, and a group of near copies is a
   few cells instead of all its pairs.
4. Cells that meet in a table, and whose sketches are close enough for their radii, are reranked with original vectors. The
   angle of their centres and their radii tell most pairs of cells: all of one linked with all of the other, or none. The
   rest are compared member by member, in blocks within tasks that return counts.
5. Links are sums of weights; components join cells.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plenum.llm.graphs import components
from plenum.llm.tables import Scratch

THRESHOLD = 0.9
SAMPLE = 4096
WIDTH = 128
TURNS = 30
TARGET = 0.995
MOST_TABLES = 64
LEAST_BITS = 10
BLOCK = 512
#: Angles closer than this to a bound are told by the vectors themselves.
MARGIN = 1e-6
SKETCH = 128
#: Standard deviations of differing bits by which the sketches of a pair may be off.
SIGMAS = 4.5


@dataclass
class Coder:
    """``tables`` substrings of ``bits`` bits, signs of projections against cuts, and a sketch of signs about the origin.

    A sketch's bit differs with a probability of the angle over pi whatever the data, so it tells how far vectors can be.
    """

    width: int
    axes: np.ndarray
    cuts: np.ndarray
    signs: np.ndarray
    bits: int
    tables: int
    angle: float
    recall: float

    def code(self, units: np.ndarray) -> np.ndarray:
        return units @ self.axes > self.cuts

    def sketch(self, units: np.ndarray) -> np.ndarray:
        return np.packbits(units @ self.signs > 0, axis=1)

    def most_differing(self, angles: np.ndarray) -> np.ndarray:
        """Differing bits that sketches at these angles stay within, all but surely."""
        p, n = np.minimum(angles / np.pi, 0.5), self.signs.shape[1]
        return np.ceil(n * p + SIGMAS * np.sqrt(n * p * (1 - p)))


def folded(vector: np.ndarray, width: int) -> np.ndarray:
    """A unit vector of ``width`` components: shorter ones get zeros, components beyond are added with a sign of their place."""
    vector = vector / np.abs(vector).max()
    vector = vector / np.sqrt((vector**2).sum())
    n = len(vector)
    out = np.zeros(-(-max(n, width) // width) * width)
    out[:n] = vector
    if n <= width:
        return out
    signs = np.random.default_rng(n).choice([-1.0, 1.0], len(out))
    out = (out * signs).reshape(-1, width).sum(axis=0)
    size = np.sqrt((out**2).sum())
    return out / size if size else out


def _rotation(v: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Iterative quantisation: the rotation of ``v`` whose signs are nearest to it, found in turns of signs and rotations."""
    r = np.linalg.qr(rng.normal(size=(v.shape[1], v.shape[1])))[0]
    for _ in range(TURNS):
        u, _, w = np.linalg.svd(np.where(v @ r > 0, 1.0, -1.0).T @ v)
        r = (u @ w).T
    return r


def fit(units: np.ndarray, classes: int, threshold: float = THRESHOLD, seed: int = 11) -> Coder:
    """A coder for ``classes`` vectors like those of the sample ``units`` (rows of one width)."""
    rng, width = np.random.default_rng(seed), units.shape[1]
    bits = max(LEAST_BITS, math.ceil(math.log2(max(classes, 2))))
    # Partners at the threshold, each in a direction of its own.
    aside = rng.normal(size=units.shape)
    aside -= (aside * units).sum(axis=1, keepdims=True) * units
    sizes = np.sqrt((aside**2).sum(axis=1, keepdims=True))
    partners = threshold * units + math.sqrt(1 - threshold**2) * aside / np.where(sizes > 0, sizes, 1)
    # Rotations about the mean with balanced cuts, or about the origin where the sample is so crowded that these part
    # near vectors: these if more than twice as many partners meet by them.
    middles = (units.mean(axis=0), np.zeros(width))
    principal = [np.linalg.eigh((units - m).T @ (units - m))[1][:, ::-1] for m in middles]
    used, met, tables, each = [], np.zeros(len(units), bool), 0, max(1, width // bits)
    while tables < MOST_TABLES and (not tables or met.mean() < TARGET):
        tried = []
        for k, (middle, vectors) in enumerate(zip(middles, principal, strict=True)):
            turned = [vectors @ _rotation((units - middle) @ vectors, rng) for _ in range(-(-bits // width))]
            axes = np.concatenate(turned, axis=1)[:, : each * bits]
            own = units @ axes
            cuts = np.zeros(axes.shape[1]) if k else np.median(own, axis=0)
            apart = ((own > cuts) != (partners @ axes > cuts)).reshape(len(units), each, bits).sum(axis=2) <= 2
            tried.append((np.count_nonzero(apart.any(axis=1) & ~met), axes, cuts, apart))
        _, axes, cuts, apart = tried[0] if 2 * tried[0][0] >= tried[1][0] else tried[1]
        used.append((axes, cuts))
        met, tables = met | apart.any(axis=1), tables + each
    signs = np.concatenate([np.linalg.qr(rng.normal(size=(width, width)))[0] for _ in range(-(-SKETCH // width))], axis=1)[:, :SKETCH]
    return Coder(width, np.concatenate([u[0] for u in used], axis=1), np.concatenate([u[1] for u in used]), signs, bits, tables, math.acos(threshold), float(met.mean()))


def _vectors(column: pa.Array) -> list[np.ndarray]:
    values, offsets = np.asarray(column.flatten(), np.float64), np.asarray(column.offsets) - column.offsets[0].as_py()
    return [values[a:b] for a, b in zip(offsets[:-1], offsets[1:], strict=True)]


def _coded(classes: DataFrame, coder: Coder) -> DataFrame:
    """id, size (components), vector (packed unit vector of all components), code (a packed sketch) and a key for each table."""
    powers = np.int64(1) << np.arange(coder.bits, dtype=np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = _vectors(batch.column(1))
            units = np.stack([folded(v, coder.width) for v in found]) if found else np.zeros((0, coder.width))
            packed, keys = coder.sketch(units), coder.code(units).reshape(len(found), coder.tables, coder.bits) @ powers + (np.arange(coder.tables, dtype=np.int64) << coder.bits)
            units = [v / np.abs(v).max() for v in found]
            units = [v / np.sqrt((v**2).sum()) for v in units]
            yield pa.RecordBatch.from_arrays([
                batch.column(0), pa.array([len(v) for v in found], pa.int32()), pa.array([v.tobytes() for v in units], pa.binary()), pa.array([p.tobytes() for p in packed], pa.binary()), pa.ListArray.from_arrays(pa.array(np.arange(len(found) + 1, dtype=np.int32) * coder.tables), pa.array(keys.reshape(-1))),
            ], names=["id", "size", "vector", "code", "keys"])

    return classes.select("id", "embedding").mapInArrow(run, "id long, size int, vector binary, code binary, keys array<long>")


def _cosines(x: pa.Array, y: pa.Array) -> np.ndarray:
    """Of pairs of packed unit vectors, of which both have the same length."""
    return np.array([np.frombuffer(a.as_buffer(), np.float64) @ np.frombuffer(b.as_buffer(), np.float64) for a, b in zip(x, y, strict=True)], np.float64)


def _differing(x: pa.Array, y: pa.Array) -> np.ndarray:
    x, y = (np.frombuffer(b"".join(v.to_pylist()), np.uint64).reshape(len(v), -1) for v in (x, y))
    return np.bitwise_count(x ^ y).sum(axis=1)


def _cells(coded: DataFrame, coder: Coder, scratch: Scratch) -> DataFrame:
    """(id, cell, angle): the pivot to which a vector goes and its angle to it; vectors far from all pivots are their own."""
    half = coder.angle / 2 - MARGIN
    rows = coded.select(F.explode("keys").alias("key"), "size", "id", "code")
    least = F.min(F.struct(F.xxhash64("id").alias("h"), F.col("id").alias("pivot"), F.col("code").alias("pivot_code")))
    entries = rows.groupBy("key", "size").agg(least.alias("least"), F.count(F.lit(1)).alias("n")).filter("n > 1").select("key", "size", "least.pivot", "least.pivot_code")
    # Written, so that both sides of the join are plain exchanges, of which Spark splits what is skewed.
    entries = scratch.cut(entries)
    limit = int(coder.most_differing(np.array([half]))[0])

    def close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = pa.array(_differing(batch.column(2), batch.column(3)) <= limit)
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(good), batch.column(1).filter(good)], names=["id", "pivot"])

    met = rows.join(entries, ["key", "size"]).filter("id <> pivot").select("id", "pivot", "code", "pivot_code").mapInArrow(close, "id long, pivot long").distinct()
    vectors = coded.select("id", "vector")

    def within(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            angles = np.arccos(np.clip(_cosines(batch.column(2), batch.column(3)), -1, 1))
            good = pa.array(angles <= half)
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(good), batch.column(1).filter(good), pa.array(angles).filter(good)], names=["id", "pivot", "angle"])

    both = met.join(vectors, "id").join(vectors.select(F.col("id").alias("pivot"), F.col("vector").alias("other")), "pivot")
    near = scratch.cut(both.select("id", "pivot", "vector", "other").mapInArrow(within, "id long, pivot long, angle double"))
    votes = scratch.cut(near.groupBy("pivot").agg(F.count(F.lit(1)).alias("votes")))
    own = votes.select(F.col("pivot").alias("id"), "pivot", F.lit(0.0).alias("angle"), "votes")
    ballots = near.join(votes, "pivot").select("id", "pivot", "angle", "votes").unionByName(own)
    chosen = ballots.groupBy("id").agg(F.max(F.struct("votes", (-F.col("pivot")).alias("p"), "angle")).alias("best")).select("id", (-F.col("best.p")).alias("cell"), "best.angle")
    cells = scratch.cut(coded.select("id").join(chosen, "id", "left").select("id", F.coalesce("cell", "id").alias("cell"), F.coalesce("angle", F.lit(0.0)).alias("angle")))
    scratch.drop(entries, near, votes)
    return cells


def _meeting(coded: DataFrame, members: DataFrame, cells: DataFrame, coder: Coder, scratch: Scratch) -> DataFrame:
    """Pairs (a, b), a < b, of cells that meet in a table and whose centres' sketches are close enough for their radii."""
    one_off = F.transform(F.sequence(F.lit(0), F.lit(coder.bits - 1)), lambda j: F.call_function("shiftleft", F.lit(1).cast("long"), j))
    near = F.flatten(F.transform("keys", lambda k: F.concat(F.array(k), F.transform(one_off, lambda bit: k.bitwiseXOR(bit)))))
    rows = coded.select("id", "size", "keys").join(members.select("id", "cell"), "id").select(F.explode(near).alias("key"), "size", "cell").distinct()
    counts = rows.groupBy("key", "size").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks")).filter("blocks > 1")
    counts = scratch.cut(counts)
    placed = rows.join(counts, ["key", "size"], "left").withColumn("blocks", F.coalesce("blocks", F.lit(1))).withColumn("block", F.pmod(F.xxhash64("cell"), F.col("blocks")).cast("int"))
    pairs = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda o: F.struct(F.least(o, F.col("block")).alias("x"), F.greatest(o, F.col("block")).alias("y")))
    dealt = placed.select("key", "size", "cell", F.explode(pairs).alias("pair"))
    grouped = dealt.join(cells.select("cell", "code", "radius"), "cell").groupBy("key", "size", "pair").agg(F.collect_list("cell").alias("cells"), F.collect_list("code").alias("codes"), F.collect_list("radius").alias("radii"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, radii = np.asarray(batch.column(0).flatten()), np.asarray(batch.column(2).flatten())
            codes = np.frombuffer(b"".join(batch.column(1).flatten().to_pylist()), np.uint64).reshape(len(ids), -1)
            ends = np.concatenate([[0], np.cumsum(np.asarray(batch.column(0).value_lengths()))]).astype(np.int64)
            sizes, found = np.diff(ends), [np.zeros((0, 2), np.int64)]
            for n in np.unique(sizes[sizes > 1]):
                x, y = np.triu_indices(n, 1)
                starts = ends[:-1][sizes == n]
                step = max(1, (1 << 20) // len(x))
                for i in range(0, len(starts), step):
                    a, b = (np.add.outer(starts[i : i + step], z).ravel() for z in (x, y))
                    apart = np.bitwise_count(codes[a] ^ codes[b]).sum(axis=1)
                    good = apart <= coder.most_differing(coder.angle + radii[a] + radii[b])
                    u, v = ids[a[good]], ids[b[good]]
                    found.append(np.stack([np.minimum(u, v), np.maximum(u, v)], axis=1))
            pairs = np.unique(np.concatenate(found), axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])

    found = grouped.filter(F.size("cells") > 1).select("cells", "codes", "radii").mapInArrow(run, "a long, b long").distinct()
    met = scratch.cut(found)
    scratch.drop(counts)
    return met


def _judged(pairs: DataFrame, cells: DataFrame, threshold: float) -> DataFrame:
    """(a, b, whole): pairs of cells of which all are linked, or (not whole) some may be."""
    most = math.acos(threshold)
    of = lambda x: cells.select(F.col("cell").alias(x), *(F.col(c).alias(f"{c}_{x}") for c in ("vector", "radius", "several")))
    both = pairs.join(of("a"), "a").join(of("b"), "b").select("a", "b", "vector_a", "vector_b", "radius_a", "radius_b", (F.col("several_a") | F.col("several_b")).alias("several"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cosines = _cosines(batch.column(2), batch.column(3))
            angles, radii = np.arccos(np.clip(cosines, -1, 1)), np.asarray(batch.column(4)) + np.asarray(batch.column(5))
            several = np.asarray(batch.column(6).to_pylist(), bool)
            whole = np.where(several, angles + radii <= most - MARGIN, cosines >= threshold)
            some = np.where(several, angles - radii <= most + MARGIN, whole)
            keep = pa.array(some.astype(bool))
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep), pa.array(whole.astype(bool)).filter(keep)], names=["a", "b", "whole"])

    return both.mapInArrow(run, "a long, b long, whole boolean")


def _by_member(border: DataFrame, coded: DataFrame, members: DataFrame, cells: DataFrame, threshold: float, scratch: Scratch) -> DataFrame:
    """(a, b, id, links): links of the members of pairs of cells across the pair, summed within blocks."""
    wanted = border.select(F.explode(F.array("a", "b")).alias("cell")).distinct()
    blocks = cells.join(wanted, "cell", "left_semi").select("cell", F.ceil(F.col("members") / BLOCK).cast("int").alias("blocks"))
    rows = members.join(blocks, "cell").join(coded.select("id", "vector"), "id").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")))
    held = scratch.cut(rows.groupBy("cell", "block").agg(F.collect_list("id").alias("ids"), F.collect_list("weight").alias("weights"), F.collect_list("vector").alias("vectors")))
    of = lambda x: held.select(F.col("cell").alias(x), *(F.col(c).alias(f"{c}_{x}") for c in ("ids", "weights", "vectors")))
    both = border.select("a", "b").join(of("a"), "a").join(of("b"), "b").select("a", "b", "ids_a", "weights_a", "vectors_a", "ids_b", "weights_b", "vectors_b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                x, y = (np.frombuffer(b"".join(batch.column(c)[r].as_py()), np.float64).reshape(len(batch.column(c)[r]), -1) for c in (4, 7))
                linked = x @ y.T >= threshold
                ids = np.concatenate([np.asarray(batch.column(c)[r].values) for c in (2, 5)])
                links = np.concatenate([linked @ np.asarray(batch.column(6)[r].values), linked.T @ np.asarray(batch.column(3)[r].values)])
                good = links > 0
                n = int(good.sum())
                yield pa.RecordBatch.from_arrays([pa.array([batch.column(c)[r].as_py()] * n, pa.int64()) for c in (0, 1)] + [pa.array(ids[good]), pa.array(links[good])], names=["a", "b", "id", "links"])

    return scratch.cut(both.mapInArrow(run, "a long, b long, id long, links long"))


def _classes(rows: DataFrame, scratch: Scratch) -> tuple[DataFrame, int]:
    """Distinct vectors with an id that the written table fixes, their rows counted and their least vec_id."""
    grouped = rows.groupBy("embedding").agg(F.count(F.lit(1)).alias("weight"), F.min("vec_id").alias("least"))
    classes, seen = scratch.counted(grouped.withColumn("id", F.monotonically_increasing_id()), n=F.count(F.lit(1)))
    return classes, seen["n"]


def usable(embedding: Column) -> Column:
    """Whether a vector takes part: not null, not zero, and without components that are null or not finite."""
    finite = F.forall(embedding, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(finite & F.exists(embedding, lambda x: x != 0), F.lit(False))


def near_equal_vectors(vectors: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = THRESHOLD) -> DataFrame:
    """One row per row of ``vectors``: vec_id, n_links, component_id, kept.

    Vectors are linked by a cosine of ``threshold`` and more, in double precision, whatever their other columns; vectors
    of different lengths are not. A vector that is null, empty, zero or holds components null or not finite has no links
    and is its own component. Every row is a vector, so rows of one vec_id are compared like others, and the component of
    a row is the least vec_id that it reaches; a null vec_id counts as a link and is the least of nothing: where there is
    no other, the component is null, and it is kept. An empty table gives none.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark)
    rows = vectors.select(vectors[f"`{id_col}`"].cast("long").alias("vec_id"), vectors[f"`{vector_col}`"].cast("array<double>").alias("embedding"))
    rows = rows.withColumn("embedding", F.when(usable(F.col("embedding")), F.col("embedding")))
    classes, n = _classes(rows.filter("embedding IS NOT NULL"), scratch)
    if n < 1:
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    sample = [np.array(r[0]) for r in classes.orderBy(F.xxhash64("embedding")).limit(SAMPLE).select("embedding").collect()]
    width = min(WIDTH, max(len(v) for v in sample))
    coder = fit(np.stack([folded(v, width) for v in sample]), n, threshold)
    coded = scratch.cut(_coded(classes, coder))
    members = scratch.cut(_cells(coded, coder, scratch).join(classes.select("id", "weight", "least"), "id"))
    sums = members.groupBy("cell").agg(F.sum("weight").alias("weight"), F.max("angle").alias("radius"), F.count(F.lit(1)).alias("members"), F.min("least").alias("least"), F.min("id").alias("one"))
    several = (F.col("members") > 1) | (F.col("one") != F.col("cell"))
    cells = scratch.cut(sums.withColumn("several", several).join(coded.select(F.col("id").alias("cell"), "code", "vector"), "cell"))
    met = _meeting(coded, members, cells, coder, scratch)
    judged = scratch.cut(_judged(met, cells, threshold))
    border = _by_member(judged.filter("NOT whole"), coded, members, cells, threshold, scratch)
    across = judged.filter("whole").select("a", "b")
    other = across.unionByName(across.select(F.col("b").alias("a"), F.col("a").alias("b")))
    whole = other.join(cells.select(F.col("cell").alias("b"), "weight"), "b").groupBy(F.col("a").alias("cell")).agg(F.sum("weight").alias("whole"))
    single = border.groupBy("id").agg(F.sum("links").alias("single"))
    edges = across.unionByName(border.select("a", "b").distinct()).select(F.col("a").alias("u"), F.col("b").alias("v"))
    joined = components(edges, scratch).withColumnsRenamed({"node": "cell"})
    grouped = cells.select("cell", "weight", "least").join(joined, "cell", "left").withColumn("component", F.coalesce("component", "cell"))
    least = grouped.groupBy("component").agg(F.min("least").alias("component_id"))
    of_cell = grouped.join(least, "component").join(whole, "cell", "left").select("cell", "component_id", (F.col("weight") - 1 + F.coalesce("whole", F.lit(0))).alias("linked"))
    of_class = members.join(of_cell, "cell").join(single, "id", "left").select("id", "component_id", (F.col("linked") + F.coalesce("single", F.lit(0))).alias("n_links"))
    found = classes.select("id", F.col("embedding").alias("same")).join(of_class, "id")
    out = rows.join(found, F.col("embedding") == F.col("same"), "left")
    component = F.when(F.col("id").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    out = out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.col("component_id").isNull()))
