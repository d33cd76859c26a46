"""Approximate nearest neighbours by cross-polytope hashing with multiprobe tables.

A table turns a vector by fast Hadamard pseudo-rotations; its bucket is the nearest signed
axis of each of `rotations` turns. Every vector is filed once per table. A query looks into
the buckets in the order of its own coordinates on their axes, the likeliest first. How far
down that order a neighbour at a given cosine lies depends on the dimension and the cosine
alone, and is simulated on random pairs: from the cosine of its k-th candidate so far, each
query knows how many buckets it needs to find such a neighbour with probability `goal`. A
query goes on, four times further each round, until it has looked that far; one that would
need more than `most` buckets looks into every bucket there is.

Candidates of a bucket are ranked exactly. A bucket is cut into parts of at most `block`
vectors and its queries likewise; each pair of parts is a piece of work of its own. Equal
vectors are one class that keeps its smallest ids, so copies crowd no bucket.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from memograph.llm.common import stored
from memograph.llm.embedding_dedup import rotate

GRID = 20
SAMPLES = 1000
LAST_ID = (1 << 63) - 1


def width_of(dim: int) -> int:
    return 1 << max(1, (dim - 1).bit_length())


def coordinates(x: np.ndarray, table: int, rotations: int, seed: int) -> np.ndarray:
    """(n, rotations, 2 * width): coordinates on the signed axes of each turn of a table."""
    n, dim = x.shape
    width = width_of(dim)
    padded = np.zeros((n, width))
    padded[:, :dim] = x
    out = np.empty((n, rotations, 2 * width))
    for r in range(rotations):
        y = rotate(padded, np.random.default_rng([seed, dim, table, r]).choice([-1.0, 1.0], size=(3, width))) / width ** 1.5
        out[:, r, :width] = y
        out[:, r, width:] = -y
    return out


def own_codes(on_axes: np.ndarray) -> np.ndarray:
    """The bucket of each row: its nearest signed axes."""
    code = np.zeros(len(on_axes), dtype=np.int64)
    for r in range(on_axes.shape[1]):
        code = code * on_axes.shape[2] + on_axes[:, r].argmax(axis=1)
    return code


def probe_codes(on_axes: np.ndarray, count: int) -> np.ndarray:
    """(n, up to count) buckets by falling sum of the row's coordinates on their axes.

    A pair of places (i, j) in two sorted lists is among the first `count` sums only if
    (i + 1) * (j + 1) <= count, so only those are formed.
    """
    n, rotations, axes = on_axes.shape
    order = np.argsort(-on_axes[:, 0], axis=1, kind="stable")[:, :count]
    codes, sums = order.astype(np.int64), np.take_along_axis(on_axes[:, 0], order, axis=1)
    for r in range(1, rotations):
        order = np.argsort(-on_axes[:, r], axis=1, kind="stable")[:, :count]
        values = np.take_along_axis(on_axes[:, r], order, axis=1)
        places = [(i, j) for i in range(codes.shape[1]) for j in range(min(order.shape[1], count // (i + 1)))]
        i, j = (np.array(p) for p in zip(*places))
        both = sums[:, i] + values[:, j]
        best = np.argsort(-both, axis=1, kind="stable")[:, :count]
        codes = codes[np.arange(n)[:, None], i[best]] * axes + order[np.arange(n)[:, None], j[best]]
        sums = np.take_along_axis(both, best, axis=1)
    return codes


def _sums(on_axes: np.ndarray) -> np.ndarray:
    out = np.zeros(1)
    for values in on_axes:
        out = (out[:, None] + values[None, :]).ravel()
    return out


def probes_needed(dim: int, tables: int, rotations: int, goal: float, seed: int) -> np.ndarray:
    """For each cosine k / GRID, how many buckets of every table a query must look into.

    With that many, it meets a vector at this cosine in one of the tables with probability
    `goal`, by simulation on random pairs.
    """
    if dim < 2:
        return np.full(GRID + 1, 2.0 * width_of(dim))
    rng = np.random.default_rng([seed, dim])
    samples = SAMPLES if rotations < 3 else SAMPLES // 5
    q = rng.normal(size=(samples, dim))
    q /= np.linalg.norm(q, axis=1, keepdims=True)
    z = rng.normal(size=(samples, dim))
    z -= (z * q).sum(axis=1, keepdims=True) * q
    z /= np.linalg.norm(z, axis=1, keepdims=True)
    turned = [coordinates(q, t, rotations, seed) for t in range(tables)]
    half = rotations // 2
    lower = [[np.sort(_sums(turned[t][s, half:])) for s in range(samples)] for t in range(tables)]
    out = np.zeros(GRID + 1)
    for g in range(GRID + 1):
        c = g / GRID
        x = c * q + math.sqrt(1 - c * c) * z
        rank = np.full(samples, np.inf)
        for t in range(tables):
            axes = coordinates(x, t, rotations, seed).argmax(axis=2)
            value = np.take_along_axis(turned[t], axes[:, :, None], axis=2).sum(axis=(1, 2))
            for s in range(samples):
                above = len(lower[t][s]) - np.searchsorted(lower[t][s], value[s] - _sums(turned[t][s, :half]) + 1e-12, side="right")
                rank[s] = min(rank[s], above.sum() + 1)
        out[g] = np.sort(rank)[min(samples - 1, math.ceil(goal * samples) - 1)]
    return np.maximum.accumulate(out[::-1])[::-1]


def _vectors(column: pa.Array, kind: str) -> list[bytes | None]:
    """Each vector as bytes; None where it is null, empty, zero, or holds null or non-finite components."""
    out: list[bytes | None] = []
    for value in column:
        items = value.as_py()
        if not items or None in items:
            out.append(None)
            continue
        v = np.array(items, dtype=np.float64)
        out.append(v.astype(kind).tobytes() if np.isfinite(v).all() and v.any() else None)
    return out


def _rows(vectors: list[bytes], kind: str, dim: int) -> np.ndarray:
    """The vectors as doubles, each scaled by a power of two so that no product overflows or vanishes."""
    x = np.frombuffer(b"".join(vectors), dtype=kind).reshape(-1, dim).astype(np.float64)
    return np.ldexp(x, -np.frexp(np.abs(x).max(axis=1, keepdims=True))[1])


def _lengths(x: np.ndarray) -> np.ndarray:
    return np.sqrt(np.einsum("ij,ij->i", x, x))


def best_of(queries: np.ndarray, points: np.ndarray, low: np.ndarray, floor: np.ndarray, keep: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, point, cosine) of each query's `keep` nearest points at or above its floor, ties to the lower `low`."""
    unit_q, unit_p = queries / _lengths(queries)[:, None], points / _lengths(points)[:, None]
    rough = unit_q @ unit_p.T
    edge = floor
    if rough.shape[1] > keep:
        edge = np.maximum(floor, np.partition(rough, rough.shape[1] - keep, axis=1)[:, rough.shape[1] - keep])
    i, j = np.nonzero(rough >= edge[:, None] - 1e-9)
    score = np.einsum("ij,ij->i", queries[i], points[j]) / (_lengths(queries)[i] * _lengths(points)[j])
    order = np.lexsort((low[j], -score, i))
    i, j, score = i[order], j[order], score[order]
    place = np.arange(len(i)) - np.searchsorted(i, i)
    wanted = (place < keep) & (score >= floor[i])
    return i[wanted], j[wanted], score[wanted]


def nearest(vectors: DataFrame, k: int = 5, every: int = 50, goal: float = 0.97, tables: int = 2, rotations: int | None = None, per_bucket: int = 256,
            first: int = 8, most: int = 4096, block: int = 512, seed: int = 13, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): for each row whose id is divisible by `every`, the k nearest other rows found.

    score is the cosine in double precision; ties go to the smaller id, null ids last. Null,
    empty and zero vectors and those with null or non-finite components take no part, and
    vectors meet only vectors of the same length. Rows are told apart by themselves, not by
    id: a repeated row is a candidate for its copy, and every row of a repeated id is a query.
    `rotations` follows from the number of vectors unless given: a bucket holds about
    `per_bucket` of them, or more. Other columns are ignored. No rows give no rows.
    """
    kind = "<f4" if vectors.schema[vector_col].dataType.simpleString() == "array<float>" else "<f8"

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = _vectors(batch.column(2), kind)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([len(v) // int(kind[2]) if v else 0 for v in found], pa.int32()),
                                              pa.array(found, pa.binary())], ["row", "id", "dim", "vec"])

    source = vectors.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("vec"))
    rows = stored(source.mapInArrow(read, "row long, id long, dim int, vec binary").filter("vec IS NOT NULL").withColumn("digest", F.unhex(F.sha2("vec", 256))))
    # Of each class, the ids that any result can need.
    by_id = Window.partitionBy("dim", "digest").orderBy(F.col("id").asc_nulls_last(), "row")
    members = stored(rows.select("dim", "digest", "id", "row").withColumn("place", F.row_number().over(by_id)).filter(F.col("place") <= k + 1))
    asks = rows.filter(F.col("id") % every == 0).select("dim", "digest", "id", "row")
    heads = members.filter("place = 1").select("dim", "digest", F.col("row").alias("node"), F.coalesce("id", F.lit(LAST_ID)).alias("low"))
    classes = stored(heads.join(rows.select("row", "vec"), F.col("node") == F.col("row")).drop("row").join(
        asks.select("dim", "digest", F.lit(True).alias("asks")).distinct(), ["dim", "digest"], "left"))
    count, dims = classes.agg(F.count(F.lit(1)), F.collect_set("dim")).first()
    turns = rotations or max(1, int(math.log(max(1, count / per_bucket)) / math.log(2 * width_of(max(dims, default=2)))))
    needed = {d: probes_needed(d, tables, turns, goal, seed) for d in dims}
    index = stored(_filed(classes.select("node", "low", "dim", "vec"), kind, tables, turns, seed))
    sizes = stored(index.groupBy("dim", "tab", "code").agg(F.count(F.lit(1)).alias("n")).withColumn("parts", F.ceil(F.col("n") / block).cast("int")))

    seekers = classes.filter("asks").select("node", "dim", "vec")
    state = None
    waiting = seekers.select("*", F.lit(-2.0).alias("floor"), F.lit(0).alias("begin"), F.lit(first).alias("end"), F.lit(False).alias("whole"))
    while True:
        found = _candidates(_looks(waiting, sizes, kind, tables, turns, seed), index, sizes, waiting, kind, block, k + 1)
        best = found if state is None else found.unionByName(state)
        first_k = Window.partitionBy("asker").orderBy(F.desc("score"), "low", "node")
        state = stored(best.repartition("asker").groupBy("asker", "node", "low").agg(F.max("score").alias("score")).withColumn(
            "place", F.row_number().over(first_k)).filter(F.col("place") <= k + 1).drop("place"))
        # The (k + 1)-th candidate is the k-th other one at worst.
        floors = state.groupBy("asker").agg(F.min("score").alias("least"), F.count(F.lit(1)).alias("n")).select(
            F.col("asker").alias("node"), F.when(F.col("n") > k, F.col("least")).otherwise(F.lit(-2.0)).alias("least"))
        asked = waiting.filter("NOT whole").select("node", "dim", "vec", "end").join(floors, "node", "left").withColumn("floor", F.coalesce("least", F.lit(-2.0)))
        place = F.greatest(F.lit(0), F.least(F.lit(GRID), F.floor(F.col("floor") * GRID).cast("int")))
        steps = F.create_map(*[part for d in sorted(needed) for part in (F.lit(d), F.array(*[F.lit(float(v)) for v in needed[d]]))]) if needed else None
        if steps is None:
            break
        goals = asked.withColumn("goal", F.when(F.col("floor") < 0, F.lit(float("inf"))).otherwise(F.element_at(F.element_at(steps, F.col("dim")), place + 1)))
        buckets = F.pow(F.lit(2.0) * F.pow(F.lit(2.0), F.ceil(F.log2(F.greatest("dim", F.lit(2)).cast("double")))), F.lit(float(turns)))
        waiting = stored(goals.filter((F.col("goal") > F.col("end")) & (F.col("end") < buckets)).select(
            "node", "dim", "vec", "floor", F.col("end").alias("begin"),
            F.least(F.col("end") * 4, F.greatest(F.least("goal", buckets), F.col("end") + 1)).cast("int").alias("end"),
            (F.col("end") * 4 > most).alias("whole")))
        if waiting.isEmpty():
            break
    named = state.join(members.join(heads.select("dim", "digest", "node"), ["dim", "digest"]).select("node", "id", "row"), "node")
    asked = asks.join(heads.select("dim", "digest", F.col("node").alias("asker")), ["dim", "digest"]).select("asker", F.col("id").alias("query_id"), F.col("row").alias("own"))
    last = Window.partitionBy("own").orderBy(F.desc("score"), F.col("id").asc_nulls_last(), "row")
    return asked.join(named, "asker").filter("row <> own").withColumn("rank", F.row_number().over(last)).filter(F.col("rank") <= k).select(
        "query_id", "rank", F.col("id").alias(id_col), "score")


def _filed(classes: DataFrame, kind: str, tables: int, rotations: int, seed: int) -> DataFrame:
    """(dim, tab, code, node, low, vec): each class once per table."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column(2).to_numpy()
            for dim in np.unique(dims):
                part = batch.take(pa.array(np.flatnonzero(dims == dim)))
                for at in range(0, part.num_rows, 2048):
                    some = part.slice(at, 2048)
                    x = _rows(some.column(3).to_pylist(), kind, int(dim))
                    x /= _lengths(x)[:, None]
                    for t in range(tables):
                        yield pa.RecordBatch.from_arrays([some.column(2), pa.array(np.full(len(x), t, dtype=np.int32)), pa.array(own_codes(coordinates(x, t, rotations, seed))),
                                                          some.column(0), some.column(1), some.column(3)], ["dim", "tab", "code", "node", "low", "vec"])

    return classes.mapInArrow(run, "dim int, tab int, code long, node long, low long, vec binary")


def _looks(waiting: DataFrame, sizes: DataFrame, kind: str, tables: int, rotations: int, seed: int) -> DataFrame:
    """(asker, dim, tab, code, parts): the occupied buckets that each waiting query looks into now."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                dim, begin, end = (batch.column(c)[k].as_py() for c in (1, 3, 4))
                x = _rows([batch.column(2)[k].as_py()], kind, dim)
                x /= _lengths(x)[:, None]
                for t in range(tables):
                    codes = probe_codes(coordinates(x, t, rotations, seed), end)[0, begin:]
                    one = pa.array(np.zeros(len(codes), dtype=np.int64))
                    yield pa.RecordBatch.from_arrays([batch.column(0)[k:k + 1].take(one), batch.column(1)[k:k + 1].take(one),
                                                      pa.array(np.full(len(codes), t, dtype=np.int32)), pa.array(codes)], ["asker", "dim", "tab", "code"])

    near = waiting.filter("NOT whole").select("node", "dim", "vec", "begin", "end").mapInArrow(run, "asker long, dim int, tab int, code long")
    near = near.join(sizes.select("dim", "tab", "code", "parts"), ["dim", "tab", "code"])
    # All buckets of one table hold all vectors.
    every = waiting.filter("whole").select(F.col("node").alias("asker"), "dim").join(sizes.filter("tab = 0").select("dim", "tab", "code", "parts"), "dim")
    return near.unionByName(every)


def _candidates(looks: DataFrame, index: DataFrame, sizes: DataFrame, waiting: DataFrame, kind: str, block: int, keep: int) -> DataFrame:
    """(asker, node, low, score): of each piece of work, the `keep` nearest vectors of every query in it."""
    bucket = ["dim", "tab", "code"]
    looks = stored(looks)
    crowds = looks.groupBy(*bucket).agg(F.count(F.lit(1)).alias("n"), F.max("parts").alias("parts")).withColumn("crowds", F.ceil(F.col("n") / block).cast("int")).drop("n")
    points = index.join(crowds, bucket).select(
        *bucket, F.pmod(F.xxhash64("node"), F.col("parts")).cast("int").alias("part"), F.explode(F.sequence(F.lit(0), F.col("crowds") - 1)).alias("crowd"),
        F.lit(0).alias("kind"), "node", "low", F.lit(-2.0).alias("floor"), "vec")
    askers = looks.drop("parts").join(crowds, bucket).select(
        *bucket, F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.pmod(F.xxhash64("asker"), F.col("crowds")).cast("int").alias("crowd"),
        F.lit(1).alias("kind"), F.col("asker").alias("node"))
    askers = askers.join(waiting.select("node", "floor", "vec"), "node").select(*bucket, "part", "crowd", "kind", "node", F.lit(0).cast("long").alias("low"), "floor", "vec")

    def settle(points: list[pa.RecordBatch], asks: pa.RecordBatch) -> pa.RecordBatch:
        table = pa.Table.from_batches(points)
        dim = asks.column(0)[0].as_py()
        node, low = table["node"].to_numpy(), table["low"].to_numpy()
        x = _rows(table["vec"].to_pylist(), kind, dim)
        i, j, score = best_of(_rows(asks.column("vec").to_pylist(), kind, dim), x, low, asks.column("floor").to_numpy(), keep)
        return pa.RecordBatch.from_arrays([asks.column("node").take(pa.array(i)), pa.array(node[j]), pa.array(low[j]), pa.array(score)], ["asker", "node", "low", "score"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A piece of work arrives in order, its vectors before its queries."""
        key, held = None, []
        for batch in batches:
            marks = np.stack([batch.column(c).to_numpy().astype(np.int64) for c in range(6)], axis=1)
            cuts = np.flatnonzero(np.concatenate([[True], (marks[1:] != marks[:-1]).any(axis=1)])) if len(marks) else []
            for a, b in zip(cuts, [*cuts[1:], len(marks)]):
                if marks[a, 5] == 0:
                    if key != tuple(marks[a, :5]):
                        key, held = tuple(marks[a, :5]), []
                    held.append(batch.slice(a, b - a))
                elif key == tuple(marks[a, :5]):
                    for at in range(a, b, 512):
                        yield settle(held, batch.slice(at, min(512, b - at)))

    order = [*bucket, "part", "crowd"]
    return points.unionByName(askers).repartition(*order).sortWithinPartitions(*order, "kind").mapInArrow(
        run, "asker long, node long, low long, score double")
