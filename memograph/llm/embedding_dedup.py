"""Near-duplicate vectors by cross-polytope hashing.

A vector is rotated by sign flips and fast Hadamard transforms; its hash is the nearest
signed axis, taken over `rotations` independent rotations per table. A vector is filed in
its own bucket of each table and in the buckets next in line (multiprobe). Vectors of one
bucket and label are compared in double precision, and a pair that meets in several
buckets counts in the first only. Exact copies are one class with a count, so they form
no pairs. A bucket of more than `block` classes is cut into blocks, and each pair of
blocks is one task's work: no bucket is capped and no task holds more than two blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from memograph.llm.common import components, stored

CHUNK, PAIRS, SMALL = 1024, 1 << 15, 64


def rotate(x: np.ndarray, signs: np.ndarray) -> np.ndarray:
    """Three rounds of sign flips and Hadamard transforms over the last axis (a power of two wide)."""
    n, d = x.shape
    for flips in signs:
        x = x * flips
        half = 1
        while half < d:
            y = x.reshape(n, d // (2 * half), 2, half)
            x = np.stack([y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]], axis=2).reshape(n, d)
            half *= 2
    return x


def bucket_codes(x: np.ndarray, tables: int, rotations: int, seed: int) -> np.ndarray:
    """(n, tables, rotations + 1) bucket numbers: the own bucket, then one per rotation with its second-nearest axis."""
    n, d = x.shape
    width = 1 << max(1, (d - 1).bit_length())
    padded = np.zeros((n, width))
    padded[:, :d] = x
    rng = np.random.default_rng(seed)
    out = np.zeros((n, tables, rotations + 1), dtype=np.int64)
    at = np.arange(n)
    for t in range(tables):
        first, second = [], []
        for _ in range(rotations):
            y = rotate(padded, rng.choice([-1.0, 1.0], size=(3, width)))
            size = np.abs(y)
            best = size.argmax(axis=1)
            size[at, best] = -1.0
            then = size.argmax(axis=1)
            first.append(2 * best + (y[at, best] < 0))
            second.append(2 * then + (y[at, then] < 0))
        for probe in range(rotations + 1):
            code = np.zeros(n, dtype=np.int64)
            for r in range(rotations):
                code = code * (2 * width) + (second[r] if probe == r + 1 else first[r])
            out[:, t, probe] = code
    return out


def _vectors(column: pa.Array) -> list[np.ndarray | None]:
    """Each vector as doubles; None where it is null, empty, zero, or holds null or non-finite components."""
    out: list[np.ndarray | None] = []
    for value in column:
        items = value.as_py()
        if not items or None in items:
            out.append(None)
            continue
        v = np.array(items, dtype=np.float64)
        out.append(v if np.isfinite(v).all() and v.any() else None)
    return out


def _unit(rows: list[bytes], dim: int) -> np.ndarray:
    x = np.frombuffer(b"".join(rows), dtype=np.float64).reshape(-1, dim)
    x = x / np.abs(x).max(axis=1, keepdims=True)  # no overflow in the norm
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _bucket_starts(columns: list[np.ndarray]) -> np.ndarray:
    """First row of each bucket, where any of the columns changes."""
    change = np.ones(len(columns[0]), dtype=bool)
    change[1:] = np.any([c[1:] != c[:-1] for c in columns], axis=0)
    return np.flatnonzero(change)


def _label_low(low: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Smallest reachable member of each, after linking i with j."""
    while True:
        before = low.copy()
        least = np.minimum(low[i], low[j])
        np.minimum.at(low, low[i], least)
        np.minimum.at(low, low[j], least)
        np.minimum.at(low, i, least)
        np.minimum.at(low, j, least)
        low = low[low]
        if (low == before).all():
            return low


def first_meetings(codes: np.ndarray, i: np.ndarray, j: np.ndarray, table: np.ndarray, code: np.ndarray) -> np.ndarray:
    """Whether each pair's bucket (table, code) is the first that both of its rows are filed in."""
    met = codes[i][:, :, :, None] == codes[j][:, :, None, :]
    shared = met.any(axis=3)
    first = shared.any(axis=2).argmax(axis=1)
    at = np.arange(len(i))
    lowest = np.where(shared[at, first], codes[i][at, first], np.iinfo(np.int64).max).min(axis=1)
    return (first == table) & (lowest == code)


def near_pairs(x: np.ndarray, starts: np.ndarray, sizes: np.ndarray, part: np.ndarray, a: np.ndarray, b: np.ndarray,
               threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(i, j, bucket) of the pairs at or above the threshold: small buckets many at a time, large ones by blocks of products."""
    small = (sizes <= SMALL) & (a == b)
    for size in np.unique(sizes[small]):
        which = np.flatnonzero(small & (sizes == size))
        one, two = np.triu_indices(int(size), 1)
        step = max(1, PAIRS // max(1, len(one)))
        for k in range(0, len(which), step):
            some = which[k:k + step]
            i, j = ((starts[some][:, None] + side).ravel() for side in (one, two))
            near = np.einsum("ij,ij->i", x[i], x[j]) >= threshold
            yield i[near], j[near], np.repeat(some, len(one))[near]
    for k in np.flatnonzero(~small).tolist():
        rows = np.arange(starts[k], starts[k] + sizes[k])
        left, right, same = rows[part[rows] == a[k]], rows[part[rows] == b[k]], a[k] == b[k]
        for s in range(0, len(left), CHUNK):
            for t in range(s if same else 0, len(right), CHUNK):
                i, j = np.nonzero(x[left[s:s + CHUNK]] @ x[right[t:t + CHUNK]].T >= threshold)
                i, j = left[s:s + CHUNK][i], right[t:t + CHUNK][j]
                keep = i < j if same else np.ones(len(i), dtype=bool)
                i, j = i[keep], j[keep]
                for u in range(0, len(i), PAIRS):
                    yield i[u:u + PAIRS], j[u:u + PAIRS], np.full(len(i[u:u + PAIRS]), k)


def near_duplicates(vectors: DataFrame, threshold: float = 0.98, tables: int = 6, rotations: int = 2, block: int = 2048, seed: int = 7,
                    id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """(id, n_links, component_id, kept) of each row of vectors.

    Rows are compared when their labels are equal and not null and their vectors equally
    long. Null, empty and zero vectors and those with null or non-finite components link with
    nothing. Repeated rows and copies are other vectors of the same direction and count as
    links. component_id is the smallest id reachable (ids that are null do not count); kept
    says whether it is the row's own. Other columns are ignored. No rows give no rows.
    """
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = _vectors(batch.column(3))
            found = [None if batch.column(2)[k].as_py() is None else v for k, v in enumerate(found)]
            yield pa.RecordBatch.from_arrays([
                batch.column(0), batch.column(1), batch.column(2), pa.array([len(v) if v is not None else 0 for v in found], pa.int32()),
                pa.array([v.tobytes() if v is not None else None for v in found], pa.binary())], ["row", "id", "label", "dim", "vec"])

    source = vectors.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("id"),
                            F.col(label_col).cast("string").alias("label"), F.col(vector_col).alias("vec"))
    rows = stored(source.mapInArrow(read, "row long, id long, label string, dim int, vec binary").withColumn("digest", F.unhex(F.sha2("vec", 256))))
    classes = stored(rows.filter("vec IS NOT NULL").groupBy("label", "dim", "digest").agg(
        F.min("row").alias("node"), F.min("id").alias("low_id"), F.count(F.lit(1)).alias("copies"), F.min("vec").alias("vec")))

    def file(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column(2).to_numpy()
            for dim in np.unique(dims):
                at = np.flatnonzero(dims == dim)
                part = batch.take(pa.array(at))
                codes = bucket_codes(_unit(part.column(3).to_pylist(), int(dim)), tables, rotations, seed)
                yield pa.RecordBatch.from_arrays([*part.columns[:3], pa.array([c.tobytes() for c in codes], pa.binary())],
                                                 ["node", "label", "dim", "codes"])

    coded = stored(classes.select("node", "label", "dim", "vec").mapInArrow(file, "node long, label string, dim int, codes binary"))

    def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        per = rotations + 1
        for batch in batches:
            codes = np.frombuffer(b"".join(batch.column(3).to_pylist()), dtype=np.int64)
            n = batch.num_rows
            many = pa.array(np.repeat(np.arange(n), tables * per))
            yield pa.RecordBatch.from_arrays([*[batch.column(k).take(many) for k in range(3)], pa.array(np.tile(np.repeat(np.arange(tables, dtype=np.int32), per), n)),
                                              pa.array(codes)], ["node", "label", "dim", "tab", "code"])

    key = ["label", "dim", "tab", "code"]
    filed = coded.mapInArrow(spell, "node long, label string, dim int, tab int, code long")
    sizes = filed.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").withColumn("parts", F.ceil(F.col("n") / block).cast("int"))
    placed = filed.join(sizes, key).withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
    # One copy of a row for each pair of blocks it belongs to: one in most buckets.
    cells = placed.select("node", *key, "part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other")).select(
        "node", *key, F.least("part", "other").alias("a"), F.greatest("part", "other").alias("b"), "part")
    held = classes.select("node", "copies", "vec").join(coded.select("node", "codes"), "node")
    work = cells.join(held, "node")

    def settle(rows: pa.Table) -> pa.RecordBatch:
        """Links of whole buckets, which lie one after the other."""
        node, copies, part, tab, code, a, b, dim = (rows[c].to_numpy() for c in ("node", "copies", "part", "tab", "code", "a", "b", "dim"))
        label = rows["label"].combine_chunks().dictionary_encode().indices.to_numpy()
        starts = _bucket_starts([label, dim, tab, code, a, b])
        sizes = np.diff(np.concatenate([starts, [len(node)]]))
        links, low = np.zeros(len(node), dtype=np.int64), np.arange(len(node))
        for d in np.unique(dim):
            mine = np.flatnonzero(dim[starts] == d)
            at = np.flatnonzero(dim == d)
            inside = np.zeros(len(node), dtype=np.int64)
            inside[at] = np.arange(len(at))
            some = rows if len(at) == len(node) else rows.take(pa.array(at))
            x = _unit(some["vec"].to_pylist(), int(d))
            codes = np.frombuffer(b"".join(some["codes"].to_pylist()), dtype=np.int64).reshape(len(x), tables, rotations + 1)
            for i, j, k in near_pairs(x, inside[starts[mine]], sizes[mine], part[at], a[starts[mine]], b[starts[mine]], threshold):
                own = first_meetings(codes, i, j, tab[starts[mine][k]], code[starts[mine][k]])
                i, j = at[i[own]], at[j[own]]
                if len(i):
                    np.add.at(links, i, copies[j])
                    np.add.at(links, j, copies[i])
                    low = _label_low(low, i, j)
        found = np.flatnonzero(links > 0)
        return pa.RecordBatch.from_arrays([pa.array(node[found]), pa.array(links[found]), pa.array(node[low[found]])], ["node", "links", "low"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Buckets arrive in order; the last one of a batch may go on in the next and waits for it."""
        held: pa.Table | None = None
        for batch in batches:
            for s in range(0, batch.num_rows, 8192):
                part = pa.Table.from_batches([batch.slice(s, 8192)])
                rows = part if held is None else pa.concat_tables([held, part])
                starts = _bucket_starts([rows["label"].combine_chunks().dictionary_encode().indices.to_numpy(), *[rows[c].to_numpy() for c in ("dim", "tab", "code", "a", "b")]])
                if starts[-1]:
                    yield settle(rows.slice(0, int(starts[-1])).combine_chunks())
                held = rows.slice(int(starts[-1]))
        if held is not None:
            yield settle(held.combine_chunks())

    order = [*key, "a", "b"]
    met = stored(work.select("node", *order, "part", "copies", "vec", "codes").repartition(*order).sortWithinPartitions(*order, "node").mapInArrow(
        meet, "node long, links long, low long"))
    totals = met.groupBy("node").agg(F.sum("links").alias("links"))
    roots = components(met.filter("node <> low").select(F.col("node").alias("a"), F.col("low").alias("b")))
    named = classes.join(totals, "node", "left").join(roots, "node", "left").select(
        "label", "dim", "digest", "copies", "low_id", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("root", "node").alias("root"))
    lowest = named.groupBy("root").agg(F.min("low_id").alias("component_id"))
    results = named.join(lowest, "root").select(
        "label", "dim", "digest", (F.col("links") + F.col("copies") - 1).alias("n_links"), "component_id")
    linked = rows.filter("vec IS NOT NULL").join(results, ["label", "dim", "digest"]).select("id", "n_links", "component_id")
    alone = rows.filter("vec IS NULL").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    return linked.unionByName(alone).select(F.col("id").alias(id_col), "n_links", "component_id",
                                            F.coalesce(F.col("id") == F.col("component_id"), F.lit(False)).alias("kept"))
