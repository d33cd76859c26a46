"""Exact nearest-neighbour join by cosine, in bounded blocks.

Copies of a vector are searched once: hashes that occur twice are counted first,
and only their rows meet by the vector itself. A vector travels as it came, with
its length; the unit vector is made where it is multiplied. Large groups are cut
into cells around pivots, two to a block, and queries are dealt to the same cells. A query first searches its own cell: the distance of
the k-th point found there bounds what any other cell can add, and it goes on
to those cells alone that the triangle inequality cannot rule out, so the result
equals a full scan. Cells are cut further into blocks on either side. A block has
`block` rows, in a larger group half of it up to WIDEST: a vector then travels to
a fixed number of blocks, however large the group, until blocks are WIDEST. Which (query block, cell, point block) have work is settled on ids
before any vector moves: a point travels to the query blocks that need it and to
no others. One task multiplies one query block with one point block and keeps k
rows per query: no pair list is ever built.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from memograph.functions.scoring import norm
from memograph.plans.bounded import broadcast_if_small
from memograph.session import cut_lineage

SLACK = 1e-6
#: Most rows of a block, and most products held at once.
WIDEST, HELD = 1 << 16, 1 << 22
ROUNDED = 1e-9  # cosines are kept to 9 decimals


def _directions(vector: Column, size: Column, zero_at: int) -> Column:
    """Unit vector with two more axes; a zero vector points along its own side's axis, at cosine 0 to all."""
    flag = F.when(size == 0, 1.0).otherwise(0.0)
    axes = F.array(flag, F.lit(0.0)) if zero_at == 0 else F.array(F.lit(0.0), flag)
    return F.concat(F.transform(vector, lambda x: F.when(size == 0, 0.0).otherwise(x.cast("double") / size)), axes)


def _matrix(rows: pd.DataFrame, zero_at: int) -> np.ndarray:
    """The same unit vectors, as rows of a matrix."""
    vectors = np.stack([np.asarray(v, dtype=np.float64) for v in rows["_x"].to_numpy()])
    size = rows["_size"].to_numpy(dtype=np.float64)
    zero = size == 0
    axes = np.zeros((len(vectors), 2))
    axes[zero, zero_at] = 1.0
    scaled = np.where(zero[:, None], 0.0, vectors / np.where(zero, 1.0, size)[:, None])
    return np.hstack([scaled, axes])


def _to_pivots(points: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(2.0 - 2.0 * points @ pivots.T, 0.0))


def best_of(asking: np.ndarray, points: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, point, cosine) of the k points with the largest rounded cosine for each row; ties go to the first point.

    The k-th of some points bounds what can be among the best, so few products are ever ordered.
    """
    some, found = max(k, min(len(points), 1024)), []
    step = max(1, HELD // len(points))
    for start in range(0, len(asking), step):
        cos = asking[start:start + step] @ points.T
        if k < len(points):
            # What is no number comes last.
            ranked = np.where(np.isnan(cos), -np.inf, cos) if np.isnan(cos).any() else cos
            least = np.partition(ranked[:, :some], some - k, axis=1)[:, some - k]
            row, point = np.nonzero(ranked >= least[:, None] - 2 * ROUNDED)
        else:
            row, point = (a.ravel() for a in np.indices(cos.shape))
        value = np.round(cos[row, point], 9)
        order = np.lexsort((point, -value, row))
        row, point, value = row[order], point[order], value[order]
        first = np.searchsorted(row, row)
        kept = np.arange(len(row)) - first < k
        found.append((row[kept] + start, point[kept], value[kept]))
    return tuple(np.concatenate(part) for part in zip(*found))


def knn_join(
    queries: DataFrame, points: DataFrame, k: int, keys: Sequence[str],
    query_id: str, point_id: str, vector: str = "embedding", block: int = 16384, pivots: int | None = None,
) -> DataFrame:
    """The k points of the same keys with the largest cosine for every query; ties go to the smaller id.

    Returns keys, query_id, point_id, cosine (9 decimals) and rank. The column
    names of query_id and point_id must differ.
    """
    keys = list(keys)
    group = F.xxhash64(*keys) if keys else F.lit(0).cast("long")

    def prepared(side: DataFrame, id_column: str, zero_at: int) -> DataFrame:
        kind = side.schema[vector].dataType.simpleString()
        given = F.col(vector) if kind in ("array<float>", "array<double>") else F.col(vector).cast("array<double>")
        rows = side.filter(F.col(vector).isNotNull()).select(*keys, group.alias("_g"), F.col(id_column).alias("_id"), given.alias("_x"))
        sized = rows.withColumn("_size", norm(F.col("_x")))
        return cut_lineage(sized.withColumn("_vk", F.xxhash64(_directions(F.col("_x"), F.col("_size"), zero_at))))

    q_rows, p_rows = prepared(queries, query_id, 0), prepared(points, point_id, 1)
    # Copies: one representative is searched; at most k ids of a copy group can ever be returned.
    copy_keys = [*keys, "_g", "_vk", "_v"]
    p_alone, p_shared = _split(p_rows, 1)
    q_alone, q_shared = _split(q_rows, 0)
    p_reps, p_ids = p_alone.filter("_id IS NOT NULL").select("_g", F.col("_id").alias("_rep"), "_x", "_size"), None
    q_reps = q_alone.select("_g", F.col("_id").alias("_rep"), "_x", "_size")
    owners = q_alone.select(*keys, "_g", "_id", F.col("_id").alias("_q"))
    one = F.first(F.struct("_x", "_size")).alias("_r")
    if p_shared is not None:
        order = Window.partitionBy(*copy_keys).orderBy("_id")
        listed = cut_lineage(p_shared.withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= k).groupBy(*copy_keys).agg(
            F.array_sort(F.collect_list("_id")).alias("_ids"), one).filter(F.size("_ids") > 0).select(
            "_g", F.element_at("_ids", 1).alias("_rep"), "_ids", "_r._x", "_r._size"))
        p_ids = p_reps.select("_g", "_rep", F.array("_rep").alias("_ids")).unionByName(listed.select("_g", "_rep", "_ids"))
        p_reps = p_reps.unionByName(listed.drop("_ids"))
    if q_shared is not None:
        firsts = cut_lineage(q_shared.groupBy(*copy_keys).agg(F.min("_id").alias("_rep"), one).select("_g", "_vk", "_v", "_rep", "_r._x", "_r._size"))
        q_reps = q_reps.unionByName(firsts.select("_g", "_rep", "_x", "_size"))
        owners = owners.unionByName(cut_lineage(q_shared.join(firsts.select("_g", "_vk", "_v", F.col("_rep").alias("_q")), ["_g", "_vk", "_v"]).select(
            *keys, "_g", "_id", "_q")))

    def counted(rows: DataFrame, name: str) -> DataFrame:
        return rows.groupBy("_g").agg(F.count(F.lit(1)).alias(name))

    # Row counts bound the distinct vectors from above and need no vector column.
    sizes = cut_lineage(counted(p_rows.select("_g"), "_points").join(counted(q_rows.select("_g"), "_queries"), "_g"))
    largest, asked_most = sizes.agg(F.max("_points"), F.max("_queries")).first()
    id_type = p_reps.schema["_rep"].dataType.simpleString()
    q_type = q_reps.schema["_rep"].dataType.simpleString()
    partial_schema = f"_g long, _q {q_type}, _rep {id_type}, _cos double"

    def multiply(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        none = np.array([], dtype=object)
        if left.empty or right.empty:
            # Typed slices: untyped empty columns do not convert to Arrow structs.
            return pd.DataFrame({
                "_g": np.array([], dtype="int64"), "_q": left["_q"].iloc[:0].to_numpy() if len(left.columns) else none,
                "_rep": right["_rep"].iloc[:0].to_numpy() if len(right.columns) else none, "_cos": np.array([], dtype="float64")})
        right = right.sort_values("_rep", kind="stable").reset_index(drop=True)
        at, top, cos = best_of(_matrix(left, 0), _matrix(right, 1), k)
        return pd.DataFrame({
            "_g": left["_g"].to_numpy()[at], "_q": left["_q"].to_numpy()[at], "_rep": right["_rep"].to_numpy()[top], "_cos": cos})

    block = max(block, min(WIDEST, max(largest or 0, asked_most or 0) // 2))
    if max(largest or 0, asked_most or 0) <= block:
        # Every group fits one block: one product per group is the whole answer.
        reps = q_reps.withColumnRenamed("_rep", "_q").groupBy("_g").cogroup(p_reps.groupBy("_g")).applyInPandas(multiply, partial_schema)
    else:
        reps = _pruned(q_reps, p_reps, sizes, k, block, pivots, largest, multiply, partial_schema, id_type, q_type)
    return _expand(reps, p_ids, owners, k, keys, query_id, point_id)


def _split(rows: DataFrame, zero_at: int) -> tuple[DataFrame, DataFrame | None]:
    """Rows whose vector hash nobody shares in their group, and the others with their unit vector, if there are any."""
    twice = cut_lineage(rows.groupBy("_g", "_vk").agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").select("_g", "_vk"))
    if twice.isEmpty():
        return rows, None
    known = broadcast_if_small(twice)
    shared = rows.join(known, ["_g", "_vk"], "left_semi").withColumn("_v", _directions(F.col("_x"), F.col("_size"), zero_at))
    return rows.join(known, ["_g", "_vk"], "left_anti"), shared


def _pruned(q_reps, p_reps, sizes, k, block, pivots, largest, multiply, partial_schema, id_type, q_type) -> DataFrame:
    """Best k representatives per query over all cells the triangle inequality leaves in play."""
    # Pivots are chosen by hash of their id: two for each block of the largest group, as cells far below a block
    # cost more pieces of work and more copies of a vector than they save, and no more than its square root.
    wanted = pivots if pivots is not None else min(math.isqrt(largest or 0) + 1, 2 * -(-(largest or 0) // block))
    table = None
    if largest > block and wanted > 1:
        chosen = p_reps.select("_x", "_size", F.xxhash64("_rep").alias("_h")).orderBy("_h").limit(wanted).collect()
        table = _matrix(pd.DataFrame({"_x": [r["_x"] for r in chosen], "_size": [r["_size"] for r in chosen]}), 1)

    def placed(side: DataFrame, id_column: str, id_kind: str, zero_at: int) -> DataFrame:
        """Each vector with its nearest pivot's cell and the distance to it; groups of one block have one cell."""
        def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                if table is None or b.empty:
                    b["_cell"], b["_away"] = 0, 2.0
                else:
                    away = _to_pivots(_matrix(b, zero_at), table)
                    cell = away.argmin(axis=1)
                    big = (b["_points"] > block).to_numpy()
                    b["_cell"] = np.where(big, cell, 0).astype("int32")
                    b["_away"] = np.where(big, away[np.arange(len(b)), cell], 2.0)
                yield b[["_g", id_column, "_x", "_size", "_cell", "_away"]]

        rows = side.withColumnRenamed("_rep", id_column).join(sizes.select("_g", "_points"), "_g")
        kind = side.schema["_x"].dataType.simpleString()
        return cut_lineage(rows.mapInPandas(place, f"_g long, {id_column} {id_kind}, _x {kind}, _size double, _cell int, _away double"))

    points, queries = placed(p_reps, "_rep", id_type, 1), placed(q_reps, "_q", q_type, 0)
    cells = cut_lineage(points.groupBy("_g", "_cell").agg(
        F.count(F.lit(1)).alias("n"), F.max("_away").alias("r")).withColumn("_pbs", F.ceil(F.col("n") / block).cast("int")))
    # A query block holds queries of one cell of one group.
    crowds = cut_lineage(queries.groupBy("_g", F.col("_cell").alias("_home")).agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("_qbs")))
    queries = queries.withColumnRenamed("_cell", "_home").join(crowds, ["_g", "_home"]).select(
        "_g", "_home", F.pmod(F.xxhash64("_q"), F.col("_qbs")).cast("int").alias("_qb"), "_q", "_x", "_size")
    work = ["_g", "_home", "_qb", "_cell", "_pb"]

    def search(visits: DataFrame, asking: DataFrame) -> DataFrame:
        """Partial results of (_g, _home, _qb, _q, _cell, _pbs) rows and those with their vectors; a point goes where some query of the block needs it."""
        def spread(rows: DataFrame) -> DataFrame:
            return rows.withColumn("_pb", F.explode(F.sequence(F.lit(0), F.col("_pbs") - 1))).drop("_pbs")

        triples = cut_lineage(visits.select("_g", "_home", "_qb", "_cell", "_pbs").distinct())
        block_of = F.pmod(F.xxhash64("_rep"), F.col("_pbs")).cast("int")
        held = points.select("_g", "_cell", "_rep", "_x", "_size").join(triples, ["_g", "_cell"]).withColumn("_pb", block_of)
        return cut_lineage(spread(asking).select(*work, "_q", "_x", "_size").groupBy(*work).cogroup(
            held.select(*work, "_rep", "_x", "_size").groupBy(*work)).applyInPandas(multiply, partial_schema))

    home = queries.withColumn("_cell", F.col("_home")).join(cells.select("_g", "_cell", "_pbs"), ["_g", "_cell"])
    own = search(home, home)
    best = Window.partitionBy("_g", "_q").orderBy(F.desc("_cos"), F.asc("_rep"))
    own = own.withColumn("_n", F.row_number().over(best)).filter(F.col("_n") <= k)
    if table is None:
        return own.drop("_n")
    own = cut_lineage(own)
    reach = own.filter(F.col("_n") == k).select("_g", "_q", F.col("_cos").alias("_kth"))
    # One row per query block and group: the cells of the group, as many as there are pivots at most.
    maps = cells.groupBy("_g").agg(F.collect_list(F.struct("_cell", "n", "r", "_pbs")).alias("_cells")).join(
        cut_lineage(queries.select("_g", "_home", "_qb").distinct()), "_g")

    def visit(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        listed = right["_cells"].iloc[0] if len(right) else []
        cell, n, pbs = (np.array([c[f] for c in listed], dtype="int64") for f in ("_cell", "n", "_pbs"))
        r = np.array([c["r"] for c in listed], dtype="float64")
        rows, at = np.zeros(0, dtype="int64"), np.zeros(0, dtype="int64")
        if len(left) and len(cell) > 1:
            away = _to_pivots(_matrix(left, 0), table)[:, cell]
            near = np.argsort(away + r, axis=1)
            enough = np.minimum((np.cumsum(n[near], axis=1) < k).sum(axis=1), len(cell) - 1)
            limit = np.take_along_axis(away + r, near[np.arange(len(left)), enough][:, None], axis=1)[:, 0]
            kth = left["_kth"].to_numpy(dtype="float64")
            limit = np.fmin(limit, np.sqrt(np.maximum(2.0 - 2.0 * (kth - ROUNDED), 0.0))) + SLACK
            open_ = (away - r <= limit[:, None]) & (cell != left["_home"].to_numpy()[:, None])
            rows, at = np.nonzero(open_)
        out = left[["_g", "_home", "_qb", "_q"]].iloc[rows].reset_index(drop=True) if len(left) else pd.DataFrame(
            {c: np.array([], dtype="int64") for c in ("_g", "_home", "_qb")} | {"_q": np.array([], dtype=object)})
        return out.assign(_cell=cell[at].astype("int32"), _pbs=pbs[at].astype("int32"))

    block_keys = ["_g", "_home", "_qb"]
    visits = cut_lineage(queries.join(reach, ["_g", "_q"], "left").groupBy(*block_keys).cogroup(maps.groupBy(*block_keys)).applyInPandas(
        visit, f"_g long, _home int, _qb int, _q {q_type}, _cell int, _pbs int"))
    both = own.drop("_n").unionByName(search(visits, visits.join(queries.select("_g", "_q", "_x", "_size"), ["_g", "_q"])))
    return both.withColumn("_n", F.row_number().over(best)).filter(F.col("_n") <= k).drop("_n")


def _expand(reps, p_ids, owners, k, keys, query_id, point_id) -> DataFrame:
    """Back to all ids: every copy of a point, if there are any, then every copy of a query."""
    if p_ids is None:
        spread = reps.withColumnRenamed("_rep", "_point")
    else:
        spread = reps.join(p_ids, ["_g", "_rep"]).select("_g", "_q", "_cos", F.explode("_ids").alias("_point"))
    final = Window.partitionBy("_g", "_q").orderBy(F.desc("_cos"), F.asc("_point"))
    chosen = spread.withColumn("rank", F.row_number().over(final)).filter(F.col("rank") <= k)
    return owners.withColumnRenamed("_id", query_id).join(chosen, ["_g", "_q"]).select(
        *keys, query_id, F.col("_point").alias(point_id), F.col("_cos").alias("cosine"), "rank")


def top_k_scan(
    queries: DataFrame, points: DataFrame, keys: Sequence[str], matches: Column | None, score: Column, k: Column | int,
    query_id: str, tie: str,
) -> DataFrame:
    """Score every admitted (query, point) row and keep the best k of each query.

    Meant for a table of user questions: it is broadcast once counted, so the
    points are scanned in place, and the group limit keeps k rows per task and
    query before anything is shuffled. A k that differs by question is first
    bounded by its maximum, because only a literal limit reaches the scan side.
    """
    bound = k if isinstance(k, int) else int(queries.agg(F.max(k)).first()[0] or 0)
    joined = points.join(broadcast_if_small(queries), list(keys))
    if matches is not None:
        joined = joined.filter(matches)
    w = Window.partitionBy(query_id).orderBy(F.desc("_order"), F.asc(tie))
    scored = joined.withColumn("cosine", score).withColumn("_order", F.round("cosine", 9))
    ranked = scored.withColumn("candidate_rank", F.row_number().over(w))
    return ranked.filter((F.col("candidate_rank") <= bound) & (F.col("candidate_rank") <= k)).drop("_order")
