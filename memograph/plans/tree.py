"""Paths in a parent-pointer tree by pointer doubling."""

from __future__ import annotations

from itertools import count

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from memograph.session import cut_lineage


def descend(
    nodes: DataFrame, node_id: str, parent_id: str, step: Column, max_depth: int | None = None, roots: Column | None = None
) -> DataFrame:
    """Adds depth and path (the steps from the root down) to every node reachable from a root.

    Every node knows the steps up to some ancestor; a round joins it with what that ancestor
    knows, which doubles the distance, so the rounds grow with the logarithm of the depth.
    Only ids and steps are walked, each round is written before the next, and the other columns
    join once at the end. Depths have no gaps: a round in which no node reaches its root is
    the last, so nodes on or below a cycle, which never do, end the walk and are left out, and
    so are nodes below a missing parent. Node ids are unique. A tree deeper than max_depth
    raises; nothing is cut off.
    """
    root = F.coalesce(F.col(parent_id).isNull() if roots is None else roots, F.lit(False))
    walk = cut_lineage(nodes.filter(root | F.col(parent_id).isNotNull()).select(
        F.col(node_id).alias("_id"), F.when(~root, F.col(parent_id)).alias("_up"), F.lit(0).alias("depth"), F.array(step).alias("path_steps")))
    there = walk.filter("_up IS NULL").count()
    for _ in count():
        above = walk.select(F.col("_id").alias("_up"), F.col("_up").alias("_next"), F.col("depth").alias("_depth"), F.col("path_steps").alias("_steps"))
        climbed = walk.filter("_up IS NOT NULL").join(above, "_up").select(
            "_id", F.col("_next").alias("_up"), (F.col("depth") + F.col("_depth") + 1).alias("depth"), F.concat("_steps", "path_steps").alias("path_steps"))
        walk = cut_lineage(walk.filter("_up IS NULL").unionByName(climbed))
        arrived = walk.filter("_up IS NULL").count()
        if arrived == there:
            break
        there = arrived
    found = walk.filter("_up IS NULL").drop("_up")
    if max_depth is not None and (found.agg(F.max("depth")).first()[0] or 0) > max_depth:
        raise ValueError(f"the tree is deeper than {max_depth} levels")
    return nodes.join(found, F.col(node_id) == F.col("_id")).select(*nodes.columns, "depth", "path_steps")
