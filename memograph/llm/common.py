"""Helpers shared by the training-data operators."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from memograph.session import prepare, run_folder

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: A word is a run of characters that are not ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame) -> DataFrame:
    """Write a table that several branches read to the shared folder, and read it back."""
    path = run_folder(df.sparkSession, "llm")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only; null counts as empty."""
    return F.translate(F.coalesce(text, F.lit("")), UPPER, UPPER.lower())


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of an undirected edge list (a, b): root is the smallest node reachable.

    Alternating large-star and small-star steps: rounds grow with the logarithm of a
    component's size, every step is one shuffle on the node, and each step's edges
    are written to the shared folder. A node with many neighbours never meets them in
    one row: minima are aggregated before the shuffle and joined back.
    """
    spark = edges.sparkSession

    def star(e: DataFrame, large: bool) -> DataFrame:
        """Large: neighbours above the node go to the smallest of all. Small: those below it do."""
        both = e if not large else e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("low")).select("a", F.least("a", "low").alias("low"))
        joined = both.join(low, "a")
        if large:
            return joined.filter("b > a").select(F.col("b").alias("a"), F.col("low").alias("b"))
        own = low.filter("low <> a").select("a", F.col("low").alias("b"))
        return joined.filter("b <> low").select(F.col("b").alias("a"), F.col("low").alias("b")).unionByName(own)

    def tidy(e: DataFrame) -> DataFrame:
        return e.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()

    current = stored(tidy(edges.select("a", "b")))
    mark = None
    for _ in range(max_rounds):
        following = stored(tidy(star(tidy(star(current, large=True)), large=False)))
        state = following.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        current = following
        if tuple(state) == mark:
            break
        mark = tuple(state)
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    # Settled edges form stars: each node points at its root.
    roots = current.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return current.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots)


def blocks_for(rows: int, size: int) -> int:
    return max(1, math.ceil(rows / size))
