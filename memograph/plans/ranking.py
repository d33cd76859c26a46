"""Order over many rows without a single-task window: range partitions, then prefix counts and sums."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from itertools import accumulate
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from memograph.session import cut_lineage

IN_PARTITION_BITS = 33  # of monotonically_increasing_id


def with_rank(rows: DataFrame, order: Sequence[Column], name: str = "rank") -> DataFrame:
    """Each row with its place, from 1, in the order over all rows.

    Sampled splitters range-partition the rows, every partition sorts its own, and only the
    number of rows of each partition passes through the driver. Rows that the order does
    not tell apart follow each other in one partition, so the order should end in a key.
    Rows are written once in between: the places stay what they are when an executor is lost.
    """
    spark = rows.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    at, of, ahead = (f"{c}_{'_'.join(rows.columns)}" for c in ("at", "of", "ahead"))  # longer than any column's name
    placed = cut_lineage(rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn(at, F.monotonically_increasing_id()))
    part = F.shiftright(at, IN_PARTITION_BITS).cast("int")
    counts = {r["part"]: r["n"] for r in placed.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n")).collect()}
    used = sorted(counts)
    offsets = spark.createDataFrame(list(zip(used, accumulate((counts[p] for p in used), initial=0))), f"`{of}` int, `{ahead}` long")
    numbered = placed.join(F.broadcast(offsets), part == F.col(f"`{of}`"))
    inside = F.col(at).bitwiseAND((1 << IN_PARTITION_BITS) - 1)
    return numbered.select(*rows.columns, (F.col(ahead) + inside + 1).alias(name))


def page(rows: DataFrame, order: Sequence[Column], limit: int, offset: int = 0, name: str = "rank") -> DataFrame:
    """The `limit` rows after the first `offset` of the order, with their places."""
    return with_rank(rows, order, name).filter(F.col(name).between(offset + 1, offset + limit))


def with_running_total(rows: DataFrame, keys: Sequence[str], order: Sequence[Column], value: Column, name: str = "before") -> DataFrame:
    """Each row with the sum of `value` over the rows before it in its group.

    Range partitions hold consecutive rows of the order (keys, then `order`), so a large group
    is spread over many; a row adds what earlier partitions hold of its group to what stands
    before it in its own. The order tells the rows of a group apart. Keys match null-safely.
    """
    spark = rows.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    at, part, added = (f"{c}_{'_'.join(rows.columns)}" for c in ("at", "part", "added"))
    by = [*[F.col(k) for k in keys], *order]
    placed = cut_lineage(rows.withColumn(added, F.coalesce(value.cast("long"), F.lit(0))).repartitionByRange(parts, *by).sortWithinPartitions(*by).withColumn(
        at, F.monotonically_increasing_id()).withColumn(part, F.shiftright(at, IN_PARTITION_BITS).cast("int")))
    held = placed.groupBy(*keys, part).agg(F.sum(added).alias("held"))
    earlier = Window.partitionBy(*keys).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    ahead = held.select(*[F.col(k).alias(f"k{n}") for n, k in enumerate(keys)], F.col(part).alias("p"), F.coalesce(F.sum("held").over(earlier), F.lit(0)).alias("ahead"))
    inside = Window.partitionBy(part, *keys).orderBy(at).rowsBetween(Window.unboundedPreceding, -1)
    summed = placed.withColumn(name, F.coalesce(F.sum(added).over(inside), F.lit(0)))
    same = reduce(and_, [F.col(k).eqNullSafe(F.col(f"k{n}")) for n, k in enumerate(keys)], F.col(part) == F.col("p"))
    return summed.join(ahead, same).select(*rows.columns, (F.col(name) + F.col("ahead")).alias(name))
