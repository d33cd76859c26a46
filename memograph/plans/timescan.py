"""Ordered computations over long event sequences without one task per key.

A window partitioned by workspace alone would sort a hot workspace in a single
task. Here every sequence is first reduced to one row per instant or per time
cell (map-side combined), the order-dependent step runs inside a cell, and only
one small row per cell is carried along the whole sequence.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HOUR_US = 3_600_000_000


def micros(ts: str | Column) -> Column:
    return F.unix_micros(F.col(ts) if isinstance(ts, str) else ts)


def cell_of(us: str | Column, width_us: int) -> Column:
    us = F.col(us) if isinstance(us, str) else us
    return F.floor(us / F.lit(width_us)).cast("long")


def session_cells(
    df: DataFrame, keys: Sequence[str], ts: str, gap_us: int, extra: Sequence[Column] = ()
) -> DataFrame:
    """One row per (keys, cell) with its 1-based session number.

    Cells are exactly one gap wide, so all rows of a cell belong to one session
    and the running count only has to visit span/gap rows per key, however many
    events a cell holds.
    """
    us = micros(ts)
    cells = df.filter(F.col(ts).isNotNull()).groupBy(*keys, cell_of(us, gap_us).alias("cell")).agg(
        F.min(us).alias("lo_us"), F.max(us).alias("hi_us"), F.count(F.lit(1)).alias("n"), *extra
    )
    w = Window.partitionBy(*keys).orderBy("cell")
    previous = F.lag("hi_us").over(w)
    opens = F.when(previous.isNull() | (F.col("lo_us") - previous > gap_us), 1).otherwise(0)
    return cells.withColumn("_opens", opens).withColumn(
        "session_no", F.sum("_opens").over(w.rowsBetween(Window.unboundedPreceding, 0))
    ).drop("_opens")


def attach_sessions(df: DataFrame, cells: DataFrame, keys: Sequence[str], ts: str, gap_us: int) -> DataFrame:
    """Give every row its session number by looking up its cell."""
    return (
        df.filter(F.col(ts).isNotNull())
        .withColumn("cell", cell_of(micros(ts), gap_us))
        .join(cells.select(*keys, "cell", "session_no"), [*keys, "cell"])
        .drop("cell")
    )


def previous_instants(df: DataFrame, keys: Sequence[str], ts: str, tie: str, cell_us: int = HOUR_US) -> DataFrame:
    """Per distinct instant of a key: first row at it (by tie) and the instant before."""
    instants = (
        df.filter(F.col(ts).isNotNull())
        .groupBy(*keys, micros(ts).alias("us"))
        .agg(F.min(tie).alias("first_id"))
        .withColumn("cell", cell_of("us", cell_us))
    )
    last = instants.groupBy(*keys, "cell").agg(F.max("us").alias("cell_last"))
    carry = last.select(
        *keys, "cell", F.lag("cell_last").over(Window.partitionBy(*keys).orderBy("cell")).alias("carried")
    )
    inside = F.lag("us").over(Window.partitionBy(*keys, "cell").orderBy("us"))
    return (
        instants.withColumn("_inside", inside)
        .join(carry, [*keys, "cell"])
        .select(*keys, "us", "first_id", F.coalesce("_inside", "carried").alias("previous_us"))
    )


def running_sums(
    points: DataFrame, keys: Sequence[str], sums: Sequence[str], cell_us: int = HOUR_US
) -> DataFrame:
    """Inclusive running totals over (us, rank) per key.

    Input columns: keys, us, rank (order among equal instants) and the summed
    columns. Rows at the same (us, rank) are merged first, so a mass of equal
    timestamps is one row before anything is sorted.
    """
    merged = (
        points.groupBy(*keys, "us", "rank")
        .agg(*[F.sum(c).alias(c) for c in sums])
        .withColumn("cell", cell_of("us", cell_us))
    )
    totals = merged.groupBy(*keys, "cell").agg(*[F.sum(c).alias(c) for c in sums])
    before = Window.partitionBy(*keys).orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    carry = totals.select(
        *keys, "cell", *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"_{c}") for c in sums]
    )
    inside = Window.partitionBy(*keys, "cell").orderBy("us", "rank").rowsBetween(Window.unboundedPreceding, 0)
    local = merged.select(*keys, "cell", "us", "rank", *[F.sum(c).over(inside).alias(c) for c in sums])
    return local.join(carry, [*keys, "cell"]).select(
        *keys, "us", "rank", *[(F.col(c) + F.col(f"_{c}")).alias(c) for c in sums]
    )


def count_following(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    ts: str,
    width_us: int,
    measures: dict[str, Column],
    cell_us: int = HOUR_US,
) -> DataFrame:
    """For each left row, sum measures of right rows with left.ts <= right.ts <= left.ts + width.

    A sweep over running totals: linear in both inputs, no pairs are formed.
    """
    names = list(measures)
    zeros = [F.lit(0).cast("long").alias(m) for m in names]
    base = left.withColumn("_us", micros(ts))
    instants = base.filter(F.col("_us").isNotNull()).select(*keys, "_us").distinct()
    opening = instants.select(*keys, F.col("_us").alias("us"), F.lit(0).alias("rank"), *zeros)
    closing = instants.select(*keys, (F.col("_us") + width_us).alias("us"), F.lit(2).alias("rank"), *zeros)
    inner = right.filter(F.col(ts).isNotNull()).select(
        *keys, micros(ts).alias("us"), F.lit(1).alias("rank"),
        *[e.cast("long").alias(m) for m, e in measures.items()],
    )
    totals = running_sums(opening.unionByName(closing).unionByName(inner), keys, names, cell_us)
    spans = (
        totals.filter("rank <> 1")
        .withColumn("_us", F.when(F.col("rank") == 0, F.col("us")).otherwise(F.col("us") - width_us))
        .groupBy(*keys, "_us")
        .agg(*[
            F.sum(F.when(F.col("rank") == 2, F.col(m)).otherwise(-F.col(m))).alias(m) for m in names
        ])
    )
    joined = base.join(spans, [*keys, "_us"], "left").drop("_us")
    for m in names:
        joined = joined.withColumn(m, F.coalesce(m, F.lit(0)))
    return joined


def carry_last(
    rows: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    value: str,
    us: str,
    cell_us: int = HOUR_US,
) -> DataFrame:
    """Adds the last non-null value strictly before each row (struct or scalar), across cells."""
    celled = rows.withColumn("cell", cell_of(us, cell_us))
    lasts = celled.filter(F.col(value).isNotNull()).groupBy(*keys, "cell").agg(
        F.max_by(value, F.struct(*order)).alias("_last")
    )
    cells = celled.select(*keys, "cell").distinct().join(lasts, [*keys, "cell"], "left")
    before = Window.partitionBy(*keys).orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    carry = cells.select(*keys, "cell", F.last("_last", ignorenulls=True).over(before).alias("_carried"))
    inside = Window.partitionBy(*keys, "cell").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return (
        celled.withColumn("_inside", F.last(value, ignorenulls=True).over(inside))
        .join(carry, [*keys, "cell"])
        .withColumn(f"previous_{value}", F.coalesce("_inside", "_carried"))
        .drop("_inside", "_carried", "cell")
    )


def ending_at_counts(
    df: DataFrame, keys: Sequence[str], ts: str, width_us: int, cell_us: int = HOUR_US
) -> DataFrame:
    """Rows of a key in [us - width, us] for each distinct instant: a rolling count with no range frame."""
    base = df.filter(F.col(ts).isNotNull()).select(*keys, micros(ts).alias("us"))
    enters = base.select(*keys, "us", F.lit(0).alias("rank"), F.lit(1).cast("long").alias("n"))
    leaves = base.select(*keys, (F.col("us") + width_us).alias("us"), F.lit(1).alias("rank"),
                         F.lit(-1).cast("long").alias("n"))
    return running_sums(enters.unionByName(leaves), keys, ["n"], cell_us).filter("rank = 0").drop("rank")
