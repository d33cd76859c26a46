"""Interval join as an equi-join on time bins."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from memograph.plans.timescan import cell_of, micros


def follow_join(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    left_ts: str,
    right_ts: str,
    width_us: int,
    bins_per_width: int = 4,
) -> DataFrame:
    """Pairs with left_ts <= right_ts <= left_ts + width, joined on (keys, bin).

    Every right row sits in one bin; a left row visits each bin its interval
    touches, so a pair appears once. Bins are narrower than the interval to keep
    non-matching candidates few; adaptive skew handling splits a hot bin.
    """
    bin_us = max(width_us // bins_per_width, 1)
    first = cell_of(micros(left_ts), bin_us)
    final = cell_of(micros(left_ts) + width_us, bin_us)
    visiting = left.filter(F.col(left_ts).isNotNull()).withColumn("_bin", F.explode(F.sequence(first, final)))
    sitting = right.filter(F.col(right_ts).isNotNull()).withColumn("_bin", cell_of(micros(right_ts), bin_us))
    gap = micros(right_ts) - micros(left_ts)
    return visiting.join(sitting, [*keys, "_bin"]).filter((gap >= 0) & (gap <= width_us)).drop("_bin")


def in_reach(rows: DataFrame, ts: str, of: DataFrame, of_ts: str, keys: Sequence[str], width_us: int, after: bool) -> DataFrame:
    """The rows that may lie up to the width after (or before) some row of `of`: all that do, and others of the same cells.

    Only the cells of `of` travel, each once, so rows that meet many of them are not multiplied.
    """
    own = cell_of(micros(of_ts), width_us)
    cells = of.filter(F.col(of_ts).isNotNull()).select(*keys, F.explode(F.array(own, own + (1 if after else -1))).alias("_cell")).distinct()
    return rows.withColumn("_cell", cell_of(micros(ts), width_us)).join(cells, [*keys, "_cell"], "left_semi").select(*rows.columns)
