"""Joining texts with the names they contain."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from memograph.plans.bounded import is_small

WINDOW = 1000
#: Lengths of the runs that needles are looked up by; a needle takes the longest that fits in it.
RUNS = (1, 2, 3, 8)
#: Most needles of the same keys that are tested against every text.
FEW = 500


def grams(rows: DataFrame, text: Column, columns: Sequence[str | Column]) -> DataFrame:
    """The columns with _gram, a row for each distinct run of the text of one of the lengths, and the empty one.

    Long texts are cut into overlapping windows first, because finding a place in a text
    takes time in proportion to it.
    """
    starts = F.sequence(F.lit(1), F.greatest(F.length("_text"), F.lit(1)), F.lit(WINDOW))
    windows = rows.select(*columns, text.alias("_text")).withColumn(
        "_window", F.explode(F.transform(starts, lambda at: F.substring(F.col("_text"), at, F.lit(WINDOW + max(RUNS) - 1))))).drop("_text")
    n = F.length("_window")

    def of(size: int) -> Column:
        runs = F.transform(F.sequence(F.lit(1), F.greatest(n - size + 1, F.lit(1))), lambda at: F.substring(F.col("_window"), at, F.lit(size)))
        return F.when(n >= size, runs).otherwise(F.array().cast("array<string>"))

    every = F.array_distinct(F.concat(F.array(F.lit("")), *map(of, RUNS)))
    return windows.withColumn("_gram", F.explode(every)).drop("_window").distinct()


def few(needles: DataFrame, keys: Sequence[str]) -> bool:
    """Whether the table is small and no keys hold many of its rows."""
    return is_small(needles) and (needles.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0) <= FEW


def containing(texts: DataFrame, text: Column, needles: DataFrame, needle: Column, keys: Sequence[str], small: bool | None = None) -> DataFrame:
    """Rows of texts with each row of needles, of the same keys, whose needle they contain.

    A table of needles that is measured small, with few needles a text, is broadcast and the
    texts are scanned in place. Beyond that each needle is looked up by one of its runs of eight characters (of
    three if it is shorter, or the whole needle), the one that the fewest texts hold: runs of
    three alone are shared by a fixed part of all texts, so what is tested would grow with the square. What travels for it
    is a hash of each text with its runs, of those runs only that needles have; a text itself
    moves once, to the needles that its hash was found for, and the whole needle is tested
    there. Column names other than the keys must differ. Null texts and needles match nothing.
    """
    if few(needles, keys) if small is None else small:
        return texts.join(F.broadcast(needles), list(keys)).filter(F.contains(text, needle))
    keys = list(keys)
    mark = F.xxhash64(text).alias("_mark")
    wanted = needles.select(*keys, needle.alias("_needle")).filter("_needle IS NOT NULL").distinct()
    n = F.length("_needle")

    def runs(size: int) -> Column:
        return F.transform(F.sequence(F.lit(1), F.greatest(n - size + 1, F.lit(1))), lambda at: F.substring(F.col("_needle"), at, F.lit(size)))

    own = F.when(n < 3, F.array("_needle")).when(n < 8, runs(3)).otherwise(runs(8))
    spelt = wanted.select(*keys, "_needle", F.explode(F.array_distinct(own)).alias("_gram"))
    held = grams(texts.filter(text.isNotNull()), text, [*keys, mark]).join(spelt.select(*keys, "_gram").distinct(), [*keys, "_gram"], "left_semi")
    counted = held.groupBy(*keys, "_gram").agg(F.count(F.lit(1)).alias("_n"))
    # A needle with a run that no text holds occurs nowhere.
    rarest = spelt.join(counted, [*keys, "_gram"], "left").groupBy(*keys, "_needle").agg(
        F.min_by("_gram", F.struct("_n", "_gram")).alias("_gram"), F.count_if(F.col("_n").isNull()).alias("_absent")).filter("_absent = 0")
    found = held.join(rarest.select(*keys, "_needle", "_gram"), [*keys, "_gram"]).select(*keys, "_mark", "_needle")
    met = texts.withColumns({"_mark": mark, "_text": text}).join(found, [*keys, "_mark"]).filter(F.contains("_text", F.col("_needle"))).drop("_mark", "_text")
    return met.join(needles.withColumn("_needle", needle), [*keys, "_needle"]).drop("_needle")
