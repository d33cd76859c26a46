"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Each document draws an exponential key, scaled by its quality weight: smaller keys come
first, and a document of twice the weight is twice as likely to come before another.
Documents are ordered by key within their source and prefix-summed against the source's
token budget. A budget above the source's size takes complete epochs first; only the rest
of it is selected by the order. Sums run over range partitions and their totals, so a
source with a third of all rows is spread over many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from memograph.llm.common import WORD, partitions, stored

#: Characters that lower a document's quality weight when they are frequent.
SYMBOLS = "#$%&*|!@=~^<>{}[]\\/_+0123456789"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def quality_weight(text: Column) -> Column:
    """1 for plain prose, down to 0.05 where symbols and digits stand for all letters; 1 for empty texts."""
    letters, chars = F.length(F.translate(text, SYMBOLS, "")), F.length(text)
    return F.coalesce(F.when(chars > 0, F.greatest(F.lit(0.05), letters / chars)), F.lit(1.0))


def draw(key: Column, seed: int) -> Column:
    """A repeatable number in (0, 1) from 52 bits of a digest."""
    bits = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit("null"))).cast("binary")), 1, 13), 16, 10)
    return (bits.cast("double") + 0.5) / F.lit(float(1 << 52))


def targets(rows: DataFrame, weights: list[float], share: float, max_epochs: float) -> DataFrame:
    """(source, source_size, target): sources in code point order, null last, take the weights in turn.

    The budget is `share` of all sizes. A source stops at `max_epochs` times its size and
    the excess goes to the others by weight: all that are not full share one level
    (target = level * weight), which is found on the sources sorted by the level that
    fills them. One row per source is handled here, never the documents.
    """
    sizes = rows.groupBy("source").agg(F.sum("size").cast("double").alias("source_size"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (((F.row_number().over(order) - 1) % len(weights)) + 1).cast("int"))
    caps = sizes.withColumn("weight", weight).withColumn("cap", F.col("source_size") * max_epochs)
    by_fill = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_first())
    everything = Window.partitionBy()
    before = by_fill.rowsBetween(Window.unboundedPreceding, -1)
    levelled = caps.withColumn("level", (
        F.sum("source_size").over(everything) * share - F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
        / (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))))
    # The first source that its level does not fill sets the level of all.
    first = F.min_by(F.col("level"), F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.col("cap") / F.col("weight"))).over(everything)
    return levelled.select("source", F.col("source_size").cast("long").alias("source_size"),
                           F.least(F.col("cap"), F.coalesce(first, F.lit(float("inf"))) * F.col("weight")).alias("target"))


def mix(docs: DataFrame, weights: list[float], share: float = 1.0, max_epochs: float = 3.0, seed: int = 1, cut: bool = True,
        id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", quality: Column | None = None) -> DataFrame:
    """One row per row of docs: (id, mark, source, size, source_size, target, taken).

    taken counts the words the mix takes, repeats included: complete epochs of the whole
    source, then documents in key order up to the budget. The document at the budget's end
    gives the words that are left (cut), or counts whole when at least half of it fits.
    Null texts have size 0 and are taken 0 words; a null source is a source of its own, last
    in order. Ties and repeated rows are settled by id, text hash and row, and each row has
    its result. A null or non-positive quality weight counts as the smallest. Other columns
    are ignored. Reruns agree. No rows give no rows.
    """
    weight = F.greatest(F.coalesce(quality_weight(F.col(text_col)) if quality is None else quality, F.lit(0.0)), F.lit(1e-9))
    # Written once: the range partitioning samples its input, and texts are not to be read twice for it.
    rows = stored(docs.select(
        F.col(id_col).alias("id"), F.xxhash64(text_col).alias("mark"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"),
        (-F.log(draw(F.col(id_col), seed)) / weight).alias("key")))
    order = ["source", "key", "id", "mark"]
    ranged = stored(rows.repartitionByRange(partitions(docs.sparkSession), *order).sortWithinPartitions(*order).select(
        "*", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("row")))
    budget = targets(ranged, weights, share, max_epochs)
    totals = ranged.groupBy("source", "part").agg(F.sum("size").alias("words"))
    ahead = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.withColumn("ahead", F.coalesce(F.sum("words").over(ahead), F.lit(0)))
    offsets = offsets.join(budget, offsets["source"].eqNullSafe(budget["source"])).select(
        offsets["source"].alias("s"), offsets["part"].alias("p"), "ahead", "source_size", "target")
    within = Window.partitionBy("part", "source").orderBy("row").rowsBetween(Window.unboundedPreceding, -1)
    placed = ranged.withColumn("before", F.coalesce(F.sum("size").over(within), F.lit(0))).join(
        offsets, (F.col("part") == F.col("p")) & F.col("source").eqNullSafe(F.col("s")))
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    left = F.round(F.col("target") - epochs * F.col("source_size")).cast("long") - F.col("ahead") - F.col("before")
    last = F.greatest(F.lit(0).cast("long"), F.least(F.col("size"), left)) if cut else F.when(
        (F.col("size") > 0) & (left * 2 >= F.col("size")), F.col("size")).otherwise(F.lit(0).cast("long"))
    return placed.select(F.col("id").alias(id_col), "mark", F.col("source").alias(source_col), "size", "source_size", "target",
                         (epochs * F.col("size") + last).alias("taken"))


def take(docs: DataFrame, weights: list[float], id_col: str = "doc_id", text_col: str = "text", **params) -> DataFrame:
    """The mix itself: each row of docs as often as it is taken, whole; documents without words stay once.

    Columns are those of docs. Repeated rows (same id and text) are taken together.
    """
    plan = mix(docs, weights, cut=False, id_col=id_col, text_col=text_col, **params)
    times = plan.groupBy(F.col(id_col).alias("__id"), F.col("mark").alias("__mark")).agg(
        F.max(F.when(F.col("size") > 0, F.col("taken") / F.col("size")).otherwise(1)).cast("int").alias("__times")).filter("__times > 0")
    keyed = docs.withColumn("__mark", F.xxhash64(text_col))
    hit = keyed.join(times, keyed[id_col].eqNullSafe(times["__id"]) & (keyed["__mark"] == times["__mark"]))
    return hit.select(*[keyed[c] for c in docs.columns], F.explode(F.sequence(F.lit(1), F.col("__times"))).alias("__copy")).drop("__copy")
