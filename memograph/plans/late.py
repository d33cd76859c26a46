"""The first rows of each question that pass a filter too dear to run over all of them."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from memograph.plans.bounded import broadcast_if_small
from memograph.session import cut_lineage


def first_passing(
    rows: DataFrame, questions: DataFrame, keys: Sequence[str], question_id: str, order: Sequence[Column], limit: str,
    passes: Callable[[DataFrame], DataFrame], factor: int = 2,
) -> DataFrame:
    """The first rows by `order` of each question, up to its `limit`, that `passes` keeps; with their rank.

    rows and questions share the keys. A round fetches the next rows of every question that is
    neither full nor at its end: `factor` times the limit first, twice as many each further
    round, so the rounds grow with the logarithm of what is rejected. The place of the last
    row fetched is kept as the threshold below which the next round begins. Questions of the
    same keys that stand at the same threshold share one fetch: all rows are ordered by keys and
    place alone, not once a question, and only those up to the last place wanted meet the
    questions. `passes` gets fetched rows with their question's columns and returns some of
    them. The order tells the rows of a question apart, and its values are not null; a limit
    below 1 gives no rows.
    """
    columns, keys = list(dict.fromkeys([*questions.columns, *rows.columns])), list(keys)
    place = F.struct(*[c.alias(f"o{n}") for n, c in enumerate(order)])
    by_place = Window.partitionBy(question_id).orderBy("_place")
    placed = rows.withColumn("_place", place)
    none = F.lit(None).cast(placed.schema["_place"].dataType)
    open_ = questions.filter(F.col(limit) > 0).select("*", (F.col(limit) * factor).cast("long").alias("_fetch"), none.alias("_last"))
    ahead = Window.partitionBy(*keys, "_last").orderBy("_place")
    found = None
    while True:
        # A literal bound lets the group limit run before the shuffle; the keys' and the question's own cut it further.
        most = open_.agg(F.max("_fetch")).first()[0]
        if most is None:
            break
        starts = broadcast_if_small(open_.groupBy(*keys, "_last").agg(F.max("_fetch").alias("_most")))
        below = F.col("_last").isNull() | (F.col("_place") > F.col("_last"))
        reached = placed.select(*keys, "_place").join(starts, keys).filter(below).withColumn("_n", F.row_number().over(ahead))
        spans = cut_lineage(reached.filter((F.col("_n") <= most) & (F.col("_n") <= F.col("_most"))).groupBy(*keys, "_last").agg(F.max("_place").alias("_to")))
        held = placed.join(broadcast_if_small(spans), keys).filter(below & (F.col("_place") <= F.col("_to"))).drop("_to")
        met = held.join(open_.withColumnRenamed("_last", "_from"), keys).filter(F.col("_last").eqNullSafe(F.col("_from"))).drop("_last", "_from")
        ranked = met.withColumn("_n", F.row_number().over(by_place)).filter((F.col("_n") <= most) & (F.col("_n") <= F.col("_fetch")))
        fetched = cut_lineage(ranked)
        kept = cut_lineage(passes(fetched.drop("_n", "_fetch")).select(*columns, "_place"))
        found = kept if found is None else found.unionByName(kept)
        state = fetched.groupBy(question_id).agg(F.max("_place").alias("_last"), F.count(F.lit(1)).alias("_got"))
        full = found.groupBy(question_id).agg(F.count(F.lit(1)).alias("_full"))
        open_ = cut_lineage(open_.drop("_last").join(state, question_id).join(full, question_id, "left").filter(
            (F.col("_got") == F.col("_fetch")) & (F.coalesce("_full", F.lit(0)) < F.col(limit))).drop("_got", "_full").withColumn(
                "_fetch", F.col("_fetch") * 2))
        if open_.isEmpty():
            break
    if found is None:
        return rows.join(questions, list(keys)).select(*columns).limit(0).withColumn("rank", F.lit(0))
    return found.withColumn("rank", F.row_number().over(by_place)).filter(F.col("rank") <= F.col(limit)).drop("_place")
