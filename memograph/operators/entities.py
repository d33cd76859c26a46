"""Entity mentions, chunk payloads and co-occurrence."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from memograph import vocab
from memograph.functions import text

LINK_TYPES = ["person", "project", "system"]
LINKS = "array<struct<type:string,target:string,target_type:string>>"


def tag(chunks: DataFrame, body: str = "text", projects: Sequence[str] = vocab.PROJECT_WORDS) -> DataFrame:
    """Adds entity_details, a mention list per text."""
    return chunks.withColumn("entity_details", text.mentions(F.coalesce(F.col(body), F.lit("")), projects))


def payload(tagged: DataFrame) -> DataFrame:
    """Chunk payload: entity names with document tags, and outgoing links."""
    names = F.transform("entity_details", lambda m: m["name"])
    parent = F.when(
        F.nullif("parent_id", F.lit("")).isNotNull(),
        F.array(F.struct(F.lit("child_of").alias("type"), F.col("parent_id").alias("target"),
                         F.lit("document").alias("target_type"))),
    ).otherwise(F.array().cast(LINKS))
    links = F.transform(
        F.filter("entity_details", lambda m: m["type"].isin(LINK_TYPES)),
        lambda m: F.struct(F.concat(F.lit("references_"), m["type"]).alias("type"), m["name"].alias("target"),
                           m["type"].alias("target_type")),
    )
    tags = F.coalesce("tags", F.array().cast("array<string>"))
    return tagged.withColumns({
        "entities": F.array_union(names, tags), "relationships": F.concat(parent, links.cast(LINKS)),
    })


def mention_rows(tagged: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row per mention with its position.

    The inner filter keeps the optimizer from deriving a size test that would
    evaluate the tagger a second time.
    """
    named = F.filter("entity_details", lambda m: m["name"].isNotNull())
    return tagged.select(*keys, F.posexplode(named).alias("position", "m")).select(
        *keys, "position", F.col("m.name").alias("name"), F.col("m.type").alias("type"))


def pairs_of(names: Column) -> Column:
    """Unordered pairs of one text's distinct names, the smaller first; names equal without case do not pair."""
    ordered = F.array_sort(F.array_distinct(names))
    return F.flatten(F.transform(
        ordered,
        lambda a, i: F.transform(
            F.filter(F.slice(ordered, i + 2, F.size(ordered)), lambda b: F.lower(a) != F.lower(b)),
            lambda b: F.struct(a.alias("entity_a"), b.alias("entity_b")),
        ),
    ))


def cooccurrence(chunks: DataFrame, names: str = "entities", ts: str = "ts", slot: str | None = None, tasks: int | None = None) -> DataFrame:
    """How often two names share a chunk, and when last.

    Pairs are formed inside a row and summed map-side, so frequent pairs travel
    as one row per task. Chunks that are dealt by a column `slot` are summed by slot where
    they lie, and the slots' sums by `tasks` tasks; what a task holds is then as much as a slot
    and a task are given, however many pairs there are in all.
    """
    keys = ["workspace_id", "entity_a", "entity_b"]
    dealt = [] if slot is None else [slot]
    pairs = chunks.select(*dealt, "workspace_id", F.col(ts).alias("ts"), F.explode(pairs_of(F.col(names))).alias("p"))
    summed = pairs.groupBy(*dealt, "workspace_id", "p.entity_a", "p.entity_b").agg(
        F.count(F.lit(1)).cast("double").alias("score"), F.max("ts").alias("last_seen"))
    if slot is None:
        return summed
    return summed.repartition(tasks, "entity_a", "entity_b").groupBy(*keys).agg(F.sum("score").alias("score"), F.max("last_seen").alias("last_seen"))


def cooccurrence_neighbours(pairs: DataFrame) -> DataFrame:
    """Both directions of every pair: an entity with each of its neighbours. The pairs are computed once."""
    ends = F.array(F.struct(F.col("entity_a").alias("entity"), F.col("entity_b").alias("neighbour")),
                   F.struct(F.col("entity_b").alias("entity"), F.col("entity_a").alias("neighbour")))
    return pairs.select("workspace_id", F.explode(ends).alias("e"), "score").select("workspace_id", "e.entity", "e.neighbour", "score")
