"""Keyed writes expressed as aggregations: newest wins, richest wins, first wins.

All of them combine map-side, so a hot key costs one row per task.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from memograph.plans import timescan
from memograph.plans.timescan import micros

MINUTES_5 = 300_000_000


def keep_by(rows: DataFrame, keys: Sequence[str | Column], order: Sequence[str | Column], newest: bool) -> DataFrame:
    """One whole row per key, the first or last by the given order."""
    whole = F.struct(*rows.columns)
    rank = F.struct(*order)
    pick = F.max_by(whole, rank) if newest else F.min_by(whole, rank)
    return rows.groupBy(*keys).agg(pick.alias("_row")).select("_row.*")


def replace_rows(current: DataFrame, incoming: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Insert-or-replace: incoming rows win, the newest of them per key."""
    kept = current.join(incoming.select(*keys).distinct(), list(keys), "left_anti")
    return kept.unionByName(keep_by(incoming, keys, order, newest=True))


def insert_missing(current: DataFrame, incoming: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Insert-or-ignore: only keys not present yet are added, the first of each."""
    fresh = incoming.join(current.select(*keys), list(keys), "left_anti")
    return current.unionByName(keep_by(fresh, keys, order, newest=False))


def merged_metadata(rows: DataFrame, keys: Sequence[str], metadata: str, order: Column) -> DataFrame:
    """(keys, metadata): the JSON objects of a group as one, the last row by `order` winning each name.

    Objects are taken apart into one row per name, so a group never meets in a list: per
    (group, name) one value is kept, map-side first, and only the names of a group, each
    once, come together. Values keep their JSON types; names are sorted. Text that is no
    object counts as empty, and a group without names has no row. Keys match null-safely
    through grouping alone.
    """
    named = rows.select(*keys, order.alias("_order"), F.explode(F.from_json(metadata, "map<string,variant>")).alias("_name", "_value"))
    # Equal times are settled by the value itself.
    value = F.to_json("_value")
    newest = named.groupBy(*keys, "_name").agg(F.max_by(value, F.struct("_order", value)).alias("_value"))
    entries = F.array_sort(F.collect_list(F.struct("_name", "_value")))
    typed = F.transform(entries, lambda e: F.struct(e["_name"], F.parse_json(e["_value"])))
    return newest.groupBy(*keys).agg(F.to_json(F.map_from_entries(typed)).alias("metadata"))


def with_metadata(merged: DataFrame, rows: DataFrame, keys: Sequence[str], metadata: str, order: Column) -> DataFrame:
    """Merged rows with the metadata of all rows of their keys; an empty object where there is none."""
    found = merged_metadata(rows, keys, metadata, order)
    found = found.select(*[F.col(k).alias(f"_k{n}") for n, k in enumerate(keys)], F.col("metadata").alias("_merged"))
    same = reduce(and_, [F.col(k).eqNullSafe(F.col(f"_k{n}")) for n, k in enumerate(keys)])
    return merged.drop("metadata").join(found, same, "left").withColumn("metadata", F.coalesce("_merged", F.lit("{}"))).drop(
        "_merged", *[f"_k{n}" for n in range(len(keys))])


def upsert_events(events: DataFrame, tolerance_us: int = MINUTES_5) -> DataFrame:
    """Merge events of equal title, type and workspace that follow each other within the tolerance.

    The earliest row gives id and time, gaps in description and severity are
    filled from later rows, confidence is the maximum, and metadata are merged,
    later rows winning a name. Rows without a time join the earliest group of
    their key and count as its latest.
    """
    keyed = events.withColumn("title_key", F.lower(F.trim("title")))
    keys = ["workspace_id", "event_type", "title_key"]
    cells = timescan.session_cells(keyed, keys, "ts", tolerance_us)
    timed = timescan.attach_sessions(keyed, cells, keys, "ts", tolerance_us)
    untimed = keyed.filter(F.col("ts").isNull()).withColumn("session_no", F.lit(1).cast("long"))
    numbered = timed.unionByName(untimed.select(*timed.columns))
    order = F.struct(F.coalesce(micros("ts"), F.lit(1 << 62)), "event_id")
    merged = numbered.groupBy(*keys, "session_no").agg(
        F.min_by("event_id", order).alias("event_id"),
        F.min_by("title", order).alias("title"),
        F.min("ts").alias("ts"),
        F.min_by("description", F.when(F.col("description").isNotNull(), order)).alias("description"),
        F.min_by("severity", F.when(F.col("severity").isNotNull(), order)).alias("severity"),
        F.max("confidence").alias("confidence"),
        F.min_by("chunk_id", order).alias("chunk_id"),
        F.count(F.lit(1)).alias("merged_rows"),
    )
    return with_metadata(merged, numbered, [*keys, "session_no"], "metadata", order)


def upsert_edges(edges: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One edge per key: maximum confidence, distinct evidence lines in order of arrival.

    Rows are reduced to one per key and evidence line first, so the lists hold
    distinct lines only. A line contained in an earlier one adds nothing.
    """
    line = F.nullif(F.col("evidence"), F.lit(""))
    per_line = edges.groupBy(*keys, line.alias("_line")).agg(
        F.max("confidence").alias("confidence"), F.count(F.lit(1)).alias("n"), F.min("seen_at").alias("first_seen"))
    grouped = per_line.groupBy(*keys).agg(
        F.max("confidence").alias("confidence"), F.sum("n").alias("merged_rows"),
        F.array_sort(F.collect_list(F.when(F.col("_line").isNotNull(), F.struct("first_seen", "_line")))).alias("lines"))
    merged = F.aggregate(
        F.transform("lines", lambda l: l["_line"]), F.lit(None).cast("string"),
        lambda acc, one: F.when(acc.isNull(), one).when(F.contains(acc, one), acc).otherwise(F.concat(acc, F.lit("\n"), one)))
    return grouped.select(*keys, "confidence", "merged_rows", merged.alias("evidence"))


def upsert_event_edges(edges: DataFrame) -> DataFrame:
    return edges.groupBy("workspace_id", "source_event_id", "target_event_id", "relationship_type").agg(
        F.max("confidence").alias("confidence")
    )


def upsert_insights(insights: DataFrame) -> DataFrame:
    """Newest insight per lower-cased title, type and workspace, with the maximum confidence.

    A metadata column, if there is one, is merged over all rows of a key, the newest winning a name.
    """
    payload = F.struct(*[c for c in insights.columns if c not in ("workspace_id", "insight_type", "confidence")])
    keys, order = ["workspace_id", "insight_type", "title_key"], F.struct("generated_at", "insight_id")
    keyed = insights.withColumn("title_key", F.lower(F.trim("title")))
    merged = keyed.groupBy(*keys).agg(F.max_by(payload, order).alias("p"), F.max("confidence").alias("confidence")).select(
        *keys, "confidence", "p.*")
    if "metadata" in insights.columns:
        merged = with_metadata(merged, keyed, keys, "metadata", order)
    return merged.drop("title_key")


def entity_refs(mentions: DataFrame) -> DataFrame:
    """One reference per (chunk, entity): the first mention by position."""
    return mentions.groupBy("workspace_id", "chunk_id", "entity_id").agg(
        F.min_by("mention_text", "position").alias("mention_text")
    )


def create_entities(mentions: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """Get-or-create nodes by (workspace, type, lower name); the earliest mention gives name and chunk."""
    fresh = mentions.groupBy("workspace_id", "type", F.lower("name").alias("name_key")).agg(
        F.min_by(F.struct("name", "chunk_id"), F.struct("seen_at", "chunk_id", "position")).alias("first")
    ).select(
        F.md5(F.concat_ws("|", "workspace_id", "type", "name_key")).alias("entity_id"),
        "workspace_id", "type", F.col("first.name").alias("name"), F.col("first.chunk_id").alias("source_chunk_id"),
    )
    if existing is None:
        return fresh
    known = existing.select("workspace_id", "type", F.lower("name").alias("name_key"))
    added = fresh.withColumn("name_key", F.lower("name")).join(known, ["workspace_id", "type", "name_key"], "left_anti")
    return existing.unionByName(added.drop("name_key"))


def closed_mapping(mapping: DataFrame) -> DataFrame:
    """(duplicate_id, canonical_id) with chains followed to their end, per connected group of ids.

    The canonical node of a group is the one that is nobody's duplicate, the smallest
    of them if there are several, and the smallest node of all on a cycle.
    """
    from memograph.operators.resolution import components

    links = mapping.filter("duplicate_id <> canonical_id").select("duplicate_id", "canonical_id").distinct()
    grouped = components(links, "duplicate_id", "canonical_id")
    ends = grouped.join(links.select(F.col("duplicate_id").alias("id")).distinct().withColumn("gone", F.lit(True)), "id", "left")
    heads = ends.groupBy("label").agg(F.min(F.struct(F.coalesce("gone", F.lit(False)).alias("gone"), "id"))["id"].alias("canonical_id"))
    return grouped.join(heads, "label").select(F.col("id").alias("duplicate_id"), "canonical_id").filter("duplicate_id <> canonical_id")


def repoint(rows: DataFrame, mapping: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Replace ids by their canonical id; ids without a mapping stay."""
    out = rows
    for c in columns:
        m = mapping.select(F.col("duplicate_id").alias(c), F.col("canonical_id").alias("_to"))
        out = out.join(m, c, "left").withColumn(c, F.coalesce("_to", c)).drop("_to")
    return out.select(*rows.columns)


def merge_entities(
    entities: DataFrame, refs: DataFrame, edges: DataFrame, mapping: DataFrame, edge_rule: str = "reassign"
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Fold duplicate nodes into canonical ones: refs move, edges move or are dropped.

    A duplicate of a duplicate goes to the end of its chain, and an edge between
    nodes that become one is dropped. Ids are unique across workspaces.
    """
    mapping = closed_mapping(mapping)
    duplicates = mapping.select(F.col("duplicate_id").alias("entity_id"))
    kept = entities.join(duplicates, "entity_id", "left_anti")
    moved = repoint(refs, mapping, ["entity_id"])
    moved = moved.groupBy("workspace_id", "chunk_id", "entity_id").agg(F.min("mention_text").alias("mention_text"))
    if edge_rule == "reassign":
        before = edges.withColumn("_own", F.col("source_id") == F.col("target_id"))
        pointed = repoint(before, mapping, ["source_id", "target_id"]).filter("_own OR source_id <> target_id").drop("_own")
    else:
        gone = mapping.select("duplicate_id")
        pointed = edges.join(gone, edges["source_id"] == gone["duplicate_id"], "left_anti")
        pointed = pointed.join(gone, pointed["target_id"] == gone["duplicate_id"], "left_anti")
    merged = upsert_edges(pointed, ["workspace_id", "source_id", "target_id", "relationship_type"])
    return kept, moved, merged


def latest_correlations(correlations: DataFrame) -> DataFrame:
    """One row per unordered pair and type, the latest written."""
    ends = correlations.withColumn("lo", F.least("source_a", "source_b")).withColumn(
        "hi", F.greatest("source_a", "source_b"))
    newest = keep_by(ends, ["workspace_id", "lo", "hi", "type"], ["seen_at", "source_a"], newest=True)
    return newest.drop("lo", "hi")


def both_directions(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """Distinct union of a symmetric relation with its mirror."""
    mirrored = pairs.withColumns({a: F.col(b), b: F.col(a)})
    return pairs.unionByName(mirrored).distinct()
