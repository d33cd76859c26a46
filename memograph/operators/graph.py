"""Entity graph: statistics, neighbourhoods, lookups and context of hits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from memograph.plans import ranking
from memograph.plans.substring import containing
from memograph.session import cut_lineage

WS = ["workspace_id"]


def stats(entities: DataFrame, edges: DataFrame) -> DataFrame:
    """Node and edge counts by type with a total row per kind."""
    nodes = entities.rollup("workspace_id", "type").agg(F.count(F.lit(1)).alias("n")).filter("workspace_id IS NOT NULL")
    links = edges.rollup("workspace_id", F.col("relationship_type").alias("type")).agg(
        F.count(F.lit(1)).alias("n")).filter("workspace_id IS NOT NULL")
    labelled = F.coalesce("type", F.lit("total"))
    return nodes.select("workspace_id", F.lit("entity").alias("kind"), labelled.alias("type"), "n").unionByName(
        links.select("workspace_id", F.lit("relationship").alias("kind"), labelled.alias("type"), "n"))


def degrees(edges: DataFrame) -> DataFrame:
    """Outgoing and incoming edges of every entity that has any."""
    ends = F.explode(F.array(
        F.struct(F.col("source_id").alias("entity_id"), F.lit(1).alias("out"), F.lit(0).alias("in")),
        F.struct(F.col("target_id").alias("entity_id"), F.lit(0).alias("out"), F.lit(1).alias("in"))))
    return edges.select("workspace_id", ends.alias("e")).groupBy("workspace_id", "e.entity_id").agg(
        F.sum("e.out").alias("outgoing"), F.sum("e.in").alias("incoming"), F.count(F.lit(1)).alias("degree"))


def filter_edges(edges: DataFrame, relationship_type: str | None = None, touching: DataFrame | None = None) -> DataFrame:
    """Edges of a type, and with an end in the given (workspace_id, entity_id) set."""
    out = edges if relationship_type is None else edges.filter(F.col("relationship_type") == relationship_type)
    if touching is None:
        return out
    ends = [out.join(touching.withColumnRenamed("entity_id", c), [*WS, c], "left_semi").select(*out.columns)
            for c in ("source_id", "target_id")]
    return ends[0].union(ends[1]).distinct()


def find_entities(entities: DataFrame, name: str | None = None, contains: str | None = None, kind: str | None = None) -> DataFrame:
    """Nodes by exact name or substring, ignoring case, in name order."""
    out = entities if kind is None else entities.filter(F.col("type") == kind)
    if name is not None:
        out = out.filter(F.lower("name") == name.strip().lower())
    if contains is not None:
        out = out.filter(F.contains(F.lower("name"), F.lit(contains.lower())))
    return out.orderBy("name", "entity_id")


def neighbourhood(edges: DataFrame, seeds: DataFrame, depth: int = 1) -> DataFrame:
    """Edges within `depth` hops of each seed, with direction and hop.

    Every (seed, edge, direction) appears once, at its first hop. A node is
    expanded once per seed; from the second hop on, each frontier is written
    before the next, so plans do not grow with the depth.
    """
    if depth < 1:
        raise ValueError("depth starts at 1")
    out_edges = edges.select("workspace_id", F.col("source_id").alias("at"), F.col("target_id").alias("next"), "edge_id",
                             F.lit("outgoing").alias("direction"))
    in_edges = edges.select("workspace_id", F.col("target_id").alias("at"), F.col("source_id").alias("next"), "edge_id",
                            F.lit("incoming").alias("direction"))
    steps = out_edges.unionByName(in_edges)
    first = seeds.select("workspace_id", F.col("entity_id").alias("seed_id"), F.col("entity_id").alias("at")).distinct()
    frontier, seen, found = first, first, None
    for hop in range(1, depth + 1):
        reached = frontier.join(steps, ["workspace_id", "at"]).select(
            "workspace_id", "seed_id", "edge_id", "direction", F.col("next"), F.lit(hop).alias("hop"))
        if 1 < hop < depth:
            reached = cut_lineage(reached)
        found = reached if found is None else found.unionByName(reached)
        if hop < depth:
            nodes = reached.select("workspace_id", "seed_id", F.col("next").alias("at")).distinct()
            frontier = nodes.join(seen, ["workspace_id", "seed_id", "at"], "left_anti")
            if hop > 1:
                frontier = cut_lineage(frontier)
            seen = seen.unionByName(frontier)
    return found.groupBy("workspace_id", "seed_id", "edge_id", "direction").agg(
        F.min("hop").alias("hop"), F.min("next").alias("other_id"))


def described_neighbourhood(near: DataFrame, entities: DataFrame) -> DataFrame:
    """Neighbourhood rows with name and type of the other end."""
    named = entities.select("workspace_id", F.col("entity_id").alias("other_id"), F.col("name").alias("other_name"),
                            F.col("type").alias("other_type"))
    return near.join(named, ["workspace_id", "other_id"], "left")


def linked_chunks(refs: DataFrame, seeds: DataFrame, limit: int = 50) -> DataFrame:
    """At most `limit` chunks that mention each seed, in chunk order."""
    found = refs.join(seeds.select("workspace_id", "entity_id").distinct(), ["workspace_id", "entity_id"], "left_semi")
    w = Window.partitionBy("workspace_id", "entity_id").orderBy("chunk_id")
    return found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= limit)


def hit_context(hits: DataFrame, refs: DataFrame, entities: DataFrame, edges: DataFrame, per_chunk: int = 5) -> DataFrame:
    """Entities of each search hit (at most five per chunk) with their one-hop edges.

    One row per (hit, entity, edge); entities without edges keep one row.
    """
    w = Window.partitionBy("query_id", "workspace_id", "chunk_id").orderBy("entity_id")
    linked = hits.select("query_id", "workspace_id", "chunk_id").join(refs, ["workspace_id", "chunk_id"])
    top = linked.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= per_chunk).drop("rank")
    named = top.join(entities.select("workspace_id", "entity_id", "name", "type"), ["workspace_id", "entity_id"])
    seeds = named.select("workspace_id", "entity_id").distinct()
    near = described_neighbourhood(neighbourhood(edges, seeds, 1), entities).withColumnRenamed("seed_id", "entity_id")
    return named.join(near.drop("hop"), ["workspace_id", "entity_id"], "left")


def chunks_of_entities(names: DataFrame, entities: DataFrame, refs: DataFrame, chunks: DataFrame, limit: int = 10) -> DataFrame:
    """Chunks that mention a named entity: exact name first, else the first name containing it.

    `names` holds (workspace_id, wanted). The substring search runs for the
    names without an exact match only.
    """
    key = F.lower(F.trim("wanted"))
    nodes = entities.select("workspace_id", "entity_id", "name")
    exact = names.withColumn("k", key).join(nodes.withColumn("k", F.lower("name")), ["workspace_id", "k"])
    exact = exact.groupBy("workspace_id", "wanted").agg(F.min_by("entity_id", "name").alias("entity_id"))
    missing = names.join(exact, ["workspace_id", "wanted"], "left_anti")
    like = containing(nodes, F.lower("name"), missing, key, ["workspace_id"])
    like = like.groupBy("workspace_id", "wanted").agg(F.min_by("entity_id", F.struct("name", "entity_id")).alias("entity_id"))
    found = exact.unionByName(like)
    linked = linked_chunks(refs, found, limit).drop("rank")
    return found.join(linked, ["workspace_id", "entity_id"]).join(chunks, ["workspace_id", "chunk_id"])


def event_neighbourhood(edges: DataFrame, events: DataFrame) -> DataFrame:
    """Every event edge seen from both of its ends with the event on the other side."""
    def side(at: str, other: str, direction: str) -> DataFrame:
        return edges.select("workspace_id", F.col(at).alias("event_id"), F.col(other).alias("other_event_id"),
                            "relationship_type", "confidence", F.lit(direction).alias("direction"))

    both = side("source_event_id", "target_event_id", "outgoing").unionByName(
        side("target_event_id", "source_event_id", "incoming"))
    other = events.select("workspace_id", F.col("event_id").alias("other_event_id"), F.col("title").alias("other_title"),
                          F.col("event_type").alias("other_type"))
    return both.join(other, ["workspace_id", "other_event_id"])


def top_neighbours(neighbours: DataFrame, limit: int = 10) -> DataFrame:
    """Strongest co-occurrence neighbours of each entity."""
    w = Window.partitionBy("workspace_id", "entity").orderBy(F.desc("score"), "neighbour")
    return neighbours.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= limit)


def page(entities: DataFrame, limit: int, offset: int = 0) -> DataFrame:
    """Entities by name, ties by id: the `limit` after the first `offset`, with their places."""
    return ranking.page(entities, [F.col("name"), F.col("entity_id")], limit, offset, "place")
