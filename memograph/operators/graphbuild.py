"""The entity graph built batch by batch against what is stored.

What is stored are narrow tables keyed by what mentions say (names, token sets with their
group, references, named edges); entities, their ids and the ends of edges follow from them.
A batch compares only its new token sets with the sets there are, and the links it finds
join groups by their labels: a group that no new link touches is not looked at, and one that
is touched changes its label, not its members' links. Batches in any cut give the graph of
one build over all of them.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from memograph import vocab
from memograph.functions import text
from memograph.operators.resolution import BLOCK, components, similar_sets
from memograph.operators.upsert import keep_by, upsert_edges
from memograph.session import cut_lineage

WS = "workspace_id"


@dataclass
class Graph:
    """names: one row per (workspace, type, lower name); sets: distinct token sets with their group's label;
    refs: one row per (workspace, chunk, type, lower name); edges: rows naming their ends."""

    names: DataFrame
    sets: DataFrame
    refs: DataFrame
    edges: DataFrame


def _ident(*columns: str) -> Column:
    return F.md5(F.concat_ws("|", *columns))


def _earliest(rows: DataFrame) -> DataFrame:
    """Each name as its earliest mention writes it, with the earliest text that describes it."""
    seen = F.struct("seen_at", "name")
    described = F.when(F.nullif("description", F.lit("")).isNotNull(), F.struct("described_at", "description"))
    return rows.groupBy(*BLOCK, "name_key").agg(
        F.min_by("name", seen).alias("name"), F.min("seen_at").alias("seen_at"), F.min_by("description", described).alias("description"),
        F.min(described)["described_at"].alias("described_at"))


def checked(mentions: DataFrame) -> DataFrame:
    """Mentions of usable names; unknown types are documents and names shorter than two letters no entities."""
    described = F.col("description") if "description" in mentions.columns else F.lit(None).cast("string")
    return mentions.withColumns({
        "type": text.entity_type_or_document(F.col("type")), "name": text.entity_name_or_null(F.col("name")), "description": described,
        "described_at": F.col("seen_at")}).filter(F.col("name").isNotNull()).withColumn("name_key", F.lower(F.trim("name")))


def regrouped(sets: DataFrame | None, names: DataFrame, threshold: float) -> DataFrame:
    """The token sets of all names with their groups, given the sets stored before."""
    tokens = F.array_sort(text.tokens(F.col("name_key")))
    there = names.select(*BLOCK, tokens.alias("tokens")).withColumn("set_key", F.array_join("tokens", " ")).distinct()
    fresh = there if sets is None else there.join(sets.select(*BLOCK, "set_key"), [*BLOCK, "set_key"], "left_anti")
    fresh = cut_lineage(fresh.withColumn("set_id", _ident(*BLOCK, "set_key")).withColumn("label", F.col("set_id")))
    every = fresh if sets is None else cut_lineage(sets.unionByName(fresh))
    label = every.select(*BLOCK, "set_key", "label")
    links = similar_sets(fresh, every, threshold).filter("left_set <> right_set")
    ends = links.join(label.withColumnsRenamed({"set_key": "left_set", "label": "l"}), [*BLOCK, "left_set"]).join(
        label.withColumnsRenamed({"set_key": "right_set", "label": "r"}), [*BLOCK, "right_set"])
    # Components over labels: as many nodes as groups that a new link touches.
    moved = components(ends.select("l", "r").filter("l <> r").distinct(), "l", "r").select(F.col("id").alias("label"), F.col("label").alias("_now"))
    return cut_lineage(every.join(moved, "label", "left").withColumn("label", F.coalesce("_now", "label")).select(*every.columns))


def extend(graph: Graph | None, mentions: DataFrame, edges: DataFrame, threshold: float = vocab.JACCARD_THRESHOLD) -> Graph:
    """The stored graph with one more batch.

    mentions: workspace_id, chunk_id, position, name, type, seen_at and, if there is one, a
    description. edges: workspace_id, chunk_id, source, target, relationship_type,
    confidence, evidence, seen_at; the ends are names mentioned in the chunk. A batch that is
    sent again adds its edges again, which changes nothing but their counts.
    """
    named = cut_lineage(checked(mentions).select(*BLOCK, "chunk_id", "position", "name", "name_key", "seen_at", "description", "described_at"))
    names = _earliest(named)
    refs = keep_by(named.select(*BLOCK, "chunk_id", "name_key", "position", F.col("name").alias("mention_text"), "seen_at"),
                   [*BLOCK, "chunk_id", "name_key"], ["position", "mention_text"], newest=False)
    if graph is not None:
        names = _earliest(graph.names.unionByName(names))
        refs = keep_by(graph.refs.unionByName(refs), [*BLOCK, "chunk_id", "name_key"], ["position", "mention_text"], newest=False)
        edges = graph.edges.unionByName(edges.select(*graph.edges.columns))
    names = cut_lineage(names)
    return Graph(names, regrouped(None if graph is None else graph.sets, names, threshold), cut_lineage(refs), cut_lineage(edges))


def entity_ids(graph: Graph) -> DataFrame:
    """Each stored name with its entity: the group's earliest name, and an id made of it."""
    keyed = graph.names.withColumn("set_key", F.array_join(F.array_sort(text.tokens(F.col("name_key"))), " ")).join(
        graph.sets.select(*BLOCK, "set_key", "label"), [*BLOCK, "set_key"])
    described = F.when(F.col("description").isNotNull(), F.struct("described_at", "description"))
    heads = keyed.groupBy(*BLOCK, "label").agg(
        F.min_by(F.struct("name", "name_key"), F.struct("seen_at", "name_key")).alias("head"), F.min_by("description", described).alias("about"))
    return keyed.join(heads, [*BLOCK, "label"]).select(
        *BLOCK, "name_key", "name", F.col("head.name").alias("canonical_name"), F.md5(F.concat_ws("|", *BLOCK, "head.name_key")).alias("entity_id"), "about")


def tables(graph: Graph) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Entities with aliases, description and first chunk; chunk references; edges between entities."""
    ids = cut_lineage(entity_ids(graph))
    pointed = graph.refs.join(ids.select(*BLOCK, "name_key", "entity_id"), [*BLOCK, "name_key"])
    first = pointed.groupBy("entity_id").agg(F.min_by("chunk_id", F.struct("seen_at", "chunk_id")).alias("source_chunk_id"))
    nodes = ids.groupBy(*BLOCK, "entity_id", F.col("canonical_name").alias("name")).agg(
        F.array_sort(F.collect_set("name")).alias("aliases"), F.first("about", ignorenulls=True).alias("description")).join(first, "entity_id")
    refs = pointed.groupBy(WS, "chunk_id", "entity_id").agg(F.min_by("mention_text", F.struct("position", "mention_text")).alias("mention_text"))
    # A name of several types in one chunk points to the one mentioned last.
    ends = pointed.groupBy(WS, "chunk_id", "name_key").agg(F.max_by("entity_id", F.struct("position", "entity_id")).alias("entity_id"))

    def end(name: str, key: str) -> DataFrame:
        return ends.select(WS, "chunk_id", F.col("name_key").alias(key), F.col("entity_id").alias(name))

    named = graph.edges.withColumns({"s": F.lower(F.trim("source")), "t": F.lower(F.trim("target"))})
    between = named.join(end("source_id", "s"), [WS, "chunk_id", "s"]).join(end("target_id", "t"), [WS, "chunk_id", "t"])
    return nodes, refs, upsert_edges(between, [WS, "source_id", "target_id", "relationship_type"])
