"""Operational events found in text, and checked model responses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from memograph import vocab
from memograph.functions import text
from memograph.operators import upsert
from memograph.session import cut_lineage

RESPONSE_SCHEMA = """
entities array<struct<name:string,type:string,description:string>>,
relationships array<struct<source:string,target:string,type:string,evidence:string,confidence:string>>
"""
EVENT_RESPONSE_SCHEMA = """
events array<struct<event_type:string,title:string,description:string,timestamp:string,severity:string,confidence:double>>,
relationships array<struct<source_title:string,target_title:string,relationship_type:string,confidence:double>>
"""


def chunk_events(chunks: DataFrame) -> DataFrame:
    """At most one event per chunk from the substring classifier, with title, summary and teams."""
    kind = F.array(text.chunk_event_type(F.col("text"), F.col("source")))
    # Exploding the one-element list classifies each text once; a filter on the column would do so twice.
    classified = chunks.select("*", F.explode(F.filter(kind, lambda k: k.isNotNull())).alias("event_type"))
    return classified.select(
        "workspace_id",
        F.concat(F.lit("event_"), "chunk_id").alias("event_id"),
        "chunk_id", "event_type",
        text.chunk_event_title(F.col("event_type"), F.col("title")).alias("title"),
        text.leading_sentences(F.col("text")).alias("summary"),
        "ts", "entities", text.event_teams(F.col("team"), F.col("entities")).alias("related_teams"),
        F.array("chunk_id").alias("source_refs"),
    )


def classified_lines(body: Column) -> Column:
    """Classified non-blank lines of a text with their number, each line judged once."""
    lines = F.transform(F.split(body, r"\R"), lambda l, i: F.struct(i.alias("line_no"), text.strip(l).alias("line")))
    judged = F.transform(
        F.filter(lines, lambda l: l["line"] != ""),
        lambda l: F.struct(l["line_no"].alias("line_no"), l["line"].alias("line"),
                           text.line_event_type(l["line"]).alias("event_type")))
    return F.filter(judged, lambda l: l["event_type"].isNotNull())


def line_events(chunks: DataFrame) -> DataFrame:
    """Every classified non-blank line as an event, numbered within its chunk."""
    lines = chunks.select("workspace_id", "chunk_id", F.explode(classified_lines(F.col("text"))).alias("l")).select(
        "workspace_id", "chunk_id", "l.*")
    return lines.select(
        "workspace_id", "chunk_id", "line_no", "event_type",
        text.clip(F.col("line")).alias("title"), F.col("line").alias("description"),
        text.line_timestamp(F.col("line")).alias("ts"),
        F.when(F.col("event_type").isin("outage", "security_event"), "high").otherwise("medium").alias("severity"),
        F.lit(0.6).alias("confidence"),
        F.md5(F.concat_ws("|", "chunk_id", F.col("line_no").cast("string"))).alias("event_id"),
    )


def sequential_edges(chunks: DataFrame) -> DataFrame:
    """Each classified line occurred after the classified line before it in the same chunk.

    Lines are paired inside the chunk's own row, so no ordering shuffle is needed.
    """
    def paired(lines: Column) -> Column:
        return F.zip_with(
            F.slice(lines, F.lit(2), F.greatest(F.size(lines) - 1, F.lit(0))),
            F.slice(lines, F.lit(1), F.greatest(F.size(lines) - 1, F.lit(0))),
            lambda later, earlier: F.struct(later["line_no"].alias("later_no"), earlier["line_no"].alias("earlier_no"),
                                            later["line"].alias("later"), earlier["line"].alias("earlier")),
        )

    rows = chunks.select(
        "workspace_id", "chunk_id", F.explode(text.let(classified_lines(F.col("text")), paired)).alias("p"))
    return rows.select(
        "workspace_id", "chunk_id", F.col("p.later_no").alias("later_no"), F.col("p.earlier_no").alias("earlier_no"),
        text.clip(F.col("p.later")).alias("source_title"), text.clip(F.col("p.earlier")).alias("target_title"),
        F.lit("occurred_after").alias("relationship_type"), F.lit(0.5).alias("confidence"),
    )


def event_graph(chunks: DataFrame, tolerance_us: int = upsert.MINUTES_5) -> tuple[DataFrame, DataFrame]:
    """Merged line events and the edges between them.

    An edge names its ends by title within the chunk. The last event of a title
    is the one an edge points to, and events merged away point to their survivor.
    """
    # Lines are classified once; the events, their survivors and the edges all read the narrow result.
    found = cut_lineage(line_events(chunks).withColumn("metadata", F.lit("{}")))
    events = upsert.upsert_events(found, tolerance_us)
    survivors = survivor_map(found, tolerance_us)
    titles = (
        found.join(survivors, ["workspace_id", "event_id"])
        .groupBy("workspace_id", "chunk_id", F.lower(F.trim("title")).alias("title_key"))
        .agg(F.max_by("survivor_id", "line_no").alias("id"))
    )
    # The lines of a chunk come from one row.
    before = F.lag(F.lower(F.trim("title"))).over(Window.partitionBy("workspace_id", "chunk_id").orderBy("line_no"))
    edges = found.select("workspace_id", "chunk_id", F.lower(F.trim("title")).alias("s"), before.alias("t")).filter("t IS NOT NULL").withColumns(
        {"relationship_type": F.lit("occurred_after"), "confidence": F.lit(0.5)})
    src = titles.select("workspace_id", "chunk_id", F.col("title_key").alias("s"), F.col("id").alias("source_event_id"))
    dst = titles.select("workspace_id", "chunk_id", F.col("title_key").alias("t"), F.col("id").alias("target_event_id"))
    resolved = edges.join(src, ["workspace_id", "chunk_id", "s"]).join(dst, ["workspace_id", "chunk_id", "t"])
    return events, upsert.upsert_event_edges(resolved)


def survivor_map(events: DataFrame, tolerance_us: int) -> DataFrame:
    """(workspace, event, surviving event) under the same grouping as upsert_events."""
    from memograph.plans import timescan

    keyed = events.withColumn("title_key", F.lower(F.trim("title")))
    keys = ["workspace_id", "event_type", "title_key"]
    cells = timescan.session_cells(keyed, keys, "ts", tolerance_us)
    timed = timescan.attach_sessions(keyed, cells, keys, "ts", tolerance_us)
    untimed = keyed.filter(F.col("ts").isNull()).withColumn("session_no", F.lit(1).cast("long"))
    numbered = timed.unionByName(untimed.select(*timed.columns))
    order = F.struct(F.coalesce(timescan.micros("ts"), F.lit(1 << 62)), "event_id")
    heads = numbered.groupBy(*keys, "session_no").agg(F.min_by("event_id", order).alias("survivor_id"))
    return numbered.join(heads, [*keys, "session_no"]).select("workspace_id", "event_id", "survivor_id")


def salvage_json(raw: Column) -> Column:
    """The first JSON object a free text yields: whole text, outer braces, then a code fence."""
    body = F.regexp_replace(raw, r"^\s+|\s+$", "")

    def as_object(candidate: Column) -> Column:
        whole = F.when(candidate.rlike(r"(?s)^\s*\{.*\}\s*$"), candidate)
        return F.when(F.try_parse_json(whole).isNotNull(), whole)

    braces = F.nullif(F.regexp_extract(body, r"(?s)(\{.*\})", 1), F.lit(""))
    fence = F.nullif(F.regexp_extract(body, r"(?is)```(?:json)?\s*(\{.*?\})\s*```", 1), F.lit(""))
    return F.coalesce(as_object(body), as_object(braces), as_object(fence))


def parse_responses(responses: DataFrame, raw: str = "response") -> DataFrame:
    """Checked entities and edges of raw model answers; anything unusable gives empty lists.

    One invalid entity voids its whole answer, as a schema check does.
    """
    parsed = responses.withColumn("_p", F.from_json(salvage_json(F.col(raw)), RESPONSE_SCHEMA))
    no_nodes = F.array().cast("array<struct<name:string,type:string,description:string>>")
    no_edges = F.array().cast("array<struct<source:string,target:string,type:string,evidence:string,confidence:double>>")
    given = F.coalesce("_p.entities", no_nodes)
    nodes = F.transform(given, lambda e: F.struct(
        text.entity_name_or_null(e["name"]).alias("name"), text.entity_type_or_document(e["type"]).alias("type"),
        e["description"].alias("description")))
    sound = F.forall(nodes, lambda n: n["name"].isNotNull())
    names = F.transform(nodes, lambda n: F.lower(n["name"]))
    edges = F.transform(F.coalesce("_p.relationships", F.array().cast(
        "array<struct<source:string,target:string,type:string,evidence:string,confidence:string>>")), lambda r: F.struct(
        F.trim(r["source"]).alias("source"), F.trim(r["target"]).alias("target"),
        text.edge_type_or_default(r["type"], vocab.EDGE_TYPES).alias("type"), r["evidence"].alias("evidence"),
        text.clamp_confidence(r["confidence"]).alias("confidence")))
    anchored = F.filter(edges, lambda r: F.array_contains(names, F.lower(r["source"]))
                        & F.array_contains(names, F.lower(r["target"])))
    return parsed.withColumns({
        "entities": F.when(sound, nodes).otherwise(no_nodes),
        "relationships": F.when(sound, anchored).otherwise(no_edges),
    }).drop("_p")


def parse_event_responses(responses: DataFrame, raw: str = "response") -> DataFrame:
    """Same for answers that list events and event edges."""
    parsed = responses.withColumn("_p", F.from_json(salvage_json(F.col(raw)), EVENT_RESPONSE_SCHEMA))
    none = F.array().cast("array<struct<event_type:string,title:string,description:string,ts:timestamp,severity:string,confidence:double>>")
    events = F.coalesce(F.transform("_p.events", lambda e: F.struct(
        text.event_type_or_default(e["event_type"]).alias("event_type"), e["title"].alias("title"),
        e["description"].alias("description"), F.try_to_timestamp(e["timestamp"]).alias("ts"),
        text.severity_or_null(e["severity"]).alias("severity"),
        F.coalesce(e["confidence"], F.lit(0.8)).alias("confidence"))), none)
    titles = F.transform(events, lambda e: F.trim(F.lower(e["title"])))
    edges = F.filter(
        F.coalesce("_p.relationships", F.array().cast(
            "array<struct<source_title:string,target_title:string,relationship_type:string,confidence:double>>")),
        lambda r: F.array_contains(titles, F.trim(F.lower(r["source_title"])))
        & F.array_contains(titles, F.trim(F.lower(r["target_title"]))))
    typed = F.transform(edges, lambda r: F.struct(
        r["source_title"].alias("source_title"), r["target_title"].alias("target_title"),
        text.edge_type_or_default(r["relationship_type"], vocab.EVENT_EDGE_TYPES).alias("relationship_type"),
        F.coalesce(r["confidence"], F.lit(0.8)).alias("confidence")))
    return parsed.withColumns({"events": events, "relationships": typed}).drop("_p")


def extraction_counts(mentions: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Per chunk: mentions found, nodes first created there, edges stored."""
    found = mentions.groupBy("workspace_id", "chunk_id").agg(F.count(F.lit(1)).alias("entities_found"))
    created = nodes.groupBy("workspace_id", F.col("source_chunk_id").alias("chunk_id")).agg(
        F.count(F.lit(1)).alias("entities_new"))
    stored = edges.groupBy("workspace_id", "chunk_id").agg(F.count(F.lit(1)).alias("relationships_stored"))
    keys = ["workspace_id", "chunk_id"]
    out = found.join(created, keys, "left").join(stored, keys, "left")
    return out.fillna(0, ["entities_new", "relationships_stored"])
