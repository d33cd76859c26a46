"""Timelines, clusters and event filters."""

from __future__ import annotations

from pyspark.sql import functions as F

from memograph import adapters as A
from memograph.catalog.base import ASOF, EVENT_REFS, OP_EVENTS, joined, query, us, with_ctes
from memograph.operators import timeline, upsert
from memograph.session import cut_lineage

DURATION = """CASE WHEN d < 60 THEN CAST(floor(d) AS BIGINT) || 's'
  WHEN d < 3600 THEN CAST(floor(d / 60) AS BIGINT) || 'm'
  WHEN d < 86400 THEN CAST(floor(d / 3600) AS BIGINT) || 'h ' || (CAST(floor(d / 60) AS BIGINT) % 60) || 'm'
  ELSE CAST(floor(d / 86400) AS BIGINT) || 'd ' || (CAST(floor(d / 3600) AS BIGINT) % 24) || 'h' END"""

SESSIONS = """
marked AS (
  SELECT *, CASE WHEN lag(us) OVER w IS NULL OR us - lag(us) OVER w > 7200000000 THEN 1 ELSE 0 END AS opens
  FROM op_events WINDOW w AS (PARTITION BY workspace_id ORDER BY us, event_id)
),
sessions AS (
  SELECT *, CAST(sum(opens) OVER (PARTITION BY workspace_id ORDER BY us, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT)
    AS cluster_id FROM marked
),
clusters AS (
  SELECT workspace_id, cluster_id, count(*) AS event_count, min(us) AS start_us, max(us) AS end_us
  FROM sessions GROUP BY ALL HAVING count(*) >= 2
)
"""


@query("temporal_clusters", with_ctes(OP_EVENTS, SESSIONS, body="""
SELECT workspace_id, cluster_id, event_count, start_us, end_us, (end_us - start_us) / 1000000.0::DOUBLE AS duration_seconds
FROM clusters"""))
def temporal_clusters(spark, sf_dir):
    return timeline.temporal_clusters(A.op_events(spark, sf_dir))


@query("temporal_cluster_members", with_ctes(OP_EVENTS, SESSIONS, body="""
SELECT workspace_id, cluster_id, event_id, event_type FROM sessions"""))
def temporal_cluster_members(spark, sf_dir):
    return timeline.cluster_members(A.op_events(spark, sf_dir)).select(
        "workspace_id", "cluster_id", "event_id", "event_type")


@query("temporal_cluster_entities", with_ctes(OP_EVENTS, EVENT_REFS, SESSIONS, body="""
SELECT DISTINCT s.workspace_id, s.cluster_id, r.name, r.type
FROM sessions s JOIN refs r USING (workspace_id, chunk_id)"""))
def temporal_cluster_entities(spark, sf_dir):
    events = A.op_events(spark, sf_dir)
    return timeline.cluster_entities(events, A.event_entity_refs(events))


@query("timeline_deltas", with_ctes(OP_EVENTS, f"""
d AS (SELECT *, (us - lag(us) OVER (PARTITION BY workspace_id ORDER BY us, event_id)) / 1000000.0::DOUBLE AS d
  FROM op_events)""", body=f"""
SELECT workspace_id, event_id, us AS ts_us, d AS delta_seconds, {DURATION} AS delta_text FROM d"""))
def timeline_deltas(spark, sf_dir):
    return timeline.deltas(A.op_events(spark, sf_dir)).select(
        "workspace_id", "event_id", us("ts", "ts_us"), "delta_seconds", "delta_text")


@query("workspace_timeline", with_ctes(OP_EVENTS, EVENT_REFS, """
page AS (SELECT *, row_number() OVER (PARTITION BY workspace_id ORDER BY us DESC, event_id) AS rank FROM op_events),
cut AS (SELECT * FROM page WHERE rank <= 50),
d AS (SELECT *, (us - lag(us) OVER (PARTITION BY workspace_id ORDER BY us, rank DESC)) / 1000000.0::DOUBLE AS d FROM cut),
named AS (SELECT workspace_id, chunk_id, string_agg(name, ',' ORDER BY name) AS entity_names FROM refs GROUP BY ALL)
""", body=f"""
SELECT d.workspace_id, event_id, rank::BIGINT AS rank, d AS delta_seconds, {DURATION} AS delta_text, entity_names
FROM d LEFT JOIN named n ON n.workspace_id = d.workspace_id AND n.chunk_id = d.chunk_id"""))
def workspace_timeline(spark, sf_dir):
    events = A.op_events(spark, sf_dir)
    out = timeline.timeline(events, A.event_entity_refs(events), limit=50)
    return out.select("workspace_id", "event_id", F.col("rank").cast("long").alias("rank"), "delta_seconds",
                      "delta_text", joined("entity_names", "entity_names"))


@query("filtered_events", with_ctes(OP_EVENTS, body="""
SELECT workspace_id, event_id, event_type, severity, us AS ts_us FROM op_events
WHERE event_type IN ('incident', 'outage') AND severity IN ('high', 'critical')
  AND ts >= TIMESTAMP '2024-01-05 00:00:00' AND ts <= TIMESTAMP '2024-01-25 00:00:00'"""))
def filtered_events(spark, sf_dir):
    found = timeline.filter_events(
        A.op_events(spark, sf_dir), event_types=["incident", "outage"], severities=["high", "critical"],
        start=F.lit("2024-01-05").cast("timestamp"), end=F.lit("2024-01-25").cast("timestamp"))
    return found.select("workspace_id", "event_id", "event_type", "severity", us("ts", "ts_us"))


@query("searched_events", with_ctes(OP_EVENTS, body="""
SELECT workspace_id, event_id, event_type FROM op_events
WHERE event_type IN ('deployment', 'escalation') AND ts >= TIMESTAMP '2024-01-10 00:00:00'"""))
def searched_events(spark, sf_dir):
    found = timeline.search_events(
        A.op_events(spark, sf_dir), ["deployment", "escalation"], "2024-01-10 00:00:00", "not a date")
    return found.select("workspace_id", "event_id", "event_type")


@query("newest_events", with_ctes(OP_EVENTS, body="""
SELECT workspace_id, event_id, us AS ts_us FROM op_events ORDER BY us DESC, event_id LIMIT 50 OFFSET 10"""))
def newest_events(spark, sf_dir):
    return timeline.newest(A.op_events(spark, sf_dir), 50, 10).select("workspace_id", "event_id", us("ts", "ts_us"))


@query("latest_events_per_entity", with_ctes(OP_EVENTS, """
named AS (SELECT workspace_id, event_id, us, unnest(entities) AS entity FROM op_events),
ranked AS (SELECT *, row_number() OVER (PARTITION BY workspace_id, entity ORDER BY us DESC, event_id) AS rank FROM named)
""", body="SELECT workspace_id, entity, event_id, rank::BIGINT AS rank FROM ranked WHERE rank <= 10"))
def latest_events_per_entity(spark, sf_dir):
    named = A.op_events(spark, sf_dir).select("workspace_id", "event_id", "ts", F.explode("entities").alias("entity"))
    latest = timeline.latest_per_key(named, ["workspace_id", "entity"], 10)
    return latest.select("workspace_id", "entity", "event_id", F.col("rank").cast("long").alias("rank"))


@query("events_mentioning_entities", with_ctes(OP_EVENTS, EVENT_REFS, """
wanted AS (SELECT DISTINCT workspace_id, unnest(entities) AS name FROM op_events
  WHERE event_type = 'outage' AND severity = 'critical'),
chunks AS (SELECT DISTINCT workspace_id, chunk_id FROM refs JOIN wanted USING (workspace_id, name))
""", body="SELECT workspace_id, event_id FROM op_events JOIN chunks USING (workspace_id, chunk_id)"))
def events_mentioning_entities(spark, sf_dir):
    events = A.op_events(spark, sf_dir)
    worst = events.filter("event_type = 'outage' AND severity = 'critical'")
    wanted = worst.select("workspace_id", F.explode("entities").alias("name")).distinct()
    return timeline.mentioning(events, A.event_entity_refs(events), wanted).select("workspace_id", "event_id")


@query("last_deployment_before_issue", with_ctes(OP_EVENTS, """
deps AS (SELECT workspace_id, us, arg_max(event_id, event_id) AS event_id, arg_max(title, event_id) AS title
  FROM op_events WHERE event_type = 'deployment' GROUP BY workspace_id, us),
issues AS (SELECT * FROM op_events WHERE event_type IN ('incident', 'outage'))
""", body="""
SELECT i.workspace_id, i.event_id, i.event_type, d.event_id AS deployment_id, d.title AS deployment_title,
  (i.us - d.us) // 60000000 AS minutes_after
FROM issues i ASOF JOIN deps d ON i.workspace_id = d.workspace_id AND i.us > d.us
WHERE i.us - d.us <= 3600000000"""))
def last_deployment_before_issue(spark, sf_dir):
    return timeline.previous_deployment(A.op_events(spark, sf_dir)).drop("title")


@query("event_upsert", with_ctes(OP_EVENTS, """
keyed AS (SELECT *, lower(trim(title)) AS tk FROM op_events),
marked AS (SELECT *, CASE WHEN lag(us) OVER w IS NULL OR us - lag(us) OVER w > 3600000000 THEN 1 ELSE 0 END AS opens
  FROM keyed WINDOW w AS (PARTITION BY workspace_id, event_type, tk ORDER BY us, event_id)),
grouped AS (SELECT *, sum(opens) OVER (PARTITION BY workspace_id, event_type, tk ORDER BY us, event_id
  ROWS UNBOUNDED PRECEDING) AS g FROM marked)
""", body="""
SELECT workspace_id, event_type, arg_min(event_id, (us, event_id)) AS event_id, min(us) AS ts_us,
  arg_min(description, (us, event_id)) FILTER (WHERE description IS NOT NULL) AS description,
  arg_min(severity, (us, event_id)) FILTER (WHERE severity IS NOT NULL) AS severity,
  max(confidence) AS confidence, count(*) AS merged_rows
FROM grouped GROUP BY workspace_id, event_type, tk, g"""))
def event_upsert(spark, sf_dir):
    merged = upsert.upsert_events(A.op_events(spark, sf_dir), tolerance_us=3_600_000_000)
    return merged.select("workspace_id", "event_type", "event_id", us("ts", "ts_us"), "description", "severity",
                         "confidence", "merged_rows")


NAMED = """
parted AS (SELECT o.*, t.k FROM op_events o JOIN typed_events t ON o.event_id = 'event_' || t.event_id),
named AS (
  SELECT workspace_id, 'Daily ' || event_type AS title, event_type, event_id, us, confidence, 'part' || (k % 3) AS name, k::VARCHAR AS value FROM parted
  UNION ALL SELECT workspace_id, 'Daily ' || event_type, event_type, event_id, us, confidence, 'by', '"' || event_id || '"' FROM parted WHERE k % 2 = 0),
newest AS (SELECT workspace_id, event_type, {by} AS part, name, arg_max(value, (us, event_id)) AS value FROM named GROUP BY ALL),
merged AS (SELECT workspace_id, event_type, part, '{{' || string_agg('"' || name || '":' || value, ',' ORDER BY name) || '}}' AS metadata FROM newest GROUP BY ALL)
"""


def with_names(spark, sf_dir):
    """Events of one title a type, with metadata whose names differ from row to row and clash in some."""
    raw = A.table(spark, sf_dir, "events").select(
        F.concat(F.lit("event_"), "event_id").alias("event_id"), F.get_json_object("props", "$.k").cast("int").alias("k"))
    own = F.concat(F.lit('"part'), F.col("k") % 3, F.lit('":'), F.col("k"))
    by = F.when(F.col("k") % 2 == 0, F.concat(F.lit(',"by":"'), "event_id", F.lit('"'))).otherwise("")
    return A.op_events(spark, sf_dir).drop("metadata").join(raw, "event_id").withColumns({
        "title": F.concat(F.lit("Daily "), "event_type"), "metadata": F.concat(F.lit("{"), own, by, F.lit("}"))})


@query("event_metadata", with_ctes(OP_EVENTS, NAMED.format(by="us // 86400000000"), body="""
SELECT workspace_id, event_type, part AS day, metadata FROM merged"""))
def event_metadata(spark, sf_dir):
    """Events of a type and day upserted: the sessions are cut by the day, so each merges a whole day."""
    rows = with_names(spark, sf_dir)
    day = F.floor(F.unix_micros("ts") / 86_400_000_000).cast("long")
    return upsert.merged_metadata(rows.withColumn("day", day), ["workspace_id", "event_type", "day"], "metadata", F.struct(F.unix_micros("ts"), F.col("event_id")))


@query("insight_metadata", with_ctes(OP_EVENTS, NAMED.format(by="title"), body="""
SELECT workspace_id, event_type AS insight_type, arg_max(event_id, (us, event_id)) AS insight_id, max(confidence) AS confidence, any_value(m.metadata) AS metadata
FROM named n JOIN merged m USING (workspace_id, event_type) GROUP BY ALL"""))
def insight_metadata(spark, sf_dir):
    rows = with_names(spark, sf_dir).select(
        "workspace_id", F.col("event_type").alias("insight_type"), "title", F.col("event_id").alias("insight_id"), F.col("ts").alias("generated_at"),
        "confidence", "metadata")
    return upsert.upsert_insights(rows).select("workspace_id", "insight_type", "insight_id", "confidence", "metadata")


@query("ranked_clusters", with_ctes(OP_EVENTS, SESSIONS, body="""
SELECT workspace_id, cluster_id, event_count, start_us,
  row_number() OVER (ORDER BY event_count DESC, start_us, workspace_id, cluster_id) AS rank FROM clusters"""))
def ranked_clusters(spark, sf_dir):
    return timeline.ranked_clusters(timeline.temporal_clusters(A.op_events(spark, sf_dir))).select(
        "workspace_id", "cluster_id", "event_count", "start_us", "rank")


@query("timeline_entity_page", with_ctes(OP_EVENTS, EVENT_REFS, """
asked AS (SELECT DISTINCT workspace_id || '/' || name AS query_id, workspace_id, name AS entity FROM refs WHERE type = 'system')
""", body="""
SELECT query_id, event_id, row_number() OVER (PARTITION BY query_id ORDER BY us DESC, event_id) AS rank
FROM asked a JOIN op_events o USING (workspace_id)
WHERE EXISTS (SELECT 1 FROM refs r WHERE r.workspace_id = o.workspace_id AND r.chunk_id = o.chunk_id AND r.name = a.entity)
QUALIFY rank <= 3"""))
def timeline_entity_page(spark, sf_dir):
    """Each workspace and service: about one event in twenty mentions it, so most of what is fetched is rejected."""
    events = A.op_events(spark, sf_dir)
    refs = cut_lineage(A.event_entity_refs(events))
    asked = refs.filter("type = 'system'").select(
        F.concat("workspace_id", F.lit("/"), "name").alias("query_id"), "workspace_id", F.col("name").alias("entity"), F.lit(3).alias("page_limit")).distinct()
    return timeline.entity_page(events, refs, asked).select("query_id", "event_id", "rank")


@query("timeline_build", with_ctes(OP_EVENTS, EVENT_REFS, f"""
spaces AS (SELECT DISTINCT workspace_id, workspace_id[4:]::INT AS k FROM op_events),
asked AS (SELECT workspace_id || '/' || v AS query_id, *, CASE WHEN (k + v) % 2 = 0 THEN ['incident', 'outage', 'deployment'] END AS types,
    CASE WHEN v = 2 THEN ['high', 'critical'] END AS severities, CASE WHEN v = 1 THEN {ASOF} - INTERVAL 20 DAYS END AS start,
    CASE WHEN v > 0 THEN 'service_' || (k % 20) END AS entity FROM spaces, (SELECT unnest(range(3)) AS v)),
fitting AS (SELECT query_id, o.*, row_number() OVER (PARTITION BY query_id ORDER BY us DESC, event_id) AS rank
  FROM asked a JOIN op_events o USING (workspace_id)
  WHERE (types IS NULL OR list_contains(types, event_type)) AND (severities IS NULL OR list_contains(severities, severity))
    AND (start IS NULL OR ts >= start)
    AND (entity IS NULL OR EXISTS (SELECT 1 FROM refs r WHERE r.workspace_id = o.workspace_id AND r.chunk_id = o.chunk_id AND r.name = entity))),
cut AS (SELECT *, (us - lag(us) OVER (PARTITION BY query_id ORDER BY us, rank DESC)) / 1000000.0::DOUBLE AS d FROM fitting WHERE rank <= 6),
named AS (SELECT workspace_id, chunk_id, string_agg(name, ',' ORDER BY name) AS entity_names FROM refs GROUP BY ALL)
""", body=f"""
SELECT query_id, event_id, rank, d AS delta_seconds, {DURATION} AS delta_text, entity_names FROM cut LEFT JOIN named USING (workspace_id, chunk_id)"""))
def timeline_build(spark, sf_dir):
    """Three questions a workspace: by type, by entity and time, by entity and severity."""
    events = A.op_events(spark, sf_dir)
    refs = cut_lineage(A.event_entity_refs(events))
    k, v = F.substring("workspace_id", 4, 9).cast("int"), F.col("v")
    asked = events.select("workspace_id").distinct().withColumn("v", F.explode(F.array(*[F.lit(n) for n in range(3)]))).select(
        F.concat("workspace_id", F.lit("/"), v).alias("query_id"), "workspace_id", F.lit(6).alias("page_limit"),
        F.when((k + v) % 2 == 0, F.array(F.lit("incident"), F.lit("outage"), F.lit("deployment"))).alias("types"),
        F.when(v == 2, F.array(F.lit("high"), F.lit("critical"))).alias("severities"),
        F.when(v == 1, F.timestamp_micros(F.unix_micros(A.as_of()) - 20 * 86_400_000_000)).alias("start"), F.lit(None).cast("timestamp").alias("end"),
        F.when(v > 0, F.concat(F.lit("service_"), k % 20)).alias("entity"))
    return timeline.build(events, refs, asked).select(
        "query_id", "event_id", "rank", "delta_seconds", "delta_text", joined("entity_names", "entity_names"))
