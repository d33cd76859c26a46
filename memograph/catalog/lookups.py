"""Entity and membership lookups, checked model answers, result lists and extraction totals."""

from __future__ import annotations

from pyspark.sql import functions as F

from memograph import adapters as A
from memograph.catalog.base import ASOF, EVENT_REFS, OP_EVENTS, joined, query, with_ctes
from memograph.catalog.detectors import UNSTABLE, VOLUME
from memograph.catalog.documents import LINES, MENTION_GRAPH, RAW_DOCS, STANDARD, WORDS, standard
from memograph.catalog.graph import NODES, REFS, item_refs, nodes
from memograph.catalog.wiki import BLOCKS, raw_blocks
from memograph.operators import anomalies, digest, entities, extraction, graph, normalize, resolution, timeline, workflow
from memograph.plans import timescan
from memograph.sources import wiki


@query("user_workspaces", """
SELECT 'u' || c_custkey AS user_id, 'ws_' || n_nationkey AS workspace_id, r_name AS workspace_name
FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey""")
def user_workspaces(spark, sf_dir):
    customer, nation, region = (A.table(spark, sf_dir, t) for t in ("customer", "nation", "region"))
    users = customer.select(F.concat(F.lit("u"), "c_custkey").alias("user_id"))
    members = customer.select(F.concat(F.lit("u"), "c_custkey").alias("user_id"), F.concat(F.lit("ws_"), "c_nationkey").alias("workspace_id"))
    spaces = nation.join(region, F.col("r_regionkey") == F.col("n_regionkey")).select(
        F.concat(F.lit("ws_"), "n_nationkey").alias("workspace_id"), F.col("r_name").alias("workspace_name"))
    return normalize.user_workspaces(users, members, spaces).select("user_id", "workspace_id", "workspace_name")


@query("entity_chunks", with_ctes(NODES, REFS, """
asked AS (SELECT DISTINCT CASE WHEN s_suppkey % 2 = 0 THEN upper(s_name) ELSE substr(s_name, 10) END AS wanted FROM supplier),
exact AS (SELECT wanted, min(entity_id) AS e FROM asked JOIN nodes ON lower(name) = lower(wanted) GROUP BY 1),
fuzzy AS (SELECT wanted, arg_min(entity_id, (name, entity_id)) AS e FROM asked, nodes
  WHERE wanted NOT IN (SELECT wanted FROM exact) AND contains(lower(name), lower(wanted)) GROUP BY 1),
chosen AS (FROM exact UNION ALL FROM fuzzy),
ranked AS (SELECT wanted, e, chunk_id, row_number() OVER (PARTITION BY wanted ORDER BY chunk_id) AS r FROM chosen JOIN item_refs ON entity_id = e)
""", body="SELECT wanted, e AS entity_id, chunk_id FROM ranked WHERE r <= 10"))
def entity_chunks(spark, sf_dir):
    supplier = A.table(spark, sf_dir, "supplier")
    wanted = supplier.select(F.lit("w").alias("workspace_id"), F.when(
        F.col("s_suppkey") % 2 == 0, F.upper("s_name")).otherwise(F.expr("substr(s_name, 10)")).alias("wanted")).distinct()
    refs = item_refs(spark, sf_dir).distinct()
    chunks = refs.select("workspace_id", "chunk_id").distinct()
    return graph.chunks_of_entities(wanted, nodes(spark, sf_dir), refs, chunks).select("wanted", "entity_id", "chunk_id")


@query("insight_filter", with_ctes(OP_EVENTS, VOLUME, UNSTABLE, body="""
SELECT DISTINCT workspace_id, 'deployment_instability' AS insight_type, lower('Deployment instability detected following release ''' || title || '''') AS title_key
FROM unstable WHERE worst > 0"""))
def insight_filter(spark, sf_dir):
    found = anomalies.run_detection(A.op_events(spark, sf_dir), A.as_of())
    return workflow.filter_insights(found, ["deployment_instability"], ["critical"]).select(
        "workspace_id", "insight_type", F.lower("title").alias("title_key"))


@query("distinct_results", with_ctes(OP_EVENTS, body="""
SELECT workspace_id, title, arg_min(event_id, (us, event_id)) AS event_id FROM op_events GROUP BY workspace_id, title"""))
def distinct_results(spark, sf_dir):
    rows = A.op_events(spark, sf_dir)
    return normalize.distinct_results(rows, ["workspace_id", "title"], [timescan.micros("ts"), "event_id"]).select(
        "workspace_id", "title", "event_id")


@query("wiki_stats", with_ctes(BLOCKS, body="""
SELECT (SELECT count(*) FROM documents) AS total_pages, (SELECT count(*) FROM typed) AS total_blocks, 1 AS total_databases,
  (SELECT count(*) FROM part) AS total_rows, (SELECT count(*) FROM documents) + (SELECT count(*) FROM part) AS total_documents"""))
def wiki_stats(spark, sf_dir):
    docs, part = A.table(spark, sf_dir, "documents"), A.table(spark, sf_dir, "part")
    one = part.select(F.lit("db_parts").alias("id")).distinct()
    both = docs.select(F.col("doc_id").alias("id")).unionAll(part.select(F.col("p_partkey").alias("id")))
    return wiki.extraction_stats(docs, wiki.blocks(raw_blocks(spark, sf_dir)), one, part, both)


@query("wiki_schema", """
SELECT 'db_' || p_partkey AS database_id, name, CASE name WHEN 'Name' THEN 'title' WHEN 'Size' THEN 'number' ELSE 'select' END AS type,
  CASE name WHEN 'Name' THEN '{}' WHEN 'Size' THEN '{"format":"' || p_type || '"}' ELSE '{"options":[{"id":"o1","name":"' || p_brand || '"}]}' END AS metadata
FROM part, (SELECT unnest(['Name', 'Size', 'Brand']) AS name)""")
def wiki_schema(spark, sf_dir):
    part = A.table(spark, sf_dir, "part")
    props = F.to_json(F.struct(F.struct(
        F.struct(F.lit("title").alias("type")).alias("Name"),
        F.struct(F.lit("number").alias("type"), F.struct(F.col("p_type").alias("format")).alias("number")).alias("Size"),
        F.struct(F.lit("select").alias("type"), F.struct(F.array(F.struct(
            F.lit("o1").alias("id"), F.col("p_brand").alias("name"))).alias("options")).alias("select")).alias("Brand"),
    ).alias("properties")))
    found = wiki.database_schema(part.select(F.concat(F.lit("db_"), "p_partkey").alias("database_id"), props.alias("json")))
    return found.select("database_id", "name", "type", "metadata")


RESPONSES = """
wanted AS (SELECT doc_id, 'Svc ' || (doc_id % 9) AS a, 'User ' || (doc_id % 5) AS b, doc_id % 4 AS shape FROM documents)
"""


@query("model_answers", with_ctes(RESPONSES, body="""
SELECT doc_id, CASE WHEN shape = 3 THEN '' ELSE a || ':system,' || b || ':document' END AS entities,
  CASE WHEN shape = 3 THEN '' ELSE b || '>owns>' || a || ':1.0' END AS relationships FROM wanted"""))
def model_answers(spark, sf_dir):
    docs = A.table(spark, sf_dir, "documents")
    i = F.col("doc_id")
    a, b = F.concat(F.lit("Svc "), i % 9), F.concat(F.lit("User "), i % 5)
    body = F.concat(
        F.lit('{"entities":[{"name":" '), a, F.lit(' ","type":"SYSTEM"},{"name":"'), b, F.lit('","type":"robot"}],"relationships":[{"source":"'),
        F.lower(b), F.lit('","target":"'), a, F.lit('","type":"Owns","confidence":"3"},{"source":"nobody","target":"'), a, F.lit('","type":"owns"}]}'))
    raw = (
        F.when(i % 4 == 0, body).when(i % 4 == 1, F.concat(F.lit("Here you go: "), body, F.lit(" Anything else?")))
        .when(i % 4 == 2, F.concat(F.lit("```json\n"), body, F.lit("\n```"))).otherwise(F.col("text")))
    parsed = extraction.parse_responses(docs.select("doc_id", raw.alias("response")))
    names = F.transform("entities", lambda e: F.concat(e["name"], F.lit(":"), e["type"]))
    first = F.transform("relationships", lambda r: F.concat(
        F.concat(F.upper(F.substring(r["source"], 1, 1)), F.substring(r["source"], 2, 99)), F.lit(">"), r["type"], F.lit(">"), r["target"],
        F.lit(":"), r["confidence"].cast("string")))
    return parsed.select("doc_id", joined(names, "entities"), F.array_join(first, ",").alias("relationships"))


def _mentions(spark, sf_dir):
    docs = standard(spark, sf_dir)
    tagged = entities.tag(docs, "content")
    return entities.mention_rows(tagged.withColumns({"chunk_id": F.col("id"), "seen_at": F.col("doc_id")}), ["workspace_id", "chunk_id", "seen_at"])


@query("extraction_counts", with_ctes(RAW_DOCS, STANDARD, WORDS, MENTION_GRAPH, """
found AS (SELECT workspace_id, id, count(*) AS n FROM mentions JOIN standard_docs USING (id) GROUP BY 1, 2),
created AS (SELECT source_chunk_id AS id, count(*) AS n FROM built GROUP BY 1),
told AS (SELECT chunk AS id, count(*) AS n FROM kept_refs WHERE type IN ('person', 'project', 'system') GROUP BY 1)
""", body="""
SELECT workspace_id, id AS chunk_id, f.n AS entities_found, coalesce(c.n, 0) AS entities_new, coalesce(t.n, 0) AS relationships_stored
FROM found f LEFT JOIN created c USING (id) LEFT JOIN told t USING (id)""").replace("WITH ", "WITH RECURSIVE ", 1))
def extraction_counts(spark, sf_dir):
    """Relationships are the references of a document to the people, projects and systems it names."""
    found = _mentions(spark, sf_dir)
    built, refs = resolution.build_graph(found)
    linked = refs.join(built.select("entity_id", "type"), "entity_id").filter(F.col("type").isin("person", "project", "system"))
    return extraction.extraction_counts(found, built, linked)


@query("event_graph", with_ctes(RAW_DOCS, STANDARD, LINES, """
line_rows AS (SELECT *, md5(id || '|' || line_no) AS event_id, lower(trim(title, ' ')) AS tk, epoch_us(ts) AS us FROM found_lines),
opened AS (SELECT *, CASE WHEN lag(us) OVER w IS NULL OR us - lag(us) OVER w > 300000000 THEN 1 ELSE 0 END AS opens FROM line_rows
  WHERE us IS NOT NULL WINDOW w AS (PARTITION BY workspace_id, event_type, tk ORDER BY us, event_id)),
sessioned AS (SELECT workspace_id, event_type, tk, id, line_no, event_id, us, sum(opens) OVER (PARTITION BY workspace_id, event_type, tk
    ORDER BY us, event_id ROWS UNBOUNDED PRECEDING) AS g FROM opened
  UNION ALL SELECT workspace_id, event_type, tk, id, line_no, event_id, us, 1 FROM line_rows WHERE us IS NULL),
merged AS (SELECT workspace_id, event_type, tk, g, arg_min(event_id, (coalesce(us, 4611686018427387904), event_id)) AS sid, count(*) AS merged_rows
  FROM sessioned GROUP BY ALL),
titles AS (SELECT s.workspace_id, s.id, s.tk, arg_max(m.sid, s.line_no) AS sid FROM sessioned s JOIN merged m USING (workspace_id, event_type, tk, g) GROUP BY 1, 2, 3),
steps AS (SELECT workspace_id, id, tk, lag(tk) OVER (PARTITION BY id ORDER BY line_no) AS before FROM line_rows),
links AS (SELECT DISTINCT s.workspace_id, a.sid AS s, b.sid AS t FROM steps s JOIN titles a ON a.id = s.id AND a.tk = s.tk
  JOIN titles b ON b.id = s.id AND b.tk = s.before WHERE before IS NOT NULL),
degrees AS (SELECT s, count(*) AS n FROM links GROUP BY s)
""", body="""
SELECT workspace_id, sid AS event_id, event_type, 0.6::DOUBLE AS confidence, merged_rows, coalesce(n, 0) AS edges FROM merged LEFT JOIN degrees ON s = sid"""))
def event_graph(spark, sf_dir):
    docs = standard(spark, sf_dir).withColumnsRenamed({"content": "text", "id": "chunk_id"})
    events, edges = extraction.event_graph(docs)
    seen = events.select("workspace_id", "event_id", "event_type", "confidence", "merged_rows")
    degree = edges.groupBy(F.col("source_event_id").alias("event_id")).agg(F.count(F.lit(1)).alias("edges"))
    return seen.join(degree, "event_id", "left").fillna(0, ["edges"])


@query("event_counts", with_ctes(OP_EVENTS, body="SELECT workspace_id, count(*) AS events FROM op_events GROUP BY 1"))
def event_counts(spark, sf_dir):
    return A.op_events(spark, sf_dir).groupBy("workspace_id").agg(F.count(F.lit(1)).alias("events"))


@query("postmortems", with_ctes(OP_EVENTS, f"""
ordered AS (SELECT *, row_number() OVER (PARTITION BY workspace_id ORDER BY us DESC, event_id) AS r FROM op_events),
worst AS (SELECT workspace_id, arg_min(event_id, r) AS incident_id, arg_min(title, r) AS title, arg_min(coalesce(description, ''), r) AS summary,
    max(us) AS at FROM ordered WHERE event_type = 'outage' GROUP BY 1),
around AS (SELECT o.*, w.incident_id FROM op_events o JOIN worst w ON o.workspace_id = w.workspace_id AND o.us <= w.at),
page AS (SELECT *, row_number() OVER (PARTITION BY incident_id ORDER BY us DESC, event_id) AS k FROM around),
steps AS (SELECT incident_id, string_agg('*   **' || strftime(ts, '%Y-%m-%d') || '**: ' || title || ' - ' || coalesce(description, '') || chr(10), '' ORDER BY us,
    '*   **' || strftime(ts, '%Y-%m-%d') || '**: ' || title || ' - ' || coalesce(description, '') || chr(10)) AS lines FROM page WHERE k <= 5 GROUP BY 1),
cited AS (SELECT *, row_number() OVER (PARTITION BY incident_id ORDER BY us DESC, event_id) AS k FROM around WHERE description IS NOT NULL),
proofs AS (SELECT incident_id, string_agg('*   [' || k || '] **' || title || '**: "' || description[:150] || '..."' || chr(10), '' ORDER BY k) AS lines
  FROM cited WHERE k <= 3 GROUP BY 1)
""", body=f"""
SELECT workspace_id, incident_id, '# Incident Postmortem: ' || title || chr(10) || '**Date Generated**: ' || strftime({ASOF}, '%Y-%m-%d') || chr(10)
  || '**Workspace**: ' || workspace_id || chr(10) || chr(10) || '## Executive Summary' || chr(10) || summary || chr(10) || chr(10)
  || '## Incident Timeline' || chr(10) || coalesce(s.lines, 'No timeline events compiled.') || chr(10) || chr(10)
  || '## Supporting Evidence' || chr(10) || coalesce(p.lines, 'No vector citations compiled.') AS document
FROM worst LEFT JOIN steps s USING (incident_id) LEFT JOIN proofs p USING (incident_id)"""))
def postmortems(spark, sf_dir):
    """The latest outage of each workspace with the five events up to it and the three latest texts, a top list by feature."""
    events = A.op_events(spark, sf_dir)
    worst = timeline.latest_per_key(events.filter("event_type = 'outage'"), ["workspace_id"], 1).select(
        "workspace_id", F.col("event_id").alias("incident_id"), "title", F.col("description").alias("summary"), F.col("ts").alias("at"))
    around = events.join(worst.select("workspace_id", "incident_id", "at"), "workspace_id").filter("ts <= at")
    page = timeline.latest_per_key(around, ["workspace_id", "incident_id"], 5).select(
        "workspace_id", "incident_id", "ts", "title", F.col("description").alias("summary"))
    proof = timeline.latest_per_key(around.filter("description IS NOT NULL"), ["workspace_id", "incident_id"], 3).select(
        "workspace_id", "incident_id", F.col("rank").alias("n"), F.col("title").alias("document"), F.col("description").alias("content"))
    return digest.postmortems(worst.drop("at"), page, proof, A.as_of())


@query("spike_entities", with_ctes(OP_EVENTS, EVENT_REFS, VOLUME, f"""
spikes AS (SELECT workspace_id, event_type FROM stats WHERE (bs > 0 AND (tm - bm) / bs >= 2.0 AND tm > 0.5) OR (bs = 0 AND tm > bm * 3 AND tm >= 1.5)),
chunks AS (SELECT DISTINCT o.workspace_id, o.event_type, chunk_id FROM op_events o JOIN spikes s ON s.workspace_id = o.workspace_id
  AND s.event_type = o.event_type WHERE ts >= {ASOF} - INTERVAL 7 DAYS AND ts <= {ASOF})
""", body="""
SELECT DISTINCT c.workspace_id, md5(c.workspace_id || '|spike|' || c.event_type) AS insight_id, r.name, r.type FROM chunks c
JOIN refs r ON r.workspace_id = c.workspace_id AND r.chunk_id = c.chunk_id"""))
def spike_entities(spark, sf_dir):
    events = A.op_events(spark, sf_dir)
    linked = anomalies.spike_events(anomalies.volume_spikes(events, A.as_of()), events, A.as_of())
    return anomalies.supporting_entities(linked, A.event_entity_refs(events))
