"""Webhooks, subscriptions and workflows derived from events and orders."""

from __future__ import annotations

from pyspark.sql import functions as F

from memograph import adapters as A
from memograph.catalog.base import ASOF, EVENT_REFS, OP_EVENTS, joined, query, us, with_ctes
from memograph.catalog.detectors import BOTTLENECKS, INSIGHTS, UNSTABLE, VOLUME
from memograph.operators import anomalies, digest, workflow
from memograph.session import cut_lineage
from memograph.sources import webhooks

HOOKS = """
hooks AS (
  SELECT event_id, ts, event_type, user_id, value, 'ws_' || (user_id % 50) AS ws, 'svc_' || (event_id % 12) AS svc,
    CASE event_type WHEN 'error' THEN 'sentry' WHEN 'purchase' THEN 'github' WHEN 'view' THEN 'slack' WHEN 'signup' THEN 'stripe'
      ELSE 'github' END AS source FROM events)
"""


def raw_hooks(spark, sf_dir):
    """Payloads as a landing zone holds them: written once, then read."""
    return cut_lineage(shape_hooks(A.table(spark, sf_dir, "events")))


def shape_hooks(e):
    ws = F.concat(F.lit("ws_"), F.col("user_id") % 50)
    svc = F.concat(F.lit("svc_"), F.col("event_id") % 12)
    kind = F.col("event_type")
    # Payloads whose kind stands in the header alone; of those, every other one has no header either and is no event.
    bare = F.col("event_id") % 5 == 1
    header = F.when(bare & (F.col("event_id") % 2 == 0), F.when(kind == "purchase", "deployment").when(kind == "click", "release"))
    alert = F.to_json(F.struct(
        ws.alias("workspace_id"), F.when(F.col("event_id") % 3 == 0, svc).alias("project_name"), svc.alias("project"),
        F.concat(F.lit("boom "), "event_id").alias("error_message"),
        F.element_at(F.array(*[F.lit(x) for x in ("fatal", "error", "warning", "info", "odd")]), (F.col("event_id") % 5 + 1).cast("int")).alias("level")))
    deploy = F.to_json(F.struct(
        ws.alias("workspace_id"), F.struct(svc.alias("name")).alias("repository"),
        F.when(~bare, F.struct(F.lit("staging").alias("environment"), F.struct(F.concat(F.lit("dev"), F.col("user_id") % 9).alias("login")).alias("creator"))).alias("deployment")))
    release = F.to_json(F.struct(
        ws.alias("workspace_id"), F.struct(svc.alias("name")).alias("repository"),
        F.when(~bare, F.struct(F.concat(F.lit("v"), F.col("event_id") % 7).alias("tag_name"))).alias("release")))
    chat = F.to_json(F.struct(ws.alias("workspace_id"), F.struct(
        F.lit("message").alias("type"), F.when(F.col("event_id") % 10 == 3, "message_changed").alias("subtype"),
        F.when(F.col("event_id") % 4 == 0, "incident-room").otherwise("general").alias("channel"),
        F.when(F.col("event_id") % 6 == 1, "Alert: it FAILED").otherwise("all fine").alias("text")).alias("event")))
    bill = F.to_json(F.struct(
        F.element_at(F.array(F.lit("customer.subscription.created"), F.lit("customer.subscription.updated"),
                             F.lit("customer.subscription.deleted"), F.lit("invoice.paid")), (F.col("event_id") % 4 + 1).cast("int")).alias("type"),
        F.struct(F.struct(
            F.concat(F.lit("sub_"), F.col("user_id") % 70).alias("id"), F.concat(F.lit("cus_"), "user_id").alias("customer"),
            F.element_at(F.array(F.lit("active"), F.lit("trialing"), F.lit("past_due")), (F.col("event_id") % 3 + 1).cast("int")).alias("status"),
            F.struct(F.when(F.col("event_id") % 5 != 0, ws).alias("workspace_id")).alias("metadata"),
            F.when(F.col("event_id") % 5 == 0, ws).alias("client_reference_id")).alias("object")).alias("data")))
    payload = F.when(kind == "error", alert).when(kind == "purchase", deploy).when(kind == "view", chat).when(
        kind == "signup", bill).otherwise(release)
    source = F.when(kind == "error", "sentry").when(kind == "view", "slack").when(kind == "signup", "stripe").otherwise("github")
    return e.select(F.concat(F.lit("hook_"), "event_id").alias("webhook_event_id"), source.alias("source"), payload.alias("payload"),
                    header.alias("kind"), F.col("ts").cast("timestamp").alias("received_at"))


HOOK_EVENTS = """
hook_events AS (
  SELECT ws AS workspace_id, 'event_hook_' || event_id AS event_id, 'incident' AS event_type, 'Sentry Alert: ' || svc || ' Exception' AS title,
    'boom ' || event_id AS summary, CASE event_id % 5 WHEN 0 THEN 'critical' WHEN 1 THEN 'high' WHEN 2 THEN 'medium' WHEN 3 THEN 'low'
      ELSE 'high' END AS severity, epoch_us(ts) AS ts_us FROM hooks WHERE event_type = 'error'
  UNION ALL SELECT ws, 'event_hook_' || event_id, 'deployment',
    'GitHub Deployment: ' || svc || ' to ' || CASE WHEN event_id % 5 = 1 THEN 'production' ELSE 'staging' END,
    'Deployment of ' || svc || ' (main) to ' || CASE WHEN event_id % 5 = 1 THEN 'production triggered by unknown_author.'
      ELSE 'staging triggered by dev' || (user_id % 9) || '.' END, 'low', epoch_us(ts) FROM hooks
    WHERE event_type = 'purchase' AND (event_id % 5 <> 1 OR event_id % 2 = 0)
  UNION ALL SELECT ws, 'event_hook_' || event_id, 'release',
    'GitHub Release: ' || svc || ' ' || CASE WHEN event_id % 5 = 1 THEN 'v1.0.0' ELSE 'v' || (event_id % 7) END,
    'GitHub release ' || CASE WHEN event_id % 5 = 1 THEN 'v1.0.0' ELSE 'v' || (event_id % 7) END || ' published in repository ' || svc || ' by unknown.',
    'low', epoch_us(ts) FROM hooks WHERE event_type = 'click' AND (event_id % 5 <> 1 OR event_id % 2 = 0)
  UNION ALL SELECT ws, 'event_hook_' || event_id, 'incident',
    'Slack Incident Chat: #' || CASE WHEN event_id % 4 = 0 THEN 'incident-room' ELSE 'general' END,
    CASE WHEN event_id % 6 = 1 THEN 'Alert: it FAILED' ELSE 'all fine' END, 'medium', epoch_us(ts) FROM hooks
    WHERE event_type = 'view' AND event_id % 10 <> 3 AND (event_id % 4 = 0 OR event_id % 6 = 1))
"""


@query("webhook_events", with_ctes(HOOKS, HOOK_EVENTS, body="SELECT * FROM hook_events"))
def webhook_events(spark, sf_dir):
    return webhooks.events(raw_hooks(spark, sf_dir)).select(
        "workspace_id", "event_id", "event_type", "title", "summary", "severity", us("ts", "ts_us"))


SUBSCRIPTIONS = """
bills AS (SELECT event_id, ts, 'sub_' || (user_id % 70) AS sub, 'cus_' || user_id AS cus, ws, event_id % 4 AS k,
  CASE event_id % 3 WHEN 0 THEN 'active' WHEN 1 THEN 'trialing' ELSE 'past_due' END AS status,
  'hook_' || event_id AS hook FROM hooks WHERE event_type = 'signup'),
sets AS (SELECT * FROM bills WHERE k IN (0, 1)),
ends AS (SELECT DISTINCT d.event_id, d.ts, d.hook, d.sub, s.ws FROM bills d JOIN sets s ON s.sub = d.sub AND s.ts <= d.ts WHERE d.k = 2),
held AS (SELECT e.ws, e.sub, e.ts, e.hook, arg_max(s.sub, (s.ts, s.hook)) AS holds FROM ends e JOIN sets s ON s.ws = e.ws AND s.ts <= e.ts GROUP BY ALL),
steps AS (SELECT ws, sub, cus, status, ts, hook FROM sets
  UNION ALL SELECT ws, sub, NULL, 'canceled', ts, hook FROM held WHERE holds = sub)
"""


@query("subscription_state", with_ctes(HOOKS, SUBSCRIPTIONS, body="""
SELECT ws AS workspace_id, arg_max(sub, (ts, hook)) AS subscription_id, arg_max(cus, (ts, hook)) FILTER (WHERE cus IS NOT NULL) AS customer_id,
  arg_max(status, (ts, hook)) AS status,
  CASE WHEN arg_max(status, (ts, hook)) IN ('active', 'trialing') THEN 'pro' ELSE 'free' END AS plan FROM steps GROUP BY 1"""))
def subscription_state(spark, sf_dir):
    return webhooks.subscriptions(webhooks.billing_changes(raw_hooks(spark, sf_dir)))


@query("webhook_log", """
WITH sent AS (SELECT event_id, event_id // 2 AS log_id, ts FROM events)
SELECT 'hook_' || log_id AS webhook_event_id, epoch_us(max(ts)) AS received_us FROM sent GROUP BY log_id""")
def webhook_log(spark, sf_dir):
    raw = raw_hooks(spark, sf_dir)
    number = F.substring("webhook_event_id", 6, 20).cast("long")
    twice = raw.withColumn("webhook_event_id", F.concat(F.lit("hook_"), F.floor(number / 2)))
    return webhooks.latest_log(twice).select("webhook_event_id", us("received_at", "received_us"))


COMMANDS = """
commands AS (
  SELECT 'ws_' || (user_id % 50) AS workspace_id, 'wf_' || user_id AS workflow_id, event_id AS seq, ts, epoch_us(ts) AS us, event_type, value,
    CASE event_type WHEN 'click' THEN 'approve' WHEN 'error' THEN 'escalate' WHEN 'view' THEN 'link' ELSE 'transition' END AS action,
    CASE event_type WHEN 'purchase' THEN 'completed' WHEN 'signup' THEN CASE WHEN value >= 20 THEN 'blocked' ELSE 'pending_review' END END AS state,
    CASE user_id % 3 WHEN 0 THEN 'customer_escalation' ELSE 'incident_response' END AS workflow_type,
    CASE WHEN event_type = 'signup' THEN 'person ' || (event_id % 5) END AS assignee,
    CASE WHEN event_type = 'purchase' THEN CASE WHEN value > 30 THEN 'high' ELSE 'low' END END AS priority
  FROM events),
asked AS (SELECT *, CASE action WHEN 'approve' THEN 'in_progress' WHEN 'escalate' THEN 'escalated' WHEN 'transition' THEN state END AS to_state
  FROM commands)
"""


def commands(spark, sf_dir):
    return shape_commands(A.table(spark, sf_dir, "events"))


def shape_commands(e):
    kind = F.col("event_type")
    return e.select(
        F.concat(F.lit("ws_"), F.col("user_id") % 50).alias("workspace_id"), F.concat(F.lit("wf_"), "user_id").alias("workflow_id"),
        F.col("event_id").alias("seq"), F.col("ts").cast("timestamp").alias("ts"),
        F.when(kind == "click", "approve").when(kind == "error", "escalate").when(kind == "view", "link").otherwise("transition").alias("action"),
        F.when(kind == "purchase", "completed").when(
            kind == "signup", F.when(F.col("value") >= 20, "blocked").otherwise("pending_review")).alias("state"),
        F.when(F.col("user_id") % 3 == 0, "customer_escalation").otherwise("incident_response").alias("workflow_type"),
        F.when(kind == "signup", F.concat(F.lit("person "), F.col("event_id") % 5)).alias("assignee"),
        F.when(kind == "purchase", F.when(F.col("value") > 30, "high").otherwise("low")).alias("priority"),
        F.concat(F.lit("Workflow "), "user_id").alias("title"), F.lit("ok").alias("notes"),
        F.when(kind == "view", F.concat(F.lit("asset_"), F.col("event_id") % 40)).alias("related_event"))


TRANSITIONS = """
moves AS (SELECT * FROM (SELECT *, lag(to_state) OVER (PARTITION BY workflow_id ORDER BY us, seq) AS from_state FROM asked
  WHERE to_state IS NOT NULL) WHERE from_state IS NULL OR from_state <> to_state)
"""


@query("workflow_transitions", with_ctes(COMMANDS, TRANSITIONS, body="""
SELECT workspace_id, workflow_id, seq, from_state, to_state, CASE WHEN from_state IS NULL THEN 'Workflow created.'
  WHEN action = 'approve' THEN 'Approved: ok' WHEN action = 'escalate' THEN 'State updated via patch update.' ELSE 'ok' END AS notes
FROM moves"""))
def workflow_transitions(spark, sf_dir):
    return workflow.transitions(commands(spark, sf_dir)).drop("ts")


PEOPLE = "CASE WHEN workflow_type = 'customer_escalation' THEN 'Head of Customer Relations' ELSE 'Director of Engineering / Incident Commander' END"
FLOW_LOG = f"""
given AS (
  SELECT workspace_id, workflow_id, seq, us, 'state' AS kind, to_state AS value FROM asked WHERE to_state IS NOT NULL
  UNION ALL SELECT workspace_id, workflow_id, seq, us, 'assignee', CASE WHEN action = 'escalate' THEN {PEOPLE} ELSE assignee END FROM asked
    WHERE action = 'escalate' OR assignee IS NOT NULL),
flow_log AS (
  SELECT workspace_id, workflow_id, seq, us, kind, before AS from_value, value AS to_value
  FROM (SELECT *, lag(value) OVER (PARTITION BY workflow_id, kind ORDER BY us, seq) AS before FROM given) WHERE before IS DISTINCT FROM value
  UNION ALL SELECT workspace_id, workflow_id, arg_min(seq, (us, seq)), min(us), 'link', NULL, 'asset_' || (seq % 40) FROM asked WHERE action = 'link' GROUP BY 1, 2, 7)
"""


@query("workflow_log", with_ctes(COMMANDS, FLOW_LOG, body="SELECT * FROM flow_log"))
def workflow_log(spark, sf_dir):
    return workflow.log(commands(spark, sf_dir))


LATEST = """
latest AS (SELECT workspace_id, workflow_id, workflow_type, arg_max(to_state, (us, seq)) FILTER (WHERE to_state IS NOT NULL) AS state,
  arg_max(priority, (us, seq)) FILTER (WHERE priority IS NOT NULL) AS priority,
  arg_max(CASE WHEN action = 'escalate' THEN CASE WHEN workflow_type = 'customer_escalation' THEN 'Head of Customer Relations'
      ELSE 'Director of Engineering / Incident Commander' END ELSE assignee END, (us, seq))
    FILTER (WHERE action = 'escalate' OR assignee IS NOT NULL) AS assignee, max(us) AS updated_us FROM asked GROUP BY ALL)
"""


@query("workflow_latest", with_ctes(COMMANDS, LATEST, body="SELECT * FROM latest"))
def workflow_latest(spark, sf_dir):
    return workflow.latest(commands(spark, sf_dir)).select(
        "workspace_id", "workflow_id", "workflow_type", "state", "priority", "assignee", us("updated_at", "updated_us"))


@query("workflow_filter", with_ctes(COMMANDS, LATEST, body="""
SELECT workflow_id, state FROM latest WHERE state IN ('blocked', 'escalated') AND priority IN ('high')"""))
def workflow_filter(spark, sf_dir):
    return workflow.filter_workflows(workflow.latest(commands(spark, sf_dir)), ["blocked", "escalated"], ["high"]).select(
        "workflow_id", "state")


@query("workflow_links", with_ctes(COMMANDS, body="""
SELECT DISTINCT workflow_id, 'asset_' || (seq % 40) AS related_event FROM commands WHERE action = 'link'"""))
def workflow_links(spark, sf_dir):
    return workflow.linked_assets(commands(spark, sf_dir)).select("workflow_id", "related_event")


@query("workflow_alerts", with_ctes(COMMANDS, LATEST, body="""
SELECT workflow_id, 'Workflow Alert in workspace ''' || workspace_id || ''': ''Workflow ' || workflow_id[4:] || ''' has been moved to '
    || upper(state) || ' (Priority: ' || upper(coalesce(priority, 'medium')) || '). Assigned to: ' || coalesce(assignee, 'Unassigned') || '.' AS message,
  replace(lower(assignee), ' ', '.') || '@company.internal' AS address FROM latest WHERE state IS NOT NULL"""))
def workflow_alerts(spark, sf_dir):
    rows = workflow.latest(commands(spark, sf_dir)).filter("state IS NOT NULL").withColumn("priority", F.coalesce("priority", F.lit("medium")))
    person = F.when(F.col("assignee").isNotNull(), F.array(F.struct(F.col("assignee").alias("name"), F.lit("person").alias("type"))))
    rows = rows.withColumn("assignees", F.coalesce(person, F.array().cast("array<struct<name:string,type:string>>")))
    return workflow.alerts(rows).select("workflow_id", "message", "address")


@query("escalation_routes", with_ctes(COMMANDS, LATEST, """
numbered AS (SELECT l.*, workflow_id[4:]::INT AS k, c.created FROM latest l JOIN (SELECT workflow_id, min(ts) AS created FROM commands GROUP BY 1) c USING (workflow_id))
""", body="""
SELECT workflow_id, state AS current_state,
  CASE WHEN k % 4 = 0 THEN '[{"step":1,"role":"Lead"},{"step":2,"role":"Person ' || k || '"}]'
    ELSE '[{"step":1,"role":"Assignee","duration_minutes":30,"timestamp":"' || strftime(created, '%Y-%m-%dT%H:%M:%S') || '"}]' END AS escalation_route,
  CASE WHEN k % 4 = 0 THEN 10 + k % 50 ELSE 60 END AS total_triage_minutes,
  CASE WHEN k % 4 = 0 AND k % 8 = 0 THEN 'Waiting for ' || k ELSE 'No clear bottleneck.' END AS bottleneck_identified FROM numbered"""))
def escalation_routes(spark, sf_dir):
    """Workflows with a recorded route, with an empty one and no minutes, and with nothing recorded."""
    from memograph.operators import issues

    k = F.substring("workflow_id", 4, 20).cast("int")
    recorded = F.concat(
        F.lit('{"escalation_route":[{"step":1,"role":"Lead"},{"step":2,"role":"Person '), k, F.lit('"}],"total_triage_minutes":'), 10 + k % 50,
        F.when(k % 8 == 0, F.concat(F.lit(',"bottleneck_identified":"Waiting for '), k, F.lit('"'))).otherwise(""), F.lit("}"))
    metadata = F.when(k % 4 == 0, recorded).when(k % 4 == 1, F.lit('{"escalation_route":[],"total_triage_minutes":0}')).when(k % 4 == 2, F.lit("{}"))
    rows = workflow.latest(commands(spark, sf_dir)).withColumn("metadata", metadata)
    return issues.escalation_routes(rows).select("workflow_id", "current_state", "escalation_route", "total_triage_minutes", "bottleneck_identified")


ALL_INSIGHTS = (OP_EVENTS, EVENT_REFS, VOLUME, UNSTABLE, BOTTLENECKS, INSIGHTS)


def insights_of(spark, sf_dir, events):
    return anomalies.all_insights(events, A.event_entity_refs(events), A.as_of())


@query("incident_workflows", with_ctes(*ALL_INSIGHTS, """
ten AS (SELECT *, row_number() OVER (PARTITION BY workspace_id ORDER BY insight_id) AS r FROM insights),
advised AS (SELECT workspace_id, count(*) FILTER (WHERE insight_type IN ('deployment_instability', 'recurring_bottleneck')) AS n,
    string_agg('Consider rolling back the deployment release: ''' || string_split(title, '''')[-2] || '''.', ' ' ORDER BY r)
      FILTER (WHERE insight_type = 'deployment_instability') AS advice FROM ten WHERE r <= 10 GROUP BY 1)
""", body="""
SELECT workspace_id, md5('triage|' || workspace_id || '|' || event_id) AS workflow_id,
  'Incident Response: Triage for ''' || title || '''' AS title,
  CASE WHEN coalesce(severity, '') = 'high' OR event_type = 'outage' THEN 'high' ELSE 'medium' END AS priority,
  coalesce(n, 0)::INTEGER AS insights,
  'Investigate recent CPU utilization and saturated connection pool metrics.' || coalesce(' ' || advice, '') AS recommendations
FROM op_events LEFT JOIN advised USING (workspace_id) WHERE event_type IN ('incident', 'outage')"""))
def incident_workflows(spark, sf_dir):
    events = A.op_events(spark, sf_dir)
    incidents = events.filter("event_type IN ('incident', 'outage')")
    made = workflow.incident_workflows(incidents, insights_of(spark, sf_dir, events), A.as_of())
    return made.select("workspace_id", "workflow_id", "title", "priority", F.size("related_insights").alias("insights"),
                       F.array_join("recommendations", " ").alias("recommendations"))


#: Support tickets of every second workspace happen four times closer to the end: their volume spikes.
CROWDED = f"""
crowded AS (SELECT * REPLACE (CASE WHEN event_type = 'support_spike' AND workspace_id[4:]::INTEGER % 2 = 0
  THEN make_timestamp(epoch_us({ASOF}) - (epoch_us({ASOF}) - epoch_us(ts)) // 4) ELSE ts END AS ts) FROM op_events)
"""


@query("customer_escalations", with_ctes(OP_EVENTS, CROWDED, VOLUME.replace("op_events", "crowded"), body="""
SELECT workspace_id, md5('escalation|' || workspace_id || '|' || md5(workspace_id || '|spike|' || event_type)) AS workflow_id,
  'Customer Escalation: Abnormal volume spike in ' || event_type || ' events' AS title, 'medium' AS priority,
  'Customer Support Lead Tier-2' AS assignee FROM stats
WHERE event_type IN ('support_spike', 'customer_complaint')
  AND ((bs > 0 AND (tm - bm) / bs >= 2.0 AND tm > 0.5) OR (bs = 0 AND tm > bm * 3 AND tm >= 1.5))"""))
def customer_escalations(spark, sf_dir):
    events = A.op_events(spark, sf_dir)
    end = F.unix_micros(A.as_of())
    closer = F.timestamp_micros(end - F.floor((end - F.unix_micros("ts")) / 4))
    even = F.substring("workspace_id", 4, 9).cast("int") % 2 == 0
    crowded = events.withColumn("ts", F.when((F.col("event_type") == "support_spike") & even, closer).otherwise(F.col("ts")))
    return workflow.customer_escalations(anomalies.volume_spikes(crowded, A.as_of())).select(
        "workspace_id", "workflow_id", "title", "priority", "assignee")


@query("event_edges", with_ctes(OP_EVENTS, """
ordered AS (SELECT workspace_id, event_id, title, event_type, lag(event_id) OVER (PARTITION BY workspace_id ORDER BY us, event_id) AS prev FROM op_events),
edges AS (SELECT workspace_id, event_id AS s, prev AS t FROM ordered WHERE prev IS NOT NULL),
both_ways AS (SELECT workspace_id, s AS event_id, t AS other_event_id, 'outgoing' AS direction FROM edges
  UNION ALL SELECT workspace_id, t, s, 'incoming' FROM edges)
""", body="""
SELECT b.workspace_id, b.event_id, b.other_event_id, b.direction, o.title AS other_title FROM both_ways b
JOIN op_events o ON o.event_id = b.other_event_id"""))
def event_edges(spark, sf_dir):
    from memograph.operators import graph, upsert
    from memograph.plans import timescan

    events = A.op_events(spark, sf_dir)
    points = events.select("workspace_id", "event_id", timescan.micros("ts").alias("us"))
    before = timescan.carry_last(points, ["workspace_id"], ["us", "event_id"], "event_id", "us")
    edges = before.filter("previous_event_id IS NOT NULL").select(
        "workspace_id", F.col("event_id").alias("source_event_id"), F.col("previous_event_id").alias("target_event_id"),
        F.lit("occurred_after").alias("relationship_type"), F.lit(0.5).alias("confidence"))
    return graph.event_neighbourhood(upsert.upsert_event_edges(edges), events).select(
        "workspace_id", "event_id", "other_event_id", "direction", "other_title")


@query("event_histograms", with_ctes(OP_EVENTS, body="""
SELECT workspace_id, event_type AS value, count(*) AS n, 'type' AS kind FROM op_events GROUP BY ALL
UNION ALL SELECT workspace_id, severity, count(*), 'severity' FROM op_events WHERE severity IS NOT NULL GROUP BY ALL"""))
def event_histograms(spark, sf_dir):
    from memograph.operators import digest

    return digest.histograms(A.op_events(spark, sf_dir))


@query("mean_confidence", with_ctes(*ALL_INSIGHTS, body="""
SELECT workspace_id, round(avg(confidence), 2) AS confidence FROM (
  SELECT workspace_id, confidence FROM op_events UNION ALL SELECT workspace_id, confidence FROM insights) GROUP BY 1"""))
def mean_confidence(spark, sf_dir):
    from memograph.operators import digest

    events = A.op_events(spark, sf_dir)
    return digest.mean_confidence(events, insights_of(spark, sf_dir, events))


@query("evidence_strings", with_ctes(*ALL_INSIGHTS, """
lines AS (SELECT workspace_id, 'Event: ' || title || ' - ' || description AS line FROM op_events WHERE description IS NOT NULL
  UNION SELECT workspace_id, 'Insight: ' || title || ' - ' || summary FROM insights
  UNION SELECT workspace_id, unnest(evidence) FROM insights),
ranked AS (SELECT *, row_number() OVER (PARTITION BY workspace_id ORDER BY line) AS rank FROM lines)
""", body="SELECT workspace_id, line, rank FROM ranked WHERE rank <= 15"))
def evidence_strings(spark, sf_dir):
    from memograph.operators import digest

    events = A.op_events(spark, sf_dir)
    return digest.evidence_lines(events, insights_of(spark, sf_dir, events))


@query("timeline_reports", with_ctes(OP_EVENTS, EVENT_REFS, """
page AS (SELECT *, row_number() OVER (PARTITION BY workspace_id ORDER BY us DESC, event_id) AS rank FROM op_events),
cut AS (SELECT * FROM page WHERE rank <= 50),
body AS (SELECT workspace_id, count(*) AS total, count(*) FILTER (WHERE severity = 'critical') AS critical,
    count(*) FILTER (WHERE severity = 'high') AS high,
    string_agg('- **' || strftime(ts, '%Y-%m-%d %H:%M:%S') || '** | **' || upper(event_type) || '**' || coalesce(' [' || upper(severity) || ']', '')
      || ' — *' || title || '*' || coalesce(chr(10) || '  * ' || description, ''), chr(10) ORDER BY us, rank DESC) AS log FROM cut GROUP BY 1),
kinds AS (SELECT workspace_id, string_agg(event_type || ' (' || n || ')', ', ' ORDER BY event_type) AS types
  FROM (SELECT workspace_id, event_type, count(*) AS n FROM cut GROUP BY ALL) GROUP BY 1),
called AS (SELECT workspace_id, string_agg('- ' || name, chr(10) ORDER BY name) AS names
  FROM (SELECT DISTINCT c.workspace_id, name FROM cut c JOIN refs r ON r.workspace_id = c.workspace_id AND r.chunk_id = c.chunk_id) GROUP BY 1)
""", body="""
SELECT workspace_id, '# Operational Health Summary (Heuristic Fallback)' || chr(10) || '**Query**: what happened' || chr(10) || chr(10)
  || '## Executive Summary' || chr(10) || 'The analyzed timeline contains **' || total || ' operational events** within this scope. '
  || 'The primary categories detected were: ' || types || '.' || chr(10)
  || CASE WHEN critical > 0 OR high > 0 THEN '⚠️ **Warning**: The timeline contains high-severity issues (critical: ' || critical || ', high: ' || high
    || '). Immediate attention is required.' ELSE '✅ **Status**: No critical or high-severity incidents detected in this window.' END || chr(10)
  || coalesce(chr(10) || '## Impacted System Entities' || chr(10) || names || chr(10), '')
  || chr(10) || '## Chronological Log' || chr(10) || log AS report
FROM body JOIN kinds USING (workspace_id) LEFT JOIN called USING (workspace_id)"""))
def timeline_reports(spark, sf_dir):
    from memograph.operators import digest, timeline

    events = A.op_events(spark, sf_dir)
    page = timeline.timeline(events, A.event_entity_refs(events), 50)
    return digest.report_lines(page, "what happened")


@query("digest_lists", with_ctes(*ALL_INSIGHTS, COMMANDS, LATEST, f"""
lines AS (
  SELECT workspace_id, 'insight' AS section, row_number() OVER (PARTITION BY workspace_id ORDER BY title) AS rank, 3 AS most,
    '[' || upper(severity) || '] ' || title || ' (Confidence: ' || printf('%.2f', confidence) || ')' AS line FROM insights
  UNION ALL SELECT workspace_id, 'workflow', row_number() OVER (PARTITION BY workspace_id ORDER BY updated_us DESC, workflow_id), 3,
    '[' || upper(replace(state, '_', ' ')) || '] ' || upper(priority) || ': Workflow ' || workflow_id[4:]
  FROM latest WHERE state IN ('pending_review', 'blocked', 'in_progress', 'escalated')
  UNION ALL SELECT workspace_id, 'event', row_number() OVER (PARTITION BY workspace_id ORDER BY us DESC, event_id), 5,
    strftime(ts, '%Y-%m-%d %H:%M') || ' | ' || upper(event_type) || ' | ' || title
  FROM op_events WHERE ts >= {ASOF} - INTERVAL 1 DAY AND ts <= {ASOF})
""", body="SELECT workspace_id, section, rank, line FROM lines WHERE rank <= most"))
def digest_lists(spark, sf_dir):
    from memograph.operators import digest

    events = A.op_events(spark, sf_dir)
    return digest.top_lists(events, insights_of(spark, sf_dir, events), workflow.latest(commands(spark, sf_dir)), A.as_of())


@query("digest_metrics", with_ctes(OP_EVENTS, EVENT_REFS, VOLUME, UNSTABLE, BOTTLENECKS, COMMANDS, LATEST, f"""
insight_rows AS (
  SELECT workspace_id, 'Abnormal volume spike in ' || event_type || ' events' AS title,
    CASE WHEN event_type IN ('support_spike', 'customer_complaint') THEN 'support_spike' ELSE 'anomaly' END AS insight_type
  FROM stats WHERE (bs > 0 AND (tm - bm) / bs >= 2.0 AND tm > 0.5) OR (bs = 0 AND tm > bm * 3 AND tm >= 1.5)
  UNION ALL SELECT workspace_id, 'Deployment instability detected following release ''' || title || '''',
    'deployment_instability' FROM unstable
  UNION ALL SELECT workspace_id, 'Recurring operational bottleneck detected on ' || name, 'recurring_bottleneck'
  FROM bottlenecks),
insights AS (SELECT DISTINCT workspace_id, insight_type, lower(title) FROM insight_rows),
event_counts AS (SELECT workspace_id, count(*) FILTER (WHERE event_type IN ('incident', 'outage')) AS incidents,
    count(*) FILTER (WHERE event_type = 'deployment') AS deployments
  FROM op_events WHERE ts >= {ASOF} - INTERVAL 1 DAY AND ts <= {ASOF} GROUP BY 1),
insight_counts AS (SELECT workspace_id, count(*) AS insights, count(*) FILTER (WHERE insight_type = 'anomaly') AS anomalies
  FROM insights GROUP BY 1),
flow_counts AS (SELECT workspace_id, count(*) AS workflows, count(*) FILTER (WHERE state = 'blocked') AS blocked FROM latest
  WHERE state IN ('pending_review', 'blocked', 'in_progress', 'escalated') GROUP BY 1)
""", body="""
SELECT workspace_id, coalesce(incidents, 0) AS incidents,
  coalesce(deployments, 0) AS deployments, coalesce(anomalies, 0) AS anomalies, coalesce(insights, 0) AS insights,
  coalesce(workflows, 0) AS workflows, coalesce(blocked, 0) AS blocked,
  'Daily Ops Digest: ' || coalesce(incidents, 0) || ' incidents, ' || coalesce(deployments, 0) || ' deploys, '
    || coalesce(anomalies, 0) || ' anomalies.' AS text
FROM event_counts FULL JOIN insight_counts USING (workspace_id) FULL JOIN flow_counts USING (workspace_id)"""))
def digest_metrics(spark, sf_dir):
    events = A.op_events(spark, sf_dir)
    insights = anomalies.all_insights(events, A.event_entity_refs(events), A.as_of())
    return digest.metrics(events, insights, workflow.latest(commands(spark, sf_dir)), A.as_of(), "daily_ops").select(
        "workspace_id", "incidents", "deployments", "anomalies", "insights", "workflows", "blocked", "text")
