"""Streams over the event log, drained and checked against their batch twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from memograph import adapters as A
from memograph.catalog.base import OP_EVENTS, query, us, with_ctes
from memograph.catalog.detectors import DEPLOYMENTS, GENERIC, ISSUES
from memograph.catalog.events import SESSIONS
from memograph.catalog.records import (
    COMMANDS, FLOW_LOG, HOOK_EVENTS, HOOKS, SUBSCRIPTIONS, TRANSITIONS, shape_commands, shape_hooks,
)
from memograph.session import prepare, run_folder
from memograph.streaming import detectors, runner, webhooks, workflows

EVENT_LOG = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def raw_stream(spark, sf_dir):
    """The landed event log as a file stream."""
    prepare(spark)
    return spark.readStream.schema(EVENT_LOG).option("pathGlobFilter", "events.parquet").parquet(sf_dir)


def event_stream(spark, sf_dir):
    return A.shape_events(raw_stream(spark, sf_dir))


@query("stream_deployment_incidents", with_ctes(OP_EVENTS, DEPLOYMENTS, body=f"""
SELECT d.workspace_id, d.event_id AS deployment_id, i.event_id AS incident_id, i.event_type, (i.us - d.us) / 1000000.0::DOUBLE AS delay_seconds
FROM deps d JOIN op_events i ON i.workspace_id = d.workspace_id AND i.us BETWEEN d.us AND d.us + 3600000000
WHERE i.event_type IN {ISSUES}"""))
def stream_deployment_incidents(spark, sf_dir):
    return runner.run_to_table(detectors.deployment_incidents(event_stream(spark, sf_dir)), "chains")


@query("stream_sessions", with_ctes(OP_EVENTS, SESSIONS, body="SELECT workspace_id, event_count, start_us, end_us FROM clusters"))
def stream_sessions(spark, sf_dir):
    """All sessions of the log, open ones too, as they stand after its last row."""
    rows = runner.run_to_table(detectors.activity_sessions(event_stream(spark, sf_dir)), "sessions", "complete")
    return runner.last_batch(rows).select("workspace_id", "event_count", us("start_time", "start_us"), us("end_time", "end_us"))


@query("stream_cooccurrence", with_ctes(OP_EVENTS, """
named AS (SELECT workspace_id, event_id, us, unnest(entities) AS e FROM op_events)
""", body="""
SELECT a.workspace_id, a.e AS entity_a, b.e AS entity_b, count(*)::DOUBLE AS score, max(a.us) AS last_seen_us
FROM named a JOIN named b ON a.event_id = b.event_id AND a.e < b.e GROUP BY ALL"""))
def stream_cooccurrence(spark, sf_dir):
    rows = runner.run_to_table(detectors.cooccurrence(event_stream(spark, sf_dir)), "pairs", "update")
    return runner.latest(rows, ["workspace_id", "entity_a", "entity_b"]).select(
        "workspace_id", "entity_a", "entity_b", "score", us("last_seen", "last_seen_us"))


@query("stream_recurring_windows", with_ctes(OP_EVENTS, f"""
named AS (SELECT workspace_id, us, unnest(list_distinct(entities)) AS entity FROM op_events WHERE event_type IN ('incident', 'escalation')),
slid AS (SELECT workspace_id, entity, (us // 86400000000 + unnest(range(1, 8))) * 86400000000 AS window_end_us FROM named
  WHERE lower(entity) NOT IN {GENERIC})
""", body="SELECT workspace_id, entity, window_end_us, count(*) AS event_count FROM slid GROUP BY ALL HAVING count(*) >= 2"))
def stream_recurring_windows(spark, sf_dir):
    rows = runner.run_to_table(detectors.recurring_windows(event_stream(spark, sf_dir)), "recurring", "update")
    return runner.latest(rows, ["workspace_id", "entity", "window_end"]).select(
        "workspace_id", "entity", us("window_end", "window_end_us"), "event_count")


@query("stream_webhook_events", with_ctes(HOOKS, HOOK_EVENTS, body="""
SELECT workspace_id, event_id, event_type, title, severity FROM hook_events"""))
def stream_webhook_events(spark, sf_dir):
    rows = runner.run_to_table(webhooks.event_stream(shape_hooks(raw_stream(spark, sf_dir))), "hooks")
    return rows.select("workspace_id", "event_id", "event_type", "title", "severity")


@query("stream_workflow_transitions", with_ctes(COMMANDS, TRANSITIONS, body="""
SELECT workspace_id, workflow_id, seq, from_state, to_state FROM moves"""))
def stream_workflow_transitions(spark, sf_dir):
    rows = runner.run_to_table(detectors.workflow_transitions(shape_commands(raw_stream(spark, sf_dir))), "workflows")
    return rows.select("workspace_id", "workflow_id", "seq", "from_state", "to_state")


@query("stream_workflow_log", with_ctes(COMMANDS, FLOW_LOG, body="""
SELECT * FROM flow_log WHERE us // 1000 < (SELECT max(us) // 1000 - 3600000 FROM commands)"""))
def stream_workflow_log(spark, sf_dir):
    """Commands out of order: what lies an hour or more behind the newest one has been released."""
    return runner.run_to_table(workflows.log(shape_commands(raw_stream(spark, sf_dir)), delay="1 hour"), "workflow-log")


#: An hour is closed once the watermark, an hour behind the newest row, has passed its end.
CLOSED = "(hour + 1) * 3600000000 <= (SELECT max(us) // 1000 * 1000 - 3600000000 FROM seen)"


@query("stream_frequency_spikes", with_ctes(OP_EVENTS, f"""
seen AS (SELECT workspace_id, event_type, us, us // 3600000000 AS hour FROM op_events WHERE event_type <> 'discussion'),
hours AS (SELECT workspace_id, event_type, hour, count(*) AS n FROM seen WHERE {CLOSED} GROUP BY ALL),
summed AS (SELECT workspace_id, event_type, hour,
    sum(n) OVER (PARTITION BY workspace_id, event_type ORDER BY hour RANGE BETWEEN 23 PRECEDING AND CURRENT ROW)::BIGINT AS count_24h,
    sum(n) OVER (PARTITION BY workspace_id, event_type ORDER BY hour RANGE BETWEEN 191 PRECEDING AND CURRENT ROW) AS span FROM hours)
""", body="""
SELECT workspace_id, event_type, hour, count_24h, (span - count_24h) / 7.0::DOUBLE AS daily_mean FROM summed
WHERE count_24h >= 3 AND count_24h >= 2.5 * ((span - count_24h) / 7.0::DOUBLE)"""))
def stream_frequency_spikes(spark, sf_dir):
    return detectors.spikes_by_hour(runner.run_to_table(detectors.frequency_hours(event_stream(spark, sf_dir)), "spikes"))


@query("stream_recurring_incidents", with_ctes(OP_EVENTS, f"""
seen AS (SELECT workspace_id, unnest(list_distinct(list_filter(entities, lambda e: lower(e) NOT IN {GENERIC}))) AS entity, us, us // 3600000000 AS hour
  FROM op_events WHERE event_type IN ('incident', 'escalation')),
hours AS (SELECT workspace_id, entity, hour, count(*) AS n FROM seen WHERE {CLOSED} GROUP BY ALL),
summed AS (SELECT workspace_id, entity, hour,
    sum(n) OVER (PARTITION BY workspace_id, entity ORDER BY hour RANGE BETWEEN 167 PRECEDING AND CURRENT ROW)::BIGINT AS event_count FROM hours)
""", body="SELECT * FROM summed WHERE event_count >= 2"))
def stream_recurring_incidents(spark, sf_dir):
    return detectors.recurring_by_hour(runner.run_to_table(detectors.recurring_hours(event_stream(spark, sf_dir)), "repeats"))


@query("stream_subscriptions", with_ctes(HOOKS, SUBSCRIPTIONS, body="""
SELECT ws AS workspace_id, arg_max(sub, (ts, hook)) AS subscription_id, arg_max(status, (ts, hook)) AS status,
  CASE WHEN arg_max(status, (ts, hook)) IN ('active', 'trialing') THEN 'pro' ELSE 'free' END AS plan FROM steps GROUP BY 1"""))
def stream_subscriptions(spark, sf_dir):
    log = run_folder(spark, "billing")
    webhooks.billing_log(shape_hooks(raw_stream(spark, sf_dir)), log, run_folder(spark, "billing-state")).trigger(availableNow=True).start().awaitTermination()
    return webhooks.subscription_table(spark, log).select("workspace_id", "subscription_id", "status", "plan")
