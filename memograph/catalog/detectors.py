"""Pattern and anomaly detectors, issue reports and digests over operational events."""

from __future__ import annotations

from pyspark.sql import functions as F

from memograph import adapters as A
from memograph.catalog.base import ASOF, EVENT_REFS, OP_EVENTS, joined, query, us, with_ctes
from memograph.operators import anomalies, digest, issues, patterns

ISSUES = "('incident', 'outage', 'performance_issue', 'infrastructure_failure')"
GENERIC = "('discussion', 'incident', 'deployment', 'slack', 'notion', 'production', 'environment')"

DEPLOYMENTS = "deps AS (SELECT * FROM op_events WHERE event_type = 'deployment')"

FREQUENCIES = f"""
freq AS (SELECT o.workspace_id, r.name, r.type, o.event_type, count(*) AS n FROM op_events o
  JOIN refs r USING (workspace_id, chunk_id) WHERE o.event_type IN {ISSUES} GROUP BY ALL)
"""


@query("incident_frequency", with_ctes(OP_EVENTS, EVENT_REFS, FREQUENCIES, body="""
SELECT workspace_id, name, type, CAST(sum(n) AS BIGINT) AS incident_count,
  string_agg(event_type || ':' || n, ',' ORDER BY event_type || ':' || n) AS breakdown
FROM freq GROUP BY workspace_id, name, type"""))
def incident_frequency(spark, sf_dir):
    events = A.op_events(spark, sf_dir)
    return patterns.frequency_breakdown(patterns.incident_frequencies(events, A.event_entity_refs(events)))


@query("ranked_frequencies", with_ctes(OP_EVENTS, EVENT_REFS, FREQUENCIES, body="""
SELECT workspace_id, name, type, CAST(sum(n) AS BIGINT) AS incident_count,
  row_number() OVER (ORDER BY sum(n) DESC, workspace_id, name, type) AS rank FROM freq GROUP BY workspace_id, name, type"""))
def ranked_frequencies(spark, sf_dir):
    events = A.op_events(spark, sf_dir)
    counted = patterns.frequency_breakdown(patterns.incident_frequencies(events, A.event_entity_refs(events)))
    return patterns.ranked_frequencies(counted).drop("breakdown")


@query("deployment_incidents", with_ctes(OP_EVENTS, DEPLOYMENTS, body=f"""
SELECT d.workspace_id, d.event_id AS deployment_id, i.event_id AS incident_id, i.event_type, i.severity,
  (i.us - d.us) / 1000000.0::DOUBLE AS delay_seconds,
  ((i.us - d.us) // 60000000) || 'm ' || (((i.us - d.us) // 1000000) % 60) || 's' AS delay_text
FROM deps d JOIN op_events i ON i.workspace_id = d.workspace_id AND i.us BETWEEN d.us AND d.us + 3600000000
WHERE i.event_type IN {ISSUES}"""))
def deployment_incidents(spark, sf_dir):
    return patterns.deployment_incidents(A.op_events(spark, sf_dir)).select(
        "workspace_id", "deployment_id", "incident_id", "event_type", "severity", "delay_seconds", "delay_text")


RECURRING = f"""
recurring_hits AS (SELECT workspace_id, event_id, us, unnest(list_distinct(entities)) AS entity FROM op_events
  WHERE event_type IN ('incident', 'escalation') AND ts >= {ASOF} - INTERVAL 7 DAYS AND ts <= {ASOF}),
recurring AS (SELECT workspace_id, entity, count(*) AS event_count FROM recurring_hits
  WHERE lower(entity) NOT IN {GENERIC} GROUP BY ALL HAVING count(*) >= 2),
recurring_patterns AS (SELECT workspace_id, 'pattern_recurring_' || replace(lower(entity), ' ', '_') AS pattern_id,
  'recurring_incident' AS pattern_type, 'Recurring incident sequence involving ' || entity AS name,
  'Detected ' || event_count || ' incidents/escalations involving the entity ''' || entity
    || ''' in the last 7 days. This points to potential system instability.' AS description,
  CASE WHEN event_count > 3 THEN 'high' ELSE 'medium' END AS severity,
  round(least(0.7::DOUBLE + event_count * 0.05::DOUBLE, 0.99::DOUBLE), 2) AS confidence, entity AS entities, event_count
  FROM recurring)
"""


@query("recurring_incidents", with_ctes(OP_EVENTS, RECURRING, body="SELECT * FROM recurring_patterns"))
def recurring_incidents(spark, sf_dir):
    out = patterns.recurring_incidents(A.op_events(spark, sf_dir), A.as_of())
    return out.withColumn("entities", F.array_join("entities", ","))


@query("recurring_incident_events", with_ctes(OP_EVENTS, RECURRING, body="""
SELECT h.workspace_id, 'pattern_recurring_' || replace(lower(entity), ' ', '_') AS pattern_id, h.event_id
FROM recurring_hits h JOIN recurring r USING (workspace_id, entity)"""))
def recurring_incident_events(spark, sf_dir):
    events = A.op_events(spark, sf_dir)
    return patterns.pattern_events(patterns.recurring_incidents(events, A.as_of()), events, A.as_of())


@query("rolling_incidents_7d", with_ctes(OP_EVENTS, f"""
named AS (SELECT workspace_id, event_id, ts, unnest(list_distinct(entities)) AS entity FROM op_events
  WHERE event_type IN ('incident', 'escalation'))
""", body=f"""
SELECT workspace_id, entity, event_id, count(*) OVER (PARTITION BY workspace_id, entity ORDER BY ts
  RANGE BETWEEN INTERVAL 7 DAYS PRECEDING AND CURRENT ROW) AS incidents_7d
FROM named WHERE lower(entity) NOT IN {GENERIC}"""))
def rolling_incidents_7d(spark, sf_dir):
    return patterns.rolling_incidents(A.op_events(spark, sf_dir)).select(
        "workspace_id", "entity", "event_id", "incidents_7d")


CHAINS = f"""
chains AS (SELECT d.workspace_id, 'pattern_chain_' || d.event_id || '_' || i.event_id AS pattern_id,
  'Incident/Escalation ''' || i.title || ''' was triggered shortly after ''' || d.title
    || '''. Temporal spacing: less than 60 minutes.' AS description,
  list_filter(list_distinct(list_concat(i.entities, d.entities)), lambda e: lower(e) NOT IN {GENERIC}) AS ents
  FROM deps d JOIN op_events i ON i.workspace_id = d.workspace_id AND i.us BETWEEN d.us AND d.us + 3600000000
  WHERE i.event_type IN ('incident', 'escalation', 'discussion'))
"""


@query("escalation_chains", with_ctes(OP_EVENTS, DEPLOYMENTS, CHAINS, body="""
SELECT workspace_id, pattern_id, description, 'high' AS severity, 0.85::DOUBLE AS confidence,
  array_to_string(list_sort(ents), ',') AS entities FROM chains"""))
def escalation_chains(spark, sf_dir):
    return patterns.escalation_chains(A.op_events(spark, sf_dir)).select(
        "workspace_id", "pattern_id", "description", "severity", "confidence", joined("entities", "entities"))


SPIKES = f"""
day_counts AS (SELECT workspace_id, event_type, count(*) FILTER (WHERE ts >= {ASOF} - INTERVAL 1 DAY) AS count_24h,
    count(*) FILTER (WHERE ts < {ASOF} - INTERVAL 1 DAY) AS count_baseline
  FROM op_events WHERE ts >= {ASOF} - INTERVAL 8 DAYS AND ts <= {ASOF} AND event_type <> 'discussion' GROUP BY ALL),
freq_spikes AS (SELECT *, count_baseline / 7.0::DOUBLE AS daily_mean FROM day_counts
  WHERE count_24h >= 3 AND (count_baseline = 0 OR count_24h >= 2.5::DOUBLE * (count_baseline / 7.0::DOUBLE)))
"""


@query("frequency_spikes", with_ctes(OP_EVENTS, SPIKES, body="""
SELECT workspace_id, event_type, 'pattern_spike_' || event_type AS pattern_id, count_24h, daily_mean,
  'Surge in operational events of type ''' || event_type || ''' detected: ' || count_24h
    || ' events in the last 24 hours, compared to a baseline average of ' || printf('%.1f', daily_mean)
    || ' per day.' AS description FROM freq_spikes"""))
def frequency_spikes(spark, sf_dir):
    return patterns.frequency_spikes(A.op_events(spark, sf_dir), A.as_of()).select(
        "workspace_id", "event_type", "pattern_id", "count_24h", "daily_mean", "description")


@query("searched_patterns", with_ctes(OP_EVENTS, DEPLOYMENTS, RECURRING, CHAINS, SPIKES, """
every AS (
  SELECT workspace_id, pattern_id, pattern_type, name, description, confidence, [entities] AS ents FROM recurring_patterns
  UNION ALL SELECT workspace_id, pattern_id, 'escalation_chain', 'Escalation chain following deployment', description,
    0.85, ents FROM chains
  UNION ALL SELECT workspace_id, 'pattern_spike_' || event_type, 'frequency_spike', 'Spike in ' || event_type || ' frequency',
    '', 0.8, [] FROM freq_spikes)
""", body="""
SELECT workspace_id, pattern_id, pattern_type FROM every WHERE confidence >= 0.8 AND (lower(name) LIKE '%service_1%'
  OR lower(description) LIKE '%service_1%' OR len(list_filter(ents, lambda e: lower(e) LIKE '%service_1%')) > 0)"""))
def searched_patterns(spark, sf_dir):
    found = patterns.filter_patterns(patterns.all_patterns(A.op_events(spark, sf_dir), A.as_of()), 0.8, None, "Service_1")
    return found.select("workspace_id", "pattern_id", "pattern_type")


VOLUME = f"""
spine AS (SELECT DISTINCT workspace_id, event_type, unnest(range(30)) AS day_offset FROM op_events
  WHERE ts >= {ASOF} - INTERVAL 30 DAYS AND ts <= {ASOF}),
counted AS (SELECT workspace_id, event_type, date_diff('day', ts::DATE, {ASOF}::DATE) AS day_offset, count(*) AS c
  FROM op_events WHERE ts >= {ASOF} - INTERVAL 30 DAYS AND ts <= {ASOF} GROUP BY ALL),
daily AS (SELECT s.workspace_id, s.event_type, s.day_offset, coalesce(c, 0) AS n FROM spine s
  LEFT JOIN counted d ON d.workspace_id = s.workspace_id AND d.event_type = s.event_type AND d.day_offset = s.day_offset),
stats AS (SELECT workspace_id, event_type, avg(n) FILTER (WHERE day_offset > 7) AS bm,
  stddev_pop(n) FILTER (WHERE day_offset > 7) AS bs, avg(n) FILTER (WHERE day_offset <= 7) AS tm FROM daily GROUP BY ALL)
"""


@query("daily_event_counts", with_ctes(OP_EVENTS, VOLUME, body="SELECT * FROM daily"))
def daily_event_counts(spark, sf_dir):
    return anomalies.daily_counts(A.op_events(spark, sf_dir), A.as_of())


@query("volume_statistics", with_ctes(OP_EVENTS, VOLUME, body="""
SELECT workspace_id, event_type, round(bm, 6) AS baseline_mean, round(bs, 6) AS baseline_std, round(tm, 6) AS target_mean,
  round(CASE WHEN bs > 0 THEN (tm - bm) / bs END, 6) AS z_score FROM stats"""))
def volume_statistics(spark, sf_dir):
    stats = anomalies.spike_statistics(anomalies.daily_counts(A.op_events(spark, sf_dir), A.as_of()))
    return stats.select("workspace_id", "event_type",
                        *[F.round(c, 6).alias(c) for c in ("baseline_mean", "baseline_std", "target_mean", "z_score")])


@query("volume_spikes", with_ctes(OP_EVENTS, VOLUME, body="""
SELECT workspace_id, event_type, CASE WHEN event_type IN ('support_spike', 'customer_complaint') THEN 'support_spike'
    ELSE 'anomaly' END AS insight_type,
  CASE WHEN event_type IN ('outage', 'incident', 'security_event') THEN 'high' ELSE 'medium' END AS severity,
  round(bm, 6) AS baseline_mean, round(tm, 6) AS target_mean, round(CASE WHEN bs > 0 THEN (tm - bm) / bs END, 6) AS z_score,
  'Baseline daily rate: ' || printf('%.2f', bm) AS evidence
FROM stats WHERE (bs > 0 AND (tm - bm) / bs >= 2.0 AND tm > 0.5) OR (bs = 0 AND tm > bm * 3 AND tm >= 1.5)"""))
def volume_spikes(spark, sf_dir):
    return anomalies.volume_spikes(A.op_events(spark, sf_dir), A.as_of()).select(
        "workspace_id", "event_type", "insight_type", "severity", "baseline_mean", "target_mean", "z_score",
        F.element_at("evidence", 1).alias("evidence"))


UNSTABLE = f"""
recent AS (SELECT * FROM op_events WHERE ts >= {ASOF} - INTERVAL 7 DAYS AND ts <= {ASOF}),
unstable AS (SELECT d.workspace_id, d.event_id AS deployment_id, d.title, count(*) AS issue_count,
    count(*) FILTER (WHERE i.event_type = 'outage' OR i.severity = 'critical') AS worst
  FROM recent d JOIN recent i ON i.workspace_id = d.workspace_id AND i.us BETWEEN d.us AND d.us + 7200000000
  WHERE d.event_type = 'deployment' AND i.event_type IN {ISSUES} GROUP BY ALL HAVING count(*) >= 2)
"""


@query("deployment_instability", with_ctes(OP_EVENTS, UNSTABLE, body="""
SELECT workspace_id, deployment_id, issue_count, CASE WHEN worst > 0 THEN 'critical' ELSE 'high' END AS severity,
  'Deployment ''' || title || ''' was followed by ' || issue_count || ' incident events within a 2-hour window, '
    || 'indicating potential release regression or DB saturation.' AS summary FROM unstable"""))
def deployment_instability(spark, sf_dir):
    return anomalies.deployment_instability(A.op_events(spark, sf_dir), A.as_of()).select(
        "workspace_id", "deployment_id", "issue_count", "severity", "summary")


@query("instability_entities", with_ctes(OP_EVENTS, EVENT_REFS, UNSTABLE, f"""
linked AS (
  SELECT u.workspace_id, u.deployment_id, d.chunk_id FROM unstable u JOIN op_events d ON d.event_id = u.deployment_id
  UNION SELECT u.workspace_id, u.deployment_id, i.chunk_id FROM unstable u JOIN op_events d ON d.event_id = u.deployment_id
  JOIN recent i ON i.workspace_id = d.workspace_id AND i.us BETWEEN d.us AND d.us + 7200000000
  WHERE i.event_type IN {ISSUES})
""", body="""
SELECT DISTINCT l.workspace_id, md5(l.workspace_id || '|instability|' || l.deployment_id) AS insight_id, r.name, r.type
FROM linked l JOIN refs r USING (workspace_id, chunk_id)"""))
def instability_entities(spark, sf_dir):
    events = A.op_events(spark, sf_dir)
    unstable = anomalies.deployment_instability(events, A.as_of())
    refs = A.event_entity_refs(events)
    linked = anomalies.instability_events(unstable, anomalies.deciding_issues(events, refs, A.as_of()), A.as_of())
    return anomalies.supporting_entities(linked, refs)


BOTTLENECKS = f"""
fortnight AS (SELECT * FROM op_events WHERE ts >= {ASOF} - INTERVAL 14 DAYS AND ts <= {ASOF}),
busy AS (SELECT workspace_id FROM fortnight GROUP BY 1 HAVING count(*) >= 2),
blocked AS (SELECT o.workspace_id, r.name, r.type, o.title, o.event_type,
    row_number() OVER (PARTITION BY o.workspace_id, r.name, r.type ORDER BY us, event_id) AS rank
  FROM fortnight o JOIN refs r USING (workspace_id, chunk_id)
  WHERE o.event_type IN ('incident', 'outage', 'performance_issue') AND o.workspace_id IN (FROM busy)),
bottlenecks AS (SELECT workspace_id, name, type, count(*) AS issue_count,
    CASE WHEN count(*) FILTER (WHERE event_type = 'outage') > 0 THEN 'high' ELSE 'medium' END AS severity,
    'Entity ''' || name || ''' (' || type || ') was associated with ' || count(*)
      || ' operational issue events in the last 14 days, including: '
      || string_agg('''' || title || '''', ', ' ORDER BY rank) FILTER (WHERE rank <= 3) || '.' AS summary
  FROM blocked GROUP BY workspace_id, name, type HAVING count(*) >= 2)
"""


@query("recurring_bottlenecks", with_ctes(OP_EVENTS, EVENT_REFS, BOTTLENECKS, body="SELECT * FROM bottlenecks"))
def recurring_bottlenecks(spark, sf_dir):
    events = A.op_events(spark, sf_dir)
    return anomalies.recurring_bottlenecks(events, A.event_entity_refs(events), A.as_of()).select(
        "workspace_id", "name", "type", "issue_count", "severity", "summary")


@query("detected_insights", with_ctes(OP_EVENTS, VOLUME, UNSTABLE, """
found AS (
  SELECT workspace_id, 'Abnormal volume spike in ' || event_type || ' events' AS title, 0.85::DOUBLE AS confidence,
    CASE WHEN event_type IN ('support_spike', 'customer_complaint') THEN 'support_spike' ELSE 'anomaly' END AS insight_type
  FROM stats WHERE (bs > 0 AND (tm - bm) / bs >= 2.0 AND tm > 0.5) OR (bs = 0 AND tm > bm * 3 AND tm >= 1.5)
  UNION ALL SELECT workspace_id, 'Deployment instability detected following release ''' || title || '''', 0.9,
    'deployment_instability' FROM unstable)
""", body="""
SELECT workspace_id, lower(title) AS title_key, insight_type, max(confidence) AS confidence FROM found GROUP BY ALL"""))
def detected_insights(spark, sf_dir):
    return anomalies.run_detection(A.op_events(spark, sf_dir), A.as_of()).select(
        "workspace_id", F.lower("title").alias("title_key"), "insight_type", "confidence")


INSIGHTS = """
all_found AS (
  SELECT workspace_id, md5(workspace_id || '|spike|' || event_type) AS insight_id, 'Abnormal volume spike in ' || event_type || ' events' AS title,
    'The system detected an abnormal increase in ''' || event_type || ''' events. The current ' || CASE WHEN bs > 0
      THEN 'rolling average is ' || printf('%.1f', (tm - bm) / bs) || ' standard deviations above historical baseline ('
      ELSE 'rolling average increased ' || printf('%.1f', tm / greatest(bm, 0.1::DOUBLE)) || 'x over baseline (' END
      || printf('%.2f', tm) || ' vs. ' || printf('%.2f', bm) || ' daily).' AS summary,
    CASE WHEN event_type IN ('support_spike', 'customer_complaint') THEN 'support_spike' ELSE 'anomaly' END AS insight_type,
    0.85::DOUBLE AS confidence, CASE WHEN event_type IN ('outage', 'incident', 'security_event') THEN 'high' ELSE 'medium' END AS severity,
    ['Baseline daily rate: ' || printf('%.2f', bm), 'Target window daily rate: ' || printf('%.2f', tm)] AS evidence
  FROM stats WHERE (bs > 0 AND (tm - bm) / bs >= 2.0 AND tm > 0.5) OR (bs = 0 AND tm > bm * 3 AND tm >= 1.5)
  UNION ALL SELECT u.workspace_id, md5(u.workspace_id || '|instability|' || deployment_id),
    'Deployment instability detected following release ''' || u.title || '''', 'Deployment ''' || u.title || ''' was followed by ' || issue_count
      || ' incident events within a 2-hour window, indicating potential release regression or DB saturation.',
    'deployment_instability', 0.9, CASE WHEN worst > 0 THEN 'critical' ELSE 'high' END,
    ['Deployment timestamp: ' || strftime(d.ts, '%Y-%m-%dT%H:%M:%S.%f'), 'Subsequent incidents count: ' || issue_count]
  FROM unstable u JOIN op_events d ON d.event_id = deployment_id
  UNION ALL SELECT workspace_id, md5(workspace_id || '|bottleneck|' || type || '|' || lower(name)),
    'Recurring operational bottleneck detected on ' || name, summary, 'recurring_bottleneck', 0.8, severity,
    ['Linked issue events count: ' || issue_count] FROM bottlenecks),
insights AS (
  SELECT workspace_id, insight_type, max(confidence) AS confidence, max(insight_id) AS insight_id, arg_max(title, insight_id) AS title,
    arg_max(summary, insight_id) AS summary, arg_max(severity, insight_id) AS severity, arg_max(evidence, insight_id) AS evidence
  FROM all_found GROUP BY workspace_id, insight_type, lower(trim(title)))
"""


KEYWORDS = f"""
month_events AS (SELECT * FROM op_events WHERE ts >= {ASOF} - INTERVAL 30 DAYS AND ts <= {ASOF}),
title_words AS (SELECT workspace_id, event_id, event_type, us, title,
  trim(unnest(string_split_regex(lower(title), '\\s+')), ':,.-()[]{{}}''"') AS keyword FROM month_events),
keyword_hits AS (SELECT * FROM title_words WHERE length(keyword) > 2 AND keyword NOT IN ('the', 'a', 'an', 'and', 'or',
  'but', 'in', 'on', 'at', 'to', 'for', 'with', 'by', 'of', 'from', 'release', 'version', 'chat:', 'issue', 'report:',
  'api', 'slack', 'notion', 'jira', 'webhook', 'error', 'warning', 'info', 'alert')),
ranked_hits AS (SELECT *, row_number() OVER (PARTITION BY workspace_id, keyword ORDER BY us DESC, event_id) AS rank
  FROM keyword_hits)
"""


@query("title_keyword_issues", with_ctes(OP_EVENTS, KEYWORDS, body="""
SELECT workspace_id, 'recurring-' || keyword AS issue_id, count(*) AS evidence_count,
  round(least(0.98::DOUBLE, 0.60::DOUBLE + count(*) * 0.12::DOUBLE), 2) AS confidence,
  CASE WHEN count(*) > 3 THEN 'high' ELSE 'medium' END AS severity,
  'Multiple operational events and signals referencing ''' || keyword || ''' have been correlated. This includes: '
    || string_agg(title, ', ' ORDER BY rank) FILTER (WHERE rank <= 3)
    || CASE WHEN count(*) > 3 THEN ' and ' || (count(*) - 3) || ' other event(s).' ELSE '.' END AS summary,
  CASE WHEN keyword IN ('billing', 'payment', 'stripe', 'webhook') THEN 'Billing Integration Team'
    WHEN keyword IN ('db', 'postgres', 'database', 'pool') THEN 'Database Ops Team'
    ELSE 'Infrastructure Platform Team' END AS assigned_team,
  string_agg(DISTINCT event_type, ',' ORDER BY event_type) AS data_sources
FROM ranked_hits GROUP BY workspace_id, keyword HAVING count(*) >= 2"""))
def title_keyword_issues(spark, sf_dir):
    return issues.recurring_issues(A.op_events(spark, sf_dir), A.as_of()).select(
        "workspace_id", "issue_id", "evidence_count", "confidence", "severity", "summary", "assigned_team", "data_sources")


@query("deployment_stability", with_ctes(OP_EVENTS, f"""
recent AS (SELECT * FROM op_events WHERE ts >= {ASOF} - INTERVAL 30 DAYS AND ts <= {ASOF}),
linked AS (SELECT d.workspace_id, d.event_id, d.author, count(i.event_id) AS incident_count FROM recent d
  LEFT JOIN recent i ON i.workspace_id = d.workspace_id AND i.us BETWEEN d.us AND d.us + 7200000000
    AND i.event_type IN ('incident', 'outage', 'abnormal_incident_frequency')
  WHERE d.event_type = 'deployment' GROUP BY ALL)
""", body="""
SELECT workspace_id, event_id, coalesce(author, 'Unknown') AS author, incident_count,
  CASE incident_count WHEN 0 THEN 100.0::DOUBLE WHEN 1 THEN 50.0 ELSE 0.0 END AS stability_score FROM linked"""))
def deployment_stability(spark, sf_dir):
    return issues.deployment_stability(A.op_events(spark, sf_dir), A.as_of()).select(
        "workspace_id", "event_id", "author", "incident_count", "stability_score")


@query("incident_explorer", with_ctes(OP_EVENTS, body=f"""
SELECT workspace_id, event_id, coalesce(severity, 'medium') AS severity, '#ops-alerts' AS channel, 'N/A' AS ticket,
  'ServiceA' AS affected_system FROM op_events
WHERE ts >= {ASOF} - INTERVAL 15 DAYS AND ts <= {ASOF} AND event_type IN ('incident', 'outage')
  AND (lower(title) LIKE '%service\\_1%' ESCAPE '\\' OR lower(coalesce(description, '')) LIKE '%service\\_1%' ESCAPE '\\'
    OR lower(title) LIKE '%outage%')"""))
def incident_explorer(spark, sf_dir):
    found = issues.explore_incidents(issues.incidents(A.op_events(spark, sf_dir), A.as_of()), "an outage on service_1")
    return found.select("workspace_id", "event_id", "severity", "channel", "ticket", "affected_system")


@query("report_timeline", with_ctes(OP_EVENTS, body=f"""
SELECT workspace_id, event_id AS id, event_type, us AS ts_us, coalesce(description, '') AS summary,
  coalesce(severity, 'medium') AS severity FROM op_events WHERE ts >= {ASOF} - INTERVAL 7 DAYS AND ts <= {ASOF}"""))
def report_timeline(spark, sf_dir):
    return issues.report_timeline(A.op_events(spark, sf_dir), A.as_of()).select(
        "workspace_id", "id", "event_type", us("ts", "ts_us"), "summary", "severity")


@query("pattern_report", with_ctes(OP_EVENTS, EVENT_REFS, FREQUENCIES, DEPLOYMENTS, f"""
marked AS (
  SELECT *, CASE WHEN lag(us) OVER w IS NULL OR us - lag(us) OVER w > 7200000000 THEN 1 ELSE 0 END AS opens
  FROM op_events WINDOW w AS (PARTITION BY workspace_id ORDER BY us, event_id)),
numbered AS (SELECT workspace_id, sum(opens) OVER (PARTITION BY workspace_id ORDER BY us, event_id
  ROWS UNBOUNDED PRECEDING) AS c FROM marked),
big AS (SELECT workspace_id, c FROM numbered GROUP BY ALL HAVING count(*) >= 2)
""", body=f"""
SELECT workspace_id, 'temporal_clusters' AS section, count(*) AS n FROM big GROUP BY 1
UNION ALL SELECT workspace_id, 'incident_frequencies', count(DISTINCT (name, type)) FROM freq GROUP BY 1
UNION ALL SELECT d.workspace_id, 'deployment_incidents', count(*) FROM deps d
  JOIN op_events i ON i.workspace_id = d.workspace_id AND i.us BETWEEN d.us AND d.us + 3600000000
  WHERE i.event_type IN {ISSUES} GROUP BY 1"""))
def pattern_report(spark, sf_dir):
    events = A.op_events(spark, sf_dir)
    return digest.pattern_report(events, A.event_entity_refs(events))
