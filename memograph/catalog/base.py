"""Registry and the SQL form of the adapters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from memograph.adapters import AS_OF, CHAT_EPOCH, DOC_EPOCH

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

ASOF = f"TIMESTAMP '{AS_OF}'"


def query(name: str, oracle: str | None = None) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn

    return register


def with_ctes(*parts: str, body: str) -> str:
    return "WITH " + ",\n".join(p.strip() for p in parts) + "\n" + body.strip()


def us(c: str | Column, name: str) -> Column:
    return F.unix_micros(F.col(c) if isinstance(c, str) else c).alias(name)


def joined(c: str | Column, name: str, sep: str = ",") -> Column:
    """Sorted array as text, so both engines hash the same value."""
    return F.array_join(F.array_sort(c), sep).alias(name)


OP_EVENTS = """
raw_events AS (
  SELECT *, CAST(regexp_extract(props, '"k": ?([0-9]+)', 1) AS INTEGER) AS k FROM events
),
typed_events AS (
  SELECT *, CASE WHEN event_type = 'error' AND value >= 20 THEN 'outage' WHEN event_type = 'error' THEN 'incident'
    WHEN event_type = 'purchase' THEN 'deployment' WHEN event_type = 'signup' THEN 'escalation'
    WHEN event_type = 'click' AND k % 3 = 0 THEN 'performance_issue' WHEN event_type = 'click' THEN 'support_spike'
    ELSE 'discussion' END AS kind FROM raw_events
),
op_events AS (
  SELECT 'event_' || event_id AS event_id, 'ws_' || (user_id % 50) AS workspace_id, kind AS event_type,
    CASE kind WHEN 'outage' THEN 'Outage' WHEN 'incident' THEN 'Incident' WHEN 'deployment' THEN 'Deployment'
      WHEN 'escalation' THEN 'Escalation' WHEN 'performance_issue' THEN 'Performance Issue'
      WHEN 'support_spike' THEN 'Support Spike' ELSE 'Discussion' END || ' on service_' || (k % 20) AS title,
    CASE WHEN k % 4 <> 3 THEN 'k=' || k || ' seen by user ' || user_id END AS description, ts,
    CASE WHEN k % 10 = 9 THEN NULL WHEN value < 5 THEN 'low' WHEN value < 20 THEN 'medium' WHEN value < 60 THEN 'high'
      ELSE 'critical' END AS severity,
    round(0.5::DOUBLE + (k % 50) / 100.0::DOUBLE, 2) AS confidence,
    'chunk_' || user_id || '_' || strftime(ts, '%Y%m%d') AS chunk_id,
    CASE WHEN k % 5 = 0 THEN ['service_' || (k % 20), 'Team_' || (k % 7), 'production']
      ELSE ['service_' || (k % 20), 'Team_' || (k % 7)] END AS entities,
    CASE WHEN k % 2 = 0 THEN 'user_' || user_id END AS author, epoch_us(ts) AS us
  FROM typed_events
)
"""

EVENT_REFS = """
event_mentions AS (SELECT DISTINCT workspace_id, chunk_id, unnest(entities) AS name FROM op_events),
refs AS (
  SELECT *, CASE WHEN starts_with(name, 'service_') THEN 'system' WHEN starts_with(name, 'Team_') THEN 'team'
    ELSE 'document' END AS type FROM event_mentions
)
"""

RAW_DOCS = f"""
numbered_docs AS (
  SELECT *, CAST(substr(source, 4) AS INTEGER) % 4 AS s FROM documents
),
noted_docs AS (
  SELECT *, CASE doc_id % 6
    WHEN 0 THEN 'Incident-' || (doc_id % 40) || ' outage of postgres in production, @user_' || (doc_id % 13)
      || ' paged. 2024-01-' || lpad((doc_id % 28 + 1)::VARCHAR, 2, '0') || ' 10:15'
    WHEN 1 THEN 'Deployment of project Apollo to staging shipped by @user_' || (doc_id % 13)
      || '; docker and kubernetes updated'
    WHEN 2 THEN 'Weekly sync with engineering about project-p' || (doc_id % 9) || ' migration'
    WHEN 3 THEN 'High latency on aws after rollback, timeout seen'
    WHEN 5 THEN 'Decision: we will use the github runbook for onboarding' ELSE '' END AS note
  FROM numbered_docs
),
raw_docs AS (
  SELECT 'doc_' || doc_id AS id, CASE s WHEN 0 THEN 'slack' WHEN 1 THEN 'notion' WHEN 2 THEN 'jira' ELSE 'gdrive' END
      AS source, 'ws_' || (doc_id % 8) AS workspace_id, CASE WHEN s = 1 THEN 'space_' || lang END AS parent_id,
    '/' || lang || '/' || source || '/doc_' || doc_id AS path,
    CASE WHEN doc_id % 50 = 49 THEN '' ELSE 'Note ' || doc_id || ' ' || lang END AS title,
    CASE WHEN note = '' THEN text ELSE text || chr(10) || note END AS content,
    CASE WHEN s <> 0 THEN 'https://wiki.example.com/' || lang || '/' || doc_id END AS url,
    CASE WHEN doc_id % 3 = 0 THEN 'user_' || (doc_id % 13) END AS author,
    CASE WHEN doc_id % 3 = 1 THEN 'user_' || (doc_id % 13) END AS created_by,
    CASE WHEN doc_id % 4 <> 3 THEN make_timestamp(({DOC_EPOCH} - doc_id * 420) * 1000000) END AS created_time,
    make_timestamp(({DOC_EPOCH} - doc_id * 420) * 1000000) AS last_edited_time,
    CASE WHEN s = 0 THEN 'chan_' || (doc_id % 5) END AS channel_name,
    CASE WHEN doc_id % 7 = 0 THEN 'platform' END AS team, [lang] AS tags, doc_id
  FROM noted_docs
)
"""

CHAT = f"""
conv_sizes AS (SELECT conv_id, count(*) AS n FROM conversations GROUP BY conv_id),
messages AS (
  SELECT 'C' || (c.conv_id % 7) AS channel_id, 'chan_' || (c.conv_id % 7) AS channel_name,
    ({CHAT_EPOCH} + c.conv_id * 7200 + turn * 60) AS sec,
    ({CHAT_EPOCH} + c.conv_id * 7200 + turn * 60) || '.000100' AS ts,
    CASE WHEN c.conv_id % 2 = 0 AND n > 1 THEN ({CHAT_EPOCH} + c.conv_id * 7200) || '.000100' END AS thread_ts,
    CASE WHEN c.conv_id % 2 = 0 AND n > 1 AND turn = 0 THEN n - 1 ELSE 0 END AS reply_count,
    CASE WHEN role <> 'system' THEN 'U' || ((c.conv_id * 3 + turn) % 30) END AS user,
    text || ' <@U' || (turn % 11) || '> cc <@U' || ((turn + 3) % 11) || '>' AS text,
    turn % 11 AS m1, (turn + 3) % 11 AS m2
  FROM conversations c JOIN conv_sizes USING (conv_id)
),
users AS (
  SELECT 'U' || n_nationkey AS user_id,
    CASE WHEN n_nationkey % 3 <> 0 THEN upper(substr(n_name, 1, 1)) || lower(substr(n_name, 2))
      WHEN n_nationkey % 2 = 0 THEN 'Real ' || n_nationkey ELSE 'login' || n_nationkey END AS shown
  FROM nation
)
"""
