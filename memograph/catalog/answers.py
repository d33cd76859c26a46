"""Question profiles, time phrases, root causes and composed answers."""

from __future__ import annotations

from pyspark.sql import functions as F

from memograph import adapters as A
from memograph.catalog.base import ASOF, OP_EVENTS, query, us, with_ctes
from memograph.catalog.detectors import CHAINS, DEPLOYMENTS, FREQUENCIES, ISSUES, RECURRING
from memograph.catalog.documents import LEFT, RAW_DOCS, RIGHT, STANDARD
from memograph.catalog.records import ALL_INSIGHTS
from memograph.catalog.search import (
    CORRELATIONS, EVIDENCE, FOUND_EVENTS, QUESTIONS, VECTORS, chunk_texts, hits_sql, lite_events, questions, stored_chunks, stored_correlations,
    stored_keys, stored_traits,
)
from memograph import vocab
from memograph.functions import text
from memograph.operators import anomalies, patterns, reasoning, retrieval
from memograph.session import cut_lineage

PHRASES = [
    "Why did checkout fail over the last 3 days", "recurring alert since Q1", "what happened yesterday", "Show the trend TODAY",
    "slow onboarding since March 12", "timeline after 2024-01-05 first outage", "spike during the past 2 weeks",
    "root cause of rollback in the last 12 hours", "anything unusual recently", "how many sev alerts last 2 months",
    "which pipeline is blocked since Feb 30", "list the deployments", "the history since December 24", "paged 5 hours ago",
]

ASKED = f"""
asked AS (SELECT conv_id * 1000 + turn AS query_id,
  {PHRASES!r}[(conv_id * 5 + turn * 3) % {len(PHRASES)} + 1] || ' ' || text AS question FROM conversations)
"""


def asked(spark, sf_dir):
    conv = A.table(spark, sf_dir, "conversations")
    phrase = F.element_at(F.array(*[F.lit(p) for p in PHRASES]),
                          ((F.col("conv_id") * 5 + F.col("turn") * 3) % len(PHRASES) + 1).cast("int"))
    return conv.select((F.col("conv_id") * 1000 + F.col("turn")).alias("query_id"), F.concat(phrase, F.lit(" "), "text").alias("question"))


def _profile_sql() -> str:
    counts = []
    for i, (_, words) in enumerate(vocab.QUERY_PROFILES):
        hits = " + ".join(f"CAST(regexp_matches(q, '{LEFT}{w}{RIGHT}') AS INTEGER)" for w in words)
        counts.append(f"{hits} AS c{i}")
    names = [name for name, _ in vocab.QUERY_PROFILES]
    best = "greatest(" + ", ".join(f"c{i}" for i in range(len(names))) + ")"
    pick = " ".join(f"WHEN c{i} = n THEN '{name}'" for i, name in enumerate(names))
    return f"""
lowered AS (SELECT query_id, lower(question) AS q FROM asked),
counts AS (SELECT query_id, q, {', '.join(counts)} FROM lowered),
bests AS (SELECT *, {best} AS n FROM counts),
profiles AS (SELECT query_id, CASE WHEN n = 0 THEN CASE WHEN regexp_matches(q, '^(how|what|which|where)')
    THEN 'root_cause_analysis' ELSE 'recurring_issue' END {pick} END AS query_type,
  round(0.5::DOUBLE + least(n * 0.15::DOUBLE, 0.49::DOUBLE), 2) AS class_confidence FROM bests)
"""


@query("query_profiles", with_ctes(ASKED, _profile_sql(), body="SELECT * FROM profiles"))
def query_profiles(spark, sf_dir):
    return reasoning.classify(asked(spark, sf_dir)).select("query_id", "query_type", "class_confidence")


def _amount(unit: str) -> str:
    return (rf"\b(?:during|since|in|over)?\s*(?:last|past|the\s+last|the\s+past)?\s+(\d+)\s+{unit}s?"
            rf"(?:$|[^\p{{L}}\p{{N}}_])")


RANGES = rf"""
lowered AS (SELECT query_id, lower(question) AS q FROM asked),
found AS (SELECT query_id, q,
  try_cast(regexp_extract(' ' || q, '{_amount("hour")}', 1) AS BIGINT) AS h, try_cast(regexp_extract(' ' || q, '{_amount("day")}', 1) AS BIGINT) AS d,
  try_cast(regexp_extract(' ' || q, '{_amount("week")}', 1) AS BIGINT) AS w, try_cast(regexp_extract(' ' || q, '{_amount("month")}', 1) AS BIGINT) AS m,
  try_cast(regexp_extract(q, '{LEFT}(?:since|during)\s+q([1-4]){RIGHT}', 1) AS INTEGER) AS quarter,
  regexp_extract(q, '{LEFT}(?:since|after|on)\s+([a-z]+)\s+(\d{{1,2}}){RIGHT}', 1) AS month,
  regexp_extract(q, '{LEFT}(?:since|after|on)\s+([a-z]+)\s+(\d{{1,2}}){RIGHT}', 2) AS dom,
  try_cast(regexp_extract(q, '{LEFT}(?:since|after|on)\s+(\d{{4}}-\d{{2}}-\d{{2}}){RIGHT}', 1) AS TIMESTAMP) AS iso FROM lowered),
dated AS (SELECT *, CASE month WHEN 'march' THEN '03' WHEN 'feb' THEN '02' WHEN 'december' THEN '12' END AS mm FROM found),
named AS (SELECT *, try_cast('2024-' || mm || '-' || lpad(dom, 2, '0') AS TIMESTAMP) AS y0,
  try_cast('2023-' || mm || '-' || lpad(dom, 2, '0') AS TIMESTAMP) AS y1 FROM dated),
ranges AS (SELECT query_id, CASE WHEN h IS NOT NULL THEN {ASOF} - to_hours(h) WHEN d IS NOT NULL THEN {ASOF} - to_days(d::INTEGER)
    WHEN w IS NOT NULL THEN {ASOF} - to_days(7 * w::INTEGER) WHEN m IS NOT NULL THEN {ASOF} - to_days(30 * m::INTEGER)
    WHEN regexp_matches(q, '{LEFT}today{RIGHT}') THEN {ASOF}
    WHEN regexp_matches(q, '{LEFT}yesterday{RIGHT}') THEN {ASOF} - INTERVAL 1 DAY
    WHEN quarter IS NOT NULL THEN make_timestamp(2024, quarter * 3 - 2, 1, 0, 0, 0.0)
    WHEN y0 IS NOT NULL AND y0 > {ASOF} THEN y1 WHEN y0 IS NOT NULL THEN y0 ELSE iso END AS s, quarter, h, d, w, m, q FROM named)
"""


@query("query_time_ranges", with_ctes(ASKED, RANGES, body=f"""
SELECT query_id, epoch_us(s) AS start_us,
  epoch_us(CASE WHEN s IS NULL THEN NULL WHEN quarter IS NOT NULL AND h IS NULL AND d IS NULL AND w IS NULL AND m IS NULL
    AND NOT regexp_matches(q, '{LEFT}(today|yesterday){RIGHT}') THEN s + INTERVAL 3 MONTHS - INTERVAL 1 SECOND ELSE {ASOF} END) AS end_us
FROM ranges"""))
def query_time_ranges(spark, sf_dir):
    return reasoning.time_ranges(asked(spark, sf_dir), A.as_of()).select("query_id", us("start", "start_us"), us("end", "end_us"))


@query("rolling_time_ranges", with_ctes(ASKED, rf"""
found AS (SELECT query_id, question, lower(question) AS q,
  try_cast(regexp_extract(lower(question), '{LEFT}last\s+([0-9]+)\s+days?{RIGHT}', 1) AS INTEGER) AS d,
  try_cast(regexp_extract(lower(question), '{LEFT}last\s+([0-9]+)\s+weeks?{RIGHT}', 1) AS INTEGER) AS w,
  try_cast(regexp_extract(lower(question), '{LEFT}last\s+([0-9]+)\s+hours?{RIGHT}', 1) AS BIGINT) AS h FROM asked)
""", body=f"""
SELECT query_id, epoch_us(CASE WHEN d IS NOT NULL THEN {ASOF} - to_days(d) WHEN w IS NOT NULL THEN {ASOF} - to_days(7 * w)
  WHEN h IS NOT NULL THEN {ASOF} - to_hours(h) WHEN regexp_matches(q, '{LEFT}past\\s+week{RIGHT}') THEN {ASOF} - INTERVAL 7 DAYS
  WHEN regexp_matches(q, '{LEFT}yesterday{RIGHT}') THEN {ASOF} - INTERVAL 2 DAYS
  WHEN regexp_matches(q, '{LEFT}today{RIGHT}') THEN {ASOF} - INTERVAL 12 HOURS
  WHEN regexp_matches(q, '{LEFT}recent{RIGHT}') THEN {ASOF} - INTERVAL 14 DAYS END) AS start_us FROM found"""))
def rolling_time_ranges(spark, sf_dir):
    return reasoning.time_ranges(asked(spark, sf_dir), A.as_of(), rolling=True).select("query_id", us("start", "start_us"))


REPORT = """
reports AS (SELECT doc_id, 'Root Cause: pool ' || (doc_id % 17) || ' ran dry. Observed Effects: latency on node ' || (doc_id % 9)
  || ' Actions Taken: ' || text AS report FROM documents)
"""


@query("report_sections", with_ctes(REPORT, r"""
flat AS (SELECT doc_id, trim(regexp_replace(left(report, 800), '\s+', ' ', 'g'), ' ') AS t FROM reports)
""", body=r"""
SELECT doc_id, regexp_extract(t, '^Root Cause: (pool \d+ ran dry\.) Observed', 1) AS root_cause,
  regexp_extract(t, 'Observed Effects: (latency on node \d+) Actions', 1) AS impact,
  md5(trim(regexp_extract(t, '^Root Cause: pool \d+ ran dry\. Observed Effects: latency on node \d+ Actions Taken: (.*)$', 1), ' ')) AS remedy_md5
FROM flat"""))
def report_sections(spark, sf_dir):
    docs = A.table(spark, sf_dir, "documents")
    report = F.concat(F.lit("Root Cause: pool "), F.col("doc_id") % 17, F.lit(" ran dry. Observed Effects: latency on node "),
                      F.col("doc_id") % 9, F.lit(" Actions Taken: "), "text")
    return docs.select("doc_id", text.report_sections(report).alias("s")).select(
        "doc_id", F.col("s.root_cause").alias("root_cause"), F.col("s.impact").alias("impact"), F.md5("s.remediation").alias("remedy_md5"))


TRACES = """
near AS (SELECT q.query_id, q.workspace_id, c.chunk_id, c.us, row_number() OVER (PARTITION BY q.query_id ORDER BY
    round(list_dot_product(q.q, c.v) / (sqrt(list_dot_product(q.q, q.q)) * sqrt(list_dot_product(c.v, c.v))), 9) DESC, c.chunk_id) AS r
  FROM questions q JOIN chunks c ON c.workspace_id = q.workspace_id),
named AS (SELECT workspace_id, chunk_id, us, unnest(list_distinct(entities)) AS entity FROM chunks),
latest AS (SELECT *, row_number() OVER (PARTITION BY workspace_id, entity ORDER BY us DESC, 'event_' || chunk_id) AS r FROM named),
asked_for AS (SELECT query_id, workspace_id, unnest(asked) AS entity FROM questions),
events_found AS (SELECT query_id, workspace_id, chunk_id, us FROM near WHERE r <= 10
  UNION SELECT a.query_id, a.workspace_id, chunk_id, us FROM asked_for a JOIN latest l
    ON l.workspace_id = a.workspace_id AND l.entity = a.entity AND l.r <= 10),
steps AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY us, 'event_' || chunk_id) AS step FROM events_found),
both_ends AS (SELECT workspace_id, source_a AS a, source_b AS b, type, score, reason FROM correlations
  UNION SELECT workspace_id, source_b, source_a, type, score, reason FROM correlations),
linked AS (SELECT x.query_id, x.chunk_id AS f, y.chunk_id AS t, c.type, c.score, row_number() OVER (
    PARTITION BY x.query_id, x.chunk_id, y.chunk_id ORDER BY c.score DESC, c.type) AS r
  FROM steps x JOIN both_ends c ON c.workspace_id = x.workspace_id AND c.a = x.chunk_id
  JOIN steps y ON y.query_id = x.query_id AND y.chunk_id = c.b AND x.step < y.step),
links AS (SELECT * FROM linked WHERE r = 1)
"""


@query("root_cause_links", with_ctes(RAW_DOCS, STANDARD, VECTORS, CORRELATIONS, QUESTIONS, TRACES, body="""
SELECT query_id, 'event_' || f AS from_event, 'event_' || t AS to_event, type, score AS score FROM links"""))
def root_cause_links(spark, sf_dir):
    rows = stored_traits(spark, sf_dir)
    prepared = retrieval.prepare_questions(questions(spark, sf_dir), A.as_of())
    events = cut_lineage(retrieval.related_events(prepared, lite_events(rows), 10))
    found = reasoning.links(events, stored_correlations(rows))
    return found.select("query_id", "from_event", "to_event", "type", "score")


@query("root_cause_confidence", with_ctes(
    RAW_DOCS, STANDARD, VECTORS, CORRELATIONS, QUESTIONS, TRACES, OP_EVENTS, DEPLOYMENTS, RECURRING, CHAINS, """
per AS (SELECT query_id, count(*) AS n, avg(score) AS s FROM links GROUP BY 1),
known AS (SELECT workspace_id, pattern_id, lower(entities) AS csv FROM recurring_patterns
  UNION ALL SELECT workspace_id, pattern_id, lower(array_to_string(ents, ',')) FROM chains),
wanted_names AS (SELECT query_id, workspace_id, unnest(list_append(asked, 'Service_' || label)) AS e FROM questions),
fitting AS (SELECT query_id, count(DISTINCT pattern_id) AS p FROM wanted_names w JOIN known k ON k.workspace_id = w.workspace_id
  AND contains(csv, lower(e)) GROUP BY 1)
""", body="""
SELECT q.query_id, coalesce(n, 0) AS link_count, coalesce(f.p, 0) AS pattern_count,
  round(least(CASE WHEN n > 0 THEN least(0.5::DOUBLE + s * 0.4::DOUBLE, 0.99::DOUBLE) ELSE 0.5 END
    + CASE WHEN f.p > 0 THEN 0.1::DOUBLE ELSE 0 END, 0.99::DOUBLE), 2) AS trace_confidence
FROM questions q LEFT JOIN per p ON p.query_id = q.query_id LEFT JOIN fitting f ON f.query_id = q.query_id"""))
def root_cause_confidence(spark, sf_dir):
    rows = stored_traits(spark, sf_dir)
    prepared = cut_lineage(retrieval.prepare_questions(questions(spark, sf_dir), A.as_of()))
    events = cut_lineage(retrieval.related_events(prepared, lite_events(rows), 10))
    # The questions ask for a service too, as the patterns name it.
    service = F.concat(F.lit("Service_"), F.regexp_extract("query_id", r"^q(\d+)_", 1))
    asking = prepared.withColumn("q_entities", F.array_append("q_entities", service))
    traced = reasoning.root_cause(asking, events, stored_correlations(rows), pattern_table(spark, sf_dir))
    return traced["summary"].select("query_id", "link_count", "pattern_count", "trace_confidence")


#: What the detectors of patterns read.
PATTERN_COLUMNS = ["workspace_id", "event_id", "event_type", "title", "ts", "entities"]


def pattern_table(spark, sf_dir):
    """Patterns of the event log; the events are stored once, the patterns are not: they grow with the square of the events."""
    return patterns.all_patterns(cut_lineage(A.op_events(spark, sf_dir).select(*PATTERN_COLUMNS)), A.as_of())


@query("matched_patterns", with_ctes(OP_EVENTS, f"""
hits AS (SELECT workspace_id, unnest(list_distinct(entities)) AS entity FROM op_events
  WHERE event_type IN ('incident', 'escalation') AND ts >= {ASOF} - INTERVAL 7 DAYS AND ts <= {ASOF}),
recurring AS (SELECT workspace_id, entity FROM hits WHERE lower(entity) NOT IN ('production') GROUP BY ALL HAVING count(*) >= 2),
wanted AS (SELECT DISTINCT workspace_id, unnest(entities) AS entity FROM op_events WHERE severity = 'critical' AND event_type = 'outage')
""", body="""
SELECT DISTINCT r.workspace_id AS query_id, 'pattern_recurring_' || lower(r.entity) AS pattern_id FROM recurring r
JOIN wanted w ON w.workspace_id = r.workspace_id AND contains(lower(r.entity), lower(w.entity))"""))
def matched_patterns(spark, sf_dir):
    events = A.op_events(spark, sf_dir)
    wanted = events.filter("severity = 'critical' AND event_type = 'outage'").groupBy("workspace_id").agg(
        F.flatten(F.collect_set("entities")).alias("q_entities")).withColumn("query_id", F.col("workspace_id"))
    return reasoning.matching_patterns(wanted, patterns.recurring_incidents(events, A.as_of())).select("query_id", "pattern_id")


@query("multi_hop_events", with_ctes(RAW_DOCS, STANDARD, VECTORS, QUESTIONS, """
near AS (SELECT q.query_id, q.workspace_id, c.chunk_id, c.entities, row_number() OVER (PARTITION BY q.query_id ORDER BY
    round(list_dot_product(q.q, c.v) / (sqrt(list_dot_product(q.q, q.q)) * sqrt(list_dot_product(c.v, c.v))), 9) DESC, c.chunk_id) AS r
  FROM questions q JOIN chunks c ON c.workspace_id = q.workspace_id),
top AS (SELECT * FROM near WHERE r <= 5),
names AS (SELECT DISTINCT query_id, workspace_id, lower(e) AS wanted FROM (
  SELECT query_id, workspace_id, unnest(asked) AS e FROM questions UNION ALL SELECT query_id, workspace_id, unnest(entities) FROM top)),
refs AS (SELECT DISTINCT workspace_id, chunk_id, unnest(entities) AS name FROM chunks),
resolved AS (SELECT DISTINCT query_id, n.workspace_id, name FROM refs r JOIN names n ON n.workspace_id = r.workspace_id AND contains(lower(name), wanted)),
reach AS (SELECT DISTINCT query_id, r.workspace_id, chunk_id FROM resolved x JOIN refs r ON r.workspace_id = x.workspace_id AND r.name = x.name
  UNION SELECT query_id, workspace_id, chunk_id FROM top
  UNION SELECT n.query_id, c.workspace_id, c.chunk_id FROM names n JOIN chunks c ON c.workspace_id = n.workspace_id
    JOIN standard_docs d ON d.id = c.chunk_id WHERE contains(lower(d.title), wanted) OR contains(lower(c.text), wanted)),
timed AS (SELECT e.query_id, e.chunk_id, c.us, row_number() OVER (PARTITION BY e.query_id ORDER BY c.us DESC, 'event_' || e.chunk_id) AS r
  FROM reach e JOIN chunks c ON c.chunk_id = e.chunk_id JOIN questions q ON q.query_id = e.query_id
  WHERE q.q_start IS NULL OR c.ts BETWEEN q.q_start AND q.q_end)
""", body="SELECT query_id, 'event_' || chunk_id AS event_id, r AS rank FROM timed WHERE r <= 100"))
def multi_hop_events(spark, sf_dir):
    rows = stored_chunks(spark, sf_dir)
    prepared = cut_lineage(retrieval.prepare_questions(questions(spark, sf_dir), A.as_of()))
    hits = cut_lineage(retrieval.filtered_knn(prepared, rows, 5).select("query_id", "workspace_id", "chunk_id", "entities"))
    refs = rows.select("workspace_id", "chunk_id", F.explode("entities").alias("name")).distinct()
    events = rows.select("workspace_id", "chunk_id", F.concat(F.lit("event_"), "chunk_id").alias("event_id"), "ts",
                         "title", F.col("text").alias("description"))
    return reasoning.multi_hop_events(prepared, hits, refs, events).select("query_id", "event_id", "rank")


def event_questions(spark, sf_dir):
    """The questions over documents, with the event log of their workspaces as what has happened there."""
    return cut_lineage(retrieval.prepare_questions(questions(spark, sf_dir), A.as_of()))


@query("multi_hop", with_ctes(RAW_DOCS, STANDARD, VECTORS, QUESTIONS, *ALL_INSIGHTS, FREQUENCIES, DEPLOYMENTS, f"""
near AS (SELECT q.query_id, q.workspace_id, c.chunk_id, c.entities, row_number() OVER (PARTITION BY q.query_id ORDER BY
    round(list_dot_product(q.q, c.v) / (sqrt(list_dot_product(q.q, q.q)) * sqrt(list_dot_product(c.v, c.v))), 9) DESC, c.chunk_id) AS r
  FROM questions q JOIN chunks c ON c.workspace_id = q.workspace_id WHERE q_start IS NULL OR c.ts BETWEEN q_start AND q_end),
top AS (SELECT * FROM near WHERE r <= 5),
names AS (SELECT DISTINCT query_id, workspace_id, lower(e) AS wanted FROM (
  SELECT query_id, workspace_id, unnest(asked) AS e FROM questions UNION ALL SELECT query_id, workspace_id, unnest(entities) FROM top)),
mentioned AS (SELECT DISTINCT query_id, r.workspace_id, chunk_id FROM refs r JOIN names n ON n.workspace_id = r.workspace_id AND contains(lower(name), wanted)),
reach AS (SELECT m.query_id, event_id FROM mentioned m JOIN op_events o ON o.workspace_id = m.workspace_id AND o.chunk_id = m.chunk_id
  UNION SELECT t.query_id, event_id FROM top t JOIN op_events o ON o.workspace_id = t.workspace_id AND o.chunk_id = t.chunk_id
  UNION SELECT n.query_id, event_id FROM names n JOIN op_events o ON o.workspace_id = n.workspace_id
    WHERE contains(lower(title), wanted) OR contains(lower(coalesce(description, '')), wanted)),
dated AS (SELECT r.query_id, o.us, o.event_id FROM reach r JOIN op_events o USING (event_id) JOIN questions q USING (query_id)
  WHERE q_start IS NULL OR o.ts BETWEEN q_start AND q_end),
reached AS (SELECT query_id, least(count(*), 100) AS n FROM dated GROUP BY 1),
shown AS (SELECT q.query_id, o.us, o.event_id, row_number() OVER (PARTITION BY q.query_id ORDER BY o.us DESC, o.event_id) AS r
  FROM questions q JOIN op_events o USING (workspace_id)
  WHERE (q_start IS NULL OR o.ts BETWEEN q_start AND q_end) AND (q.query_id NOT IN (SELECT query_id FROM mentioned)
    OR EXISTS (SELECT 1 FROM mentioned m WHERE m.query_id = q.query_id AND m.chunk_id = o.chunk_id AND m.workspace_id = o.workspace_id))),
paged AS (SELECT *, (us - lag(us) OVER (PARTITION BY query_id ORDER BY us, r DESC)) / 1000000.0::DOUBLE AS d FROM shown WHERE r <= 50),
pages AS (SELECT query_id, count(*) AS n, max(d) AS gap FROM paged GROUP BY 1),
opening AS (SELECT *, CASE WHEN lag(us) OVER w IS NULL OR us - lag(us) OVER w > 7200000000 THEN 1 ELSE 0 END AS opens
  FROM op_events WINDOW w AS (PARTITION BY workspace_id ORDER BY us, event_id)),
numbering AS (SELECT workspace_id, sum(opens) OVER (PARTITION BY workspace_id ORDER BY us, event_id ROWS UNBOUNDED PRECEDING) AS c FROM opening),
crowds AS (SELECT workspace_id, count(*) AS n FROM (SELECT workspace_id, c FROM numbering GROUP BY ALL HAVING count(*) >= 2) GROUP BY 1),
affected AS (SELECT workspace_id, count(DISTINCT (name, type)) AS n FROM freq GROUP BY 1),
followed AS (SELECT d.workspace_id, count(*) AS n FROM deps d JOIN op_events i ON i.workspace_id = d.workspace_id
  AND i.us BETWEEN d.us AND d.us + 3600000000 WHERE i.event_type IN {ISSUES} GROUP BY 1),
told AS (SELECT workspace_id, count(*) AS n, round(avg(confidence), 2) AS confidence FROM insights GROUP BY 1),
hit_counts AS (SELECT query_id, count(*) AS n FROM top GROUP BY 1)
""", body="""
SELECT q.query_id, coalesce(h.n, 0) AS hits, coalesce(e.n, 0) AS events, coalesce(p.n, 0) AS timeline_events, p.gap AS longest_gap_seconds,
  coalesce(c.n, 0) AS temporal_clusters, coalesce(a.n, 0) AS incident_frequencies, coalesce(f.n, 0) AS deployment_incidents,
  coalesce(t.n, 0) AS insights, coalesce(t.confidence, 0.8) AS confidence
FROM questions q LEFT JOIN hit_counts h ON h.query_id = q.query_id LEFT JOIN reached e ON e.query_id = q.query_id LEFT JOIN pages p ON p.query_id = q.query_id
  LEFT JOIN crowds c ON c.workspace_id = q.workspace_id LEFT JOIN affected a ON a.workspace_id = q.workspace_id
  LEFT JOIN followed f ON f.workspace_id = q.workspace_id LEFT JOIN told t ON t.workspace_id = q.workspace_id"""))
def multi_hop(spark, sf_dir):
    """Questions over documents, followed into the event log of their workspaces."""
    log = cut_lineage(A.op_events(spark, sf_dir))
    refs = cut_lineage(A.event_entity_refs(log))
    insights = cut_lineage(anomalies.all_insights(log, refs, A.as_of()))
    parts = reasoning.multi_hop(event_questions(spark, sf_dir), stored_chunks(spark, sf_dir), refs, log, insights)
    return parts["summary"].select(
        "query_id", "hits", "events", "timeline_events", "longest_gap_seconds", "temporal_clusters", "incident_frequencies", "deployment_incidents",
        "insights", "confidence")


def answered(spark, sf_dir):
    rows = stored_keys(spark, sf_dir)
    asked_rows = cut_lineage(questions(spark, sf_dir))
    return reasoning.answer(asked_rows, rows, lite_events(rows), stored_correlations(rows), pattern_table(spark, sf_dir), A.as_of(),
                            texts=chunk_texts(spark, sf_dir))


def three(cause: str, impact: str, remedy: str) -> str:
    return f"'**Root Cause**: ' || {cause} || chr(10) || '**Impact**: ' || {impact} || chr(10) || '**Remediation**: ' || {remedy}"


# Test texts carry no labelled sections, so the first text of an answer gives the defaults.
ANSWERED = (RAW_DOCS, STANDARD, VECTORS, CORRELATIONS, QUESTIONS, hits_sql(60), EVIDENCE, FOUND_EVENTS, OP_EVENTS, DEPLOYMENTS, RECURRING, CHAINS, """
asked AS (SELECT query_id, CASE WHEN label % 5 = 2 AND label % 2 <> 0 THEN 'docker in the last 14 days'
    WHEN label % 5 = 2 THEN 'postgres outage in the last 14 days' WHEN label % 2 = 0 THEN 'which postgres outage' ELSE 'docker trouble' END AS question
  FROM questions)
""", _profile_sql(), """
shown AS (SELECT f.query_id, f.chunk_id, f.rank, c.text, c.source_type FROM final f JOIN chunks c USING (chunk_id) WHERE rank <= 10),
tops AS (SELECT query_id, trim(regexp_replace(left(text, 800), '\\s+', ' ', 'g'), ' ') AS flat FROM shown WHERE rank = 1),
found_steps AS (SELECT e.query_id, c.workspace_id, e.chunk_id, d.title, row_number() OVER (PARTITION BY e.query_id ORDER BY c.us, 'event_' || e.chunk_id) AS step
  FROM found_events e JOIN chunks c USING (chunk_id) JOIN standard_docs d ON d.id = e.chunk_id),
near_pairs AS (SELECT * FROM both_ends WHERE chunk_id IN (SELECT chunk_id FROM hits) OR related_id IN (SELECT chunk_id FROM hits)),
step_pairs AS (SELECT x.query_id, x.chunk_id AS f, x.step AS i, y.step AS j, c.score, row_number() OVER (
    PARTITION BY x.query_id, x.chunk_id, y.chunk_id ORDER BY c.score DESC, c.type) AS r
  FROM found_steps x JOIN near_pairs c ON c.workspace_id = x.workspace_id AND c.chunk_id = x.chunk_id
  JOIN found_steps y ON y.query_id = x.query_id AND y.chunk_id = c.related_id AND x.step < y.step),
traces AS (SELECT query_id, count(*) AS n, avg(score) AS s, arg_min(f, (i, j)) AS first FROM step_pairs WHERE r = 1 GROUP BY 1),
known AS (SELECT workspace_id, pattern_id, lower(entities) AS csv, name FROM recurring_patterns
  UNION ALL SELECT workspace_id, pattern_id, lower(array_to_string(ents, ',')), NULL FROM chains),
wanted_names AS (SELECT query_id, workspace_id, unnest(asked) AS e FROM questions),
fitting AS (SELECT query_id, count(DISTINCT pattern_id) AS p, arg_min(name, pattern_id) FILTER (WHERE name IS NOT NULL) AS problem
  FROM wanted_names w JOIN known k ON k.workspace_id = w.workspace_id AND contains(csv, lower(e)) GROUP BY 1),
gathered AS (
  SELECT q.query_id, q.workspace_id, a.question, p.query_type, p.class_confidence, coalesce(c.n, 0) AS chunk_count, coalesce(e.n, 0) AS event_count,
    coalesce(t.n, 0) AS link_count, coalesce(f.p, 0) AS pattern_count, d.title AS trigger, o.flat, f.problem,
    round(least(CASE WHEN t.n > 0 THEN least(0.5::DOUBLE + t.s * 0.4::DOUBLE, 0.99::DOUBLE) ELSE 0.5 END
      + CASE WHEN f.p > 0 THEN 0.1::DOUBLE ELSE 0 END, 0.99::DOUBLE), 2) AS trace_confidence
  FROM questions q JOIN asked a ON a.query_id = q.query_id JOIN profiles p ON p.query_id = q.query_id
  LEFT JOIN (SELECT query_id, count(*) AS n FROM shown GROUP BY 1) c ON c.query_id = q.query_id
  LEFT JOIN (SELECT query_id, count(*) AS n FROM found_events GROUP BY 1) e ON e.query_id = q.query_id
  LEFT JOIN traces t ON t.query_id = q.query_id LEFT JOIN fitting f ON f.query_id = q.query_id LEFT JOIN tops o ON o.query_id = q.query_id
  LEFT JOIN standard_docs d ON d.id = t.first)
""", f"""
answers AS (SELECT *, round(class_confidence * 0.3::DOUBLE + trace_confidence * 0.7::DOUBLE, 2) AS confidence, CASE
  WHEN query_type = 'root_cause_analysis' AND trigger IS NOT NULL THEN {three(
      "'Primary trigger identified as ''' || trigger || '''.'", "'Potential gateway instability and client-side timeouts.'",
      "'Investigate ''' || trigger || ''' events and check system limits.'")}
  WHEN query_type = 'root_cause_analysis' AND flat IS NOT NULL THEN {three(
      "'Telemetry alert matches context: ' || left(flat, 150) || '...'", "'Service latency and authentication errors.'",
      "'Apply recent patch, verify connection pools, and run diagnostics.'")}
  WHEN query_type = 'root_cause_analysis' THEN {three(
      "'Primary trigger identified as ''unknown''.'", "'Intermittent application failures in active workspace.'",
      "'Inspect live system execution logs and run verification queries.'")}
  WHEN query_type = 'recurring_issue' THEN {three(
      "'Recurring bottleneck profile detected matching ''' || coalesce(problem, 'unknown') || '''.'",
      "'Repeated bottlenecks and operational performance degradation.'", "'Adjust connector limits and clean up duplicate documents.'")}
  WHEN query_type = 'trend_analysis' THEN {three(
      "'Temporal distribution analysis of workspace events.'",
      "'Fluctuations in workspace activity (' || event_count || ' events registered).'", "'Establish alert baselines and monitor traffic spikes.'")}
  ELSE {three(
      "'Diagnostic report compiled for ''' || question || '''.'", "'Found ' || chunk_count || ' chunks and ' || event_count || ' events of interest.'",
      "'Review the specific event timestamps and vector evidence details.'")} END AS summary FROM gathered)
""", """
findings AS (SELECT query_id, 'chunk' AS kind, rank AS n, chunk_id AS ref,
    'Semantic overlap found in ' || source_type || ': ''' || regexp_replace(left(text, 150), '^\\s+|\\s+$', '', 'g') || '...''' AS finding FROM shown WHERE rank <= 3)
""")


@query("answers", with_ctes(*ANSWERED, body="""
SELECT query_id, workspace_id, question, query_type, class_confidence, chunk_count, event_count, link_count, pattern_count, trace_confidence, summary,
  confidence FROM answers"""))
def answers(spark, sf_dir):
    return answered(spark, sf_dir)["answers"]


@query("answer_findings", with_ctes(*ANSWERED, body="SELECT * FROM findings"))
def answer_findings(spark, sf_dir):
    return answered(spark, sf_dir)["findings"]


@query("alert_context", with_ctes(*ANSWERED, """
bullets AS (SELECT query_id, string_agg(chr(10) || '• *' || ref || '*: "' || left(finding, 100) || '..."', '' ORDER BY n) AS lines
  FROM findings WHERE n <= 2 GROUP BY query_id)
""", body="""
SELECT query_id, workspace_id, '*Alert Triggered*: `' || question || '`' || chr(10) || '*Severity*: `HIGH` | *Diagnostic Confidence*: `'
  || floor(confidence * 100)::INT || '%`' || chr(10) || chr(10) || '*RCA Summary*:' || chr(10) || summary || chr(10) || chr(10)
  || '*Primary Supporting Evidence*:' || coalesce(lines, ' No vector documents linked.') AS message
FROM answers LEFT JOIN bullets USING (query_id)"""))
def alert_context(spark, sf_dir):
    parts = answered(spark, sf_dir)
    alerts = parts["answers"].select("query_id", "workspace_id", "question", F.lit("high").alias("severity"))
    return reasoning.alert_context(alerts, parts["answers"], parts["findings"])
