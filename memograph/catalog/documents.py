"""Normalization, chunking, tagging and text events over whole documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from memograph import adapters as A
from memograph.catalog.base import ASOF, RAW_DOCS, joined, query, us, with_ctes
from memograph.operators import chunking, entities, extraction, normalize
from memograph.functions import text as T

STANDARD = f"""
standard_docs AS (
  SELECT id, source, CASE source WHEN 'slack' THEN 'chat_thread' WHEN 'notion' THEN 'wiki_page' WHEN 'jira' THEN 'ticket'
      ELSE 'document' END AS source_type, workspace_id, coalesce(author, created_by, 'unknown') AS author,
    coalesce(created_time, last_edited_time, {ASOF}) AS ts, url, parent_id, title, content, doc_id, tags, path,
    list_filter(string_split(path, '/'), lambda p: p <> '') AS hierarchy,
    coalesce(team, CASE WHEN source = 'slack' THEN channel_name END, 'unknown') AS team
  FROM raw_docs
)
"""
CLEAN = """
clean_docs AS (
  SELECT * FROM standard_docs WHERE length(coalesce(content, '')) >= 10
    AND (workspace_id, id) IN (SELECT (workspace_id, min(id)) FROM standard_docs WHERE length(coalesce(content, '')) >= 10 GROUP BY workspace_id, content)
    AND title <> '' AND content <> ''
)
"""


def standard(spark, sf_dir):
    return normalize.standardize(A.raw_documents(spark, sf_dir), A.as_of())


def clean(spark, sf_dir):
    return normalize.normalize(standard(spark, sf_dir))


@query("standardized_metadata", with_ctes(RAW_DOCS, STANDARD, body="""
SELECT id, source, source_type, workspace_id, author, epoch_us(ts) AS ts_us, url, array_to_string(hierarchy, '/') AS hierarchy,
  team FROM standard_docs"""))
def standardized_metadata(spark, sf_dir):
    return standard(spark, sf_dir).select(
        "id", "source", "source_type", "workspace_id", "author", us("ts", "ts_us"), "url",
        F.array_join("hierarchy", "/").alias("hierarchy"), "team")


@query("normalize_documents", with_ctes(RAW_DOCS, STANDARD, CLEAN, body="""
SELECT id, workspace_id, source, title, md5(content) AS content_md5 FROM clean_docs"""))
def normalize_documents(spark, sf_dir):
    return clean(spark, sf_dir).select("id", "workspace_id", "source", "title", F.md5("content").alias("content_md5"))


@query("rejected_documents", with_ctes(RAW_DOCS, STANDARD, body="""
SELECT id, 'missing title' AS reasons FROM standard_docs WHERE title = ''"""))
def rejected_documents(spark, sf_dir):
    return normalize.split_valid(standard(spark, sf_dir))[1].select("id", "reasons")


@query("normalization_counts", with_ctes(RAW_DOCS, STANDARD, CLEAN, body="""
SELECT (SELECT count(*) FROM standard_docs) AS input_documents,
  (SELECT count(*) FROM standard_docs WHERE length(coalesce(content, '')) < 10) AS filtered,
  (SELECT count(*) - count(DISTINCT (workspace_id, content)) FROM standard_docs WHERE length(coalesce(content, '')) >= 10)
    AS duplicates_removed,
  (SELECT count(*) FROM clean_docs) AS output_documents"""))
def normalization_counts(spark, sf_dir):
    return normalize.normalization_counts(standard(spark, sf_dir))


RESENT = """
resent AS (SELECT id, workspace_id, content, title FROM standard_docs
  UNION ALL SELECT id, workspace_id, content, title FROM standard_docs WHERE doc_id % 3 = 0
  UNION ALL SELECT id || '_other', workspace_id || '_other', content, title FROM standard_docs WHERE doc_id % 5 = 0
  UNION ALL SELECT id || '_again', workspace_id, content, title FROM standard_docs WHERE doc_id % 7 = 0),
firsts AS (SELECT workspace_id, content, min(id) AS id FROM resent WHERE length(coalesce(content, '')) >= 10 GROUP BY ALL)
"""


@query("resent_documents", with_ctes(RAW_DOCS, STANDARD, RESENT, body="""
SELECT f.id, f.workspace_id, md5(f.content) AS content_md5 FROM firsts f
WHERE content <> '' AND EXISTS (SELECT 1 FROM resent r WHERE r.id = f.id AND r.workspace_id = f.workspace_id AND r.title <> '')"""))
def resent_documents(spark, sf_dir):
    docs = standard(spark, sf_dir)
    other = docs.filter("doc_id % 5 = 0").withColumns({
        "id": F.concat("id", F.lit("_other")), "workspace_id": F.concat("workspace_id", F.lit("_other"))})
    again = docs.filter("doc_id % 7 = 0").withColumn("id", F.concat("id", F.lit("_again")))
    sent = docs.unionByName(docs.filter("doc_id % 3 = 0")).unionByName(other).unionByName(again)
    return normalize.normalize(sent).select("id", "workspace_id", F.md5("content").alias("content_md5"))


@query("enriched_documents", with_ctes(RAW_DOCS, STANDARD, CLEAN, body="""
SELECT id, workspace_id, CASE WHEN doc_id % 3 = 0 THEN upper(title) ELSE title END AS title, md5(content) AS content_md5,
  CASE WHEN doc_id % 2 = 0 THEN 'checked' END AS mark FROM clean_docs"""))
def enriched_documents(spark, sf_dir):
    """A hook that rewrites some titles, leaves the others null, and adds a column."""
    def hook(docs):
        return docs.withColumns({"title": F.when(F.col("doc_id") % 3 == 0, F.upper("title")), "mark": F.when(F.col("doc_id") % 2 == 0, "checked")})

    found = normalize.normalize(standard(spark, sf_dir), enrichment=hook)
    return found.select("id", "workspace_id", "title", F.md5("content").alias("content_md5"), "mark")


@query("allowed_sources", with_ctes(RAW_DOCS, STANDARD, body="""
SELECT source, count(*) AS n FROM standard_docs WHERE lower(source) IN ('slack', 'notion') GROUP BY 1"""))
def allowed_sources(spark, sf_dir):
    return normalize.allow_sources(standard(spark, sf_dir), ["Slack", "NOTION"]).groupBy("source").agg(
        F.count(F.lit(1)).alias("n"))


@query("workspace_scope", with_ctes(RAW_DOCS, body="""
SELECT id, coalesce(nullif(trim(coalesce(nullif(parent_id, ''), channel_name)), ''), 'default_workspace') AS scope
FROM raw_docs"""))
def workspace_scope(spark, sf_dir):
    docs = A.raw_documents(spark, sf_dir)
    return docs.select("id", normalize.workspace_scope(F.col("channel_name"), F.col("parent_id")).alias("scope"))


@query("normalized_text_copies", """
WITH keyed AS (SELECT doc_id, trim(regexp_replace(lower(text), '\\s+', ' ', 'g'), ' ') AS k FROM documents)
SELECT min(doc_id) AS doc_id FROM keyed GROUP BY k""")
def normalized_text_copies(spark, sf_dir):
    docs = A.table(spark, sf_dir, "documents")
    best = normalize.distinct_normalized(docs.select("doc_id", "text"), [], "text", ["doc_id"])
    return best.select("doc_id")


@query("workspace_doc_counts", with_ctes(RAW_DOCS, STANDARD, body="""
SELECT workspace_id, count(DISTINCT coalesce(url, id)) AS documents FROM standard_docs GROUP BY 1"""))
def workspace_doc_counts(spark, sf_dir):
    return normalize.document_counts(standard(spark, sf_dir))


@query("workspace_quota", with_ctes(RAW_DOCS, STANDARD, """
counts AS (SELECT workspace_id, count(DISTINCT coalesce(url, id)) AS documents FROM standard_docs GROUP BY 1),
plans AS (SELECT DISTINCT 'ws_' || (c_custkey % 10) AS workspace_id,
  CASE WHEN c_custkey % 10 < 6 THEN 'free' ELSE 'pro' END AS plan FROM customer)
""", body="""
SELECT p.workspace_id, plan, coalesce(documents, 0) AS documents,
  CAST(plan = 'free' AND coalesce(documents, 0) >= 50 AS VARCHAR) AS rejected
FROM plans p LEFT JOIN counts c ON c.workspace_id = p.workspace_id"""))
def workspace_quota(spark, sf_dir):
    k = F.col("c_custkey") % 10
    plans = A.table(spark, sf_dir, "customer").select(
        F.concat(F.lit("ws_"), k).alias("workspace_id"), F.when(k < 6, "free").otherwise("pro").alias("plan")).distinct()
    out = normalize.quota(normalize.document_counts(standard(spark, sf_dir)), plans)
    return out.withColumn("rejected", F.col("rejected").cast("string"))


@query("synced_sources", with_ctes(RAW_DOCS, body="""
SELECT source, count(*) AS documents FROM raw_docs GROUP BY 1
UNION ALL SELECT 'web', count(*) FROM pages"""))
def synced_sources(spark, sf_dir):
    web = A.table(spark, sf_dir, "pages").select(
        F.concat(F.lit("page_"), "page_id").alias("id"), "url", F.col("html").alias("content"), F.lit("web").alias("source"))
    everything = normalize.sync({"memory": A.raw_documents(spark, sf_dir), "web": web}, "ws_all")
    return everything.groupBy("source").agg(F.count(F.lit(1)).alias("documents"))


@query("chunks_fixed", with_ctes(RAW_DOCS, """
starts AS (SELECT id, content, unnest(range(0, length(content), 900)) AS start_pos FROM raw_docs WHERE length(content) > 0)
""", body="""
SELECT id, start_pos // 900 AS chunk_index, start_pos, start_pos + 1000 AS end_pos,
  md5(substr(content, start_pos + 1, 1000)) AS text_md5 FROM starts"""))
def chunks_fixed(spark, sf_dir):
    docs = A.raw_documents(spark, sf_dir).select("id", "content")
    return chunking.fixed_windows(docs).select("id", "chunk_index", "start_pos", "end_pos", F.md5("text").alias("text_md5"))


@query("chunks_recursive")
def chunks_recursive(spark, sf_dir):
    docs = A.raw_documents(spark, sf_dir).select("id", "content")
    return chunking.with_chunk_ids(chunking.recursive_chunks(docs))


TEAMS = "('engineering','product','qa','support','devops','ops','marketing','sales','hr','finance','design')"
SYSTEMS = ("('postgres','postgresql','qdrant','aws','s3','docker','kubernetes','fastapi','ollama','sentence-transformers',"
           "'github','jira')")
ENVIRONMENTS = "('production','prod','staging','dev','development','localhost','test')"
PRODUCTS = "('notion','slack','stripe')"
CONCEPTS = "('deployment','migration','onboarding','backup','postmortem','runbook','sprint')"
PROJECTS = "('apollo','phoenix','nexus','aurora','copilot')"
LEFT, RIGHT = r"(?:^|[^\p{L}\p{N}_])", r"(?:$|[^\p{L}\p{N}_])"

# The word rules cut a text at everything that is not a letter, digit, underscore or hyphen, then trim hyphens:
# equal to a word-boundary match for every dictionary word.
WORDS = rf"""
words AS (SELECT DISTINCT id, trim(unnest(string_split_regex(lower(content), '[^\p{{L}}\p{{N}}_\-]+')), '-') AS w
  FROM standard_docs),
word_mentions AS (
  SELECT id, CASE WHEN w IN {TEAMS} THEN 'team' WHEN w IN {SYSTEMS} THEN 'system' WHEN w IN {ENVIRONMENTS} THEN 'environment'
      WHEN w IN {PRODUCTS} THEN 'product' WHEN w IN {CONCEPTS} THEN 'operational_concept' WHEN w IN {PROJECTS} THEN 'project'
    END AS type,
    CASE WHEN w IN ('postgres', 'postgresql') THEN 'PostgreSQL' WHEN w IN {ENVIRONMENTS} OR w IN {CONCEPTS} THEN w
      ELSE upper(w[1]) || w[2:] END AS name,
    CASE WHEN w IN {PROJECTS} THEN 5 ELSE 4 END AS stage
  FROM words WHERE w IN {TEAMS} OR w IN {SYSTEMS} OR w IN {ENVIRONMENTS} OR w IN {PRODUCTS} OR w IN {CONCEPTS}
    OR w IN {PROJECTS}),
pattern_mentions AS (
  SELECT id, 1 AS stage, 'project' AS type, unnest(regexp_extract_all(content,
    '(?i){LEFT}project[-_ ]([a-zA-Z0-9_\-]*[a-zA-Z0-9_])', 1)) AS name FROM standard_docs
  UNION ALL SELECT id, 2, 'incident', unnest(regexp_extract_all(content,
    '(?i){LEFT}(inc[-_ ][0-9]+|incident[-_ ][0-9]+|sev[-_ ][0-9]){RIGHT}', 1)) FROM standard_docs
  UNION ALL SELECT id, 2, 'incident', unnest(regexp_extract_all(content, '(?i){LEFT}(outage){RIGHT}', 1)) FROM standard_docs
  UNION ALL SELECT id, 3, 'person', unnest(regexp_extract_all(content, '@([a-zA-Z0-9_.\-]+)', 1)) FROM standard_docs),
all_mentions AS (SELECT *, row_number() OVER (PARTITION BY id, lower(name) ORDER BY stage) AS r
  FROM (SELECT id, stage, type, name FROM pattern_mentions UNION ALL SELECT id, stage, type, name FROM word_mentions)),
mentions AS (SELECT id, name, type FROM all_mentions WHERE r = 1)
"""


# The entity graph of the mentions: names equal without case are one, and token sets that are near each other one group.
MENTION_GRAPH = """
kept AS (SELECT workspace_id, id AS chunk, doc_id AS seen, trim(name) AS name, lower(trim(name)) AS key,
    CASE WHEN type IN ('person', 'team', 'project', 'product', 'system', 'workflow', 'incident', 'deployment', 'customer', 'department', 'document',
      'decision', 'metric', 'tool') THEN type ELSE 'document' END AS type
  FROM mentions JOIN standard_docs USING (id) WHERE length(trim(name)) >= 2),
kept_names AS (SELECT workspace_id, type, key, arg_min(name, (seen, name)) AS name, min(seen) AS seen,
    list_sort(list_distinct(regexp_extract_all(key, '[a-z0-9]+'))) AS t FROM kept GROUP BY 1, 2, 3),
kept_sets AS (SELECT DISTINCT workspace_id, type, t FROM kept_names),
near_sets AS (SELECT a.workspace_id, a.type, a.t AS x, b.t AS y FROM kept_sets a JOIN kept_sets b ON a.workspace_id = b.workspace_id AND a.type = b.type AND a.t <> b.t
  WHERE len(list_intersect(a.t, b.t)) >= 0.8 * len(list_distinct(list_concat(a.t, b.t)))),
met AS (SELECT workspace_id, type, t AS a, t AS b FROM kept_sets
  UNION SELECT m.workspace_id, m.type, a, y FROM met m JOIN near_sets n ON n.workspace_id = m.workspace_id AND n.type = m.type AND b = x),
joined_sets AS (SELECT workspace_id, type, a AS t, min(b) AS g FROM met GROUP BY 1, 2, 3),
built_heads AS (SELECT n.workspace_id, n.type, g, arg_min(n.name, (n.seen, n.key)) AS name, string_agg(DISTINCT n.name, ',' ORDER BY n.name) AS aliases
  FROM kept_names n JOIN joined_sets j USING (workspace_id, type, t) GROUP BY 1, 2, 3),
kept_refs AS (SELECT DISTINCT k.workspace_id, k.type, j.g, k.chunk, k.seen FROM kept k JOIN kept_names n USING (workspace_id, type, key)
  JOIN joined_sets j ON j.workspace_id = n.workspace_id AND j.type = n.type AND j.t = n.t),
built AS (SELECT h.workspace_id, h.type, h.name, h.aliases, arg_min(r.chunk, (r.seen, r.chunk)) AS source_chunk_id, count(*) AS chunks
  FROM built_heads h JOIN kept_refs r ON r.workspace_id = h.workspace_id AND r.type = h.type AND r.g = h.g GROUP BY h.workspace_id, h.type, h.g, h.name, h.aliases)
"""

@query("entity_mentions", with_ctes(RAW_DOCS, STANDARD, WORDS, body="""
SELECT id, lower(name) AS name_key, type FROM mentions"""))
def entity_mentions(spark, sf_dir):
    tagged = entities.tag(standard(spark, sf_dir), "content")
    return entities.mention_rows(tagged, ["id"]).select("id", F.lower("name").alias("name_key"), "type")


@query("chunk_payload", with_ctes(RAW_DOCS, STANDARD, WORDS, """
links AS (
  SELECT id, 'child_of>' || parent_id || '>document' AS link FROM standard_docs WHERE parent_id IS NOT NULL
  UNION ALL SELECT id, 'references_' || type || '>' || lower(name) || '>' || type FROM mentions
    WHERE type IN ('person', 'project', 'system')),
link_lists AS (SELECT id, string_agg(link, ',' ORDER BY link) AS links FROM links GROUP BY id),
names AS (SELECT id, lower(name) AS n FROM mentions UNION SELECT id, lower(unnest(tags)) FROM standard_docs),
name_lists AS (SELECT id, string_agg(n, ',' ORDER BY n) AS entities FROM names GROUP BY id)
""", body="""
SELECT d.id, workspace_id, source_type, coalesce(entities, '') AS entities, coalesce(links, '') AS links
FROM standard_docs d LEFT JOIN link_lists l ON l.id = d.id LEFT JOIN name_lists n ON n.id = d.id"""))
def chunk_payload(spark, sf_dir):
    rows = entities.payload(entities.tag(standard(spark, sf_dir), "content"))
    lowered = F.array_distinct(F.transform("entities", F.lower))
    links = F.transform("relationships", lambda r: F.concat(
        r["type"], F.lit(">"), F.when(r["type"] == "child_of", r["target"]).otherwise(F.lower(r["target"])),
        F.lit(">"), r["target_type"]))
    return rows.select("id", "workspace_id", "source_type", joined(lowered, "entities"), joined(links, "links"))


@query("cooccurrence", with_ctes(RAW_DOCS, STANDARD, WORDS, """
named AS (SELECT m.id, workspace_id, ts, lower(name) AS n FROM mentions m JOIN standard_docs USING (id))
""", body="""
SELECT a.workspace_id, a.n AS entity_a, b.n AS entity_b, count(*)::DOUBLE AS score, max(epoch_us(a.ts)) AS last_seen_us
FROM named a JOIN named b ON a.id = b.id AND a.n < b.n GROUP BY ALL"""))
def cooccurrence(spark, sf_dir):
    tagged = entities.tag(standard(spark, sf_dir), "content")
    named = tagged.select("workspace_id", "ts", F.transform("entity_details", lambda m: F.lower(m["name"])).alias("entities"))
    return entities.cooccurrence(named).select("workspace_id", "entity_a", "entity_b", "score", us("last_seen", "last_seen_us"))


@query("chunk_events", with_ctes(RAW_DOCS, STANDARD, WORDS, CLEAN, r"""
low AS (SELECT *, lower(content) AS l, lower(title) AS lt,
  list_filter(list_transform(string_split(replace(content, chr(10), ' '), '.'), lambda s: trim(s, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))), lambda s: s <> '') AS sentences
  FROM clean_docs),
kinds AS (SELECT *, CASE
  WHEN regexp_matches(l, 'incident|outage|sev-|severity|downtime|postmortem|rca') THEN 'incident'
  WHEN regexp_matches(l, 'deploy|release|shipped|production push|rollback|migration') THEN 'deployment'
  WHEN regexp_matches(l, 'meeting|sync|standup|retro|weekly|all-hands|kickoff') THEN 'meeting'
  WHEN regexp_matches(l, 'escalat(ion|e)|paged|pager|alert') THEN 'escalation'
  WHEN source = 'slack' AND length(content) > 40 THEN 'discussion' END AS event_type,
  array_to_string(sentences[1:2], '. ') AS lead FROM low),
teams AS (SELECT id, string_agg(DISTINCT t, ',' ORDER BY t) AS teams FROM (
  SELECT id, team AS t FROM clean_docs WHERE team <> 'unknown'
  UNION SELECT id, split_part(name, ' ', 1) FROM mentions WHERE contains(lower(name), 'team') OR name IN ('Engineering', 'Product', 'Support', 'Devops')) GROUP BY id)
""", body="""
SELECT workspace_id, 'event_' || id AS event_id, event_type,
  CASE WHEN event_type = 'incident' AND NOT (contains(lt, 'incident') OR contains(lt, 'outage')) THEN 'Incident: ' || title
    WHEN event_type = 'deployment' AND NOT (contains(lt, 'deploy') OR contains(lt, 'release'))
      THEN 'Deployment/Release: ' || title ELSE title END AS title,
  md5(CASE WHEN lead = '' THEN left(content, 200) WHEN length(lead) > 200 THEN left(lead, 197) || '...' ELSE lead END)
    AS summary_md5, coalesce(t.teams, '') AS related_teams
FROM kinds k LEFT JOIN teams t USING (id) WHERE event_type IS NOT NULL"""))
def chunk_events(spark, sf_dir):
    docs = clean(spark, sf_dir).withColumnsRenamed({"content": "text", "id": "chunk_id"})
    found = extraction.chunk_events(entities.payload(entities.tag(docs)))
    return found.select("workspace_id", "event_id", "event_type", "title", F.md5("summary").alias("summary_md5"),
                        joined(F.array_distinct("related_teams"), "related_teams"))


LINES = rf"""
split_lines AS (SELECT id, workspace_id, generate_subscripts(parts, 1) - 1 AS line_no, unnest(parts) AS raw FROM (
  SELECT *, string_split_regex(content, '\r\n|[\n\x0B\f\r\x{{85}}\x{{2028}}\x{{2029}}]') AS parts FROM standard_docs)),
lines AS (SELECT id, workspace_id, line_no, regexp_replace(raw, '^\s+|\s+$', '', 'g') AS line FROM split_lines),
kinds AS (SELECT *, CASE
  WHEN regexp_matches(line, '(?i){LEFT}(outage|downtime|system down|unreachable|service down|offline|crash|db crash){RIGHT}') THEN 'outage'
  WHEN regexp_matches(line, '(?i){LEFT}(rollback|rolled back|revert){RIGHT}') THEN 'rollback'
  WHEN regexp_matches(line, '(?i){LEFT}(deploy|deployment|deployed|rollout|updated production|shipped){RIGHT}') THEN 'deployment'
  WHEN regexp_matches(line, '(?i){LEFT}(migration|migrated|schema upgrade|db upgrade|db migration){RIGHT}') THEN 'migration'
  WHEN regexp_matches(line, '(?i){LEFT}(incident|inc[-_ ][0-9]+|bug|alert|exception|error|prod alert|sev[-_ ][0-9]){RIGHT}') THEN 'incident'
  WHEN regexp_matches(line, '(?i){LEFT}(escalated|paged|page|alerted oncall|notified lead){RIGHT}') THEN 'escalation'
  WHEN regexp_matches(line, '(?i){LEFT}(release|released|v[0-9]+\.[0-9]+){RIGHT}') THEN 'release'
  WHEN regexp_matches(line, '(?i){LEFT}(security|vulnerability|cve|leak|rotated key|breach){RIGHT}') THEN 'security_event'
  WHEN regexp_matches(line, '(?i){LEFT}(latency|slow|memory leak|high cpu|high memory|timeout|throttling|cpu spike){RIGHT}') THEN 'performance_issue'
  WHEN regexp_matches(line, '(?i){LEFT}(decided|decision|choice|opted to|we will use|adr){RIGHT}') THEN 'decision'
  END AS event_type FROM lines WHERE line <> ''),
found_lines AS (SELECT *, CASE WHEN length(line) > 100 THEN left(line, 97) || '...' ELSE line END AS title,
  try_cast(replace(regexp_extract(line, '{LEFT}(20\d{{2}}[-/]\d{{2}}[-/]\d{{2}}(?:[ T]\d{{2}}:\d{{2}}(?::\d{{2}})?)?){RIGHT}', 1), '/', '-')
    || CASE WHEN regexp_matches(line, '20\d{{2}}[-/]\d{{2}}[-/]\d{{2}}[ T]\d{{2}}:\d{{2}}') THEN ':00' ELSE '' END AS TIMESTAMP) AS ts
  FROM kinds WHERE event_type IS NOT NULL)
"""


@query("line_events", with_ctes(RAW_DOCS, STANDARD, LINES, body="""
SELECT id, line_no, event_type, md5(title) AS title_md5, epoch_us(ts) AS ts_us,
  CASE WHEN event_type IN ('outage', 'security_event') THEN 'high' ELSE 'medium' END AS severity FROM found_lines"""))
def line_events(spark, sf_dir):
    docs = standard(spark, sf_dir).withColumnsRenamed({"content": "text", "id": "chunk_id"})
    return extraction.line_events(docs).select(
        F.col("chunk_id").alias("id"), "line_no", "event_type", F.md5("title").alias("title_md5"), us("ts", "ts_us"), "severity")


@query("line_event_edges", with_ctes(RAW_DOCS, STANDARD, LINES, """
ordered AS (SELECT id, line_no, title, lag(line_no) OVER w AS prev_no, lag(title) OVER w AS prev_title FROM found_lines
  WINDOW w AS (PARTITION BY id ORDER BY line_no))
""", body="""
SELECT id, line_no AS later_no, prev_no AS earlier_no, md5(title) AS source_md5, md5(prev_title) AS target_md5
FROM ordered WHERE prev_no IS NOT NULL"""))
def line_event_edges(spark, sf_dir):
    docs = standard(spark, sf_dir).withColumnsRenamed({"content": "text", "id": "chunk_id"})
    return extraction.sequential_edges(docs).select(
        F.col("chunk_id").alias("id"), "later_no", "earlier_no", F.md5("source_title").alias("source_md5"),
        F.md5("target_title").alias("target_md5"))


@query("url_hierarchy", """
WITH parts AS (SELECT page_id, list_filter(string_split(regexp_extract(url, '^https?://[^/]+([^?#]*)', 1), '/'),
  lambda p: p <> '') AS h FROM pages)
SELECT page_id, array_to_string(h, '/') AS hierarchy, CASE WHEN h[1:1] = ['en'] THEN 0.15::DOUBLE
  WHEN list_contains(h, 'en') THEN 0.06 ELSE 0.0 END AS boost FROM parts""")
def url_hierarchy(spark, sf_dir):
    from memograph.functions import scoring

    path = F.regexp_extract("url", r"^https?://[^/]+([^?#]*)", 1)
    pages = A.table(spark, sf_dir, "pages").select(F.col("page_id").alias("id"), "url", path.alias("path"))
    std = normalize.standardize(pages.withColumn("doc_id", F.col("id")), A.as_of())
    return std.select(F.col("doc_id").alias("page_id"), F.array_join("hierarchy", "/").alias("hierarchy"),
                      scoring.hierarchy_boost(F.col("hierarchy"), F.array(F.lit("en"))).alias("boost"))
