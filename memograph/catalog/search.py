"""Vector search, correlations and evidence over embedded documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from memograph import adapters as A
from memograph.catalog.base import ASOF, OP_EVENTS, query, with_ctes
from memograph.catalog.documents import STANDARD, RAW_DOCS, standard
from memograph.functions import scoring
from memograph.operators import correlation, retrieval
from memograph.plans.neighbours import knn_join
from memograph.session import cut_lineage

DIM = 64

VECTORS = """
vecs AS (SELECT vec_id, label, 'ws_' || (vec_id % 8) AS workspace_id, embedding::DOUBLE[] AS v FROM embeddings),
chunks AS (
  SELECT 'doc_' || e.vec_id AS chunk_id, e.vec_id AS seen_at, d.workspace_id, d.source, d.source_type, d.author, d.team, d.ts,
    epoch_us(d.ts) AS us, d.hierarchy, d.content AS text, e.v, e.label,
    CASE WHEN e.vec_id % 5 = 1 THEN ['service_' || (e.label % 4), 'topic_1'] ELSE ['service_' || (e.label % 4)] END AS entities
  FROM vecs e JOIN standard_docs d ON d.doc_id = e.vec_id)
"""


def keyed_chunks(spark, sf_dir):
    """Embedded documents; the digest of a text is taken where the text lies, before it meets its vector."""
    vec = A.table(spark, sf_dir, "embeddings")
    docs = standard(spark, sf_dir).withColumn("text_key", F.sha2("content", 256))
    service = F.concat(F.lit("service_"), F.col("label") % 4)
    return vec.join(docs, vec["vec_id"] == docs["doc_id"]).select(
        F.col("id").alias("chunk_id"), F.col("vec_id").alias("seen_at"), "workspace_id", "source", "source_type", "author",
        "team", "ts", "hierarchy", F.col("content").alias("text"), "text_key", "title", "path", "embedding", "label",
        F.when(F.col("vec_id") % 5 == 1, F.array(service, F.lit("topic_1"))).otherwise(F.array(service)).alias("entities"))


def chunks(spark, sf_dir):
    return keyed_chunks(spark, sf_dir).drop("text_key")


def stored_chunks(spark, sf_dir):
    """The chunk table as a store holds it, for queries that read it several times."""
    return cut_lineage(chunks(spark, sf_dir))


def stored_traits(spark, sf_dir):
    """The chunk table without texts, for queries that return none."""
    return cut_lineage(keyed_chunks(spark, sf_dir).drop("text", "text_key"))


def stored_keys(spark, sf_dir):
    """The chunk table with the digest of each text; the texts themselves are fetched for hits, from `chunk_texts`."""
    return cut_lineage(keyed_chunks(spark, sf_dir).drop("text"))


def chunk_texts(spark, sf_dir):
    """Texts by chunk and digest."""
    return standard(spark, sf_dir).select("workspace_id", F.col("id").alias("chunk_id"), F.sha2("content", 256).alias("text_key"),
                                          F.col("content").alias("text"))


def stored_correlations(rows):
    """The correlation table as a store holds it: computed once, then read."""
    return cut_lineage(correlation.correlate(rows))


CORRELATIONS = """
pairs AS (
  SELECT a.workspace_id, a.chunk_id AS a_id, b.chunk_id AS b_id,
    round(list_dot_product(a.v, b.v) / (sqrt(list_dot_product(a.v, a.v)) * sqrt(list_dot_product(b.v, b.v))), 9) AS cos,
    a.us AS a_us, b.us AS b_us, a.source AS a_source, b.source AS b_source, a.seen_at, a.entities AS a_e, b.entities AS b_e
  FROM chunks a JOIN chunks b ON a.workspace_id = b.workspace_id),
nearest AS (SELECT *, row_number() OVER (PARTITION BY workspace_id, a_id ORDER BY cos DESC, b_id) AS rank FROM pairs),
measured AS (
  SELECT *, len(list_intersect(a_e, b_e)) / len(a_e)::DOUBLE AS overlap, a_source <> b_source AS crossing,
    CASE WHEN abs(a_us - b_us) <= 3600000000 THEN 1.0::DOUBLE WHEN abs(a_us - b_us) <= 86400000000 THEN 0.5
      WHEN abs(a_us - b_us) <= 604800000000 THEN 0.2 ELSE 0.0 END AS proximity
  FROM nearest WHERE rank <= 10 AND a_id <> b_id),
based AS (SELECT *, cos * 0.40::DOUBLE + overlap * 0.30::DOUBLE + proximity * 0.30::DOUBLE AS base FROM measured),
scored AS (SELECT *, CASE WHEN crossing AND base > 0.5 THEN least(base + 0.05::DOUBLE, 1.0) ELSE base END AS s FROM based),
directed AS (
  SELECT workspace_id, a_id, b_id, CASE WHEN crossing THEN 'cross_source' ELSE 'intra_source' END AS type, round(s, 4) AS score,
    seen_at, coalesce(nullif(concat_ws(', ',
      CASE WHEN len(list_intersect(a_e, b_e)) > 0
        THEN 'shared entities: ' || array_to_string(list_sort(list_intersect(a_e, b_e)), ', ') END,
      CASE WHEN abs(a_us - b_us) <= 3600000000 THEN 'temporal proximity (< 1 hr)'
        WHEN abs(a_us - b_us) <= 86400000000 THEN 'temporal proximity (< 24 hrs)' END,
      CASE WHEN cos > 0.8 THEN 'high semantic similarity' END), ''), 'semantic overlap') AS reason
  FROM scored WHERE s >= 0.65),
correlations AS (
  SELECT workspace_id, a_id AS source_a, b_id AS source_b, type, score, reason FROM (
    SELECT *, row_number() OVER (PARTITION BY workspace_id, least(a_id, b_id), greatest(a_id, b_id), type
      ORDER BY seen_at DESC, a_id DESC) AS r FROM directed) WHERE r = 1)
"""


@query("knn_self_join", """
WITH v AS (SELECT vec_id, 'ws_' || (vec_id % 8) AS workspace_id, embedding::DOUBLE[] AS v FROM embeddings),
p AS (SELECT a.workspace_id, a.vec_id, b.vec_id AS near_id,
    round(list_dot_product(a.v, b.v) / (sqrt(list_dot_product(a.v, a.v)) * sqrt(list_dot_product(b.v, b.v))), 9) AS c
  FROM v a JOIN v b ON a.workspace_id = b.workspace_id),
r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY c DESC, near_id) AS rank FROM p)
SELECT workspace_id, vec_id, near_id, round(c, 6) AS cosine, rank FROM r WHERE rank <= 10""")
def knn_self_join(spark, sf_dir):
    vec = A.table(spark, sf_dir, "embeddings").withColumn("workspace_id", F.concat(F.lit("ws_"), F.col("vec_id") % 8))
    near = knn_join(vec, vec.withColumnRenamed("vec_id", "near_id"), 10, ["workspace_id"], "vec_id", "near_id")
    return near.withColumn("cosine", F.round("cosine", 6))


@query("knn_global", """
WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings),
p AS (SELECT a.vec_id, b.vec_id AS near_id,
    round(list_dot_product(a.v, b.v) / (sqrt(list_dot_product(a.v, a.v)) * sqrt(list_dot_product(b.v, b.v))), 9) AS c
  FROM v a, v b),
r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY c DESC, near_id) AS rank FROM p)
SELECT vec_id, near_id, round(c, 6) AS cosine, rank FROM r WHERE rank <= 5""")
def knn_global(spark, sf_dir):
    vec = A.table(spark, sf_dir, "embeddings")
    near = knn_join(vec, vec.withColumnRenamed("vec_id", "near_id"), 5, [], "vec_id", "near_id", block=256)
    return near.withColumn("cosine", F.round("cosine", 6))


@query("correlations", with_ctes(RAW_DOCS, STANDARD, VECTORS, CORRELATIONS, body="""
SELECT workspace_id, source_a, source_b, type, score AS score, reason FROM correlations"""))
def correlations(spark, sf_dir):
    found = correlation.correlate(stored_chunks(spark, sf_dir))
    return found.drop("seen_at")


# One question per label and workspace: its vector is the label's mean vector.
QUESTIONS = f"""
coords AS (SELECT label, generate_subscripts(v, 1) AS i, unnest(v) AS x FROM vecs),
means AS (SELECT label, i, avg(x) AS x FROM coords GROUP BY ALL),
centroids AS (SELECT label, list(x ORDER BY i) AS q FROM means GROUP BY label),
questions AS (
  SELECT 'q' || label || '_' || workspace_id AS query_id, workspace_id, q, label,
    CASE WHEN label % 3 = 0 THEN ['slack', 'notion'] END AS q_sources, CASE WHEN label % 4 = 1 THEN ['en'] END AS q_scope,
    CASE WHEN label % 5 = 2 THEN {ASOF} - INTERVAL 14 DAYS END AS q_start, CASE WHEN label % 5 = 2 THEN {ASOF} END AS q_end,
    CASE WHEN label % 6 = 5 THEN ['topic_1'] ELSE [] END AS wanted,
    list_distinct(list_concat(CASE WHEN label % 6 = 5 THEN ['topic_1'] ELSE [] END,
      CASE WHEN label % 2 = 0 THEN ['PostgreSQL', 'outage'] ELSE ['Docker'] END)) AS asked
  FROM centroids, (SELECT DISTINCT workspace_id FROM chunks))
"""


def questions(spark, sf_dir):
    vec = A.table(spark, sf_dir, "embeddings")
    coords = vec.select("label", F.posexplode("embedding").alias("i", "x")).groupBy("label", "i").agg(
        F.avg(F.col("x").cast("double")).alias("x"))
    centroids = coords.groupBy("label").agg(F.array_sort(F.collect_list(F.struct("i", "x"))).alias("c")).select(
        "label", F.transform("c", lambda p: p["x"]).alias("embedding"))
    spaces = F.explode(F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.concat(F.lit("ws_"), i)))
    label = F.col("label")
    asked = F.when(label % 5 == 2, "postgres outage in the last 14 days").when(
        label % 2 == 0, "which postgres outage").otherwise("docker trouble")
    return centroids.select("label", "embedding", spaces.alias("workspace_id")).select(
        F.concat(F.lit("q"), "label", F.lit("_"), "workspace_id").alias("query_id"), "workspace_id", "embedding", "label",
        F.when((label % 5 == 2) & (label % 2 != 0), "docker in the last 14 days").otherwise(asked).alias("question"),
        F.when(label % 3 == 0, F.array(F.lit("slack"), F.lit("notion"))).alias("sources"),
        F.when(label % 4 == 1, F.array(F.lit("en"))).alias("scope"),
        F.when(label % 6 == 5, F.array(F.lit("topic_1"))).alias("wanted"))


HITS = f"""
matched AS (
  SELECT q.query_id, q.workspace_id, c.chunk_id, c.label = q.label AS good, c.ts, c.us, c.source, c.hierarchy, c.entities, c.text,
    q.asked, q.q_scope,
    round(list_dot_product(q.q, c.v) / (sqrt(list_dot_product(q.q, q.q)) * sqrt(list_dot_product(c.v, c.v))), 9) AS cos
  FROM questions q JOIN chunks c ON c.workspace_id = q.workspace_id
  WHERE (q_sources IS NULL OR list_contains(q_sources, c.source)) AND (q_start IS NULL OR c.ts BETWEEN q_start AND q_end)
    AND (q_scope IS NULL OR list_contains(c.hierarchy, q_scope[-1])) AND list_has_all(c.entities, q.wanted)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY cos DESC, chunk_id) AS candidate_rank FROM matched),
"""


def hits_sql(fetch: int) -> str:
    return HITS + f"""
based_hits AS (
  SELECT *, round(cos + exp(-0.01::DOUBLE * greatest((epoch_us({ASOF}) - us) // 86400000000, 0)) * 0.12::DOUBLE
    + CASE WHEN q_scope IS NULL THEN 0.0::DOUBLE WHEN hierarchy[1:len(q_scope)] = q_scope THEN 0.15
        WHEN list_has_any(hierarchy, q_scope) THEN 0.06 ELSE 0.0 END
    + least(len(list_intersect(entities, asked)) / 3.0::DOUBLE, 1.0) * 0.15::DOUBLE
    + CASE WHEN source = 'notion' THEN 0.05::DOUBLE ELSE 0.0 END, 4) AS base_score
  FROM ranked WHERE candidate_rank <= {fetch}),
both_ends AS (SELECT workspace_id, source_a AS chunk_id, source_b AS related_id, type, score, reason FROM correlations
  UNION SELECT workspace_id, source_b, source_a, type, score, reason FROM correlations),
boosts AS (SELECT h.query_id, h.chunk_id, sum(b.score * 0.1::DOUBLE) AS boost FROM based_hits h
  JOIN both_ends b ON b.workspace_id = h.workspace_id AND b.chunk_id = h.chunk_id
  JOIN based_hits o ON o.query_id = h.query_id AND o.chunk_id = b.related_id GROUP BY ALL),
boosted AS (SELECT h.*, coalesce(boost, 0.0) AS boost, round(base_score + coalesce(boost, 0.0), 4) AS score FROM based_hits h
  LEFT JOIN boosts b ON b.query_id = h.query_id AND b.chunk_id = h.chunk_id),
placed AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, base_score DESC, candidate_rank) AS rank FROM boosted)
"""


@query("filtered_knn", with_ctes(RAW_DOCS, STANDARD, VECTORS, QUESTIONS, HITS.rstrip().rstrip(","), body="""
SELECT query_id, chunk_id, round(cos, 6) AS cosine, candidate_rank FROM ranked WHERE candidate_rank <= 10"""))
def filtered_knn(spark, sf_dir):
    prepared = retrieval.prepare_questions(questions(spark, sf_dir), A.as_of())
    found = retrieval.filtered_knn(prepared, chunks(spark, sf_dir), 10, conditions=retrieval.admitted())
    return found.select("query_id", "chunk_id", F.round("cosine", 6).alias("cosine"), "candidate_rank")


@query("hybrid_search", with_ctes(RAW_DOCS, STANDARD, VECTORS, CORRELATIONS, QUESTIONS, hits_sql(20), body="""
SELECT query_id, chunk_id, rank, score AS score, round(boost, 6) AS correlation_boost FROM placed WHERE rank <= 5"""))
def hybrid_search(spark, sf_dir):
    rows = stored_traits(spark, sf_dir)
    found = retrieval.hybrid_search(questions(spark, sf_dir), rows, stored_correlations(rows), A.as_of())
    return found.select("query_id", "chunk_id", "rank", "score",
                        F.round("correlation_boost", 6).alias("correlation_boost"))


@query("correlation_context", with_ctes(RAW_DOCS, STANDARD, VECTORS, CORRELATIONS, QUESTIONS, hits_sql(20), body="""
SELECT p.query_id, p.chunk_id, b.related_id, b.type, b.score AS correlation_score FROM placed p
LEFT JOIN both_ends b ON b.workspace_id = p.workspace_id AND b.chunk_id = p.chunk_id WHERE rank <= 5"""))
def correlation_context(spark, sf_dir):
    rows = stored_traits(spark, sf_dir)
    links = stored_correlations(rows)
    found = retrieval.hybrid_search(questions(spark, sf_dir), rows, links, A.as_of())
    return retrieval.correlation_context(found.select("query_id", "workspace_id", "chunk_id"), links).select(
        "query_id", "chunk_id", "related_id", "type", "correlation_score")


@query("retrieval_eval", with_ctes(RAW_DOCS, STANDARD, VECTORS, QUESTIONS, HITS.rstrip().rstrip(","), """
relevant AS (SELECT q.query_id, count(*) AS relevant FROM questions q JOIN chunks c ON c.workspace_id = q.workspace_id
  AND c.label = q.label GROUP BY 1),
top AS (SELECT query_id, count(*) AS returned, count(*) FILTER (WHERE good) AS found FROM ranked WHERE candidate_rank <= 10 GROUP BY 1)
""", body="""
SELECT r.query_id, relevant, coalesce(returned, 0) AS returned, coalesce(found, 0) AS found,
  round(coalesce(found / returned::DOUBLE, 0.0), 6) AS precision, round(coalesce(found / relevant::DOUBLE, 0.0), 6) AS recall
FROM relevant r LEFT JOIN top t ON t.query_id = r.query_id"""))
def retrieval_eval(spark, sf_dir):
    rows, asked = chunks(spark, sf_dir), questions(spark, sf_dir)
    prepared = retrieval.prepare_questions(asked, A.as_of())
    found = retrieval.filtered_knn(prepared, rows, 10, conditions=retrieval.admitted())
    judged = asked.select("query_id", "workspace_id", "label").join(rows, ["workspace_id", "label"]).select("query_id", "chunk_id")
    return retrieval.evaluate(found, judged)


@query("workspace_discovery", with_ctes(RAW_DOCS, STANDARD, VECTORS, QUESTIONS, """
near AS (SELECT q.query_id, c.workspace_id, row_number() OVER (PARTITION BY q.query_id ORDER BY
    round(list_dot_product(q.q, c.v) / (sqrt(list_dot_product(q.q, q.q)) * sqrt(list_dot_product(c.v, c.v))), 9) DESC, c.chunk_id) AS r
  FROM questions q, chunks c),
counted AS (SELECT query_id, workspace_id, count(*) AS n, min(r) AS first FROM near WHERE r <= 5 GROUP BY ALL)
""", body="SELECT query_id, arg_max(workspace_id, (n, -first)) AS workspace_id FROM counted GROUP BY 1"))
def workspace_discovery(spark, sf_dir):
    prepared = retrieval.prepare_questions(questions(spark, sf_dir), A.as_of())
    return retrieval.discover_workspace(prepared, chunks(spark, sf_dir))


def lite_events(rows):
    """One event per embedded document, found at its chunk."""
    return rows.select(
        "workspace_id", F.concat(F.lit("event_"), "chunk_id").alias("event_id"), F.col("title"), "ts",
        F.col("title").alias("summary"), F.lit("incident").alias("event_type"), "entities", "embedding",
        F.array("chunk_id").alias("source_refs"))


EVIDENCE = """
hits AS (SELECT * FROM placed WHERE rank <= 20),
joined_pairs AS (SELECT DISTINCT h.query_id, least(b.chunk_id, b.related_id) AS lo, greatest(b.chunk_id, b.related_id) AS hi, b.type
  FROM hits h JOIN both_ends b ON b.workspace_id = h.workspace_id AND b.chunk_id = h.chunk_id
  JOIN hits o ON o.query_id = h.query_id AND o.chunk_id = b.related_id),
ends AS (SELECT query_id, unnest([lo, hi]) AS chunk_id FROM joined_pairs),
raises AS (SELECT query_id, chunk_id, count(*) * 0.05::DOUBLE AS raise FROM ends GROUP BY ALL),
uniq AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id,
    trim(regexp_replace(lower(text), '\\s+', ' ', 'g'), ' ') ORDER BY rank) AS u FROM hits) WHERE u = 1),
raised AS (SELECT h.query_id, h.chunk_id, h.rank AS search_rank, round(h.score + least(coalesce(raise, 0.0), 0.15::DOUBLE), 4) AS score
  FROM uniq h LEFT JOIN raises r ON r.query_id = h.query_id AND r.chunk_id = h.chunk_id),
final AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, search_rank) AS rank FROM raised)
"""


@query("evidence", with_ctes(RAW_DOCS, STANDARD, VECTORS, CORRELATIONS, QUESTIONS, hits_sql(60), EVIDENCE,
                             body="SELECT query_id, chunk_id, score AS score, rank FROM final WHERE rank <= 10"))
def evidence(spark, sf_dir):
    rows = stored_keys(spark, sf_dir)
    parts = retrieval.evidence(questions(spark, sf_dir), rows, lite_events(rows), stored_correlations(rows), A.as_of(), texts=chunk_texts(spark, sf_dir))
    return parts["chunks"].select("query_id", "chunk_id", "score", "rank")


FOUND_EVENTS = """
near AS (SELECT q.query_id, q.workspace_id, c.chunk_id, row_number() OVER (PARTITION BY q.query_id ORDER BY
    round(list_dot_product(q.q, c.v) / (sqrt(list_dot_product(q.q, q.q)) * sqrt(list_dot_product(c.v, c.v))), 9) DESC, c.chunk_id) AS r
  FROM questions q JOIN chunks c ON c.workspace_id = q.workspace_id),
named AS (SELECT workspace_id, chunk_id, us, unnest(list_distinct(entities)) AS entity FROM chunks),
latest AS (SELECT *, row_number() OVER (PARTITION BY workspace_id, entity ORDER BY us DESC, 'event_' || chunk_id) AS r FROM named),
asked_for AS (SELECT query_id, workspace_id, unnest(asked) AS entity FROM questions),
found_events AS (SELECT query_id, chunk_id FROM near WHERE r <= 10
  UNION SELECT a.query_id, chunk_id FROM asked_for a JOIN latest l ON l.workspace_id = a.workspace_id
    AND l.entity = a.entity AND l.r <= 10)
"""


@query("evidence_events", with_ctes(RAW_DOCS, STANDARD, VECTORS, QUESTIONS, FOUND_EVENTS,
                                    body="SELECT query_id, 'event_' || chunk_id AS event_id FROM found_events"))
def evidence_events(spark, sf_dir):
    prepared = retrieval.prepare_questions(questions(spark, sf_dir), A.as_of())
    return retrieval.related_events(prepared, lite_events(chunks(spark, sf_dir)), 10).select("query_id", "event_id")


@query("evidence_timeline", with_ctes(RAW_DOCS, STANDARD, VECTORS, CORRELATIONS, QUESTIONS, hits_sql(60), EVIDENCE, FOUND_EVENTS, """
mixed AS (SELECT query_id, 'chunk' AS type, f.chunk_id AS id, us FROM final f JOIN chunks c USING (chunk_id) WHERE rank <= 10
  UNION ALL SELECT query_id, 'event', 'event_' || chunk_id, us FROM found_events JOIN chunks USING (chunk_id))
""", body="SELECT query_id, type, id, row_number() OVER (PARTITION BY query_id ORDER BY us DESC, type, id) AS rank FROM mixed"))
def evidence_timeline(spark, sf_dir):
    rows = stored_keys(spark, sf_dir)
    parts = retrieval.evidence(questions(spark, sf_dir), rows, lite_events(rows), stored_correlations(rows), A.as_of(), texts=chunk_texts(spark, sf_dir))
    return parts["timeline"].select("query_id", "type", "id", "rank")


@query("event_vector_search", with_ctes(RAW_DOCS, STANDARD, VECTORS, QUESTIONS, """
kinds AS (SELECT *, ['incident', 'deployment', 'discussion'][label % 3 + 1] AS kind FROM chunks),
near AS (SELECT q.query_id, c.chunk_id, row_number() OVER (PARTITION BY q.query_id ORDER BY
    round(list_dot_product(q.q, c.v) / (sqrt(list_dot_product(q.q, q.q)) * sqrt(list_dot_product(c.v, c.v))), 9) DESC, c.chunk_id) AS r
  FROM questions q JOIN kinds c ON c.workspace_id = q.workspace_id
  WHERE (q.label % 2 = 0 OR kind IN ('incident', 'deployment')) AND (q_start IS NULL OR c.ts BETWEEN q_start AND q_end))
""", body="SELECT query_id, 'event_' || chunk_id AS event_id, r AS rank FROM near WHERE r <= 7"))
def event_vector_search(spark, sf_dir):
    """Questions of odd labels want two of three event types; some have a time range."""
    kind = F.element_at(F.array(F.lit("incident"), F.lit("deployment"), F.lit("discussion")), (F.col("label") % 3 + 1).cast("int"))
    rows = chunks(spark, sf_dir)
    events = lite_events(rows).drop("event_type").join(rows.select(F.concat(F.lit("event_"), "chunk_id").alias("event_id"), kind.alias("event_type")), "event_id")
    odd = F.regexp_extract("query_id", r"^q(\d+)_", 1).cast("int") % 2 == 1
    asked = retrieval.prepare_questions(questions(spark, sf_dir), A.as_of()).withColumn(
        "q_types", F.when(odd, F.array(F.lit("incident"), F.lit("deployment"))))
    return retrieval.search_events(asked, events, 7).select("query_id", "event_id", F.col("candidate_rank").alias("rank"))


@query("evidence_days", with_ctes(RAW_DOCS, STANDARD, VECTORS, QUESTIONS, HITS.rstrip().rstrip(","), """
rows AS (SELECT query_id, ts::DATE AS day, 1 AS d, 0 AS e FROM ranked WHERE candidate_rank <= 10
  UNION ALL SELECT query_id, day, 0, 1 FROM (SELECT q.query_id, c.ts::DATE AS day, row_number() OVER (PARTITION BY q.query_id ORDER BY
      round(list_dot_product(q.q, c.v) / (sqrt(list_dot_product(q.q, q.q)) * sqrt(list_dot_product(c.v, c.v))), 9) DESC, c.chunk_id) AS r
    FROM questions q JOIN chunks c ON c.workspace_id = q.workspace_id) WHERE r <= 10),
days AS (SELECT query_id, day, sum(d)::BIGINT AS documents, sum(e)::BIGINT AS events FROM rows GROUP BY ALL),
cut AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY day DESC) AS rank FROM days)
""", body="SELECT query_id, strftime(day, '%Y-%m-%d') AS day, documents, events, rank FROM cut WHERE rank <= 10"))
def evidence_days(spark, sf_dir):
    rows = stored_chunks(spark, sf_dir)
    prepared = retrieval.prepare_questions(questions(spark, sf_dir), A.as_of())
    found = retrieval.filtered_knn(prepared, rows, 10, conditions=retrieval.admitted())
    events = retrieval.filtered_knn(prepared, lite_events(rows), 10, "event_id")
    return retrieval.day_groups(found, events).withColumn("day", F.date_format("day", "yyyy-MM-dd"))


@query("name_similarity", """
WITH c AS (SELECT a.vec_id, round(list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[])
  / (sqrt(list_dot_product(a.embedding::DOUBLE[], a.embedding::DOUBLE[]))
  * sqrt(list_dot_product(b.embedding::DOUBLE[], b.embedding::DOUBLE[]))), 6) AS cosine
  FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1)
SELECT * FROM c""")
def name_similarity(spark, sf_dir):
    a = A.table(spark, sf_dir, "embeddings")
    b = a.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    return a.join(b, "vec_id").select("vec_id", F.round(scoring.cosine(F.col("embedding"), F.col("other")), 6).alias("cosine"))
