"""Tables that ingest keeps in step, after several batches with repeated and replaced rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from memograph import adapters as A
from memograph.catalog.base import OP_EVENTS, query, with_ctes
from memograph.catalog.detectors import CHAINS, DEPLOYMENTS, RECURRING, SPIKES
from memograph.catalog.documents import RAW_DOCS, STANDARD
from memograph.catalog.search import CORRELATIONS, VECTORS, stored_traits
from memograph.session import cut_lineage, run_folder
from memograph.streaming.maintain import EVENT_COLUMNS, Maintained


@query("ingest_twice", with_ctes(RAW_DOCS, STANDARD, VECTORS, CORRELATIONS, OP_EVENTS, DEPLOYMENTS, RECURRING, CHAINS, SPIKES, """
named AS (SELECT workspace_id, chunk_id, us, unnest(entities) AS name FROM chunks),
entity_pairs AS (
  SELECT a.workspace_id, a.name AS x, b.name AS y, count(*) AS n, max(a.us) AS last_us
  FROM named a JOIN named b ON a.chunk_id = b.chunk_id AND a.name < b.name GROUP BY ALL)
""", body="""
SELECT 'pair' AS part, workspace_id, x AS a, y AS b, n::DOUBLE AS value, last_us::VARCHAR AS note FROM entity_pairs
UNION ALL SELECT 'correlation', workspace_id, source_a, source_b, score, type || ': ' || reason FROM correlations
UNION ALL SELECT 'recurring', workspace_id, pattern_id, severity, confidence, description FROM recurring_patterns
UNION ALL SELECT 'chain', workspace_id, pattern_id, 'high', 0.85, description FROM chains
UNION ALL SELECT 'spike', workspace_id, 'pattern_spike_' || event_type, 'medium', 0.80,
  'Surge in operational events of type ''' || event_type || ''' detected: ' || count_24h
    || ' events in the last 24 hours, compared to a baseline average of ' || printf('%.1f', daily_mean) || ' per day.' FROM freq_spikes"""))
def ingest_twice(spark, sf_dir):
    """Three batches, the second sent twice; the first holds older versions of rows that the third replaces."""
    chunks, events = stored_traits(spark, sf_dir), cut_lineage(A.op_events(spark, sf_dir).select(*EVENT_COLUMNS))
    number = F.substring("event_id", 7, 20).cast("long")
    old_chunks = chunks.filter("seen_at % 3 = 2 AND seen_at % 2 = 0").withColumns({
        "embedding": F.reverse("embedding"), "entities": F.array(F.lit("service_1"), F.lit("topic_1"), F.lit("old")), "seen_at": F.col("seen_at") - 1})
    old_events = events.filter((number % 3 == 2) & (number % 2 == 0)).withColumns({
        "event_type": F.when(number % 4 == 0, "deployment").otherwise("incident"), "title": F.lit("Old"), "entities": F.array(F.lit("old"))})
    store = Maintained(spark, run_folder(spark, "maintained"), A.as_of())
    for batch in (0, 1, 1, 2):
        some, news = chunks.filter(F.col("seen_at") % 3 == batch), events.filter(number % 3 == batch)
        if batch == 0:
            some, news = some.unionByName(old_chunks), news.unionByName(old_events)
        store.apply(f"batch-{batch}", some, news)
    pairs = store.cooccurrence().select(
        F.lit("pair").alias("part"), "workspace_id", F.col("entity_a").alias("a"), F.col("entity_b").alias("b"), F.col("score").alias("value"),
        F.unix_micros("last_seen").cast("string").alias("note"))
    links = store.correlations().select(
        F.lit("correlation").alias("part"), "workspace_id", F.col("source_a").alias("a"), F.col("source_b").alias("b"), F.col("score").alias("value"),
        F.concat("type", F.lit(": "), "reason").alias("note"))
    kind = F.when(F.col("pattern_type") == "recurring_incident", "recurring").when(F.col("pattern_type") == "escalation_chain", "chain").otherwise("spike")
    found = store.patterns().select(
        kind.alias("part"), "workspace_id", F.col("pattern_id").alias("a"), F.col("severity").alias("b"), F.col("confidence").alias("value"),
        F.col("description").alias("note"))
    return pairs.unionByName(links).unionByName(found)
