"""Keyed tables that are written twice, emptied by workspace, merged along chains, and deep trees."""

from __future__ import annotations

from pyspark.sql import functions as F

from memograph import adapters as A
from memograph.catalog.base import query
from memograph.operators import upsert
from memograph.session import run_folder
from memograph.sources import documents, sinks, wiki

ORDER_ROWS = """
sent AS (SELECT o_orderkey AS chunk_id, o_orderstatus AS workspace_id,
    CASE WHEN o_orderkey % 5 <> 0 THEN date_trunc('year', o_orderdate)::DATE END AS date, round(o_totalprice * 100)::BIGINT AS body FROM orders),
again AS (SELECT chunk_id, CASE WHEN chunk_id % 4 = 0 THEN NULL ELSE workspace_id END AS workspace_id,
    CASE WHEN chunk_id % 2 = 0 THEN DATE '2001-01-01' ELSE date END AS date, body + 7 AS body FROM sent WHERE chunk_id % 3 = 0),
stored AS (SELECT * FROM again UNION ALL SELECT * FROM sent WHERE chunk_id % 3 <> 0)
"""


def order_store(spark, sf_dir):
    """A table keyed by chunk_id, written, then written again with moved, null and repeated keys."""
    sent = A.table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("chunk_id"), F.col("o_orderstatus").alias("workspace_id"),
        F.when(F.col("o_orderkey") % 5 != 0, F.trunc("o_orderdate", "year")).alias("date"),
        F.round(F.col("o_totalprice") * 100).cast("long").alias("body"), F.lit(1).alias("seen_at"))
    some = sent.filter("chunk_id % 3 = 0").withColumns({
        "workspace_id": F.when(F.col("chunk_id") % 4 != 0, F.col("workspace_id")),
        "date": F.when(F.col("chunk_id") % 2 == 0, F.lit("2001-01-01").cast("date")).otherwise(F.col("date"))})
    again = some.withColumns({"body": F.col("body") + 3, "seen_at": F.lit(2)}).unionByName(
        some.withColumns({"body": F.col("body") + 7, "seen_at": F.lit(3)}))
    path = run_folder(spark, "store")
    for rows in (sent, again):
        sinks.upsert(rows, path, ["chunk_id"], ["seen_at"], ["workspace_id", "date"])
    return path


@query("chunk_store_upsert", f"WITH {ORDER_ROWS} SELECT chunk_id, workspace_id, date, body FROM stored")
def chunk_store_upsert(spark, sf_dir):
    return spark.read.parquet(order_store(spark, sf_dir)).select("chunk_id", "workspace_id", F.col("date").cast("date").alias("date"), "body")


@query("workspace_reset", f"""
WITH {ORDER_ROWS} SELECT coalesce(workspace_id, '-') AS workspace_id, count(*) AS n, sum(body)::BIGINT AS checksum
FROM stored WHERE workspace_id IS DISTINCT FROM 'F' GROUP BY 1""")
def workspace_reset(spark, sf_dir):
    path = order_store(spark, sf_dir)
    sinks.reset_workspace(spark, path, "F")
    return spark.read.parquet(path).groupBy(F.coalesce("workspace_id", F.lit("-")).alias("workspace_id")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("body").alias("checksum"))


@query("event_store_upsert", """
WITH sent AS (SELECT 'event_' || event_id AS event_id, 'ws_' || (user_id % 5) AS workspace_id, event_type AS title,
    CASE WHEN event_id % 7 <> 0 THEN ts::DATE END AS date, event_id AS n FROM events)
SELECT event_id, workspace_id, CASE WHEN n % 2 = 0 THEN upper(title) ELSE title END AS title,
  CASE WHEN n % 6 = 0 THEN NULL ELSE date END AS date FROM sent""")
def event_store_upsert(spark, sf_dir):
    sent = A.table(spark, sf_dir, "events").select(
        F.concat(F.lit("event_"), "event_id").alias("event_id"), F.concat(F.lit("ws_"), F.col("user_id") % 5).alias("workspace_id"),
        F.col("event_type").alias("title"), F.when(F.col("event_id") % 7 != 0, F.to_date("ts")).alias("date"), F.col("event_id").alias("n"),
        F.lit(0).alias("seen_at"))
    again = sent.filter("n % 2 = 0").withColumns({"title": F.upper("title"), "date": F.when(F.col("n") % 6 != 0, F.col("date")), "seen_at": F.lit(1)})
    path = run_folder(spark, "events")
    for rows in (sent, again, again):
        sinks.upsert(rows, path, ["event_id"], ["seen_at"], ["workspace_id", "date"])
    return spark.read.parquet(path).select("event_id", "workspace_id", "title", F.col("date").cast("date").alias("date"))


@query("chained_merge", """
WITH canon AS (SELECT p_partkey, p_partkey // 9 * 9 AS c FROM part),
refs AS (SELECT DISTINCT l_orderkey, c FROM lineitem JOIN canon ON p_partkey = l_partkey),
next_ones AS (SELECT a.c AS s, b.c AS t FROM canon a JOIN canon b ON b.p_partkey = a.p_partkey + 3),
pointed AS (SELECT s, t, count(*) AS merged FROM next_ones WHERE s <> t GROUP BY ALL)
SELECT 'nodes' AS part, count(DISTINCT c) AS n, sum(DISTINCT c)::BIGINT AS checksum FROM canon
UNION ALL SELECT 'refs', count(*), sum(c)::BIGINT FROM refs
UNION ALL SELECT 'edges', count(*), sum(s * merged + t)::BIGINT FROM pointed""")
def chained_merge(spark, sf_dir):
    part = A.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("entity_id"), F.lit("w").alias("workspace_id"))
    mapping = part.filter("entity_id % 9 <> 0").select(
        F.col("entity_id").alias("duplicate_id"), (F.col("entity_id") - 1).alias("canonical_id"))
    refs = A.table(spark, sf_dir, "lineitem").select(
        F.lit("w").alias("workspace_id"), F.col("l_orderkey").alias("chunk_id"), F.col("l_partkey").alias("entity_id"), F.lit("m").alias("mention_text"))
    other = part.select((F.col("entity_id") - 3).alias("source_id"), F.col("entity_id").alias("target_id"))
    edges = other.join(part.select(F.col("entity_id").alias("source_id")), "source_id", "left_semi").select(
        F.lit("w").alias("workspace_id"), "source_id", "target_id", F.lit("depends_on").alias("relationship_type"), F.lit(0.5).alias("confidence"),
        F.lit(None).cast("string").alias("evidence"), F.lit(0).alias("seen_at"))
    kept, moved, merged = upsert.merge_entities(part, refs, edges, mapping)

    def check(rows, name, value):
        return rows.agg(F.lit(name).alias("part"), F.count(F.lit(1)).alias("n"), F.sum(value).alias("checksum"))

    return check(kept, "nodes", F.col("entity_id")).unionByName(check(moved, "refs", F.col("entity_id"))).unionByName(
        check(merged, "edges", F.col("source_id") * F.col("merged_rows") + F.col("target_id")))


@query("deep_paths", """
WITH chains AS (SELECT p_partkey AS k, p_partkey // 27 AS chain FROM part)
SELECT a.k AS node_id, count(*) - 1 AS depth, string_agg(b.k::VARCHAR, '/' ORDER BY b.k) AS path
FROM chains a JOIN chains b ON a.chain = b.chain AND b.k <= a.k GROUP BY a.k""")
def deep_paths(spark, sf_dir):
    k = F.col("p_partkey")
    nodes = A.table(spark, sf_dir, "part").select(
        k.alias("node_id"), F.when(k % 27 != 0, k - 1).alias("parent_id"), k.cast("string").alias("title"))
    return wiki.paths(nodes).select("node_id", "depth", "path")


@query("insert_or_ignore", """
WITH current AS (SELECT o_orderkey AS k, o_custkey AS v FROM orders WHERE o_orderkey % 3 <> 0)
SELECT k, v, 'old' AS made FROM current
UNION ALL SELECT o_orderkey, o_custkey + 1, 'new' FROM orders WHERE o_orderkey % 3 = 0""")
def insert_or_ignore(spark, sf_dir):
    """Keys that are there stay as they are; of two new rows of a key the first is added."""
    orders = A.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_custkey").alias("v"))
    current = orders.filter("k % 3 <> 0").select("k", "v", F.lit("old").alias("made"), F.lit(0).alias("seen_at"))
    again = orders.select("k", F.explode(F.array(F.lit(1), F.lit(2))).alias("seen_at"), "v").select(
        "k", (F.col("v") + F.col("seen_at")).alias("v"), F.lit("new").alias("made"), "seen_at")
    return upsert.insert_missing(current, again, ["k"], ["seen_at"]).select("k", "v", "made")


@query("landed_documents", """
SELECT 'T-' || o_orderkey AS id, 'jira' AS source, 'ws_' || (o_custkey % 5) AS workspace_id, o_orderpriority AS title, NULL AS content,
  epoch_us(o_orderdate::TIMESTAMP) AS created_us FROM orders WHERE o_orderkey % 2 = 0
UNION ALL SELECT 'F-' || o_orderkey, 'gdrive', 'ws_' || (o_custkey % 5), o_orderpriority, 'Total ' || round(o_totalprice * 100)::BIGINT, NULL
FROM orders WHERE o_orderkey % 2 = 1""")
def landed_documents(spark, sf_dir):
    """Orders landed as ticket lines in JSON, without content and with a field too many, and as drive files in Parquet, without a time."""
    orders = A.table(spark, sf_dir, "orders")
    space, even = F.concat(F.lit("ws_"), F.col("o_custkey") % 5).alias("workspace_id"), F.col("o_orderkey") % 2 == 0
    tickets, files = run_folder(spark, "tickets"), run_folder(spark, "files")
    orders.filter(even).select(
        F.concat(F.lit("T-"), "o_orderkey").alias("id"), space, F.col("o_orderpriority").alias("title"),
        F.col("o_orderdate").cast("timestamp").alias("created_time"), F.lit("github").alias("source"), F.lit(1).alias("votes")).write.json(tickets)
    orders.filter(~even).select(
        F.concat(F.lit("F-"), "o_orderkey").alias("id"), space, F.col("o_orderpriority").alias("title"),
        F.concat(F.lit("Total "), F.round(F.col("o_totalprice") * 100).cast("long")).alias("content")).write.parquet(files)
    found = documents.read_tickets(spark, tickets).unionByName(documents.read_drive(spark, files, "parquet"))
    return found.select("id", "source", "workspace_id", "title", "content", F.unix_micros("created_time").alias("created_us"))
