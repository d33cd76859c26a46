"""Entity graph over nations, suppliers, customers and orders."""

from __future__ import annotations

from pyspark.sql import functions as F

from memograph import adapters as A
from memograph.catalog.base import query, with_ctes
from memograph.catalog.documents import MENTION_GRAPH, RAW_DOCS, STANDARD, WORDS
from memograph.functions import text
from memograph.functions.embedding import hashed_trigrams
from memograph.operators import entities, graph, graphbuild, resolution, upsert

NODES = """
nodes AS (
  SELECT 'w' AS workspace_id, 'r' || r_regionkey AS entity_id, r_name AS name, 'department' AS type FROM region
  UNION ALL SELECT 'w', 'n' || n_nationkey, n_name, 'team' FROM nation
  UNION ALL SELECT 'w', 's' || s_suppkey, s_name, 'system' FROM supplier
  UNION ALL SELECT 'w', 'c' || c_custkey, c_name, 'customer' FROM customer),
links AS (
  SELECT 'w' AS workspace_id, 'n' || n_nationkey AS source_id, 'r' || n_regionkey AS target_id, 'part_of' AS relationship_type FROM nation
  UNION ALL SELECT 'w', 's' || s_suppkey, 'n' || s_nationkey, 'part_of' FROM supplier
  UNION ALL SELECT 'w', 'c' || c_custkey, 'n' || c_nationkey, 'assigned_to' FROM customer),
edges AS (SELECT *, source_id || '>' || target_id AS edge_id FROM links)
"""


def nodes(spark, sf_dir):
    def part(t, prefix, key, name, kind):
        return A.table(spark, sf_dir, t).select(
            F.lit("w").alias("workspace_id"), F.concat(F.lit(prefix), key).alias("entity_id"), F.col(name).alias("name"),
            F.lit(kind).alias("type"))

    return (
        part("region", "r", "r_regionkey", "r_name", "department").unionByName(part("nation", "n", "n_nationkey", "n_name", "team"))
        .unionByName(part("supplier", "s", "s_suppkey", "s_name", "system"))
        .unionByName(part("customer", "c", "c_custkey", "c_name", "customer"))
    )


def edges(spark, sf_dir):
    def part(t, sp, sk, tp, tk, kind):
        src, dst = F.concat(F.lit(sp), sk), F.concat(F.lit(tp), tk)
        return A.table(spark, sf_dir, t).select(
            F.lit("w").alias("workspace_id"), src.alias("source_id"), dst.alias("target_id"),
            F.lit(kind).alias("relationship_type"), F.concat(src, F.lit(">"), dst).alias("edge_id"))

    return (
        part("nation", "n", "n_nationkey", "r", "n_regionkey", "part_of")
        .unionByName(part("supplier", "s", "s_suppkey", "n", "s_nationkey", "part_of"))
        .unionByName(part("customer", "c", "c_custkey", "n", "c_nationkey", "assigned_to"))
    )


@query("graph_stats", with_ctes(NODES, body="""
SELECT workspace_id, 'entity' AS kind, type, count(*) AS n FROM nodes GROUP BY ALL
UNION ALL SELECT workspace_id, 'entity', 'total', count(*) FROM nodes GROUP BY ALL
UNION ALL SELECT workspace_id, 'relationship', relationship_type, count(*) FROM edges GROUP BY ALL
UNION ALL SELECT workspace_id, 'relationship', 'total', count(*) FROM edges GROUP BY ALL"""))
def graph_stats(spark, sf_dir):
    return graph.stats(nodes(spark, sf_dir), edges(spark, sf_dir))


@query("entity_degree", with_ctes(NODES, """
ends AS (SELECT workspace_id, source_id AS entity_id, 1 AS o, 0 AS i FROM edges
  UNION ALL SELECT workspace_id, target_id, 0, 1 FROM edges)
""", body="""
SELECT workspace_id, entity_id, sum(o)::BIGINT AS outgoing, sum(i)::BIGINT AS incoming, count(*) AS degree FROM ends GROUP BY ALL"""))
def entity_degree(spark, sf_dir):
    return graph.degrees(edges(spark, sf_dir))


@query("found_entities", with_ctes(NODES, body="""
SELECT entity_id, name FROM nodes WHERE type = 'team' AND lower(name) LIKE '%nation\\_1%' ESCAPE '\\'"""))
def found_entities(spark, sf_dir):
    return graph.find_entities(nodes(spark, sf_dir), contains="Nation_1", kind="team").select("entity_id", "name")


@query("entity_page", with_ctes(NODES, body="""
SELECT entity_id, name, row_number() OVER (ORDER BY name, entity_id) AS place FROM nodes QUALIFY place BETWEEN 36 AND 85"""))
def entity_page(spark, sf_dir):
    return graph.page(nodes(spark, sf_dir), limit=50, offset=35).select("entity_id", "name", "place")


@query("filtered_edges", with_ctes(NODES, body="""
SELECT edge_id FROM edges WHERE relationship_type = 'part_of'
  AND (target_id IN (SELECT 'n' || n_nationkey FROM nation WHERE n_regionkey = 1)
    OR source_id IN (SELECT 'n' || n_nationkey FROM nation WHERE n_regionkey = 1))"""))
def filtered_edges(spark, sf_dir):
    some = A.table(spark, sf_dir, "nation").filter("n_regionkey = 1").select(
        F.lit("w").alias("workspace_id"), F.concat(F.lit("n"), "n_nationkey").alias("entity_id"))
    return graph.filter_edges(edges(spark, sf_dir), "part_of", some).select("edge_id")


@query("neighborhood_2hop", with_ctes(NODES, """
steps AS (SELECT source_id AS a, target_id AS b, edge_id, 'outgoing' AS direction FROM edges
  UNION ALL SELECT target_id, source_id, edge_id, 'incoming' FROM edges),
seeds AS (SELECT 'r' || r_regionkey AS seed FROM region),
hop1 AS (SELECT seed, edge_id, direction, b FROM seeds JOIN steps ON a = seed),
front AS (SELECT DISTINCT seed, b AS x FROM hop1 WHERE b <> seed),
hops AS (SELECT seed, edge_id, direction, b, 1 AS hop FROM hop1
  UNION ALL SELECT seed, edge_id, direction, b, 2 FROM front JOIN steps ON a = x)
""", body="""
SELECT seed AS seed_id, edge_id, direction, min(hop) AS hop, min(b) AS other_id, min(name) AS other_name
FROM hops JOIN nodes ON entity_id = b GROUP BY ALL"""))
def neighborhood_2hop(spark, sf_dir):
    seeds = nodes(spark, sf_dir).filter("type = 'department'")
    near = graph.neighbourhood(edges(spark, sf_dir), seeds, depth=2)
    return graph.described_neighbourhood(near, nodes(spark, sf_dir)).select(
        "seed_id", "edge_id", "direction", "hop", "other_id", "other_name")


@query("neighborhood_khop", with_ctes(NODES, """
steps AS (SELECT source_id AS a, target_id AS b, edge_id, 'outgoing' AS direction FROM edges
  UNION ALL SELECT target_id, source_id, edge_id, 'incoming' FROM edges),
walked AS (SELECT DISTINCT 'n' || n_nationkey AS seed, 'n' || n_nationkey AS x, 0 AS d FROM nation WHERE n_regionkey = 2
  UNION SELECT seed, b, d + 1 FROM walked JOIN steps ON a = x WHERE d < 3),
first_met AS (SELECT seed, x, min(d) AS d FROM walked GROUP BY ALL)
""", body="""
SELECT seed AS seed_id, edge_id, direction, min(d) + 1 AS hop FROM first_met JOIN steps ON a = x GROUP BY ALL""").replace("WITH ", "WITH RECURSIVE ", 1))
def neighborhood_khop(spark, sf_dir):
    seeds = A.table(spark, sf_dir, "nation").filter("n_regionkey = 2").select(
        F.lit("w").alias("workspace_id"), F.concat(F.lit("n"), "n_nationkey").alias("entity_id"))
    return graph.neighbourhood(edges(spark, sf_dir), seeds, depth=4).select("seed_id", "edge_id", "direction", "hop")


REFS = """
item_refs AS (SELECT DISTINCT 'w' AS workspace_id, 'o' || l_orderkey AS chunk_id, 's' || l_suppkey AS entity_id FROM lineitem)
"""


def item_refs(spark, sf_dir):
    return A.table(spark, sf_dir, "lineitem").select(
        F.lit("w").alias("workspace_id"), F.concat(F.lit("o"), "l_orderkey").alias("chunk_id"),
        F.concat(F.lit("s"), "l_suppkey").alias("entity_id"))


@query("chunk_entity_refs", with_ctes(REFS, """
lines AS (SELECT 'w' AS workspace_id, 'o' || l_orderkey AS chunk_id, 's' || l_suppkey AS entity_id, l_linenumber, l_partkey FROM lineitem)
""", body="""
SELECT chunk_id, entity_id, 'part ' || arg_min(l_partkey, (l_linenumber, l_partkey)) AS mention_text FROM lines GROUP BY ALL"""))
def chunk_entity_refs(spark, sf_dir):
    items = A.table(spark, sf_dir, "lineitem")
    mentions = items.select(
        F.lit("w").alias("workspace_id"), F.concat(F.lit("o"), "l_orderkey").alias("chunk_id"),
        F.concat(F.lit("s"), "l_suppkey").alias("entity_id"), F.struct("l_linenumber", "l_partkey").alias("position"),
        F.concat(F.lit("part "), "l_partkey").alias("mention_text"))
    return upsert.entity_refs(mentions).select("chunk_id", "entity_id", "mention_text")


@query("linked_chunks", with_ctes(REFS, """
ranked AS (SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY chunk_id) AS rank FROM item_refs)
""", body="SELECT entity_id, chunk_id FROM ranked WHERE rank <= 50"))
def linked_chunks(spark, sf_dir):
    seeds = nodes(spark, sf_dir).filter("type = 'system'")
    return graph.linked_chunks(item_refs(spark, sf_dir).distinct(), seeds, 50).select("entity_id", "chunk_id")


@query("hit_context", with_ctes(NODES, REFS, """
hits AS (SELECT DISTINCT 'q' || c_nationkey AS query_id, 'o' || o_orderkey AS chunk_id FROM orders
  JOIN customer ON c_custkey = o_custkey WHERE o_orderpriority = '1-URGENT' AND o_totalprice > 400000),
ranked AS (SELECT query_id, h.chunk_id, r.entity_id, row_number() OVER (PARTITION BY query_id, h.chunk_id ORDER BY r.entity_id) AS k
  FROM hits h JOIN item_refs r USING (chunk_id))
""", body="""
SELECT query_id, chunk_id, t.entity_id, s.name, e.edge_id, o.name AS other_name
FROM ranked t JOIN nodes s ON s.entity_id = t.entity_id LEFT JOIN edges e ON e.source_id = t.entity_id
  LEFT JOIN nodes o ON o.entity_id = e.target_id WHERE k <= 5"""))
def hit_context(spark, sf_dir):
    orders, customer = A.table(spark, sf_dir, "orders"), A.table(spark, sf_dir, "customer")
    hits = orders.filter("o_orderpriority = '1-URGENT' AND o_totalprice > 400000").join(
        customer, F.col("c_custkey") == F.col("o_custkey")
    ).select(F.concat(F.lit("q"), "c_nationkey").alias("query_id"), F.lit("w").alias("workspace_id"),
             F.concat(F.lit("o"), "o_orderkey").alias("chunk_id")).distinct()
    out = graph.hit_context(hits, item_refs(spark, sf_dir).distinct(), nodes(spark, sf_dir), edges(spark, sf_dir))
    return out.select("query_id", "chunk_id", "entity_id", "name", "edge_id", "other_name")


PAIRS = """
baskets AS (SELECT DISTINCT l_orderkey, 's' || l_suppkey AS s FROM lineitem),
pairs AS (SELECT a.s AS entity_a, b.s AS entity_b, count(*)::DOUBLE AS score FROM baskets a JOIN baskets b
  ON a.l_orderkey = b.l_orderkey AND a.s < b.s GROUP BY ALL)
"""


LINES_A_TASK = 200_000


def supplier_pairs(spark, sf_dir):
    lines = A.table(spark, sf_dir, "lineitem")
    # A task gets a bounded number of lines; the count is read from the files' footers.
    tasks = -(-lines.count() // LINES_A_TASK) or 1
    slot = F.pmod(F.xxhash64("l_orderkey"), F.lit(16 * tasks)).alias("slot")
    dealt = lines.select(slot, "l_orderkey", "l_suppkey", "l_shipdate").repartition(tasks, "slot")
    baskets = dealt.groupBy("slot", "l_orderkey").agg(
        F.collect_set(F.concat(F.lit("s"), "l_suppkey")).alias("entities"), F.max("l_shipdate").cast("timestamp").alias("ts"))
    return entities.cooccurrence(baskets.withColumn("workspace_id", F.lit("w")), slot="slot", tasks=tasks)


@query("supplier_cooccurrence", with_ctes(PAIRS, body="SELECT * FROM pairs"))
def supplier_cooccurrence(spark, sf_dir):
    return supplier_pairs(spark, sf_dir).select("entity_a", "entity_b", "score")


@query("cooccurrence_neighbors", with_ctes(PAIRS, """
both_ways AS (SELECT entity_a AS entity, entity_b AS neighbour, score FROM pairs
  UNION SELECT entity_b, entity_a, score FROM pairs),
ranked AS (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY score DESC, neighbour) AS rank FROM both_ways)
""", body="SELECT entity, neighbour, score, rank FROM ranked WHERE rank <= 10"))
def cooccurrence_neighbors(spark, sf_dir):
    near = entities.cooccurrence_neighbours(supplier_pairs(spark, sf_dir))
    return graph.top_neighbours(near, 10).select("entity", "neighbour", "score", "rank")


@query("edge_upsert", """
WITH raw AS (SELECT 'c' || o_custkey AS source_id, 's' || l_suppkey AS target_id,
    CASE WHEN l_returnflag = 'R' THEN 'affects' ELSE 'depends_on' END AS relationship_type,
    round(0.5::DOUBLE + l_discount, 2) AS confidence, '<' || o_orderpriority || '>' AS evidence, o_orderkey AS seen_at
  FROM orders JOIN lineitem ON l_orderkey = o_orderkey),
firsts AS (SELECT source_id, target_id, relationship_type, evidence, min(seen_at) AS f FROM raw GROUP BY ALL),
lines AS (SELECT source_id, target_id, relationship_type, string_agg(evidence, chr(10) ORDER BY f, evidence) AS evidence
  FROM firsts GROUP BY ALL)
SELECT r.source_id, r.target_id, r.relationship_type, max(confidence) AS confidence, count(*) AS merged_rows,
  any_value(l.evidence) AS evidence
FROM raw r JOIN lines l USING (source_id, target_id, relationship_type) GROUP BY r.source_id, r.target_id, r.relationship_type""")
def edge_upsert(spark, sf_dir):
    rows = A.table(spark, sf_dir, "orders").join(
        A.table(spark, sf_dir, "lineitem"), F.col("l_orderkey") == F.col("o_orderkey"))
    raw = rows.select(
        F.concat(F.lit("c"), "o_custkey").alias("source_id"), F.concat(F.lit("s"), "l_suppkey").alias("target_id"),
        F.when(F.col("l_returnflag") == "R", "affects").otherwise("depends_on").alias("relationship_type"),
        F.round(F.lit(0.5) + F.col("l_discount"), 2).alias("confidence"),
        F.concat(F.lit("<"), "o_orderpriority", F.lit(">")).alias("evidence"), F.col("o_orderkey").alias("seen_at"))
    return upsert.upsert_edges(raw, ["source_id", "target_id", "relationship_type"])


@query("entity_create", """
WITH m AS (SELECT p_brand AS workspace_id, lower(p_name) AS name_key, p_name AS name, p_partkey FROM part)
SELECT workspace_id, md5(workspace_id || '|product|' || name_key) AS entity_id, arg_min(name, p_partkey) AS name,
  'p' || min(p_partkey) AS source_chunk_id FROM m GROUP BY workspace_id, name_key""")
def entity_create(spark, sf_dir):
    mentions = A.table(spark, sf_dir, "part").select(
        F.col("p_brand").alias("workspace_id"), F.lit("product").alias("type"), F.col("p_name").alias("name"),
        F.concat(F.lit("p"), "p_partkey").alias("chunk_id"), F.col("p_partkey").alias("seen_at"), F.lit(0).alias("position"))
    return upsert.create_entities(mentions).select("workspace_id", "entity_id", "name", "source_chunk_id")


@query("entity_create_known", """
WITH m AS (SELECT p_brand AS workspace_id, lower(p_name) AS name_key, p_name AS name, p_partkey FROM part),
known AS (SELECT workspace_id, name_key, upper(arg_min(name, p_partkey)) AS name, 'p' || min(p_partkey) AS chunk FROM m WHERE p_partkey % 2 = 0 GROUP BY 1, 2),
fresh AS (SELECT workspace_id, name_key, arg_min(name, p_partkey) AS name, 'p' || min(p_partkey) AS chunk FROM m GROUP BY 1, 2)
SELECT f.workspace_id, md5(f.workspace_id || '|product|' || f.name_key) AS entity_id, coalesce(k.name, f.name) AS name,
  coalesce(k.chunk, f.chunk) AS source_chunk_id FROM fresh f LEFT JOIN known k ON k.workspace_id = f.workspace_id AND k.name_key = f.name_key""")
def entity_create_known(spark, sf_dir):
    """Parts of even numbers are stored, in capitals; all parts are mentioned then, and only the rest are new."""
    mentions = A.table(spark, sf_dir, "part").select(
        F.col("p_brand").alias("workspace_id"), F.lit("product").alias("type"), F.col("p_name").alias("name"),
        F.concat(F.lit("p"), "p_partkey").alias("chunk_id"), F.col("p_partkey").alias("seen_at"), F.lit(0).alias("position"))
    known = upsert.create_entities(mentions.filter("seen_at % 2 = 0")).withColumn("name", F.upper("name"))
    return upsert.create_entities(mentions, known).select("workspace_id", "entity_id", "name", "source_chunk_id")


@query("entity_merge", """
WITH canon AS (SELECT p_partkey, min(p_partkey) OVER (PARTITION BY p_name) AS c FROM part),
refs AS (SELECT DISTINCT 'o' || l_orderkey AS chunk_id, c AS entity FROM lineitem JOIN canon ON p_partkey = l_partkey),
pointed AS (SELECT 's' || l_suppkey AS s, c, count(*) AS merged FROM lineitem JOIN canon ON p_partkey = l_partkey GROUP BY ALL)
SELECT 'nodes' AS part, count(DISTINCT c) AS n, sum(DISTINCT c)::BIGINT AS checksum FROM canon
UNION ALL SELECT 'refs', count(*), sum(entity)::BIGINT FROM refs
UNION ALL SELECT 'edges', count(*), sum(merged * (c % 97))::BIGINT FROM pointed""")
def entity_merge(spark, sf_dir):
    part, items = A.table(spark, sf_dir, "part"), A.table(spark, sf_dir, "lineitem")

    def ident(c):
        return F.concat(F.lit("p"), c)

    number = F.substring("id", 2, 20).cast("long")
    ents = part.select(ident("p_partkey").alias("entity_id"), F.lit("w").alias("workspace_id"), "p_name")
    heads = part.groupBy("p_name").agg(F.min("p_partkey").alias("head"))
    mapping = part.join(heads, "p_name").filter("p_partkey <> head").select(
        ident("p_partkey").alias("duplicate_id"), ident("head").alias("canonical_id"))
    refs = items.select(F.lit("w").alias("workspace_id"), F.concat(F.lit("o"), "l_orderkey").alias("chunk_id"),
                        ident("l_partkey").alias("entity_id"), F.lit("m").alias("mention_text"))
    links = items.select(
        F.lit("w").alias("workspace_id"), F.concat(F.lit("s"), "l_suppkey").alias("source_id"),
        ident("l_partkey").alias("target_id"), F.lit("depends_on").alias("relationship_type"), F.lit(0.5).alias("confidence"),
        F.lit(None).cast("string").alias("evidence"), F.col("l_orderkey").alias("seen_at"))
    kept, moved, merged = upsert.merge_entities(ents, refs, links, mapping)

    def check(rows, name, value):
        return rows.agg(F.lit(name).alias("part"), F.count(F.lit(1)).alias("n"), F.sum(value).alias("checksum"))

    return (
        check(kept.withColumn("id", F.col("entity_id")), "nodes", number)
        .unionByName(check(moved.withColumn("id", F.col("entity_id")), "refs", number))
        .unionByName(check(merged.withColumn("id", F.col("target_id")), "edges", F.col("merged_rows") * (number % 97)))
    )


TOKENS = """
toks AS (SELECT name, list_sort(list_distinct(regexp_extract_all(lower(name), '[a-z0-9]+'))) AS t FROM wanted),
ents AS (SELECT entity_id, name AS ename, list_sort(list_distinct(regexp_extract_all(lower(name), '[a-z0-9]+'))) AS t FROM stored)
"""


@query("entity_resolution", """
WITH stored AS (SELECT min(p_partkey) AS entity_id, p_name || ' ' || p_type || ' ' || p_brand AS name,
    upper(p_name || '/' || p_type || '/' || p_brand) AS alias FROM part GROUP BY ALL),
wanted AS (
  SELECT DISTINCT CASE p_partkey % 4 WHEN 0 THEN upper(p_name || ' ' || p_type || ' ' || p_brand)
    WHEN 1 THEN p_name || '/' || p_type || '/' || p_brand WHEN 2 THEN p_type || ' unit ' || p_name || ' ' || p_brand
    ELSE 'unknown item ' || p_size END AS name FROM part),
""" + TOKENS + """,
exact AS (SELECT w.name, arg_min(s.entity_id, (s.name, s.entity_id)) AS e FROM wanted w JOIN stored s ON lower(w.name) = lower(s.name) GROUP BY 1),
alias AS (SELECT w.name, arg_min(s.entity_id, (s.name, s.entity_id)) AS e FROM wanted w JOIN stored s ON lower(w.name) = lower(s.alias)
  WHERE w.name NOT IN (SELECT name FROM exact) GROUP BY 1),
scores AS (SELECT w.name, e.entity_id, e.ename, len(list_intersect(w.t, e.t)) AS i, len(list_distinct(list_concat(w.t, e.t))) AS u
  FROM toks w, ents e WHERE w.name NOT IN (SELECT name FROM exact UNION SELECT name FROM alias)),
best AS (SELECT name, arg_min(entity_id, (-(i / u::DOUBLE), ename, entity_id)) AS e FROM scores WHERE i / u::DOUBLE >= 0.8 GROUP BY 1)
SELECT w.name, coalesce(x.e, a.e, b.e) AS entity_id,
  CASE WHEN x.e IS NOT NULL THEN 'exact' WHEN a.e IS NOT NULL THEN 'alias' WHEN b.e IS NOT NULL THEN 'overlap' ELSE 'new' END AS stage
FROM wanted w LEFT JOIN exact x ON x.name = w.name LEFT JOIN alias a ON a.name = w.name LEFT JOIN best b ON b.name = w.name""")
def entity_resolution(spark, sf_dir):
    part = A.table(spark, sf_dir, "part")
    full = F.concat_ws(" ", "p_name", "p_type", "p_brand")
    slashed = F.concat_ws("/", "p_name", "p_type", "p_brand")
    stored = part.groupBy(full.alias("name"), F.upper(slashed).alias("alias")).agg(F.min("p_partkey").alias("entity_id")).select(
        F.lit("w").alias("workspace_id"), F.lit("product").alias("type"), "entity_id", "name", F.array("alias").alias("aliases"))
    k = F.col("p_partkey") % 4
    name = (
        F.when(k == 0, F.upper(full)).when(k == 1, slashed)
        .when(k == 2, F.concat("p_type", F.lit(" unit "), "p_name", F.lit(" "), "p_brand"))
        .otherwise(F.concat(F.lit("unknown item "), "p_size")))
    wanted = part.select(F.lit("w").alias("workspace_id"), F.lit("product").alias("type"), name.alias("name"))
    return resolution.resolve(wanted, stored).select("name", "entity_id", "stage")


# crc32 of a text's bytes, by the table that eight shifts of each byte give.
NAME_VECTORS = """
crc_steps AS (SELECT list_transform(range(256), lambda b: list_reduce([b] || range(8), lambda c, i: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
spelt AS (SELECT DISTINCT name, '  ' || lower(name) || ' ' AS p FROM (SELECT name FROM wanted UNION ALL SELECT name FROM stored)),
tris AS (SELECT name, unnest(list_transform(range(length(p) - 2), lambda i: substr(p, i + 1, 3))) AS g FROM spelt),
slots AS (SELECT name, xor(list_reduce([4294967295] || list_transform(range(3), lambda i: ascii(substr(g, i + 1, 1))::BIGINT),
    lambda c, x: xor(t[xor(c, x) % 256 + 1], c >> 8)), 4294967295) % 128 AS slot, count(*) AS n FROM tris, crc_steps GROUP BY ALL),
sizes AS (SELECT name, sqrt(sum(n * n)) AS size FROM slots GROUP BY name)
"""


@query("alias_resolution", """
WITH stored AS (SELECT p_partkey AS k, 'part number ' || p_partkey AS name FROM part),
wanted AS (SELECT DISTINCT CASE p_partkey % 3 WHEN 0 THEN 'PN-' || p_partkey WHEN 1 THEN p_brand || '/' || p_partkey ELSE 'none of ' || p_partkey END AS name,
  p_partkey AS k FROM part)
SELECT name, CASE WHEN k % 3 < 2 THEN k END AS entity_id, CASE WHEN k % 3 < 2 THEN 'alias' ELSE 'new' END AS stage FROM wanted""")
def alias_resolution(spark, sf_dir):
    """Stored entities keep their aliases as one text, with blanks and empty entries."""
    part = A.table(spark, sf_dir, "part")
    k = F.col("p_partkey")
    stored = part.select(F.lit("w").alias("workspace_id"), F.lit("product").alias("type"), k.alias("entity_id"), F.concat(F.lit("part number "), k).alias("name"),
                         text.alias_list(F.concat(F.lit(" pn-"), k, F.lit(" ,, "), F.upper("p_brand"), F.lit("/"), k, F.lit(","))).alias("aliases"))
    name = F.when(k % 3 == 0, F.concat(F.lit("PN-"), k)).when(k % 3 == 1, F.concat("p_brand", F.lit("/"), k)).otherwise(F.concat(F.lit("none of "), k))
    wanted = part.select(F.lit("w").alias("workspace_id"), F.lit("product").alias("type"), name.alias("name"))
    return resolution.resolve(wanted, stored).select("name", "entity_id", "stage")


@query("entity_resolution_vectors", """
WITH stored AS (SELECT min(p_partkey) AS entity_id, p_name || ' ' || p_type || ' ' || p_brand AS name FROM part GROUP BY ALL),
wanted AS (SELECT DISTINCT CASE p_partkey % 3 WHEN 0 THEN p_name || ' ' || p_type || ' ' || p_brand
    WHEN 1 THEN p_name || p_type || ' ' || p_brand ELSE 'zq' || p_size || 'xj' END AS name FROM part),
""" + NAME_VECTORS + """,
exact AS (SELECT w.name, s.entity_id FROM wanted w JOIN stored s ON s.name = w.name),
dots AS (SELECT w.name, s.name AS ename, sum(a.n * b.n) AS dot FROM wanted w JOIN slots a ON a.name = w.name JOIN slots b ON b.slot = a.slot
  JOIN stored s ON s.name = b.name WHERE w.name NOT IN (SELECT name FROM exact) GROUP BY ALL),
near AS (SELECT d.name, d.ename, round(dot / (x.size * y.size), 9) AS c FROM dots d JOIN sizes x ON x.name = d.name JOIN sizes y ON y.name = d.ename),
best AS (SELECT name, arg_max(ename, (c, -k)) AS ename, max(c) AS c FROM (SELECT *, row_number() OVER (ORDER BY ename) AS k FROM near) GROUP BY name)
SELECT w.name, coalesce(x.entity_id, s.entity_id) AS entity_id, CASE WHEN x.name IS NOT NULL THEN 'exact' WHEN s.name IS NOT NULL THEN 'vector' ELSE 'new' END AS stage
FROM wanted w LEFT JOIN exact x ON x.name = w.name LEFT JOIN best b ON b.name = w.name AND b.c >= 0.92 LEFT JOIN stored s ON s.name = b.ename""")
def entity_resolution_vectors(spark, sf_dir):
    """Names with a missing space share no token set with the stored ones; their letters still give them away."""
    part = A.table(spark, sf_dir, "part")
    full = F.concat_ws(" ", "p_name", "p_type", "p_brand")
    stored = part.groupBy(full.alias("name")).agg(F.min("p_partkey").alias("entity_id")).select(
        F.lit("w").alias("workspace_id"), F.lit("product").alias("type"), "entity_id", "name", F.array().cast("array<string>").alias("aliases"))
    k = F.col("p_partkey") % 3
    name = F.when(k == 0, full).when(k == 1, F.concat("p_name", "p_type", F.lit(" "), "p_brand")).otherwise(F.concat(F.lit("zq"), "p_size", F.lit("xj")))
    wanted = part.select(F.lit("w").alias("workspace_id"), F.lit("product").alias("type"), name.alias("name"))
    return resolution.resolve(wanted, stored, embed=hashed_trigrams(128)).select("name", "entity_id", "stage")


@query("graph_build", with_ctes(RAW_DOCS, STANDARD, WORDS, MENTION_GRAPH, body="""
SELECT workspace_id, type, name, aliases, source_chunk_id, chunks FROM built""").replace("WITH ", "WITH RECURSIVE ", 1))
def graph_build(spark, sf_dir):
    docs = A.raw_documents(spark, sf_dir)
    tagged = entities.tag(docs, "content")
    found = entities.mention_rows(tagged.withColumns({"chunk_id": F.col("id"), "seen_at": F.col("doc_id")}),
                                  ["workspace_id", "chunk_id", "seen_at"])
    built, refs = resolution.build_graph(found)
    counts = refs.groupBy("entity_id").agg(F.count(F.lit(1)).alias("chunks"))
    return built.join(counts, "entity_id").select(
        "workspace_id", "type", "name", F.array_join("aliases", ",").alias("aliases"), "source_chunk_id", "chunks")


def product_mentions(spark, sf_dir):
    """Four spellings of each part, a token further apart each, and an edge from one to the next."""
    part = A.table(spark, sf_dir, "part")
    full = F.concat_ws(" ", "p_name", "p_type", "p_brand")
    names = [F.upper(full), F.concat_ws("/", "p_name", "p_type", "p_brand"), F.concat(full, F.lit(" unit")), F.concat(F.lit("Old "), full, F.lit(" Unit"))]
    rows = part.select("p_partkey", F.posexplode(F.array(*names)).alias("position", "name"))
    mentions = rows.select(
        F.lit("w").alias("workspace_id"), F.concat(F.lit("c"), F.floor(F.col("p_partkey") / 3)).alias("chunk_id"),
        ((F.col("p_partkey") % 3) * 4 + F.col("position")).alias("position"), "name", F.lit("system").alias("type"), F.col("p_partkey").alias("seen_at"),
        F.when(F.col("position") == 2, F.concat(F.lit("part "), "p_partkey")).alias("description"))
    later = mentions.select("chunk_id", F.col("position").alias("next_at"), F.col("name").alias("target"))
    edges = mentions.join(later, "chunk_id").filter("next_at = position + 1").select(
        "workspace_id", "chunk_id", F.col("name").alias("source"), "target", F.lit("depends_on").alias("relationship_type"),
        (F.lit(0.5) + F.col("position") / 100).alias("confidence"), F.lit(None).cast("string").alias("evidence"), "seen_at")
    return mentions, edges


PRODUCTS = """
spelt AS (
  SELECT 'c' || (p_partkey // 3) AS chunk, p_partkey AS seen, p_partkey % 3 * 4 + v AS position, CASE v
      WHEN 0 THEN upper(p_name || ' ' || p_type || ' ' || p_brand) WHEN 1 THEN p_name || '/' || p_type || '/' || p_brand
      WHEN 2 THEN p_name || ' ' || p_type || ' ' || p_brand || ' unit' ELSE 'Old ' || p_name || ' ' || p_type || ' ' || p_brand || ' Unit' END AS name,
    CASE WHEN v = 2 THEN 'part ' || p_partkey END AS about
  FROM part, (SELECT unnest(range(4)) AS v)),
keyed AS (SELECT *, lower(name) AS key, array_to_string(list_sort(list_distinct(regexp_extract_all(lower(name), '[a-z0-9]+'))), ' ') AS k FROM spelt),
sets AS (SELECT DISTINCT k, string_split(k, ' ') AS t FROM keyed),
-- Sets of at most eight tokens at 0.8 or more are one within the other, so the larger holds the smaller's first token.
within AS (SELECT a.k AS x, b.k AS y FROM sets a JOIN (SELECT k, t, unnest(t) AS token FROM sets) b ON b.token = a.t[1] AND len(b.t) > len(a.t)
  WHERE len(list_intersect(a.t, b.t)) / (len(a.t) + len(b.t) - len(list_intersect(a.t, b.t)))::DOUBLE >= 0.8),
pairs AS (SELECT x, y FROM within UNION ALL SELECT y, x FROM within),
reach AS (SELECT k AS a, k AS b FROM sets UNION SELECT a, y FROM reach JOIN pairs ON b = x),
groups AS (SELECT a AS k, min(b) AS g FROM reach GROUP BY a),
names AS (SELECT key, k, arg_min(name, (seen, name)) AS name, min(seen) AS seen FROM keyed GROUP BY key, k),
heads AS (SELECT g, arg_min(name, (seen, key)) AS head, arg_min(key, (seen, key)) AS head_key, string_agg(name, '|' ORDER BY name) AS aliases
  FROM names JOIN groups USING (k) GROUP BY g),
told AS (SELECT g, arg_min(about, (seen, about)) FILTER (WHERE about IS NOT NULL) AS description, arg_min(chunk, (seen, chunk)) AS source_chunk_id,
    count(DISTINCT chunk) AS chunks FROM keyed JOIN groups USING (k) GROUP BY g),
steps AS (SELECT a.position, x.g AS s, y.g AS t FROM keyed a JOIN keyed b ON a.chunk = b.chunk AND b.position = a.position + 1
  JOIN groups x ON x.k = a.k JOIN groups y ON y.k = b.k),
links AS (SELECT s, t, max(0.5 + position / 100.0::DOUBLE) AS confidence, count(*) AS n FROM steps GROUP BY s, t)
"""


@query("graph_build_twice", "WITH RECURSIVE " + PRODUCTS + """
SELECT 'node' AS part, head AS a, aliases AS b, description AS c, source_chunk_id AS d, chunks AS n, NULL::DOUBLE AS confidence FROM heads JOIN told USING (g)
UNION ALL SELECT 'edge', x.head, y.head, NULL, NULL, n, confidence FROM links JOIN heads x ON x.g = s JOIN heads y ON y.g = t""")
def graph_build_twice(spark, sf_dir):
    """The graph of parts in two batches; spellings of one part fall into either, so the second joins groups of the first."""
    mentions, edges = product_mentions(spark, sf_dir)
    graph = None
    for batch in (0, 1):
        some = (F.col("seen_at") + F.col("position")) % 2 == batch
        graph = graphbuild.extend(graph, mentions.filter(some), edges.filter(F.col("seen_at") % 2 == batch))
    found, refs, links = graphbuild.tables(graph)
    counts = refs.groupBy("entity_id").agg(F.count(F.lit(1)).alias("n"))
    heads = found.select("entity_id", "name")
    none = F.lit(None).cast("string")
    points = found.join(counts, "entity_id").select(
        F.lit("node").alias("part"), F.col("name").alias("a"), F.array_join("aliases", "|").alias("b"), F.col("description").alias("c"),
        F.col("source_chunk_id").alias("d"), "n", F.lit(None).cast("double").alias("confidence"))
    lines = links.join(heads.withColumnsRenamed({"entity_id": "source_id", "name": "a"}), "source_id").join(
        heads.withColumnsRenamed({"entity_id": "target_id", "name": "b"}), "target_id").select(
        F.lit("edge").alias("part"), "a", "b", none.alias("c"), none.alias("d"), F.col("merged_rows").alias("n"), "confidence")
    return points.unionByName(lines)
