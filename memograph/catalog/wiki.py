"""Wiki export to documents; blocks are the lines of the document collection."""

from __future__ import annotations

from pyspark.sql import functions as F

from memograph import adapters as A
from memograph.catalog.base import query, with_ctes
from memograph.sources import wiki

KINDS = ["paragraph", "heading_2", "bulleted_list_item", "to_do", "quote", "embed", "bookmark"]

BLOCKS = """
split_docs AS (SELECT doc_id, string_split(text, chr(10)) AS parts FROM documents),
numbered AS (SELECT doc_id, generate_subscripts(parts, 1) - 1 AS n, unnest(parts) AS line FROM split_docs),
blocks AS (SELECT *, ['paragraph', 'heading_2', 'bulleted_list_item', 'to_do', 'quote', 'embed', 'bookmark']
    [(doc_id + n) % 7 + 1] AS kind, n // 3 AS grp, n % 3 AS level FROM numbered),
typed AS (SELECT doc_id, n, grp, level, kind, CASE WHEN kind = 'bookmark' THEN '' ELSE line END AS content
  FROM blocks WHERE kind <> 'embed')
"""


def raw_blocks(spark, sf_dir):
    docs = A.table(spark, sf_dir, "documents")
    lines = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("n", "line"))
    kind = F.element_at(F.array(*[F.lit(k) for k in KINDS]), ((F.col("doc_id") + F.col("n")) % 7 + 1).cast("int"))
    run = F.to_json(F.struct(F.col("line").alias("plain_text")))
    parent = F.when(F.col("n") % 3 == 0, F.lit(None)).otherwise(F.col("n") - 1)
    return lines.select(
        F.concat(F.lit("page_"), "doc_id").alias("page_id"),
        F.concat(F.lit("b_"), "doc_id", F.lit("_"), "n").alias("block_id"),
        F.concat(F.lit("b_"), "doc_id", F.lit("_"), parent).alias("parent_id"),
        F.col("n").alias("position"),
        F.concat(F.lit('{"type":"'), kind, F.lit('","'), kind, F.lit('":{"rich_text":['), run, F.lit(']}}')).alias("json"),
    )


@query("wiki_blocks", with_ctes(BLOCKS, body="""
SELECT 'b_' || doc_id || '_' || n AS block_id, kind AS block_type, md5(content) AS content_md5 FROM typed"""))
def wiki_blocks(spark, sf_dir):
    return wiki.blocks(raw_blocks(spark, sf_dir)).select("block_id", "block_type", F.md5("content").alias("content_md5"))


@query("wiki_pages", with_ctes(BLOCKS, """
tops AS (SELECT * FROM typed WHERE level = 0),
seconds AS (SELECT s.* FROM typed s JOIN tops t USING (doc_id, grp) WHERE s.level = 1 AND s.content <> '' AND t.content <> ''),
thirds AS (SELECT s.* FROM typed s JOIN seconds t USING (doc_id, grp) WHERE s.level = 2 AND s.content <> ''),
shown AS (SELECT * FROM tops UNION ALL SELECT * FROM seconds UNION ALL SELECT * FROM thirds),
grouped AS (SELECT doc_id, grp, string_agg(content, chr(10) ORDER BY n) AS t FROM shown GROUP BY ALL)
""", body="""
SELECT 'page_' || doc_id AS page_id, md5(string_agg(t, chr(10) || chr(10) ORDER BY grp)) AS content_md5, count(*) AS top_blocks
FROM grouped GROUP BY doc_id"""))
def wiki_pages(spark, sf_dir):
    return wiki.page_contents(wiki.blocks(raw_blocks(spark, sf_dir))).select(
        "page_id", F.md5("content").alias("content_md5"), "top_blocks")


@query("wiki_rows", """
SELECT 'row_' || p_partkey AS id, 'Parts/' || p_name AS path, p_name AS title,
  md5('Name: ' || p_name || chr(10) || 'Size: ' || p_size || chr(10) || 'Tags: [''' || p_type || ''', ''' || p_brand || ''']'
    || CASE WHEN p_size % 2 = 0 THEN chr(10) || 'Even: True' ELSE '' END
    || CASE WHEN p_partkey % 4 < 2 THEN chr(10) || chr(10) || 'About ' || p_name || CASE WHEN p_partkey % 4 = 0 THEN chr(10) || 'In ' || p_type ELSE '' END
      || chr(10) || chr(10) || p_brand ELSE '' END) AS content_md5 FROM part""")
def wiki_rows(spark, sf_dir):
    part = A.table(spark, sf_dir, "part")

    def run(c):
        return F.array(F.struct(F.col(c).alias("plain_text")))

    props = F.to_json(F.struct(F.struct(
        F.struct(F.lit("title").alias("type"), run("p_name").alias("title")).alias("Name"),
        F.struct(F.lit("number").alias("type"), F.col("p_size").alias("number")).alias("Size"),
        F.struct(F.lit("multi_select").alias("type"), F.array(
            F.struct(F.col("p_type").alias("name")), F.struct(F.col("p_brand").alias("name"))).alias("multi_select")).alias("Tags"),
        F.struct(F.lit("checkbox").alias("type"), (F.col("p_size") % 2 == 0).alias("checkbox")).alias("Even"),
        F.struct(F.lit("select").alias("type"), F.lit(None).cast("struct<name:string>").alias("select")).alias("Empty"),
    ).alias("properties")))
    rows = part.select(F.concat(F.lit("row_"), "p_partkey").alias("row_id"), F.lit("db_parts").alias("database_id"),
                       F.lit("Parts").alias("database_path"), props.alias("json"))
    # Rows with blocks of their own, some nested; rows with one blank block; rows without any.
    row, key = F.concat(F.lit("row_"), "p_partkey"), F.col("p_partkey") % 4

    def block(number, parent, content):
        return part.select(row.alias("page_id"), F.concat(F.lit(f"b{number}_"), "p_partkey").alias("block_id"),
                           (F.concat(F.lit(f"b{parent}_"), "p_partkey") if parent else F.lit(None).cast("string")).alias("parent_id"),
                           F.lit(number).alias("position"), content.alias("content"), key.alias("key"))

    typed = block(1, None, F.concat(F.lit("About "), "p_name")).filter("key < 2").unionByName(
        block(2, 1, F.concat(F.lit("In "), "p_type")).filter("key = 0")).unionByName(
        block(3, None, F.col("p_brand")).filter("key < 2")).unionByName(block(4, None, F.lit("")).filter("key = 2"))
    return wiki.row_documents(rows, wiki.page_contents(typed.drop("key"))).select("id", "path", "title", F.md5("content").alias("content_md5"))


@query("wiki_paths", """
SELECT 'r' || r_regionkey AS node_id, r_name AS path, 0 AS depth FROM region
UNION ALL SELECT 'n' || n_nationkey, r_name || '/' || n_name, 1 FROM nation JOIN region ON r_regionkey = n_regionkey
UNION ALL SELECT 'c' || c_custkey, r_name || '/' || n_name || '/' || c_name, 2 FROM customer
  JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey""")
def wiki_paths(spark, sf_dir):
    def node(t, prefix, key, title, parent_prefix=None, parent=None):
        up = F.concat(F.lit(parent_prefix), parent) if parent else F.lit(None).cast("string")
        return A.table(spark, sf_dir, t).select(
            F.concat(F.lit(prefix), key).alias("node_id"), up.alias("parent_id"), F.col(title).alias("title"))

    nodes = (
        node("region", "r", "r_regionkey", "r_name")
        .unionByName(node("nation", "n", "n_nationkey", "n_name", "r", "n_regionkey"))
        .unionByName(node("customer", "c", "c_custkey", "c_name", "n", "c_nationkey"))
    )
    return wiki.paths(nodes).select("node_id", "path", "depth")
