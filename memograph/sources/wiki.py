"""Wiki exports: blocks, pages, databases and their rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from memograph.plans.tree import descend

# Block types that carry text, and those read another way.
RICH_TYPES = ["paragraph", "heading_1", "heading_2", "heading_3", "bulleted_list_item", "numbered_list_item", "to_do",
              "toggle", "quote", "code", "callout"]
TITLE_TYPES = ["child_page", "child_database"]
CAPTION_TYPES = ["image", "file"]
BLOCK_TYPES = [*RICH_TYPES, *TITLE_TYPES, *CAPTION_TYPES, "table", "bookmark", "divider"]

TEXT_RUN = "struct<plain_text:string,href:string,annotations:struct<bold:boolean,italic:boolean,strikethrough:boolean,underline:boolean,code:boolean,color:string>>"
BODY = (
    f"rich_text array<{TEXT_RUN}>, caption array<struct<plain_text:string>>, title string, url string, type string, "
    "external struct<url:string>, file struct<url:string>, icon struct<emoji:string,external:struct<url:string>,file:struct<url:string>>, "
    "checked boolean, language string, color string, is_toggleable boolean, has_column_header boolean, has_row_header boolean, "
    "cells array<array<struct<plain_text:string>>>"
)
PROPERTY = (
    "struct<id:string,type:string,title:array<struct<plain_text:string>>,rich_text:array<struct<plain_text:string>>,number:string,"
    "checkbox:boolean,select:struct<name:string>,multi_select:array<struct<name:string>>,date:struct<start:string>,email:string,"
    "phone_number:string,url:string,relation:array<struct<id:string>>,rollup:struct<number:string,array:string>,"
    "status:struct<name:string>,people:array<struct<id:string>>,files:array<struct<name:string,file:struct<url:string>>>,"
    "created_time:string,created_by:struct<id:string>,last_edited_time:string,last_edited_by:struct<id:string>>"
)


def plain_text(runs: Column) -> Column:
    return F.coalesce(F.array_join(F.transform(runs, lambda r: F.coalesce(r["plain_text"], F.lit(""))), ""), F.lit(""))


def blocks(raw: DataFrame, json: str = "json", table_text: bool = False) -> DataFrame:
    """Typed blocks with content and a metadata document; unknown types are dropped.

    Table rows carry no text by default. With table_text their cells are read.
    """
    kind = F.get_json_object(json, "$.type")
    known = BLOCK_TYPES + (["table_row"] if table_text else [])
    typed = raw.withColumn("block_type", kind).filter(F.col("block_type").isin(known)).withColumn(
        "_b", F.from_json(
            F.call_function("get_json_object", F.col(json), F.concat(F.lit("$."), "block_type")), BODY))
    t, b = F.col("block_type"), lambda name: F.col(f"_b.{name}")
    cells = F.array_join(F.transform(b("cells"), plain_text), " | ")
    content = (
        F.when(t.isin(RICH_TYPES), plain_text(b("rich_text")))
        .when(t.isin(TITLE_TYPES), F.coalesce(b("title"), F.lit("")))
        .when(t.isin(CAPTION_TYPES), plain_text(b("caption")))
        .when(t == "bookmark", F.coalesce(b("url"), F.lit("")))
        .when(t == "divider", "---").when(t == "table_row", cells).otherwise("")
    )
    address = F.when(b("type") == "file", b("file.url")).otherwise(b("external.url"))
    metadata = F.to_json(F.struct(
        b("color").alias("color"), b("is_toggleable").alias("is_toggleable"),
        F.when(t == "to_do", F.coalesce(b("checked"), F.lit(False))).alias("checked"),
        F.when(t == "code", F.coalesce(b("language"), F.lit("text"))).alias("language"),
        F.when(t.isin("code", *CAPTION_TYPES), plain_text(b("caption"))).alias("caption"),
        F.when(t == "callout", F.coalesce(b("icon.emoji"), b("icon.external.url"), b("icon.file.url"))).alias("icon"),
        F.when(t.isin(TITLE_TYPES), b("title")).alias("title"),
        F.when(t == "bookmark", b("url")).when(t.isin(CAPTION_TYPES), address).alias("url"),
        F.when(t == "table", F.coalesce(b("has_column_header"), F.lit(False))).alias("has_column_header"),
        F.when(t == "table", F.coalesce(b("has_row_header"), F.lit(False))).alias("has_row_header"),
    ))
    return typed.select(
        *[c for c in raw.columns if c != json], "block_type", content.alias("content"), metadata.alias("metadata"),
        b("rich_text").alias("rich_text"))


def page_contents(typed: DataFrame, max_depth: int | None = None, keep_blank: bool = True) -> DataFrame:
    """Text of each page: top-level blocks apart by a blank line, nested text below its block.

    A block without text hides everything nested in it, so the page text is the
    pre-order walk over blocks whose whole chain of ancestors has text. With
    keep_blank a blank top-level block still adds its separator.
    """
    alive = typed.filter((F.col("content") != "") | F.col("parent_id").isNull())
    walked = descend(
        alive.select("page_id", "block_id", "parent_id", "position", "content"), "block_id", "parent_id",
        F.struct("position", "block_id"), max_depth)
    rooted = walked.withColumn("_root", F.element_at("path_steps", 1))
    # A blank root has children in the export but not in the text.
    blank = rooted.filter((F.col("depth") == 0) & (F.col("content") == "")).select("page_id", "_root")
    seen = rooted.join(blank, ["page_id", "_root"], "left_anti")
    tops = seen.groupBy("page_id", "_root").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("path_steps", "content"))), lambda s: s["content"]), "\n")
        .alias("text"))
    if keep_blank:
        tops = tops.unionByName(blank.withColumn("text", F.lit("")))
    return tops.groupBy("page_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_root", "text"))), lambda s: s["text"]), "\n\n")
        .alias("content"), F.count(F.lit(1)).alias("top_blocks"))


def properties(json: Column) -> Column:
    return F.from_json(F.get_json_object(json, "$.properties"), f"map<string,{PROPERTY}>")


def first_title(props: Column, default: str) -> Column:
    """Text of the first property of type title."""
    titled = F.filter(F.map_values(props), lambda p: p["type"] == "title")
    found = F.when(F.size(titled) > 0, plain_text(F.element_at(titled, 1)["title"]))
    return F.coalesce(F.nullif(found, F.lit("")), F.lit(default))


def _listed(items: Column) -> Column:
    return F.when(F.size(items) > 0, F.concat(F.lit("['"), F.array_join(items, "', '"), F.lit("']")))


def property_text(p: Column) -> Column:
    """Value of one property as text; empty, false and zero values are null."""
    kind = p["type"]
    files = F.transform(p["files"], lambda f: F.concat(
        F.lit("{'name': '"), f["name"], F.lit("', 'url': "),
        F.coalesce(F.concat(F.lit("'"), f["file"]["url"], F.lit("'")), F.lit("None")), F.lit("}")))
    value = (
        F.when(kind == "title", plain_text(p["title"])).when(kind.isin("rich_text", "text"), plain_text(p["rich_text"]))
        .when(kind == "number", F.when(p["number"].try_cast("double") != 0, p["number"]))
        .when(kind == "checkbox", F.when(p["checkbox"], "True"))
        .when(kind == "select", p["select"]["name"]).when(kind == "status", p["status"]["name"])
        .when(kind == "multi_select", _listed(F.transform(p["multi_select"], lambda o: o["name"])))
        .when(kind == "date", p["date"]["start"]).when(kind == "email", p["email"])
        .when(kind == "phone_number", p["phone_number"]).when(kind == "url", p["url"])
        .when(kind == "relation", _listed(F.transform(p["relation"], lambda r: r["id"])))
        .when(kind == "rollup", F.coalesce(F.when(p["rollup"]["number"].try_cast("double") != 0, p["rollup"]["number"]),
                                           F.when(p["rollup"]["array"] != "[]", p["rollup"]["array"])))
        .when(kind == "people", _listed(F.transform(p["people"], lambda r: r["id"])))
        .when(kind == "files", F.when(F.size(files) > 0, F.concat(F.lit("["), F.array_join(files, ", "), F.lit("]"))))
        .when(kind == "created_time", p["created_time"]).when(kind == "created_by", p["created_by"]["id"])
        .when(kind == "last_edited_time", p["last_edited_time"]).when(kind == "last_edited_by", p["last_edited_by"]["id"])
    )
    return F.nullif(value, F.lit(""))


def row_documents(rows: DataFrame, contents: DataFrame, json: str = "json") -> DataFrame:
    """Database rows as documents: `name: value` lines, then the row's own blocks."""
    props = properties(F.col(json))
    parsed = rows.withColumn("_p", props)
    lines = F.filter(
        F.transform(F.map_entries("_p"), lambda e: F.concat(e["key"], F.lit(": "), property_text(e["value"]))),
        lambda l: l.isNotNull())
    titled = parsed.withColumns({"title_text": first_title(F.col("_p"), ""), "lines": F.array_join(lines, "\n")}).drop("_p")
    joined = titled.join(contents.select(F.col("page_id").alias("row_id"), F.col("content").alias("blocks")), "row_id", "left")
    return joined.select(
        F.col("row_id").alias("id"), F.lit("notion").alias("source"), F.col("row_id").alias("source_id"),
        F.col("database_id").alias("parent_id"),
        F.when(F.col("title_text") != "", F.concat("database_path", F.lit("/"), "title_text")).otherwise(F.col("database_path")).alias("path"),
        F.coalesce(F.nullif("title_text", F.lit("")), F.lit("Untitled")).alias("title"),
        F.concat_ws("\n\n", "lines", F.nullif("blocks", F.lit(""))).alias("content"),
    )


def database_schema(databases: DataFrame, json: str = "json") -> DataFrame:
    """One row per database property with its type-specific settings."""
    settings = (
        "map<string,struct<id:string,type:string,select:struct<options:array<struct<id:string,name:string,color:string>>>,"
        "multi_select:struct<options:array<struct<id:string,name:string,color:string>>>,relation:struct<database_id:string>,"
        "rollup:struct<relation_property_id:string,rollup_property_id:string,function:string>,number:struct<format:string>,"
        "formula:struct<expression:string>>>"
    )
    props = F.from_json(F.get_json_object(json, "$.properties"), settings)
    v = F.col("value")
    chosen = (
        F.when(v["type"] == "select", F.to_json(v["select"])).when(v["type"] == "multi_select", F.to_json(v["multi_select"]))
        .when(v["type"] == "relation", F.to_json(v["relation"])).when(v["type"] == "rollup", F.to_json(v["rollup"]))
        .when(v["type"] == "number", F.to_json(v["number"])).when(v["type"] == "formula", F.to_json(v["formula"]))
        .otherwise("{}")
    )
    return databases.select("database_id", F.explode(props).alias("name", "value")).select(
        "database_id", "name", F.coalesce(v["id"], F.col("name")).alias("property_id"),
        F.coalesce(v["type"], F.lit("unknown")).alias("type"), chosen.alias("metadata"))


def paths(nodes: DataFrame, max_depth: int | None = None) -> DataFrame:
    """Slash-joined titles from the root for pages and databases; roots have no leading slash."""
    walked = descend(nodes, "node_id", "parent_id", F.col("title"), max_depth)
    return walked.withColumn("path", F.array_join("path_steps", "/")).drop("path_steps")


def page_documents(pages: DataFrame, contents: DataFrame, hierarchy: DataFrame) -> DataFrame:
    """Pages with their path and assembled text."""
    return (
        pages.join(contents, "page_id", "left")
        .join(hierarchy.select(F.col("node_id").alias("page_id"), "path"), "page_id", "left")
        .select(
            F.col("page_id").alias("id"), F.lit("notion").alias("source"), F.col("page_id").alias("source_id"),
            "path", "title", F.coalesce("content", F.lit("")).alias("content"), "url", "created_time", "last_edited_time")
    )


def extraction_stats(pages: DataFrame, typed_blocks: DataFrame, databases: DataFrame, rows: DataFrame, docs: DataFrame) -> DataFrame:
    """Totals of one extraction as a single row of aggregates."""
    def tagged(df: DataFrame, kind: str) -> DataFrame:
        return df.select(F.lit(kind).alias("kind"))

    union = tagged(pages, "pages")
    for df, kind in ((typed_blocks, "blocks"), (databases, "databases"), (rows, "rows"), (docs, "documents")):
        union = union.unionAll(tagged(df, kind))
    return union.agg(*[
        F.count_if(F.col("kind") == k).alias(f"total_{k}") for k in ("pages", "blocks", "databases", "rows", "documents")])
