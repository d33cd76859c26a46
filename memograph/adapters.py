"""Adapters that present generic business tables in the memory data model.

They let the operators run over any landed star-schema, event log and document
collection: users become workspaces, event kinds become operational event
types, conversations become chat messages, and so on.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from memograph.session import prepare

AS_OF = "2024-01-31 00:00:00"
DOC_EPOCH = 1706572800  # 2024-01-30 00:00:00 UTC
CHAT_EPOCH = 1704067200  # 2024-01-01 00:00:00 UTC


def as_of() -> Column:
    return F.lit(AS_OF).cast("timestamp")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    prepare(spark)
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def op_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event log as operational events."""
    return shape_events(table(spark, sf_dir, "events"))


def shape_events(raw: DataFrame) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("int")
    kind = F.col("event_type")
    event_type = (
        F.when((kind == "error") & (F.col("value") >= 20), "outage")
        .when(kind == "error", "incident")
        .when(kind == "purchase", "deployment")
        .when(kind == "signup", "escalation")
        .when((kind == "click") & (k % 3 == 0), "performance_issue")
        .when(kind == "click", "support_spike")
        .otherwise("discussion")
    )
    severity = (
        F.when(k % 10 == 9, F.lit(None).cast("string"))
        .when(F.col("value") < 5, "low")
        .when(F.col("value") < 20, "medium")
        .when(F.col("value") < 60, "high")
        .otherwise("critical")
    )
    ts = F.col("ts").cast("timestamp")
    service = F.concat(F.lit("service_"), k % 20)
    team = F.concat(F.lit("Team_"), k % 7)
    return raw.select(
        F.concat(F.lit("event_"), "event_id").alias("event_id"),
        F.concat(F.lit("ws_"), F.col("user_id") % 50).alias("workspace_id"),
        event_type.alias("event_type"),
        F.concat(F.initcap(F.replace(event_type, F.lit("_"), F.lit(" "))), F.lit(" on "), service).alias("title"),
        F.when(k % 4 != 3, F.concat(F.lit("k="), k, F.lit(" seen by user "), "user_id")).alias("description"),
        ts.alias("ts"),
        severity.alias("severity"),
        F.round(F.lit(0.5) + (k % 50) / F.lit(100.0), 2).alias("confidence"),
        F.concat(
            F.lit("chunk_"), "user_id", F.lit("_"), F.date_format(ts, "yyyyMMdd")
        ).alias("chunk_id"),
        F.when(
            k % 5 == 0, F.array(service, team, F.lit("production"))
        ).otherwise(F.array(service, team)).alias("entities"),
        F.when(
            k % 2 == 0, F.concat(F.lit('{"author":"user_'), "user_id", F.lit('"}'))
        ).otherwise(F.lit("{}")).alias("metadata"),
    )


def event_entity_refs(events: DataFrame) -> DataFrame:
    """Distinct (workspace, chunk, entity) mentions behind a set of events."""
    return (
        events.select("workspace_id", "chunk_id", F.explode("entities").alias("name"))
        .distinct()
        .select(
            "workspace_id",
            "chunk_id",
            "name",
            F.when(F.col("name").startswith("service_"), "system")
            .when(F.col("name").startswith("Team_"), "team")
            .otherwise("document")
            .alias("type"),
        )
    )


def raw_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text collection as connector output, before normalization."""
    docs = prepare(spark).read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    i = F.col("doc_id")
    src = F.substring("source", 4, 10).cast("int")
    kind = i % 6
    note = (
        F.when(
            kind == 0,
            F.concat(
                F.lit("Incident-"), i % 40, F.lit(" outage of postgres in production, @user_"), i % 13,
                F.lit(" paged. 2024-01-"), F.lpad((i % 28 + 1).cast("string"), 2, "0"), F.lit(" 10:15"),
            ),
        )
        .when(
            kind == 1,
            F.concat(
                F.lit("Deployment of project Apollo to staging shipped by @user_"), i % 13,
                F.lit("; docker and kubernetes updated"),
            ),
        )
        .when(kind == 2, F.concat(F.lit("Weekly sync with engineering about project-p"), i % 9, F.lit(" migration")))
        .when(kind == 3, F.lit("High latency on aws after rollback, timeout seen"))
        .when(kind == 5, F.lit("Decision: we will use the github runbook for onboarding"))
        .otherwise(F.lit(""))
    )
    created = F.timestamp_seconds(F.lit(DOC_EPOCH) - i * 420)
    return docs.select(
        F.concat(F.lit("doc_"), i).alias("id"),
        F.element_at(
            F.array(F.lit("slack"), F.lit("notion"), F.lit("jira"), F.lit("gdrive")), src % 4 + 1
        ).alias("source"),
        F.concat(F.lit("ws_"), i % 8).alias("workspace_id"),
        F.when(src % 4 == 1, F.concat(F.lit("space_"), "lang")).alias("parent_id"),
        F.concat(F.lit("/"), "lang", F.lit("/"), "source", F.lit("/doc_"), i).alias("path"),
        F.when(i % 50 == 49, F.lit("")).otherwise(F.concat(F.lit("Note "), i, F.lit(" "), "lang")).alias("title"),
        F.when(note == "", F.col("text")).otherwise(F.concat("text", F.lit("\n"), note)).alias("content"),
        F.when(src % 4 != 0, F.concat(F.lit("https://wiki.example.com/"), "lang", F.lit("/"), i)).alias("url"),
        F.when(i % 3 == 0, F.concat(F.lit("user_"), i % 13)).alias("author"),
        F.when(i % 3 == 1, F.concat(F.lit("user_"), i % 13)).alias("created_by"),
        F.when(i % 4 != 3, created).alias("created_time"),
        created.alias("last_edited_time"),
        F.when(src % 4 == 0, F.concat(F.lit("chan_"), i % 5)).alias("channel_name"),
        F.when(i % 7 == 0, F.lit("platform")).alias("team"),
        F.array("lang").alias("tags"),
        i.alias("doc_id"),
    )


def chat_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = table(spark, sf_dir, "nation")
    n = F.col("n_nationkey")
    return nation.select(
        F.concat(F.lit("U"), n).alias("user_id"),
        F.when(n % 3 == 0, F.lit("")).otherwise(F.initcap(F.lower("n_name"))).alias("display_name"),
        F.when(n % 2 == 0, F.concat(F.lit("Real "), n)).alias("real_name"),
        F.concat(F.lit("login"), n).alias("name"),
    )


def chat_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversation turns as a channel export; even conversations are threads."""
    conv = table(spark, sf_dir, "conversations")
    sizes = conv.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"))
    c, t = F.col("conv_id"), F.col("turn")

    def stamp(turn: Column) -> Column:
        return F.concat((F.lit(CHAT_EPOCH) + c * 7200 + turn * 60).cast("string"), F.lit(".000100"))

    threaded = (c % 2 == 0) & (F.col("n") > 1)
    return conv.join(sizes, "conv_id").select(
        F.concat(F.lit("C"), c % 7).alias("channel_id"),
        F.concat(F.lit("chan_"), c % 7).alias("channel_name"),
        stamp(t).alias("ts"),
        F.when(threaded, stamp(F.lit(0))).alias("thread_ts"),
        F.when(threaded & (t == 0), F.col("n") - 1).otherwise(F.lit(0)).cast("int").alias("reply_count"),
        F.when(F.col("role") != "system", F.concat(F.lit("U"), (c * 3 + t) % 30)).alias("user"),
        F.lit(None).cast("string").alias("bot_id"),
        F.concat("text", F.lit(" <@U"), t % 11, F.lit("> cc <@U"), (t + 3) % 11, F.lit(">")).alias("text"),
    )
