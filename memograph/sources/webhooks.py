"""Webhook payloads as events; works on batch and streaming frames alike."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from memograph import vocab
from memograph.functions import text
from memograph.plans.timescan import carry_last, micros

PAYLOAD_COLUMNS = "webhook_event_id string, source string, payload string, kind string, received_at timestamp"


def _json(path: str) -> Column:
    return F.get_json_object("payload", path)


def _or(value: Column, default: str) -> Column:
    return F.coalesce(F.nullif(value, F.lit("")), F.lit(default))


def _workspace() -> Column:
    return F.coalesce(_json("$.workspace_id"), F.lit(vocab.DEFAULT_WORKSPACE))


def _event(rows: DataFrame, event_type: Column, title: Column, summary: Column, entities: Column, severity: Column,
           team: str, metadata: Column) -> DataFrame:
    return rows.select(
        _workspace().alias("workspace_id"), F.concat(F.lit("event_"), "webhook_event_id").alias("event_id"), "source",
        event_type.alias("event_type"), title.alias("title"), summary.alias("summary"), entities.alias("entities"),
        severity.alias("severity"), F.lit(team).alias("team"), metadata.alias("metadata"), F.lit(1.0).alias("confidence"),
        F.col("received_at").alias("ts"))


def chat_incidents(raw: DataFrame) -> DataFrame:
    """Messages (not their edits) from an incident channel or mentioning an alert or failure."""
    channel, body = F.coalesce(_json("$.event.channel"), F.lit("")), F.coalesce(_json("$.event.text"), F.lit(""))
    wanted = (
        (F.col("source") == "slack") & (_json("$.event.type") == "message") & F.nullif(_json("$.event.subtype"), F.lit("")).isNull()
        & (channel.contains("incident") | text.contains_any(F.lower(body), ["alert", "fail"]))
    )
    return _event(
        raw.filter(wanted), F.lit("incident"), F.concat(F.lit("Slack Incident Chat: #"), channel), body,
        F.array(F.lit("slack"), channel), F.lit("medium"), "Operations",
        F.to_json(F.struct(channel.alias("channel"), _json("$.event.user").alias("user"))))


def code_events(raw: DataFrame) -> DataFrame:
    """Deployments and releases of a code host; the payload shape or the header names the kind."""
    rows = raw.filter(F.col("source") == "github")
    deploys = F.coalesce((_json("$.deployment").isNotNull() & (_json("$.deployment") != "{}")), F.lit(False)) | (
        F.coalesce(F.col("kind"), F.lit("")) == "deployment")
    releases = ~deploys & (F.coalesce((_json("$.release").isNotNull() & (_json("$.release") != "{}")), F.lit(False)) | (
        F.coalesce(F.col("kind"), F.lit("")) == "release"))
    repo, ref = F.coalesce(_json("$.repository.name"), F.lit("unknown_repo")), F.coalesce(_json("$.ref"), F.lit("main"))
    env = F.coalesce(_json("$.deployment.environment"), F.lit("production"))
    creator = F.coalesce(_json("$.deployment.creator.login"), F.lit("unknown_author"))
    tag, author = F.coalesce(_json("$.release.tag_name"), F.lit("v1.0.0")), F.coalesce(_json("$.release.author.login"), F.lit("unknown"))
    kind = F.when(deploys, "deployment").otherwise("release")
    title = F.when(deploys, F.concat(F.lit("GitHub Deployment: "), repo, F.lit(" to "), env)).otherwise(
        F.concat(F.lit("GitHub Release: "), repo, F.lit(" "), tag))
    summary = F.when(deploys, F.concat(
        F.lit("Deployment of "), repo, F.lit(" ("), ref, F.lit(") to "), env, F.lit(" triggered by "), creator, F.lit("."))
    ).otherwise(F.concat(
        F.lit("GitHub release "), tag, F.lit(" published in repository "), repo, F.lit(" by "), author, F.lit(".")))
    entities = F.array(repo, F.when(deploys, env).otherwise(tag), F.lit("github"))
    metadata = F.to_json(F.struct(
        repo.alias("repository"), F.when(deploys, ref).alias("ref"), F.when(deploys, env).alias("environment"),
        F.when(~deploys, tag).alias("tag"), F.when(deploys, creator).otherwise(author).alias("author")))
    return _event(rows.filter(deploys | releases), kind, title, summary, entities, F.lit("low"), "Engineering", metadata)


def alert_incidents(raw: DataFrame) -> DataFrame:
    """Error alerts as incidents with a mapped severity."""
    project = _or(F.coalesce(F.nullif(_json("$.project_name"), F.lit("")), _json("$.project")), "unknown_project")
    message = _or(F.coalesce(F.nullif(_json("$.message"), F.lit("")), _json("$.error_message")), "Unknown error alert")
    level = _or(_json("$.level"), "error")
    return _event(
        raw.filter(F.col("source") == "sentry"), F.lit("incident"), F.concat(F.lit("Sentry Alert: "), project, F.lit(" Exception")),
        message, F.array(project, F.lit("sentry"), level), text.alert_severity(level), "Platform",
        F.to_json(F.struct(project.alias("project"), level.alias("level"))))


def events(raw: DataFrame) -> DataFrame:
    """All event-bearing payloads; unreadable payloads yield none."""
    return chat_incidents(raw).unionByName(code_events(raw)).unionByName(alert_incidents(raw))


def billing_changes(raw: DataFrame) -> DataFrame:
    """Subscription changes: set with a workspace, or end of a subscription id."""
    rows = raw.filter(F.col("source") == "stripe").select(
        _json("$.type").alias("type"), _json("$.data.object.id").alias("subscription_id"),
        _json("$.data.object.customer").alias("customer_id"), _json("$.data.object.status").alias("status"),
        F.coalesce(F.nullif(_json("$.data.object.metadata.workspace_id"), F.lit("")),
                   _json("$.data.object.client_reference_id")).alias("workspace_id"),
        F.col("received_at").alias("ts"), "webhook_event_id")
    kind = F.when(F.col("type").isin("customer.subscription.created", "customer.subscription.updated"), "set").when(
        F.col("type") == "customer.subscription.deleted", "end")
    out = rows.withColumn("change", kind).filter(F.col("change").isNotNull())
    return out.filter((F.col("change") == "end") | F.nullif("workspace_id", F.lit("")).isNotNull())


def subscriptions(changes: DataFrame) -> DataFrame:
    """Latest plan of each workspace.

    An end applies to the workspace that holds the subscription at that moment:
    its last set before the end must carry the same id.
    """
    order = F.struct("ts", "webhook_event_id")
    sets = changes.filter("change = 'set'")
    # A workspace owns a subscription from its first set on: one row per pair, however often it is set.
    owners = sets.groupBy("subscription_id", F.col("workspace_id").alias("owner")).agg(F.min("ts").alias("owned_from"))
    ends = (
        changes.filter("change = 'end'").select("subscription_id", "ts", "webhook_event_id")
        .join(owners, "subscription_id").filter("owned_from <= ts")
        .select("subscription_id", "ts", "webhook_event_id", F.col("owner").alias("workspace_id"))
    )
    null = F.lit(None).cast("string")
    rows = sets.select("workspace_id", "ts", "webhook_event_id", F.lit(0).alias("rank"), F.col("subscription_id").alias("held"),
                       null.alias("subscription_id")).unionByName(
        ends.select("workspace_id", "ts", "webhook_event_id", F.lit(1).alias("rank"), null.alias("held"), "subscription_id"))
    scanned = carry_last(rows.withColumn("us", micros("ts")), ["workspace_id"], ["us", "rank", "webhook_event_id"], "held", "us")
    valid = scanned.filter("rank = 1 AND previous_held = subscription_id")
    steps = sets.select("workspace_id", "subscription_id", "customer_id", "status", "ts", "webhook_event_id").unionByName(
        valid.select("workspace_id", "subscription_id", F.lit(None).cast("string").alias("customer_id"),
                     F.lit("canceled").alias("status"), "ts", "webhook_event_id"))
    plan = F.when(F.col("status").isin("active", "trialing"), "pro").otherwise("free")
    return steps.groupBy("workspace_id").agg(
        F.max_by("subscription_id", order).alias("subscription_id"),
        F.max_by("customer_id", F.when(F.col("customer_id").isNotNull(), order)).alias("customer_id"),
        F.max_by("status", order).alias("status"), F.max_by(plan, order).alias("plan"))


def latest_log(raw: DataFrame) -> DataFrame:
    """Replace-by-id log: the last payload received per id."""
    from memograph.operators.upsert import keep_by

    return keep_by(raw, ["webhook_event_id"], ["received_at", "payload"], newest=True)
