"""Issue, deployment, incident and escalation reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from memograph import vocab
from memograph.functions import scoring, text
from memograph.operators.patterns import since
from memograph.plans import timescan
from memograph.plans.rangejoin import follow_join

WS = ["workspace_id"]


def keyword_hits(events: DataFrame, as_of: Column, days: int = 30) -> DataFrame:
    """(workspace, keyword, event) rows; a word used twice in a title counts twice."""
    recent = events.filter((F.col("ts") >= since(as_of, days)) & (F.col("ts") <= as_of))
    return recent.select(
        "workspace_id", "event_id", "event_type", "ts", "title", "description",
        F.explode(text.title_keywords(F.col("title"))).alias("keyword"),
    )


def recurring_issues(events: DataFrame, as_of: Column, days: int = 30) -> DataFrame:
    """Keyword clusters of event titles with confidence, routing and the newest three titles."""
    hits = keyword_hits(events, as_of, days)
    groups = hits.groupBy("workspace_id", "keyword").agg(
        F.count(F.lit(1)).alias("evidence_count"),
        F.array_join(F.array_sort(F.collect_set("event_type")), ",").alias("data_sources"),
    ).filter(F.col("evidence_count") >= 2)
    order = Window.partitionBy("workspace_id", "keyword").orderBy(F.desc("ts"), "event_id")
    shown = (
        hits.select("workspace_id", "keyword", "ts", "event_id", "title")
        .withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= 3)
        .groupBy("workspace_id", "keyword")
        .agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "title"))),
                                      lambda t: t["title"]), ", ").alias("titles"))
    )
    kw, n = F.col("keyword"), F.col("evidence_count")
    tail = F.when(n > 3, F.concat(F.lit(" and "), n - 3, F.lit(" other event(s)."))).otherwise(F.lit("."))
    return groups.join(shown, ["workspace_id", "keyword"]).select(
        "workspace_id",
        F.concat(F.lit("recurring-"), kw).alias("issue_id"),
        F.concat(F.lit("Recurring "), text.capitalize(kw), F.lit(" Activity Detected")).alias("title"),
        F.concat(text.capitalize(kw), F.lit(" Signal Cluster")).alias("category"),
        F.concat(
            F.lit("Multiple operational events and signals referencing '"), kw,
            F.lit("' have been correlated. This includes: "), "titles", tail,
        ).alias("summary"),
        F.round(scoring.issue_confidence(n), 2).alias("confidence"),
        text.routed_team(kw).alias("assigned_team"), text.routed_assignee(kw).alias("assignee"),
        F.lit("Under Investigation").alias("status"),
        F.when(n > 3, "high").otherwise("medium").alias("severity"),
        "evidence_count", "data_sources",
    )


def deployment_stability(events: DataFrame, as_of: Column, days: int = 30) -> DataFrame:
    """Every deployment with its number of incidents in two hours and its stability score."""
    recent = events.filter((F.col("ts") >= since(as_of, days)) & (F.col("ts") <= as_of))
    counted = timescan.count_following(
        recent.filter(F.col("event_type") == "deployment"),
        recent.filter(F.col("event_type").isin(vocab.STABILITY_TYPES)),
        WS, "ts", 7_200_000_000, {"incident_count": F.lit(1)},
    )
    n = F.col("incident_count")
    return counted.select(
        "workspace_id", "event_id", "title", "ts",
        F.coalesce(F.get_json_object("metadata", "$.author"), F.lit("Unknown")).alias("author"),
        n, F.when(n == 0, 100.0).when(n == 1, 50.0).otherwise(0.0).alias("stability_score"),
        F.when(n > 0, 0.85).otherwise(0.95).alias("confidence"),
    )


def stability_evidence(events: DataFrame, as_of: Column, days: int = 30) -> DataFrame:
    """Long form of the incidents linked to each deployment."""
    recent = events.filter((F.col("ts") >= since(as_of, days)) & (F.col("ts") <= as_of))
    deployments = recent.filter(F.col("event_type") == "deployment").select(
        "workspace_id", F.col("event_id").alias("deployment_id"), F.col("ts").alias("deployed_at"))
    incidents = recent.filter(F.col("event_type").isin(vocab.STABILITY_TYPES)).select(
        "workspace_id", "event_id", "ts", "title", F.coalesce("severity", F.lit("medium")).alias("severity"))
    return follow_join(deployments, incidents, WS, "deployed_at", "ts", 7_200_000_000)


def incidents(events: DataFrame, as_of: Column, days: int = 15) -> DataFrame:
    """Recent incidents and outages with their linked channel, ticket and system."""
    recent = events.filter(
        (F.col("ts") >= since(as_of, days)) & (F.col("ts") <= as_of) & F.col("event_type").isin("incident", "outage")
    )

    def tag(name: str, default: str) -> Column:
        value = F.get_json_object("metadata", f"$.{name}")
        return F.coalesce(F.when(value != "", value), F.lit(default))

    return recent.select(
        "workspace_id", "event_id", "title", "ts", F.coalesce("severity", F.lit("medium")).alias("severity"),
        tag("slack_channel", "#ops-alerts").alias("channel"), tag("jira_ticket", "N/A").alias("ticket"),
        tag("affected_system", "ServiceA").alias("affected_system"), "description", "confidence",
    )


def explore_incidents(found: DataFrame, query: str) -> DataFrame:
    """Incidents whose title or snippet contains any query word longer than two letters."""
    words = [w for w in query.lower().split() if len(w) > 2]
    if not words:
        return found
    snippet = F.coalesce(F.lower("description"), F.lit(""))
    return found.filter(text.contains_any(F.lower("title"), words) | text.contains_any(snippet, words))


def escalation_routes(workflows: DataFrame) -> DataFrame:
    """Triage route of each workflow: the recorded one, else a single 30-minute step."""
    route = F.get_json_object("metadata", "$.escalation_route")
    single = F.to_json(F.array(F.struct(
        F.lit(1).alias("step"), F.lit("Assignee").alias("role"), F.lit(30).alias("duration_minutes"),
        F.date_format("created_at", "yyyy-MM-dd'T'HH:mm:ss").alias("timestamp"),
    )))
    minutes = F.get_json_object("metadata", "$.total_triage_minutes").try_cast("int")
    return workflows.select(
        "workspace_id", "workflow_id", "title", F.col("workflow_type").alias("incident_type"), "priority",
        F.col("state").alias("current_state"),
        F.coalesce(F.when(~route.isin("", "[]"), route), single).alias("escalation_route"),
        F.coalesce(F.when(minutes != 0, minutes), F.lit(60)).alias("total_triage_minutes"),
        F.coalesce(F.get_json_object("metadata", "$.bottleneck_identified"),
                   F.lit("No clear bottleneck.")).alias("bottleneck_identified"),
    )


def report_timeline(events: DataFrame, as_of: Column, days: int = 7) -> DataFrame:
    recent = events.filter((F.col("ts") >= since(as_of, days)) & (F.col("ts") <= as_of))
    return recent.select(
        "workspace_id", F.col("event_id").alias("id"), "title", "event_type", "ts",
        F.coalesce("description", F.lit("")).alias("summary"), F.coalesce("severity", F.lit("medium")).alias("severity"),
    ).orderBy(F.asc_nulls_first("ts"), "id")
