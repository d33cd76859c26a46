"""Supervised workflows as an event-sourced table of commands."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from memograph import vocab
from memograph.operators.patterns import since
from memograph.plans import timescan
from memograph.plans.timescan import micros

# Who takes over an escalated workflow.
ESCALATION_OWNERS = {"customer_escalation": "Head of Customer Relations"}
DEFAULT_OWNER = "Director of Engineering / Incident Commander"


def requested_state() -> Column:
    """State a command asks for: approving starts the work, escalating escalates, linking asks for none."""
    action = F.col("action")
    return F.when(action == "approve", "in_progress").when(action == "escalate", "escalated").when(
        action.isin("create", "update", "transition"), F.col("state"))


def transitions(commands: DataFrame) -> DataFrame:
    """State changes in order; asking for the current state logs nothing.

    `commands` carries workspace_id, workflow_id, seq, ts, action, state and notes.
    """
    asked = commands.withColumn("to_state", requested_state()).filter(F.col("to_state").isNotNull()).withColumn("us", micros("ts"))
    keys = ["workspace_id", "workflow_id"]
    ordered = timescan.carry_last(asked, keys, ["us", "seq"], "to_state", "us", cell_us=60_000_000)
    changed = F.col("previous_to_state").isNull() | (F.col("previous_to_state") != F.col("to_state"))
    notes = (
        F.when(F.col("previous_to_state").isNull(), "Workflow created.")
        .when(F.col("action") == "approve", F.concat(F.lit("Approved: "), F.coalesce("notes", F.lit(""))))
        .when(F.col("action").isin("update", "escalate"), "State updated via patch update.")
        .otherwise(F.coalesce(F.nullif("notes", F.lit("")), F.lit("State transitioned.")))
    )
    return ordered.filter(changed).select(
        *keys, "seq", "ts", F.col("previous_to_state").alias("from_state"), "to_state", notes.alias("notes"))


def owner_of(kind: Column) -> Column:
    """Who takes over an escalated workflow of this type."""
    owner = F.lit(DEFAULT_OWNER)
    for name, person in ESCALATION_OWNERS.items():
        owner = F.when(kind == name, person).otherwise(owner)
    return owner


def log(commands: DataFrame) -> DataFrame:
    """Changes of state and assignee and first links of each workflow: (keys, seq, us, kind, from_value, to_value)."""
    keys = ["workspace_id", "workflow_id"]
    person = F.when(F.col("action") == "escalate", owner_of(F.col("workflow_type"))).otherwise(F.col("assignee"))

    def changes(value: Column, kind: str) -> DataFrame:
        given = commands.select(*keys, "seq", micros("ts").alias("us"), value.alias("value")).filter("value IS NOT NULL")
        ordered = timescan.carry_last(given, keys, ["us", "seq"], "value", "us", cell_us=60_000_000)
        changed = ordered.filter(F.col("previous_value").isNull() | (F.col("previous_value") != F.col("value")))
        return changed.select(*keys, "seq", "us", F.lit(kind).alias("kind"), F.col("previous_value").alias("from_value"), F.col("value").alias("to_value"))

    links = commands.filter(F.col("related_event").isNotNull()).groupBy(*keys, "related_event").agg(
        F.min(F.struct(micros("ts").alias("us"), "seq")).alias("first"))
    return changes(requested_state(), "state").unionByName(changes(person, "assignee")).unionByName(links.select(
        *keys, "first.seq", "first.us", F.lit("link").alias("kind"), F.lit(None).cast("string").alias("from_value"), F.col("related_event").alias("to_value")))


def latest(commands: DataFrame) -> DataFrame:
    """Current row of every workflow: the last given value of each field."""
    order = F.struct("ts", "seq")
    state = requested_state()
    assignee = F.when(F.col("action") == "escalate", owner_of(F.col("workflow_type"))).otherwise(F.col("assignee"))

    def last_given(value: Column, name: str) -> Column:
        return F.max_by(value, F.when(value.isNotNull(), order)).alias(name)

    return commands.groupBy("workspace_id", "workflow_id", "workflow_type").agg(
        last_given(F.col("title"), "title"), last_given(state, "state"), last_given(F.col("priority"), "priority"),
        last_given(assignee, "assignee"), F.min("ts").alias("created_at"), F.max("ts").alias("updated_at"))


def linked_assets(commands: DataFrame, column: str = "related_event") -> DataFrame:
    """Distinct (workflow, asset) links; the set form of each workflow's asset list."""
    return commands.filter(F.col(column).isNotNull()).select("workspace_id", "workflow_id", column).distinct()


def filter_workflows(workflows: DataFrame, states: Sequence[str] | None = None, priorities: Sequence[str] | None = None) -> DataFrame:
    out = workflows
    if states:
        out = out.filter(F.col("state").isin(list(states)))
    if priorities:
        out = out.filter(F.col("priority").isin(list(priorities)))
    return out


def filter_insights(insights: DataFrame, types: Sequence[str] | None = None, severities: Sequence[str] | None = None) -> DataFrame:
    out = insights
    if types:
        out = out.filter(F.col("insight_type").isin(list(types)))
    if severities:
        out = out.filter(F.col("severity").isin(list(severities)))
    return out


def incident_workflows(incidents: DataFrame, insights: DataFrame, as_of: Column, per_workspace: int = 10) -> DataFrame:
    """A triage workflow per incident with the workspace's recent insights and advice.

    At most ten recent insights of a workspace are attached, as the feature
    defines, so the lists stay small and are joined by workspace.
    """
    recent = insights.filter((F.col("generated_at") >= since(as_of, 1)) & (F.col("generated_at") <= as_of))
    w = Window.partitionBy("workspace_id").orderBy(F.desc("generated_at"), "insight_id")
    ten = recent.withColumn("r", F.row_number().over(w)).filter(F.col("r") <= per_workspace)
    release = F.element_at(F.split("title", "'"), -2)
    advice = F.when(F.col("insight_type") == "deployment_instability", F.concat(
        F.lit("Consider rolling back the deployment release: '"),
        F.when(F.contains("title", F.lit("'")), release).otherwise(F.lit("recent release")), F.lit("'.")))
    related = F.when(F.col("insight_type").isin("deployment_instability", "recurring_bottleneck"), F.col("insight_id"))
    # collect_list drops the nulls of other insight types.
    per = ten.groupBy("workspace_id").agg(
        F.transform(F.array_sort(F.collect_list(F.when(related.isNotNull(), F.struct("r", related.alias("id"))))), lambda x: x["id"]).alias("related_insights"),
        F.transform(F.array_sort(F.collect_list(F.when(advice.isNotNull(), F.struct("r", advice.alias("a"))))), lambda x: x["a"]).alias("advice"))
    empty = F.array().cast("array<string>")
    urgent = F.coalesce(F.col("severity") == "high", F.lit(False)) | (F.col("event_type") == "outage")
    return incidents.join(per, "workspace_id", "left").select(
        "workspace_id", F.md5(F.concat_ws("|", F.lit("triage"), "workspace_id", "event_id")).alias("workflow_id"),
        F.concat(F.lit("Incident Response: Triage for '"), "title", F.lit("'")).alias("title"),
        F.lit("incident_response").alias("workflow_type"), F.lit("pending_review").alias("state"),
        F.when(urgent, "high").otherwise("medium").alias("priority"), F.lit("DevOps On-Call Team").alias("assignee"),
        F.col("event_id").alias("related_event"), F.coalesce("related_insights", empty).alias("related_insights"),
        F.concat(F.array(F.lit("Investigate recent CPU utilization and saturated connection pool metrics.")),
                 F.coalesce("advice", empty)).alias("recommendations"))


def customer_escalations(insights: DataFrame) -> DataFrame:
    """A workflow per support spike."""
    # Title, assignee and advice of the escalation.
    return insights.filter(F.col("insight_type") == "support_spike").select(
        "workspace_id", F.md5(F.concat_ws("|", F.lit("escalation"), "workspace_id", "insight_id")).alias("workflow_id"),
        F.concat(F.lit("Customer Escalation: "), "title").alias("title"), F.lit("customer_escalation").alias("workflow_type"),
        F.lit("pending_review").alias("state"), F.when(F.col("severity") == "high", "high").otherwise("medium").alias("priority"),
        F.lit("Customer Support Lead Tier-2").alias("assignee"), F.col("insight_id").alias("related_insight"),
        F.array(F.lit("Draft response to high-priority customer contacts regarding system issues."),
                F.lit("Coordinate with Platform Engineering regarding PostgreSQL connection saturation.")).alias("recommendations"))


def alerts(workflows: DataFrame) -> DataFrame:
    """Message of a changed workflow and one address row per person it is assigned to.

    `assignees` is an array of structs (name, type); without a person the address is null.
    """
    names = F.when(F.size("assignees") > 0, F.array_join(F.transform("assignees", lambda a: F.coalesce(a["name"], F.lit("Unknown"))), ", ")
                   ).otherwise("Unassigned")
    message = F.concat(
        F.lit("Workflow Alert in workspace '"), "workspace_id", F.lit("': '"), "title", F.lit("' has been moved to "),
        F.upper("state"), F.lit(" (Priority: "), F.upper("priority"), F.lit("). Assigned to: "), names, F.lit("."))
    people = F.filter("assignees", lambda a: a["type"] == "person")
    address = F.concat(F.replace(F.lower(F.coalesce("person.name", F.lit("user"))), F.lit(" "), F.lit(".")), F.lit("@company.internal"))
    return workflows.withColumns({"message": message, "person": F.explode_outer(people)}).select(
        "workspace_id", "workflow_id", "message", F.when(F.col("person").isNotNull(), address).alias("address"),
        F.concat(F.lit("[Workflow Update] "), "title", F.lit(" -> "), F.upper("state")).alias("subject"))


def active(workflows: DataFrame) -> DataFrame:
    return workflows.filter(F.col("state").isin(vocab.WORKFLOW_ACTIVE_STATES))
