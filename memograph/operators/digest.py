"""Per-workspace digests, pattern reports and text summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from memograph import vocab
from memograph.functions import text
from memograph.operators import patterns, timeline
from memograph.plans import timescan

HOUR_US = 3_600_000_000


def metrics(
    events: DataFrame, insights: DataFrame, workflows: DataFrame | None, as_of: Column, kind: str, hours: int = 24
) -> DataFrame:
    """One row of counts and its text line per workspace."""
    start = F.timestamp_micros(F.unix_micros(as_of) - hours * HOUR_US)
    parts = [
        events.filter((F.col("ts") >= start) & (F.col("ts") <= as_of)).groupBy("workspace_id").agg(
            F.count_if(F.col("event_type").isin("incident", "outage")).alias("incidents"),
            F.count_if(F.col("event_type") == "deployment").alias("deployments")),
        insights.filter((F.col("generated_at") >= start) & (F.col("generated_at") <= as_of)).groupBy("workspace_id").agg(
            F.count(F.lit(1)).alias("insights"),
            F.count_if(F.col("insight_type") == "anomaly").alias("anomalies")),
    ]
    if workflows is not None:
        active = workflows.filter(F.col("state").isin(vocab.WORKFLOW_ACTIVE_STATES))
        parts.append(active.groupBy("workspace_id").agg(
            F.count(F.lit(1)).alias("workflows"), F.count_if(F.col("state") == "blocked").alias("blocked")))
    out = parts[0]
    for part in parts[1:]:
        out = out.join(part, "workspace_id", "full")
    counts = [c for c in out.columns if c != "workspace_id"]
    for c in counts:
        out = out.withColumn(c, F.coalesce(c, F.lit(0)))
    for c in ("workflows", "blocked"):
        if c not in counts:
            out = out.withColumn(c, F.lit(0).cast("long"))
    label = F.lit(kind.replace("_", " ").title())
    return out.withColumn("text", F.concat(
        label, F.lit(" Digest: "), F.col("incidents"), F.lit(" incidents, "), F.col("deployments"),
        F.lit(" deploys, "), F.col("anomalies"), F.lit(" anomalies."),
    ))


def top_lists(events: DataFrame, insights: DataFrame, workflows: DataFrame, as_of: Column, hours: int = 24) -> DataFrame:
    """First 3 insights, 3 pending workflows and 5 events per workspace as rows (section, rank, line)."""
    start = F.timestamp_micros(F.unix_micros(as_of) - hours * HOUR_US)

    def top(rows: DataFrame, section: str, time: str, tie: str, line: Column, n: int) -> DataFrame:
        w = Window.partitionBy("workspace_id").orderBy(F.desc_nulls_last(time), F.asc(tie))
        return rows.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n).select(
            "workspace_id", F.lit(section).alias("section"), "rank", line.alias("line"))

    recent = events.filter((F.col("ts") >= start) & (F.col("ts") <= as_of))
    fresh = insights.filter((F.col("generated_at") >= start) & (F.col("generated_at") <= as_of))
    pending = workflows.filter(F.col("state").isin(vocab.WORKFLOW_ACTIVE_STATES))
    return (
        top(fresh, "insight", "generated_at", "title", F.concat(
            F.lit("["), F.upper("severity"), F.lit("] "), "title", F.lit(" (Confidence: "),
            F.format_string("%.2f", "confidence"), F.lit(")")), 3)
        .unionByName(top(pending, "workflow", "updated_at", "workflow_id", F.concat(
            F.lit("["), F.upper(F.replace("state", F.lit("_"), F.lit(" "))), F.lit("] "), F.upper("priority"),
            F.lit(": "), "title"), 3))
        .unionByName(top(recent, "event", "ts", "event_id", F.concat(
            F.date_format("ts", "yyyy-MM-dd HH:mm"), F.lit(" | "), F.upper("event_type"), F.lit(" | "), "title"), 5))
    )


def pattern_report(events: DataFrame, refs: DataFrame) -> DataFrame:
    """How many clusters, affected entities and deployment-issue pairs each workspace has."""
    def counted(rows: DataFrame, section: str) -> DataFrame:
        return rows.groupBy("workspace_id").agg(F.count(F.lit(1)).alias("n")).select(
            "workspace_id", F.lit(section).alias("section"), "n")

    # A sweep counts the issues within an hour of each deployment; no pairs are formed.
    deployments = events.filter(F.col("event_type") == "deployment")
    issues = events.filter(F.col("event_type").isin(vocab.ISSUE_TYPES))
    followed = timescan.count_following(deployments, issues, ["workspace_id"], "ts", HOUR_US, {"issues": F.lit(1)}).groupBy("workspace_id").agg(
        F.sum("issues").alias("n")).select("workspace_id", F.lit("deployment_incidents").alias("section"), "n")
    frequencies = patterns.incident_frequencies(events, refs).select("workspace_id", "name", "type").distinct()
    return (
        counted(timeline.temporal_clusters(events), "temporal_clusters")
        .unionByName(counted(frequencies, "incident_frequencies"))
        .unionByName(followed.filter("n > 0"))
    )


def histograms(events: DataFrame) -> DataFrame:
    """Counts per workspace by type and by severity in long form."""
    by_type = events.groupBy("workspace_id", F.col("event_type").alias("value")).agg(F.count(F.lit(1)).alias("n"))
    by_severity = events.filter(F.col("severity").isNotNull()).groupBy(
        "workspace_id", F.col("severity").alias("value")).agg(F.count(F.lit(1)).alias("n"))
    return by_type.withColumn("kind", F.lit("type")).unionByName(by_severity.withColumn("kind", F.lit("severity")))


def mean_confidence(events: DataFrame, insights: DataFrame) -> DataFrame:
    """Mean confidence over a workspace's events and insights, 0.8 where there is none."""
    values = events.select("workspace_id", "confidence").unionByName(insights.select("workspace_id", "confidence"))
    return values.groupBy("workspace_id").agg(F.round(F.coalesce(F.avg("confidence"), F.lit(0.8)), 2).alias("confidence"))


def report_lines(page: DataFrame, query: str) -> DataFrame:
    """Markdown report of a bounded timeline page, one text per workspace.

    The page comes from timeline(), whose limit bounds the rows of a workspace,
    so the lists built here are bounded as well.
    """
    stamp = F.coalesce(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), F.lit("N/A"))
    badge = F.coalesce(F.concat(F.lit(" ["), F.upper("severity"), F.lit("]")), F.lit(""))
    note = F.coalesce(F.concat(F.lit("\n  * "), "description"), F.lit(""))
    line = F.concat(F.lit("- **"), stamp, F.lit("** | **"), F.upper("event_type"), F.lit("**"), badge,
                    F.lit(" — *"), "title", F.lit("*"), note)
    order = F.struct(F.coalesce(F.unix_micros("ts"), F.lit(-(1 << 62))), -F.col("rank"))
    types = page.groupBy("workspace_id", "event_type").agg(F.count(F.lit(1)).alias("n"), F.max("rank").alias("at"))
    categories = types.groupBy("workspace_id").agg(F.array_sort(F.collect_list(
        F.struct("event_type", "n"))).alias("types"))
    body = page.groupBy("workspace_id").agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.col("severity") == "critical").alias("critical"),
        F.count_if(F.col("severity") == "high").alias("high"),
        F.array_sort(F.collect_list(F.struct(order.alias("o"), line.alias("line")))).alias("lines"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("entity_names")))).alias("names"),
    )
    summary = F.concat(
        F.lit("The analyzed timeline contains **"), F.col("total"), F.lit(" operational events** within this scope. "),
        F.lit("The primary categories detected were: "),
        F.array_join(F.transform("types", lambda t: F.concat(t["event_type"], F.lit(" ("), t["n"], F.lit(")"))), ", "),
        F.lit("."),
    )
    warning = F.when(
        (F.col("critical") > 0) | (F.col("high") > 0),
        F.concat(F.lit("⚠️ **Warning**: The timeline contains high-severity issues (critical: "), F.col("critical"),
                 F.lit(", high: "), F.col("high"), F.lit("). Immediate attention is required.")),
    ).otherwise("✅ **Status**: No critical or high-severity incidents detected in this window.")
    # Headings and sentences of the report.
    names = F.array_join(F.transform("names", lambda n: F.concat(F.lit("- "), n)), "\n")
    return body.join(categories, "workspace_id").select(
        "workspace_id",
        F.concat_ws(
            "\n",
            F.lit("# Operational Health Summary (Heuristic Fallback)"), F.lit(f"**Query**: {query}\n"),
            F.lit("## Executive Summary"), summary, warning,
            F.when(F.size("names") > 0, F.concat(F.lit("\n## Impacted System Entities\n"), names)),
            F.lit("\n## Chronological Log"),
            F.array_join(F.transform("lines", lambda l: l["line"]), "\n"),
        ).alias("report"),
    )


def postmortems(incidents: DataFrame, page: DataFrame, evidence: DataFrame, as_of: Column) -> DataFrame:
    """One Markdown postmortem per incident from its timeline page and numbered evidence texts (both bounded top lists).

    incidents: workspace_id, incident_id, title, summary; page: ts, title, summary; evidence:
    n, document, content. A citation shows the first 150 letters of its content, as the
    report defines.
    """
    # Headings and sentences of the report.
    keys = ["workspace_id", "incident_id"]
    event = F.concat(F.lit("*   **"), F.coalesce(F.date_format("ts", "yyyy-MM-dd"), F.lit("N/A")), F.lit("**: "), "title",
                     F.lit(" - "), F.coalesce("summary", F.lit("")), F.lit("\n"))
    steps = page.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(F.unix_micros("ts").alias("us"), event.alias("line")))).alias("steps"))
    cited = F.concat(F.lit("*   ["), "n", F.lit("] **"), F.coalesce(F.nullif("document", F.lit("")), F.lit("document")), F.lit('**: "'),
                     F.left("content", F.lit(150)), F.lit('..."\n'))
    proof = evidence.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("n", cited.alias("line")))).alias("proofs"))

    def lines(column: str, otherwise: str) -> Column:
        return F.coalesce(F.array_join(F.transform(column, lambda x: x["line"]), ""), F.lit(otherwise))

    return incidents.join(steps, keys, "left").join(proof, keys, "left").select(
        *keys,
        F.concat(
            F.lit("# Incident Postmortem: "), "title", F.lit("\n**Date Generated**: "), F.date_format(as_of, "yyyy-MM-dd"),
            F.lit("\n**Workspace**: "), "workspace_id", F.lit("\n\n## Executive Summary\n"), F.coalesce("summary", F.lit("")),
            F.lit("\n\n## Incident Timeline\n"), lines("steps", "No timeline events compiled."),
            F.lit("\n\n## Supporting Evidence\n"), lines("proofs", "No vector citations compiled.")).alias("document"))


def evidence_lines(events: DataFrame, insights: DataFrame, limit: int = 15) -> DataFrame:
    """At most 15 distinct evidence strings per workspace, in text order."""
    lines = events.filter(F.col("description").isNotNull()).select(
        "workspace_id", F.concat(F.lit("Event: "), "title", F.lit(" - "), "description").alias("line"))
    more = insights.select("workspace_id", F.concat(F.lit("Insight: "), "title", F.lit(" - "), "summary").alias("line"))
    proof = insights.select("workspace_id", F.explode("evidence").alias("line"))
    distinct = lines.unionByName(more).unionByName(proof).distinct()
    w = Window.partitionBy("workspace_id").orderBy("line")
    return distinct.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= limit)


def key_findings(insights: DataFrame) -> DataFrame:
    return insights.select(
        "workspace_id", F.concat(F.lit("["), F.upper("insight_type"), F.lit("] "), "title").alias("finding"), "insight_id")


