"""Pattern detectors over operational events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from memograph import vocab
from memograph.functions import scoring, text
from memograph.plans import timescan
from memograph.plans.rangejoin import follow_join
from memograph.plans.ranking import with_rank
from memograph.plans.timescan import micros

WS = ["workspace_id"]
MINUTE_US = 60_000_000
CHAIN_MINUTES = 60
DAY_US = 86_400_000_000


def since(as_of: Column, days: int) -> Column:
    return F.timestamp_micros(F.unix_micros(as_of) - days * DAY_US)


def incident_frequencies(events: DataFrame, refs: DataFrame) -> DataFrame:
    """Issue events per linked entity and type.

    Issues are counted per chunk first, so an entity's rows are chunk counts
    and not single events when they meet in the join.
    """
    per_chunk = (
        events.filter(F.col("event_type").isin(vocab.ISSUE_TYPES))
        .groupBy("workspace_id", "chunk_id", "event_type").agg(F.count(F.lit(1)).alias("n"))
    )
    return (
        per_chunk.join(refs, ["workspace_id", "chunk_id"])
        .groupBy("workspace_id", "name", "type", "event_type")
        .agg(F.sum("n").alias("n"))
    )


def frequency_breakdown(frequencies: DataFrame) -> DataFrame:
    """Total per entity and its sorted type:count breakdown (at most one entry per type)."""
    return frequencies.groupBy("workspace_id", "name", "type").agg(
        F.sum("n").alias("incident_count"),
        F.array_join(
            F.array_sort(F.collect_list(F.concat("event_type", F.lit(":"), F.col("n")))), ","
        ).alias("breakdown"),
    )


def ranked_frequencies(breakdown: DataFrame) -> DataFrame:
    """Entities with their place by number of issues over all workspaces, the most first; ties by workspace, name and type."""
    return with_rank(breakdown, [F.desc("incident_count"), F.col("workspace_id"), F.col("name"), F.col("type")])


def deployment_incidents(events: DataFrame, minutes: float = 60.0) -> DataFrame:
    """Every issue within the threshold after a deployment of the same workspace."""
    deployments = events.filter(F.col("event_type") == "deployment").select(
        "workspace_id", F.col("event_id").alias("deployment_id"), F.col("ts").alias("deployed_at"),
        F.col("title").alias("deployment_title"),
    )
    issues = events.filter(F.col("event_type").isin(vocab.ISSUE_TYPES)).select(
        "workspace_id", F.col("event_id").alias("incident_id"), F.col("ts").alias("occurred_at"),
        F.col("title").alias("incident_title"), "event_type", "severity",
    )
    pairs = follow_join(deployments, issues, WS, "deployed_at", "occurred_at", int(minutes * MINUTE_US))
    delay = (micros("occurred_at") - micros("deployed_at")) / F.lit(1_000_000.0)
    return pairs.withColumn("delay_seconds", delay).withColumn("delay_text", text.clock_delay(F.col("delay_seconds")))


def recurring_incidents(events: DataFrame, as_of: Column, days: int = 7) -> DataFrame:
    """Entities with two or more incidents or escalations in the last days."""
    recent = events.filter(
        F.col("event_type").isin(vocab.RECURRING_TYPES) & (F.col("ts") >= since(as_of, days)) & (F.col("ts") <= as_of)
    )
    named = recent.select("workspace_id", F.explode(F.array_distinct(text.without_generic(F.col("entities")))).alias("entity"))
    counted = named.groupBy("workspace_id", "entity").agg(F.count(F.lit(1)).alias("event_count"))
    return counted.filter(F.col("event_count") >= 2).select(
        "workspace_id",
        F.concat(F.lit("pattern_recurring_"), text.slug(F.col("entity"))).alias("pattern_id"),
        F.lit("recurring_incident").alias("pattern_type"),
        F.concat(F.lit("Recurring incident sequence involving "), "entity").alias("name"),
        F.concat(
            F.lit("Detected "), F.col("event_count"), F.lit(" incidents/escalations involving the entity '"), "entity",
            F.lit("' in the last 7 days. This points to potential system instability."),
        ).alias("description"),
        F.when(F.col("event_count") > 3, "high").otherwise("medium").alias("severity"),
        scoring.pattern_confidence(F.col("event_count")).alias("confidence"),
        F.array("entity").alias("entities"),
        "event_count",
    )


def pattern_events(patterns: DataFrame, events: DataFrame, as_of: Column, days: int = 7) -> DataFrame:
    """Long form of a recurring pattern's related events."""
    recent = events.filter(
        F.col("event_type").isin(vocab.RECURRING_TYPES) & (F.col("ts") >= since(as_of, days)) & (F.col("ts") <= as_of)
    ).select("workspace_id", "event_id", F.explode(F.array_distinct("entities")).alias("entity"))
    keyed = patterns.select("workspace_id", "pattern_id", F.element_at("entities", 1).alias("entity"))
    return recent.join(keyed, ["workspace_id", "entity"]).select("workspace_id", "pattern_id", "event_id")


def chain_deployments(events: DataFrame) -> DataFrame:
    """The end that a chain starts from. Generic names are left out once an event, not once a pair."""
    return events.filter(F.col("event_type") == "deployment").select(
        "workspace_id", F.col("event_id").alias("deployment_id"), F.col("ts").alias("deployed_at"),
        F.col("title").alias("deployment_title"), text.without_generic(F.col("entities")).alias("deployment_entities"),
    )


def chain_issues(events: DataFrame) -> DataFrame:
    """The end that a chain leads to: issue and discussion events."""
    return events.filter(F.col("event_type").isin(vocab.CHAIN_TYPES)).select(
        "workspace_id", "event_id", "ts", "title", text.without_generic(F.col("entities")).alias("entities"))


def join_chains(deployments: DataFrame, issues: DataFrame, minutes: int = CHAIN_MINUTES, dealt: tuple[str, ...] = ()) -> DataFrame:
    """Pairs of the two ends up to an hour apart, with both titles and their joint entities.

    Ends meet within equal values of the `dealt` columns only, which are kept.
    """
    pairs = follow_join(deployments, issues, [*WS, *dealt], "deployed_at", "ts", minutes * MINUTE_US)
    # No null is left in the lists, so the plain sort does what array_sort does with a comparison a pair of names.
    joint = F.sort_array(F.array_union("entities", "deployment_entities"))
    return pairs.select("workspace_id", "deployment_id", "event_id", "deployment_title", "title", joint.alias("entities"), *dealt)


def chain_pairs(events: DataFrame, minutes: int = CHAIN_MINUTES, issues: DataFrame | None = None) -> DataFrame:
    """Issue or discussion events up to an hour after a deployment; see `join_chains`.

    Deployments come from events, and so do the issues unless they are given. The pairs grow with the square of the events.
    """
    return join_chains(chain_deployments(events), chain_issues(events if issues is None else issues), minutes)


def chain_patterns(pairs: DataFrame) -> DataFrame:
    """The pattern of each pair of `chain_pairs`."""
    return pairs.select(
        "workspace_id",
        F.concat(F.lit("pattern_chain_"), "deployment_id", F.lit("_"), "event_id").alias("pattern_id"),
        F.lit("escalation_chain").alias("pattern_type"),
        F.lit("Escalation chain following deployment").alias("name"),
        F.concat(
            F.lit("Incident/Escalation '"), "title", F.lit("' was triggered shortly after '"), "deployment_title",
            F.lit("'. Temporal spacing: less than 60 minutes."),
        ).alias("description"),
        F.lit("high").alias("severity"), F.lit(0.85).alias("confidence"),
        "entities", "deployment_id", "event_id",
    )


def escalation_chains(events: DataFrame, minutes: int = CHAIN_MINUTES, issues: DataFrame | None = None) -> DataFrame:
    """The patterns of all pairs of a deployment and an event of the hour after it; see `chain_pairs`."""
    return chain_patterns(chain_pairs(events, minutes, issues))


def frequency_spikes(events: DataFrame, as_of: Column) -> DataFrame:
    """Types whose last 24 hours reach 3 events and 2.5 times the prior week's daily mean."""
    scope = events.filter(
        (F.col("ts") >= since(as_of, 8)) & (F.col("ts") <= as_of) & (F.col("event_type") != "discussion")
    )
    last_day = F.col("ts") >= since(as_of, 1)
    counts = scope.groupBy("workspace_id", "event_type").agg(
        F.count_if(last_day).alias("count_24h"), F.count_if(~last_day).alias("count_baseline")
    ).withColumn("daily_mean", F.col("count_baseline") / 7.0)
    spike = (F.col("count_24h") >= 3) & (
        (F.col("daily_mean") == 0) | (F.col("count_24h") >= 2.5 * F.col("daily_mean"))
    )
    return counts.filter(spike).select(
        "workspace_id",
        F.concat(F.lit("pattern_spike_"), "event_type").alias("pattern_id"),
        F.lit("frequency_spike").alias("pattern_type"),
        F.concat(F.lit("Spike in "), "event_type", F.lit(" frequency")).alias("name"),
        F.concat(
            F.lit("Surge in operational events of type '"), "event_type", F.lit("' detected: "), F.col("count_24h"),
            F.lit(" events in the last 24 hours, compared to a baseline average of "),
            F.format_string("%.1f", "daily_mean"), F.lit(" per day."),
        ).alias("description"),
        F.lit("medium").alias("severity"), F.lit(0.80).alias("confidence"),
        F.array().cast("array<string>").alias("entities"),
        "event_type", "count_24h", "daily_mean",
    )


def rolling_incidents(events: DataFrame, days: int = 7) -> DataFrame:
    """For each incident or escalation, how many of its entity fell in the days up to it."""
    named = events.filter(F.col("event_type").isin(vocab.RECURRING_TYPES) & F.col("ts").isNotNull()).select(
        "workspace_id", "event_id", "ts",
        F.explode(F.array_distinct(text.without_generic(F.col("entities")))).alias("entity"),
    )
    keys = ["workspace_id", "entity"]
    counts = timescan.ending_at_counts(named, keys, "ts", days * DAY_US)
    return named.withColumn("us", micros("ts")).join(counts, [*keys, "us"]).withColumnRenamed("n", "incidents_7d")


def filter_patterns(
    patterns: DataFrame, min_confidence: float = 0.0, pattern_type: str | None = None, query: str | None = None
) -> DataFrame:
    """Patterns by confidence and type, then by text in name, description or an entity."""
    out = patterns.filter(F.col("confidence") >= min_confidence)
    if pattern_type:
        out = out.filter(F.col("pattern_type") == pattern_type)
    if query:
        q = F.lit(query.lower())
        out = out.filter(
            F.contains(F.lower("name"), q) | F.contains(F.lower("description"), q)
            | F.exists("entities", lambda e: F.contains(F.lower(e), q))
        )
    return out


def all_patterns(events: DataFrame, as_of: Column) -> DataFrame:
    """The three detectors as one table keyed by (workspace_id, pattern_id)."""
    columns = ["workspace_id", "pattern_id", "pattern_type", "name", "description", "severity", "confidence", "entities"]
    return (
        recurring_incidents(events, as_of).select(*columns)
        .unionByName(escalation_chains(events).select(*columns))
        .unionByName(frequency_spikes(events, as_of).select(*columns))
        .withColumn("last_detected", as_of)
    )
