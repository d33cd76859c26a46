"""Statistical detectors; each returns insight rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from memograph import vocab
from memograph.operators.patterns import DAY_US, since
from memograph.plans import timescan
from memograph.plans.rangejoin import follow_join

WS = ["workspace_id"]
HISTORY_DAYS = 30
INSIGHT_COLUMNS = [
    "workspace_id", "insight_id", "title", "summary", "insight_type", "confidence", "severity", "evidence",
    "generated_at",
]


def daily_counts(events: DataFrame, as_of: Column, days: int = HISTORY_DAYS) -> DataFrame:
    """Counts per workspace, type and day offset (0 = the day of as_of), zero days included."""
    recent = events.filter((F.col("ts") >= since(as_of, days)) & (F.col("ts") <= as_of))
    offset = F.date_diff(as_of.cast("date"), F.col("ts").cast("date"))
    counted = recent.groupBy("workspace_id", "event_type", offset.alias("day_offset")).agg(F.count(F.lit(1)).alias("n"))
    # One row per day exists at most, so a type's history is a map of at most `days` + 1 entries.
    history = counted.groupBy("workspace_id", "event_type").agg(
        F.map_from_entries(F.collect_list(F.struct("day_offset", "n"))).alias("by_day")
    )
    return history.select(
        "workspace_id", "event_type", "by_day", F.explode(F.sequence(F.lit(0), F.lit(days - 1))).alias("day_offset")
    ).select(
        "workspace_id", "event_type", "day_offset",
        F.coalesce(F.try_element_at("by_day", F.col("day_offset")), F.lit(0)).alias("n"),
    )


def spike_statistics(daily: DataFrame, window_days: int = 7) -> DataFrame:
    """Baseline mean and deviation against the target mean.

    The target holds offsets 0..window_days inclusive: a day exactly
    window_days back is not older than the boundary instant.
    """
    target = F.col("day_offset") <= window_days
    base = F.when(~target, F.col("n"))
    stats = daily.groupBy("workspace_id", "event_type").agg(
        F.avg(base).alias("baseline_mean"), F.stddev_pop(base).alias("baseline_std"),
        F.avg(F.when(target, F.col("n"))).alias("target_mean"),
    )
    z = (F.col("target_mean") - F.col("baseline_mean")) / F.col("baseline_std")
    return stats.withColumn("z_score", F.when(F.col("baseline_std") > 0, z))


def volume_spikes(events: DataFrame, as_of: Column, window_days: int = 7) -> DataFrame:
    stats = spike_statistics(daily_counts(events, as_of), window_days)
    varied = (F.col("baseline_std") > 0) & (F.col("z_score") >= 2.0) & (F.col("target_mean") > 0.5)
    steady = (
        (F.col("baseline_std") == 0) & (F.col("target_mean") > F.col("baseline_mean") * 3)
        & (F.col("target_mean") >= 1.5)
    )
    means = [F.format_string("%.2f", "target_mean"), F.lit(" vs. "), F.format_string("%.2f", "baseline_mean"),
             F.lit(" daily)")]
    reason = F.when(
        F.col("baseline_std") > 0,
        F.concat(F.lit("rolling average is "), F.format_string("%.1f", "z_score"),
                 F.lit(" standard deviations above historical baseline ("), *means),
    ).otherwise(
        F.concat(F.lit("rolling average increased "),
                 F.format_string("%.1f", F.col("target_mean") / F.greatest("baseline_mean", F.lit(0.1))),
                 F.lit("x over baseline ("), *means)
    )
    title = F.concat(F.lit("Abnormal volume spike in "), "event_type", F.lit(" events"))
    return stats.filter(varied | steady).select(
        "workspace_id",
        F.md5(F.concat_ws("|", "workspace_id", F.lit("spike"), "event_type")).alias("insight_id"),
        title.alias("title"),
        F.concat(F.lit("The system detected an abnormal increase in '"), "event_type", F.lit("' events. The current "),
                 reason, F.lit(".")).alias("summary"),
        F.when(F.col("event_type").isin(vocab.SUPPORT_TYPES), "support_spike").otherwise("anomaly").alias("insight_type"),
        F.lit(0.85).alias("confidence"),
        F.when(F.col("event_type").isin(vocab.SPIKE_HIGH_TYPES), "high").otherwise("medium").alias("severity"),
        F.array(
            F.concat(F.lit("Baseline daily rate: "), F.format_string("%.2f", "baseline_mean")),
            F.concat(F.lit("Target window daily rate: "), F.format_string("%.2f", "target_mean")),
        ).alias("evidence"),
        as_of.alias("generated_at"), "event_type",
        F.round("baseline_mean", 6).alias("baseline_mean"), F.round("target_mean", 6).alias("target_mean"),
        F.round("z_score", 6).alias("z_score"),
    )


def spike_events(spikes: DataFrame, events: DataFrame, as_of: Column, window_days: int = 7) -> DataFrame:
    """Long form of a spike's supporting events."""
    target = events.filter((F.col("ts") >= since(as_of, window_days)) & (F.col("ts") <= as_of))
    keys = spikes.filter(F.col("event_type").isNotNull()).select("workspace_id", "event_type", "insight_id")
    return target.join(keys, ["workspace_id", "event_type"]).select("workspace_id", "insight_id", "event_id", "chunk_id")


def supporting_entities(supporting: DataFrame, refs: DataFrame) -> DataFrame:
    """Distinct entities behind the chunks of each insight's supporting events."""
    chunks = supporting.select("workspace_id", "insight_id", "chunk_id").distinct()
    return chunks.join(refs, ["workspace_id", "chunk_id"]).select("workspace_id", "insight_id", "name", "type").distinct()


def deployment_instability(events: DataFrame, as_of: Column, days: int = 7) -> DataFrame:
    """Deployments of the last days followed by two or more issues within two hours."""
    recent = events.filter((F.col("ts") >= since(as_of, days)) & (F.col("ts") <= as_of))
    deployments = recent.filter(F.col("event_type") == "deployment")
    issues = recent.filter(F.col("event_type").isin(vocab.ISSUE_TYPES))
    worst = (F.col("event_type") == "outage") | F.coalesce(F.col("severity") == "critical", F.lit(False))
    counted = timescan.count_following(
        deployments, issues, WS, "ts", 7_200_000_000,
        {"issue_count": F.lit(1), "worst_count": worst.cast("int")},
    )
    return counted.filter(F.col("issue_count") >= 2).select(
        "workspace_id",
        F.md5(F.concat_ws("|", "workspace_id", F.lit("instability"), "event_id")).alias("insight_id"),
        F.concat(F.lit("Deployment instability detected following release '"), "title", F.lit("'")).alias("title"),
        F.concat(
            F.lit("Deployment '"), "title", F.lit("' was followed by "), F.col("issue_count"),
            F.lit(" incident events within a 2-hour window, indicating potential release regression or DB saturation."),
        ).alias("summary"),
        F.lit("deployment_instability").alias("insight_type"), F.lit(0.9).alias("confidence"),
        F.when(F.col("worst_count") > 0, "critical").otherwise("high").alias("severity"),
        F.array(
            F.concat(F.lit("Deployment timestamp: "), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")),
            F.concat(F.lit("Subsequent incidents count: "), F.col("issue_count")),
        ).alias("evidence"),
        as_of.alias("generated_at"), F.col("event_id").alias("deployment_id"), "issue_count",
    )


def instability_events(unstable: DataFrame, events: DataFrame, as_of: Column, days: int = 7) -> DataFrame:
    """Long form of an unstable deployment's supporting events: itself and its issues."""
    recent = events.filter((F.col("ts") >= since(as_of, days)) & (F.col("ts") <= as_of))
    keys = unstable.select("workspace_id", "insight_id", F.col("deployment_id").alias("event_id"))
    deployments = recent.join(keys, ["workspace_id", "event_id"]).select(
        "workspace_id", "insight_id", F.col("ts").alias("deployed_at"), "event_id", "chunk_id"
    )
    issues = recent.filter(F.col("event_type").isin(vocab.ISSUE_TYPES)).select("workspace_id", "event_id", "ts", "chunk_id")
    linked = follow_join(
        deployments.select("workspace_id", "insight_id", "deployed_at"), issues, WS, "deployed_at", "ts", 7_200_000_000
    )
    columns = ["workspace_id", "insight_id", "event_id", "chunk_id"]
    return deployments.select(*columns).unionByName(linked.select(*columns))


def deciding_issues(events: DataFrame, refs: DataFrame, as_of: Column, days: int = 7, width_us: int = 7_200_000_000) -> DataFrame:
    """The events of the last days, of the issues only those that decide which entities a span of the given width reaches.

    Time is cut into cells of that width. A span that begins in one cell ends in the next, so
    it meets an entity exactly if the entity's last issue of the first cell or its first
    issue of the next lies in it. An entity keeps these two a cell, however many issues there are.
    """
    columns = ["workspace_id", "chunk_id", "ts", "event_id", "event_type"]
    recent = events.filter((F.col("ts") >= since(as_of, days)) & (F.col("ts") <= as_of)).select(*columns)
    issue = F.coalesce(F.col("event_type").isin(vocab.ISSUE_TYPES), F.lit(False))
    place = F.struct("ts", "event_id", "event_type")
    # A chunk's first and last issue of a cell stand for it before its entities are looked up.
    per_chunk = recent.filter(issue).groupBy("workspace_id", "chunk_id", timescan.cell_of(timescan.micros("ts"), width_us).alias("cell")).agg(
        F.min(place).alias("first"), F.max(place).alias("last"))
    per_name = per_chunk.join(refs, ["workspace_id", "chunk_id"]).groupBy("workspace_id", "name", "type", "cell").agg(
        F.min(F.struct("first", "chunk_id")).alias("first"), F.max(F.struct("last", "chunk_id")).alias("last"))
    ends = F.array(*[F.struct(F.col(f"{end}.chunk_id").alias("chunk_id"), F.col(f"{end}.{end}").alias("event")) for end in ("first", "last")])
    kept = per_name.select("workspace_id", F.explode(ends).alias("e")).select("workspace_id", "e.chunk_id", "e.event.*").distinct()
    return recent.filter(~issue).unionByName(kept.select(*columns))


def recurring_bottlenecks(events: DataFrame, refs: DataFrame, as_of: Column, days: int = 14) -> DataFrame:
    """Entities behind two or more issue events of the last days, in workspaces with two or more events.

    Counts are formed per chunk before the join with entity mentions; the titles
    shown in the summary are the first three by (time, id), found by a group
    limit before any list is built.
    """
    recent = events.filter((F.col("ts") >= since(as_of, days)) & (F.col("ts") <= as_of))
    busy = recent.groupBy("workspace_id").agg(F.count(F.lit(1)).alias("scope_events")).filter("scope_events >= 2")
    issues = recent.filter(F.col("event_type").isin(vocab.BOTTLENECK_TYPES))
    per_chunk = issues.groupBy("workspace_id", "chunk_id").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("event_type") == "outage").alias("outages")
    )
    counted = (
        per_chunk.join(refs, ["workspace_id", "chunk_id"])
        .groupBy("workspace_id", "name", "type")
        .agg(F.sum("n").alias("issue_count"), F.sum("outages").alias("outage_count"))
        .filter(F.col("issue_count") >= 2)
        .join(busy.select("workspace_id"), ["workspace_id"], "left_semi")
    )
    # An entity's first three events are among the first three of its chunks, so a crowded chunk sends three rows.
    in_chunk = Window.partitionBy("workspace_id", "chunk_id").orderBy("ts", "event_id")
    heads = issues.select("workspace_id", "chunk_id", "ts", "event_id", "title").withColumn(
        "rank", F.row_number().over(in_chunk)).filter(F.col("rank") <= 3).drop("rank")
    order = Window.partitionBy("workspace_id", "name", "type").orderBy("ts", "event_id")
    shown = (
        heads.join(refs, ["workspace_id", "chunk_id"])
        .withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= 3)
        .groupBy("workspace_id", "name", "type")
        .agg(F.array_sort(F.collect_list(F.struct("rank", "title"))).alias("top"))
    )
    titles = F.array_join(F.transform("top", lambda t: F.concat(F.lit("'"), t["title"], F.lit("'"))), ", ")
    return counted.join(shown, ["workspace_id", "name", "type"]).select(
        "workspace_id",
        F.md5(F.concat_ws("|", "workspace_id", F.lit("bottleneck"), "type", F.lower("name"))).alias("insight_id"),
        F.concat(F.lit("Recurring operational bottleneck detected on "), "name").alias("title"),
        F.concat(
            F.lit("Entity '"), "name", F.lit("' ("), "type", F.lit(") was associated with "), F.col("issue_count"),
            F.lit(" operational issue events in the last 14 days, including: "), titles, F.lit("."),
        ).alias("summary"),
        F.lit("recurring_bottleneck").alias("insight_type"), F.lit(0.8).alias("confidence"),
        F.when(F.col("outage_count") > 0, "high").otherwise("medium").alias("severity"),
        F.array(F.concat(F.lit("Linked issue events count: "), F.col("issue_count"))).alias("evidence"),
        as_of.alias("generated_at"), "name", "type", "issue_count",
    )


def run_detection(events: DataFrame, as_of: Column) -> DataFrame:
    """Spikes and instabilities as one insight table, newest per (title, type, workspace)."""
    from memograph.operators.upsert import upsert_insights

    found = volume_spikes(events, as_of).select(*INSIGHT_COLUMNS).unionByName(
        deployment_instability(events, as_of).select(*INSIGHT_COLUMNS)
    )
    return upsert_insights(found)


def all_insights(events: DataFrame, refs: DataFrame, as_of: Column) -> DataFrame:
    """Every detector's insights in one keyed table."""
    from memograph.operators.upsert import upsert_insights

    found = (
        volume_spikes(events, as_of).select(*INSIGHT_COLUMNS)
        .unionByName(deployment_instability(events, as_of).select(*INSIGHT_COLUMNS))
        .unionByName(recurring_bottlenecks(events, refs, as_of).select(*INSIGHT_COLUMNS))
    )
    return upsert_insights(found)
