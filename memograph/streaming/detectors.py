"""Streaming twins of the event detectors."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

from memograph import vocab
from memograph.functions import text
from memograph.operators.entities import pairs_of

HOUR_US = 3_600_000_000


def deduplicate(raw: DataFrame, delay: str = "1 day") -> DataFrame:
    """Each webhook id once within the watermark."""
    return raw.withWatermark("received_at", delay).dropDuplicatesWithinWatermark(["webhook_event_id"])


def cooccurrence(chunks: DataFrame) -> DataFrame:
    """Running pair counts; run it in update or complete mode."""
    pairs = chunks.select("workspace_id", "ts", F.explode(pairs_of(F.col("entities"))).alias("p"))
    return pairs.groupBy("workspace_id", "p.entity_a", "p.entity_b").agg(
        F.count(F.lit(1)).cast("double").alias("score"), F.max("ts").alias("last_seen"))


def deployment_incidents(events: DataFrame, minutes: int = 60, delay: str = "2 hours") -> DataFrame:
    """Stream-stream join of deployments with the issues that follow within the threshold.

    The delay must exceed the threshold, or matches are dropped with the state.
    The time bin is part of the join key, so a busy workspace spreads over tasks.
    """
    width = minutes * 60_000_000
    bin_us = max(width // 4, 1)
    deployments = events.filter("event_type = 'deployment'").select(
        F.col("workspace_id").alias("d_ws"), F.col("event_id").alias("deployment_id"), F.col("ts").alias("deployed_at")
    ).withWatermark("deployed_at", delay).withColumn("d_bin", F.explode(F.sequence(
        F.floor(F.unix_micros("deployed_at") / bin_us), F.floor((F.unix_micros("deployed_at") + width) / bin_us))))
    issues = events.filter(F.col("event_type").isin(vocab.ISSUE_TYPES)).select(
        "workspace_id", F.col("event_id").alias("incident_id"), F.col("ts").alias("occurred_at"), "event_type"
    ).withWatermark("occurred_at", delay).withColumn("i_bin", F.floor(F.unix_micros("occurred_at") / bin_us))
    joined = deployments.join(issues, F.expr(
        f"d_ws = workspace_id AND d_bin = i_bin AND occurred_at >= deployed_at AND occurred_at <= deployed_at + INTERVAL {minutes} MINUTES"))
    return joined.select(
        "workspace_id", "deployment_id", "incident_id", "event_type",
        ((F.unix_micros("occurred_at") - F.unix_micros("deployed_at")) / F.lit(1_000_000.0)).alias("delay_seconds"))


def activity_sessions(events: DataFrame, gap: str = "2 hours", delay: str = "1 hour") -> DataFrame:
    """Runs of activity per workspace closed by a gap; single events are dropped.

    The runner switches on merging inside each task, so a busy workspace ships few rows.
    """
    sessions = events.withWatermark("ts", delay).groupBy("workspace_id", F.session_window("ts", gap).alias("w")).agg(
        F.count(F.lit(1)).alias("event_count"), F.min("ts").alias("start_time"), F.max("ts").alias("end_time"))
    return sessions.filter("event_count >= 2").drop("w")


def recurring_windows(events: DataFrame, delay: str = "1 day", slide: str = "1 day") -> DataFrame:
    """Sliding 7-day incident and escalation counts per entity, kept at two or more."""
    named = events.filter(F.col("event_type").isin(vocab.RECURRING_TYPES)).select(
        "workspace_id", "ts", F.explode(F.array_distinct(text.without_generic(F.col("entities")))).alias("entity"))
    counts = named.withWatermark("ts", delay).groupBy("workspace_id", "entity", F.window("ts", "7 days", slide).alias("w")).agg(
        F.count(F.lit(1)).alias("event_count"))
    return counts.filter("event_count >= 2").select("workspace_id", "entity", F.col("w.end").alias("window_end"), "event_count")


def hourly_counts(rows: DataFrame, keys: list[str], delay: str = "1 hour") -> DataFrame:
    """Counts per key and hour in append mode: an hour is written once, when the watermark has passed its end.

    Event time alone decides, so the rows do not depend on how the input is cut into
    batches, a silent key is closed like any other, and counts combine before the shuffle.
    """
    counted = rows.withWatermark("ts", delay).groupBy(*keys, F.window("ts", "1 hour").alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return counted.select(*keys, F.floor(F.unix_micros("w.start") / HOUR_US).alias("hour"), "n")


def frequency_hours(events: DataFrame) -> DataFrame:
    """Closed hours of each workspace and type; read them with spikes_by_hour."""
    return hourly_counts(events.filter("event_type <> 'discussion'"), ["workspace_id", "event_type"])


def spikes_by_hour(hours: DataFrame) -> DataFrame:
    """Every closed hour at which the last 24 hours surge over the week before them.

    One row per key and hour comes in, so a key's window is bounded by the hours it covers.
    """
    w = Window.partitionBy("workspace_id", "event_type").orderBy("hour")
    day, span = F.sum("n").over(w.rangeBetween(-23, 0)), F.sum("n").over(w.rangeBetween(-191, 0))
    judged = hours.withColumns({"count_24h": day, "daily_mean": (span - day) / 7.0})
    return judged.filter((F.col("count_24h") >= 3) & (F.col("count_24h") >= 2.5 * F.col("daily_mean"))).select(
        "workspace_id", "event_type", "hour", "count_24h", "daily_mean")


def recurring_hours(events: DataFrame) -> DataFrame:
    """Closed hours of each entity's incidents; read them with recurring_by_hour."""
    named = events.filter(F.col("event_type").isin(vocab.RECURRING_TYPES)).select(
        "workspace_id", "ts", F.explode(F.array_distinct(text.without_generic(F.col("entities")))).alias("entity"))
    return hourly_counts(named, ["workspace_id", "entity"])


def recurring_by_hour(hours: DataFrame) -> DataFrame:
    """Every closed hour at which an entity has two or more incidents within the last 168 hours."""
    w = Window.partitionBy("workspace_id", "entity").orderBy("hour").rangeBetween(-167, 0)
    return hours.withColumn("event_count", F.sum("n").over(w)).filter("event_count >= 2").select("workspace_id", "entity", "hour", "event_count")


class _Workflow(StatefulProcessor):
    """Current state of one workflow; emits a row per change, those of a batch in one frame."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("state", StructType([
            StructField("state", StringType()), StructField("changes", IntegerType())]))

    def handleInputRows(self, key, rows, timer_values) -> Iterator[pd.DataFrame]:
        held = self.state.get() if self.state.exists() else (None, 0)
        current, changes = held[0], held[1]
        # A batch may come in several frames; the order holds over all of them.
        asked, out = sorted(pair for frame in rows for pair in zip(frame["seq"].tolist(), frame["to_state"].tolist())), []
        for seq, wanted in asked:
            if wanted and wanted != current:
                changes += 1
                out.append((key[0], key[1], seq, current, wanted, changes))
                current = wanted
        if out:
            self.state.update((current, changes))
            yield pd.DataFrame(out, columns=["workspace_id", "workflow_id", "seq", "from_state", "to_state", "change_no"])

    def close(self) -> None:
        pass


def workflow_transitions(commands: DataFrame) -> DataFrame:
    """State changes of supervised workflows as commands arrive; needs the RocksDB state store.

    Commands of one workflow are applied in the order of seq within a batch.
    """
    from memograph.operators.workflow import requested_state

    asked = commands.select("workspace_id", "workflow_id", "seq", requested_state().alias("to_state")).filter("to_state IS NOT NULL")
    return asked.groupBy("workspace_id", "workflow_id").transformWithStateInPandas(
        statefulProcessor=_Workflow(),
        outputStructType="workspace_id string, workflow_id string, seq long, from_state string, to_state string, change_no int",
        outputMode="Append", timeMode="None")
