"""Event filters, ordered timelines and gap clusters."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from memograph.functions import text
from memograph.plans import timescan
from memograph.plans.bounded import broadcast_if_small
from memograph.plans.late import first_passing
from memograph.plans.ranking import with_rank
from memograph.plans.timescan import micros

WS = ["workspace_id"]
HOURS_2 = 7_200_000_000


def filter_events(
    events: DataFrame,
    workspaces: Sequence[str] | None = None,
    event_types: Sequence[str] | None = None,
    severities: Sequence[str] | None = None,
    start: Column | None = None,
    end: Column | None = None,
) -> DataFrame:
    """Conjunction of optional list and inclusive range filters; pushed to the scan."""
    out = events
    for column, values in (("workspace_id", workspaces), ("event_type", event_types), ("severity", severities)):
        if values:
            out = out.filter(F.col(column).isin(list(values)))
    if start is not None:
        out = out.filter(F.col("ts") >= start)
    if end is not None:
        out = out.filter(F.col("ts") <= end)
    return out


def search_events(events: DataFrame, event_types: Sequence[str] | None, start: str | None, end: str | None) -> DataFrame:
    """Same filter with textual bounds; a bound that does not parse is ignored."""
    out = filter_events(events, event_types=event_types)
    for bound, is_start in ((start, True), (end, False)):
        if bound:
            parsed = F.try_to_timestamp(F.lit(bound))
            inside = F.col("ts") >= parsed if is_start else F.col("ts") <= parsed
            out = out.filter(parsed.isNull() | inside)
    return out


def newest(events: DataFrame, limit: int, offset: int = 0, tie: str = "event_id") -> DataFrame:
    """Newest page of events, nulls last."""
    return events.orderBy(F.desc_nulls_last("ts"), F.asc(tie)).offset(offset).limit(limit)


def latest_per_key(rows: DataFrame, keys: Sequence[str], n: int, tie: str = "event_id") -> DataFrame:
    """Latest n rows per key; the group limit runs before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(F.desc_nulls_last("ts"), F.asc(tie))
    return rows.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)


def mentioning(events: DataFrame, refs: DataFrame, entities: DataFrame) -> DataFrame:
    """Events whose chunk mentions any of the given (workspace_id, name) entities."""
    chunks = refs.join(entities, ["workspace_id", "name"], "left_semi").select("workspace_id", "chunk_id").distinct()
    return events.join(chunks, ["workspace_id", "chunk_id"], "left_semi")


def deltas(events: DataFrame) -> DataFrame:
    """Seconds since the previous event of the workspace; events at one instant follow each other by id.

    Events without a time come first and carry no delta.
    """
    instants = timescan.previous_instants(events, WS, "ts", "event_id")
    joined = events.withColumn("us", micros("ts")).join(instants, [*WS, "us"], "left")
    seconds = F.when(F.col("event_id") != F.col("first_id"), F.lit(0.0)).otherwise(
        (F.col("us") - F.col("previous_us")) / F.lit(1_000_000.0)
    )
    return (
        joined.withColumn("delta_seconds", F.when(F.col("us").isNotNull(), seconds))
        .withColumn("delta_text", text.duration_text(F.col("delta_seconds")))
        .drop("first_id", "previous_us", "us")
    )


def timeline(events: DataFrame, refs: DataFrame, limit: int) -> DataFrame:
    """Newest events per workspace with deltas inside the page and sorted entity names.

    The page is bounded by limit per workspace, so its windows are small. Filter
    events before the call to page over some of them.
    """
    page = latest_per_key(events, WS, limit)
    order = Window.partitionBy("workspace_id").orderBy(F.asc_nulls_first("ts"), F.desc("rank"))
    before = F.last("ts", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1))
    out = page.withColumn("delta_seconds", (micros("ts") - F.unix_micros(before)) / F.lit(1_000_000.0))
    out = out.withColumn("delta_text", text.duration_text(F.col("delta_seconds")))
    named = (
        page.select("workspace_id", "chunk_id").distinct()
        .join(refs, ["workspace_id", "chunk_id"])
        .groupBy("workspace_id", "chunk_id")
        .agg(F.array_sort(F.collect_set("name")).alias("entity_names"))
    )
    return out.join(named, ["workspace_id", "chunk_id"], "left")


def entity_page(events: DataFrame, refs: DataFrame, questions: DataFrame) -> DataFrame:
    """The newest events of each question's workspace that mention its entity, up to its limit.

    questions: query_id, workspace_id, entity, page_limit. Events are fetched newest first, twice the
    limit at a time, and only the fetched ones are looked up in the mentions; a question whose
    page is not full fetches on until it is, or its workspace has no more. Events without a
    time come last.
    """
    def mentioned(fetched: DataFrame) -> DataFrame:
        keys = ["workspace_id", "chunk_id", "entity"]
        named = refs.select("workspace_id", "chunk_id", F.col("name").alias("entity"))
        # The mentions are scanned in place for what was fetched; only those that were asked for travel.
        return fetched.join(named.join(broadcast_if_small(fetched.select(*keys).distinct()), keys, "left_semi"), keys, "left_semi")

    newest = [-F.coalesce(micros("ts"), F.lit(-(1 << 62))), F.col("event_id")]
    return first_passing(events, questions, WS, "query_id", newest, "page_limit", mentioned)


def build(events: DataFrame, refs: DataFrame, questions: DataFrame) -> DataFrame:
    """A timeline for each question: newest events first, with deltas inside the page and sorted entity names.

    questions: query_id, workspace_id, page_limit, and the filters types (a list), severities
    (a list), start, end and entity; a null filter admits all. Filters are looked at on fetched
    events, and a page that is not full fetches on.
    """
    def admitted(fetched: DataFrame) -> DataFrame:
        def opt(name: str, condition: Column) -> Column:
            return F.col(name).isNull() | condition

        inside = fetched.filter(
            opt("types", F.array_contains("types", F.col("event_type"))) & opt("severities", F.array_contains("severities", F.col("severity")))
            & opt("start", F.col("ts") >= F.col("start")) & opt("end", F.col("ts") <= F.col("end")))
        named = refs.select("workspace_id", "chunk_id", F.col("name").alias("entity"), F.lit(True).alias("_named")).distinct()
        return inside.join(named, ["workspace_id", "chunk_id", "entity"], "left").filter(opt("entity", F.col("_named"))).drop("_named")

    newest = [-F.coalesce(micros("ts"), F.lit(-(1 << 62))), F.col("event_id")]
    page = first_passing(events, questions, WS, "query_id", newest, "page_limit", admitted)
    order = Window.partitionBy("query_id").orderBy(F.asc_nulls_first("ts"), F.desc("rank"))
    before = F.last("ts", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1))
    out = page.withColumn("delta_seconds", (micros("ts") - F.unix_micros(before)) / F.lit(1_000_000.0))
    names = refs.groupBy("workspace_id", "chunk_id").agg(F.array_sort(F.collect_set("name")).alias("entity_names"))
    return out.withColumn("delta_text", text.duration_text(F.col("delta_seconds"))).join(names, ["workspace_id", "chunk_id"], "left")


def ranked_clusters(clusters: DataFrame) -> DataFrame:
    """Clusters with their place by size over all workspaces, the largest first; ties by start, workspace and number."""
    return with_rank(clusters, [F.desc("event_count"), F.col("start_us"), F.col("workspace_id"), F.col("cluster_id")])


def temporal_clusters(events: DataFrame, gap_us: int = HOURS_2) -> DataFrame:
    """Runs of events at most a gap apart, numbered per workspace; single events are not clusters."""
    cells = timescan.session_cells(events, WS, "ts", gap_us)
    return (
        cells.groupBy("workspace_id", F.col("session_no").alias("cluster_id"))
        .agg(F.sum("n").alias("event_count"), F.min("lo_us").alias("start_us"), F.max("hi_us").alias("end_us"))
        .filter(F.col("event_count") >= 2)
        .withColumn("duration_seconds", (F.col("end_us") - F.col("start_us")) / F.lit(1_000_000.0))
    )


def cluster_members(events: DataFrame, gap_us: int = HOURS_2) -> DataFrame:
    """(workspace, cluster, event) rows; the long form of each cluster's event list."""
    cells = timescan.session_cells(events, WS, "ts", gap_us)
    return timescan.attach_sessions(events, cells, WS, "ts", gap_us).withColumnRenamed("session_no", "cluster_id")


def cluster_entities(events: DataFrame, refs: DataFrame, gap_us: int = HOURS_2) -> DataFrame:
    """Distinct entities linked to the chunks of each cluster."""
    chunks = cluster_members(events, gap_us).select("workspace_id", "cluster_id", "chunk_id").distinct()
    return chunks.join(refs, ["workspace_id", "chunk_id"]).select("workspace_id", "cluster_id", "name", "type").distinct()


def previous_deployment(events: DataFrame, issue_types: Sequence[str] = ("incident", "outage"),
                        within_us: int = 3_600_000_000) -> DataFrame:
    """Issues with the latest strictly earlier deployment of the workspace, at most an hour before."""
    deployments = (
        events.filter(F.col("event_type") == "deployment")
        .groupBy("workspace_id", micros("ts").alias("us"))
        .agg(F.max(F.struct("event_id", "title")).alias("d"))
        .select("workspace_id", "us", F.lit(1).alias("rank"),
                F.struct(F.col("us"), F.col("d.event_id").alias("event_id"), F.col("d.title").alias("title")).alias("deployment"))
    )
    issues = events.filter(F.col("event_type").isin(list(issue_types)) & F.col("ts").isNotNull())
    probes = issues.select("workspace_id", micros("ts").alias("us"), F.lit(0).alias("rank")).distinct()
    rows = deployments.filter(F.col("us").isNotNull()).unionByName(probes, allowMissingColumns=True)
    found = timescan.carry_last(rows, WS, ["us", "rank"], "deployment", "us").filter("rank = 0")
    found = found.select("workspace_id", "us", F.col("previous_deployment").alias("d"))
    return (
        issues.withColumn("us", micros("ts")).join(found, [*WS, "us"])
        .filter(F.col("us") - F.col("d.us") <= within_us)
        .select(
            "workspace_id", "event_id", "title", "event_type",
            F.col("d.event_id").alias("deployment_id"), F.col("d.title").alias("deployment_title"),
            F.floor((F.col("us") - F.col("d.us")) / 60_000_000).alias("minutes_after"),
        )
    )
