"""Question profiles, root-cause chains, summaries and multi-hop context."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from memograph import vocab
from memograph.functions import phrases, scoring, text
from memograph.operators import digest, retrieval
from memograph.operators.upsert import keep_by
from memograph.plans.bounded import broadcast_if_small
from memograph.plans.late import first_passing
from memograph.plans.substring import containing
from memograph.session import cut_lineage

# One sentence per profile.
EXPLANATIONS = {
    "root_cause_analysis": "Query focuses on finding correlation chains, dependencies, or preceding triggers of an incident.",
    "recurring_issue": "Query focuses on identifying repeated system failures, outages, or recurring onboarding issues.",
    "trend_analysis": "Query focuses on temporal progression, frequency changes, or operational trend signals over time.",
    "escalation_analysis": "Query focuses on operational escalation paths, alert response times, or severity-level escalations.",
    "bottleneck_analysis": "Query focuses on identifying slower workflows, onboarding blockers, or pipeline delivery delays.",
    "timeline_analysis": "Query focuses on a chronological breakdown of events and source references.",
    "anomaly_investigation": "Query focuses on investigating sudden deviations, metrics spikes, or unexpected system states.",
}


def classify(questions: DataFrame, question: str = "question") -> DataFrame:
    """Profile with the most keyword hits, the earlier profile on a tie, and its confidence.

    Hits are counted in the question's own row; nothing is joined or shuffled.
    """
    low = F.lower(F.col(question))
    rows = []
    for i, (profile, words) in enumerate(vocab.QUERY_PROFILES):
        hits = F.filter(
            F.array(*[F.when(low.rlike(rf"\b{re.escape(w)}\b"), F.lit(w)) for w in words]), lambda w: w.isNotNull())
        rows.append(F.struct(hits.alias("keywords"), F.lit(-i).alias("order"), F.lit(profile).alias("profile")))
    by_hits = F.transform(F.array(*rows), lambda r: F.struct(
        F.size(r["keywords"]).alias("n"), r["order"].alias("order"), r["profile"].alias("profile"), r["keywords"].alias("keywords")))
    scored = questions.withColumn("_best", F.explode(F.array(F.array_max(by_hits))))
    asks = F.lower(F.col(question)).rlike("^(how|what|which|where)")
    n = F.col("_best.n")
    profile = F.when(n > 0, F.col("_best.profile")).when(asks, "root_cause_analysis").otherwise("recurring_issue")
    explained = F.create_map(*[F.lit(x) for pair in EXPLANATIONS.items() for x in pair])
    return scored.select(
        *questions.columns, profile.alias("query_type"),
        F.round(F.lit(0.5) + F.least(n * 0.15, F.lit(0.49)), 2).alias("class_confidence"),
        F.col("_best.keywords").alias("keywords"),
    ).withColumn("explanation", F.element_at(explained, F.col("query_type")))


def time_ranges(questions: DataFrame, as_of: Column, question: str = "question", rolling: bool = False) -> DataFrame:
    """Start, end and the question without its time phrase."""
    q = F.col(question)
    if rolling:
        return questions.withColumn("_r", phrases.rolling_range(q, as_of)).select(
            *questions.columns, F.col("_r.start").alias("start"), F.col("_r.end").alias("end"), F.col("_r.clean").alias("clean"))
    ranged = questions.withColumn("_r", phrases.calendar_range(q, as_of))
    return ranged.select(
        *questions.columns, F.col("_r.start").alias("start"), F.col("_r.end").alias("end"),
        phrases.without_phrase(q, F.col("_r.phrase")).alias("clean"))


def chains(events: DataFrame) -> DataFrame:
    """Events of each question in time order; the list of one question is bounded by its search limits."""
    w = Window.partitionBy("query_id").orderBy(F.asc_nulls_first("ts"), "event_id")
    return events.withColumn("step", F.row_number().over(w))


def links(events: DataFrame, correlations: DataFrame) -> DataFrame:
    """Pairs of a question's events, earlier first, whose sources are correlated.

    Correlations meet the events by equality on each end, so pairs form only
    where a correlation exists. The first match by reference order counts.
    """
    steps = chains(events)
    refs = steps.select("query_id", "workspace_id", "event_id", "step", F.posexplode("source_refs").alias("ref_no", "ref"))
    a = refs.select("query_id", "workspace_id", F.col("ref").alias("ref_a"), F.col("event_id").alias("from_event"),
                    F.col("step").alias("from_step"), F.col("ref_no").alias("from_no"))
    b = refs.select("query_id", "workspace_id", F.col("ref").alias("ref_b"), F.col("event_id").alias("to_event"),
                    F.col("step").alias("to_step"), F.col("ref_no").alias("to_no"))
    both = correlations.select("workspace_id", F.col("source_a").alias("ref_a"), F.col("source_b").alias("ref_b"),
                               "type", "score", "reason")
    both = both.unionByName(both.withColumns({"ref_a": F.col("ref_b"), "ref_b": F.col("ref_a")})).distinct()
    matched = a.join(both, ["workspace_id", "ref_a"]).join(b, ["query_id", "workspace_id", "ref_b"]).filter("from_step < to_step")
    return keep_by(matched, ["query_id", "from_event", "to_event"],
                   ["from_no", "to_no", -F.col("score"), "type"], newest=False)


def pattern_matches(questions: DataFrame, patterns: DataFrame) -> DataFrame:
    """Patterns whose entity list, as text, contains a wanted entity of the question; a row for each such entity.

    Patterns of workspaces without a question are left out first, so that Spark can do so
    before it pairs their events.
    """
    asked = questions.select("query_id", "workspace_id", F.explode("q_entities").alias("entity"))
    spaces = broadcast_if_small(asked.select("workspace_id").distinct())
    listed = patterns.join(spaces, ["workspace_id"], "left_semi").withColumn("_csv", F.lower(F.array_join("entities", ",")))
    return containing(listed, F.col("_csv"), asked, F.lower("entity"), ["workspace_id"]).drop("_csv", "entity")


def matching_patterns(questions: DataFrame, patterns: DataFrame) -> DataFrame:
    """Patterns whose entity list, as text, contains a wanted entity of the question."""
    return pattern_matches(questions, patterns).distinct()


def pattern_counts(matches: DataFrame) -> DataFrame:
    """Distinct matches of each question; two hashes of a row travel for it, as patterns grow with the square of the events."""
    row = [c for c in matches.columns if c != "query_id"]
    marks = matches.select("query_id", F.xxhash64(*row).alias("_a"), F.xxhash64(F.lit(1), *row).alias("_b")).distinct()
    return marks.groupBy("query_id").agg(F.count(F.lit(1)).alias("pattern_count"))


def root_cause(questions: DataFrame, events: DataFrame, correlations: DataFrame, patterns: DataFrame) -> dict[str, DataFrame]:
    """Chain, links, patterns, explanation lines and confidence of every question.

    matches are the patterns with a row for each entity that they match; what repeated rows do
    not change is better read from there.
    """
    linked = links(events, correlations)
    matches = pattern_matches(questions, patterns)
    titles = events.select("query_id", "event_id", "title")
    steps = (
        linked.join(titles.withColumnsRenamed({"event_id": "from_event", "title": "from_title"}), ["query_id", "from_event"])
        .join(titles.withColumnsRenamed({"event_id": "to_event", "title": "to_title"}), ["query_id", "to_event"])
        .select("query_id", "from_event", "to_event", F.concat(
            F.lit("Step: '"), "from_title", F.lit("' linked to '"), "to_title", F.lit("' (Reason: "), "reason",
            F.lit(", Similarity: "), F.col("score").cast("string"), F.lit(")")).alias("explanation"))
    )
    per = linked.groupBy("query_id").agg(
        F.count(F.lit(1)).alias("link_count"), F.avg("score").alias("mean_score"),
        F.min_by("from_event", F.struct("from_step", "to_step")).alias("first_event"))
    named = pattern_counts(matches)
    counted = questions.select("query_id", "workspace_id").join(per, "query_id", "left").join(named, "query_id", "left")
    n, p = F.coalesce("link_count", F.lit(0)), F.coalesce("pattern_count", F.lit(0))
    summary = counted.select(
        "query_id", "workspace_id", n.alias("link_count"), p.alias("pattern_count"), "first_event",
        scoring.chain_confidence(n, F.coalesce("mean_score", F.lit(0.0)), p > 0).alias("trace_confidence"))
    return {"chain": chains(events), "links": linked, "patterns": matches.distinct(), "matches": matches, "steps": steps, "summary": summary}


def synthesize(classified: DataFrame, parts: dict[str, DataFrame], traced: dict[str, DataFrame]) -> DataFrame:
    """One rule-based answer per question: summary text, confidence and counts."""
    tops = keep_by(parts["chunks"].select("query_id", "chunk_id", "text", "rank"), ["query_id"], ["rank"], newest=False)
    tops = tops.select("query_id", text.report_sections(F.col("text")).alias("top"))
    chunks = parts["chunks"].groupBy("query_id").agg(F.count(F.lit(1)).alias("chunk_count"))
    events = parts["events"].groupBy("query_id").agg(F.count(F.lit(1)).alias("event_count"))
    triggers = traced["summary"].join(
        parts["events"].select("query_id", F.col("event_id").alias("first_event"), F.col("title").alias("trigger")),
        ["query_id", "first_event"], "left")
    recurring = traced["matches"].filter(F.col("pattern_type") == "recurring_incident").groupBy("query_id").agg(
        F.min_by("name", F.struct(-F.unix_micros("last_detected"), "pattern_id")).alias("problem"))
    rows = (
        classified.join(triggers.drop("workspace_id"), "query_id", "left").join(tops, "query_id", "left")
        .join(chunks, "query_id", "left").join(events, "query_id", "left").join(recurring, "query_id", "left")
        .fillna(0, ["chunk_count", "event_count", "link_count", "pattern_count"])
    )

    def three(cause: Column, impact: Column, remedy: Column) -> Column:
        return F.concat(F.lit("**Root Cause**: "), cause, F.lit("\n**Impact**: "), impact, F.lit("\n**Remediation**: "), remedy)

    kind = F.col("query_type")
    # Sentences of the rule-based answers.
    cause = (
        F.when(F.col("trigger").isNotNull(), three(
            F.concat(F.lit("Primary trigger identified as '"), "trigger", F.lit("'.")),
            F.lit("Potential gateway instability and client-side timeouts."),
            F.concat(F.lit("Investigate '"), "trigger", F.lit("' events and check system limits."))))
        .when(F.col("top").isNotNull(), three(F.col("top.root_cause"), F.col("top.impact"), F.col("top.remediation")))
        .otherwise(three(F.lit("Primary trigger identified as 'unknown'."),
                         F.lit("Intermittent application failures in active workspace."),
                         F.lit("Inspect live system execution logs and run verification queries.")))
    )
    summary = (
        F.when(kind == "root_cause_analysis", cause)
        .when(kind == "recurring_issue", three(
            F.concat(F.lit("Recurring bottleneck profile detected matching '"), F.coalesce("problem", F.lit("unknown")), F.lit("'.")),
            F.lit("Repeated bottlenecks and operational performance degradation."),
            F.lit("Adjust connector limits and clean up duplicate documents.")))
        .when(kind == "trend_analysis", three(
            F.lit("Temporal distribution analysis of workspace events."),
            F.concat(F.lit("Fluctuations in workspace activity ("), F.col("event_count"), F.lit(" events registered).")),
            F.lit("Establish alert baselines and monitor traffic spikes.")))
        .otherwise(three(
            F.concat(F.lit("Diagnostic report compiled for '"), "question", F.lit("'.")),
            F.concat(F.lit("Found "), F.col("chunk_count"), F.lit(" chunks and "), F.col("event_count"), F.lit(" events of interest.")),
            F.lit("Review the specific event timestamps and vector evidence details.")))
    )
    return rows.select(
        "query_id", "workspace_id", "question", "query_type", "class_confidence", "chunk_count", "event_count", "link_count",
        "pattern_count", "trace_confidence", summary.alias("summary"),
        scoring.answer_confidence(F.col("class_confidence"), F.col("trace_confidence")).alias("confidence"))


def key_findings(chunks: DataFrame, patterns: DataFrame) -> DataFrame:
    """Up to three chunk excerpts and two patterns per question; a pattern may come more than once."""
    first = chunks.filter(F.col("rank") <= 3).select(
        "query_id", F.lit("chunk").alias("kind"), F.col("rank").cast("long").alias("n"), F.col("chunk_id").alias("ref"),
        F.concat(F.lit("Semantic overlap found in "), "source_type", F.lit(": '"),
                 text.strip(F.substring("text", 1, 150)), F.lit("...'")).alias("finding"))
    w = Window.partitionBy("query_id").orderBy(F.desc("last_detected"), "pattern_id")
    # Each task keeps the rows of its two first places; what is distinct is settled among them.
    firsts = patterns.withColumn("_place", F.dense_rank().over(w)).filter(F.col("_place") <= 2).drop("_place").distinct()
    second = firsts.withColumn("n", F.row_number().over(w)).filter(F.col("n") <= 2).withColumn("n", F.col("n").cast("long")).select(
        "query_id", F.lit("pattern").alias("kind"), "n", F.col("pattern_id").alias("ref"),
        F.concat(F.lit("Registered alert pattern: '"), "name", F.lit("' ("), "description", F.lit(")")).alias("finding"))
    return first.unionByName(second)


def answer(
    questions: DataFrame, chunks: DataFrame, events: DataFrame, correlations: DataFrame, patterns: DataFrame,
    as_of: Column, limit: int = 10, texts: DataFrame | None = None,
) -> dict[str, DataFrame]:
    """Classify, gather evidence, trace causes and compose an answer for a table of questions; texts as for `retrieval.evidence`."""
    parts = retrieval.evidence(questions, chunks, events, correlations, as_of, limit, texts)
    parts["chunks"], parts["events"] = cut_lineage(parts["chunks"]), cut_lineage(parts["events"])
    traced = root_cause(parts["questions"], parts["events"], parts["correlations"].withColumnsRenamed(
        {"chunk_id": "source_a", "related_id": "source_b"}).drop("query_id").distinct(), patterns)
    classified = classify(questions.select("query_id", "workspace_id", "question"))
    return {**parts, **{f"trace_{k}": v for k, v in traced.items()}, "answers": synthesize(classified, parts, traced),
            "findings": key_findings(parts["chunks"], traced["matches"])}


def wanted_names(questions: DataFrame, hits: DataFrame) -> DataFrame:
    """(query_id, workspace_id, wanted): lower-case names from each question and from its hits."""
    own = questions.select("query_id", "workspace_id", F.explode("q_entities").alias("name"))
    from_hits = hits.select("query_id", "workspace_id", F.explode("entities").alias("name"))
    return cut_lineage(own.unionByName(from_hits).select("query_id", "workspace_id", F.lower(F.trim("name")).alias("wanted")).distinct())


def entity_chunks(names: DataFrame, refs: DataFrame) -> DataFrame:
    """(query_id, workspace_id, chunk_id): chunks that refer to an entity whose name contains a wanted one."""
    nodes = refs.select("workspace_id", "name").distinct()
    resolved = containing(nodes, F.lower("name"), names, F.col("wanted"), ["workspace_id"]).select("query_id", "workspace_id", "name").distinct()
    return refs.join(resolved, ["workspace_id", "name"]).select("query_id", "workspace_id", "chunk_id").distinct()


def multi_hop_events(
    questions: DataFrame, hits: DataFrame, refs: DataFrame, events: DataFrame, newest: int = 100
) -> DataFrame:
    """Events reached from a question: by hit chunks, by chunks of its entities, or by naming one.

    Wanted names come from the question and from its hits. A name table measured
    small is broadcast; a larger one meets the events on shared trigrams.
    """
    names = wanted_names(questions, hits)
    by_entity = entity_chunks(names, refs)
    chunks = by_entity.union(hits.select("query_id", "workspace_id", "chunk_id")).distinct()
    linked = events.select("workspace_id", "chunk_id", "event_id").join(chunks, ["workspace_id", "chunk_id"]).select(
        "query_id", "workspace_id", "event_id")
    # Title and description are searched apart, so no name can span both.
    texts = F.array(F.lower("title"), F.lower(F.coalesce("description", F.lit(""))))
    said = events.select("workspace_id", "event_id", F.explode(texts).alias("said"))
    naming = containing(said, F.col("said"), names, F.col("wanted"), ["workspace_id"]).select("query_id", "workspace_id", "event_id")
    bounds = questions.select("query_id", "q_start", "q_end")
    reached = linked.union(naming).distinct().join(events, ["workspace_id", "event_id"]).join(bounds, "query_id").filter(
        (F.col("q_start").isNull() | (F.col("ts") >= F.col("q_start"))) & (F.col("q_end").isNull() | (F.col("ts") <= F.col("q_end"))))
    w = Window.partitionBy("query_id").orderBy(F.desc_nulls_last("ts"), "event_id")
    return reached.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= newest)


def in_range() -> Column:
    return (F.col("q_start").isNull() | (F.col("ts") >= F.col("q_start"))) & (F.col("q_end").isNull() | (F.col("ts") <= F.col("q_end")))


def multi_hop(
    questions: DataFrame, chunks: DataFrame, refs: DataFrame, events: DataFrame, insights: DataFrame,
    nearest: int = 5, newest: int = 100, page: int = 50,
) -> dict[str, DataFrame]:
    """Everything one question leads to: hits, events, a timeline, patterns, insights, and a summary row.

    questions are prepared ones. The timeline holds the `page` newest events of the workspace in
    the question's range that an entity of the question or of its hits is mentioned with, or any
    event where no such entity is known. Patterns and insights are those of the workspace; the
    confidence is the mean over its insights, 0.8 where there is none.
    """
    hits = cut_lineage(retrieval.filtered_knn(questions, chunks, nearest, conditions=in_range()).select(
        "query_id", "workspace_id", "chunk_id", "entities", "cosine"))
    reached = cut_lineage(multi_hop_events(questions, hits, refs, events, newest))
    mentioned = cut_lineage(entity_chunks(wanted_names(questions, hits), refs))
    bound = mentioned.select("query_id").distinct().withColumn("bound", F.lit(True))
    asking = cut_lineage(questions.select("query_id", "workspace_id", "q_start", "q_end", F.lit(page).alias("page_limit")).join(bound, "query_id", "left"))

    def wanted(fetched: DataFrame) -> DataFrame:
        inside = fetched.filter(in_range())
        linked = mentioned.withColumn("_linked", F.lit(True))
        return inside.join(linked, ["query_id", "workspace_id", "chunk_id"], "left").filter(
            F.col("bound").isNull() | F.col("_linked")).drop("_linked")

    order = [-F.coalesce(F.unix_micros("ts"), F.lit(-(1 << 62))), F.col("event_id")]
    shown = cut_lineage(first_passing(events, asking, ["workspace_id"], "query_id", order, "page_limit", wanted))
    by_time = Window.partitionBy("query_id").orderBy(F.asc_nulls_first("ts"), F.desc("rank"))
    timeline = shown.withColumn("delta_seconds", (F.unix_micros("ts") - F.unix_micros(F.lag("ts").over(by_time))) / 1_000_000)
    patterns = digest.pattern_report(events, refs)
    parts = {"hits": hits, "events": reached, "timeline": timeline, "patterns": patterns, "insights": insights}
    out = questions.select("query_id", "workspace_id", "question", "q_start", "q_end")
    for name, rows in (("hits", hits), ("events", reached)):
        out = out.join(rows.groupBy("query_id").agg(F.count(F.lit(1)).alias(name)), "query_id", "left")
    gaps = timeline.groupBy("query_id").agg(F.count(F.lit(1)).alias("timeline_events"), F.max("delta_seconds").alias("longest_gap_seconds"))
    sections = patterns.groupBy("workspace_id").pivot("section", ["temporal_clusters", "incident_frequencies", "deployment_incidents"]).agg(F.first("n"))
    told = insights.groupBy("workspace_id").agg(F.count(F.lit(1)).alias("insights"), F.round(F.avg("confidence"), 2).alias("confidence"))
    counts = ["hits", "events", "timeline_events", "temporal_clusters", "incident_frequencies", "deployment_incidents", "insights"]
    summary = out.join(gaps, "query_id", "left").join(sections, "workspace_id", "left").join(told, "workspace_id", "left")
    return {**parts, "summary": summary.fillna(0, counts).fillna(0.8, ["confidence"])}


def alert_context(alerts: DataFrame, answers: DataFrame, findings: DataFrame) -> DataFrame:
    """Diagnostic text of an alert from the answer to its title and its first two findings."""
    w = Window.partitionBy("query_id").orderBy("kind", "n")
    two = findings.withColumn("r", F.row_number().over(w)).filter(F.col("r") <= 2).groupBy("query_id").agg(
        F.array_sort(F.collect_list(F.struct("r", "ref", "finding"))).alias("f"))
    bullets = F.array_join(F.transform("f", lambda x: F.concat(
        F.lit("\n• *"), x["ref"], F.lit("*: \""), F.substring(x["finding"], 1, 100), F.lit("...\""))), "")
    return alerts.join(answers.select("query_id", "summary", "confidence"), "query_id").join(two, "query_id", "left").select(
        "query_id", "workspace_id",
        F.concat(
            F.lit("*Alert Triggered*: `"), "question", F.lit("`\n*Severity*: `"), F.upper("severity"),
            F.lit("` | *Diagnostic Confidence*: `"), F.floor(F.col("confidence") * 100), F.lit("%`\n\n*RCA Summary*:\n"),
            "summary", F.lit("\n\n*Primary Supporting Evidence*:"), F.coalesce(bullets, F.lit(" No vector documents linked.")),
        ).alias("message"))
