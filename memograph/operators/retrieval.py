"""Filtered vector search over a table of questions, re-ranking and evidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from memograph.functions import phrases, scoring, text
from memograph.operators.correlation import by_source
from memograph.operators.upsert import keep_by
from memograph.plans.bounded import broadcast_if_small
from memograph.plans.neighbours import knn_join, top_k_scan
from memograph.session import cut_lineage

QUESTION_COLUMNS = {
    "query_id": "string", "workspace_id": "string", "question": "string", "embedding": "array<double>", "limit": "int",
    "sources": "array<string>", "author": "string", "team": "string", "start": "timestamp", "end": "timestamp",
    "scope": "array<string>", "wanted": "array<string>",
}


def prepare_questions(questions: DataFrame, as_of: Column, default_limit: int = 5) -> DataFrame:
    """Fill missing parameters, read rolling time phrases and tag the wanted entities.

    An explicit time bound wins over a phrase.
    """
    full = questions.select(*[
        (F.col(c) if c in questions.columns else F.lit(None)).cast(t).alias(c) for c, t in QUESTION_COLUMNS.items()])
    ranged = full.withColumn("_r", phrases.rolling_range(F.col("question"), as_of))
    tagged = ranged.withColumn("_e", F.transform(text.mentions(F.col("_r.clean")), lambda m: m["name"]))
    none = F.array().cast("array<string>")
    return tagged.select(
        "query_id", "workspace_id", "question", F.col("_r.clean").alias("search_text"),
        F.col("embedding").alias("q_vector"), F.coalesce("limit", F.lit(default_limit)).alias("q_limit"),
        F.col("sources").alias("q_sources"), F.col("author").alias("q_author"), F.col("team").alias("q_team"),
        F.coalesce("start", "_r.start").alias("q_start"), F.coalesce("end", "_r.end").alias("q_end"),
        F.col("scope").alias("q_scope"), F.coalesce("wanted", none).alias("q_wanted"),
        F.array_union(F.coalesce("_e", none), F.coalesce("wanted", none)).alias("q_entities"),
    )


def admitted() -> Column:
    """Payload filter of a question against a chunk: absent parameters admit all."""
    def opt(parameter: str, condition: Column) -> Column:
        return F.col(parameter).isNull() | condition

    return (
        opt("q_sources", F.array_contains("q_sources", F.col("source")))
        & opt("q_author", F.col("author") == F.col("q_author")) & opt("q_team", F.col("team") == F.col("q_team"))
        & opt("q_start", F.col("ts") >= F.col("q_start")) & opt("q_end", F.col("ts") <= F.col("q_end"))
        & (F.col("q_scope").isNull() | (F.size("q_scope") <= 0)
           | F.array_contains("hierarchy", F.try_element_at("q_scope", F.lit(-1))))
        & (F.size(F.array_except("q_wanted", "entities")) == 0)
    )


def filtered_knn(questions: DataFrame, chunks: DataFrame, k: Column | int, id_column: str = "chunk_id",
                 conditions: Column | None = None) -> DataFrame:
    """Best k rows by cosine for every question within its workspace.

    Both sides are scaled to unit length before they meet, so a pair costs one
    dot product.
    """
    asked = questions.withColumn("q_unit", scoring.unit(F.col("q_vector")))
    held = chunks.withColumn("_unit", scoring.unit(F.col("embedding")))
    score = scoring.dot(F.col("q_unit"), F.col("_unit"))
    return top_k_scan(asked, held, ["workspace_id"], conditions, score, k, "query_id", id_column).drop("_unit", "q_unit")


def rank(candidates: DataFrame, as_of: Column) -> DataFrame:
    """Cosine plus recency, path, entity and source boosts, with every part kept."""
    parts = {
        "recency_boost": scoring.recency_boost(F.col("ts"), as_of),
        "hierarchy_boost": scoring.hierarchy_boost(F.col("hierarchy"), F.col("q_scope")),
        "entity_boost": scoring.entity_boost(F.col("entities"), F.col("q_entities")),
        "source_boost": scoring.source_boost(F.col("source")),
    }
    total = F.col("cosine")
    out = candidates
    for name, value in parts.items():
        out = out.withColumn(name, value)
        total = total + F.col(name)
    return out.withColumn("base_score", F.round(total, 4))


def correlation_boost(ranked: DataFrame, correlations: DataFrame) -> DataFrame:
    """Adds a tenth of every correlation score whose other end is a candidate of the same question."""
    hits = ranked.select("query_id", "workspace_id", "chunk_id")
    linked = hits.join(by_source(correlations), ["workspace_id", "chunk_id"])
    inside = linked.join(
        hits.withColumnRenamed("chunk_id", "related_id"), ["query_id", "workspace_id", "related_id"], "left_semi")
    boosts = inside.groupBy("query_id", "workspace_id", "chunk_id").agg(
        F.sum(F.col("score") * 0.1).alias("correlation_boost"), F.count(F.lit(1)).alias("correlated_hits"))
    return ranked.join(boosts, ["query_id", "workspace_id", "chunk_id"], "left").withColumns({
        "correlation_boost": F.coalesce("correlation_boost", F.lit(0.0)),
        "correlated_hits": F.coalesce("correlated_hits", F.lit(0)),
    }).withColumn("score", F.round(F.col("base_score") + F.col("correlation_boost"), 4))


def hybrid_search(questions: DataFrame, chunks: DataFrame, correlations: DataFrame, as_of: Column,
                  over_fetch: int = 3, at_least: int = 20) -> DataFrame:
    """Filter, over-fetch by cosine, re-rank, boost correlated hits, and cut to each question's limit.

    The feature re-ranks the `over_fetch` times limit nearest chunks, `at_least` 20. A chunk
    below them stays out even if its boosts (0.47 in all, and a tenth of each correlation)
    would lift it into the limit; a larger factor admits it.
    """
    prepared = prepare_questions(questions, as_of)
    fetched = filtered_knn(prepared, chunks, F.greatest(F.col("q_limit") * over_fetch, F.lit(at_least)), conditions=admitted())
    boosted = correlation_boost(rank(fetched, as_of), correlations)
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), F.desc("base_score"), "candidate_rank")
    return boosted.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= F.col("q_limit"))


def correlation_context(hits: DataFrame, correlations: DataFrame) -> DataFrame:
    """Correlations of each hit in long form; hits without any keep one row."""
    return hits.join(by_source(correlations).withColumnRenamed("score", "correlation_score"), ["workspace_id", "chunk_id"], "left")


def discover_workspace(questions: DataFrame, chunks: DataFrame) -> DataFrame:
    """Most frequent workspace among the five nearest chunks of any workspace; ties go to the nearer one."""
    asked = questions.select("query_id", F.col("q_vector").alias("embedding"))
    near = knn_join(asked, chunks.select("chunk_id", "embedding"), 5, [], "query_id", "chunk_id").withColumnRenamed(
        "rank", "candidate_rank").join(chunks.select("chunk_id", "workspace_id"), "chunk_id")
    counted = near.groupBy("query_id", "workspace_id").agg(
        F.count(F.lit(1)).alias("n"), F.min("candidate_rank").alias("first"))
    return counted.groupBy("query_id").agg(
        F.max_by("workspace_id", F.struct("n", -F.col("first"))).alias("workspace_id"))


def related_events(questions: DataFrame, events: DataFrame, event_limit: int = 10, per_entity: int = 10) -> DataFrame:
    """Events near a question: by vector, and the latest per wanted entity; the first list wins.

    Feature limits: the `event_limit` nearest and the `per_entity` latest of each entity.
    """
    vectored = events.filter(F.col("embedding").isNotNull())
    semantic = filtered_knn(questions, vectored, event_limit, "event_id").select(
        "query_id", "workspace_id", "event_id", F.round("cosine", 4).alias("score"), F.lit(0).alias("list"))
    named = events.select("workspace_id", "event_id", "ts", F.explode(F.array_distinct("entities")).alias("entity"))
    w = Window.partitionBy("workspace_id", "entity").orderBy(F.desc_nulls_last("ts"), "event_id")
    latest = named.withColumn("r", F.row_number().over(w)).filter(F.col("r") <= per_entity)
    asked = questions.select("query_id", "workspace_id", F.explode("q_entities").alias("entity"))
    relational = asked.join(latest, ["workspace_id", "entity"]).select(
        "query_id", "workspace_id", "event_id", F.lit(None).cast("double").alias("score"), F.lit(1).alias("list")).distinct()
    merged = keep_by(semantic.unionByName(relational), ["query_id", "workspace_id", "event_id"], ["list"], newest=False)
    return merged.drop("list").join(events.drop("embedding"), ["workspace_id", "event_id"])


def search_events(questions: DataFrame, events: DataFrame, limit: int = 10) -> DataFrame:
    """The `limit` events nearest to each question in its workspace, of its types and inside its time range.

    questions are prepared ones with q_types, a list of event types; a null one admits all.
    """
    wanted = (F.col("q_types").isNull() | F.array_contains("q_types", F.col("event_type"))) & (
        F.col("q_start").isNull() | (F.col("ts") >= F.col("q_start"))) & (F.col("q_end").isNull() | (F.col("ts") <= F.col("q_end")))
    return filtered_knn(questions, events.filter(F.col("embedding").isNotNull()), limit, "event_id", conditions=wanted)


def newest_first(mixed: DataFrame) -> DataFrame:
    """Each question's chunks and events in one list, the newest first and undated last; a list is bounded by its search limits."""
    w = Window.partitionBy("query_id").orderBy(F.desc_nulls_last("ts"), "type", "id")
    return mixed.withColumn("rank", F.row_number().over(w))


def with_texts(hits: DataFrame, texts: DataFrame) -> DataFrame:
    """Hits with their text, found by chunk and digest; texts are scanned in place while the hits are few, and no other text travels."""
    keys = ["workspace_id", "chunk_id", "text_key"]
    wanted = broadcast_if_small(hits.select(*keys).distinct())
    found = texts.select(*keys, "text").join(wanted, keys, "left_semi").dropDuplicates(keys)
    return hits.join(found, keys, "left")


def evidence(
    questions: DataFrame, chunks: DataFrame, events: DataFrame, correlations: DataFrame, as_of: Column, limit: int = 10,
    texts: DataFrame | None = None,
) -> dict[str, DataFrame]:
    """Chunks, events, correlations and the mixed newest-first list for every question.

    Texts lie in the chunks, or in a table of workspace_id, chunk_id, text_key and text;
    chunks then carry text_key, a digest of the text.
    """
    doubled = questions.withColumn("limit", F.lit(limit * 2))
    prepared = prepare_questions(doubled, as_of)
    # At most 2 * limit rows per question, read by four branches below.
    hits = cut_lineage(hybrid_search(doubled, chunks, correlations, as_of))
    if texts is not None:
        hits = cut_lineage(with_texts(hits, texts))
    found = related_events(prepared, events, limit)

    linked = hits.select("query_id", "workspace_id", "chunk_id").join(by_source(correlations), ["workspace_id", "chunk_id"])
    pairs = keep_by(
        linked.withColumns({"lo": F.least("chunk_id", "related_id"), "hi": F.greatest("chunk_id", "related_id")}),
        ["query_id", "workspace_id", "lo", "hi", "type"], ["chunk_id"], newest=False)
    ends = F.explode(F.array("lo", "hi"))
    inside = hits.select("query_id", F.col("chunk_id"))
    both = pairs.join(inside.withColumnRenamed("chunk_id", "lo"), ["query_id", "lo"], "left_semi").join(
        inside.withColumnRenamed("chunk_id", "hi"), ["query_id", "hi"], "left_semi")
    boosts = both.select("query_id", ends.alias("chunk_id")).groupBy("query_id", "chunk_id").agg(
        (F.count(F.lit(1)) * 0.05).alias("aggregation_boost"))

    best = keep_by(
        hits, ["query_id", F.sha2(text.collapse(F.col("text")), 256).alias("_digest")], ["rank"], newest=False)
    raised = best.join(boosts, ["query_id", "chunk_id"], "left").withColumn(
        "aggregation_boost", F.coalesce("aggregation_boost", F.lit(0.0))
    ).withColumn("search_rank", F.col("rank")).withColumn(
        "score", F.round(F.col("score") + F.least("aggregation_boost", F.lit(0.15)), 4))
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "search_rank")
    final = raised.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= limit)

    mixed = final.select(
        "query_id", F.lit("chunk").alias("type"), F.col("chunk_id").alias("id"), "source", "ts", "score",
        F.col("text").alias("content"), "entities",
    ).unionByName(found.select(
        "query_id", F.lit("event").alias("type"), F.col("event_id").alias("id"),
        F.coalesce(F.try_element_at("source_refs", F.lit(1)), F.lit("system")).alias("source"), "ts",
        F.coalesce("score", F.lit(0.8)).alias("score"), F.col("summary").alias("content"), "entities"))
    return {"questions": prepared, "chunks": final, "events": found, "correlations": pairs.drop("lo", "hi"), "timeline": newest_first(mixed)}


def day_groups(hits: DataFrame, events: DataFrame, limit_days: int = 10) -> DataFrame:
    """Hits and events of a question counted by day, the newest days first."""
    rows = hits.select("query_id", F.to_date("ts").alias("day"), F.lit(1).alias("d"), F.lit(0).alias("e")).unionByName(
        events.select("query_id", F.to_date("ts").alias("day"), F.lit(0).alias("d"), F.lit(1).alias("e")))
    days = rows.filter(F.col("day").isNotNull()).groupBy("query_id", "day").agg(
        F.sum("d").alias("documents"), F.sum("e").alias("events"))
    w = Window.partitionBy("query_id").orderBy(F.desc("day"))
    return days.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= limit_days)


def evaluate(hits: DataFrame, judgments: DataFrame) -> DataFrame:
    """Precision and recall of each question's hits against judged relevant chunks."""
    relevant = judgments.groupBy("query_id").agg(F.count(F.lit(1)).alias("relevant"))
    judged = hits.join(judgments.select("query_id", "chunk_id", F.lit(1).alias("_good")), ["query_id", "chunk_id"], "left")
    per = judged.groupBy("query_id").agg(F.count(F.lit(1)).alias("returned"), F.count("_good").alias("found"))
    return relevant.join(per, "query_id", "left").select(
        "query_id", "relevant", F.coalesce("returned", F.lit(0)).alias("returned"), F.coalesce("found", F.lit(0)).alias("found"),
        F.round(F.coalesce(F.col("found") / F.col("returned"), F.lit(0.0)), 6).alias("precision"),
        F.round(F.coalesce(F.col("found") / F.col("relevant"), F.lit(0.0)), 6).alias("recall"))
