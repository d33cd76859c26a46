"""Correlations between chunks: similarity, shared entities and closeness in time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from memograph import vocab
from memograph.functions import scoring
from memograph.operators.upsert import both_directions, latest_correlations
from memograph.plans.neighbours import knn_join


def neighbours(chunks: DataFrame, k: int = vocab.CORRELATION_NEIGHBOURS) -> DataFrame:
    """The k nearest chunks of each chunk in its workspace, itself counted but not returned."""
    points = chunks.select("workspace_id", F.col("chunk_id").alias("match_id"), "embedding")
    return knn_join(chunks, points, k, ["workspace_id"], "chunk_id", "match_id").filter("chunk_id <> match_id")


def score(pairs: DataFrame, chunks: DataFrame, threshold: float = vocab.CORRELATION_THRESHOLD) -> DataFrame:
    """Scored directed pairs at or above the threshold; the overlap is relative to the first chunk."""
    traits = ["entities", "ts", "source", "seen_at"]
    own = chunks.select("workspace_id", "chunk_id", *traits)
    other = chunks.select("workspace_id", F.col("chunk_id").alias("match_id"),
                          *[F.col(c).alias(f"match_{c}") for c in traits if c != "seen_at"])
    rows = pairs.join(own, ["workspace_id", "chunk_id"]).join(other, ["workspace_id", "match_id"])
    shared = F.array_intersect("entities", "match_entities")
    mine = F.size(F.array_distinct("entities"))
    overlap = F.when(mine > 0, F.least(F.size(shared) / F.size("entities"), F.lit(1.0))).otherwise(0.0)
    us_a, us_b = F.unix_micros("ts"), F.unix_micros("match_ts")
    cross = ~F.col("source").eqNullSafe(F.col("match_source"))
    combined = scoring.correlation_score(F.col("cosine"), overlap, scoring.proximity_step(us_a, us_b), cross)
    return rows.withColumn("_score", combined).filter(F.col("_score") >= threshold).select(
        "workspace_id", F.col("chunk_id").alias("source_a"), F.col("match_id").alias("source_b"),
        F.when(cross, "cross_source").otherwise("intra_source").alias("type"),
        F.round("_score", 4).alias("score"),
        scoring.correlation_reason(shared, us_a, us_b, F.col("cosine")).alias("reason"), "seen_at")


def correlate(chunks: DataFrame, k: int = vocab.CORRELATION_NEIGHBOURS, threshold: float = vocab.CORRELATION_THRESHOLD) -> DataFrame:
    """One correlation per unordered pair and type, the direction of the later chunk winning.

    `chunks` carries workspace_id, chunk_id, embedding, entities, ts, source and
    seen_at (ingest order).
    """
    return latest_correlations(score(neighbours(chunks, k), chunks, threshold))


def by_source(correlations: DataFrame) -> DataFrame:
    """Correlations seen from either end: (workspace, chunk_id, related_id, ...)."""
    both = both_directions(
        correlations.select("workspace_id", "source_a", "source_b", "type", "score", "reason"), "source_a", "source_b")
    return both.withColumnsRenamed({"source_a": "chunk_id", "source_b": "related_id"})
