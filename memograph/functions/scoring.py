"""Vector and ranking expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from memograph import vocab
from memograph.functions.text import let


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(
        F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v
    )


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    scale = norm(a) * norm(b)
    return F.when(scale == 0, 0.0).otherwise(dot(a, b) / scale)


def unit(a: Column) -> Column:
    """Vector scaled to length one; zero vectors stay zero."""
    return let(norm(a), lambda size: F.transform(a, lambda x: F.when(size == 0, 0.0).otherwise(x.cast("double") / size)))


def recency_boost(ts: Column, as_of: Column, weight: float = vocab.RECENCY_WEIGHT) -> Column:
    days = F.greatest(F.floor((F.unix_micros(as_of) - F.unix_micros(ts)) / F.lit(86_400_000_000)), F.lit(0))
    return F.when(ts.isNull(), 0.0).otherwise(F.exp(-vocab.RECENCY_DECAY * days) * weight)


def hierarchy_boost(hierarchy: Column, scope: Column, weight: float = vocab.HIERARCHY_WEIGHT) -> Column:
    parts = F.size(scope)
    prefix = F.slice(hierarchy, F.lit(1), F.greatest(parts, F.lit(0))) == scope
    return (
        F.when(scope.isNull() | (parts == 0), 0.0)
        .when(prefix, weight)
        .when(F.arrays_overlap(hierarchy, scope), weight * 0.4)
        .otherwise(0.0)
    )


def entity_boost(entities: Column, wanted: Column, weight: float = vocab.ENTITY_WEIGHT) -> Column:
    shared = F.coalesce(F.size(F.array_intersect(entities, wanted)), F.lit(0))
    return F.least(shared / 3.0, F.lit(1.0)) * weight


def source_boost(source: Column, weights: dict[str, float] | None = None) -> Column:
    out = F.lit(0.0)
    for name, value in (weights or vocab.SOURCE_WEIGHTS).items():
        out = F.when(source == name, float(value)).otherwise(out)
    return out


def proximity_step(us_a: Column, us_b: Column) -> Column:
    """1.0 within an hour, 0.5 within a day, 0.2 within a week, else 0."""
    gap = F.abs(us_a - us_b)
    return F.coalesce(
        F.when(gap <= 3_600_000_000, 1.0)
        .when(gap <= 86_400_000_000, 0.5)
        .when(gap <= 604_800_000_000, 0.2)
        .otherwise(0.0),
        F.lit(0.0),
    )


def correlation_score(cos: Column, overlap: Column, proximity: Column, cross: Column) -> Column:
    base = cos * 0.40 + overlap * 0.30 + proximity * 0.30
    return F.when(cross & (base > 0.5), F.least(base + 0.05, F.lit(1.0))).otherwise(base)


def correlation_reason(shared: Column, us_a: Column, us_b: Column, cos: Column) -> Column:
    gap = F.abs(us_a - us_b)
    parts = F.concat_ws(
        ", ",
        F.when(F.size(shared) > 0,
               F.concat(F.lit("shared entities: "), F.array_join(F.array_sort(shared), ", "))),
        F.when(gap <= 3_600_000_000, F.lit("temporal proximity (< 1 hr)"))
        .when(gap <= 86_400_000_000, F.lit("temporal proximity (< 24 hrs)")),
        F.when(cos > 0.8, F.lit("high semantic similarity")),
    )
    return F.when(parts == "", "semantic overlap").otherwise(parts)


def pattern_confidence(n: Column) -> Column:
    return F.round(F.least(F.lit(0.7) + n * 0.05, F.lit(0.99)), 2)


def issue_confidence(n: Column) -> Column:
    return F.least(F.lit(0.98), F.lit(0.60) + n * 0.12)


def chain_confidence(links: Column, mean_score: Column, has_pattern: Column) -> Column:
    base = F.when(links > 0, F.least(F.lit(0.5) + mean_score * 0.4, F.lit(0.99))).otherwise(0.5)
    return F.round(F.when(has_pattern, F.least(base + 0.1, F.lit(0.99))).otherwise(base), 2)


def answer_confidence(classified: Column, traced: Column) -> Column:
    return F.round(classified * 0.3 + traced * 0.7, 2)
