"""Document normalization: scope, metadata, length and content filters."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from memograph import vocab
from memograph.functions import text


def workspace_scope(query_scope: Column, target_scope: Column) -> Column:
    """Target scope if given, else the query's, trimmed, else the default workspace."""
    chosen = F.coalesce(F.when(target_scope != "", target_scope), query_scope)
    return F.coalesce(F.nullif(F.trim(chosen), F.lit("")), F.lit(vocab.DEFAULT_WORKSPACE))


def allow_sources(docs: DataFrame, allowed: Sequence[str]) -> DataFrame:
    return docs.filter(F.lower("source").isin([a.lower() for a in allowed])) if allowed else docs


def _column(df: DataFrame, name: str, kind: str = "string") -> Column:
    return F.col(name) if name in df.columns else F.lit(None).cast(kind)


def _first_text(df: DataFrame, names: Sequence[str]) -> Column:
    return F.coalesce(*[F.nullif(_column(df, n), F.lit("")) for n in names])


def standardize(docs: DataFrame, as_of: Column) -> DataFrame:
    """One layout for every connector: source kind, author, time, path parts and team."""
    source = F.coalesce(F.nullif(_column(docs, "source"), F.lit("")), F.lit("unknown"))
    kind = F.coalesce(F.nullif(_column(docs, "source_type"), F.lit("")), F.lit("document"))
    for name, value in vocab.SOURCE_TYPES.items():
        kind = F.when(source == name, value).otherwise(kind)
    times = [_column(docs, n, "timestamp") for n in ("timestamp", "created_time", "last_edited_time", "date")]
    empty = F.array().cast("array<string>")
    parts = F.filter(F.split(_column(docs, "path"), "/"), lambda p: p != "")
    listed = _column(docs, "hierarchy", "array<string>")
    hierarchy = F.when(F.nullif(_column(docs, "path"), F.lit("")).isNotNull(), parts).otherwise(F.coalesce(listed, empty))
    team = F.coalesce(
        F.nullif(_column(docs, "team"), F.lit("")),
        F.when(source == "slack", _column(docs, "channel_name")), F.lit("unknown"),
    )
    new = {
        "source": source, "source_type": kind,
        "workspace_id": F.coalesce(F.nullif(_column(docs, "workspace_id"), F.lit("")), F.lit(vocab.DEFAULT_WORKSPACE)),
        "author": F.coalesce(_first_text(docs, ["author", "created_by", "creator"]), F.lit("unknown")),
        "ts": F.coalesce(*times, as_of), "hierarchy": hierarchy, "team": team,
    }
    kept = [c for c in ("id", "title", "content", "url", "parent_id", "path", "tags", "doc_id", "source_id", "metadata") if c in docs.columns]
    return docs.select(*kept, *[v.alias(k) for k, v in new.items()])


def long_enough(docs: DataFrame, minimum: int = 10) -> DataFrame:
    return docs.filter(F.length(F.coalesce("content", F.lit(""))) >= minimum)


def distinct_content(docs: DataFrame, order: Sequence[str] = ("id",), scope: Sequence[str] = ("workspace_id",)) -> DataFrame:
    """First document of each exact content within its scope (a workspace).

    Only a digest and the order columns travel to decide who stays; a group of
    copies is reduced to one row per task before the shuffle, and the texts move
    once. Rows that are sent again under the same id and content stay once.
    """
    from memograph.operators.upsert import keep_by

    marked = docs.withColumn("_digest", F.sha2(F.coalesce("content", F.lit("")), 256))
    keys = [*scope, "_digest"]
    firsts = marked.groupBy(*keys).agg(F.min(F.struct(*order)).alias("_first")).select(
        *[F.col(c).alias(f"_k{n}") for n, c in enumerate(keys)], *[F.col(f"_first.{c}").alias(f"_o{n}") for n, c in enumerate(order)])
    same = [F.col(c).eqNullSafe(F.col(f"_k{n}")) for n, c in enumerate(keys)] + [
        F.col(c).eqNullSafe(F.col(f"_o{n}")) for n, c in enumerate(order)]
    stays = marked.join(firsts, reduce(and_, same), "left_semi")
    # What is left of a key are rows of one id; the whole row settles which.
    return keep_by(stays, [*keys, *order], [F.to_json(F.struct(*docs.columns))], newest=False).select(*docs.columns)


def distinct_normalized(docs: DataFrame, keys: Sequence[str], content: str, order: Sequence[Column]) -> DataFrame:
    """Best row per text that is equal after lower-casing and collapsing spaces."""
    from memograph.operators.upsert import keep_by

    return keep_by(docs, [*keys, F.sha2(text.collapse(F.col(content)), 256).alias("_digest")], order, newest=False)


def split_valid(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Documents with id, title and content, and the rejected rest with its reasons."""
    def present(c: str) -> Column:
        return F.coalesce(F.col(c) != "", F.lit(False))

    ok = present("id") & present("title") & present("content")
    reasons = F.concat_ws(",", *[F.when(~present(c), F.lit(f"missing {c}")) for c in ("id", "title", "content")])
    return docs.filter(ok), docs.filter(~ok).withColumn("reasons", reasons)


def enrich(docs: DataFrame, fn: Callable[[DataFrame], DataFrame] | None) -> DataFrame:
    """User hook over the whole frame; a column it leaves null falls back to the original value."""
    if fn is None:
        return docs
    changed = fn(docs.select("*", F.struct(*docs.columns).alias("_before")))
    return changed.select(
        *[F.coalesce(F.col(c), F.col(f"_before.{c}")).alias(c) if c in docs.columns else F.col(c)
          for c in changed.columns if c != "_before"]
    )


def normalize(
    docs: DataFrame, minimum: int = 10, drop_copies: bool = True,
    enrichment: Callable[[DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """Length filter, exact de-duplication, enrichment and validation in that order."""
    out = long_enough(docs, minimum)
    if drop_copies:
        out = distinct_content(out)
    return split_valid(enrich(out, enrichment))[0]


def normalization_counts(docs: DataFrame, minimum: int = 10) -> DataFrame:
    """input, filtered, duplicates and output counters in one pass of aggregates; copies count within a workspace."""
    size = F.length(F.coalesce("content", F.lit("")))
    digest = F.sha2(F.coalesce("content", F.lit("")), 256)
    valid = F.coalesce((F.col("id") != "") & (F.col("title") != "") & (F.col("content") != ""), F.lit(False))
    first = docs.select("workspace_id", "id", valid.alias("valid"), (size >= minimum).alias("long"), digest.alias("digest"))
    per_content = first.groupBy("workspace_id", "digest", "long").agg(
        F.count(F.lit(1)).alias("n"), F.min_by("valid", "id").alias("kept_valid"))
    return per_content.agg(
        F.sum("n").alias("input_documents"),
        F.coalesce(F.sum(F.when(~F.col("long"), F.col("n"))), F.lit(0)).alias("filtered"),
        F.coalesce(F.sum(F.when(F.col("long"), F.col("n") - 1)), F.lit(0)).alias("duplicates_removed"),
        F.count_if(F.col("long") & F.col("kept_valid")).alias("output_documents"),
    )


def document_counts(docs: DataFrame) -> DataFrame:
    """Distinct documents per workspace."""
    key = F.coalesce(_column(docs, "source_id"), _column(docs, "url"), F.col("id"))
    return docs.groupBy("workspace_id").agg(F.countDistinct(key).alias("documents"))


def quota(counts: DataFrame, plans: DataFrame, limit: int = vocab.FREE_PLAN_DOCUMENTS) -> DataFrame:
    """Flags free workspaces that already hold the allowed number of documents."""
    return plans.join(counts, "workspace_id", "left").select(
        "workspace_id", "plan", F.coalesce("documents", F.lit(0)).alias("documents"),
        ((F.col("plan") == "free") & (F.coalesce("documents", F.lit(0)) >= limit)).alias("rejected"),
    )


def sync(sources: dict[str, DataFrame], workspace_id: str | None = None) -> DataFrame:
    """Union of all connectors' documents, stamped with their workspace."""
    out = None
    for name, docs in sources.items():
        if "source" not in docs.columns:
            docs = docs.withColumn("source", F.lit(name))
        if workspace_id:
            docs = docs.withColumn("workspace_id", F.lit(workspace_id))
        out = docs if out is None else out.unionByName(docs, allowMissingColumns=True)
    return out


def user_workspaces(users: DataFrame, memberships: DataFrame, workspaces: DataFrame) -> DataFrame:
    """Workspaces each user belongs to."""
    return users.join(memberships, "user_id").join(workspaces, "workspace_id")


def distinct_results(rows: DataFrame, keys: Sequence[str], order: Sequence[str | Column]) -> DataFrame:
    """First row of each combination of shown fields, in the given order."""
    from memograph.operators.upsert import keep_by

    return keep_by(rows, list(keys), order, newest=False)
