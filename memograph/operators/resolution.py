"""Entity resolution: exact, alias, token overlap, then name vectors."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from memograph import vocab
from memograph.functions import text
from memograph.plans.neighbours import knn_join
from memograph.session import cut_lineage

BLOCK = ["workspace_id", "type"]
#: Most names that one task embeds.
NAMES_A_TASK = 20_000


def _token_sets(rows: DataFrame) -> DataFrame:
    """Token set of each name with its tokens in rare-first order.

    Rare tokens first keeps the prefix groups of the overlap join small.
    """
    sets = rows.withColumn("tokens", F.array_sort(text.tokens(F.col("name"))))
    return sets.withColumn("set_key", F.array_join("tokens", " "))


def _rare_first(sets: DataFrame) -> DataFrame:
    frequency = sets.select(*BLOCK, F.explode("tokens").alias("token")).groupBy(*BLOCK, "token").agg(
        F.count(F.lit(1)).alias("f"))
    ordered = (
        sets.select(*BLOCK, "set_key", F.explode("tokens").alias("token"))
        .join(frequency, [*BLOCK, "token"])
        .groupBy(*BLOCK, "set_key").agg(F.array_sort(F.collect_list(F.struct("f", "token"))).alias("by_rarity"))
    )
    return ordered.select(*BLOCK, "set_key", F.transform("by_rarity", lambda t: t["token"]).alias("tokens"))


def _keys(sets: DataFrame, threshold: float) -> DataFrame:
    """(set, own size, partner size, key): sets that reach the threshold share such a key.

    For each partner size in reach, the needed overlap leaves only the first few
    rare tokens to agree on. Where the needed overlap is the whole set, the key
    is the set itself, so equal short names never meet through a common token.
    """
    n = F.size("tokens")
    partners = F.sequence(F.ceil(n * threshold - 1e-9).cast("int"), F.floor(n / threshold + 1e-9).cast("int"))
    sized = sets.select(*BLOCK, "set_key", "tokens", n.alias("own"), F.explode(partners).alias("partner"))
    need = F.ceil((F.col("own") + F.col("partner")) * (threshold / (1 + threshold)) - 1e-9).cast("int")
    whole = (need >= F.col("own")) & (F.col("own") == F.col("partner"))
    heads = F.slice("tokens", F.lit(1), F.greatest(F.col("own") - need + 1, F.lit(0)))
    keys = F.when(whole, F.array(F.concat(F.lit("="), "set_key"))).otherwise(heads)
    return sized.select(*BLOCK, "set_key", "tokens", "own", "partner", F.explode(keys).alias("key"))


def similar_sets(left: DataFrame, right: DataFrame, threshold: float = vocab.JACCARD_THRESHOLD) -> DataFrame:
    """Pairs of distinct token sets with Jaccard similarity at or above the threshold, exactly.

    Both sides must be ordered by one token order, so they are ordered together.
    """
    union = left.select(*BLOCK, "set_key", "tokens").unionByName(right.select(*BLOCK, "set_key", "tokens")).distinct()
    ordered = cut_lineage(_rare_first(union.filter(F.size("tokens") > 0)))
    keyed = _keys(ordered, threshold)
    a = keyed.join(left.select(*BLOCK, "set_key").distinct(), [*BLOCK, "set_key"], "left_semi").select(
        *BLOCK, "key", "own", "partner", F.col("set_key").alias("left_set"), F.col("tokens").alias("left_tokens"))
    b = keyed.join(right.select(*BLOCK, "set_key").distinct(), [*BLOCK, "set_key"], "left_semi").select(
        *BLOCK, "key", F.col("own").alias("partner"), F.col("partner").alias("own"), F.col("set_key").alias("right_set"),
        F.col("tokens").alias("right_tokens"))
    shared = F.size(F.array_intersect("left_tokens", "right_tokens"))
    # Both sides are distinct tokens, so the union follows from the sizes.
    pairs = a.join(b, [*BLOCK, "key", "own", "partner"]).withColumn("shared", shared).withColumn(
        "score", F.col("shared") / (F.col("own") + F.col("partner") - F.col("shared")))
    return pairs.filter(F.col("score") >= threshold).select(*BLOCK, "left_set", "right_set", "score").distinct()


def embedded(rows: DataFrame, name: str, embed: Callable[[Column], Column]) -> DataFrame:
    """Rows with their name's vector: each distinct name is embedded once, by as many tasks as the names need.

    Files of short names are few, and a filter on the vector would embed the rows that a name comes from.
    """
    distinct = cut_lineage(rows.select(name).distinct())
    tasks = max(-(-distinct.count() // NAMES_A_TASK), 1)
    vectors = cut_lineage(distinct.repartition(tasks).withColumn("embedding", embed(F.col(name))))
    return rows.join(vectors.withColumnRenamed(name, "_name"), F.col(name).eqNullSafe(F.col("_name"))).drop("_name")


def resolve(
    names: DataFrame, entities: DataFrame, embed: Callable[[Column], Column] | None = None,
    jaccard: float = vocab.JACCARD_THRESHOLD, cosine: float = vocab.NAME_COSINE_THRESHOLD,
) -> DataFrame:
    """Match names (workspace_id, type, name) to stored entities; unmatched names have a null entity.

    Each stage sees only what the stages before left over. Every candidate is
    considered, and ties go to the first entity by name and id.
    """
    # Written once: every stage reads both, and no stage's filter may reach below what made them.
    wanted = cut_lineage(names.select(*BLOCK, F.trim("name").alias("name")).filter(F.col("name") != "").distinct())
    nodes = cut_lineage(entities.select(*BLOCK, "entity_id", F.col("name").alias("entity_name"), "aliases"))
    first = F.struct("entity_name", "entity_id")

    def picked(rows: DataFrame, stage: str) -> DataFrame:
        return rows.groupBy(*BLOCK, "name").agg(F.min_by("entity_id", first).alias("entity_id")).withColumn(
            "stage", F.lit(stage))

    def left_over(rows: DataFrame, done: DataFrame) -> DataFrame:
        return rows.join(done.select(*BLOCK, "name"), [*BLOCK, "name"], "left_anti")

    exact = picked(wanted.withColumn("k", F.lower("name")).join(
        nodes.withColumn("k", F.lower("entity_name")), [*BLOCK, "k"]), "exact")
    rest = left_over(wanted, exact)
    listed = nodes.select(*BLOCK, "entity_id", "entity_name", F.explode(F.transform("aliases", lambda a: F.lower(F.trim(a)))).alias("k"))
    alias = picked(rest.withColumn("k", F.lower("name")).join(listed, [*BLOCK, "k"]), "alias")
    rest = left_over(rest, alias)

    # Written once: each is read by several branches of the overlap join.
    name_sets = cut_lineage(_token_sets(rest))
    node_sets = cut_lineage(_token_sets(nodes.withColumn("name", F.col("entity_name"))))
    pairs = similar_sets(name_sets, node_sets, jaccard).select(*BLOCK, "left_set", "right_set", "score")
    empty = name_sets.filter(F.col("set_key") == "").select(
        *BLOCK, F.lit("").alias("left_set"), F.lit("").alias("right_set"), F.lit(1.0).alias("score")).distinct()
    scored = (
        name_sets.select(*BLOCK, "name", F.col("set_key").alias("left_set"))
        .join(pairs.unionByName(empty), [*BLOCK, "left_set"])
        .join(node_sets.select(*BLOCK, "entity_id", "entity_name", F.col("set_key").alias("right_set")), [*BLOCK, "right_set"])
    )
    overlap = scored.groupBy(*BLOCK, "name").agg(
        F.min_by("entity_id", F.struct(-F.col("score"), "entity_name", "entity_id")).alias("entity_id")
    ).withColumn("stage", F.lit("overlap"))
    done = exact.unionByName(alias).unionByName(overlap)
    if embed is not None:
        rest = left_over(name_sets.select(*BLOCK, "name"), overlap)
        keyed = nodes.withColumn("key", F.concat_ws("\u0001", "entity_name", F.col("entity_id").cast("string")))
        near = knn_join(embedded(rest, "name", embed), embedded(keyed, "entity_name", embed), 1, BLOCK, "name", "key").filter(
            F.col("cosine") >= cosine)
        done = done.unionByName(near.join(keyed.select(*BLOCK, "key", "entity_id"), [*BLOCK, "key"]).select(
            *BLOCK, "name", "entity_id", F.lit("vector").alias("stage")))
    return wanted.join(done, [*BLOCK, "name"], "left").withColumn("stage", F.coalesce("stage", F.lit("new")))


def components(pairs: DataFrame, a: str, b: str, max_rounds: int = 50) -> DataFrame:
    """Smallest reachable id per node of an undirected relation, by label propagation.

    Labels are written after each round; with pointer jumping the rounds grow
    with the logarithm of a chain's length.
    """
    both = pairs.select(F.col(a).alias("x"), F.col(b).alias("y")).union(pairs.select(F.col(b).alias("x"), F.col(a).alias("y")))
    both = cut_lineage(both.filter("x <> y").distinct())
    labels = cut_lineage(both.select(F.col("x").alias("id")).distinct().withColumn("label", F.col("id")))
    for _ in range(max_rounds):
        offers = both.join(labels.select(F.col("id").alias("y"), "label"), "y").select(F.col("x").alias("id"), "label")
        lower = offers.unionByName(labels).groupBy("id").agg(F.min("label").alias("label"))
        jump = lower.select(F.col("id").alias("label"), F.col("label").alias("jumped"))
        nxt = cut_lineage(lower.join(jump, "label", "left").select("id", F.least("label", F.coalesce("jumped", "label")).alias("label")))
        moved = nxt.join(labels.withColumnRenamed("label", "before"), "id").filter("label <> before").limit(1).count()
        labels = nxt
        if moved == 0:
            return labels
    raise RuntimeError("components did not settle; raise max_rounds")


def canonical_names(mentions: DataFrame, threshold: float = vocab.JACCARD_THRESHOLD) -> DataFrame:
    """Batch resolution of mentions among themselves: one canonical entity per group of similar names.

    Names equal without case are one node; nodes with equal or similar token
    sets join one component; the earliest mention names it.
    """
    nodes = mentions.groupBy(*BLOCK, F.lower(F.trim("name")).alias("name_key")).agg(
        F.min_by("name", F.struct("seen_at", "name")).alias("name"), F.min("seen_at").alias("seen_at"))
    sets = cut_lineage(_token_sets(nodes))
    pairs = similar_sets(sets, sets, threshold).filter("left_set < right_set")
    ident = lambda c: F.md5(F.concat_ws("|", *BLOCK, c))
    links = components(pairs.select(ident("left_set").alias("l"), ident("right_set").alias("r")), "l", "r")
    labelled = sets.withColumn("set_id", ident("set_key")).join(
        links.withColumnRenamed("id", "set_id"), "set_id", "left").withColumn("group_id", F.coalesce("label", "set_id"))
    heads = labelled.groupBy(*BLOCK, "group_id").agg(
        F.min_by("name", F.struct("seen_at", "name_key")).alias("canonical_name"),
        F.min_by("name_key", F.struct("seen_at", "name_key")).alias("canonical_key"))
    return labelled.join(heads, [*BLOCK, "group_id"]).select(
        *BLOCK, "name_key", "name", "canonical_name",
        F.md5(F.concat_ws("|", *BLOCK, "canonical_key")).alias("entity_id"))


def build_graph(mentions: DataFrame, threshold: float = vocab.JACCARD_THRESHOLD) -> tuple[DataFrame, DataFrame]:
    """Canonical entities with aliases, and chunk references, from typed mentions.

    Mentions carry workspace_id, chunk_id, position, name, type and seen_at.
    Unknown types are stored as documents and names shorter than two letters
    are no entities.
    """
    from memograph.operators.upsert import entity_refs

    checked = mentions.withColumn("type", text.entity_type_or_document(F.col("type"))).withColumn(
        "name", text.entity_name_or_null(F.col("name"))).filter(F.col("name").isNotNull())
    # Written once: mentions are found in texts, and both the names and the references read them.
    checked = cut_lineage(checked)
    canon = cut_lineage(canonical_names(checked, threshold))
    by_key = checked.withColumn("name_key", F.lower(F.trim("name"))).join(
        canon.select(*BLOCK, "name_key", "entity_id", "canonical_name"), [*BLOCK, "name_key"])
    aliases = canon.groupBy(*BLOCK, "entity_id", "canonical_name").agg(F.array_sort(F.collect_set("name")).alias("aliases"))
    sources = by_key.groupBy("entity_id").agg(F.min_by("chunk_id", F.struct("seen_at", "chunk_id")).alias("source_chunk_id"))
    nodes = aliases.join(sources, "entity_id").withColumnRenamed("canonical_name", "name")
    refs = entity_refs(by_key.withColumn("mention_text", F.col("name")))
    return nodes, refs


def build_edges(edges: DataFrame, canon: DataFrame) -> DataFrame:
    """Edges named by (source, target) become entity edges, merged by key."""
    from memograph.operators.upsert import upsert_edges

    names = canon.groupBy("workspace_id", "name_key").agg(F.min("entity_id").alias("entity_id"))
    src = names.select("workspace_id", F.col("name_key").alias("s"), F.col("entity_id").alias("source_id"))
    dst = names.select("workspace_id", F.col("name_key").alias("t"), F.col("entity_id").alias("target_id"))
    pointed = edges.withColumns({"s": F.lower("source"), "t": F.lower("target")}).join(
        src, ["workspace_id", "s"]).join(dst, ["workspace_id", "t"])
    return upsert_edges(pointed, ["workspace_id", "source_id", "target_id", "relationship_type"])
