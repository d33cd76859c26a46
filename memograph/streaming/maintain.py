"""Derived tables kept in step with ingest: a batch computes only what it touches.

Every table is a list of versions, one folder per batch; the newest version of a key counts,
and a deleted key leaves a marker. A ledger says which batches count: it is written last, so
readers never see half a batch, a batch that failed on its way is simply written again, and
one whose id stands in the ledger changes nothing.

What a batch changes follows from the chunks and events that are new, or differ from the
ones they replace:

* co-occurrence: pairs of new rows are added to their totals; pairs that a replaced row held
  are counted again, over the chunks of their workspace;
* neighbour lists: new against all, the rest against new, and a list that loses a member is
  searched again;
* escalation chains: changed deployments against all events, the other deployments against
  changed events; recurring incidents and spikes of the touched workspaces. Chains grow with
  the square of the events, so a batch writes the two ends of its chains, each end once a side,
  and the pairs are formed when they are read. A chain counts as long as neither of its events
  has a version newer than the batch that wrote it, which is settled on the ends: chains are
  never stored, grouped, compared or marked as deleted.

Workspace and key columns are not null.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from memograph import vocab
from memograph.operators import correlation, entities, patterns
from memograph.operators.upsert import keep_by
from memograph.plans.neighbours import knn_join
from memograph.plans.rangejoin import in_reach
from memograph.sources.sinks import read_table
from memograph.session import cut_lineage

WS = "workspace_id"
KEYS = {"chunks": [WS, "chunk_id"], "events": [WS, "event_id"], "pairs": [WS, "entity_a", "entity_b"],
        "neighbours": [WS, "chunk_id"], "patterns": [WS, "pattern_id"]}
CHUNK_COLUMNS = [WS, "chunk_id", "embedding", "entities", "ts", "source", "seen_at"]
EVENT_COLUMNS = [WS, "event_id", "event_type", "title", "ts", "entities"]
PATTERN_COLUMNS = [WS, "pattern_id", "pattern_type", "name", "description", "severity", "confidence", "entities"]
CHAINS, DEPLOYMENTS, ISSUES, REPLACED = "chains", "chain_deployments", "chain_issues", "replaced_events"
NEAR = "array<struct<away:double,match_id:string>>"


def same_rows(rows: DataFrame, leave: tuple[str, ...] = ()) -> Column:
    """One text that is equal exactly for rows of equal values."""
    return F.to_json(F.struct(*[c for c in rows.columns if c not in leave]), {"ignoreNullFields": "false"})


def paired(starts: DataFrame, ends: DataFrame) -> DataFrame:
    """The chains between the ends that each batch wrote: one end at least is fresh, which is dealt out so that no pair is formed in vain."""
    fresh = F.col("fresh")
    starts = starts.withColumn("side", fresh.cast("int"))
    ends = ends.withColumn("side", F.explode(F.when(fresh, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(1)))))
    return patterns.join_chains(starts.drop("fresh"), ends.drop("fresh"), dealt=("no", "side")).drop("side")


class Store:
    """Versioned keyed tables below a folder, and the ledger of the batches that count."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")

    def ledger(self) -> DataFrame | None:
        return read_table(self.spark, f"{self.path}/ledger")

    def last(self) -> int:
        ledger = self.ledger()
        return 0 if ledger is None else ledger.agg(F.max("no")).first()[0]

    def counts(self, batch_id: str) -> bool:
        ledger = self.ledger()
        return ledger is not None and not ledger.filter(F.col("batch_id") == batch_id).isEmpty()

    def versions(self, table: str) -> DataFrame | None:
        """All versions of the batches that count, deletions included; of chains the pairs of all batches."""
        if table == CHAINS:
            starts, ends = self.versions(DEPLOYMENTS), self.versions(ISSUES)
            return None if starts is None else paired(starts, ends)
        ledger = self.ledger()
        if ledger is None:
            return None
        base, last = ledger.agg(F.max("base"), F.max("no")).first()
        return self.spark.read.parquet(f"{self.path}/{table}").filter(F.col("no").between(base, last))

    def current(self, table: str) -> DataFrame | None:
        found = self.versions(table)
        return None if found is None else keep_by(found, KEYS[table], ["no"], newest=True).filter("NOT gone").drop("no", "gone")

    def write(self, table: str, no: int, rows: DataFrame, gone: DataFrame | None = None) -> DataFrame:
        """The rows as this batch's versions; keys in `gone` are deleted. Returns the rows as they lie."""
        marked = rows.withColumn("gone", F.lit(False))
        if gone is not None:
            marked = marked.unionByName(gone.select(*KEYS[table]).withColumn("gone", F.lit(True)), allowMissingColumns=True)
        folder = f"{self.path}/{table}/no={no}"
        marked.write.mode("overwrite").parquet(folder)
        return self.spark.read.schema(marked.schema).parquet(folder).filter("NOT gone").drop("gone")

    def chains(self) -> DataFrame | None:
        """Chains whose two events have not changed since the batch that wrote them."""
        starts, ends = self.versions(DEPLOYMENTS), self.versions(ISSUES)
        if starts is None:
            return None
        last, keys = self.last(), KEYS["events"]
        moved = self.versions(REPLACED).groupBy(*keys).agg(F.max("no").alias("newest"))

        def standing(rows: DataFrame, end: str) -> DataFrame:
            known = moved.select(F.col(WS).alias("_ws"), F.col("event_id").alias("_end"), "newest")
            older = rows.filter(F.col("no") < last).join(
                known, (F.col(WS) == F.col("_ws")) & (F.col(end) == F.col("_end")) & (F.col("no") < F.col("newest")), "left_anti")
            return rows.filter(F.col("no") == last).unionByName(older)

        return paired(standing(starts, "deployment_id"), standing(ends, "event_id")).drop("no")

    def write_chains(self, no: int, changed: DataFrame, others: DataFrame, replaced: DataFrame) -> None:
        """The ends of the chains that changed events are in, each once, and the keys of the events that were replaced."""
        starts, ends = patterns.chain_deployments(changed), patterns.chain_issues(changed)
        width = patterns.CHAIN_MINUTES * patterns.MINUTE_US
        met = in_reach(patterns.chain_issues(others), "ts", starts, "deployed_at", [WS], width, after=True)
        meeting = in_reach(patterns.chain_deployments(others), "deployed_at", ends, "ts", [WS], width, after=False)
        for table, fresh, stale in ((DEPLOYMENTS, starts, meeting), (ISSUES, ends, met)):
            rows = fresh.withColumn("fresh", F.lit(True)).unionByName(stale.withColumn("fresh", F.lit(False)))
            rows.write.mode("overwrite").parquet(f"{self.path}/{table}/no={no}")
        replaced.select(*KEYS["events"]).write.mode("overwrite").parquet(f"{self.path}/{REPLACED}/no={no}")

    def commit(self, batch_id: str, no: int, base: int = 0) -> None:
        row = self.spark.createDataFrame([(no, batch_id, base)], "no int, batch_id string, base int")
        row.coalesce(1).write.mode("append").parquet(f"{self.path}/ledger")

    def compact(self) -> None:
        """Fold all versions into one; the folders before it may then be deleted."""
        no = self.last() + 1
        for table in KEYS:
            self.write(table, no, self.current(table))
        events = self.current("events")
        none = events.limit(0)
        self.write_chains(no, events, none, none)
        self.commit(f"compacted-{no}", no, base=no)


def changes(incoming: DataFrame, held: DataFrame | None, keys: list[str]) -> tuple[DataFrame, DataFrame | None]:
    """Incoming rows that are new or differ from the held ones, and the held rows they replace."""
    if held is None:
        return incoming, None
    before = held.select(*keys, same_rows(held.select(*incoming.columns)).alias("_held"))
    differ = incoming.join(before, keys, "left").filter(F.col("_held").isNull() | (F.col("_held") != same_rows(incoming)))
    changed = cut_lineage(differ.select(*incoming.columns))
    return changed, cut_lineage(held.select(*incoming.columns).join(changed.select(*keys), keys, "left_semi"))


def touched_rows(held: DataFrame | None, changed: DataFrame, keys: list[str]) -> DataFrame:
    """All rows of the workspaces that the changed rows lie in, as they are after the batch."""
    if held is None:
        return changed
    there = held.select(*changed.columns).join(changed.select(WS).distinct(), WS, "left_semi")
    return cut_lineage(there.join(changed.select(*keys), keys, "left_anti").unionByName(changed))


def merged_rows(incoming: DataFrame, versions: DataFrame | None, keys: list[str]) -> DataFrame:
    """`changes` and `touched_rows` in one pass, for tables whose replaced rows nobody asks for.

    The rows of all workspaces that a new or differing row lies in, as they are after the batch.
    `fresh` marks the rows that are new or differ, `again` those of them that replace a held one.
    """
    if versions is None:
        return incoming.withColumns({"fresh": F.lit(True), "again": F.lit(False)})
    row = F.struct(*incoming.columns)
    there = versions.join(incoming.select(WS).distinct(), WS, "left_semi")
    # Grouped under the key's own columns, so the join needs no further shuffle of the held rows.
    held = there.groupBy(*keys).agg(F.max_by(F.struct(row.alias("row"), "gone"), "no").alias("_held"))
    old = held.filter("NOT _held.gone").select(*keys, F.col("_held.row").alias("_old"))
    both = incoming.select(*keys, row.alias("_new")).join(old, keys, "full")
    fresh = F.col("_new").isNotNull() & ~F.col("_new").eqNullSafe(F.col("_old"))
    merged = cut_lineage(both.select(
        F.when(fresh, F.col("_new")).otherwise(F.coalesce("_old", "_new")).alias("_row"), fresh.alias("fresh"),
        (fresh & F.col("_old").isNotNull()).alias("again")).select("_row.*", "fresh", "again"))
    touched = cut_lineage(merged.filter("fresh").select(F.col(WS).alias("_ws")).distinct())
    return merged.join(touched, F.col(WS).eqNullSafe(F.col("_ws")), "left_semi")


class Maintained:
    """Chunks and events with their pairs, neighbour lists, correlations and patterns.

    `k` is the length of a neighbour list, which counts the chunk itself, and `as_of` the
    time that patterns look back from; batches of one store use the same values.
    """

    def __init__(self, spark: SparkSession, path: str, as_of: Column, k: int = vocab.CORRELATION_NEIGHBOURS) -> None:
        self.store, self.as_of, self.k = Store(spark, path), as_of, k

    def apply(self, batch_id: str, chunks: DataFrame, events: DataFrame) -> bool:
        """Take in a batch of chunks and events; False if it was taken in before."""
        store = self.store
        if store.counts(batch_id):
            return False
        no = store.last() + 1
        held = {table: store.current(table) for table in KEYS}
        # One row per key of a batch: the last one seen, the largest of rows seen at once.
        chunks = chunks.select(*CHUNK_COLUMNS)
        incoming = cut_lineage(keep_by(chunks, KEYS["chunks"], ["seen_at", same_rows(chunks)], newest=True))
        changed, replaced = changes(incoming, held["chunks"], KEYS["chunks"])
        changed = store.write("chunks", no, changed)
        after = touched_rows(held["chunks"], changed, KEYS["chunks"])
        self._pairs(no, held["pairs"], changed, replaced, after)
        self._neighbours(no, held["neighbours"], changed, replaced, after)
        events = events.select(*EVENT_COLUMNS)
        news = cut_lineage(keep_by(events, KEYS["events"], [same_rows(events)], newest=True))
        after = merged_rows(news, store.versions("events"), KEYS["events"])
        moved = store.write("events", no, after.filter("fresh").select(*EVENT_COLUMNS))
        self._patterns(no, held["patterns"], moved, after)
        store.commit(batch_id, no)
        return True

    def _pairs(self, no: int, held: DataFrame | None, changed: DataFrame, replaced: DataFrame | None, after: DataFrame) -> None:
        keys = KEYS["pairs"]
        added = entities.cooccurrence(changed)
        if held is None:
            self.store.write("pairs", no, added)
            return
        lost = cut_lineage(entities.cooccurrence(replaced).select(*keys))
        known = held.join(added.select(*keys), keys, "left_semi").unionByName(added).join(lost, keys, "left_anti")
        summed = known.groupBy(*keys).agg(F.sum("score").alias("score"), F.max("last_seen").alias("last_seen"))
        again = after.join(lost.select(WS).distinct(), WS, "left_semi")
        counted = cut_lineage(entities.cooccurrence(again).join(lost, keys, "left_semi"))
        self.store.write("pairs", no, summed.unionByName(counted), gone=lost.join(counted, keys, "left_anti"))

    def _neighbours(self, no: int, held: DataFrame | None, changed: DataFrame, replaced: DataFrame | None, after: DataFrame) -> None:
        keys, ids = KEYS["neighbours"], changed.select(*KEYS["neighbours"])

        def near(asking: DataFrame, points: DataFrame) -> DataFrame:
            found = points.select(WS, F.col("chunk_id").alias("match_id"), "embedding")
            return knn_join(asking, found, self.k, [WS], "chunk_id", "match_id").select(*keys, (-F.col("cosine")).alias("away"), "match_id")

        def lists(entries: DataFrame) -> DataFrame:
            """The k best of at most 2 * k entries of each chunk."""
            ordered = F.array_sort(F.collect_set(F.struct("away", "match_id")))
            return entries.groupBy(*keys).agg(F.slice(ordered, 1, self.k).cast(NEAR).alias("near"))

        if held is None:
            self.store.write("neighbours", no, lists(near(changed, after)))
            return
        kept = cut_lineage(held.join(changed.select(WS).distinct(), WS, "left_semi").join(ids, keys, "left_anti"))
        entries = kept.select(*keys, F.explode("near").alias("e")).select(*keys, "e.away", "e.match_id")
        gone = replaced.select(WS, F.col("chunk_id").alias("match_id"))
        broken = cut_lineage(entries.join(gone, [WS, "match_id"], "left_semi").select(*keys).distinct())
        searched = after.join(ids.unionByName(broken), keys, "left_semi")
        others = after.join(ids.unionByName(broken), keys, "left_anti")
        closer = cut_lineage(near(others, changed))
        fresh = cut_lineage(lists(near(searched, after)))
        old = entries.join(closer.select(*keys).distinct(), keys, "left_semi")
        merged = lists(old.unionByName(closer)).join(kept.withColumnRenamed("near", "_before"), keys, "left").filter(
            ~F.col("near").eqNullSafe(F.col("_before"))).drop("_before")
        self.store.write("neighbours", no, fresh.unionByName(merged), gone=ids.join(fresh, keys, "left_anti"))

    def _patterns(self, no: int, held: DataFrame | None, changed: DataFrame, after: DataFrame) -> None:
        keys = KEYS["patterns"]
        self.store.write_chains(no, changed, after.filter("NOT fresh"), after.filter("again"))
        found = cut_lineage(patterns.recurring_incidents(after, self.as_of).select(*PATTERN_COLUMNS).unionByName(
            patterns.frequency_spikes(after, self.as_of).select(*PATTERN_COLUMNS)))
        if held is None:
            self.store.write("patterns", no, found)
            return
        looked = held.join(changed.select(WS).distinct(), WS, "left_semi").select(*keys)
        self.store.write("patterns", no, found, gone=looked.distinct().join(found, keys, "left_anti"))

    def chunks(self) -> DataFrame:
        return self.store.current("chunks")

    def events(self) -> DataFrame:
        return self.store.current("events")

    def cooccurrence(self) -> DataFrame:
        return self.store.current("pairs")

    def patterns(self) -> DataFrame:
        whole = self.store.current("patterns").select(*PATTERN_COLUMNS)
        return whole.unionByName(patterns.chain_patterns(self.store.chains()).select(*PATTERN_COLUMNS)).withColumn("last_detected", self.as_of)

    def neighbours(self) -> DataFrame:
        """(workspace, chunk, match, cosine): each chunk's list without itself."""
        listed = self.store.current("neighbours").select(WS, "chunk_id", F.explode("near").alias("e"))
        return listed.select(WS, "chunk_id", F.col("e.match_id").alias("match_id"), (-F.col("e.away")).alias("cosine")).filter("chunk_id <> match_id")

    def correlations(self) -> DataFrame:
        """Correlations of the listed pairs; no vector is searched for them."""
        chunks = self.chunks()
        return correlation.latest_correlations(correlation.score(self.neighbours(), chunks))


def batch_writer(maintained: Maintained, process: Callable[[DataFrame], tuple[DataFrame, DataFrame]]) -> Callable[[DataFrame, int], None]:
    """foreachBatch body: the stream's own epoch names the batch, so a replayed one changes nothing."""

    def write(batch: DataFrame, epoch: int) -> None:
        chunks, events = process(batch)
        maintained.apply(f"epoch-{epoch}", chunks, events)

    return write
