"""Streams against their batch twins, and repeatable keyed writes."""

from datetime import datetime, timedelta
from types import SimpleNamespace

import pandas as pd
import pytest
from pyspark.sql import functions as F

from memograph import adapters as A
from memograph.catalog import chat, streams
from memograph.operators import patterns
from memograph.session import run_folder
from memograph.sources import documents, sinks
from memograph.streaming import detectors, ingest, runner, webhooks, workflows

SF = "/root/testdata/sf0.001"
LOG = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def stream(spark):
    return A.shape_events(spark.readStream.schema(LOG).option("pathGlobFilter", "events.parquet").parquet(SF))


def shuffled_log(spark, folder):
    """The event log in time order, cut into many small files, one per trigger."""
    ordered = spark.read.schema(LOG).parquet(f"{SF}/events.parquet").orderBy("ts").collect()
    for i in range(0, len(ordered), 150):
        spark.createDataFrame(ordered[i:i + 150], LOG).coalesce(1).write.mode("append").parquet(folder)
    return A.shape_events(spark.readStream.schema(LOG).option("maxFilesPerTrigger", 1).parquet(folder))


@pytest.mark.parametrize("made, judged", [
    (detectors.frequency_hours, detectors.spikes_by_hour), (detectors.recurring_hours, detectors.recurring_by_hour)])
def test_hourly_results_do_not_depend_on_batches(spark, tmp_path, made, judged):
    whole = judged(runner.run_to_table(made(stream(spark)), "whole"))
    cut = judged(runner.run_to_table(made(shuffled_log(spark, str(tmp_path / "log"))), "cut"))
    rows = sorted(map(tuple, whole.collect()))
    assert rows and rows == sorted(map(tuple, cut.collect()))


def test_sessions_of_the_whole_log(spark, tmp_path):
    """Open sessions count too, and a session that a later row joins to another is not left behind."""
    base, schema = datetime(2024, 1, 1), "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
    minutes = [0, 20, 40, 160, 180, 110, 2000, 2010, 5000]
    for i, m in enumerate(minutes):
        row = (i, base + timedelta(minutes=m), 1, "click", 1.0, '{"k": 1}')
        spark.createDataFrame([row], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "log"))
    log = A.shape_events(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "log")))
    got = runner.last_batch(runner.run_to_table(detectors.activity_sessions(log, gap="80 minutes", delay="1 day"), "all-sessions", "complete"))
    found = sorted((r["event_count"], r["start_time"], r["end_time"]) for r in got.collect())
    assert found == [(2, base + timedelta(minutes=2000), base + timedelta(minutes=2010)), (6, base, base + timedelta(minutes=180))]


def test_open_sessions_of_the_query(spark, tmp_path):
    rows = [(i, datetime(2024, 1, 1, 10, i), 1, "click", 1.0, '{"k": 1}') for i in range(3)]
    spark.createDataFrame(rows, LOG).coalesce(1).write.parquet(str(tmp_path / "made"))
    (tmp_path / "sf").mkdir()
    next((tmp_path / "made").glob("*.parquet")).rename(tmp_path / "sf" / "events.parquet")
    assert [r["event_count"] for r in streams.stream_sessions(spark, str(tmp_path / "sf")).collect()] == [3]


def test_workflow_order_across_small_frames(spark, tmp_path):
    schema = "workspace_id string, workflow_id string, seq long, ts timestamp, action string, state string"
    rows = [("w", "f", s, datetime(2024, 1, 1), "transition", f"s{s}") for s in (3, 1, 4, 2)]
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2")
    try:
        log = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        got = runner.run_to_table(detectors.workflow_transitions(log), "small").orderBy("change_no").collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert [(r["seq"], r["from_state"], r["to_state"]) for r in got] == [(1, None, "s1"), (2, "s1", "s2"), (3, "s2", "s3"), (4, "s3", "s4")]


def test_late_matches_over_several_files(spark, tmp_path):
    base = datetime(2024, 1, 1)
    schema = "event_id string, workspace_id string, event_type string, ts timestamp"
    for i, kind in enumerate(["deployment", "incident"]):
        spark.createDataFrame([(f"e{i}{j}", "w", kind, base + timedelta(hours=3 * j, minutes=20 * i)) for j in range(4)], schema).write.mode(
            "append").parquet(str(tmp_path / "log"))
    log = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "log"))
    got = runner.run_to_table(detectors.deployment_incidents(log, delay="2 days"), "late")
    assert sorted((r["deployment_id"], r["incident_id"], r["delay_seconds"]) for r in got.collect()) == [
        (f"e0{j}", f"e1{j}", 1200.0) for j in range(4)]


def test_repeated_webhooks_count_once(spark, tmp_path):
    rows = [(f"h{i % 3}", "sentry", '{"project": "p", "level": "fatal"}', None, datetime(2024, 1, 1, 0, i)) for i in range(9)]
    spark.createDataFrame(rows, "webhook_event_id string, source string, payload string, kind string, received_at timestamp").write.parquet(str(tmp_path / "in"))
    got = runner.run_to_table(webhooks.event_stream(webhooks.read_payloads(spark, str(tmp_path / "in"), "parquet")), "once")
    assert got.count() == 3
    assert {r["severity"] for r in got.collect()} == {"critical"}


def test_ingest_is_repeatable(spark, tmp_path):
    docs = A.raw_documents(spark, SF)
    chunk_path, event_path = str(tmp_path / "chunks"), str(tmp_path / "events")
    write = ingest.batch_writer(chunk_path, event_path, A.as_of())
    write(docs, 0)
    first = spark.read.parquet(chunk_path).drop("seen_at").count(), spark.read.parquet(event_path).count()
    write(docs, 1)
    assert (spark.read.parquet(chunk_path).count(), spark.read.parquet(event_path).count()) == first
    assert spark.read.parquet(chunk_path).select("chunk_id").distinct().count() == first[0]
    before = spark.read.parquet(event_path).filter("workspace_id <> 'ws_1'").count()
    sinks.reset_workspace(spark, event_path, "ws_1")
    left = spark.read.parquet(event_path)
    assert left.filter("workspace_id = 'ws_1'").count() == 0 and left.count() == before


def test_ingest_stream(spark, tmp_path):
    docs = A.raw_documents(spark, SF)
    landed = str(tmp_path / "landed")
    docs.write.parquet(landed)
    source = spark.readStream.schema(docs.schema).parquet(landed)
    query = ingest.ingest(source, str(tmp_path / "c"), str(tmp_path / "e"), str(tmp_path / "log"), A.as_of()).trigger(availableNow=True).start()
    query.awaitTermination()
    assert spark.read.parquet(str(tmp_path / "c")).count() > 0


def test_upsert_replaces_only_touched_partitions(spark):
    path = run_folder(spark, "table")
    schema = "k string, part string, v int, n int"
    sinks.upsert(spark.createDataFrame([("a", "p", 1, 1), ("b", "p", 1, 1), ("c", "q", 1, 1)], schema), path, ["k"], ["n"], ["part"])
    sinks.upsert(spark.createDataFrame([("a", "p", 2, 2), ("a", "p", 3, 3)], schema), path, ["k"], ["n"], ["part"])
    assert sorted((r["k"], r["v"]) for r in spark.read.parquet(path).collect()) == [("a", 3), ("b", 1), ("c", 1)]


def test_landed_tickets(spark, tmp_path):
    spark.createDataFrame([("T-1", "ws", "Fix it")], "id string, workspace_id string, title string").write.json(str(tmp_path / "t"))
    row = documents.read_tickets(spark, str(tmp_path / "t")).first()
    assert (row["id"], row["source"], row["content"]) == ("T-1", "jira", None)


def test_patterns_of_stream_and_batch_agree(spark):
    batch = patterns.deployment_incidents(A.op_events(spark, SF)).count()
    assert runner.run_to_table(detectors.deployment_incidents(stream(spark)), "pairs").count() == batch


def test_upsert_moves_keys_and_keeps_nulls(spark):
    path = run_folder(spark, "table")
    schema = "k string, part string, v int, n int"
    sinks.upsert(spark.createDataFrame([("a", None, 1, 1), ("b", None, 1, 1), ("c", "q", 1, 1), (None, "q", 1, 1)], schema), path, ["k"], ["n"], ["part"])
    sinks.upsert(spark.createDataFrame([("c", None, 2, 2), ("a", "r", 2, 2), (None, "s/ %", 2, 2)], schema), path, ["k"], ["n"], ["part"])
    got = sorted((str(r["k"]), str(r["part"]), r["v"]) for r in spark.read.parquet(path).collect())
    assert got == [("None", "s/ %", 2), ("a", "r", 2), ("b", "None", 1), ("c", "None", 2)]


def test_depth_is_never_cut(spark):
    from memograph.operators import graph
    from memograph.plans.tree import descend

    chain = spark.createDataFrame([(k, k - 1 if k else None) for k in range(24)], "id long, up long")
    assert descend(chain, "id", "up", F.col("id")).count() == 24
    with pytest.raises(ValueError):
        descend(chain, "id", "up", F.col("id"), max_depth=20)
    edges = spark.createDataFrame([("w", k, k + 1, k) for k in range(4)], "workspace_id string, source_id long, target_id long, edge_id long")
    seeds = spark.createDataFrame([("w", 0)], "workspace_id string, entity_id long")
    assert graph.neighbourhood(edges, seeds, 4).agg(F.max("hop")).first()[0] == 4
    with pytest.raises(ValueError):
        graph.neighbourhood(edges, seeds, 0)


def test_late_commands_find_their_place(spark, tmp_path):
    """Commands shuffled over many small batches against the batch log, once a far later command has moved the watermark."""
    import random

    from memograph.catalog.records import shape_commands
    from memograph.operators import workflow
    from memograph.streaming import workflows

    rng = random.Random(6)
    raw = spark.read.schema(LOG).parquet(f"{SF}/events.parquet").orderBy("ts").limit(300).collect()
    sent = list(raw)
    rng.shuffle(sent)
    last = raw[-1]
    sent.append(type(last)(*[last[0] + 10 ** 9, last[1] + timedelta(days=400), 10 ** 9, "signup", 1.0, last[5]]))
    for i in range(0, len(sent), 40):
        spark.createDataFrame([tuple(r) for r in sent[i:i + 40]], LOG).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream_in = spark.readStream.schema(LOG).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got = runner.run_to_table(workflows.log(shape_commands(stream_in), delay="300 days"), "late-commands")
    want = workflow.log(shape_commands(spark.createDataFrame([tuple(r) for r in raw], LOG)))
    columns = ["workspace_id", "workflow_id", "seq", "us", "kind", "from_value", "to_value"]
    assert sorted(map(str, got.select(*columns).collect())) == sorted(map(str, want.select(*columns).collect()))


def test_channel_scope_takes_the_whole_lookback(spark, tmp_path):
    """Messages of the first days of the month lie within thirty days of the fixed time."""
    turns = [(c, 0, "user", "hi") for c in (1, 3, 5, 2)]
    spark.createDataFrame(turns, "conv_id long, turn int, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    assert sorted(r["channel_id"] for r in chat.channel_scope(spark, str(tmp_path)).collect()) == ["C1", "C3", "C5"]


class Cell:
    """A state variable that counts how often it is reached."""

    calls = 0

    def __init__(self, value):
        self.value = value

    def __getattr__(self, name):
        Cell.calls += 1
        return {"exists": lambda: self.value is not None, "get": lambda: self.value if not isinstance(self.value, list) else iter(self.value),
                "update": lambda v: setattr(self, "value", v), "put": lambda v: setattr(self, "value", v), "clear": lambda: setattr(self, "value", []),
                "appendList": lambda v: self.value.extend(v), "keys": lambda: iter(list(self.value)), "registerTimer": lambda ms: TIMERS.append(ms),
                "updateValue": lambda k, v: self.value.__setitem__(k, v)}[name]


TIMERS = []


def test_changes_of_a_workflow_come_in_one_frame():
    flow = detectors._Workflow()
    flow.state = Cell(None)
    frame = pd.DataFrame({"seq": range(100), "to_state": [f"s{k % 3}" for k in range(100)]})
    first = list(flow.handleInputRows(("w", "f"), iter([frame]), None))
    assert [len(f) for f in first] == [100] and first[0]["change_no"].tolist() == list(range(1, 101))
    again = list(flow.handleInputRows(("w", "f"), iter([pd.DataFrame({"seq": [100, 101], "to_state": ["s0", "s1"]})]), None))
    assert again[0].values.tolist() == [["w", "f", 101, "s0", "s1", 101]]


def test_a_batch_of_commands_reaches_the_state_a_few_times():
    flow = workflows._Workflow()
    flow.handle, flow.waiting, flow.held, flow.assets = Cell(0), Cell([]), Cell(None), Cell({})
    frame = pd.DataFrame({"us": [(200 - k) * 1000 for k in range(200)], "seq": range(200), "to_state": ["a", "b"] * 100, "to_person": None, "asset": "x"})
    frame = pd.concat([frame, frame.iloc[:1].assign(to_state="z")])
    Cell.calls = 0
    assert list(flow.handleInputRows(("w", "f"), iter([frame]), None)) == [] and TIMERS == [2]
    clock = SimpleNamespace(getCurrentWatermarkInMs=lambda: 101)
    out = list(flow.handleExpiredTimer(("w", "f"), clock, SimpleNamespace(getExpiryTimeInMs=lambda: 2)))[0]
    assert (out["kind"] == "state").sum() == 100 and (out["kind"] == "link").sum() == 1 and TIMERS == [2, 102] and Cell.calls <= 12
    clock = SimpleNamespace(getCurrentWatermarkInMs=lambda: 500)
    out = list(flow.handleExpiredTimer(("w", "f"), clock, SimpleNamespace(getExpiryTimeInMs=lambda: 102)))[0]
    assert len(out) == 100 and out["to_value"].iloc[-1] == "z" and flow.waiting.value == []
