"""Detectors, graph and records on small hand-made rows."""

import random
from datetime import datetime, timedelta

import pandas as pd
import pytest
from pyspark.sql import functions as F

from memograph.functions import embedding
from memograph.operators import anomalies, digest, graph, issues, patterns, reasoning, resolution, retrieval, timeline, workflow
from memograph.sources import chat, webhooks

NOW = datetime(2026, 5, 25, 10)
SCHEMA = ("event_id string, workspace_id string, event_type string, title string, description string, ts timestamp, severity string,"
          "confidence double, chunk_id string, entities array<string>, metadata string")


def rows_of(spark, rows):
    full = []
    for i, (kind, ago, more) in enumerate(rows):
        r = {"ws": "w", "severity": "medium", "entities": ["api"], "title": f"{kind} {i}", **more}
        full.append((f"e{i:03d}", r["ws"], kind, r["title"], None, None if ago is None else NOW - ago, r["severity"], 0.9,
                     r.get("chunk", f"c{i}"), r["entities"], "{}"))
    return spark.createDataFrame(full, SCHEMA)


@pytest.fixture
def now():
    return F.lit(str(NOW)).cast("timestamp")


def test_volume_spike_against_its_baseline(spark, now):
    base = [("incident", timedelta(days=d), {}) for d in range(9, 29)]
    burst = [("incident", timedelta(hours=h), {}) for h in range(1, 41)]
    quiet = [("meeting", timedelta(days=d), {}) for d in range(1, 29)]
    found = anomalies.volume_spikes(rows_of(spark, base + burst + quiet), now).collect()
    assert [(r["event_type"], r["severity"], r["insight_type"]) for r in found] == [("incident", "high", "anomaly")]
    assert found[0]["title"] == "Abnormal volume spike in incident events"


def test_support_spike_opens_a_customer_workflow(spark, now):
    burst = [("support_spike", timedelta(hours=h), {}) for h in range(1, 41)]
    spikes = anomalies.volume_spikes(rows_of(spark, burst), now)
    made = workflow.customer_escalations(spikes).collect()
    assert [(r["title"], r["priority"]) for r in made] == [
        ("Customer Escalation: Abnormal volume spike in support_spike events", "medium")]


def test_deployment_instability_needs_two_issues(spark, now):
    rows = [("deployment", timedelta(hours=5), {}), ("incident", timedelta(hours=4), {}), ("outage", timedelta(hours=3), {}),
            ("deployment", timedelta(hours=30), {}), ("incident", timedelta(hours=29), {}),
            ("outage", timedelta(hours=4), {"ws": "other"})]
    found = anomalies.deployment_instability(rows_of(spark, rows), now).collect()
    assert [(r["deployment_id"], r["issue_count"], r["severity"]) for r in found] == [("e000", 2, "critical")]
    score = {r["event_id"]: r["stability_score"] for r in issues.deployment_stability(rows_of(spark, rows), now).collect()}
    assert score == {"e000": 0.0, "e003": 50.0}


def test_nothing_without_events(spark, now):
    assert anomalies.run_detection(rows_of(spark, []), now).count() == 0


def test_clusters_and_pairs(spark):
    rows = [("deployment", timedelta(minutes=50), {}), ("incident", timedelta(minutes=40), {}), ("outage", timedelta(minutes=10), {}),
            ("incident", timedelta(days=3), {}), ("incident", None, {})]
    events = rows_of(spark, rows)
    clusters = timeline.temporal_clusters(events).collect()
    assert [(r["cluster_id"], r["event_count"], r["duration_seconds"]) for r in clusters] == [(2, 3, 2400.0)]
    pairs = patterns.deployment_incidents(events).collect()
    assert sorted((r["incident_id"], r["delay_text"]) for r in pairs) == [("e001", "10m 0s"), ("e002", "40m 0s")]


def test_two_hours_apart_stay_together(spark):
    rows = [("incident", timedelta(hours=4), {}), ("incident", timedelta(hours=2), {}), ("incident", timedelta(0), {})]
    assert timeline.temporal_clusters(rows_of(spark, rows)).first()["event_count"] == 3


def test_workspaces_stay_apart(spark, now):
    mine = [("incident", timedelta(hours=h), {}) for h in (1, 2, 3)] + [("deployment", timedelta(hours=4), {})]
    theirs = [(k, a, {**m, "ws": "other", "title": "foreign"}) for k, a, m in mine]
    alone = patterns.all_patterns(rows_of(spark, mine), now).filter("workspace_id = 'w'").drop("last_detected")
    both = patterns.all_patterns(rows_of(spark, mine + theirs), now).filter("workspace_id = 'w'").drop("last_detected")
    assert sorted(map(str, alone.collect())) == sorted(map(str, both.collect()))


def test_partitioning_does_not_change_results(spark, now):
    rows = [("incident", timedelta(hours=h % 40), {"entities": ["api", "db"]}) for h in range(60)]
    events = rows_of(spark, rows)
    few, many = events.coalesce(1), events.repartition(13)
    for fn in (lambda e: patterns.recurring_incidents(e, now), lambda e: patterns.rolling_incidents(e), lambda e: issues.recurring_issues(e, now)):
        assert sorted(map(str, fn(few).collect())) == sorted(map(str, fn(many).collect()))


def test_issue_keywords_count_repeats_and_route(spark, now):
    events = rows_of(spark, [("incident", timedelta(hours=1), {"title": "Database pool database"}), ("incident", timedelta(hours=2), {"title": "api alert"})])
    found = {r["issue_id"]: r for r in issues.recurring_issues(events, now).collect()}
    assert set(found) == {"recurring-database"}
    assert found["recurring-database"]["evidence_count"] == 2
    assert found["recurring-database"]["assigned_team"] == "Database Ops Team"
    assert found["recurring-database"]["confidence"] == 0.84


def test_entity_resolution_stages(spark):
    nodes = spark.createDataFrame([
        ("w", "system", "n1", "Billing Service", ["bills"]), ("w", "system", "n2", "east core node pool api", []),
        ("w", "system", "n3", "kubernetes cluster", []), ("x", "system", "n4", "Billing Service", [])],
        "workspace_id string, type string, entity_id string, name string, aliases array<string>")
    names = spark.createDataFrame([
        ("w", "system", "billing service"), ("w", "system", "BILLS"), ("w", "system", "api pool node core"),
        ("w", "system", "kubernetes clusters"), ("w", "system", "something else")], "workspace_id string, type string, name string")
    got = {r["name"]: (r["entity_id"], r["stage"]) for r in resolution.resolve(
        names, nodes, embedding.hashed_trigrams(), cosine=0.9).collect()}
    assert got == {"billing service": ("n1", "exact"), "BILLS": ("n1", "alias"), "api pool node core": ("n2", "overlap"),
                   "kubernetes clusters": ("n3", "vector"), "something else": (None, "new")}


def test_a_name_is_embedded_once_however_many_rows_it_comes_from(spark):
    asked, vector = spark.sparkContext.accumulator(0), embedding.hashed_trigrams()

    @F.pandas_udf("string")
    def seen(names: pd.Series) -> pd.Series:
        asked.add(len(names))
        return names

    rows = spark.range(3000).select(F.lit("w").alias("workspace_id"), F.lit("system").alias("type"), F.concat(F.lit("alpha beta "), F.col("id") % 3).alias("name"), "id")
    nodes = rows.groupBy("workspace_id", "type", "name").agg(F.min("id").alias("entity_id")).withColumn("aliases", F.array().cast("array<string>"))
    names = rows.withColumn("name", F.replace("name", F.lit("a b"), F.lit("ab")))
    got = resolution.resolve(names, nodes, lambda c: vector(seen(c)), jaccard=0.95, cosine=0.8).select("name", "entity_id", "stage").collect()
    assert sorted(map(tuple, got)) == [(f"alphabeta {n}", n, "vector") for n in range(3)]
    assert asked.value == 6


def test_graph_lookup_prefers_the_exact_name(spark):
    nodes = spark.createDataFrame([("w", "1", "api gateway"), ("w", "2", "api")], "workspace_id string, entity_id string, name string")
    refs = spark.createDataFrame([("w", "c1", "1"), ("w", "c2", "2")], "workspace_id string, chunk_id string, entity_id string")
    chunks = spark.createDataFrame([("w", "c1", "a"), ("w", "c2", "b")], "workspace_id string, chunk_id string, text string")
    names = spark.createDataFrame([("w", "API"), ("w", "gate"), ("w", "none")], "workspace_id string, wanted string")
    got = sorted((r["wanted"], r["chunk_id"]) for r in graph.chunks_of_entities(names, nodes, refs, chunks).collect())
    assert got == [("API", "c2"), ("gate", "c1")]


def test_question_filters(spark, now):
    chunks = spark.createDataFrame([
        ("c1", "w", "slack", "ana", "ops", NOW - timedelta(days=1), ["en", "runbooks"], ["api"], [1.0, 0.0]),
        ("c2", "w", "notion", "bob", "dev", NOW - timedelta(days=90), ["en"], ["db"], [0.0, 1.0]),
        ("c3", "x", "slack", "ana", "ops", NOW, ["en"], ["api"], [1.0, 0.0])],
        "chunk_id string, workspace_id string, source string, author string, team string, ts timestamp, hierarchy array<string>,"
        "entities array<string>, embedding array<double>")
    asked = spark.createDataFrame([
        ("all", "w", "anything", [1.0, 1.0], None, None, None), ("recent", "w", "recent trouble", [1.0, 1.0], None, None, None),
        ("wiki", "w", "anything", [1.0, 1.0], ["notion"], None, None), ("path", "w", "anything", [1.0, 1.0], None, ["en", "runbooks"], None),
        ("both", "w", "anything", [1.0, 1.0], None, None, ["api", "db"])],
        "query_id string, workspace_id string, question string, embedding array<double>, sources array<string>, scope array<string>, wanted array<string>")
    found = retrieval.filtered_knn(retrieval.prepare_questions(asked, now), chunks, 10, conditions=retrieval.admitted())
    got = {}
    for r in found.collect():
        got.setdefault(r["query_id"], set()).add(r["chunk_id"])
    assert got == {"all": {"c1", "c2"}, "recent": {"c1"}, "wiki": {"c2"}, "path": {"c1"}}
    ranked = {(r["query_id"], r["chunk_id"]): r for r in retrieval.rank(found, now).collect()}
    assert ranked[("path", "c1")]["hierarchy_boost"] == 0.15
    assert ranked[("wiki", "c2")]["source_boost"] == 0.05


def test_profiles(spark):
    asked = spark.createDataFrame([("why did it fail, root cause?",), ("anywhere",), ("how is it",), ("worsening delay",)], "question string")
    got = [(r["query_type"], r["class_confidence"]) for r in reasoning.classify(asked).collect()]
    assert got == [("root_cause_analysis", 0.95), ("recurring_issue", 0.5), ("root_cause_analysis", 0.5), ("bottleneck_analysis", 0.8)]


def test_digest_counts(spark, now):
    events = rows_of(spark, [("incident", timedelta(hours=1), {}), ("outage", timedelta(hours=2), {}), ("deployment", timedelta(hours=3), {}),
                             ("incident", timedelta(hours=30), {})])
    insights = spark.createDataFrame([("w", "anomaly", NOW)], "workspace_id string, insight_type string, generated_at timestamp")
    flows = spark.createDataFrame([("w", "blocked"), ("w", "completed")], "workspace_id string, state string")
    row = digest.metrics(events, insights, flows, now, "daily_ops").first()
    assert row["text"] == "Daily Ops Digest: 2 incidents, 1 deploys, 1 anomalies."
    assert (row["workflows"], row["blocked"]) == (1, 1)


def test_chat_routing(spark):
    rows = [("C1", "general", "1700000000.000100", "1700000000.000100", 1, "U1", None, "parent <@U2>"),
            ("C1", "general", "1700000060.000100", "1700000000.000100", 0, "U2", None, "reply"),
            ("C1", "general", "1700000030.000100", "1600000000.000100", 0, "U2", None, "orphan reply"),
            ("C1", "general", "1700000040.000100", None, 0, None, "B9", "loose"), ("C1", "general", "bad", None, 0, None, None, "no time")]
    messages = spark.createDataFrame(rows, "channel_id string, channel_name string, ts string, thread_ts string, reply_count int, user string, bot_id string, text string")
    users = spark.createDataFrame([("U1", "", "Ana K", "ana"), ("U2", "Bo", None, "bo")], "user_id string, display_name string, real_name string, name string")
    threads, loose = chat.route(chat.resolve(messages, users))
    doc = chat.thread_documents(threads).first()
    assert doc["content"] == "Ana K [22:13:20]: parent @Bo\nBo [22:14:20]: reply"
    assert (doc["title"], doc["reply_count"]) == ("Slack Thread: Ana K in #general", 1)
    assert sorted(r["clean_text"] for r in loose.collect()) == ["loose", "no time"]


def test_billing_end_of_an_old_subscription_changes_nothing(spark):
    def hook(i, kind, sub, ws=None, status=None):
        body = {"type": kind, "data": {"object": {"id": sub, "status": status, "metadata": {"workspace_id": ws}}}}
        import json
        return (f"h{i}", "stripe", json.dumps(body), None, NOW + timedelta(minutes=i))

    raw = spark.createDataFrame([
        hook(1, "customer.subscription.created", "old", "w", "active"), hook(2, "customer.subscription.created", "new", "w", "trialing"),
        hook(3, "customer.subscription.deleted", "old"), hook(4, "customer.subscription.created", "s2", "v", "active"),
        hook(5, "customer.subscription.deleted", "s2"), ("h6", "stripe", "not json", None, NOW)], webhooks.PAYLOAD_COLUMNS)
    got = {r["workspace_id"]: (r["subscription_id"], r["status"], r["plan"]) for r in webhooks.subscriptions(webhooks.billing_changes(raw)).collect()}
    assert got == {"w": ("new", "trialing", "pro"), "v": ("s2", "canceled", "free")}


def test_deciding_issues_reach_the_entities_that_all_issues_reach(spark, now):
    rng = random.Random(5)
    minutes = [*range(0, 900, 20), 120, 240, 10_079, 10_081, 11_000]
    rows = [(rng.choice(["deployment", "incident", "outage", "incident", "meeting", None]), timedelta(minutes=rng.choice(minutes) - 30, seconds=rng.choice([0, 0, 7])),
             {"ws": rng.choice(["w", "v", None]), "chunk": rng.choice([f"c{n}" for n in range(9)] + [None]), "entities": rng.sample("abcdefg", 2)}) for _ in range(700)]
    rows += [("incident", None, {})]
    events = rows_of(spark, rows).unionByName(rows_of(spark, rows[:40]))
    refs = events.filter("ts IS NOT NULL").select("workspace_id", "chunk_id", F.explode("entities").alias("name"), F.lit("system").alias("type")).filter(
        F.xxhash64("chunk_id", "name") % 3 == 0).distinct()
    unstable = anomalies.deployment_instability(events, now)
    every = anomalies.instability_events(unstable, events, now)
    some = anomalies.instability_events(unstable, anomalies.deciding_issues(events, refs, now), now)
    want, got = (sorted(map(str, anomalies.supporting_entities(linked, refs).collect())) for linked in (every, some))
    assert got == want and len(want) > 20

    # Ten times the issues of a chunk are no more rows.
    crowd = rows_of(spark, [("deployment", timedelta(hours=3), {})] + [("incident", timedelta(minutes=m / 10), {"chunk": "c"}) for m in range(1000)])
    linked = anomalies.instability_events(anomalies.deployment_instability(crowd, now), anomalies.deciding_issues(
        crowd, crowd.select("workspace_id", F.lit("c").alias("chunk_id"), F.lit("api").alias("name"), F.lit("system").alias("type")).distinct(), now), now)
    assert linked.count() <= 5
