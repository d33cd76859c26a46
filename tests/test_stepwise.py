"""Work done in rounds or batches against the same work done at once."""

import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from memograph import adapters as A
from memograph.catalog import graph, search
from memograph.operators import correlation, entities, graphbuild, patterns, reasoning, retrieval, upsert
from memograph.plans import late, neighbours, substring
from memograph.plans.late import first_passing
from memograph.plans.neighbours import knn_join
from memograph.plans.ranking import with_running_total
from memograph.plans.substring import containing
from memograph.plans.tree import descend
from memograph.sources import chat
from memograph.streaming.maintain import Maintained

BASE = datetime(2024, 1, 20)
CHUNKS = "workspace_id string, chunk_id string, embedding array<float>, entities array<string>, ts timestamp, source string, seen_at long"
EVENTS = "workspace_id string, event_id string, event_type string, title string, ts timestamp, entities array<string>"


def chunk_rows(rng, ids, seen):
    return [(f"w{i % 2}", f"c{i}", [rng.gauss(0, 1) for _ in range(6)], rng.sample(["a", "b", "c", "d"], rng.randint(0, 3)),
             BASE + timedelta(minutes=rng.randint(0, 500)), rng.choice(["slack", "jira"]), seen) for i in ids]


def event_rows(rng, ids):
    return [(f"w{i % 2}", f"e{i}", rng.choice(["deployment", "incident", "escalation", "discussion", "outage"]), f"t{rng.randint(0, 3)}",
             BASE + timedelta(minutes=rng.randint(0, 2000)), rng.sample(["db", "api", "production"], 2)) for i in ids]


def rows_of(df, *columns):
    return sorted(map(str, df.select(*columns).collect()))


def test_batches_give_what_one_run_gives(spark, tmp_path):
    rng = random.Random(4)
    batches = [(chunk_rows(rng, range(0, 40), 1), event_rows(rng, range(0, 50))),
               (chunk_rows(rng, [*range(30, 34), *range(40, 60)], 2), event_rows(rng, [3, 4, 5, *range(50, 80)])),
               (chunk_rows(rng, [41, 2], 3), []), ([], event_rows(rng, [60, 61]))]
    as_of = F.lit("2024-01-22 00:00:00").cast("timestamp")
    store = Maintained(spark, str(tmp_path / "store"), as_of, k=4)
    for n, (chunks, events) in enumerate(batches):
        assert store.apply(f"b{n}", spark.createDataFrame(chunks, CHUNKS), spark.createDataFrame(events, EVENTS))
        assert not store.apply(f"b{n}", spark.createDataFrame(chunks, CHUNKS), spark.createDataFrame(events, EVENTS))
    # A batch that fails before its ledger row stands leaves no trace, whatever it wrote.
    store.store.write("chunks", store.store.last() + 1, spark.createDataFrame(chunk_rows(rng, [0, 99], 9), CHUNKS))
    chunks = spark.createDataFrame(list({r[1]: r for c, _ in batches for r in c}.values()), CHUNKS)
    events = spark.createDataFrame(list({r[1]: r for _, e in batches for r in e}.values()), EVENTS)

    def check():
        assert rows_of(store.chunks(), *chunks.columns) == rows_of(chunks, *chunks.columns)
        pairs = ["workspace_id", "entity_a", "entity_b", "score", "last_seen"]
        assert rows_of(store.cooccurrence(), *pairs) == rows_of(entities.cooccurrence(chunks), *pairs)
        near = ["workspace_id", "chunk_id", "match_id", "cosine"]
        assert rows_of(store.neighbours(), *near) == rows_of(correlation.neighbours(chunks, 4), *near)
        links = ["workspace_id", "source_a", "source_b", "type", "score", "reason"]
        assert rows_of(store.correlations(), *links) == rows_of(correlation.correlate(chunks, 4), *links)
        found = ["workspace_id", "pattern_id", "description", "severity", "confidence", "entities"]
        want = patterns.all_patterns(events, as_of)
        assert rows_of(store.patterns(), *found) == rows_of(want, *found) and want.count() > 5

    check()
    store.store.compact()
    check()


def test_chains_are_kept_by_the_versions_of_their_events(spark, tmp_path):
    """No chain is grouped or written again because another event of its deployment changed."""
    def event(n, kind, minute, title="t"):
        return ("w", f"e{n}", kind, title, BASE + timedelta(minutes=minute), ["db"])

    store = Maintained(spark, str(tmp_path / "chains"), F.lit("2024-01-22 00:00:00").cast("timestamp"), k=2)
    chunks = spark.createDataFrame([], CHUNKS)
    for n, events in enumerate(([event(0, "deployment", 0), event(1, "incident", 5), event(2, "incident", 9)],
                                [event(1, "incident", 6, "new"), event(3, "deployment", 1)], [event(3, "discussion", 1)])):
        assert store.apply(f"b{n}", chunks, spark.createDataFrame(events, EVENTS))
    assert rows_of(store.store.versions("chains"), "no", "deployment_id", "event_id", "title") == sorted(map(str, spark.createDataFrame(
        [(1, "e0", "e1", "t"), (1, "e0", "e2", "t"), (2, "e0", "e1", "new"), (2, "e3", "e1", "new"), (2, "e3", "e2", "t"), (3, "e0", "e3", "t")],
        "no int, deployment_id string, event_id string, title string").collect()))
    assert sorted((r.deployment_id, r.event_id, r.title) for r in store.store.chains().collect()) == [("e0", "e1", "new"), ("e0", "e2", "t"), ("e0", "e3", "t")]
    plan = store.store.chains()._jdf.queryExecution().optimizedPlan().toString()
    assert all("title" not in line for line in plan.splitlines() if "Aggregate" in line)
    assert store.store.versions("patterns").filter("pattern_type = 'escalation_chain'").isEmpty()


def test_chains_are_stored_by_their_ends(spark, tmp_path):
    """What a batch stores grows with its events and what lies an hour around them, not with their pairs."""
    def event(name, kind, minute, title="t", space="w", micros=0):
        return (space, name, kind, title, BASE + timedelta(minutes=minute, microseconds=micros), ["db"])

    deployments = [event(f"d{n}", "deployment", n / 10) for n in range(80)]
    issues = [event(f"i{n}", "incident", 10 + n / 10) for n in range(90)]
    far = [event("far", "deployment", 900), event("late", "incident", 1900), event("d0", "deployment", 0, space="v"), event("i0", "incident", 1, space="v")]
    # An hour to the microsecond after d0, one microsecond more, a moved and a renamed event, and a deployment before them.
    second = [event("edge", "escalation", 60), event("past", "escalation", 60, micros=1), event("i1", "incident", 10.1, micros=1),
              event("d1", "deployment", 0.1, "new"), event("d80", "deployment", -49)]
    store = Maintained(spark, str(tmp_path / "ends"), F.lit("2024-01-22 00:00:00").cast("timestamp"), k=2)
    chunks = spark.createDataFrame([], CHUNKS)
    written = []
    for n, events in enumerate((deployments + issues + far, second)):
        assert store.apply(f"b{n}", chunks, spark.createDataFrame(events, EVENTS))
        written.append(sum(spark.read.parquet(str(f)).count() for f in (tmp_path / "ends").glob(f"chain*/no={n + 1}")))
    assert written == [174, 5 + 80 - 1 + 90 - 1]
    now = spark.createDataFrame(list({r[:2]: r for r in deployments + issues + far + second}.values()), EVENTS)
    columns = ["workspace_id", "deployment_id", "event_id", "deployment_title", "title", "entities"]
    assert rows_of(store.events(), *now.columns) == rows_of(now, *now.columns)
    found = {(r.workspace_id, r.deployment_id, r.event_id) for r in store.store.chains().collect()}
    assert {("w", "d0", "edge"), ("w", "d80", "i1"), ("v", "d0", "i0")} <= found and ("w", "d0", "past") not in found
    assert rows_of(store.store.chains(), *columns) == rows_of(patterns.chain_pairs(now), *columns)
    store.store.compact()
    assert rows_of(store.store.chains(), *columns) == rows_of(patterns.chain_pairs(now), *columns)


def test_graph_in_batches_equals_one_build(spark):
    rng = random.Random(1)
    words = ["core", "api", "db", "auth", "web", "cache", "old"]
    rows = [("w", f"c{i // 4}", i % 4, " ".join(rng.sample(words, rng.randint(3, 6))), rng.choice(["system", "team"]), i, rng.choice([None, "", f"d{i}"])) for i in range(120)]
    mentions = spark.createDataFrame(rows, "workspace_id string, chunk_id string, position int, name string, type string, seen_at long, description string")
    edges = spark.createDataFrame([("w", a[1], a[3], b[3], "uses", 0.5 + a[2] / 10, None, a[5]) for a, b in zip(rows, rows[1:]) if a[1] == b[1]],
                                  "workspace_id string, chunk_id string, source string, target string, relationship_type string, confidence double, evidence string, seen_at long")
    whole = graphbuild.tables(graphbuild.extend(None, mentions, edges, threshold=0.6))
    graph = None
    for part in (2, 0, 1):
        graph = graphbuild.extend(graph, mentions.filter(F.col("seen_at") % 3 == part), edges.filter(F.col("seen_at") % 3 == part), threshold=0.6)
    for a, b in zip(whole, graphbuild.tables(graph)):
        assert rows_of(a, *a.columns) == rows_of(b, *a.columns)
    assert whole[0].count() < mentions.select("name", "type").distinct().count()


def test_late_filter_fetches_until_full(spark):
    rows = spark.createDataFrame([(n % 3, n, n % 97 == 0) for n in range(3000)], "ws int, n int, good boolean")
    asked = spark.createDataFrame([("a", 0, 5), ("b", 1, 2), ("c", 1, 100), ("d", 9, 3), ("e", 2, 0)], "q string, ws int, many int")
    fetched = []

    def passes(some):
        fetched.append(some.count())
        return some.filter("good")

    got = first_passing(rows, asked, ["ws"], "q", [F.col("n")], "many", passes)
    want = []
    for q, ws, many in (("a", 0, 5), ("b", 1, 2), ("c", 1, 100)):
        hits = [n for n in range(3000) if n % 3 == ws and n % 97 == 0][:many]
        want += [(q, n, rank) for rank, n in enumerate(hits, 1)]
    assert sorted((r["q"], r["n"], r["rank"]) for r in got.collect()) == want
    assert len(fetched) > 3
    assert first_passing(rows, asked.limit(0), ["ws"], "q", [F.col("n")], "many", lambda s: s).count() == 0


def test_questions_at_one_place_share_a_fetch(spark, monkeypatch):
    plans, write = [], late.cut_lineage

    def spy(df):
        plans.append(df._jdf.queryExecution().optimizedPlan().toString())
        return write(df)

    monkeypatch.setattr(late, "cut_lineage", spy)
    rows = spark.createDataFrame([(n % 2, n, n % 7) for n in range(400)], "ws int, n int, rest int")
    asked = spark.createDataFrame([(f"{ws}/{rest}", ws, rest, 2 + rest % 2) for ws in (0, 1) for rest in range(7)], "q string, ws int, wanted int, many int")
    got = first_passing(rows, asked, ["ws"], "q", [F.col("n")], "many", lambda some: some.filter("rest = wanted"))
    want = [(q, n, rank) for q, ws, rest, many in map(tuple, asked.collect())
            for rank, n in enumerate([n for n in range(400) if n % 2 == ws and n % 7 == rest][:many], 1)]
    assert sorted((r["q"], r["n"], r["rank"]) for r in got.collect()) == sorted(want)
    # All rows are ordered once a workspace; a question orders those up to the last place wanted.
    assert "windowspecdefinition(ws#" in plans[0] and "windowspecdefinition(q#" not in plans[0]
    assert all("_to#" in plan for plan in plans if "windowspecdefinition(q#" in plan)


def test_running_totals_over_spread_groups(spark):
    rng = random.Random(3)
    rows = [(rng.choice(["hot", "hot", "hot", "cold", None]), n, rng.choice([None, 1, 2, 5])) for n in range(600)]
    got = with_running_total(spark.createDataFrame(rows, "k string, n int, v int").repartition(5), ["k"], [F.col("n")], F.col("v"))
    before, want = {}, []
    for k, n, v in rows:
        want.append((str(k), n, before.get(k, 0)))
        before[k] = before.get(k, 0) + (v or 0)
    assert sorted((str(r["k"]), r["n"], r["before"]) for r in got.collect()) == sorted(want)


def test_paths_leave_out_cycles_and_orphans(spark):
    rows = [(0, None), *[(k, k - 1) for k in range(1, 40)], (100, 101), (101, 102), (102, 100), (103, 100), (200, 999), (201, 200), (300, 300), (400, None)]
    got = {r["id"]: r for r in descend(spark.createDataFrame(rows, "id long, up long"), "id", "up", F.col("id")).collect()}
    assert sorted(got) == [*range(40), 400]
    assert got[39]["path_steps"] == list(range(40)) and got[39]["depth"] == 39 and got[400]["depth"] == 0


def test_one_long_text_moves_once(spark):
    body = "".join(random.Random(5).choice("abcdefgh ") for _ in range(200_000)) + "the needle é here"
    texts = spark.createDataFrame([("w", 1, body), ("w", 2, "xyz the"), ("w", 3, ""), ("w", 4, None), ("v", 5, "the needle")], "ws string, n int, t string")
    needles = spark.createDataFrame([("w", "the needle é"), ("w", "the"), ("w", "zz"), ("w", "é"), ("w", ""), ("w", None), ("w", "absent words")], "ws string, q string")
    got = [sorted((r["n"], r["q"]) for r in containing(texts, F.col("t"), needles, F.col("q"), ["ws"], small=s).collect()) for s in (True, False)]
    assert got[0] == got[1] and (1, "the needle é") in got[0] and (2, "the") in got[0]


def test_many_names_are_looked_up_by_long_runs(spark, monkeypatch):
    looked, grams = [], substring.grams
    monkeypatch.setattr(substring, "grams", lambda *a: looked.append(grams(*a)) or looked[-1])
    texts = spark.createDataFrame([("w", f"Supplier#{n:09d}") for n in range(900)] + [("w", None), ("v", "Supplier#000000001")], "ws string, t string")
    needles = spark.createDataFrame([("w", f"{n:09d}") for n in range(1, 1300, 2)] + [("w", None), ("v", "00001")], "ws string, q string")
    got = sorted((r["t"], r["q"]) for r in containing(texts, F.col("t"), needles, F.col("q"), ["ws"]).collect())
    assert got == sorted([(f"Supplier#{n:09d}", f"{n:09d}") for n in range(1, 900, 2)] + [("Supplier#000000001", "00001")])
    # Not every name is tested against every text, and a run is held by few of them.
    held = {r["_gram"]: r["n"] for r in looked[0].filter("length(_gram) = 8 AND ws = 'w'").groupBy("_gram").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert held["00000012"] == 11 and held["00000120"] == 1


def test_long_runs_across_windows(spark, monkeypatch):
    monkeypatch.setattr(substring, "WINDOW", 10)
    body = "abcdefghijklmnopqrstuvwxyz0123456789"
    texts = spark.createDataFrame([("w", body), ("w", body[::-1]), ("w", "")], "ws string, t string")
    needles = spark.createDataFrame([("w", b[at:at + n]) for b in (body, body[::-1]) for n in (0, 1, 2, 3, 7, 8, 9, 20) for at in range(0, 30, 3)], "ws string, q string").distinct()
    got = [sorted((r["t"], r["q"]) for r in containing(texts, F.col("t"), needles, F.col("q"), ["ws"], small=s).collect()) for s in (True, False)]
    assert got[0] == got[1] and len(got[0]) > 60


def test_neighbours_by_cells_equal_a_full_scan(spark):
    rng = random.Random(9)
    centres = [[rng.gauss(0, 3) for _ in range(5)] for _ in range(6)]
    rows = [(i, f"w{i % 2}", [x + rng.gauss(0, 0.2) for x in rng.choice(centres)]) for i in range(400)]
    df = spark.createDataFrame(rows, "id int, ws string, embedding array<double>")
    points = df.withColumnRenamed("id", "near")
    whole = knn_join(df, points, 5, ["ws"], "id", "near").select("id", "near", "rank", "cosine").collect()
    for block, pivots in ((20, None), (7, 4), (50, 1)):
        cut = knn_join(df, points, 5, ["ws"], "id", "near", block=block, pivots=pivots).select("id", "near", "rank", "cosine").collect()
        assert sorted(map(tuple, whole)) == sorted(map(tuple, cut))


def test_metadata_of_merged_events(spark):
    at = datetime(2024, 1, 1)
    rows = [("w", "e1", "incident", "Down", at, '{"a": 1, "b": {"x": [1, 2]}}'), ("w", "e2", "incident", "down ", at + timedelta(minutes=1), '{"a": "two", "c": true}'),
            ("w", "e3", "incident", "Down", at + timedelta(minutes=2), "not json"), ("w", "e4", "incident", "Down", at + timedelta(minutes=3), None),
            ("v", "e5", "incident", "Down", at, "{}")]
    events = spark.createDataFrame(rows, "workspace_id string, event_id string, event_type string, title string, ts timestamp, metadata string").select(
        "*", F.lit(None).cast("string").alias("description"), F.lit(None).cast("string").alias("severity"), F.lit(0.5).alias("confidence"), F.lit("c").alias("chunk_id"))
    got = {r["event_id"]: r["metadata"] for r in upsert.upsert_events(events).collect()}
    assert got == {"e1": '{"a":"two","b":{"x":[1,2]},"c":true}', "e5": "{}"}


def test_busy_days_come_in_sections(spark):
    seconds = 1704067200
    rows = [("C1", "general", f"{seconds + n}.000000", None, 0, "U1", None, "x" * 50) for n in range(300)] + [("C2", "quiet", f"{seconds}.000000", None, 0, "U1", None, "y")]
    messages = spark.createDataFrame(rows, "channel_id string, channel_name string, ts string, thread_ts string, reply_count int, user string, bot_id string, text string")
    users = spark.createDataFrame([("U1", "Ann", None, "ann")], "user_id string, display_name string, real_name string, name string")
    got = chat.documents(messages, users, section_bytes=1000).collect()
    busy = sorted((r for r in got if "C1" in r["id"]), key=lambda r: r["created_time"])
    assert len(busy) > 15 and len([r for r in got if "C2" in r["id"]]) == 1
    assert all(len(r["content"]) < 1200 for r in busy) and [r["id"] for r in busy][:2] == ["slack_chat_C1_2024-01-01", "slack_chat_C1_2024-01-01#2"]
    lines = [line for r in busy for line in r["content"].split("\n\n", 1)[1].split("\n")]
    assert len(lines) == 300 and lines == sorted(lines)


def test_undated_documents_get_the_time_of_ingest(spark):
    from memograph.streaming import ingest

    docs = spark.createDataFrame([("d", "w", "jira", "Title", "An outage of the database was seen today.")], "id string, workspace_id string, source string, title string, content string")
    chunks, _ = ingest.process(docs.withColumn("tags", F.array(F.lit("en"))).withColumn("parent_id", F.lit("")).withColumn("path", F.lit("")), F.lit("2025-05-05 00:00:00").cast("timestamp"))
    assert {str(r["ts"]) for r in chunks.collect()} == {"2025-05-05 00:00:00"}
    assert A.AS_OF.startswith("2024")


def test_pairs_dealt_by_slots_equal_pairs_at_once(spark):
    rng = random.Random(8)
    rows = [(rng.choice(["w", "v", None]), rng.choice([None, rng.sample(["a", "A", "b", "c", "d", None], rng.randint(0, 4))]),
             rng.choice([None, BASE + timedelta(minutes=n)]), n) for n in range(300)]
    chunks = spark.createDataFrame(rows, "workspace_id string, entities array<string>, ts timestamp, n long")
    slots = chunks.withColumn("slot", F.col("n") % 7).repartition(3, "slot")
    got = entities.cooccurrence(slots, slot="slot", tasks=5)
    assert got.rdd.getNumPartitions() == 5
    assert rows_of(got, *got.columns) == rows_of(entities.cooccurrence(chunks), *got.columns) and got.count() > 5


def test_supplier_pairs_get_more_tasks_with_more_lines(spark, tmp_path, monkeypatch):
    lines = [(n // 3, n * 7 % 11, BASE + timedelta(days=n % 5)) for n in range(90)] + [(None, 1, None), (None, 2, None), (5, None, None)]
    spark.createDataFrame(lines, "l_orderkey long, l_suppkey long, l_shipdate timestamp").write.parquet(str(tmp_path / "lineitem.parquet"))
    want = rows_of(graph.supplier_pairs(spark, str(tmp_path)), "entity_a", "entity_b", "score", "last_seen")
    monkeypatch.setattr(graph, "LINES_A_TASK", 10)
    many = graph.supplier_pairs(spark, str(tmp_path))
    assert many.rdd.getNumPartitions() == 10
    assert rows_of(many, "entity_a", "entity_b", "score", "last_seen") == want and len(want) > 10


def test_vectors_travel_as_they_came_and_once_if_nobody_shares_them(spark, monkeypatch):
    """Single precision stays single; without copies no task groups rows by their vector."""
    stored, cut = [], neighbours.cut_lineage

    def kept(df):
        out = cut(df)
        stored.append((out, df._jdf.queryExecution().executedPlan().toString()))
        return out

    rng = random.Random(12)
    rows = [(i, f"w{i % 2}", [rng.gauss(0, 1) for _ in range(6)]) for i in range(200)]
    df = spark.createDataFrame(rows, "id int, ws string, embedding array<float>")
    monkeypatch.setattr(neighbours, "cut_lineage", kept)
    whole = knn_join(df, df.withColumnRenamed("id", "near"), 3, ["ws"], "id", "near").collect()
    many = knn_join(df, df.withColumnRenamed("id", "near"), 3, ["ws"], "id", "near", block=20, pivots=4).collect()
    assert sorted(map(tuple, whole)) == sorted(map(tuple, many)) and len(whole) == 600
    kinds = {f.dataType.simpleString() for out, _ in stored for f in out.schema if f.dataType.simpleString().startswith("array")}
    assert "array<float>" in kinds and "array<double>" not in kinds
    assert not any("collect_list(_id" in plan for _, plan in stored)


def test_neighbours_among_scaled_copies_nulls_and_repeated_rows(spark):
    """Vectors of one direction are one class, also with null ids and rows that come twice; zero vectors are at cosine 0."""
    rng = random.Random(13)
    rows = [(i, [x * (1 + i % 2) for x in ([1.0, 2.0, 0.5] if i % 3 == 0 else [0.0, 0.0, 0.0] if i == 1 else [rng.gauss(0, 1) for _ in range(3)])]) for i in range(60)]
    df = spark.createDataFrame([*rows, *rows[:4], (None, [1.0, 2.0, 0.5]), (77, None)], "id int, embedding array<double>")
    points = df.withColumnRenamed("id", "near")
    whole = knn_join(df, points, 4, [], "id", "near").select("id", "near", "rank", "cosine").collect()
    cut = knn_join(df, points, 4, [], "id", "near", block=8, pivots=3).select("id", "near", "rank", "cosine").collect()
    assert sorted(map(str, whole)) == sorted(map(str, cut))
    first = sorted((r["rank"], r["near"]) for r in whole if r["id"] == 9)
    assert first[:3] == [(1, 0), (2, 0), (3, 3)] and len(first) == 4 and {r["cosine"] for r in whole if r["id"] == 1} == {0.0}


def test_texts_fetched_for_hits_equal_texts_in_chunks(spark):
    """A chunk that comes twice keeps its own text each time."""
    now = F.lit("2024-01-31 00:00:00").cast("timestamp")
    rows = [(f"c{i}", f"Body {i % 5}  of note", [float(i % 7), 1.0, float(i % 3)], BASE + timedelta(minutes=i), i) for i in range(24)]
    rows += [("c3", "Another body", [3.0, 1.0, 0.0], BASE, 30), ("c4", None, [4.0, 1.0, 1.0], BASE, 31), ("c5", "Body 0  of note", [5.0, 1.0, 2.0], BASE, 32)]
    chunks = spark.createDataFrame(rows, "chunk_id string, text string, embedding array<double>, ts timestamp, seen_at int").select(
        "*", F.lit("w").alias("workspace_id"), F.lit("slack").alias("source"), F.lit("chat").alias("source_type"), F.lit("a").alias("author"),
        F.lit("t").alias("team"), F.array(F.lit("x")).alias("hierarchy"), F.array(F.lit("Docker")).alias("entities"), F.col("chunk_id").alias("title"))
    asked = spark.createDataFrame([("q", "w", "docker trouble", [1.0, 1.0, 1.0]), ("r", "w", "postgres", [5.0, 1.0, 0.0])],
                                  "query_id string, workspace_id string, question string, embedding array<double>")
    links, events = correlation.correlate(chunks), search.lite_events(chunks)
    keyed = chunks.withColumn("text_key", F.sha2("text", 256))
    want = retrieval.evidence(asked, chunks, events, links, now, 6)
    got = retrieval.evidence(asked, keyed.drop("text"), events, links, now, 6, texts=keyed.select("workspace_id", "chunk_id", "text_key", "text"))
    assert rows_of(got["chunks"], "query_id", "chunk_id", "text", "rank") == rows_of(want["chunks"], "query_id", "chunk_id", "text", "rank")
    assert rows_of(got["timeline"], "query_id", "type", "id", "content") == rows_of(want["timeline"], "query_id", "type", "id", "content")
    assert got["chunks"].count() == 12


def test_matched_patterns_are_counted_without_travelling(spark):
    """Patterns that match by two names or come twice count once, and no description is shuffled for it."""
    rows = [("w", f"p{i % 8}", "escalation_chain", "n", f"long {i % 8}", "high", 0.8, [f"service_{i % 4}", "docker"]) for i in range(12)] + [
        ("v", "p0", "escalation_chain", "n", "elsewhere", "high", 0.8, ["docker"])]
    found = spark.createDataFrame(rows, "workspace_id string, pattern_id string, pattern_type string, name string, description string, severity string, "
                                        "confidence double, entities array<string>").withColumn("last_detected", F.lit(BASE))
    asked = spark.createDataFrame([("q", "w", ["Docker", "service_1"]), ("r", "w", ["service_3"]), ("s", "w", ["none"])],
                                  "query_id string, workspace_id string, q_entities array<string>")
    counts = reasoning.pattern_counts(reasoning.pattern_matches(asked, found))
    assert {r["query_id"]: r["pattern_count"] for r in counts.collect()} == {"q": 8, "r": 2}
    plan = counts._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(query_id" in plan and not any("hashpartitioning" in line and "description" in line for line in plan.splitlines())
    hits = spark.createDataFrame([], "query_id string, rank int, chunk_id string, source_type string, text string")
    told = reasoning.key_findings(hits, reasoning.pattern_matches(asked, found))
    assert sorted((r["query_id"], r["n"], r["ref"]) for r in told.collect()) == [("q", 1, "p0"), ("q", 2, "p1"), ("r", 1, "p3"), ("r", 2, "p7")]
    assert reasoning.matching_patterns(asked, found).count() == 10
