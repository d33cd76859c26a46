"""Physical patterns against brute force, with hot keys, equal times and copies."""

import random

import numpy as np
from pyspark.sql import functions as F

from memograph.operators import resolution, timeline, upsert
from memograph.plans import timescan
from memograph.plans.bounded import broadcast_if_small
from memograph.plans import neighbours
from memograph.plans.neighbours import knn_join
from memograph.plans.rangejoin import follow_join

HOUR = 3_600_000_000


def skewed(spark, n=400, seed=5):
    """A third of the rows in one workspace, and many at one instant."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        ws = "hot" if i % 3 == 0 else f"w{i % 7}"
        us = 1_700_000_000_000_000 + (0 if i % 9 == 0 else rng.randrange(0, 60 * HOUR))
        rows.append((f"e{i:04d}", ws, us, rng.choice(["deployment", "incident", "outage", "discussion"])))
    df = spark.createDataFrame(rows, "event_id string, workspace_id string, us long, event_type string")
    return rows, df.withColumn("ts", F.timestamp_micros("us")).drop("us")


def test_previous_instants_equal_a_plain_lag(spark):
    rows, df = skewed(spark)
    got = {r["event_id"]: r["delta_seconds"] for r in timeline.deltas(df).select("event_id", "delta_seconds").collect()}
    by_ws = {}
    for e, ws, us, _ in rows:
        by_ws.setdefault(ws, []).append((us, e))
    for listed in by_ws.values():
        before = None
        for us, e in sorted(listed):
            want = None if before is None else (us - before) / 1e6
            assert got[e] == want
            before = us


def test_sessions_equal_a_sequential_scan(spark):
    rows, df = skewed(spark)
    got = {r["event_id"]: r["cluster_id"] for r in timeline.cluster_members(df, 2 * HOUR).collect()}
    by_ws = {}
    for e, ws, us, _ in rows:
        by_ws.setdefault(ws, []).append((us, e))
    for listed in by_ws.values():
        number, before = 0, None
        for us, e in sorted(listed):
            number += before is None or us - before > 2 * HOUR
            assert got[e] == number
            before = us


def test_counts_following_equal_pairs(spark):
    rows, df = skewed(spark)
    left, right = df.filter("event_type = 'deployment'"), df.filter("event_type <> 'deployment'")
    got = {r["event_id"]: r["n"] for r in timescan.count_following(
        left, right, ["workspace_id"], "ts", HOUR, {"n": F.lit(1)}).collect()}
    for e, ws, us, kind in rows:
        if kind == "deployment":
            assert got[e] == sum(1 for _, w, u, k in rows if w == ws and k != "deployment" and us <= u <= us + HOUR)


def test_follow_join_equals_nested_loops(spark):
    rows, df = skewed(spark)
    left = df.filter("event_type = 'deployment'").select("workspace_id", F.col("event_id").alias("a"), F.col("ts").alias("at"))
    right = df.filter("event_type = 'incident'").select("workspace_id", F.col("event_id").alias("b"), F.col("ts").alias("bt"))
    got = sorted((r["a"], r["b"]) for r in follow_join(left, right, ["workspace_id"], "at", "bt", HOUR).collect())
    want = sorted((a[0], b[0]) for a in rows for b in rows if a[1] == b[1] and a[3] == "deployment" and b[3] == "incident"
                  and a[2] <= b[2] <= a[2] + HOUR)
    assert got == want


def test_rolling_counts(spark):
    rows, df = skewed(spark)
    got = {(r["workspace_id"], r["us"]): r["n"] for r in timescan.ending_at_counts(df, ["workspace_id"], "ts", 5 * HOUR).collect()}
    for _, ws, us, _ in rows:
        assert got[(ws, us)] == sum(1 for _, w, u, _ in rows if w == ws and us - 5 * HOUR <= u <= us)


def test_cell_width_does_not_change_results(spark):
    _, df = skewed(spark)
    points = df.select("workspace_id", timescan.micros("ts").alias("us"), F.lit(0).alias("rank"), F.lit(1).cast("long").alias("n"))
    wide = timescan.running_sums(points, ["workspace_id"], ["n"], 50 * HOUR).collect()
    fine = timescan.running_sums(points, ["workspace_id"], ["n"], HOUR // 60).collect()
    assert sorted(map(tuple, wide)) == sorted(map(tuple, fine))


def brute(vectors, queries, k):
    ids = sorted(vectors)
    m = np.array([vectors[i] for i in ids], dtype=float)
    m = m / np.where(np.linalg.norm(m, axis=1, keepdims=True) == 0, 1, np.linalg.norm(m, axis=1, keepdims=True))
    out = {}
    for q in queries:
        v = np.array(vectors[q], dtype=float)
        size = np.linalg.norm(v)
        cos = np.round(m @ (v / size if size else v), 9)
        order = sorted(range(len(ids)), key=lambda i: (-cos[i], ids[i]))[:k]
        out[q] = [ids[i] for i in order]
    return out


def test_pruned_neighbours_equal_brute_force(spark):
    """Clusters, a third of all rows one copied vector, zero vectors, and blocks far smaller than the group."""
    rng = np.random.default_rng(3)
    centers = rng.normal(size=(6, 8))
    vectors = {}
    for i in range(240):
        if i % 3 == 0:
            vectors[i] = [1.0, 2.0, 0.5, 0.0, 0.0, 1.0, 0.0, 0.0]
        elif i in (1, 2):
            vectors[i] = [0.0] * 8
        else:
            vectors[i] = (centers[i % 6] + 0.05 * rng.normal(size=8)).tolist()
    df = spark.createDataFrame([(i, "w", v) for i, v in vectors.items()], "id long, ws string, embedding array<double>")
    near = knn_join(df, df.withColumnRenamed("id", "near"), 7, ["ws"], "id", "near", block=16, pivots=5)
    got = {}
    for r in near.orderBy("id", "rank").collect():
        got.setdefault(r["id"], []).append(r["near"])
    want = brute(vectors, vectors, 7)
    assert len(got) == 240
    assert got == want


def test_one_block_and_many_blocks_agree(spark):
    rng = np.random.default_rng(9)
    df = spark.createDataFrame([(i, f"w{i % 2}", rng.normal(size=6).tolist()) for i in range(120)],
                               "id long, ws string, embedding array<double>")
    other = df.withColumnRenamed("id", "near")
    whole = knn_join(df, other, 4, ["ws"], "id", "near").select("id", "near", "rank").collect()
    cut = knn_join(df, other, 4, ["ws"], "id", "near", block=10, pivots=3).select("id", "near", "rank").collect()
    assert sorted(map(tuple, whole)) == sorted(map(tuple, cut))


def test_best_of_equals_a_stable_sort():
    """Ties, rows without numbers and points without numbers, over more points than the first bound looks at."""
    rng = np.random.default_rng(2)
    for n, m, k in ((50, 7, 10), (40, 1500, 6), (30, 1100, 1050)):
        a, b = np.round(rng.normal(size=(n, 3)), 1), np.round(rng.normal(size=(m, 3)), 1)
        a[3], b[::5] = np.nan, np.nan
        cos = np.round(a @ b.T, 9)
        top = np.argsort(-cos, axis=1, kind="stable")[:, :k]
        row, point, value = neighbours.best_of(a, b, k)
        assert row.tolist() == np.repeat(np.arange(n), top.shape[1]).tolist() and point.tolist() == top.ravel().tolist()
        assert np.allclose(value, cos[row, point], equal_nan=True)


def test_pieces_of_work_do_not_grow_with_the_group(spark, monkeypatch):
    """Vectors without structure, in a group of many small blocks: query blocks meet a bounded number of point blocks."""
    rng, cut, pieces = np.random.default_rng(4), neighbours.cut_lineage, []

    def counted(df):
        out = cut(df)
        if out.columns == ["_g", "_home", "_qb", "_cell", "_pbs"]:
            pieces.append(out.agg(F.sum("_pbs")).first()[0])
        return out

    monkeypatch.setattr(neighbours, "cut_lineage", counted)
    df = spark.createDataFrame([(i, rng.normal(size=16).tolist()) for i in range(1600)], "id long, embedding array<double>")
    assert knn_join(df, df.withColumnRenamed("id", "near"), 3, [], "id", "near", block=8).count() == 4800
    assert 0 < sum(pieces) <= 1000


def test_broadcast_needs_a_proven_size(spark):
    small, large = spark.range(10), spark.range(100)
    assert "broadcast" in broadcast_if_small(small, 20)._jdf.queryExecution().toString().lower()
    assert "broadcast" not in broadcast_if_small(large, 20)._jdf.queryExecution().toString().lower()


def test_components_of_a_long_chain(spark):
    pairs = spark.createDataFrame([(f"n{i:03d}", f"n{i + 1:03d}") for i in range(40)] + [("z1", "z2")], "a string, b string")
    labels = {r["id"]: r["label"] for r in resolution.components(pairs, "a", "b").collect()}
    assert set(labels[f"n{i:03d}"] for i in range(41)) == {"n000"}
    assert labels["z2"] == "z1"


def test_similar_sets_equal_all_pairs(spark):
    rng = random.Random(4)
    words = ["api", "db", "core", "east", "west", "node", "pool", "cache", "edge", "web", "x1", "x2"]
    names = {" ".join(sorted(rng.sample(words, rng.randint(1, 11)))) for _ in range(150)}
    rows = spark.createDataFrame([("w", "system", n) for n in sorted(names)], "workspace_id string, type string, name string")
    sets = resolution._token_sets(rows)
    got = {(r["left_set"], r["right_set"]) for r in resolution.similar_sets(sets, sets, 0.8).collect()}
    want = set()
    for a in names:
        for b in names:
            x, y = set(a.split()), set(b.split())
            if len(x & y) / len(x | y) >= 0.8:
                want.add((" ".join(sorted(x)), " ".join(sorted(y))))
    assert got == want


def test_event_upsert_is_idempotent_and_order_free(spark):
    _, df = skewed(spark, 120)
    events = df.select("*", F.lit("Same title").alias("title"), F.lit(None).cast("string").alias("description"),
                       F.lit("low").alias("severity"), F.lit(0.5).alias("confidence"), F.lit("c").alias("chunk_id"),
                       F.lit("{}").alias("metadata"))
    once = upsert.upsert_events(events, HOUR)
    again = upsert.upsert_events(once.select(*events.columns), HOUR)
    shuffled = upsert.upsert_events(events.repartition(5).orderBy(F.rand(3)), HOUR)
    key = ["workspace_id", "event_type", "event_id", "confidence"]
    assert sorted(map(tuple, once.select(*key).collect())) == sorted(map(tuple, shuffled.select(*key).collect()))
    # The merged rows keep their first time, so a second pass merges only heads that lie within the tolerance.
    assert again.count() <= once.count()


def test_containing_both_ways(spark):
    from memograph.plans.substring import containing

    texts = spark.createDataFrame([("w", i, t) for i, t in enumerate(["alpha beta", "beta", "b", "", "éta bé", None])] + [("v", 9, "beta")],
                                  "ws string, n int, t string")
    needles = spark.createDataFrame([("w", q) for q in ["beta", "b", "be", "", "éta", "missing", "a b", None]], "ws string, q string")
    both = [sorted((r["n"], r["q"]) for r in containing(texts, F.col("t"), needles, F.col("q"), ["ws"], small=s).collect()) for s in (True, False)]
    assert both[0] == both[1] and (0, "a b") in both[0] and (3, "") in both[0] and all(n != 9 for n, _ in both[0])
