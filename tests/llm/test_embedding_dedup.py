import numpy as np

from memograph.llm import embedding_dedup

SCHEMA = "vec_id long, embedding array<float>, label int, n_links long, node string"


def brute(rows, threshold=0.98):
    good = {}
    for k, (i, v, label, *_) in enumerate(rows):
        if label is not None and v and None not in v and np.isfinite(v).all() and any(v):
            a = np.array(v, dtype=np.float32).astype(np.float64)
            good[k] = a / np.linalg.norm(a)
    links, root = [0] * len(rows), list(range(len(rows)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k
    for p in good:
        for q in good:
            if p < q and rows[p][2] == rows[q][2] and len(good[p]) == len(good[q]) and good[p] @ good[q] >= threshold:
                links[p] += 1
                links[q] += 1
                root[max(find(p), find(q))] = min(find(p), find(q))
    low = {}
    for k, r in enumerate(rows):
        low[find(k)] = min(low.get(find(k), r[0]), r[0])
    return sorted((r[0], links[k], low[find(k)], r[0] == low[find(k)]) for k, r in enumerate(rows))


def data():
    rng = np.random.default_rng(4)
    rows, i = [], 900
    for c in range(30):
        base = rng.normal(size=24)
        for _ in range(1 + c % 9 if c else 70):
            rows.append((i, (base + rng.normal(size=24) * rng.choice([0.0, 0.05, 0.15])).tolist(), c % 3, 1, "x"))
            i -= 1
    rows += [(r[0] + 2000, r[1], r[2], 1, "x") for r in rows[:40]]
    rows += [(5000, None, 1, 1, "x"), (5001, [], 1, 1, "x"), (5002, [0.0] * 24, 1, 1, "x"), (5003, [1.0, None], 1, 1, "x"),
             (5004, [float("nan")] * 24, 1, 1, "x"), (5005, rows[0][1], None, 1, "x"), (5006, [1.0, 2.0], 0, 1, "x"), (5007, [2.0, 4.0], 0, 1, "x"),
             (5008, [1e30, 1e30], 0, 1, "x"), (5009, [1.0, 1.0], 0, 1, "x"), (5009, [1.0, 1.0], 0, 1, "x")]
    return rows


def test_matches_brute_force(spark):
    rows = data()
    vectors = spark.createDataFrame(rows, SCHEMA).repartition(4)
    want = brute(rows)
    for block in (2048, 8):
        got = sorted((r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in embedding_dedup.near_duplicates(vectors, block=block).collect())
        assert got == want


def test_empty(spark):
    assert embedding_dedup.near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0


def test_rotation_keeps_length():
    x = np.random.default_rng(0).normal(size=(5, 16))
    y = embedding_dedup.rotate(x, np.ones((3, 16)))
    assert np.allclose(np.linalg.norm(y, axis=1), np.linalg.norm(x, axis=1) * 64)
