import random
import re

import xxhash

from memograph.llm import simhash


def reference(text, shingle):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return 0
    parts = [" ".join(words[i:i + shingle]) for i in range(max(1, len(words) - shingle + 1))]
    hashes = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
    value = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))
    return value - (1 << 64) if value >> 63 else value


def closed(fps):
    root = {i: i for i in fps}
    changed = True
    while changed:
        changed = False
        for i, a in fps.items():
            for j, b in fps.items():
                if bin((a ^ b) & (1 << 64) - 1).count("1") <= 2 and root[i] > root[j]:
                    root[i], changed = root[j], True
    return root


def texts():
    rng = random.Random(5)
    words = [f"w{i}é" if i % 7 == 0 else f"W{i}" for i in range(40)]
    base = [" ".join(rng.choices(words, k=rng.choice([1, 2, 5, 60]))) for _ in range(30)]
    near = [b + " \t extra" for b in base[:10]] + [b.upper() for b in base[:10]]
    return [*base, *near, *base[:5], None, "", " \n\t ", "one", "x y z", "long " * 30000 + "end"]


def test_near_duplicates_match_brute_force(spark):
    data = list(enumerate(texts()))
    docs = spark.createDataFrame([(i, t, "q", 1) for i, t in data], "doc_id long, text string, fp string, n int")
    want = {i: reference(t, 3) for i, t in data}
    for cap in (64, 1):
        got = {r["doc_id"]: r for r in simhash.near_duplicates(docs, bucket_cap=cap).collect()}
        assert {i: r["fp"] for i, r in got.items()} == want
        assert {i: r["component_id"] for i, r in got.items()} == closed(want)


def fingerprints_near(rng):
    """Groups of fingerprints a few bits apart, chained and crowded."""
    fps = set()
    for _ in range(12):
        base = rng.getrandbits(64)
        for _ in range(25):
            x = base
            for b in rng.sample(range(64), rng.choice([0, 1, 2, 3])):
                x ^= 1 << b
            fps.add(x - (1 << 64) if x >> 63 else x)
    return sorted(fps)


def test_links_match_brute_force(spark):
    fps = fingerprints_near(random.Random(9))
    classes = spark.createDataFrame(list(zip(fps, range(len(fps)))), "fp long, root long")
    want = closed(dict(enumerate(fps)))
    for cap in (1000, 3):
        found = {r["node"]: r["root"] for r in simhash.components(simhash.link(classes, bucket_cap=cap)).collect()}
        assert {i: found.get(i, i) for i in want} == want


def test_thresholds_sum_and_prefer_cheap_parts():
    cost = [{-1: 0, 0: 5.0, 1: 7.0, 2: 90.0}, {-1: 0, 0: 50.0, 1: 100.0}, {-1: 0, 0: 4.0, 1: 60.0}]
    assert simhash.allocate(cost, 0) == [1, -1, 0]


def test_keep_one(spark):
    rows = [(1, "a b c d e f g h"), (2, "A b c d e f g h"), (3, "other words entirely here now"), (3, "other words entirely here now"), (4, None), (5, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted((r["doc_id"] for r in simhash.keep_one(docs, shingle=5).collect())) == [1, 3, 4]
    assert simhash.keep_one(docs.limit(0)).count() == 0
