import random
from collections import Counter

import numpy as np

from memograph.llm import suffix_dedup

SCHEMA = "doc_id long, text string, found string, place int"


def brute(texts, length):
    data = [(t or "").encode() for t in texts]
    count = Counter(d[s:s + length] for d in data for s in range(len(d) - length + 1))
    out = []
    for d in data:
        gone = np.zeros(len(d) + 2, dtype=int)
        for s in range(len(d) - length + 1):
            if count[d[s:s + length]] > 1:
                gone[s + 1:s + length + 1] = 1
        steps = np.diff(gone)
        out.append((len(d), int(gone.sum()), int((steps == 1).sum()), bytes(np.frombuffer(d, np.uint8)[gone[1:len(d) + 1] == 0])))
    return out


def prose(rng, n):
    return " ".join("".join(rng.choices("abcdefghé\0", k=rng.randint(1, 9))) for _ in range(n))


def data():
    rng = random.Random(3)
    passages = [prose(rng, rng.randint(6, 40)) for _ in range(6)]
    texts = []
    for _ in range(60):
        parts = [prose(rng, rng.randint(0, 30))]
        for _ in range(rng.randint(0, 3)):
            p = rng.choice(passages)
            a, b = sorted(rng.choices(range(len(p) + 1), k=2))
            parts += [p[a:b] if rng.random() < 0.6 else p, prose(rng, rng.randint(0, 6))]
        texts.append(" ".join(parts))
    near = prose(rng, 80)
    texts += [near[:k] + "X" + near[k + 1:] for k in range(50, 400, 31)]
    texts += [None, "", "short", "a" * 900, "ab" * 300 + "c" + "ab" * 200, "x" * 39, "y" * 40, "y" * 41, texts[0], texts[0], texts[5], "\0" * 100]
    return texts


def test_matches_brute_force(spark):
    texts = data()
    docs = spark.createDataFrame([(k, t, "clash", 1) for k, t in enumerate(texts)], SCHEMA).repartition(4)
    want = {k: r for k, r in enumerate(brute(texts, 40))}
    for cap in (1 << 15, 4):
        got = {r[0]: (r[1], r[2], r[3], bytes(r[4])) for r in suffix_dedup.remove_repeats(docs, length=40, span=24, group_cap=cap).collect()}
        assert got == want
    assert sum(r[1] > 0 for r in want.values()) > 30


def test_repeated_rows_null_ids_and_empty(spark):
    rng = random.Random(4)
    t, u = prose(rng, 50), prose(rng, 50)
    docs = spark.createDataFrame([(1, t, "x", 1), (1, t, "x", 1), (2, u, "x", 1), (None, u, "x", 1), (None, prose(rng, 50), "x", 1)], SCHEMA)
    got = sorted(((r["doc_id"] or 0, r["n_removed"] == r["n_bytes"]) for r in suffix_dedup.remove_repeats(docs, 40, 24).collect()))
    assert got == [(0, False), (0, True), (1, True), (1, True), (2, True)]
    assert suffix_dedup.remove_repeats(docs.limit(0)).count() == 0


def test_long_texts_across_pieces(spark, monkeypatch):
    rng = random.Random(6)
    text = prose(rng, 400)
    whole = suffix_dedup.anchors(text.encode(), 400, 320)
    monkeypatch.setattr(suffix_dedup, "PIECE", 300)
    cut = suffix_dedup.anchors(text.encode(), 400, 320)
    picks = lambda f: [p for p, a, b in zip(*f) for _ in range(a, b + 1)]
    assert picks(cut) == picks(whole) and len(picks(whole)) == len(text.encode()) - 399


def test_multikey_order_and_common_prefix():
    rng = np.random.default_rng(1)
    words = rng.integers(0, 3, size=(3000, 5)).astype(np.uint64).astype(">u8")
    words[:, 1] = words[:, 1] << 40
    order = suffix_dedup.multikey_order(words)
    rows = [words[k].tobytes() for k in order]
    assert rows == sorted(rows)
    shared = suffix_dedup.common_prefix(words, order)
    for k in range(1, 3000):
        a, b = rows[k - 1], rows[k]
        assert shared[k] == next((i for i in range(40) if a[i] != b[i]), 40)
