import math
import re
import zlib

import numpy as np
import pytest

from hashlib import sha256

from memograph.llm import importance

SCHEMA = "doc_id long, text string, row int, weight string, bucket string, rank int"


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def features(text, runs, buckets):
    w = words(text)
    return [zlib.crc32(" ".join(w[i:i + n]).encode()) % buckets for n in range(1, runs + 1) for i in range(len(w) - n + 1)]


def brute(docs, target, percent, least, buckets, runs, seed):
    s, t = np.zeros(buckets), np.zeros(buckets)
    for side, rows in ((s, docs), (t, target)):
        for row in rows:
            for b in features(row[1], runs, buckets):
                side[b] += 1
    gain = [math.floor(1000 * math.log((t[b] + 1) * (s.sum() + buckets) / ((s[b] + 1) * (t.sum() + buckets)))) for b in range(buckets)]
    out = []
    for row in docs:
        f = features(row[1], runs, buckets)
        weight = sum(gain[b] for b in f) // len(f) if f else 0
        h = int(sha256(f"{seed}:{'' if row[0] is None else row[0]}".encode()).hexdigest()[:8], 16)
        out.append([row[0], len(words(row[1])), len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2 ** 32))), None])
    able = sorted((r for r in out if r[1] >= least), key=lambda r: (-r[4], r[0] is None, r[0] or 0, r[3], r[1]))
    for place, r in enumerate(able[:percent * len(able) // 100], 1):
        r[5] = place
    return sorted(map(str, out))


def documents():
    rng = np.random.default_rng(5)
    names = ["Alpha", "beta", "gamma's", "Ünder", "x1", "y" * 300, "ß", "日本"]
    docs = [(i, " ".join(rng.choice(names, size=rng.integers(0, 40))) + ".", 1, "w", "b", 9) for i in range(200)]
    docs += [(None, "alpha beta gamma", 1, "w", "b", 9), (None, "other words", 1, "w", "b", 9), (1000, None, 1, "w", "b", 9), (1001, "", 1, "w", "b", 9),
             (1002, "., -!", 1, "w", "b", 9), (1003, "solo", 1, "w", "b", 9), (1004, "Alpha beta " * 60_000, 1, "w", "b", 9)]
    return docs + docs[:30] + [docs[7]] * 20


@pytest.mark.parametrize("runs,buckets", [(2, 10_000), (3, 97)])
def test_matches_brute_force(spark, runs, buckets):
    docs, target = documents(), [(1, "alpha x1 beta", 1, "", "", 1), (2, None, 1, "", "", 1), (3, "日本 alpha " * 50, 1, "", "", 1)]
    got = importance.resample(spark.createDataFrame(docs, SCHEMA).repartition(4), spark.createDataFrame(target, SCHEMA), least_words=3, runs=runs, buckets=buckets)
    assert sorted(str(list(r)) for r in got.select("doc_id", "n_words", "n_features", "weight", "score", "rank").collect()) == brute(docs, target, 25, 3, buckets, runs, 7)


def test_empty_tables(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert importance.resample(none, none).count() == 0
    some = spark.createDataFrame([(1, "a b " * 20, 1, "", "", 1)], SCHEMA)
    assert [r["weight"] for r in importance.resample(some, none).collect()] == [
        eval(brute([(1, "a b " * 20)], [], 25, 20, 10_000, 2, 7)[0])[3]]


def test_planes_give_the_exact_sum():
    rng = np.random.default_rng(1)
    counts, gain = rng.integers(0, 5000, size=(7, 1000)) * (rng.random((7, 1000)) < 0.1), rng.integers(-40_000, 40_000, size=1000)
    bits, worth = importance.gain_planes(gain)
    assert (importance.weighed(counts, bits, worth) == counts @ gain).all()


def test_pieces_count_like_the_whole(monkeypatch):
    text = ("one Two  three, " * 40 + "z" * 400 + " é " + "q" * 700 + " end").encode()
    whole = importance.bucket_counts([text, None, b"", b"a"], 500, 3)
    monkeypatch.setattr(importance, "PIECE", 30)
    cut = importance.bucket_counts([text, None, b"", b"a"], 500, 3)
    assert (whole[0] == cut[0]).all() and (whole[1] == cut[1]).all() and whole[1].tolist() == [124, 0, 0, 1]
