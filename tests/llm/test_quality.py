import itertools

import numpy as np
from pyspark.sql import functions as F

from memograph.llm import quality


def test_marginals_match_enumeration():
    rng = np.random.default_rng(3)
    per_text = np.array([1, 4, 2, 5])
    good, trans = rng.normal(size=per_text.sum()), rng.normal(size=(2, 2))
    p, pairs, log_z = quality.marginals(good, trans, per_text)
    want, want_pairs, want_z, at = np.zeros(len(good)), np.zeros((2, 2)), 0.0, 0
    for n in per_text:
        total, line, edge = 0.0, np.zeros(n), np.zeros((2, 2))
        for y in itertools.product((0, 1), repeat=int(n)):
            s = np.exp(sum(good[at + i] for i in range(n) if y[i]) + sum(trans[y[i - 1], y[i]] for i in range(1, n)))
            total += s
            line += s * np.array(y)
            for i in range(1, n):
                edge[y[i - 1], y[i]] += s
        want[at:at + n] = line / total
        want_pairs += edge / total
        want_z += np.log(total)
        at += n
    assert np.allclose(p, want) and np.allclose(pairs, want_pairs) and np.isclose(log_z, want_z)


def test_line_counts():
    texts = ["Ab 1é|\n\nx x x.".encode(), b"", b"a" * 5, ("w " * (quality.PIECE // 2 + 3)).encode()]
    x, length, per_text = quality.line_features(texts)
    assert list(per_text) == [3, 1, 1, 1]
    assert list(length) == [7, 1, 6, 1, 5, quality.PIECE + 6]
    assert x[2, 7] == 0.5 and x[2, 11] == 1.0 and x[3, 12] == 1.0


def corpus():
    rng = np.random.default_rng(1)
    words = [f"w{chr(97 + i)}{chr(97 + j)}" for i in range(20) for j in range(20)]
    rows = []
    for i in range(400):
        lines = [" ".join(rng.choice(words, 12)) + "." for _ in range(1 + i % 5)]
        if i % 4 == 0:
            lines[-1:] = [" ".join(w.upper() + "!!" for w in rng.choice(words, 30))]
        rows.append((i, "\n".join(lines), int(i % 4 != 0)))
    return rows


def test_held_out_accuracy(spark):
    rows = corpus()
    docs = spark.createDataFrame([(i, t, "clash") for i, t, _ in rows], "doc_id long, text string, label string")
    labels = spark.createDataFrame([(i, q) for i, _, q in rows], "doc_id long, quality int")
    model = quality.train(docs, labels)
    truth = {i: q for i, _, q in rows}
    got = quality.score(docs, model).select("doc_id", "score", quality.held_out(F.col("doc_id")).alias("h")).collect()
    held = [r for r in got if r["h"]]
    assert len(held) > 50 and all((r["score"] >= 0.7) == bool(truth[r["doc_id"]]) for r in held)


def test_odd_rows(spark):
    rows = corpus()
    labels = spark.createDataFrame([(i, q) for i, _, q in rows], "doc_id long, quality int")
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    model = quality.train(docs, labels)
    odd = spark.createDataFrame([(1, None, 9.0), (2, "", 9.0), (2, "", 9.0), (None, "a b\n" * 100000, 9.0)], "doc_id long, text string, score double")
    got = quality.score(odd, model).collect()
    assert len(got) == 4 and all(0 <= r["score"] <= 1 for r in got) and len({r["score"] for r in got[:3]}) == 1
    assert quality.score(odd.limit(0), model).count() == 0
    assert quality.train(docs.limit(0), labels.limit(0)) == 0.5
    one = quality.train(docs, labels.filter("quality = 1"))
    assert one == 1.0 and {r["score"] for r in quality.score(odd, one).collect()} == {1.0}
