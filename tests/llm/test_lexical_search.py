import math
import re
from collections import Counter

import numpy as np
import pytest

from memograph.llm import lexical_search

DOCS = "doc_id long, text string, row int, n string, score string, item_id int"
ITEMS = "item_id long, text string, doc_id int, rank int"


def terms(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, k):
    held = [(row[0], Counter(terms(row[1]))) for row in docs]
    held = [(i, c) for i, c in held if c]
    n, total = len(held), sum(sum(c.values()) for _, c in held)
    df = Counter(t for _, c in held for t in c)
    out = []
    for item in items:
        scores = []
        for place, (i, c) in enumerate(held):
            m = 50 + (50 * sum(c.values()) * n) // total
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((10 ** 9 * c[t]) // (1000 * c[t] + 20 * m)) for t in set(terms(item[1])) & set(c))
            if score > 0:
                scores.append((-score, i is None, i or 0, place, i))
        out += [(item[0], rank, s[4], -s[0]) for rank, s in enumerate(sorted(scores)[:k], 1)]
    return sorted(map(str, out))


def tables():
    rng = np.random.default_rng(3)
    names = [f"w{i}" for i in range(60)] + ["Ünder", "日本", "Mixed", "a1"]
    docs = [(i, " ".join(rng.choice(names[20 * (i % 3):], size=rng.integers(0, 60))), 1, "x", "y", 5) for i in range(700)]
    docs += [(None, "w1 w2 w3", 1, "x", "y", 5), (None, "w1 w2 w3", 1, "x", "y", 5), (5000, None, 1, "x", "y", 5), (5001, "", 1, "x", "y", 5), (5002, "...", 1, "x", "y", 5),
             (5003, "w7 W8 " * 300_000, 1, "x", "y", 5)]
    docs += docs[:40] + [(6000 + i, docs[3][1], 1, "x", "y", 5) for i in range(80)]
    items = [(i, " ".join(rng.choice(names, size=rng.integers(1, 12))), 1, 1) for i in range(30)]
    items += [(100, None, 1, 1), (101, "", 1, 1), (102, "unknown", 1, 1), (103, "w7 w7 W7", 1, 1), (None, "w1 w2", 1, 1), items[0], (104, " ".join(names), 1, 1)]
    return docs, items


@pytest.mark.parametrize("k,block_bytes", [(50, 1 << 19), (5, 300)])
def test_matches_brute_force(spark, k, block_bytes):
    docs, items = tables()
    got = lexical_search.rank_documents(spark.createDataFrame(docs, DOCS).repartition(4), spark.createDataFrame(items, ITEMS), k=k, share=8, block_bytes=block_bytes)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted(str(tuple(r)) for r in got.collect()) == brute(docs, items, k)


def test_empty_tables(spark):
    docs, items = tables()
    docs, items = spark.createDataFrame(docs[:5], DOCS), spark.createDataFrame(items, ITEMS)
    assert lexical_search.rank_documents(docs, items.limit(0)).count() == 0
    assert lexical_search.rank_documents(docs.limit(0), items).count() == 0


def test_bounds_drop_pairs_and_never_a_hit():
    rng = np.random.default_rng(0)
    leaf = lexical_search.LEAF
    x = rng.integers(1, 1000, size=(203, 40)) * (rng.random((203, 40)) < 0.1) * 1.0
    items = (rng.random((21, 40)) < 0.1) * 1.0
    x, items = x[lexical_search.similar_order(x, leaf)], items[lexical_search.similar_order(items, leaf)]
    score = x @ items.T
    weakest = np.sort(score, axis=0)[-5]
    left = lexical_search.pairs_left(lexical_search.maxima(x, leaf), lexical_search.maxima(items, leaf), weakest, leaf)
    pairs = np.repeat(np.repeat(left, leaf, axis=0)[:len(x)], leaf, axis=1)[:, :len(items)]
    assert pairs[score >= weakest].all() and not left.all()


def test_a_product_beyond_64_bits_is_divided_exactly():
    assert lexical_search.divided(np.array([10 ** 9, 7]), 10 ** 11, 10 ** 14).tolist() == [50 * 10 ** 9 * 10 ** 11 // 10 ** 14, 50 * 7 * 10 ** 11 // 10 ** 14]
