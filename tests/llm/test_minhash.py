"""Near-duplicates by banded minimum hashes, on planted pairs, large groups and odd ids."""

import random

import numpy as np
import pytest

import corpus_pipeline
from memograph.llm import minhash, simhash

DOCS = "doc_id long, text string"


def word(rng):
    return "".join(rng.choices("abcdefghij", k=10))


def planted(rng, n, similarity):
    """Two texts of n and fewer words, with 4 words more than shingles, at this similarity or just above."""
    words = [word(rng) for _ in range(n + 4)]
    drop = int(n * (1 - similarity) + 1e-9)
    return " ".join(words), " ".join(words[:len(words) - drop])


def jaccard(a, b):
    x, y = minhash.shingles(a.encode(), 5), minhash.shingles(b.encode(), 5)
    return len(x & y) / len(x | y)


@pytest.mark.parametrize("similarity", [0.8, 0.85, 0.9])
@pytest.mark.parametrize("n", [20, 200])
def test_planted_pairs_meet(similarity, n):
    rng, met = random.Random(n), 0
    for _ in range(300):
        a, b = planted(rng, n, similarity)
        assert similarity <= jaccard(a, b) < similarity + 0.01
        met += bool(set(minhash.band_keys(minhash.shingle_set(a.encode(), 5))) & set(minhash.band_keys(minhash.shingle_set(b.encode(), 5))))
    assert met >= 299


def test_short_and_long_copies_go(spark):
    rng, rows = random.Random(3), []
    for n in (10, 20, 200):
        for similarity in (0.8, 0.9):
            for _ in range(50):
                rows += [(len(rows) + k, t) for k, t in enumerate(planted(rng, n, similarity))]
    kept = {r["doc_id"] for r in corpus_pipeline.drop_near_copies(spark, spark.createDataFrame(rows, DOCS), "").collect()}
    assert kept == {i for i, _ in rows if i % 2 == 0}


def test_large_group_matches_brute_force(spark):
    """Copies of a text that is not there itself, most of them near the limit, and some below it."""
    rng = random.Random(4)
    base, texts = [word(rng) for _ in range(300)], []
    for k in range(400):
        words = list(base)
        for at in rng.sample(range(300), rng.choice([3, 4, 5]) if k % 4 else 10):
            words[at] = word(rng)
        texts.append(" ".join(words))
    sets = [minhash.shingle_set(t.encode(), 5) for t in texts]
    root = list(range(len(sets)))
    near = [(i, j) for i in range(len(sets)) for j in range(i) if minhash.similar(sets[i], sets[j], 0.8)]
    changed = True
    while changed:
        changed = False
        for i, j in near:
            low = min(root[i], root[j])
            changed |= root[i] != root[j]
            root[i] = root[j] = low
    got = {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(spark.createDataFrame(list(enumerate(texts)), DOCS)).collect()}
    assert 1 < len(set(root)) < 300 and got == dict(enumerate(root))


def test_blocks_bring_all_unlike_roots_together(monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK", 50)
    rng = np.random.default_rng(5)
    nodes, sizes = np.arange(100, 220), rng.integers(1, 30, 120)
    for roots in (rng.integers(0, 3, 120), np.where(np.arange(120) % 40, 0, np.arange(120)), np.arange(120)):
        groups = [set(g.tolist()) for g in minhash.comparisons(nodes, sizes, roots)]
        assert all(any({100 + i, 100 + j} <= g for g in groups) for i in range(120) for j in range(i) if roots[i] != roots[j])
        assert max(sum(sizes[n - 100] for n in g) for g in groups) <= 2 * (50 + 30)
    assert not list(minhash.comparisons(nodes, sizes, nodes * 0))


def test_links_reach_what_all_pairs_reach():
    rng = np.random.default_rng(6)
    sets = [np.unique(rng.integers(0, 12, rng.integers(1, 14)).astype(np.uint64)) for _ in range(80)]
    for similarity in (0.5, 0.8, 1.0):
        parts = []
        for found in (minhash.links(sets, similarity), [(i, j) for i in range(80) for j in range(i) if minhash.similar(sets[i], sets[j], similarity)]):
            root = list(range(80))
            for _ in range(80):
                for i, j in found:
                    root[i] = root[j] = min(root[i], root[j])
            parts.append(root)
        assert parts[0] == parts[1]


def test_repeated_lines_neither_link_nor_part(spark):
    rng = random.Random(7)
    line, body = " ".join(word(rng) for _ in range(7)), [" ".join(word(rng) for _ in range(120)) for _ in range(3)]
    rows = [(1, f"{body[0]} " + f"{line} " * 400), (2, f"{body[1]} " + f"{line} " * 400), (3, f"{body[2]} {line} {line}"), (4, f"{body[2]} " + f"{line} " * 300)]
    assert jaccard(rows[0][1], rows[1][1]) < 0.1 and jaccard(rows[2][1], rows[3][1]) >= 0.8
    kept = {r["doc_id"] for r in corpus_pipeline.drop_near_copies(spark, spark.createDataFrame(rows, DOCS), "").collect()}
    assert kept == {1, 2, 3}


@pytest.mark.parametrize("operator", [minhash, simhash])
def test_unlike_texts_without_an_id_of_their_own(spark, operator):
    rng = random.Random(9)
    one, two, three, four = (" ".join(word(rng) for _ in range(40)) for _ in range(4))
    rows = [(None, one), (None, two), (None, one), (5, three), (None, three.upper()), (6, one + " x" if operator is minhash else one.upper()), (7, two[:50]), (7, four)]
    docs = spark.createDataFrame(rows, DOCS)
    kept = sorted((tuple(r) for r in operator.keep_one(docs).collect()), key=str)
    assert kept == sorted([(None, two), (5, three), rows[5], (7, two[:50]), (7, four)], key=str)
    found = operator.near_duplicates(docs)
    assert found.count() == len(rows) and found.filter("doc_id is null and component_id is null").count() == 1


def test_recall_and_false_removals_by_band(spark):
    """The pipeline's stage on planted pairs; test_large_group_matches_brute_force has a group of several hundred."""
    rng, rows, band = random.Random(11), [], {}
    for similarity in (0.5, 0.7, 0.78, 0.8, 0.85, 0.9, 0.95):
        for k in range(100):
            for t in planted(rng, 100, similarity):
                band[len(rows)] = similarity
                rows.append((len(rows), t))
    kept = {r["doc_id"] for r in corpus_pipeline.drop_near_copies(spark, spark.createDataFrame(rows, DOCS), "").collect()}
    gone = [band[i] for i, _ in rows if i not in kept]
    assert all(i % 2 for i in range(len(rows)) if i not in kept)
    assert {s: gone.count(s) for s in sorted(set(band.values()))} == {0.5: 0, 0.7: 0, 0.78: 0, 0.8: 100, 0.85: 100, 0.9: 100, 0.95: 100}


def prose(rng, n):
    return [("".join(rng.choices("abcdefgh", k=rng.randint(2, 9)))) for _ in range(n)]


def data():
    """Groups of copies with a few changed words, and texts of their own."""
    rng, rows, group = random.Random(8), [], {}
    for g in range(25):
        base = prose(rng, rng.choice([60, 200, 500]))
        for c in range(1 + g % 6 if g else 60):
            words = list(base)
            for _ in range(int(len(words) * rng.choice([0, 0.01, 0.02])) if c else 0):
                words[rng.randrange(len(words))] = "changed"
            rows.append((len(rows), " ".join(words)))
            group[rows[-1][0]] = g
    return rows, group


def brute(rows, similarity=0.8):
    sets = {i: minhash.shingles(t.encode(), 5) for i, t in rows}
    root = {i: i for i in sets}
    changed = True
    while changed:
        changed = False
        for i in sets:
            for j in sets:
                if root[i] > root[j] and len(sets[i] & sets[j]) >= similarity * len(sets[i] | sets[j]):
                    root[i], changed = root[j], True
    return root


def test_groups_of_copies(spark):
    rows, group = data()
    docs = spark.createDataFrame([(i, t, "clash", 1) for i, t in rows], "doc_id long, text string, keys string, w0 int").repartition(4)
    got = {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(docs).collect()}
    want = brute(rows)
    assert all(group[i] == group[c] for i, c in got.items())
    assert np.mean([got[i] == want[i] for i in got]) > 0.97
    kept = minhash.keep_one(docs)
    assert kept.columns == docs.columns and kept.count() == len(set(got.values()))


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, "one"), (3, "one"), (None, "one"), (4, "two words"), (5, "w " * 60000), (6, "W " * 60000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r["doc_id"] or 0, r["component_id"]) for r in minhash.near_duplicates(docs).collect())
    assert got == [(0, 3), (1, 1), (2, 1), (3, 3), (3, 3), (4, 4), (5, 5), (6, 5)]
    assert minhash.near_duplicates(docs.limit(0)).count() == 0
