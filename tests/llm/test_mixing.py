import math

from memograph.llm import mixing


def fill(sizes, weights, total, cap):
    """Share by weight, stop at the cap, share the excess again."""
    target, open_ = {s: 0.0 for s in sizes}, set(sizes)
    left = total
    while open_ and left > 1e-9:
        w = sum(weights[s] for s in open_)
        over = [s for s in open_ if left * weights[s] / w > cap * sizes[s]]
        if not over:
            for s in open_:
                target[s] = left * weights[s] / w
            break
        for s in over:
            target[s] = cap * sizes[s]
        left -= sum(target[s] for s in over)
        open_ -= set(over)
    return target


def rows():
    out, i = [], 0
    for s, n, k in (("a", 3, 10), ("b", 40, 20), ("ä", 25, 7), ("B", 5, 400), (None, 6, 3), ("zero", 2, 0)):
        for j in range(n):
            out.append((i, " ".join(["w!"] * (k + j % 3 if k else 0)) if k else ("" if j else None), s, "clash", 1))
            i += 1
    return out


def test_targets_and_taken(spark):
    docs = spark.createDataFrame(rows(), "doc_id long, text string, source string, target string, key int").repartition(5)
    got = mixing.mix(docs, [5.0, 2.0, 1.0]).collect()
    sizes, ids = {}, {}
    for i, t, s, *_ in rows():
        sizes[s] = sizes.get(s, 0) + len((t or "").split())
    order = sorted([s for s in sizes if s is not None]) + [None]
    want = fill(sizes, {s: [5, 2, 1][k % 3] for k, s in enumerate(order)}, sum(sizes.values()), 3)
    taken = {}
    for r in got:
        s = r["source"]
        assert r["source_size"] == sizes[s] and math.isclose(r["target"], want[s], rel_tol=1e-9, abs_tol=1e-9)
        assert 0 <= r["taken"] <= 3 * r["size"]
        taken[s] = taken.get(s, 0) + r["taken"]
        ids[r["doc_id"]] = r["taken"]
    assert len(got) == len(rows()) and all(abs(taken[s] - want[s]) <= 0.5 + 1e-9 for s in sizes)
    again = {r["doc_id"]: r["taken"] for r in mixing.mix(docs.repartition(2), [5.0, 2.0, 1.0]).collect()}
    assert again == ids


def test_better_documents_come_first(spark):
    docs = spark.createDataFrame([(i, "word " * 10 if i % 2 else "##1! " * 10, "s") for i in range(400)] + [
        (1000 + i, "word " * 10, "t") for i in range(400)], "doc_id long, text string, source string")
    got = mixing.mix(docs, [1.0, 3.0]).filter("source = 's'").collect()
    good = sum(r["taken"] > 0 for r in got if r["doc_id"] % 2)
    assert good > 2 * sum(r["taken"] > 0 for r in got if r["doc_id"] % 2 == 0)


def test_take_repeats_whole_documents(spark):
    docs = spark.createDataFrame(rows(), "doc_id long, text string, source string, target string, key int")
    mixed = mixing.take(docs, [5.0, 2.0, 1.0])
    assert mixed.columns == docs.columns
    texts = {r[0]: r[1] for r in rows()}
    assert all(r["text"] == texts[r["doc_id"]] for r in mixed.collect())
    assert mixing.take(docs.limit(0), [1.0]).count() == 0
    assert mixing.mix(docs.limit(0), [1.0]).count() == 0
