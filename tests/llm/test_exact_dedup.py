from memograph.llm import exact_dedup

ROWS = [(1, "Same"), (2, "same"), (3, "sAME"), (4, None), (5, ""), (6, "É"), (7, "é"), (8, "rep"), (8, "rep"), (None, "rep"), (None, "Lone"), (9, "x" * 200000)]


def expected(rows):
    groups = {}
    for i, (d, t) in enumerate(rows):
        groups.setdefault("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""), []).append(((d is not None, d or 0), d))
    out = []
    for members in groups.values():
        keep = max(members)[1]
        stays = 1
        for _, d in members:
            out.append((d, keep, len(members), bool(d == keep and stays)))
            stays -= d == keep and stays
    return sorted(out, key=str)


def test_both_paths_give_the_same(spark):
    docs = spark.createDataFrame([(i, t, "z", 1) for i, t in ROWS], "doc_id long, text string, digest string, n int")
    for share in (0.0, 0.2, 2.0):
        got = [(r["doc_id"], r["keep_id"], r["group_size"], r["kept"]) for r in exact_dedup.decide(docs, share=share).collect()]
        assert sorted(got, key=str) == expected(ROWS)
    kept = exact_dedup.drop_copies(docs)
    assert kept.columns == docs.columns
    assert sorted((str(r["doc_id"]) for r in kept.collect())) == sorted(str(r[0]) for r in expected(ROWS) if r[3])


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert exact_dedup.decide(docs).count() == 0
    assert exact_dedup.drop_copies(docs).count() == 0


def test_no_python_in_the_plan(spark):
    docs = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    plan = exact_dedup.decide(docs)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
