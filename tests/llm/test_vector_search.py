import numpy as np
import pytest

from memograph.llm import vector_search
from memograph.llm.common import table

SCHEMA = "vec_id long, embedding array<float>, label int, row string, low string, rank int"


def brute(rows, k):
    good = [(i, np.array(v, dtype=np.float32).astype(float)) for i, v, *_ in rows if v and None not in v and np.isfinite(v).all() and any(v)]
    out = []
    for own, (q, a) in enumerate(good):
        if q is None or q % 50:
            continue
        near = sorted((-round(float(a @ b / np.linalg.norm(a) / np.linalg.norm(b)), 9), i is None, i or 0, at) for at, (i, b) in enumerate(good)
                      if at != own and len(a) == len(b))[:k]
        out += [(q, rank, None if none else i, -s) for rank, (s, none, i, _) in enumerate(near, 1)]
    return sorted(map(str, out))


def found(df):
    return sorted(str((r["query_id"], r["rank"], r["vec_id"], round(r["score"], 9))) for r in df.collect())


def data():
    rng = np.random.default_rng(8)
    rows = [(i, rng.normal(size=8).tolist(), 0, "", "", 0) for i in range(400)]
    rows += [(1000 + i, rows[50][1], 0, "", "", 0) for i in range(60)]  # many copies of a query
    rows += [rows[100]] * 2 + [(None, rows[150][1], 0, "", "", 0)]
    odd = [None, [], [0.0] * 8, [1.0, None], [float("nan")] * 8, [float("inf")] * 8, [1e30, 1e30, 0.0], [2e-30, 3e-30, 0.0], [1.0, 0.5, 0.0]]
    return rows + [(2000 + 50 * i, v, 0, "", "", 0) for i, v in enumerate(odd)]


@pytest.mark.parametrize("params", [{}, {"block": 16, "first": 2}, {"rotations": 2, "first": 3, "most": 64}])
def test_small_table_is_searched_whole(spark, params):
    """With goal 1 and few vectors every query looks into every bucket it may need."""
    rows = data()
    got = vector_search.nearest(spark.createDataFrame(rows, SCHEMA).repartition(4), goal=1.0, **params)
    assert got.columns == ["query_id", "rank", "vec_id", "score"]
    assert found(got) == brute(rows, 5)


def test_fewer_rows_than_k_and_none(spark):
    rows = [(0, [1.0, 0.0], 0, "", "", 0), (1, [1.0, 1.0], 0, "", "", 0), (50, [0.0, 1.0], 0, "", "", 0)]
    assert found(vector_search.nearest(spark.createDataFrame(rows, SCHEMA))) == brute(rows, 5)
    assert vector_search.nearest(spark.createDataFrame([], SCHEMA)).count() == 0


def test_recall_on_the_table(spark):
    vectors = table(spark, "/root/testdata/sf0.1", "embeddings")
    rows = [(r["vec_id"], r["embedding"]) for r in vectors.select("vec_id", "embedding").collect()]
    want, got = set(), set()
    for line in brute(rows, 5):
        q, _, v, _ = eval(line)
        want.add((q, v))
    got = {(r["query_id"], r["vec_id"]) for r in vector_search.nearest(vectors).collect()}
    assert len(got & want) >= 0.9 * len(want)


def test_probes_come_in_order_of_their_sums():
    on_axes = np.random.default_rng(0).normal(size=(5, 2, 8))
    codes = vector_search.probe_codes(on_axes, 20)
    for row, own in zip(on_axes, codes):
        sums = (row[0][:, None] + row[1][None, :]).ravel()
        assert own.tolist() == np.argsort(-sums, kind="stable")[:20].tolist()
    assert (vector_search.own_codes(on_axes) == codes[:, 0]).all()


def test_more_probes_are_needed_for_farther_neighbours():
    needed = vector_search.probes_needed(16, 2, 1, 0.95, 1)
    assert (np.diff(needed) <= 0).all() and needed[-1] == 1 and needed[0] > 10
