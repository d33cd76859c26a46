import random

from pyspark.sql import functions as F

from memograph.plans.ranking import page, with_rank


def test_rank_is_the_place_in_the_whole_order(spark):
    rng = random.Random(2)
    rows = [(i, rng.choice([None, 1, 2, 3, 50]), f"t{i}") for i in range(500)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "id int, size int, _part string").repartition(5)
    got = with_rank(df, [F.col("size").desc_nulls_last(), F.col("id")], "place")
    assert got.columns == ["id", "size", "_part", "place"]
    want = sorted(rows, key=lambda r: (r[1] is None, -(r[1] or 0), r[0]))
    assert [(r["id"], r["size"], r["_part"]) for r in sorted(got.collect(), key=lambda r: r["place"])] == want
    assert sorted(r["place"] for r in got.collect()) == list(range(1, 501))
    assert [r["id"] for r in page(df, [F.col("id")], limit=7, offset=20).orderBy("rank").collect()] == list(range(20, 27))


def test_no_rows_have_no_rank(spark):
    assert with_rank(spark.createDataFrame([], "id int"), [F.col("id")]).count() == 0


def test_no_single_task_window(spark):
    plan = with_rank(spark.range(100), [F.col("id")])._jdf.queryExecution().toString()
    assert "SinglePartition" not in plan and "Window" not in plan
