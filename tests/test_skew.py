import random

import pytest
from pyspark.sql import functions as F

from rankmill.operators.skew import lookup, rank_in_groups, running_total
from rankmill.operators.storage import load, materialize, shared_dir


def test_shared_dir_is_stable(spark):
    assert shared_dir(spark) == shared_dir(spark)


def test_materialize_keeps_rows_and_schema(spark):
    df = spark.createDataFrame([(1, "a"), (2, None)], "i int, s string")
    back = materialize(df, "t")
    assert back.schema == df.schema and sorted(back.collect()) == sorted(df.collect())


def test_lookup_splits_hot_keys(spark):
    rows = [("hot", i) for i in range(300)] + [(f"k{i}", i) for i in range(50)] + [("none", 1), (None, 2)]
    left = spark.createDataFrame(rows, "k string, v int")
    dim = spark.createDataFrame([("hot", 1, 300), *[(f"k{i}", i, 1) for i in range(50)], ("unused", 5, 0)], "k string, x int, n int")
    for how in ("inner", "left"):
        got = lookup(left, dim, ["k"], F.col("n") > 100, how)
        want = left.join(dim, "k", how).select(got.columns)
        assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_lookup_reads_its_left_side_once(spark, sf_dir):
    left = load(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey")
    dim = load(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey")
    plan = lookup(left, dim, ["l_orderkey"], F.col("o_custkey") < 3)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("l_partkey") and plan.count("Relation [l_orderkey") == 1


def test_lookup_spreads_repeated_rows(spark):
    left = spark.createDataFrame([("hot", 1)] * 300 + [(None, 2)] * 5, "k string, v int").repartition(4)
    dim = spark.createDataFrame([("hot", 7)], "k string, x int")
    assert lookup(left, dim, ["k"], F.lit(True)).count() == 300 == lookup(left, dim, ["k"], F.lit(None).cast("boolean")).count()
    assert lookup(left, dim, ["k"], F.lit(True), "left").where("x IS NULL").count() == 5


def test_a_cluster_must_name_its_shared_folder():
    class Cluster:
        class conf:
            get = staticmethod(lambda name, default: default)

        class sparkContext:
            master = "spark://host:7077"

            class _jsc:
                sc = staticmethod(lambda: type("S", (), {"getCheckpointDir": staticmethod(lambda: type("N", (), {"isDefined": staticmethod(lambda: False)}))}))

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_dir(Cluster)


def test_rank_in_groups_matches_window(spark):
    rng = random.Random(5)
    rows = [("a", i, float(rng.randrange(40))) for i in range(900)] + [(None, i, float(i % 3)) for i in range(20)] + [(f"g{i % 60}", i, rng.random()) for i in range(300)]
    df = spark.createDataFrame(rows, "g string, i int, s double").repartition(5)
    got = {(r.g, r.i): r["rank"] for r in rank_in_groups(df, ["g"], "s").collect()}
    for g, i, s in rows:
        assert got[g, i] == 1 + sum(1 for a, _, c in rows if a == g and c > s)


def test_rank_in_groups_of_nothing(spark):
    assert rank_in_groups(spark.createDataFrame([], "g string, s double"), ["g"], "s").count() == 0


def test_running_total(spark):
    rng = random.Random(22)
    rows = [(float(x), rng.randrange(5)) for x in rng.sample(range(1000), 400)]
    got = {r.x: r.before for r in running_total(spark.createDataFrame(rows, "x double, n long").repartition(5), "x", "n").collect()}
    assert got == {x: sum(n for y, n in rows if y < x) for x, _ in rows}
    assert running_total(spark.createDataFrame([], "x double, n long"), "x", "n").count() == 0
