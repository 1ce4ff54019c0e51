import random
from decimal import Decimal as D

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from dealerscope.operators.ranking import mean_rank_share, rank_descending, value_range


@pytest.mark.parametrize("seed", range(3))
def test_split_rank_equals_the_window_function(spark, seed):
    rng = random.Random(seed)
    pool = [None, D("0.00"), D("16384.00"), D("16383.99"), D("-5.10"), D("-0.01"), D("0.01"), D("99999999999.99"), D("17179869184.00")]
    rows = [
        (
            i,
            rng.choice(["a", "b", None]) if i % 3 else "hot",
            rng.choice(pool) if i % 2 else D(rng.randint(-100, 10 ** rng.randint(2, 13))) / 100,
        )
        for i in range(600)
    ]
    df = spark.createDataFrame(rows, "id INT, g STRING, v DECIMAL(38,2)")
    expected = df.withColumn("r", F.rank().over(Window.partitionBy("g").orderBy(F.desc_nulls_first("v"))))
    assert sorted(map(str, rank_descending(df, ["g"], "v", "r").collect())) == sorted(map(str, expected.collect()))


def test_whole_numbers_and_doubles_rank_alike(spark):
    values = [None, 0.0, 1e-300, -1e-300, 1e300, 1.5, 1.5, 2.0, 2.0000000000000004, -3.0, -2.9999999999999996, 5e-324]
    df = spark.createDataFrame(list(enumerate(values * 3)), "id INT, v DOUBLE").withColumn("g", F.lit(1))
    expected = df.withColumn("r", F.rank().over(Window.partitionBy("g").orderBy(F.desc_nulls_first("v"))))
    assert sorted(map(str, rank_descending(df, ["g"], "v", "r").collect())) == sorted(map(str, expected.collect()))


def test_ranges_never_fall_and_are_narrow(spark):
    rng = random.Random(5)
    values = sorted({rng.uniform(-1, 1) * 10 ** rng.randint(-8, 12) for _ in range(3000)} | {0.0})
    df = spark.createDataFrame([(v,) for v in values], "v DOUBLE")
    found = [r.r for r in df.select("v", value_range(F.col("v")).alias("r")).orderBy("v").collect()]
    assert found == sorted(found)
    one = spark.range(1_000_000, 2_000_000).groupBy(value_range(F.col("id")).alias("r")).count()
    sizes = [r["count"] for r in one.collect()]
    assert len(sizes) >= 128 and max(sizes) < 12_000


def test_no_task_sorts_a_hot_group(spark):
    """A third of the rows in one group, a third of those with one value: windows get ranges of distinct values."""
    n = 60_000
    df = spark.range(n).select(
        "id",
        F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 50).alias("g"),
        F.when(F.col("id") % 9 == 0, 700).otherwise(F.col("id") % 9973 + 500).cast("decimal(38,2)").alias("v"),
    )
    ranked = rank_descending(df, ["g"], "v", "r")
    plan = ranked._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Window [") == 2 and "_in#" in plan
    expected = df.withColumn("r", F.rank().over(Window.partitionBy("g").orderBy(F.desc_nulls_first("v"))))
    assert ranked.exceptAll(expected).count() == 0 and ranked.count() == n
    ranges = df.filter("g = 0").select(value_range(F.col("v")).alias("r"), "v").distinct().groupBy("r").count()
    assert max(r["count"] for r in ranges.collect()) < 300


def test_mean_rank_share_averages_ties(spark):
    df = spark.createDataFrame([(1, 5.0), (2, 5.0), (3, 1.0), (4, 9.0)], "id INT, x DOUBLE")
    shares = {r.id: r.s for r in mean_rank_share(df, "x", "s").collect()}
    assert shares == {3: 0.25, 1: 0.625, 2: 0.625, 4: 1.0}
