"""Many K-means models in shared passes, against a plain loop and against Spark's own."""

import numpy as np
import pytest
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import VectorAssembler

from dealerscope.operators import kmeans

COLUMNS = ["a", "b", "c"]
JOBS = [(k, 42 + i) for k in (3, 4, 5) for i in range(6)]


@pytest.fixture(scope="module")
def cloud():
    rng = np.random.default_rng(7)
    centres = np.array([[0, 0, 0], [4, 0, 1], [0, 5, -2], [-4, -4, 3]])
    x = np.concatenate([c + rng.standard_normal((150, 3)) for c in centres])
    return np.round(x, 6)


def _frame(spark, x):
    return spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(x)], "id INT, a DOUBLE, b DOUBLE, c DOUBLE")


def _plain_inertia(x, centres):
    return ((x[:, None] - np.array(centres)[None]) ** 2).sum(axis=2).min(axis=1).sum()


def test_centres_are_stationary_and_inertia_exact(spark, cloud):
    found = kmeans.fit_many(kmeans.whole_points(_frame(spark, cloud), "id", COLUMNS), JOBS, tolerance=0)
    assert [(f.k, f.seed) for f in found] == JOBS
    for f in found:
        assert len(f.centres) == f.k
        assert f.inertia == pytest.approx(_plain_inertia(cloud, f.centres), rel=1e-12)
        near = ((cloud[:, None] - np.array(f.centres)[None]) ** 2).sum(axis=2).argmin(axis=1)
        assert np.allclose([cloud[near == j].mean(axis=0) for j in range(f.k)], f.centres, atol=1e-9)


def test_two_layouts_agree_to_the_last_bit(spark, cloud):
    frame = _frame(spark, cloud)
    one = kmeans.fit_many(kmeans.whole_points(frame.coalesce(1), "id", COLUMNS), JOBS)
    many = kmeans.fit_many(kmeans.whole_points(frame.repartition(7, "a").sortWithinPartitions("b"), "id", COLUMNS), JOBS)
    assert one == many


def test_best_of_restarts_is_as_good_as_spark_ml(spark, cloud):
    frame = _frame(spark, cloud)
    features = VectorAssembler(inputCols=COLUMNS, outputCol="features").transform(frame).cache()
    found = kmeans.fit_many(kmeans.whole_points(frame, "id", COLUMNS), [(k, 42 + i) for k in (3, 4, 5) for i in range(20)])
    for k in (3, 4, 5):
        ours = min(f.inertia for f in found if f.k == k)
        theirs = min(KMeans(k=k, seed=42 + i, maxIter=100).fit(features).summary.trainingCost for i in range(4))
        assert ours <= theirs * 1.001
    features.unpersist()


def test_jobs_do_not_grow_with_the_models(spark, cloud):
    points = kmeans.whole_points(_frame(spark, cloud), "id", COLUMNS)
    tracker, group = spark.sparkContext.statusTracker(), "fit many models"
    spark.sparkContext.setJobGroup(group, group)
    try:
        kmeans.fit_many(points, [(k, i) for k in (3, 4, 5) for i in range(20)])
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    # a pass is at most two jobs under adaptive execution
    assert len(tracker.getJobIdsForGroup(group)) <= 2 * (5 + kmeans.PASSES + 2)


def test_first_centres_follow_the_squared_distance(spark):
    """Of two clumps the second centre falls into the far one nearly always, each point of it about as often."""
    x = np.concatenate((np.zeros((50, 3)), np.full((4, 3), 100.0)))
    x[:50, 0] = np.arange(50) / 1000
    points = kmeans.whole_points(_frame(spark, x), "id", COLUMNS)
    firsts = kmeans._seeded(points, [(2, s) for s in range(120)])
    far = [c.max(axis=0)[0] >= 100 * kmeans.UNITS for c in firsts]
    assert sum(far) >= 118
    assert len({c[0, 0] for c in firsts}) > 30


def test_few_points_and_none(spark):
    rows = [[1.0, 2.0, 3.0]] * 5 + [[9.0, 9.0, 9.0]]
    two = kmeans.fit_many(kmeans.whole_points(_frame(spark, rows), "id", COLUMNS), [(3, 1), (1, 1)])
    assert sorted(two[0].centres) == [(1.0, 2.0, 3.0), (9.0, 9.0, 9.0)] and two[0].inertia == 0
    assert two[1].inertia == pytest.approx(_plain_inertia(np.array(rows), two[1].centres))
    empty = kmeans.whole_points(_frame(spark, rows).limit(0), "id", COLUMNS)
    assert kmeans.fit_many(empty, [(3, 1)]) == [kmeans.Clustering(3, 1, (), 0.0)]


def test_sums_are_exact_for_large_coordinates(spark):
    rows = [[3e11 + i / 1e6, -3e11, 0.000001] for i in range(40)]
    points = kmeans.whole_points(_frame(spark, rows), "id", COLUMNS)
    (n, sums), = kmeans._pass(points, [(0, np.zeros((1, 3)))])[0]
    assert n == 40 and sums == [sum(round(r[d] * 1e6) for r in rows) for d in range(3)]


def test_points_are_dealt_by_their_number(spark, cloud, monkeypatch):
    """A few bytes are many points to compare: one file would leave a pass to one task."""
    monkeypatch.setattr(kmeans, "POINTS_PER_TASK", 100, raising=False)
    points = kmeans.whole_points(_frame(spark, cloud).coalesce(1), "id", COLUMNS)
    assert points.count() == len(cloud)
    assert len(points.inputFiles()) == len(cloud) // 100


def test_nearest_of_many_models_is_the_plain_one(cloud):
    """Also for points between two centres, which go to the lower id."""
    x = np.concatenate((np.round(cloud * kmeans.UNITS), np.zeros((5, 3))))
    rng = np.random.default_rng(3)
    centres = np.concatenate((np.round(rng.standard_normal((6, 4, 3)) * kmeans.UNITS), [[[0, 0, 1], [0, 0, -1], [1, 0, 0], [9, 9, 9]]]))
    plain = ((x[None, :, None] - centres[:, None]) ** 2).sum(axis=3).argmin(axis=2)
    assert (kmeans._nearest(x, centres) == plain).all()
