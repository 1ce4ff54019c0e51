"""Dealer segmentation by recency, frequency and monetary value."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from dataclasses import dataclass
from functools import reduce

from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dealerscope.functions.money import total
from dealerscope.operators.kmeans import Clustering, fit_many, nearest_centre, whole_points
from dealerscope.operators.quality import count_between, duplicate_keys, row_checks, union_checks
from dealerscope.operators.ranking import mean_rank_share, tiles
from dealerscope.sources.durable import materialise

MEASURES = ("recency", "frequency", "monetary")
Z_COLUMNS = tuple(f"z_{m}" for m in MEASURES)
CLUSTER_COUNTS = (3, 4, 5)
SEED = 42
RESTARTS = 20


def rfm(dealers: DataFrame, orders: DataFrame) -> DataFrame:
    """Recency, frequency and monetary value of every dealer with orders.

    Recency is measured from the last order date of the data, the other two over the
    twelve months before it (a month-end is clamped).
    """
    latest = orders.agg(F.max("order_date")).scalar()
    recent = F.col("order_date") >= F.add_months(latest, -12)
    per_dealer = orders.groupBy("dealer_id").agg(
        F.max("order_date").alias("last_order"),
        F.count_if(recent).cast("bigint").alias("frequency"),
        F.coalesce(total(F.when(recent, F.col("total_amount"))), F.lit(0).cast("decimal(38,2)")).alias("monetary"),
    )
    return per_dealer.join(dealers.select("dealer_id"), "dealer_id", "left_semi").select(
        "dealer_id", F.datediff(latest, F.col("last_order")).alias("recency"), "frequency", "monetary"
    )


def standardise(table: DataFrame) -> DataFrame:
    """Add ``z_*``: each measure less its mean, over its population deviation.

    A measure that is the same for all dealers becomes zero. The table is read twice, for
    the moments and for the rows.
    """
    pairs = [(F.avg(F.col(m).cast("double")), F.stddev_pop(F.col(m).cast("double"))) for m in MEASURES]
    moments = table.agg(F.struct(*(c.alias(f"{k}_{m}") for m, p in zip(MEASURES, pairs) for k, c in zip("ms", p))))
    stats = moments.scalar()

    def z(measure):
        mean, deviation = stats[f"m_{measure}"], stats[f"s_{measure}"]
        score = (F.col(measure).cast("double") - mean) / F.nullif(deviation, F.lit(0.0))
        return F.round(F.coalesce(score, F.lit(0.0)), 6)

    return table.withColumns({f"z_{m}": z(m) for m in MEASURES})


def fit_restarts(
    points: DataFrame, ks: Iterable[int] = CLUSTER_COUNTS, restarts: int = RESTARTS, seed: int = SEED
) -> dict[int, Clustering]:
    """The clustering of least inertia for each k, out of ``restarts`` differently seeded ones; the first on a tie.

    All of them are fitted in the same passes over the points.
    """
    best: dict[int, Clustering] = {}
    for found in fit_many(points, [(k, seed + i) for k in ks for i in range(restarts)]):
        if found.k not in best or found.inertia < best[found.k].inertia:
            best[found.k] = found
    return best


def diagnose(table: DataFrame, clusterings: Mapping[int, Clustering]) -> list[tuple[int, float, float]]:
    """``(k, inertia, silhouette)`` per clustering, with squared Euclidean silhouette.

    That form needs only the sums of each cluster, not the distances of all pairs. With a
    single cluster there is none, and it counts as 0.
    """
    features = VectorAssembler(inputCols=list(Z_COLUMNS), outputCol="features").transform(table)
    evaluator = ClusteringEvaluator(predictionCol="cluster_id", featuresCol="features", metricName="silhouette")
    out = []
    for k, found in sorted(clusterings.items()):
        assigned = features.withColumn("cluster_id", nearest_centre(Z_COLUMNS, found))
        out.append((k, found.inertia, float(evaluator.evaluate(assigned)) if len(set(found.centres)) > 1 else 0.0))
    return out


def best_k(diagnostics: Iterable[tuple[int, float, float]]) -> int:
    """The k of greatest silhouette; the smaller k on a tie."""
    return min(diagnostics, key=lambda d: (-d[2], d[0]))[0]


def centroids(assigned: DataFrame) -> DataFrame:
    """Mean of each measure per cluster, in original units."""
    means = (F.avg(F.col(m).cast("double")).alias(m) for m in MEASURES)
    return assigned.groupBy("cluster_id").agg(*means)


# A label applies if the rank shares of the centre are below or above these
# bounds; the first label that applies is taken, else the last name.
LABEL_RULES = (
    ("Champions", {"recency": ("below", 0.40), "frequency": ("above", 0.60), "monetary": ("above", 0.60)}),
    ("At Risk", {"recency": ("above", 0.65), "frequency": ("below", 0.50)}),
    ("Loyal", {"frequency": ("above", 0.60)}),
    ("Potential", {"recency": ("below", 0.50)}),
)
OTHER_LABEL = "Needs Attention"


def _applies(bounds: Mapping[str, tuple[str, float]]) -> Column:
    tests = (
        F.col(f"share_{m}") < bound if side == "below" else F.col(f"share_{m}") > bound
        for m, (side, bound) in bounds.items()
    )
    return reduce(lambda a, b: a & b, tests)


def label_clusters(centres: DataFrame) -> DataFrame:
    """Name each cluster by the rank shares of its centre, see ``LABEL_RULES``.

    The rules compare clusters with each other, so they stay valid when the data changes,
    and two clusters may get the same name.
    """
    ranked = reduce(lambda df, m: mean_rank_share(df, m, f"share_{m}"), MEASURES, centres)
    names = (F.when(_applies(bounds), name) for name, bounds in LABEL_RULES)
    label = F.coalesce(*names, F.lit(OTHER_LABEL))
    return ranked.select("cluster_id", *MEASURES, label.alias("segment_label"))


TILES = 4
BANDS = 5


def quantile_bands(table: DataFrame, tile_count: int = TILES, bands: int = BANDS) -> DataFrame:
    """Clusters by rule instead of by fit: ``table`` with ``cluster_id`` from 0 (worst) to ``bands`` - 1.

    Each measure gives its exact quantile, the shorter recency the higher, and the sum of the
    three is cut into bands of equal width. Dealers with equal measures share a band.
    """
    scored = table.withColumn("_fresh", -F.col("recency"))
    for measure in ("_fresh", *MEASURES[1:]):
        scored = tiles(scored, measure, tile_count, f"_tile_{measure}")
    total_tiles = sum((F.col(f"_tile_{m}") for m in MEASURES[1:]), F.col("_tile__fresh"))
    widest = 3 * (tile_count - 1) + 1
    return scored.select("dealer_id", *MEASURES, F.floor(total_tiles * bands / widest).cast("int").alias("cluster_id"))


def label_dealers(assigned: DataFrame) -> Segmentation:
    """The segmentation that given clusters make: their centres, labels and labelled dealers."""
    assigned = materialise(assigned)
    centres = materialise(label_clusters(centroids(assigned)))
    labels = centres.select("cluster_id", "segment_label")
    labelled = assigned.join(labels, "cluster_id").select("dealer_id", *MEASURES, "cluster_id", "segment_label")
    none = assigned.sparkSession.createDataFrame([], "k INT, inertia DOUBLE, silhouette DOUBLE")
    return Segmentation(labelled, none, centres)


@dataclass(frozen=True)
class Segmentation:
    segments: DataFrame  # one row per dealer
    diagnostics: DataFrame  # one row per k
    centres: DataFrame  # one row per cluster of the chosen k, with its label


def segment_dealers(
    dealers: DataFrame,
    orders: DataFrame,
    ks: Iterable[int] = CLUSTER_COUNTS,
    restarts: int = RESTARTS,
    seed: int = SEED,
) -> Segmentation:
    """Cluster the dealers for each k, keep the k that separates best, label its clusters."""
    table = materialise(standardise(materialise(rfm(dealers, orders))))
    models = fit_restarts(whole_points(table, "dealer_id", Z_COLUMNS), ks, restarts, seed)
    diagnostics = diagnose(table, models)
    chosen = models[best_k(diagnostics)]
    assigned = table.select("dealer_id", *MEASURES, nearest_centre(Z_COLUMNS, chosen).alias("cluster_id"))
    assigned = materialise(assigned)
    centres = materialise(label_clusters(centroids(assigned)))
    labels = centres.select("cluster_id", "segment_label")
    by_k = dealers.sparkSession.createDataFrame(diagnostics, "k INT, inertia DOUBLE, silhouette DOUBLE")
    labelled = assigned.join(labels, "cluster_id").select("dealer_id", *MEASURES, "cluster_id", "segment_label")
    return Segmentation(labelled, by_k, centres)


def segment_profile(segments: DataFrame) -> DataFrame:
    """Dealers and mean measures per label."""
    means = (F.avg(F.col(m).cast("double")).alias(f"mean_{m}") for m in MEASURES)
    return segments.groupBy("segment_label").agg(F.count(F.lit(1)).alias("dealers"), *means)


def segment_checks(segments: DataFrame, dealers_with_orders: DataFrame) -> DataFrame:
    """``(check_name, failures)`` for a segment table: one row per dealer, 3 to 5 clusters, labelled."""
    unlabelled = F.coalesce(F.length("segment_label"), F.lit(0)) == 0
    clusters = segments.select("cluster_id").distinct()
    missing = dealers_with_orders.select("dealer_id").distinct().join(segments, "dealer_id", "left_anti")
    return union_checks(
        [
            row_checks(segments, {"segments: no label": unlabelled}),
            duplicate_keys(segments, ["dealer_id"], "segments: duplicate dealer"),
            row_checks(missing, {"segments: dealer left out": F.lit(True)}),
            count_between(clusters, min(CLUSTER_COUNTS), max(CLUSTER_COUNTS), "segments: number of clusters"),
        ]
    )
