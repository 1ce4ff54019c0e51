"""Plain forecasts judged over several origins, and a recursive linear forecast in SQL.

Their numbers follow from sums and fixed weights alone, so they are the yardstick of the fitted
models, go through the same scores and comparison, and can be checked in any other engine.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from dealerscope.plans.forecast import LAG_COLUMNS, Model, compare, lag_shift, model_summary, select_winner
from dealerscope.plans.timeseries import HOLDOUT_WEEKS, LAGS, demand_features
from dealerscope.sources.durable import materialise

LAST_WEEK = Model("last_week", "last")
MEAN_OF_FOUR = Model("mean_of_four", "mean")
FOLDS = 6  # origins, HOLDOUT_WEEKS apart, the latest first
KEYS = ("product_id", "fold")


def fold_rows(series: DataFrame, folds: int = FOLDS, holdout: int = HOLDOUT_WEEKS) -> DataFrame:
    """(product_id, fold, ds, y, before): each week once for every fold that knows it or holds it out.

    Fold f leaves out the last ``f * holdout`` weeks of a product and holds out the ``holdout``
    before them. ``before`` counts the weeks back from the fold's origin: 1 is the last known
    one, held-out weeks have 0 and less. The folds are made by exploding, so the series is read
    and sorted once; a product has at most one row per calendar week.
    """
    place = F.row_number().over(Window.partitionBy("product_id").orderBy(F.desc("ds")))
    placed = series.select("product_id", "ds", "y", place.alias("place"))
    every = placed.withColumn("fold", F.explode(F.array(*(F.lit(f) for f in range(folds)))))
    before = F.col("place") - (F.col("fold") + 1) * holdout
    return every.withColumn("before", before).filter(F.col("before") > -holdout).drop("place")


def plain_forecasts(series: DataFrame, folds: int = FOLDS, holdout: int = HOLDOUT_WEEKS) -> dict[Model, DataFrame]:
    """The held-out weeks of every fold with at least LAGS known weeks, as each plain model predicts them."""
    rows = fold_rows(series, folds, holdout)
    known = rows.filter(F.col("before").between(1, LAGS)).groupBy(*KEYS).agg(
        F.max(F.when(F.col("before") == 1, F.col("y"))).alias(LAST_WEEK.prefix),
        F.avg("y").alias(MEAN_OF_FOUR.prefix),
        F.count(F.lit(1)).alias("weeks"),
    )
    held = rows.filter("before <= 0").join(known.filter(F.col("weeks") == LAGS), list(KEYS))
    return {m: held.select(*KEYS, "ds", "y", F.greatest(F.lit(0.0), F.col(m.prefix)).alias("yhat")) for m in (LAST_WEEK, MEAN_OF_FOUR)}


@dataclass(frozen=True)
class Backtest:
    forecasts: DataFrame  # both models' predictions, one row per product, fold, week and model
    scores: DataFrame  # one row per product and fold
    results: DataFrame  # the better model's predictions, one row per product, fold and week


def run_backtest(series: DataFrame, folds: int = FOLDS, holdout: int = HOLDOUT_WEEKS) -> Backtest:
    """Score the plain models on every fold and keep the better one of each; the last week wins a tie."""
    predicted = {m: materialise(rows) for m, rows in plain_forecasts(series, folds, holdout).items()}
    models = (MEAN_OF_FOUR, LAST_WEEK)
    mean, last = (predicted[m] for m in models)
    scores = materialise(compare(mean, last, models, KEYS))
    forecasts = mean.withColumn("model", F.lit(MEAN_OF_FOUR.name)).unionByName(last.withColumn("model", F.lit(LAST_WEEK.name)))
    return Backtest(forecasts, scores, select_winner(mean, last, scores, models, KEYS))


def league(run: Backtest) -> DataFrame:
    return model_summary(run.scores, (MEAN_OF_FOUR, LAST_WEEK))


# Weights of the four latest weeks and the constant. They are sums of few powers of
# two, so the products and sums of whole quantities are exact.
WEIGHTS = (0.75, 0.5, -0.25, -0.125)
CONSTANT = -3.0


def forecast_linear(series: DataFrame, weights: Sequence[float] = WEIGHTS, constant: float = CONSTANT, holdout: int = HOLDOUT_WEEKS) -> DataFrame:
    """(product_id, ds, y, yhat): the holdout predicted week by week from the four latest weeks.

    A recursive common table expression carries one row per product: the step and the four
    latest quantities. Each prediction, clipped at zero, becomes the latest quantity of the next
    step, as in the fitted model (:func:`lag_shift`). Products without four weeks before the
    holdout have lags of zero there.
    """
    spark = series.sparkSession
    features = demand_features(series).filter("is_holdout")
    state = features.groupBy("product_id").agg(*(F.coalesce(F.min_by(c, "ds"), F.lit(0.0)).alias(c) for c in LAG_COLUMNS))
    terms = " + ".join(f"cast({w!r} as double) * {c}" for w, c in zip(weights, LAG_COLUMNS))
    guess = f"greatest(0D, {terms} + cast({constant!r} as double))"
    shifted = ", ".join(lag_shift(guess))
    steps = spark.sql(
        f"""WITH RECURSIVE steps(product_id, step, {', '.join(LAG_COLUMNS)}) AS (
              SELECT product_id, 0, {', '.join(LAG_COLUMNS)} FROM {{state}}
              UNION ALL
              SELECT product_id, step + 1, {shifted} FROM steps WHERE step < {int(holdout)})
            SELECT product_id, step, {LAG_COLUMNS[0]} AS yhat FROM steps WHERE step > 0""",
        state=state,
    )
    step = F.row_number().over(Window.partitionBy("product_id").orderBy("ds"))
    weeks = features.select("product_id", "ds", "y", step.alias("step"))
    return weeks.join(steps, ["product_id", "step"]).select("product_id", "ds", "y", "yhat")
