"""Eight-week holdout forecasts: a pooled boosted-tree model against one regression per product."""

from __future__ import annotations

import sys
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressionModel, GBTRegressor
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from dealerscope.operators.quality import duplicate_keys, row_checks, union_checks
from dealerscope.plans.timeseries import HOLDOUT_WEEKS, LAGS, demand_features, demand_series
from dealerscope.sources.durable import materialise

# The per-product fit travels to the workers as code, so they need numpy and pandas only.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

LAG_COLUMNS = tuple(f"lag_{i}" for i in range(1, LAGS + 1))
FEATURES = (*LAG_COLUMNS, "rolling_4", "month", "days_to_peak_demand")
BOOSTED, SEASONAL = "boosted_trees", "seasonal_regression"


@dataclass(frozen=True)
class Model:
    """A model as results name it, and the prefix of its score columns."""

    name: str
    prefix: str


MODELS = (Model(BOOSTED, "boosted"), Model(SEASONAL, "seasonal"))


def lag_shift(prediction: str) -> list[str]:
    """The lags of the next step as SQL, latest first: the prediction, then each lag but the oldest."""
    return [prediction, *LAG_COLUMNS[:-1]]


# Size of the boosted model.
BOOSTED_PARAMS = {"maxIter": 180, "maxDepth": 3, "stepSize": 0.05, "lossType": "squared", "seed": 42}

ROWS_PER_TASK = 50_000  # of the training rows


def long_enough(series: DataFrame, holdout: int = HOLDOUT_WEEKS) -> DataFrame:
    """Products with at least one week before the holdout; shorter series cannot be trained."""
    weeks = F.count(F.lit(1)).over(Window.partitionBy("product_id"))
    return series.withColumn("weeks", weeks).filter(F.col("weeks") > holdout).drop("weeks")


# -- boosted trees ---------------------------------------------------------------------


def _assembler() -> VectorAssembler:
    return VectorAssembler(inputCols=list(FEATURES), outputCol="features")


def fit_boosted(features: DataFrame, params: Mapping[str, object] | None = None) -> GBTRegressionModel | None:
    """One model over all products, trained on the weeks before each product's holdout.

    None if no product has a week with all its lags before the holdout.
    """
    known = features.filter(~F.col("is_holdout")).dropna(subset=[*FEATURES, "y"])
    known = materialise(known.select(*FEATURES, F.col("y").alias("label")))
    rows = known.count()
    if not rows:
        return None
    # hundreds of short jobs read it: no more partitions than its rows are worth
    known = known.coalesce(-(-rows // ROWS_PER_TASK))
    train = _assembler().transform(known).select("features", "label")
    return GBTRegressor(**{**BOOSTED_PARAMS, **(params or {})}).fit(train)


def forecast_boosted(
    model: GBTRegressionModel | None, features: DataFrame, holdout: int = HOLDOUT_WEEKS
) -> DataFrame:
    """Predict the holdout week by week, each clipped prediction feeding the next lags.

    Without a model the mean of the four latest quantities is the prediction.

    The state is one row per product: the four latest quantities, and the holdout weeks
    as an array. A step adds one column to it, so no step shuffles or joins anything.
    """
    week = F.struct("ds", "y", "month", F.col("days_to_peak_demand").alias("until_peak"))
    ahead = features.filter("is_holdout").groupBy("product_id").agg(
        F.array_sort(F.collect_list(week)).alias("weeks"),
        *(F.min_by(c, "ds").alias(c) for c in LAG_COLUMNS),
    )
    state = materialise(ahead.withColumns({c: F.coalesce(c, F.lit(0.0)) for c in LAG_COLUMNS}))
    assembler = _assembler()
    for step in range(holdout):
        current = F.col("weeks")[step]
        inputs = state.withColumns(
            {
                "rolling_4": sum((F.col(c) for c in LAG_COLUMNS[1:]), F.col(LAG_COLUMNS[0])) / LAGS,
                "month": current["month"],
                "days_to_peak_demand": current["until_peak"],
            }
        )
        if model is None:
            predicted = inputs.withColumn("prediction", F.col("rolling_4"))
        else:
            predicted = model.transform(assembler.transform(inputs))
        clipped = F.greatest(F.lit(0.0), F.col("prediction"))
        done = [f"yhat_{i}" for i in range(step)]
        guessed = predicted.withColumn(f"yhat_{step}", clipped)
        shifted = (F.expr(source).alias(name) for name, source in zip(LAG_COLUMNS, lag_shift(f"yhat_{step}")))
        state = guessed.select("product_id", "weeks", *done, f"yhat_{step}", *shifted)
    rows = F.arrays_zip("weeks", F.array(*(f"yhat_{i}" for i in range(holdout))).alias("yhat"))
    return state.select("product_id", F.explode(rows).alias("r")).select(
        "product_id", F.col("r.weeks.ds").alias("ds"), F.col("r.weeks.y").alias("y"), F.col("r.yhat").alias("yhat")
    )


# -- regression per product ------------------------------------------------------------

YEAR_DAYS = 365.25
YEAR_ORDER = 10  # sine and cosine pairs of the yearly cycle
CHANGE_POINTS = 25  # possible bends of the trend, over the first four fifths of the history
SEASON_SCALE, BEND_SCALE = 10.0, 0.05


def _design(days: np.ndarray, until_peak: np.ndarray, first: float, span: float, bends: np.ndarray) -> np.ndarray:
    t = (days - first) / span
    cycle = 2 * np.pi * np.outer(days / YEAR_DAYS, np.arange(1, YEAR_ORDER + 1))
    hinges = np.maximum(0.0, t[:, None] - bends[None, :])
    return np.column_stack([np.ones_like(t), t, until_peak, np.sin(cycle), np.cos(cycle), hinges])


def _penalised_fit(x: np.ndarray, y: np.ndarray, scales: np.ndarray) -> np.ndarray:
    """Least squares in which each coefficient is pulled to zero according to its scale."""
    noise = 1.0
    for _ in range(3):
        beta = np.linalg.solve(x.T @ x + np.diag((noise / scales) ** 2), x.T @ y)
        noise = max(float(np.std(y - x @ beta)), 1e-3)
    return beta


def _forecast_one(group: pd.DataFrame) -> pd.DataFrame:
    """Trend with bends, yearly cycle and days to peak for one product's weeks."""
    group = group.sort_values("ds")
    held = group["is_holdout"].to_numpy(dtype=bool)
    days = pd.to_datetime(group["ds"]).to_numpy().astype("datetime64[D]").astype(float)
    until = group["days_to_peak_demand"].to_numpy(dtype=float)
    y = group["y"].to_numpy(dtype=float)
    known = ~held
    first, span = days[known].min(), max(np.ptp(days[known]), 1.0)
    until = (until - until[known].mean()) / (until[known].std() or 1.0)
    size = max(np.abs(y[known]).max(), 1.0)
    bends = np.linspace(0, 0.8, min(CHANGE_POINTS, known.sum()) + 1)[1:]
    x = _design(days, until, first, span, bends)
    level, season, bend = [5.0, 5.0, SEASON_SCALE], [SEASON_SCALE] * 2 * YEAR_ORDER, [BEND_SCALE] * len(bends)
    scales = np.array(level + season + bend)
    beta = _penalised_fit(x[known], y[known] / size, scales)
    yhat = np.clip(x[held] @ beta * size, 0, None)
    return group.loc[held, ["product_id", "ds", "y"]].assign(yhat=yhat)


def forecast_seasonal(series: DataFrame) -> DataFrame:
    """Predict each product's holdout from its own earlier weeks.

    A group holds at most one row per calendar week, so its size does not grow with the
    number of orders.
    """
    columns = series.select("product_id", "ds", "y", "days_to_peak_demand", "is_holdout")
    schema = columns.select("product_id", "ds", "y", F.lit(0.0).alias("yhat")).schema
    return columns.groupBy("product_id").applyInPandas(_forecast_one, schema)


# -- comparison ------------------------------------------------------------------------


SCORE_DIGITS = 9  # scores are rounded, so that sums taken in another order decide alike


def score(forecast: DataFrame, keys: Sequence[str] = ("product_id",)) -> DataFrame:
    """MAPE (actuals below one count as one) and RMSE per product."""
    error = F.col("y") - F.col("yhat")
    return forecast.groupBy(*keys).agg(
        F.round(F.avg(F.abs(error) / F.greatest("y", F.lit(1.0))) * 100, SCORE_DIGITS).alias("mape"),
        F.round(F.sqrt(F.avg(error * error)), SCORE_DIGITS).alias("rmse"),
    )


def compare(
    first: DataFrame, second: DataFrame, models: tuple[Model, Model] = MODELS, keys: Sequence[str] = ("product_id",)
) -> DataFrame:
    """Both models' scores per product and the model of lower MAPE (the second on a tie)."""
    scored = [
        score(forecast, keys).withColumnsRenamed({"mape": f"{m.prefix}_mape", "rmse": f"{m.prefix}_rmse"})
        for forecast, m in zip((first, second), models)
    ]
    a, b = models
    winner = F.when(F.col(f"{b.prefix}_mape") <= F.col(f"{a.prefix}_mape"), b.name).otherwise(a.name)
    return scored[0].join(scored[1], list(keys)).withColumn("model_used", winner)


def select_winner(
    first: DataFrame,
    second: DataFrame,
    scores: DataFrame,
    models: tuple[Model, Model] = MODELS,
    keys: Sequence[str] = ("product_id",),
) -> DataFrame:
    """The winning model's predictions and scores, one row per product and week."""
    a, b = models
    second_won = F.col("model_used") == b.name
    candidates = first.withColumn("model", F.lit(a.name)).unionByName(second.withColumn("model", F.lit(b.name)))
    won = candidates.join(scores, list(keys)).filter(F.col("model") == F.col("model_used"))
    return won.select(
        *keys,
        "model_used",
        *(F.when(second_won, F.col(f"{b.prefix}_{c}")).otherwise(F.col(f"{a.prefix}_{c}")).alias(c) for c in ("mape", "rmse")),
        f"{b.prefix}_mape",
        f"{a.prefix}_mape",
        F.col("ds").alias("forecast_week"),
        F.col("yhat").alias("predicted_qty"),
        F.col("y").alias("actual_qty"),
    )


def model_summary(scores: DataFrame, models: tuple[Model, Model] = MODELS) -> DataFrame:
    """Products won and mean MAPE per model."""
    rows = F.array(
        *(
            F.struct(F.lit(m.name).alias("model"), (F.col("model_used") == m.name).alias("won"), F.col(f"{m.prefix}_mape").alias("mape"))
            for m in models
        )
    )
    return (
        scores.select(F.inline(rows))
        .groupBy("model")
        .agg(F.count_if("won").alias("wins"), F.avg("mape").alias("mean_mape"))
    )


@dataclass(frozen=True)
class ForecastRun:
    results: DataFrame  # one row per product and holdout week
    scores: DataFrame  # one row per product


def run_forecast(
    lines: DataFrame,
    products: DataFrame,
    calendar: DataFrame,
    skus: DataFrame | None = None,
    params: Mapping[str, object] | None = None,
) -> ForecastRun:
    """Build the series of the lines' (or the chosen) products, fit both models, keep the better.

    The facts are read once, for the weekly series; everything after it works on at most
    one row per product and week.
    """
    series = materialise(long_enough(demand_series(lines, products, calendar, skus)))
    features = demand_features(series)
    boosted = materialise(forecast_boosted(fit_boosted(features, params), features))
    seasonal = materialise(forecast_seasonal(series))
    scores = materialise(compare(boosted, seasonal))
    return ForecastRun(select_winner(boosted, seasonal, scores), scores)


def forecast_checks(results: DataFrame) -> DataFrame:
    """``(check_name, failures)``: predictions are not negative, scores are finite, keys unique."""
    predicted, mape = F.col("predicted_qty").cast("double"), F.col("mape").cast("double")
    infinite = mape.isNull() | F.isnan(mape) | (F.abs(mape) == float("inf"))
    return union_checks(
        [
            row_checks(
                results,
                {
                    "forecast: negative quantity": predicted.isNull() | (predicted < 0),
                    "forecast: MAPE not finite": infinite,
                },
            ),
            duplicate_keys(results, ["product_id", "forecast_week"], "forecast: duplicate week"),
        ]
    )
