"""Folds by exploding origins, plain models through the common scores, the recursive forecast, and quantile bands."""

import datetime as dt
import random
from decimal import Decimal

import pytest
from conftest import day

from dealerscope.operators.ranking import tiles
from dealerscope.plans import backtest as bt
from dealerscope.plans import forecast as fc
from dealerscope.plans import segments as sg
from dealerscope.plans import timeseries as ts


def _weekly(make, *series):
    rows = []
    for product, ys in series:
        rows += [(product, str(day("2023-01-02") + dt.timedelta(weeks=i)), y, 6) for i, y in enumerate(ys)]
    return ts.mark_holdout(ts.with_days_to_peak(make.weekly(*rows)))


def test_folds_repeat_the_weeks_that_each_origin_knows(make):
    series = _weekly(make, (1, range(9)), (2, range(3)))
    found = {}
    for r in bt.fold_rows(series, folds=3, holdout=3).collect():
        found.setdefault((r.product_id, r.fold), {})[int(r.y)] = r.before
    assert found[1, 0] == {y: 6 - y for y in range(9)}
    assert found[1, 1] == {y: 3 - y for y in range(6)}
    assert found[1, 2] == {y: 0 - y for y in range(3)}
    assert found[2, 0] == {0: 0, 1: -1, 2: -2} and (2, 1) not in found


def test_plain_models_use_nothing_after_the_origin(make):
    ys = [4, 8, 0, 12, 100, 100, 7, 7]
    rows = bt.plain_forecasts(_weekly(make, (1, ys), (2, [1, 2, 3, 4])), folds=2, holdout=2)
    last = sorted((r.fold, r.ds, r.y, r.yhat) for r in rows[bt.LAST_WEEK].collect())
    mean = sorted((r.fold, r.ds, r.y, r.yhat) for r in rows[bt.MEAN_OF_FOUR].collect())
    assert [(f, y, yhat) for f, _, y, yhat in last] == [(0, 7, 100), (0, 7, 100), (1, 100, 12), (1, 100, 12)]
    assert [(f, y, yhat) for f, _, y, yhat in mean] == [(0, 7, 53), (0, 7, 53), (1, 100, 6), (1, 100, 6)]


def test_backtest_goes_through_the_common_scores(make):
    rng = random.Random(3)
    plain = [(p, [rng.randrange(40) for _ in range(70)]) for p in (1, 2, 3)]
    run = bt.run_backtest(_weekly(make, *plain))
    scores = {(r.product_id, r.fold): r for r in run.scores.collect()}
    assert len(scores) == 18
    for p, ys in plain:
        for fold in range(6):
            end = 70 - 8 * fold
            held, known = ys[end - 8 : end], ys[: end - 8]
            for prefix, guess in (("last", known[-1]), ("mean", sum(known[-4:]) / 4)):
                mape = sum(abs(y - guess) / max(y, 1) for y in held) / 8 * 100
                rmse = (sum((y - guess) ** 2 for y in held) / 8) ** 0.5
                row = scores[p, fold]
                assert row[f"{prefix}_mape"] == pytest.approx(mape) and row[f"{prefix}_rmse"] == pytest.approx(rmse)
            better = bt.LAST_WEEK.name if row.last_mape <= row.mean_mape else bt.MEAN_OF_FOUR.name
            assert row.model_used == better
    results = run.results.collect()
    assert len(results) == 18 * 8 and all(r.mape == min(r.last_mape, r.mean_mape) for r in results)
    wins = {r.model: r.wins for r in bt.league(run).collect()}
    assert sum(wins.values()) == 18 and set(wins) == {"last_week", "mean_of_four"}
    assert all(r.failures == 0 for r in fc.forecast_checks(run.results.filter("fold = 0")).collect())


def test_recursive_forecast_equals_a_loop_and_is_clipped(make):
    ys = {1: [20, 3, 14, 9] + [5] * 8, 2: [0, 0, 0, 1] + [2] * 8, 3: [50, 60, 70, 90] + [8] * 8}
    rows = bt.forecast_linear(_weekly(make, *ys.items())).orderBy("product_id", "ds").collect()
    assert len(rows) == 24
    for p, series in ys.items():
        lags = series[3::-1]
        wanted = []
        for _ in range(8):
            guess = max(0.0, sum(w * lag for w, lag in zip(bt.WEIGHTS, lags)) + bt.CONSTANT)
            wanted.append(guess)
            lags = [guess, *lags[:3]]
        mine = [r for r in rows if r.product_id == p]
        assert [r.yhat for r in mine] == wanted and [r.y for r in mine] == series[4:]
    assert any(r.yhat == 0 for r in rows) and any(r.yhat > 0 for r in rows)


def test_lag_shift_is_shared_by_both_forecasts():
    assert fc.lag_shift("p") == ["p", "lag_1", "lag_2", "lag_3"]


def test_tiles_are_exact_and_ties_share_one(spark):
    df = spark.createDataFrame([(i, v) for i, v in enumerate([5, 1, 9, 9, 9, 2, 7, None])], "id INT, v INT")
    found = {r.id: r.t for r in tiles(df, "v", 4, "t").collect()}
    # ranks from the largest: null 1, the nines 2, then 5, 6, 7, 8 of eight
    assert found == {7: 3, 2: 3, 3: 3, 4: 3, 6: 1, 0: 1, 5: 0, 1: 0}
    plan = tiles(df, "v", 4, "t")._jdf.queryExecution().optimizedPlan().toString()
    assert "_in#" in plan  # ranked inside value ranges


def test_bands_label_dealers_without_a_fit(make, spark):
    table = spark.createDataFrame(
        [(i, 100 - i, i, Decimal(i * 10)) for i in range(40)], "dealer_id INT, recency INT, frequency BIGINT, monetary DECIMAL(38,2)"
    )
    run = sg.label_dealers(sg.quantile_bands(table))
    rows = {r.dealer_id: r for r in run.segments.collect()}
    assert len(rows) == 40 and rows[0].cluster_id == 0 and rows[39].cluster_id == sg.BANDS - 1
    assert rows[39].segment_label == "Champions" and rows[0].segment_label == "At Risk"
    means = {r.cluster_id: r.frequency for r in run.centres.collect()}
    assert [means[k] for k in sorted(means)] == sorted(means.values())
