"""Whitening and hard negatives against dense linear algebra and plain loops."""

import math

import numpy as np
import pytest
from conftest import SMALL
from pyspark.sql import functions as F

from dealerscope.llm import hard_negatives, queries, whitening

AWKWARD = [(None, 1, [1.0, 1.0]), (20, 1, None), (21, 1, [1.0, None]), (22, 1, [math.nan, 1.0]), (23, 1, [math.inf, 1.0]), (24, 1, [1.0]), (25, 1, []), (26, None, [1.0, 2.0])]
SCHEMA = "vec_id long, label int, embedding array<double>"
EXTRA = ["x", "v", "n", "component", "deviation", "anchor", "slot", "rank", "score", "place", "block", "positive_id"]


def _frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).withColumns({name: F.lit("mine") for name in EXTRA})


# -- whitening --------------------------------------------------------------------------


def _dense(vectors):
    """(x, n, sums, whitening matrix, shares) of a plain decomposition of the distinct rows."""
    x = np.floor(64 * np.asarray(vectors, np.float64)).astype(np.int64) + 1_000_000
    fit = np.unique(x, axis=0)
    n, sums = len(fit), fit.sum(axis=0)
    y = (n * fit - sums) / n
    values, axes = np.linalg.eigh(y.T @ y / n)
    return x, n, sums, axes[:, ::-1] / np.sqrt(np.maximum(values[::-1], 1e-300)), values[::-1] / values.sum()


def test_whitening_of_the_given_vectors(spark):
    rows = queries.op12_whitening(spark, SMALL).collect()
    given = {r["vec_id"]: r["embedding"] for r in spark.read.parquet(f"{SMALL}/embeddings.parquet").collect()}
    ids = sorted(given)
    x, n, sums, matrix, shares = _dense([given[i] for i in ids])
    place = {i: k for k, i in enumerate(ids)}
    found = np.zeros((len(ids), 16))
    for r in rows:
        k = place[r["vec_id"]]
        found[k, r["component"] - 1] = r["whitened"]
        assert r["n"] == n and r["deviation"] == sum((n * int(a) - int(s)) ** 2 for a, s in zip(x[k], sums))
        assert abs(r["explained"] / shares[r["component"] - 1] - 1) < 1e-10 and r["identity_error"] < 1e-12
    assert len(rows) == 16 * len(ids)
    wanted = ((n * x - sums) / n) @ matrix[:, :16]
    wanted *= np.sign((wanted * found).sum(axis=0))
    assert np.abs(found - wanted).max() < 1e-8


@pytest.mark.parametrize("width, wanted, spread", [(64, 16, 0.0), (90, 8, 0.3), (40, 16, 2.0), (3, 16, 1.0), (1, 1, 1.0)])
def test_jacobi_davidson_reaches_double_precision(width, wanted, spread):
    rng = np.random.default_rng(width)
    a = rng.standard_normal((4 * width, width)) * np.exp(-spread * np.arange(width) / 8)
    a = a.T @ a / len(a)
    found = whitening.jacobi_davidson(lambda block: a @ block, width, min(wanted, width))
    values, vectors = np.linalg.eigh(a)
    assert np.allclose(found.values, values[::-1][:wanted], rtol=0, atol=1e-13 * values[-1])
    assert (found.residuals <= 16 * np.finfo(float).eps * math.sqrt(width) * values[-1]).all()
    assert np.abs(found.vectors.T @ found.vectors - np.eye(found.vectors.shape[1])).max() < 1e-12


def test_jacobi_davidson_with_equal_values_and_without_rank():
    q = np.linalg.qr(np.random.default_rng(5).standard_normal((60, 60)))[0]
    a = (q * np.repeat([5.0, 3.0, 0.0], [10, 10, 40])) @ q.T
    found = whitening.jacobi_davidson(lambda block: a @ block, 60, 24)
    assert np.allclose(found.values, np.repeat([5.0, 3.0, 0.0], [10, 10, 4]), atol=1e-13)


def test_minres_solves_the_projected_equation():
    rng = np.random.default_rng(3)
    q = np.linalg.qr(rng.standard_normal((12, 3)))[0]
    a = rng.standard_normal((12, 12))
    a = a + a.T
    outside = np.eye(12) - q @ q.T
    residuals = outside @ rng.standard_normal((12, 2))
    values = np.array([0.3, -0.7])
    t = whitening._corrections(lambda block: a @ block, values, residuals, q, 12)
    for k in range(2):
        assert np.allclose(outside @ (a - values[k] * np.eye(12)) @ outside @ t[:, k], -residuals[:, k], atol=1e-8)
    assert np.abs(q.T @ t).max() < 1e-10


def test_whitening_of_awkward_rows(spark):
    rows = [(1, 0, [0.0, 0.5]), (1, 0, [0.0, 0.5]), (2, 0, [1.0, 0.5]), (3, 0, [2.0, 0.5]), (4, 0, [0.001, 0.501]), *AWKWARD]
    out = whitening.whiten(_frame(spark, rows)).collect()
    # row 4 equals row 1 as whole numbers; the second entry varies with the null id's and label's rows only
    assert sorted({r["vec_id"] or 0 for r in out}) == [0, 1, 2, 3, 4, 26]
    by_row = {}
    for r in out:
        by_row.setdefault((r["vec_id"], r["component"]), []).append((r["deviation"], r["whitened"]))
    assert len(by_row[1, 1]) == 2 and set(by_row[1, 1]) == set(by_row[4, 1])
    assert {r["n"] for r in out} == {5} and {r["component"] for r in out} == {1, 2}
    one_way = [r for r in rows if r[0] in (1, 2, 3, 4)]
    flat = whitening.whiten(_frame(spark, one_way)).collect()
    assert {r["component"] for r in flat} == {1} and len(flat) == 5 and {r["explained"] for r in flat} == {1.0}
    assert whitening.whiten(_frame(spark, one_way[:2])).count() == 0  # no variance
    assert whitening.whiten(_frame(spark, []).limit(0)).count() == 0
    assert whitening.whiten(_frame(spark, [r for r in AWKWARD if r[0] in (20, 25)])).count() == 0


# -- hard negatives ---------------------------------------------------------------------


def _mined(rows, is_anchor):
    """Every anchor against all rows."""
    whole = {(i, label, tuple(math.floor(256 * c) for c in v)) for i, label, v in rows}
    out = []
    for a, label, v in whole:
        if not is_anchor(a):
            continue
        scored = sorted((-sum(p * q for p, q in zip(v, w)), i, other == label) for i, other, w in whole if i != a)
        positives = [(i, -s) for s, i, same in scored if same][:5]
        for positive, most in positives:
            fit = [(i, -s) for s, i, same in scored if not same and 80 * most <= -100 * s <= 100 * most][:5]
            out += [(a, positive, k + 1, i, most, s) for k, (i, s) in enumerate(fit)]
    return sorted(out)


def _found(frame):
    return sorted(tuple(r) for r in frame.collect())


def test_hard_negatives_of_the_given_vectors(spark):
    rows = spark.read.parquet(f"{SMALL}/embeddings.parquet").collect()
    plain = [(r["vec_id"], (r["label"] + 1) % 10 if r["vec_id"] % 7 == 0 else r["label"], r["embedding"]) for r in rows]
    wanted = _mined(plain, lambda i: i % 100 == 0)
    assert _found(queries.op13_hard_negatives(spark, SMALL)) == wanted and wanted


@pytest.mark.parametrize("anchors, part, members", [(16_384, 65_536, 32), (7, 50, 3)])
def test_hard_negatives_with_ties_copies_and_blocks(spark, monkeypatch, anchors, part, members):
    rng = np.random.default_rng(11)
    centres = rng.standard_normal((6, 5))
    vectors = np.round((centres[rng.integers(0, 6, 400)] + 0.2 * rng.standard_normal((400, 5))) * 2) / 2  # many equal scores
    rows = [(int(i), int(rng.integers(0, 4)), [float(c) for c in v]) for i, v in enumerate(vectors)]
    rows += [(1000 + i, i % 2, [1.0, 0.5, 0.0, 0.0, 1.0]) for i in range(60)]  # one hot vector
    rows += [(2000, 1, [0.0] * 5), (2010, 2, [-9.0] * 5), (5, 3, [1.0] * 5), *rows[:3]]
    monkeypatch.setattr(hard_negatives, "ANCHORS", anchors)
    monkeypatch.setattr(hard_negatives, "MEMBERS", members)
    frame = _frame(spark, [*rows, *((i, label, v) for i, label, v in AWKWARD if v != [1.0, 1.0])])
    found = hard_negatives.mine_hard_negatives(frame, frame.filter("vec_id % 10 = 0"))
    assert _found(found) == _mined(rows, lambda i: i % 10 == 0)


def test_walks_end_before_their_lists_do():
    """On vectors with structure most of a list is certified away, and nothing is lost."""
    rng = np.random.default_rng(2)
    centres = rng.standard_normal((200, 16)) * 300
    vectors = np.floor(np.repeat(centres, 100, axis=0) + rng.standard_normal((20_000, 16)) * 9).astype(np.int64)
    ids, labels = np.arange(20_000), np.arange(20_000) % 7
    at = ids[::40]
    anchors = hard_negatives.cluster(at, labels[at], vectors[at])
    anchor, _, score, found, scored = hard_negatives.walk(anchors, ids, labels, vectors, 5, True)
    assert scored < 0.25 * len(at) * len(ids)
    products = vectors[at] @ vectors.T
    for k, a in enumerate(at):
        others = np.flatnonzero((labels == labels[a]) & (ids != a))
        best = others[np.lexsort((others, -products[k, others]))][:5]
        mine = anchors.ids[anchor] == a
        assert found[mine].tolist() == best.tolist() and score[mine].tolist() == products[k, best].tolist()


def test_hard_negatives_of_awkward_tables(spark):
    frame = _frame(spark, [(0, 1, [1.0, 0.0]), (100, 1, [1.0, 0.0]), *AWKWARD])
    assert hard_negatives.mine_hard_negatives(frame, frame).count() == 0  # no row of another label
    nothing = frame.limit(0)
    assert hard_negatives.mine_hard_negatives(nothing, nothing).count() == 0
    assert hard_negatives.mine_hard_negatives(frame, nothing).count() == 0
    huge = _frame(spark, [(0, 1, [1e8, 1e8]), (1, 1, [1e8, 1.0])])
    with pytest.raises(OverflowError):
        hard_negatives.mine_hard_negatives(huge, huge)
