"""K-means for many (k, seed) pairs at once: one pass over the points moves the centres of all of them."""

from __future__ import annotations

import sys
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass
from fractions import Fraction
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dealerscope.sources.durable import materialise

# The passes travel to the workers as code, so they need numpy and pyarrow only.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

UNITS = 1_000_000  # points are whole numbers of millionths, whose sums are alike in any order
PASSES = 100
TOLERANCE = 1e-4  # a model stands still when none of its centres moves farther
POINTS_PER_TASK = 50_000  # a pass is bound by arithmetic, so points are dealt by their number and not their bytes
_BLOCK = 4096  # points that are compared with all centres together


@dataclass(frozen=True)
class Clustering:
    """Centres in the order of their cluster ids, and the exact sum of squared distances to the nearest."""

    k: int
    seed: int
    centres: tuple[tuple[float, ...], ...]
    inertia: float


def whole_points(rows: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """(key, hash, x): the points as whole numbers of 1 / UNITS, written once and read by every pass.

    ``rows`` are counted, and dealt to one file for each POINTS_PER_TASK if they are more.
    """
    x = F.array(*(F.round(F.col(c).cast("double") * UNITS).cast("long") for c in columns))
    points = rows.select(F.col(key).alias("key"), F.xxhash64(key).alias("hash"), x.alias("x"))
    files = -(-rows.count() // POINTS_PER_TASK)
    return materialise(points.repartition(files) if files > 1 else points)


def _mixed(x: np.ndarray) -> np.ndarray:
    """Scrambles unsigned 64-bit integers: two rounds of shift, exclusive or and odd factor."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xA0761D6478BD642F)
    return x ^ (x >> np.uint64(32))


def _points(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column("x").flatten().to_numpy().reshape(batch.num_rows, -1)


def _squares(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Squared distances, a row for each centre; summed in the order of the dimensions, so that a
    point's are its own in any batch."""
    out = np.zeros((len(centres), len(x)))
    for d in range(x.shape[1]):
        away = np.ascontiguousarray(x[:, d])[None, :] - centres[:, d, None]
        out += np.square(away, out=away)
    return out


def _draws(batches: Iterator[pa.RecordBatch], models: list[tuple[int, int, np.ndarray]]) -> Iterator[pa.RecordBatch]:
    """The task's winner of each model's draw: of exponential waiting times, at the rate of the
    squared distance to the model's nearest centre, the shortest."""
    best: dict[int, tuple[float, int, list[int]]] = {}
    turns = [_mixed(np.array([seed * 1_000_003 + len(centres) + 1], np.uint64)) for _, seed, centres in models]
    for batch in batches:
        hashes = batch.column("hash").to_numpy().view(np.uint64)
        every = _points(batch).astype(np.float64)
        for start in range(0, len(every), _BLOCK):
            x, hashed = every[start : start + _BLOCK], hashes[start : start + _BLOCK]
            for (model, _, centres), turn in zip(models, turns):
                luck = (_mixed(hashed ^ turn).astype(np.float64) + 1) / 2.0**64
                rate = _squares(x, centres).min(axis=0) if len(centres) else np.ones(len(x))
                with np.errstate(divide="ignore"):
                    wait = np.where(rate > 0, -np.log(luck) / rate, np.inf)
                alike = np.flatnonzero(wait == wait.min())
                first = int(alike[hashed[alike].argmin()])
                entry = (float(wait[first]), int(hashed[first].astype(np.int64)), x[first].astype(np.int64).tolist())
                if np.isfinite(entry[0]) and (model not in best or entry < best[model]):
                    best[model] = entry
    if best:
        waits, hashes_, xs = zip(*best.values())
        columns = [pa.array(list(best), pa.int32()), pa.array(waits), pa.array(hashes_, pa.int64()), pa.array(xs, pa.list_(pa.int64()))]
        yield pa.RecordBatch.from_arrays(columns, names=["model", "wait", "hash", "x"])


def _seeded(points: DataFrame, jobs: Sequence[tuple[int, int]]) -> list[np.ndarray]:
    """First centres of all models, each drawn with a chance in proportion to its squared distance
    from those before; one pass for each centre. Fewer than k if there are fewer distinct points."""
    centres: list[list[list[int]]] = [[] for _ in jobs]
    open_ = set(range(len(jobs)))
    while open_:
        models = [(m, jobs[m][1], np.array(centres[m], np.float64)) for m in sorted(open_)]
        drawn = points.select("hash", "x").mapInArrow(partial(_draws, models=models), "model int, wait double, hash long, x array<long>")
        winners = drawn.groupBy("model").agg(F.min(F.struct("wait", "hash", "x")).alias("first")).select("model", "first.x").collect()
        for row in winners:
            centres[row["model"]].append(list(row["x"]))
        open_ = {r["model"] for r in winners if len(centres[r["model"]]) < jobs[r["model"]][0]}
    return [np.array(c, np.float64) for c in centres]


def _nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """For each of some models (their centres: models, clusters, dimensions) and each point the nearest
    cluster; the lower of two that are equally near."""
    least = _squares(x, centres[:, 0])
    nearest = np.zeros(least.shape, np.int8 if centres.shape[1] < 128 else np.int64)
    for cluster in range(1, centres.shape[1]):
        squares = _squares(x, centres[:, cluster])
        nearest[squares < least] = cluster
        np.minimum(least, squares, out=least)
    return nearest


def _moves(batches: Iterator[pa.RecordBatch], models: list[tuple[int, np.ndarray]]) -> Iterator[pa.RecordBatch]:
    """Points and coordinate sums of each model's clusters in the task. Models of as many clusters go together."""
    groups = [[(m, c) for m, c in models if len(c) == size] for size in sorted({len(c) for _, c in models})]
    centres = [np.stack([c for _, c in group]) for group in groups]
    width = centres[0].shape[2]
    counts = [np.zeros(c.shape[:2], np.int64) for c in centres]
    sums = [np.zeros(c.shape, np.int64) for c in centres]
    for batch in batches:
        points = _points(batch)
        for start in range(0, len(points), _BLOCK):
            x = points[start : start + _BLOCK]
            exact = x.astype(np.float64)
            # in two halves, whose sums of a block a double holds exactly, in any order
            parts = np.concatenate((np.ones((len(x), 1)), x >> 32, x & 0xFFFFFFFF), axis=1)
            for c, count, sum_ in zip(centres, counts, sums):
                nearest = _nearest(exact, c)
                for cluster in range(c.shape[1]):
                    found = ((nearest == cluster).astype(np.float64) @ parts).astype(np.int64)
                    count[:, cluster] += found[:, 0]
                    sum_[:, cluster] += (found[:, 1 : width + 1] << 32) + found[:, width + 1 :]
    if counts[0].any():
        model = [m for group, c in zip(groups, centres) for m, _ in group for _ in range(c.shape[1])]
        cluster = [j for c in centres for _ in range(c.shape[0]) for j in range(c.shape[1])]
        rows = np.concatenate([s.reshape(-1, width) for s in sums])
        columns = [
            pa.array(model, pa.int32()), pa.array(cluster, pa.int32()), pa.array(np.concatenate([c.ravel() for c in counts])),
            pa.array(list(rows), pa.list_(pa.int64())),
        ]
        yield pa.RecordBatch.from_arrays(columns, names=["model", "cluster", "n", "sums"])


def _pass(points: DataFrame, models: list[tuple[int, np.ndarray]]) -> dict[int, list[tuple[int, list[int]]]]:
    """(points, coordinate sums) of each cluster of each model: what reaches the driver is a row a cluster."""
    width = models[0][1].shape[1]
    parts = points.select("x").mapInArrow(partial(_moves, models=models), "model int, cluster int, n long, sums array<long>")
    totals = [F.sum(F.col("sums")[d].cast("decimal(38,0)")).alias(f"s{d}") for d in range(width)]
    out = {m: [(0, [0] * width)] * len(c) for m, c in models}
    for r in parts.groupBy("model", "cluster").agg(F.sum("n").alias("n"), *totals).collect():
        out[r["model"]][r["cluster"]] = (r["n"], [int(r[f"s{d}"]) for d in range(width)])
    return out


def _inertia(squares: int, clusters: list[tuple[int, list[int]]], centres: np.ndarray) -> float:
    """The sum of squared distances, exact until it is rounded once."""
    total = Fraction(squares)
    for (n, sums), centre in zip(clusters, centres.tolist()):
        at = [Fraction(c) for c in centre]
        total += n * sum(c * c for c in at) - 2 * sum(c * s for c, s in zip(at, sums))
    return float(total / UNITS**2)


def fit_many(points: DataFrame, jobs: Iterable[tuple[int, int]], passes: int = PASSES, tolerance: float = TOLERANCE) -> list[Clustering]:
    """A clustering for each (k, seed), by Lloyd's steps from drawn centres; ``points`` as of :func:`whole_points`.

    All models move in the same passes, those that stand still drop out. Every choice hangs on
    a point's own hash and on exact sums, so the result is the same however the points lie. A
    cluster without points stays where it is; a point between two centres goes to the lower id.
    """
    jobs = list(jobs)
    centres = _seeded(points, jobs)
    live = [m for m in range(len(jobs)) if len(centres[m])]
    if not live:
        return [Clustering(k, seed, (), 0.0) for k, seed in jobs]
    far = (tolerance * UNITS) ** 2
    moving = live
    for _ in range(passes):
        still = []
        for m, clusters in _pass(points, [(m, centres[m]) for m in moving]).items():
            moved = np.array([[s / n for s in sums] if n else old for (n, sums), old in zip(clusters, centres[m].tolist())])
            if ((moved - centres[m]) ** 2).sum(axis=1).max() > far:
                still.append(m)
            centres[m] = moved
        moving = still
        if not moving:
            break
    square = F.aggregate("x", F.lit(0).cast("decimal(38,0)"), lambda total, x: (total + x.cast("decimal(19,0)") * x).cast("decimal(38,0)"))
    squares = int(points.agg(F.sum(square)).first()[0])
    final = _pass(points, [(m, centres[m]) for m in live])
    return [
        Clustering(
            k, seed, tuple(tuple(c / UNITS for c in centre) for centre in centres[m].tolist()), _inertia(squares, final[m], centres[m]) if m in final else 0.0
        )
        for m, (k, seed) in enumerate(jobs)
    ]


def nearest_centre(columns: Sequence[str], clustering: Clustering) -> Column:
    """The id of the nearest centre; the lower of two that are equally near."""
    choices = []
    for number, centre in enumerate(clustering.centres):
        square = sum((F.col(c) - F.lit(x)) * (F.col(c) - F.lit(x)) for c, x in zip(columns, centre))
        choices.append(F.struct(square.alias("square"), F.lit(number).alias("id")))
    return F.array_min(F.array(*choices))["id"]
