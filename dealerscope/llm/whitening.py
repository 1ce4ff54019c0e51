"""Whitening of embeddings by block Jacobi-Davidson, with the covariance known by its products alone.

A product of the covariance with a few vectors is one pass over the rows: each task centres its
rows, multiplies them and sums. The search space grows by corrections of the wanted Ritz vectors;
a correction solves (I - QQ')(A - theta I)(I - QQ') t = -r with a few MINRES steps, one pass a step
for all corrections at once. Q holds the locked and the wanted vectors. Pairs are locked when their
residual is down to rounding.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dealerscope.llm.common import arrow_batch, materialise

COMPONENTS = 16
SCALE, OFFSET = 64.0, 1_000_000  # an entry c becomes floor(SCALE * c) + OFFSET
SPARE = 4  # vectors of the first search space beyond the wanted ones
SPACE = 3  # the search space holds SPACE times the wanted vectors, then it is restarted
INNER = 8  # MINRES steps of a correction
PASSES = 2000
_EPS = np.finfo(np.float64).eps


def _rows_of(batch: pa.RecordBatch, width: int) -> np.ndarray:
    return batch.column("x").flatten().to_numpy().reshape(-1, width)


def _partial(batches: Iterator[pa.RecordBatch], term: Callable[[np.ndarray], np.ndarray], width: int, kind: str) -> Iterator[pa.RecordBatch]:
    """The sum of ``term`` over the rows of a task, as one row."""
    total = None
    for batch in batches:
        if batch.num_rows:
            part = term(_rows_of(batch, width))
            total = part if total is None else total + part
    if total is not None:
        yield pa.RecordBatch.from_arrays([pa.array([total.ravel()], pa.list_(pa.int64() if kind == "long" else pa.float64()))], names=["sums"])


def _summed(rows: DataFrame, term: Callable[[np.ndarray], np.ndarray], width: int, kind: str = "double") -> list:
    """The sum of ``term`` over all rows; what reaches the driver is one such array."""
    parts = rows.select("x").mapInArrow(partial(_partial, term=term, width=width, kind=kind), f"sums array<{kind}>")
    entries = parts.select(F.posexplode("sums").alias("place", "part"))
    part = F.col("part").cast("decimal(38,0)") if kind == "long" else F.col("part")
    totals = {r["place"]: r["total"] for r in entries.groupBy("place").agg(F.sum(part).alias("total")).collect()}
    return [totals[place] for place in range(len(totals))]


@dataclass(frozen=True)
class Centre:
    """The exact mean as a whole number and a remainder, so that differences from it lose nothing."""

    n: int
    sums: tuple[int, ...]

    def whole(self) -> np.ndarray:
        return np.array([s // self.n for s in self.sums], np.int64)

    def rest(self) -> np.ndarray:
        return np.array([(s % self.n) / self.n for s in self.sums])

    def of(self, x: np.ndarray) -> np.ndarray:
        return (x - self.whole()).astype(np.float64) - self.rest()


def _product(x: np.ndarray, centre: Centre, vectors: np.ndarray) -> np.ndarray:
    y = centre.of(x)
    return y.T @ (y @ vectors)


def _orthonormal(new: np.ndarray, base: np.ndarray) -> np.ndarray:
    """Unit vectors for what the columns of ``new`` add to the space of ``base``; dependent ones go."""
    out = base
    for column in new.T:
        size = np.linalg.norm(column)
        if size == 0:
            continue
        column = column / size
        for _ in range(3):
            column = column - out @ (out.T @ column)
        left = np.linalg.norm(column)
        if left > 1e-8:
            column = column / left
            column = column - out @ (out.T @ column)
            out = np.column_stack((out, column / np.linalg.norm(column)))
    return out[:, base.shape[1] :]


def _corrections(product: Callable[[np.ndarray], np.ndarray], values: np.ndarray, residuals: np.ndarray, q: np.ndarray, steps: int) -> np.ndarray:
    """MINRES for all correction equations side by side: each column has its own shift and recurrence."""

    def outside(block: np.ndarray) -> np.ndarray:
        block = block - q @ (q.T @ block)
        return block - q @ (q.T @ block)

    v = outside(-residuals)
    beta = np.linalg.norm(v, axis=0)
    live = beta > 0
    safe = np.where(live, beta, 1.0)
    v = v / safe
    v_old, w, w_old = np.zeros_like(v), np.zeros_like(v), np.zeros_like(v)
    t = np.zeros_like(v)
    eta, gamma, gamma_old, sigma, sigma_old = beta.copy(), np.ones_like(beta), np.ones_like(beta), np.zeros_like(beta), np.zeros_like(beta)
    carried = np.zeros_like(beta)
    for _ in range(steps):
        if not live.any():
            break
        av = outside(product(v) - v * values)
        alpha = (v * av).sum(axis=0)
        following = av - alpha * v - carried * v_old
        reach = np.linalg.norm(following, axis=0)
        delta = gamma * alpha - gamma_old * sigma * carried
        rho = np.hypot(delta, reach)
        rho_2 = sigma * alpha + gamma_old * gamma * carried
        rho_3 = sigma_old * carried
        ok = live & (rho > 0)
        divide = np.where(ok, rho, 1.0)
        gamma_new, sigma_new = np.where(ok, delta / divide, 1.0), np.where(ok, reach / divide, 0.0)
        w_new = (v - rho_3 * w_old - rho_2 * w) / divide
        t = np.where(ok, t + gamma_new * eta * w_new, t)
        eta = np.where(ok, -sigma_new * eta, eta)
        live = ok & (reach > 1e-12 * np.abs(alpha).max(initial=1e-300))
        v_old, v = v, following / np.where(live, reach, 1.0)
        w_old, w = w, w_new
        gamma_old, gamma, sigma_old, sigma, carried = gamma, gamma_new, sigma, sigma_new, reach
    return t


@dataclass(frozen=True)
class Eigenpairs:
    values: np.ndarray  # falling
    vectors: np.ndarray  # one column each
    residuals: np.ndarray
    passes: int  # products with the matrix


def jacobi_davidson(product: Callable[[np.ndarray], np.ndarray], width: int, wanted: int, seed: int = 1) -> Eigenpairs:
    """The ``wanted`` largest eigenpairs of a symmetric matrix of which only products are known.

    Every residual ends at rounding, that is at 16 units of it in the largest eigenvalue for each
    sum of ``sqrt(width)`` terms; RuntimeError if PASSES products do not get there.
    """
    passes = 0

    def counted(block: np.ndarray) -> np.ndarray:
        nonlocal passes
        passes += 1
        return product(block)

    most = min(width, max(SPACE * wanted, wanted + 2 * SPARE))
    start = np.random.default_rng(seed).standard_normal((width, min(width, wanted + SPARE)))
    space = _orthonormal(start, np.zeros((width, 0)))
    image = counted(space)
    while True:
        inner = space.T @ image
        values, turned = np.linalg.eigh((inner + inner.T) / 2)
        values, turned = values[::-1], turned[:, ::-1]
        ritz, ritz_image = space @ turned, image @ turned
        residuals = ritz_image[:, :wanted] - ritz[:, :wanted] * values[:wanted]
        sizes = np.linalg.norm(residuals, axis=0)
        enough = 16 * _EPS * np.sqrt(width) * max(values[0], 0.0)
        open_ = np.flatnonzero(sizes > enough)
        if not len(open_) or space.shape[1] == width:
            return Eigenpairs(values[:wanted], ritz[:, :wanted], sizes, passes)
        if passes >= PASSES:
            raise RuntimeError(f"residuals of {sizes.max():.3g} after {passes} products")
        if space.shape[1] + len(open_) > most:  # restart: the leading Ritz vectors and their images, no product needed
            keep = min(ritz.shape[1], wanted + SPARE)
            space, image = ritz[:, :keep], ritz_image[:, :keep]
        added = _corrections(counted, values[open_], residuals[:, open_], ritz[:, :wanted], INNER)
        new = _orthonormal(added, space)
        if not new.shape[1]:
            new = _orthonormal(np.random.default_rng(seed + passes).standard_normal((width, 1)), space)
        space, image = np.column_stack((space, new)), np.column_stack((image, counted(new)))


@dataclass(frozen=True)
class Whitening:
    """What has been learned: the mean, unit eigenvectors as columns, their eigenvalues and shares of the variance."""

    centre: Centre
    values: np.ndarray
    vectors: np.ndarray
    explained: np.ndarray
    passes: int

    def apply(self, x: np.ndarray) -> np.ndarray:
        return (self.centre.of(x) @ self.vectors) / np.sqrt(self.values)


def learn_whitening(fit: DataFrame, width: int, components: int = COMPONENTS) -> Whitening | None:
    """The leading components of the rows ``x`` (array<long>, all of ``width``); None without any variance.

    Components whose eigenvalue is rounding beside the trace are left out, so there may be fewer.
    """
    n, *sums = (int(s) for s in _summed(fit, _counted, width, "long"))
    centre = Centre(n, tuple(sums))
    trace = sum(_summed(fit, partial(_squares, centre=centre), width)) / n
    if not trace > 0:
        return None

    def product(block: np.ndarray) -> np.ndarray:
        entries = _summed(fit, partial(_product, centre=centre, vectors=block), width)
        return np.array(entries).reshape(block.shape) / n

    found = jacobi_davidson(product, width, min(components, width))
    real = found.values > width * _EPS * trace
    values, vectors = found.values[real], found.vectors[:, real]
    vectors = vectors * np.where(np.take_along_axis(vectors, np.abs(vectors).argmax(axis=0)[None], axis=0) < 0, -1.0, 1.0)
    return Whitening(centre, values, vectors, np.minimum(values / trace, 1.0), found.passes)


def _counted(x: np.ndarray) -> np.ndarray:
    return np.concatenate(([len(x)], x.sum(axis=0)))


def _squares(x: np.ndarray, centre: Centre) -> np.ndarray:
    return (centre.of(x) ** 2).sum(axis=0)


def _whitened_sum(x: np.ndarray, model: Whitening) -> np.ndarray:
    return model.apply(x).sum(axis=0)


def _whitened_products(x: np.ndarray, model: Whitening, mean: np.ndarray) -> np.ndarray:
    y = model.apply(x) - mean
    return y.T @ y


def identity_error(fit: DataFrame, model: Whitening) -> float:
    """The largest entry, in size, of the whitened rows' covariance less the identity."""
    width, n, many = len(model.centre.sums), model.centre.n, len(model.values)
    mean = np.array(_summed(fit, partial(_whitened_sum, model=model), width)) / n
    products = np.array(_summed(fit, partial(_whitened_products, model=model, mean=mean), width))
    return float(np.abs(products.reshape(many, many) / n - np.eye(many)).max())


_OUT = pa.schema(
    [("vec_id", pa.int64()), ("component", pa.int32()), ("n", pa.int64()), ("deviation", pa.int64()), ("whitened", pa.float64()), ("explained", pa.float64()), ("identity_error", pa.float64())]
)


def _put_out(batches: Iterator[pa.RecordBatch], model: Whitening, error: float) -> Iterator[pa.RecordBatch]:
    many = len(model.values)
    for batch in batches:
        for start in range(0, batch.num_rows, 4096):
            part = batch.slice(start, 4096)
            rows = part.num_rows
            each = pa.array(np.repeat(np.arange(rows), many))
            yield arrow_batch(
                _OUT,
                part.column("vec_id").take(each),
                np.tile(np.arange(1, many + 1, dtype=np.int32), rows),
                np.full(rows * many, model.centre.n),
                part.column("deviation").take(each),
                model.apply(_rows_of(part, len(model.centre.sums))).ravel(),
                np.tile(model.explained, rows),
                np.full(rows * many, error),
            )


def whole_vectors(embeddings: DataFrame) -> DataFrame:
    """(vec_id, x): the rows that take part, their entries as whole numbers."""
    plain = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"))
    finite = F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    x = F.transform("v", lambda c: F.floor(c * F.lit(SCALE)).cast("long") + F.lit(OFFSET).cast("long"))
    return plain.filter("size(v) > 0").filter(finite).select("vec_id", x.alias("x"))


def whiten(embeddings: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error) for each row and component.

    A vector that is null, empty, of another length than most (the shorter on a tie), or holds a
    null or non-finite entry is dropped. Each entry c becomes x = floor(64 c) + 1000000. The fit
    list has each distinct x once: n of them, with sums S. ``deviation`` is the exact sum of
    (n x - S)^2; a value beyond a long fails, it does not wrap. ``component`` counts from 1 by falling
    eigenvalue of the fit list's covariance (divisor n), each eigenvector's largest entry positive.
    Components without variance beyond rounding are left out: one distinct vector, or no row,
    gives no result. Rows with a null id and repeated rows are put out like all others and do not
    weigh in the fit.
    """
    spark = embeddings.sparkSession
    rows = whole_vectors(embeddings)
    usual = rows.groupBy(F.size("x").alias("width")).agg(F.count(F.lit(1)).alias("many")).orderBy(F.desc("many"), "width").first()
    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    nothing = spark.createDataFrame([], schema)
    if usual is None:
        return nothing
    width = usual["width"]
    rows = rows.filter(F.size("x") == width)
    fit = materialise(rows.select("x").distinct())
    model = learn_whitening(fit, width, components)
    if model is None:
        return nothing
    n, sums = model.centre.n, model.centre.sums
    apart = F.zip_with("x", F.array(*(F.lit(s).cast("long") for s in sums)), lambda x, s: x * F.lit(n).cast("long") - s)
    deviation = F.aggregate(apart, F.lit(0).cast("long"), lambda total, a: total + a * a)
    put = partial(_put_out, model=model, error=identity_error(fit, model))
    return rows.withColumn("deviation", deviation).mapInArrow(put, schema)
