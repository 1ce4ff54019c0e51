"""Hard negatives from lists that a cluster of anchors shares.

Anchors are clustered by direction. For a cluster, the rows are sorted once by a bound of their
inner product with any member: a row at angle t from the centre, in a cluster of radius r, has at
most |row| cos(t - r) with a member of length 1. Every member walks that list in blocks and stops
when the next bound, times its own length, is certainly below the last place that counts. The list
of a cluster lies in parts, one with each task that holds rows; a part is walked to its own
certified end and yields its own best rows, which are then merged.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from dealerscope.llm.common import arrow_batch, materialise

SCALE = 256.0  # a component x becomes floor(SCALE * x)
POSITIVES, NEGATIVES = 5, 5
LEAST, OF = 80, 100  # a negative has LEAST / OF of the positive's score, or more, up to all of it
ANCHORS = 16_384  # anchors that are broadcast at a time
MEMBERS = 8  # anchors of a cluster, about
SAMPLE = 8192  # anchors to which the centres of a block are fitted
_PART = 65_536  # rows that a task sorts and walks together
_STEP = 2048  # rows of a list that its walkers score at a time
_SLACK = 1e-9


@dataclass
class Anchors:
    """Anchors of one block, ordered by cluster; ``windows`` holds their positives' scores, least ones first."""

    ids: np.ndarray
    labels: np.ndarray
    vectors: np.ndarray
    starts: np.ndarray  # of the clusters, one more for the end
    centres: np.ndarray
    radii: np.ndarray
    windows: list[np.ndarray] | None = None


def _unit(vectors: np.ndarray) -> np.ndarray:
    sizes = np.linalg.norm(vectors, axis=1, keepdims=True)
    return vectors / np.where(sizes > 0, sizes, 1.0)


def cluster(ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray, seed: int = 1) -> Anchors:
    """Spherical k-means of the anchors, fitted to SAMPLE of them; every anchor goes to its nearest centre."""
    directions = _unit(vectors.astype(np.float64))
    rng = np.random.default_rng(seed)
    sample = directions[rng.permutation(len(directions))[:SAMPLE]]
    many = max(1, -(-len(directions) // MEMBERS))
    centres = sample[:many].copy()
    for _ in range(6):
        home = (sample @ centres.T).argmax(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, home, sample)
        moved = np.linalg.norm(sums, axis=1) > 0
        centres[moved] = _unit(sums[moved])
    home = (directions @ centres.T).argmax(axis=1)
    order = np.lexsort((ids, home))
    used, starts = np.unique(home[order], return_index=True)
    cosine = np.einsum("ij,ij->i", directions, centres[home])[order]
    radii = np.arccos(np.clip(np.minimum.reduceat(cosine, starts), -1, 1)) + _SLACK
    lying = np.linalg.norm(directions[order], axis=1) == 0  # a zero vector has no direction and score 0 only
    radii[np.logical_or.reduceat(lying, starts)] = np.pi
    return Anchors(ids[order], labels[order], vectors[order], np.append(starts, len(order)), centres[used], radii)


def _scores(a: np.ndarray, b: np.ndarray, exact_float: bool) -> np.ndarray:
    """Exact integer inner products."""
    if exact_float:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return a @ b.T


_LEAST = np.iinfo(np.int64).min
_FOUND = pa.schema([("anchor", pa.int32()), ("slot", pa.int32()), ("score", pa.int64()), ("vec_id", pa.int64())])


class _Best:
    """The best rows of each (anchor, slot) so far: score, then smaller id; ``floor`` is the last place's score."""

    def __init__(self, slots: int, top: int) -> None:
        self.scores = np.full((slots, top), _LEAST, np.int64)
        self.ids = np.full((slots, top), np.iinfo(np.int64).max, np.int64)

    @property
    def floor(self) -> np.ndarray:
        return self.scores[:, -1]

    def offer(self, slot: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        top = self.scores.shape[1]
        touched, at = np.unique(slot, return_inverse=True)
        slots = np.concatenate((np.repeat(np.arange(len(touched)), top), at))
        scores = np.concatenate((self.scores[touched].ravel(), score))
        names = np.concatenate((self.ids[touched].ravel(), ids))
        order = np.lexsort((names, -scores.astype(np.float64), slots)) if abs(scores[scores > _LEAST]).max(initial=0) < 2**53 else np.lexsort((names, ~scores, slots))
        order = order[np.arange(len(order)) - np.searchsorted(slots[order], slots[order]) < top]
        self.scores[touched] = scores[order].reshape(-1, top)
        self.ids[touched] = names[order].reshape(-1, top)


def walk(anchors: Anchors, ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray, top: int, exact_float: bool) -> tuple[np.ndarray, ...]:
    """(anchor, slot, score, id) of the best rows of one part for all anchors, and how many rows were scored.

    Without windows the rows are those of the anchor's label other than itself, and there is one
    slot. With windows a slot is a positive's score, and its rows are those of other labels within
    the window.
    """
    lengths = np.linalg.norm(vectors.astype(np.float64), axis=1)
    directions = _unit(vectors.astype(np.float64))
    found, scored = [], 0
    for c in range(len(anchors.centres)):
        members = np.arange(anchors.starts[c], anchors.starts[c + 1])
        angle = np.arccos(np.clip(directions @ anchors.centres[c], -1, 1))
        bound = lengths * np.cos(np.maximum(angle - anchors.radii[c], 0)) * (1 + _SLACK * np.sign(np.cos(np.maximum(angle - anchors.radii[c], 0)))) + _SLACK
        order = np.argsort(-bound, kind="stable")
        bound = bound[order]
        mine = anchors.vectors[members]
        reach = np.linalg.norm(mine.astype(np.float64), axis=1)
        if anchors.windows is None:
            high = np.full((len(members), 1), np.iinfo(np.int64).max)
            low = np.full((len(members), 1), _LEAST)
        else:
            widest = max(len(anchors.windows[m]) for m in members)
            high = np.full((len(members), max(widest, 1)), _LEAST)
            for i, m in enumerate(members):
                high[i, : len(anchors.windows[m])] = anchors.windows[m]
            low = -((-LEAST * high) // OF)  # the least whole number at or above LEAST / OF of the score
        slots = high.shape[1]
        best = _Best(len(members) * slots, top)
        open_slot = low <= high
        open_slot &= high > _LEAST
        for start in range(0, len(order), _STEP):
            # a bound is over one unit of length; whole-number scores cannot exceed its floor
            most = np.floor(np.minimum(bound[start] * reach + _SLACK, 9.2e18)).astype(np.int64)
            needed = np.maximum(best.floor.reshape(len(members), slots), low)
            open_slot &= most[:, None] >= needed
            walkers = np.flatnonzero(open_slot.any(axis=1))
            if not len(walkers):
                break
            rows = order[start : start + _STEP]
            score = _scores(mine[walkers], vectors[rows], exact_float)
            scored += score.size
            same = anchors.labels[members[walkers]][:, None] == labels[rows][None, :]
            if anchors.windows is None:
                fits = same & (anchors.ids[members[walkers]][:, None] != ids[rows][None, :])
            else:
                fits = ~same
            for s in range(slots):
                at = np.flatnonzero(open_slot[walkers, s])
                if not len(at):
                    continue
                floor = np.maximum(best.floor.reshape(len(members), slots)[walkers[at], s], low[walkers[at], s])
                inside = fits[at] & (score[at] >= floor[:, None]) & (score[at] <= high[walkers[at], s][:, None])
                which, row = np.nonzero(inside)
                if len(which):
                    best.offer(walkers[at[which]] * slots + s, score[at[which], row], ids[rows[row]])
        slot, place = np.nonzero(best.scores > _LEAST)
        found.append((members[slot // slots], slot % slots, best.scores[slot, place], best.ids[slot, place]))
    return (*map(np.concatenate, zip(*found)), scored)


def _walked(batches: Iterator[pa.RecordBatch], anchors: Broadcast, top: int, exact_float: bool) -> Iterator[pa.RecordBatch]:
    held: list[pa.RecordBatch] = []

    def part() -> pa.RecordBatch:
        table = pa.Table.from_batches(held).combine_chunks()
        vectors = table.column("v").combine_chunks().flatten().to_numpy().reshape(table.num_rows, -1)
        ids, labels = table.column("vec_id").to_numpy(), table.column("label").to_numpy()
        anchor, slot, score, vec_id, _ = walk(anchors.value, ids, labels, vectors, top, exact_float)
        held.clear()
        return arrow_batch(_FOUND, anchor.astype(np.int32), slot.astype(np.int32), score, vec_id)

    for batch in batches:
        for start in range(0, batch.num_rows, _PART):
            held.append(batch.slice(start, _PART))
            if sum(b.num_rows for b in held) >= _PART:
                yield part()
    if held:
        yield part()


def _merged(found: DataFrame, top: int) -> DataFrame:
    order = Window.partitionBy("anchor", "slot").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)


def whole_vectors(embeddings: DataFrame) -> DataFrame:
    """(vec_id, label, v): the rows that take part, components as whole numbers, repeated rows once."""
    plain = embeddings.select(
        F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), F.col("embedding").cast("array<double>").alias("e")
    )
    finite = F.forall("e", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    kept = plain.filter("vec_id IS NOT NULL AND label IS NOT NULL AND size(e) > 0").filter(finite)
    return kept.select("vec_id", "label", F.transform("e", lambda x: F.floor(x * F.lit(SCALE)).cast("long")).alias("v")).dropDuplicates()


_RESULT = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


def mine_hard_negatives(embeddings: DataFrame, anchors: DataFrame) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    Both tables have vec_id, label and embedding; ``anchors`` are rows of ``embeddings``. An
    anchor's positives are its POSITIVES best other rows of its label; for each, the NEGATIVES best rows of
    other labels follow whose score is LEAST / OF of the positive's or more and not above it. A score
    is the exact inner product of the whole numbers floor(256 x); higher ones come first, ties by
    smaller vec_id. A positive without such a negative has no row.

    Rows whose vec_id, label or vector is null or empty, whose vector has another length than most
    (the shorter on a tie), or a null or non-finite component, take no part. Repeated rows count
    once; rows that share an id but not all else are rows of their own, and none is a positive of
    its own id. Whole numbers whose products could leave a long raise OverflowError. Empty tables
    give no rows.

    Of equal vectors with one label the POSITIVES + 1 smallest ids stand for all: no result can need more.
    Anchors are broadcast in blocks of at most ANCHORS; a block's centres are fitted to SAMPLE of
    its anchors. Every row is walked or certified, so the result is exact.
    """
    spark = embeddings.sparkSession
    rows, asked = whole_vectors(embeddings), whole_vectors(anchors)
    usual = rows.groupBy(F.size("v").alias("width")).agg(F.count(F.lit(1)).alias("many")).orderBy(F.desc("many"), "width").first()
    if usual is None:
        return spark.createDataFrame([], _RESULT)
    rows, asked = rows.filter(F.size("v") == usual["width"]), materialise(asked.filter(F.size("v") == usual["width"]))
    few = max(POSITIVES, NEGATIVES) + 1
    salted = Window.partitionBy("v", "label", F.pmod(F.xxhash64("vec_id"), F.lit(64))).orderBy("vec_id")
    whole = Window.partitionBy("v", "label").orderBy("vec_id")
    rows = rows.withColumn("place", F.row_number().over(salted)).filter(F.col("place") <= few)
    rows = materialise(rows.withColumn("place", F.row_number().over(whole)).filter(F.col("place") <= few).drop("place"))

    size = F.array_max(F.transform("v", F.abs))
    largest = max(frame.agg(F.max(size)).first()[0] or 0 for frame in (rows, asked))
    if usual["width"] * largest * largest * OF >= 2**63:
        raise OverflowError("inner products of these vectors do not fit a long")
    exact_float = usual["width"] * largest * largest < 2**53

    blocks = max(1, -(-asked.count() // ANCHORS))
    numbered = asked.withColumn("block", F.pmod(F.xxhash64("vec_id", "label", "v"), F.lit(blocks)).cast("int"))
    results = []
    for number in range(blocks):
        block = numbered.filter(F.col("block") == number).orderBy("vec_id", "label", "v").toArrow().combine_chunks()
        if not block.num_rows:
            continue
        vectors = block.column("v").combine_chunks().flatten().to_numpy().reshape(block.num_rows, -1)
        mine = cluster(block.column("vec_id").to_numpy(), block.column("label").to_numpy(), vectors)
        results.append(_mine_block(rows, mine, exact_float))
    if not results:
        return spark.createDataFrame([], _RESULT)
    mined = results[0]
    for more in results[1:]:
        mined = mined.union(more)
    return mined


def _mine_block(rows: DataFrame, mine: Anchors, exact_float: bool) -> DataFrame:
    """One block: a walk for the positives, which go back with the anchors as windows, and one for the negatives."""
    spark = rows.sparkSession
    shape = "anchor int, slot int, score long, vec_id long"
    known = spark.sparkContext.broadcast(mine)
    near = _merged(rows.mapInArrow(partial(_walked, anchors=known, top=POSITIVES, exact_float=exact_float), shape), POSITIVES)
    found = near.select("anchor", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")).toArrow()
    scores = [np.zeros(0, np.int64)] * len(mine.ids)
    owner, reached = found.column("anchor").to_numpy(), found.column("positive_score").to_numpy()
    order = np.lexsort((reached, owner))
    names, starts = np.unique(owner[order], return_index=True)
    for name, part in zip(names.tolist(), np.split(reached[order], starts[1:])):
        scores[name] = np.unique(part)
    mine.windows = scores
    slot = np.array([np.searchsorted(scores[a], s) for a, s in zip(owner.tolist(), reached.tolist())], np.int32)
    columns = [found.column("anchor"), pa.array(slot), pa.array(mine.ids[owner]), found.column("positive_id"), found.column("positive_score")]
    positives = spark.createDataFrame(pa.table(columns, names=["anchor", "slot", "anchor_id", "positive_id", "positive_score"]))
    windows = spark.sparkContext.broadcast(mine)
    walked = rows.mapInArrow(partial(_walked, anchors=windows, top=NEGATIVES, exact_float=exact_float), shape)
    negatives = _merged(materialise(walked), NEGATIVES)
    ranked = positives.join(negatives, ["anchor", "slot"])
    mined = ranked.select("anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
    mined = materialise(mined)
    known.destroy()
    windows.destroy()
    return mined
