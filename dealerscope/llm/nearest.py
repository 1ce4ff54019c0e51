"""Approximate nearest neighbours by inner product: a forest of random-projection trees.

A tree splits a bounded sample at the median along the line between the centres of two random
halves, again and again. All vectors are then sent down the trees. A query goes through all trees
with one priority queue: the open node whose side of the planes is nearest comes next, whichever
tree it is in, until the query has its leaves. A point is stored once, with its leaf in every tree,
and is a candidate of a query that has any of them; candidates are ranked by their exact scores.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from dealerscope.llm.common import materialise

TREES = 6
LEAF = 128  # vectors in a leaf, about
SHARE = 2.0  # leaves that a query visits, in leaves of one tree; over all trees there are TREES times as many
SAMPLE = 32_768  # vectors to which the planes are fitted
TOP = 20
QUERIES = 4096  # queries that are sent to all tasks at a time
_PART = 4096  # points that are scored together
_VISITS_A_TASK = 128  # queries whose leaves a task looks for


@dataclass
class Forest:
    """``planes[t, n]`` and ``middles[t, n]`` of node n of tree t; the children of n are 2n + 1 and 2n + 2."""

    planes: np.ndarray
    middles: np.ndarray
    depth: int

    def leaves(self, vectors: np.ndarray) -> np.ndarray:
        """The leaf of each vector in each tree."""
        out = np.zeros((len(vectors), len(self.planes)), np.int64)
        for t in range(len(self.planes)):
            node = np.zeros(len(vectors), np.int64)
            for _ in range(self.depth):
                above = np.einsum("ij,ij->i", vectors, self.planes[t, node]) > self.middles[t, node]
                node = 2 * node + 1 + above
            out[:, t] = node - (2**self.depth - 1)
        return out

    def visit(self, margins: np.ndarray, many: int) -> list[tuple[int, int]]:
        """The (tree, leaf) pairs nearest to a query, from its margins to all planes.

        An open node waits with the squares of the margins that were crossed to reach it.
        """
        inner = 2**self.depth - 1
        queue = [(0.0, tree, 0) for tree in range(len(self.planes))]
        found: list[tuple[int, int]] = []
        while queue and len(found) < many:
            cost, tree, node = heapq.heappop(queue)
            row = margins[tree]
            while node < inner:
                margin = row[node]
                above = margin > 0
                heapq.heappush(queue, (cost + margin * margin, tree, 2 * node + 2 - above))
                node = 2 * node + 1 + above
            found.append((tree, node - inner))
        return found


def fit_forest(sample: np.ndarray, depth: int, trees: int = TREES, seed: int = 1) -> Forest:
    rng = np.random.default_rng(seed)
    inner, width = 2**depth - 1, sample.shape[1]
    planes, middles = np.zeros((trees, inner, width)), np.zeros((trees, inner))
    for t in range(trees):
        members = {0: np.arange(len(sample))}
        for node in range(inner):
            mine = members.pop(node)
            points = sample[mine]
            low, high = points[rng.choice(len(mine), 2, replace=len(mine) < 2)]
            for _ in range(4):
                near = ((points - low) ** 2).sum(axis=1) < ((points - high) ** 2).sum(axis=1)
                if near.all() or not near.any():
                    break
                low, high = points[near].mean(axis=0), points[~near].mean(axis=0)
            line = high - low
            if not line.any():
                line = rng.standard_normal(width)
            line /= np.linalg.norm(line)
            along = points @ line
            order = np.argsort(along, kind="stable")
            half = max(1, len(order) // 2)
            planes[t, node], middles[t, node] = line, along[order[half - 1]]
            members[2 * node + 1], members[2 * node + 2] = mine[order[:half]], mine[order[half:] if half < len(order) else order]
    return Forest(planes, middles, depth)


def _matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.float64).reshape(len(column), -1)


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        packed = [np.array(v, np.float64).tobytes() for v in batch.column("embedding").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("ids"), pa.array(packed, pa.binary())], names=["ids", "vector"])


def _lifted(vectors: np.ndarray, longest: float) -> np.ndarray:
    """One more coordinate, with which all vectors are equally long: the nearest has the largest product."""
    return np.column_stack((vectors, np.sqrt(np.maximum(longest**2 - (vectors**2).sum(axis=1), 0))))


def _indexed(batches: Iterator[pa.RecordBatch], forest: Broadcast, longest: float) -> Iterator[pa.RecordBatch]:
    """Each point with its leaf in every tree."""
    for batch in batches:
        if batch.num_rows:
            leaves = forest.value.leaves(_lifted(_matrix(batch.column("vector")), longest)).astype(np.int32)
            columns = [batch.column("ids"), batch.column("vector"), pa.array(list(leaves), pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays(columns, names=["ids", "vector", "leaves"])


def _visits(batches: Iterator[pa.RecordBatch], forest: Broadcast, many: int) -> Iterator[pa.RecordBatch]:
    """Each query with the leaves that it visits, a bit for each leaf of each tree."""
    trees, inner, width = forest.value.planes.shape
    for batch in batches:
        if not batch.num_rows:
            continue
        vectors = np.column_stack((_matrix(batch.column("vector")), np.zeros(batch.num_rows)))
        margins = vectors @ forest.value.planes.reshape(-1, width).T - forest.value.middles.ravel()
        bits = []
        for row in margins.reshape(len(margins), trees, inner).tolist():
            seen = np.zeros((trees, inner + 1), dtype=bool)
            tree, leaf = zip(*forest.value.visit(row, many))
            seen[list(tree), list(leaf)] = True
            bits.append(np.packbits(seen).tobytes())
        yield pa.RecordBatch.from_arrays([batch.column("query_id"), batch.column("vector"), pa.array(bits, pa.binary())], names=["query_id", "vector", "seen"])


@dataclass
class Block:
    """Some queries: their vectors, and a packed bit for each leaf of each tree that they visit."""

    vectors: np.ndarray
    bits: np.ndarray
    leaves: int

    def some(self, start: int, many: int = 512) -> tuple[np.ndarray, np.ndarray]:
        """Vectors of some queries, and ``seen[tree, leaf, query]``."""
        bits = self.bits[start : start + many]
        seen = np.unpackbits(bits, axis=1, count=TREES * self.leaves).astype(bool).reshape(len(bits), TREES, self.leaves)
        return self.vectors[start : start + many], np.ascontiguousarray(seen.transpose(1, 2, 0))


_FOUND = "query int, ids array<long>, score double"


def _scored(batches: Iterator[pa.RecordBatch], block: Broadcast, top: int) -> Iterator[pa.RecordBatch]:
    """The best points of a task's part for each query, by exact scores; a point is scored once for all queries."""
    for batch in batches:
        parts = [batch.slice(start, _PART) for start in range(0, batch.num_rows, _PART)]
        read = [(_matrix(p.column("vector")), p.column("leaves").flatten().to_numpy().reshape(p.num_rows, -1)) for p in parts]
        first_ids = [np.array([ids[0] for ids in p.column("ids").to_pylist()]) for p in parts]
        for start in range(0, len(block.value.vectors) if parts else 0, 512):
            queries, seen = block.value.some(start)
            for part, (vectors, leaves), ids in zip(parts, read, first_ids):
                query, point, score = _best_of(vectors, leaves, ids, queries, seen, top)
                columns = [pa.array((query + start).astype(np.int32)), part.column("ids").take(pa.array(point)), pa.array(score)]
                yield pa.RecordBatch.from_arrays(columns, names=["query", "ids", "score"])


def _best_of(vectors, leaves, first_ids, queries, seen, top: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    candidate = np.zeros((len(vectors), len(queries)), dtype=bool)
    for tree in range(leaves.shape[1]):
        candidate |= seen[tree, leaves[:, tree]]
    rough = np.where(candidate, vectors @ queries.T, -np.inf).T
    many = min(top + 1, len(vectors))
    # a little more than the last place may still tie with it
    floor = np.partition(rough, len(vectors) - many, axis=1)[:, len(vectors) - many]
    slack = np.where(np.isfinite(floor), 1e-9 * (1 + np.abs(floor)), 0)
    query, point = np.nonzero((rough >= (floor - slack)[:, None]) & candidate.T)
    score = (queries[query] * vectors[point]).sum(axis=1)  # a row alone: alike in every part
    order = np.lexsort((first_ids[point], -score, query))
    query, point, score = query[order], point[order], score[order]
    keep = np.arange(len(query)) - np.searchsorted(query, query) <= top
    return query[keep], point[keep], score[keep]


def nearest(embeddings: DataFrame, queries: DataFrame, top: int = TOP, share: float = SHARE) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``top`` rows found for each query, largest inner product first.

    Both tables have vec_id and embedding; a query's own vec_id is no candidate. Ties go to the
    smaller vec_id, scores are those of the given vectors in double precision. Vectors that are
    null, zero, of another length than most, or hold a null or a non-finite number take no part,
    nor do rows without an id; repeated rows count once. An empty table has no neighbours.

    Equal vectors are one point of the index with their ``top`` + 1 smallest ids, which is all a
    query can need of them; they are numbered in salted parts first. The planes are fitted to
    SAMPLE points or fewer, the forest goes to all tasks (at most SAMPLE / 4 planes a tree), every
    point is indexed, in one row. Queries go to all tasks in blocks of at most QUERIES, with a bit for
    each leaf; each task scores its points against them in one product and yields the best of its part
    for each query. A query visits ``share`` times as many leaves as one tree has.
    """
    spark = embeddings.sparkSession
    points, queries = _valid(embeddings), _valid(queries)
    sizes = points.groupBy(F.size("embedding").alias("width")).agg(F.count(F.lit(1)).alias("many"))
    usual = sizes.orderBy(F.desc("many"), "width").first()
    nothing = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    if usual is None:
        return nothing
    points = points.filter(F.size("embedding") == usual["width"])
    queries = queries.filter(F.size("embedding") == usual["width"])

    salted = Window.partitionBy("embedding", F.pmod(F.xxhash64("vec_id"), F.lit(64))).orderBy("vec_id")
    whole = Window.partitionBy("embedding").orderBy("vec_id")
    few = points.withColumn("place", F.row_number().over(salted)).filter(F.col("place") <= top + 1)
    few = few.withColumn("place", F.row_number().over(whole)).filter(F.col("place") <= top + 1)
    classes = few.groupBy("embedding").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))
    index = materialise(classes.mapInArrow(_pack, "ids array<long>, vector binary"))

    norm = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x * x))
    longest = points.agg(F.max(norm)).first()[0]
    many = index.count()
    sample = index.select("vector", F.xxhash64("vector").alias("by")).orderBy("by", "vector").limit(SAMPLE).toArrow()
    depth = max(0, int(np.ceil(np.log2(max(1.0, min(many / LEAF, SAMPLE / 8, len(sample) / 2))))))
    forest = spark.sparkContext.broadcast(fit_forest(_lifted(_matrix(sample.column("vector").combine_chunks()), longest), depth))

    placing = partial(_indexed, forest=forest, longest=longest)
    index = materialise(index.mapInArrow(placing, "ids array<long>, vector binary, leaves array<int>"))

    asked = materialise(queries.withColumn("ids", F.array("vec_id")).mapInArrow(_pack, "ids array<long>, vector binary"))
    asked = asked.select(F.col("ids")[0].alias("query_id"), "vector")
    number = asked.count()
    visiting = partial(_visits, forest=forest, many=max(TREES, round(share * 2**depth)))
    spread = asked.repartition(max(1, -(-number // _VISITS_A_TASK)))
    blocks = max(1, -(-number // QUERIES))
    visits = spread.mapInArrow(visiting, "query_id long, vector binary, seen binary")
    visits = materialise(visits.withColumn("block", F.pmod(F.xxhash64("query_id", "vector"), F.lit(blocks)).cast("int")))
    found = nothing
    for block in range(blocks):
        mine = visits.filter(F.col("block") == block).select("query_id", "vector", "seen").toArrow().combine_chunks()
        if mine.num_rows:
            found = found.union(_search_block(index, mine, depth, top))
    return found


def _search_block(index: DataFrame, queries: pa.Table, depth: int, top: int) -> DataFrame:
    """The results of the queries of one block, which all tasks get."""
    spark = index.sparkSession
    bits = np.frombuffer(b"".join(queries.column("seen").to_pylist()), np.uint8).reshape(queries.num_rows, -1)
    vectors = _matrix(queries.column("vector").combine_chunks())
    block = spark.sparkContext.broadcast(Block(vectors, bits, 1 << depth))
    best = materialise(index.mapInArrow(partial(_scored, block=block, top=top), _FOUND))
    block.destroy()
    names = pa.table([pa.array(np.arange(queries.num_rows, dtype=np.int32)), queries.column("query_id")], names=["query", "query_id"])
    rows = best.select("query", "score", F.explode("ids").alias("vec_id")).join(F.broadcast(spark.createDataFrame(names)), "query")
    order = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    ranked = rows.filter("vec_id <> query_id").withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    return ranked.select("query_id", "rank", "vec_id", "score")


def _valid(table: DataFrame) -> DataFrame:
    """vec_id and embedding of the rows that take part, -0.0 as 0.0, repeated rows once."""
    plain = table.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    kept = plain.filter("vec_id IS NOT NULL AND embedding IS NOT NULL").filter(finite).filter(F.exists("embedding", lambda x: x != 0))
    return kept.withColumn("embedding", F.transform("embedding", lambda x: x + F.lit(0.0))).dropDuplicates()
