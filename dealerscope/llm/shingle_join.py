"""Similarity join of documents on word shingles, with R-trees over count vectors.

Documents with one set of shingles form a class, a point of a space whose coordinates count its
shingles by group. The sum of the smaller coordinates of two points bounds their overlap, and so does
that of a point and the upper corner of a box of an R-tree. Random texts fill such a space evenly,
so one tree over all points could not prune; trees are built where points are near each other. Two
classes of similarity t or more share one of their first shingles in any fixed order (the first
``n - ceil(t n) + 1`` of n), so classes meet in buckets, one for each such shingle, frequent shingles
last, and each bucket has its R-tree. Pairs that its search leaves are tested on finer counts, if
the texts are long, and verified on the shingles themselves (:mod:`linking`).
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from dealerscope.llm.common import kept_for, materialise, mix64, texts_of
from dealerscope.llm.components import connected_components
from dealerscope.llm.linking import Test, Units, link_classes, looked_up, sets_of

WORDS = 5
LEAST = 75  # least similarity, in hundredths
GROUPS = 256  # coordinates of a point
FINE = {2048: 11, 1 << 14: 14, 1 << 18: 18}  # sets of more shingles also have counts by this many bits of the hash
FREQUENT = 4000  # a shingle is frequent in over 1 / 4000 of the documents
MOST_FREQUENT = 2_000_000  # the rarest of the frequent shingles beyond this count as rare
_FANOUT = 8
_COUNTED = 1 << 21  # shingles counted together in a task
_PUT_OUT = 1 << 17  # shingles that a task puts out together
_SEARCHED = 1 << 19  # pairs of a stray and a member of its unit that a search has at most, or one stray's
_PART = 1 << 16  # first shingles of a part, about


def _class_of(shingles: np.ndarray) -> bytes:
    """128 bits that name a set: the sums of its hashes and of their squares."""
    sums = (int(shingles.sum(dtype=np.uint64)), int((shingles * shingles).sum(dtype=np.uint64)))
    return sums[0].to_bytes(8, "little") + sums[1].to_bytes(8, "little")


def _key(name: bytes) -> int:
    """The half of a class's name by which its prefix rows go."""
    return int.from_bytes(name[:8], "little", signed=True)


def _signed(values: np.ndarray) -> pa.Array:
    return pa.array(values.view(np.int64))


def _packed(counts: np.ndarray) -> bytes:
    """A point in one, two or four bytes a coordinate, as its largest one needs."""
    return counts.astype("<u1" if counts.max() < 1 << 8 else "<u2" if counts.max() < 1 << 16 else "<u4").tobytes()


def _unpacked(points: list[bytes]) -> np.ndarray:
    """Points of all widths as one matrix."""
    sizes = np.fromiter(map(len, points), np.int64, len(points)) // GROUPS
    kind = np.dtype(f"<u{int(sizes.max(initial=1))}")
    out = np.empty((len(points), GROUPS), kind)
    for size in np.unique(sizes).tolist():
        mine = np.flatnonzero(sizes == size)
        out[mine] = np.frombuffer(b"".join(points[i] for i in mine.tolist()), f"<u{size}").reshape(len(mine), GROUPS)
    return out


def _fine_counts(shingles: np.ndarray) -> bytes | None:
    """Counts by more groups, for a set of many shingles; none where one would not fit 16 bits."""
    bits = max((b for n, b in FINE.items() if len(shingles) > n), default=None)
    if bits is None:
        return None
    counts = np.bincount((shingles >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits)
    return _packed(counts) if counts.max() < 1 << 16 else None


def _spread(fine: bytes) -> np.ndarray:
    """Fine counts as numbers: one or two bytes each, by the number of groups that FINE has."""
    groups = {1 << bits for bits in FINE.values()}
    return np.frombuffer(fine, "<u1" if len(fine) in groups else "<u2").astype(np.int64)


def _survey(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each document, its counts where its class is met first in the task; rows
    (frequent, times) for shingles met often in a task."""
    kept_for("shingles")
    names = ["doc_id", "version", "n", "class", "key", "counts", "fine", "frequent", "times"]
    seen: set[bytes] = set()
    kept: list[np.ndarray] = []
    size = 0

    def counted() -> pa.RecordBatch:
        values, times = np.unique(np.concatenate(kept), return_counts=True)
        often = times > 2
        n, nulls = int(often.sum()), pa.nulls
        kinds = (pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.int64(), pa.binary(), pa.binary())
        columns = [nulls(n, kind) for kind in kinds]
        return pa.RecordBatch.from_arrays([*columns, _signed(values[often]), pa.array(times[often])], names=names)

    for batch in batches:
        sizes, classes, counts, fine = [], [], [], []
        for shingles in sets_of(texts_of(batch), WORDS):
            sizes.append(len(shingles))
            classes.append(_class_of(shingles))
            counts.append(None)
            fine.append(None)
            if classes[-1] not in seen:
                seen.add(classes[-1])
                counts[-1] = _packed(np.bincount((shingles >> np.uint64(56)).astype(np.int64), minlength=GROUPS))
                fine[-1] = _fine_counts(shingles)
                kept.append(shingles)
                size += len(shingles)
            if size > _COUNTED:
                yield counted()
                kept.clear()
                size = 0
        n = len(sizes)
        keys = np.array([_key(name) for name in classes], np.int64)
        columns = [batch.column("doc_id"), batch.column("version"), pa.array(sizes, pa.int32()), pa.array(classes, pa.binary())]
        columns += [pa.array(keys), pa.array(counts, pa.binary()), pa.array(fine, pa.binary())]
        yield pa.RecordBatch.from_arrays([*columns, pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64())], names=names)
    if kept:
        yield counted()


def _prefixes(batches: Iterator[pa.RecordBatch], frequent: Broadcast) -> Iterator[pa.RecordBatch]:
    """(shingle, class key) for the first shingles of each set; a set once for each task."""
    values, times = frequent.value
    seen: set[bytes] = set()
    firsts: list[np.ndarray] = []
    keys: list[np.ndarray] = []
    size = 0

    def found() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([_signed(np.concatenate(firsts)), pa.array(np.concatenate(keys))], names=["shingle", "key"])

    for batch in batches:
        for shingles in sets_of(texts_of(batch), WORDS):
            n = len(shingles)
            name = _class_of(shingles)
            if not n or name in seen:
                continue
            seen.add(name)
            many = n - -(-3 * n // 4) + 1
            if len(values):
                at = np.minimum(np.searchsorted(values, shingles), len(values) - 1)
                often = values[at] == shingles
                late = shingles[often][np.argsort(times[at[often]], kind="stable")]
                shingles = np.concatenate((shingles[~often], late))
            firsts.append(shingles[:many].copy())  # no view, which would hold the whole set
            keys.append(np.full(many, _key(name)))
            size += many
            if size > _PUT_OUT:
                yield found()
                firsts, keys, size = [], [], 0
    if firsts:
        yield found()


def _in_parts(part: np.ndarray, bits: int, *columns: np.ndarray) -> pa.RecordBatch:
    """A row (part, bytes of each column) for each part that rows of numbers lie in; columns go with the parts."""
    order = np.argsort(part.astype(np.uint16), kind="stable")
    many = np.bincount(part.astype(np.int64), minlength=1 << bits)
    present = np.flatnonzero(many)
    packed = []
    for column in columns:
        ends = np.concatenate(([0], np.cumsum(many[present]))) * column.itemsize
        buffers = [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(column[order]))]
        packed.append(pa.Array.from_buffers(pa.binary(), len(present), buffers))
    return pa.RecordBatch.from_arrays([pa.array(present.astype(np.int32)), *packed], names=["part", *(f"c{i}" for i in range(len(columns)))])


def _part_of(values: np.ndarray, bits: int) -> np.ndarray:
    return (values >> np.uint64(64 - bits)) if bits else np.zeros(len(values), np.uint64)


def _whole_parts(batches: Iterator[pa.RecordBatch], *kinds: str) -> Iterator[list[np.ndarray]]:
    """The columns of one part after the other, from rows sorted by part."""
    part, held = None, []

    def joined() -> list[np.ndarray]:
        return [np.frombuffer(b"".join(column), kind) for column, kind in zip(zip(*held), kinds)]

    for batch in batches:
        parts, columns = batch.column(0).to_pylist(), [batch.column(i + 1).to_pylist() for i in range(len(kinds))]
        for mine, *blobs in zip(parts, *columns):
            if held and mine != part:
                yield joined()
                held = []
            part = mine
            held.append(blobs)
    if held:
        yield joined()


def _dealt(batches: Iterator[pa.RecordBatch], frequent: Broadcast, bits: int) -> Iterator[pa.RecordBatch]:
    """The rows of :func:`_prefixes` by parts of the shingles: few large rows are shuffled and sorted, not all small ones."""
    for batch in _prefixes(batches, frequent):
        shingle = batch.column(0).to_numpy().view(np.uint64)
        yield _in_parts(_part_of(shingle, bits), bits, shingle, batch.column(1).to_numpy())


def _runs(*columns: np.ndarray) -> np.ndarray:
    """Where in sorted rows a new one starts."""
    new = np.ones(len(columns[0]), bool)
    new[1:] = columns[0][1:] != columns[0][:-1]
    for column in columns[1:]:
        new[1:] |= column[1:] != column[:-1]
    return np.flatnonzero(new)


_HEAD = np.dtype([("mix", "<u8"), ("low", "<i8"), ("shingle", "<i8"), ("size", "<i8")])


def _shared(batches: Iterator[pa.RecordBatch], bits: int) -> Iterator[pa.RecordBatch]:
    """The buckets of shingles that more than one class has: (head, keys), by parts of a mix of their keys.

    Buckets of the same classes have equal heads but for the shingle, so they meet in one part.
    """
    heads: list[np.ndarray] = []
    members: list[np.ndarray] = []
    size = 0

    def found() -> pa.RecordBatch:
        head, keys = np.concatenate(heads), np.concatenate(members)
        part = _part_of(head["mix"], bits)
        many = head["size"]
        by_head, by_key = _in_parts(part, bits, head), _in_parts(np.repeat(part, many), bits, keys)
        return pa.RecordBatch.from_arrays([*by_head.columns, by_key.column(1)], names=["part", "c0", "c1"])

    for shingle, key in _whole_parts(batches, "<i8", "<i8"):
        order = np.argsort(shingle)
        shingle, key = shingle[order], key[order]
        same = shingle[1:] == shingle[:-1]
        met = np.concatenate((same, [False])) | np.concatenate(([False], same))
        shingle, key = shingle[met], key[met]  # met by several rows, perhaps of one class
        order = np.lexsort((key, shingle))
        shingle, key = shingle[order], key[order]
        once = _runs(shingle, key)
        shingle, key = shingle[once], key[once]
        starts = _runs(shingle)
        many = np.diff(np.append(starts, len(shingle)))
        shared = many > 1
        keys = key[np.repeat(shared, many)]
        starts, many = starts[shared], many[shared]
        if not len(starts):
            continue
        head = np.empty(len(starts), _HEAD)
        head["mix"] = np.bitwise_xor.reduceat(mix64(keys.view(np.uint64)), np.cumsum(many) - many)
        head["low"], head["shingle"], head["size"] = key[starts], shingle[starts], many
        heads.append(head)
        members.append(keys)
        size += len(keys)
        if size > _PUT_OUT:
            yield found()
            heads, members, size = [], [], 0
    if heads:
        yield found()


def _distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, member, shingles): of buckets of the same classes one, named by the least of its shingles, and how many they were."""
    for head, keys in _whole_parts(batches, _HEAD, "<i8"):
        starts = np.cumsum(head["size"]) - head["size"]
        order = np.lexsort((head["shingle"], head["low"], head["size"], head["mix"]))
        head, starts = head[order], starts[order]
        once = _runs(head["mix"], head["size"], head["low"])
        times = np.diff(np.append(once, len(head)))
        head, starts = head[once], starts[once]
        many = head["size"]
        at = np.repeat(starts - np.cumsum(many) + many, many) + np.arange(int(many.sum()))
        columns = [np.repeat(head["shingle"], many), keys[at], np.repeat(times, many)]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["key", "member", "shingles"])


def _buckets(frame: DataFrame, classes: DataFrame, frequent: Broadcast) -> DataFrame:
    """(key, class, a): the distinct buckets, with the class each is compared with first.

    That is the class of the bucket most of whose shingles are first ones of others too: in a group
    of near copies the one that the others were made from, or one of the least changed.
    """
    partitions = int(frame.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    total = classes.agg(F.sum("n")).first()[0] or 0
    bits = min(16, max(total // 4 // _PART, 4 * partitions).bit_length())
    blobs = "part int, c0 binary, c1 binary"
    dealt = frame.select("text").mapInArrow(partial(_dealt, frequent=frequent, bits=bits), blobs)
    shared = dealt.repartition("part").sortWithinPartitions("part").mapInArrow(partial(_shared, bits=bits), blobs)
    distinct = shared.repartition("part").sortWithinPartitions("part").mapInArrow(_distinct, "key long, member long, shingles long")
    named = materialise(distinct).join(classes.select(F.col("key").alias("member"), "class", "n"), "member")
    central = F.sum("shingles").over(Window.partitionBy("member")) / F.col("n")
    named = materialise(named.select("key", "class", central.alias("central")))
    pivots = named.groupBy("key").agg(F.max(F.struct("central", "class")).alias("most")).select("key", F.col("most.class").alias("a"))
    return materialise(looked_up(named.drop("central"), materialise(pivots), "key", named.count()))


@dataclass
class RTrees:
    """R-trees of many units, packed level by level: level 0 holds the points, the last one a root for each unit.

    A box is its upper corner, its least and largest set and its component (-1 for several).
    ``first`` and ``many`` name a node's children on the level below.
    """

    corner: list[np.ndarray]
    least: list[np.ndarray]
    largest: list[np.ndarray]
    component: list[np.ndarray]
    first: list[np.ndarray]
    many: list[np.ndarray]
    unit: np.ndarray  # of each root, rising

    @classmethod
    def pack(cls, points: np.ndarray, sizes: np.ndarray, components: np.ndarray, unit: np.ndarray) -> RTrees:
        """Points must come by unit, near ones together."""
        none = np.zeros(0, np.int64)
        trees = cls([points], [sizes], [sizes], [components], [none], [none], unit)
        while (trees.unit[1:] == trees.unit[:-1]).any():
            new = np.concatenate(([True], trees.unit[1:] != trees.unit[:-1]))
            begin = np.flatnonzero(new)
            place = np.arange(len(new)) - np.repeat(begin, np.diff(np.append(begin, len(new))))
            starts = np.flatnonzero(place % _FANOUT == 0)
            low = np.minimum.reduceat(trees.component[-1], starts)
            high = np.maximum.reduceat(trees.component[-1], starts)
            trees.corner.append(np.maximum.reduceat(trees.corner[-1], starts))
            trees.least.append(np.minimum.reduceat(trees.least[-1], starts))
            trees.largest.append(np.maximum.reduceat(trees.largest[-1], starts))
            trees.component.append(np.where(low == high, low, -1))
            trees.first.append(starts)
            trees.many.append(np.diff(np.append(starts, len(new))))
            trees.unit = trees.unit[starts]
        return trees

    def search(self, points: np.ndarray, sizes: np.ndarray, components: np.ndarray, unit: np.ndarray, test: Counts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, point, overlap bound) for what the trees of the queries' units cannot rule out."""
        at = np.minimum(np.searchsorted(self.unit, unit), len(self.unit) - 1)
        query = np.flatnonzero(self.unit[at] == unit)
        node = at[query]
        for level in range(len(self.corner) - 1, -1, -1):
            small, large, mine = self.least[level][node], self.largest[level][node], sizes[query]
            keep = (self.component[level][node] != components[query]) & (100 * large >= test.least * mine) & (100 * mine >= test.least * small)
            query, node = query[keep], node[keep]
            overlap = _overlaps(self.corner[level], node, points, query)
            keep = test.bound_allows(overlap, self.least[level][node], sizes[query])
            query, node, overlap = query[keep], node[keep], overlap[keep]
            if level:
                many = self.many[level][node]
                query = np.repeat(query, many)
                node = np.repeat(self.first[level][node] - np.cumsum(many) + many, many) + np.arange(many.sum())
        return query, node, overlap


def _overlaps(a: np.ndarray, at_a: np.ndarray, b: np.ndarray, at_b: np.ndarray) -> np.ndarray:
    """Sums of the smaller coordinates, row by row."""
    out = np.empty(len(at_a), np.int64)
    for start in range(0, len(out), 1024):  # so many stay in a core's cache
        part = slice(start, start + 1024)
        out[part] = np.minimum(a[at_a[part]], b[at_b[part]]).sum(axis=1, dtype=np.uint32)
    return out


class Counts(Test):
    """Points are counts by group; the bound on the overlap, coarse then fine, says what may be linked.

    The trees hold the coarse counts; the fine ones of long texts are compared with what the trees leave.
    """

    columns = ("counts", "fine")

    def points(self, rows, ending: str = ""):
        coarse = _unpacked(rows.column(f"counts{ending}").to_pylist())
        return coarse, rows.column(f"fine{ending}").to_pylist()

    def bound_allows(self, overlap: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """overlap / (a + b - overlap) can reach the least similarity."""
        return (100 + self.least) * overlap >= self.least * (a.astype(np.int64) + b)

    def _fine_allows(self, a: bytes | None, b: bytes | None, n: int) -> bool:
        if a is None or b is None:
            return True
        x, y = map(_spread, (a, b))
        few = min(len(x), len(y))
        x, y = (v.reshape(few, -1).sum(axis=1) for v in (x, y))
        return (100 + self.least) * int(np.minimum(x, y).sum()) >= self.least * n

    def _with_fine(self, keep: np.ndarray, a: list, b: list, n: np.ndarray) -> np.ndarray:
        keep = keep.copy()
        for i in np.flatnonzero(keep).tolist():
            keep[i] = self._fine_allows(a[i], b[i], int(n[i]))
        return keep

    def pairwise(self, a, b, n_a, n_b):
        every = np.arange(len(n_a))
        overlap = _overlaps(a[0], every, b[0], every)
        keep = self.bound_allows(overlap, n_a, n_b) & self.sizes_allow(n_a, n_b)
        together = n_a.astype(np.int64) + n_b
        return self._with_fine(keep, a[1], b[1], together), overlap / np.maximum(together, 1)

    def one_with(self, hubs, n_hubs, points, at, n):
        overlap = _overlaps(hubs[0], np.arange(len(n_hubs)), points[0], np.full(len(n_hubs), at))
        keep = self.bound_allows(overlap, n_hubs, n) & self.sizes_allow(n_hubs, n)
        return self._with_fine(keep, hubs[1], [points[1][at]] * len(n_hubs), n_hubs.astype(np.int64) + n)

    def search(self, units: Units, points):
        coarse, fine = points
        unit = np.repeat(np.arange(len(units.starts) - 1), np.diff(units.starts))
        member, stray = np.flatnonzero(units.member), np.flatnonzero(units.stray)
        if not len(member):
            return
        # a component holds near copies: packed together, by size, their boxes are tight
        order = member[np.lexsort((units.n[member], units.home[member], unit[member]))]
        n, home, row = units.n.astype(np.int64), units.home.astype(np.int64), units.row
        trees = RTrees.pack(coarse[row[order]], n[order], home[order], unit[order])
        # strays of small units go together, up to so many pairs
        pairs = np.cumsum(np.bincount(unit[member], minlength=len(units.starts))[unit[stray]])
        start = 0
        while start < len(stray):
            most = (pairs[start - 1] if start else 0) + _SEARCHED
            part = stray[start : max(start + 1, min(start + 4096, int(np.searchsorted(pairs, most, side="right"))))]
            start += len(part)
            query, point, overlap = trees.search(coarse[row[part]], n[part], home[part], unit[part], self)
            a, b = part[query], order[point]
            together = n[a] + n[b]
            keep = self._with_fine(np.ones(len(a), bool), [fine[i] for i in row[a].tolist()], [fine[i] for i in row[b].tolist()], together)
            if keep.any():
                yield a[keep], b[keep], (overlap / np.maximum(together, 1))[keep]


@dataclass
class SimilarDocuments:
    """``members``: (doc_id, version, n_shingles, class, group, component_id, links); ``links``: (a, b), pairs of classes."""

    members: DataFrame
    links: DataFrame


def join_similar(documents: DataFrame) -> SimilarDocuments:
    """Documents whose sets of 5-word shingles have a Jaccard similarity of at least 3/4.

    Words are runs of characters other than ASCII white space, A-Z lower-cased; a text of fewer
    words has its whole sequence as one shingle; one without words, or null, has none and no
    links. ``members`` has every row; ``component_id`` is the least doc_id that links reach, its
    own if none; ``class`` names its set, ``group`` the class that stands for its component, and
    ``version`` is the text's hash. ``links`` connects classes so that each pair of similar
    documents is joined by a path of links, without every pair in a large group: where two classes
    are already joined, they are not compared, and the column ``links`` counts the links of a class
    that were found, not all similar classes. Repeated rows and exact copies are one class. Rows
    with a null id take part and can join others. Shingles and sets are known by hashes of 64 and
    128 bits.
    """
    spark = documents.sparkSession
    frame = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    schema = "doc_id long, version long, n int, class binary, key long, counts binary, fine binary, frequent long, times long"
    survey = materialise(frame.withColumn("version", F.xxhash64("text")).mapInArrow(_survey, schema))
    rows = survey.filter("class IS NOT NULL").select("doc_id", "version", "n", "class")
    least = F.min(F.struct(F.col("doc_id").isNull().alias("unknown"), "doc_id", "version"))
    classes = survey.filter("class IS NOT NULL").groupBy("class").agg(
        least.alias("least"), F.first("key").alias("key"), F.first("n").alias("n"),
        F.first("counts", ignorenulls=True).alias("counts"), F.first("fine", ignorenulls=True).alias("fine"),
    )
    classes = materialise(classes.withColumn("least", F.struct("least.doc_id", "least.version")))

    many = max(32, rows.count() // FREQUENT)
    often = survey.filter("times IS NOT NULL").groupBy("frequent").agg(F.sum("times").alias("times")).filter(F.col("times") > many)
    often = often.orderBy(F.desc("times"), "frequent").limit(MOST_FREQUENT).toArrow()
    values = often.column("frequent").to_numpy().view(np.uint64)
    order = np.argsort(values)
    frequent = spark.sparkContext.broadcast((values[order], often.column("times").to_numpy()[order]))

    links = link_classes(classes, _buckets(frame, classes, frequent), frame, Counts(WORDS, LEAST))
    joined = connected_components(links)

    home = classes.select("class", F.col("least.doc_id").alias("least_id")).join(joined.withColumnRenamed("node", "class"), "class", "left")
    home = materialise(home.withColumn("component", F.coalesce("component", "class")))
    ids = home.groupBy("component").agg(F.min("least_id").alias("component_id"))
    degree = links.select("a").union(links.select("b")).toDF("class").groupBy("class").agg(F.count(F.lit(1)).alias("links"))
    home = looked_up(home.drop("least_id"), ids, "component", home.count()).join(degree, "class", "left").select(
        "class", F.col("component").alias("group"), "component_id", F.coalesce("links", F.lit(0)).alias("links")
    )
    members = looked_up(rows, materialise(home), "class", rows.count())
    own = F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("component_id"))
    members = members.select("doc_id", "version", F.col("n").alias("n_shingles"), "class", "group", own.alias("component_id"), "links")
    return SimilarDocuments(members, links)


def one_of_each(documents: DataFrame) -> DataFrame:
    """The documents with all their columns, whatever their names, one of each group of similar ones.

    The one with the least doc_id stays, then the one whose text has the least hash; a null id
    comes last, and of repeated rows one stays. Texts without words are all kept.
    """
    members = join_similar(documents).members
    best = F.min(F.struct(F.col("doc_id").isNull().alias("unknown"), "doc_id", "version")).alias("best")
    kept = members.filter("n_shingles > 0").groupBy("group").agg(best).select("best.doc_id", "best.version")
    own = uuid.uuid4().hex  # no column of the documents has such a name
    kept = materialise(kept.distinct()).toDF(f"id_{own}", f"of_{own}")
    words = F.coalesce("text", F.lit("")).rlike(r"[^ \t\n\x0B\f\r]")
    marked = documents.withColumn(f"text_{own}", F.xxhash64("text"))
    same = F.col("doc_id").cast("long").eqNullSafe(F.col(f"id_{own}")) & (F.col(f"text_{own}") == F.col(f"of_{own}"))
    once = marked.filter(words).join(kept, same, "left_semi").dropDuplicates(["doc_id", f"text_{own}"])
    return once.union(marked.filter(~words)).drop(f"text_{own}")
