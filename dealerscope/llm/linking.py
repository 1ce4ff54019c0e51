"""Links between classes of equal sets that meet in buckets, without comparing what is already joined.

An operator brings the buckets and a :class:`Test`: what it knows of a class (its points), and which
pairs that leaves. Candidates are confirmed on the full sets, taken from the texts again. Only paths
of links are wanted, so three rounds do: each class with the likeliest pivot of its buckets; then each
class of a bucket's smaller components with its likeliest partner in another one; then every
candidate pair that still lies in two components.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dealerscope.llm.common import in_blocks, materialise, shingles_of_each, texts_of, word_hashes
from dealerscope.llm.components import connected_components
from dealerscope.sources.stored import write_buckets

HOT = 1000  # a key is hot if over 1 / HOT of the rows have it, so there are at most HOT such keys
SLICE = 4096  # classes of a bucket that a task compares at a time
LARGE = 64  # classes of a bucket whose main component's large buckets are searched together
UNIT = 256  # members that are confirmed against one hub together
CHUNK = 64  # hubs of a unit of the last round
_TOLD = 200_000  # pairs that a task remembers to have put out


@dataclass(frozen=True)
class Test:
    """Sets of ``words``-word shingles are linked at ``least`` hundredths of similarity.

    ``columns`` are the binary columns that make a class's point. A subclass says which pairs of
    points may be linked; it may let others through, it may not lose any it does not state.
    """

    words: int
    least: int
    columns = ()

    def points(self, rows: pa.Table | pa.RecordBatch, ending: str = ""):
        """The points of some rows, as what the other methods take."""
        raise NotImplementedError

    def pairwise(self, a, b, n_a: np.ndarray, n_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Whether each row of ``a`` may be linked with the same row of ``b``, and how likely."""
        raise NotImplementedError

    def search(self, units: Units, points) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(stray, member, how likely) for the pairs of the units that may be linked, as row numbers."""
        raise NotImplementedError

    def one_with(self, hubs, n_hubs: np.ndarray, points, at: int, n: int) -> np.ndarray:
        """Which of the points ``hubs`` may be linked with row ``at`` of other points."""
        raise NotImplementedError

    def sizes_allow(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return 100 * np.minimum(a, b).astype(np.int64) >= self.least * np.maximum(a, b).astype(np.int64)

    def linked(self, a: np.ndarray, b: np.ndarray) -> bool:
        """Whether two sorted sets have the similarity."""
        at = np.minimum(np.searchsorted(a, b), len(a) - 1)
        shared = int((a[at] == b).sum())
        return 100 * shared >= self.least * (len(a) + len(b) - shared)


@dataclass
class Units:
    """Rows of whole units, one after the other: which are strays, which are members, in which components.

    ``row`` is the point of each; one point can be in several units.
    """

    starts: np.ndarray  # of the units, one more for the end
    stray: np.ndarray
    member: np.ndarray
    n: np.ndarray
    home: np.ndarray
    row: np.ndarray = None

    def __post_init__(self):
        if self.row is None:
            self.row = np.arange(len(self.n))


def sets_of(texts: list[str], words: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingles of each text, as unsigned 64-bit hashes."""
    for part in in_blocks(texts):
        for shingles in shingles_of_each(*word_hashes(texts[part]), words):
            shingles = np.sort(shingles)  # np.unique takes ten times as long
            yield shingles[np.concatenate((shingles[:1] == shingles[:1], shingles[1:] != shingles[:-1]))]


# -- keys that many rows have -------------------------------------------------------------


def hot_keys(rows: DataFrame, key: str, total: int) -> DataFrame:
    """(key, many) of the keys that over 1 / HOT of the rows have: at most HOT, so they may be broadcast."""
    counts = rows.groupBy(key).agg(F.count(F.lit(1)).alias("many"))
    return F.broadcast(materialise(counts.filter(F.col("many") > total // HOT)))


def looked_up(rows: DataFrame, table: DataFrame, key: str, total: int) -> DataFrame:
    """Inner join of written ``rows`` to one row for each key: hot keys are broadcast, so none fills a task.

    The hot keys, at most HOT, come to the driver.
    """
    hot = [r[0] for r in hot_keys(rows, key, total).select(key).filter(F.col(key).isNotNull()).collect()]
    if not hot:
        return rows.join(table, key)
    few, rest = table.filter(F.col(key).isin(hot)), rows.filter(~F.col(key).isin(hot)).join(table, key)
    return rows.filter(F.col(key).isin(hot)).join(F.broadcast(few), key).unionByName(rest)


# -- confirmation on full sets ------------------------------------------------------------


def _confirmed(batches: Iterator[pa.RecordBatch], test: Test) -> Iterator[pa.RecordBatch]:
    """Links between the hubs and the members of units; rows come by unit, its hubs first.

    A unit's hubs are held, its members pass by.
    """
    unit, hub_points = None, None
    hubs: list[pa.RecordBatch] = []
    sets: list[np.ndarray] = []
    names: list[bytes] = []
    homes: list[bytes] = []
    for batch in batches:
        found: list[tuple[bytes, bytes]] = []
        units, members = batch.column("unit").to_pylist(), batch.column("member").to_pylist()
        classes, components = batch.column("class").to_pylist(), batch.column("component").to_pylist()
        points, n = test.points(batch), batch.column("n").to_numpy()
        for i, shingles in enumerate(sets_of(texts_of(batch), test.words)):
            if units[i] != unit:
                unit, hub_points, hubs, sets, names, homes = units[i], None, [], [], [], []
            if not members[i]:
                hubs.append(batch.slice(i, 1).select(["n", *test.columns]))
                sets.append(shingles)
                names.append(classes[i])
                homes.append(components[i])
                hub_points = None
                continue
            if not hubs:
                continue
            if hub_points is None:
                held = pa.Table.from_batches(hubs).combine_chunks()
                hub_points = test.points(held), held.column("n").to_numpy()
            for k in np.flatnonzero(test.one_with(*hub_points, points, i, n[i])).tolist():
                if names[k] != classes[i] and homes[k] != components[i] and test.linked(sets[k], shingles):
                    found.append((names[k], classes[i]))
        a, b = zip(*found) if found else ((), ())
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary())], names=["a", "b"])


_BITS = 27  # of the filter of needed documents, 16 MB


def _filter(keys: DataFrame) -> np.ndarray:
    """A Bloom filter of the column ``at``, of fixed size."""
    bits = keys.select(F.explode(F.array("at", F.xxhash64("at"))).alias("bit"))
    bit = F.pmod("bit", F.lit(1 << _BITS))
    one = F.expr(f"shiftleft(1L, cast(pmod(bit, {1 << _BITS}) & 63 as int))")
    found = bits.groupBy(F.shiftright(bit, 6).alias("word")).agg(F.bit_or(one).alias("bits")).toArrow()
    out = np.zeros(1 << (_BITS - 6), np.int64)
    out[found.column("word").to_numpy()] = found.column("bits").to_numpy()
    return out


def _passing(batches: Iterator[pa.RecordBatch], bits: Broadcast) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        passed = np.ones(batch.num_rows, dtype=bool)
        for name in ("at", "again"):
            bit = batch.column(name).to_numpy() & ((1 << _BITS) - 1)
            passed &= (bits.value[bit >> 6] >> (bit & 63)) & 1 == 1
        yield batch.filter(pa.array(passed)).select(["at", "of", "text"])


def _texts_of(classes: DataFrame, points: DataFrame, documents: DataFrame) -> DataFrame:
    """(class, text): each class with the text of the document (doc_id, version) that stands for it.

    The documents are filtered where they are, so only texts that are needed, and few others, are
    shuffled. Repeated rows of a document are one; they are found where the join has put them.
    """
    key = F.xxhash64(F.col("of.doc_id").isNull(), "of.doc_id", "of.version").alias("at")
    wanted = classes.join(points.select("class", F.col("least").alias("of")), "class").select(key, "of", "class")
    wanted = materialise(wanted)
    bits = documents.sparkSession.sparkContext.broadcast(_filter(wanted))
    known = documents.select(F.struct("doc_id", F.xxhash64("text").alias("version")).alias("of"), "text")
    keyed = known.select(key, "of", "text").withColumn("again", F.xxhash64("at"))
    passing = keyed.mapInArrow(partial(_passing, bits=bits), "at long, of struct<doc_id: long, version: long>, text string")
    found = passing.join(wanted.withColumnRenamed("of", "its"), "at").filter(F.col("of").eqNullSafe(F.col("its")))
    return found.groupBy("at", "class").agg(F.first("text").alias("text")).drop("at")


def _confirm(units: DataFrame, state: DataFrame, points: DataFrame, documents: DataFrame, test: Test) -> DataFrame:
    """Links among the rows (unit, member, class); ``state`` has the component of each class."""
    units = materialise(units)
    texts = _texts_of(units.select("class").distinct(), points, documents)
    columns = ["component", "n", *test.columns, "text"]
    about = points.drop("least").join(texts, "class").join(state.select("class", "component"), "class")
    placed = units.join(about, "class").repartition("unit").sortWithinPartitions("unit", "member", "class")
    rows = placed.select("unit", "member", "class", *columns)
    return materialise(rows.mapInArrow(partial(_confirmed, test=test), "a binary, b binary"))


def _units(pairs: DataFrame) -> DataFrame:
    """(unit, member, class) for written pairs (hub a, member b): the hub once for each UNIT members, about."""
    hot = hot_keys(pairs, "a", pairs.count())
    salt = F.when(F.col("many").isNotNull(), F.pmod(F.xxhash64("b"), F.ceil(F.col("many") / UNIT))).otherwise(0)
    dealt = pairs.join(hot, "a", "left").select("a", "b", F.xxhash64("a", salt.cast("int")).alias("unit"))
    hubs = dealt.select("unit", F.lit(False).alias("member"), F.col("a").alias("class")).distinct()
    return hubs.union(dealt.select("unit", F.lit(True), "b"))


# -- candidates of the buckets ------------------------------------------------------------


def _met(batches: Iterator[pa.RecordBatch], test: Test) -> Iterator[pa.RecordBatch]:
    """(a, b, likely) of the pairs that the test leaves."""
    for batch in batches:
        if batch.num_rows:
            n_a, n_b = batch.column("n_a").to_numpy(), batch.column("n").to_numpy()
            keep, likely = test.pairwise(test.points(batch, "_a"), test.points(batch), n_a, n_b)
            columns = [batch.column("a"), batch.column("class"), pa.array(likely.astype(np.float64))]
            yield pa.RecordBatch.from_arrays(columns, names=["a", "b", "likely"]).filter(pa.array(keep))


def _open(buckets: DataFrame, state: DataFrame, points: DataFrame, total: int, test: Test) -> DataFrame:
    """The buckets whose classes are in several components, sliced.

    Rows (place, units, stray, member, class, component, n, points, chunk), by place. Of a
    bucket's components the one with the most classes (then the greatest) is its main one, classes
    of others are strays. A pair of two components has a stray, so a bucket of many classes is cut
    into slices, and the strays of it go to each slice as well (such a row is no member of that
    slice). Slices with one main component share a ``place``, small buckets only if their least
    component is one too, so a class is sent to a place once, with the buckets (``units``) it has
    there, and a task sees that they repeat pairs.
    """
    placed = materialise(looked_up(buckets, state.select("class", "component", "many"), "class", total))
    kinds = placed.groupBy("key").agg(
        F.max(F.struct("many", "component")).alias("main"), F.min("component").alias("low"), F.max("component").alias("high"), F.count(F.lit(1)).alias("size")
    )
    around = F.when(F.col("size") > LARGE, F.xxhash64("main.component")).otherwise(F.xxhash64("main.component", "low"))
    mixed = kinds.filter("low <> high").select("key", F.col("main.component").alias("main"), around.alias("around"), F.ceil(F.col("size") / SLICE).cast("int").alias("slices"))
    mixed = materialise(mixed)
    rows = looked_up(placed.select("key", "class", "component"), mixed, "key", total)
    rows = materialise(rows.withColumn("slice", F.pmod(F.xxhash64("class"), F.col("slices")).cast("int")))
    strays = rows.filter("component <> main AND slices > 1").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)))
    strays = strays.filter("other <> slice").withColumn("slice", F.col("other")).drop("other").withColumn("member", F.lit(False))
    every = rows.withColumn("member", F.lit(True)).unionByName(strays).select(
        F.xxhash64("around", "slice").alias("place"),
        F.xxhash64("key", "slice").alias("unit"),
        (F.col("component") != F.col("main")).alias("stray"),
        "member",
        "class",
    )
    points = points.select("class", "n", *test.columns)
    once = every.repartition("class").groupBy("class", "place", "stray", "member").agg(F.collect_list("unit").alias("units"))
    rows = once.join(state.select("class", "component", "chunk"), "class").join(points, "class")
    return rows.repartition("place").sortWithinPartitions("place", "component", "class")


def _whole_units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows of some whole places, and so of whole units, at a time; those of a place follow each other."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        place = batch.column("place").to_numpy()
        same = place == place[-1]
        first = 0 if same.all() else int(len(place) - np.argmin(same[::-1]))  # the last place may go on
        if first or (held and held[-1].column("place")[-1].as_py() != place[0]):
            yield pa.Table.from_batches([*held, batch.slice(0, first)]).combine_chunks()
            held = []
        held.append(batch.slice(first))
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def _in_units(place: np.ndarray, stray: np.ndarray, member: np.ndarray, row: np.ndarray, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows of the units to search, one after the other, and where each begins.

    A place is searched as a whole where that compares no more pairs than its units do, which
    repeat them: those of a group of near copies share most of their classes. Row ``row[i]`` is in unit ``unit[i]``.
    """
    number = np.cumsum(np.concatenate(([0], place[1:] != place[:-1])))
    pairs = np.bincount(number, stray).astype(np.int64) * np.bincount(number, member).astype(np.int64)
    order = np.lexsort((unit, number[row]))
    row, unit = row[order], unit[order]
    new = np.concatenate(([True], (unit[1:] != unit[:-1]) | (number[row[1:]] != number[row[:-1]])))
    starts = np.flatnonzero(new)
    each = np.add.reduceat(stray[row].astype(np.int64), starts) * np.add.reduceat(member[row].astype(np.int64), starts)
    whole = pairs <= np.bincount(number[row[starts]], each, minlength=len(pairs))
    alone = ~whole[number[row]]
    rows = np.flatnonzero(whole[number])
    begin = np.concatenate((np.concatenate(([True], number[rows[1:]] != number[rows[:-1]])) if len(rows) else np.zeros(0, bool), new[alone]))
    rows = np.concatenate((rows, row[alone]))
    return rows, np.append(np.flatnonzero(begin), len(rows))


def _pairs_in(table: pa.Table, test: Test) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(stray, member, how likely) for the pairs of the units that may be linked, as row numbers."""
    stray, member = (np.asarray(table.column(c).combine_chunks().to_numpy(zero_copy_only=False), bool) for c in ("stray", "member"))
    home = np.unique(np.array(table.column("component").to_pylist(), dtype="V16"), return_inverse=True)[1]
    units = table.column("units").combine_chunks()
    many = units.value_lengths().to_numpy()
    rows, starts = _in_units(table.column("place").to_numpy(), stray, member, np.repeat(np.arange(len(many)), many), units.flatten().to_numpy())
    n = table.column("n").to_numpy()
    for a, b, likely in test.search(Units(starts, stray[rows], member[rows], n[rows], home[rows], rows), test.points(table)):
        yield rows[a], rows[b], likely


def _likeliest(batches: Iterator[pa.RecordBatch], test: Test) -> Iterator[pa.RecordBatch]:
    """(class, partner, likely): the likeliest partner of each stray in each unit."""
    for table in _whole_units(batches):
        found = [np.zeros((3, 0))]
        for stray, member, likely in _pairs_in(table, test):
            order = np.lexsort((-likely, stray))
            first = order[np.concatenate(([True], stray[order][1:] != stray[order][:-1]))] if len(order) else order
            found.append(np.stack((stray[first], member[first], likely[first])))
        stray, member, likely = np.concatenate(found, axis=1)
        names = table.column("class").combine_chunks()
        columns = [names.take(pa.array(stray.astype(np.int64))), names.take(pa.array(member.astype(np.int64))), pa.array(likely)]
        yield pa.RecordBatch.from_arrays(columns, names=["class", "partner", "likely"])


def _asked(batches: Iterator[pa.RecordBatch], test: Test) -> Iterator[pa.RecordBatch]:
    """(chunk, partner) for all candidates of the strays of a chunk; a task tells the last pairs of a place once."""
    place, told = None, set()
    for table in _whole_units(batches):
        places, names, chunks = table.column("place").to_numpy(), table.column("class").to_pylist(), table.column("chunk").to_numpy()
        number = np.unique(np.array(names, dtype="V16"), return_index=True, return_inverse=True)
        out: list[tuple[int, bytes]] = []
        for stray, member, _ in _pairs_in(table, test):
            pairs = np.unique(np.stack((places[stray], chunks[stray], number[2][member])), axis=1)
            for here, chunk, at in pairs.T.tolist():
                if here != place or len(told) > _TOLD:
                    place, told = here, set()
                pair = (chunk, names[number[1][at]])
                if pair not in told:
                    told.add(pair)
                    out.append(pair)
        chunk, partner = zip(*out) if out else ((), ())
        yield pa.RecordBatch.from_arrays([pa.array(chunk, pa.int64()), pa.array(partner, pa.binary())], names=["chunk", "partner"])


def _placed(state: DataFrame, links: DataFrame) -> DataFrame:
    """``state`` with each class's component by the links, and how many classes the component has."""
    joined = materialise(connected_components(links))
    sizes = joined.groupBy("component").agg(F.count(F.lit(1)).alias("many"))
    home = looked_up(joined, sizes, "component", joined.count())
    kept = state.drop("component", "many").join(home.withColumnRenamed("node", "class"), "class", "left")
    return materialise(kept.withColumns({"component": F.coalesce("component", "class"), "many": F.coalesce("many", F.lit(1))}))


def with_pivots(buckets: DataFrame) -> DataFrame:
    """Of written buckets (key, class) with the same classes one, with its least class, ``a``."""
    kinds = buckets.groupBy("key").agg(F.count(F.lit(1)).alias("size"), F.bit_xor(F.xxhash64("class")).alias("mix"), F.min("class").alias("a"))
    pivots = materialise(kinds.groupBy("size", "mix", "a").agg(F.min("key").alias("key")).select("key", "a"))
    return materialise(looked_up(buckets, pivots, "key", buckets.count()))


def link_classes(classes: DataFrame, buckets: DataFrame, documents: DataFrame, test: Test) -> DataFrame:
    """Links (a, b) between classes that join every pair of linked ones which share a bucket by a path.

    ``classes`` has class, n, least (doc_id and version) and the test's columns, ``buckets`` (key,
    class, a) those with more than one class and which of its classes, the pivot, each is compared
    with first, both written; ``documents`` has doc_id and text. Points
    of the classes in buckets are written once, in buckets by class; what changes from round to
    round is a small table beside them. Texts are fetched for the candidates of a round alone.
    """
    with_pivot, buckets = buckets, buckets.select("key", "class")
    total = buckets.count()
    needed = classes.join(buckets.select("class").distinct(), "class", "left_semi").select("class", "n", *test.columns, "least")
    points = write_buckets(needed, "class", int(documents.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    first = {"component": F.col("class"), "many": F.lit(1).cast("long"), "chunk": F.lit(0).cast("long")}
    state = materialise(points.select("class").withColumns(first))

    # each class with the likeliest of the pivots of its buckets
    met = materialise(with_pivot.filter("a <> class").select("a", "class").distinct())
    bare = points.select("class", "n", *test.columns)
    pivot = bare.withColumnsRenamed({"class": "a", "n": "n_a"} | {c: f"{c}_a" for c in test.columns})
    sided = looked_up(met, pivot, "a", met.count()).join(bare, "class")
    likely = sided.mapInArrow(partial(_met, test=test), "a binary, b binary, likely double")
    pairs = materialise(likely.groupBy("b").agg(F.max(F.struct("likely", "a")).alias("best")).select("best.a", "b"))
    links = _confirm(_units(pairs), state, points, documents, test)

    # each class of a bucket's smaller components with its likeliest partner in another one
    state = _placed(state, links)
    likely = _open(buckets, state, points, total, test).mapInArrow(partial(_likeliest, test=test), "class binary, partner binary, likely double")
    best = materialise(likely.groupBy("class").agg(F.max(F.struct("likely", "partner")).alias("best")).select("class", "best.partner"))
    pairs = best.select(F.col("partner").alias("a"), F.col("class").alias("b"))
    links = materialise(links.union(_confirm(_units(pairs), state, points, documents, test)))

    # every candidate pair that still is in two components: strays near one component share their partners' texts
    state = _placed(state, links)
    main = state.select(F.col("class").alias("partner"), F.col("component").alias("near"))
    near = looked_up(best, main, "partner", best.count()).select("class", "near")
    crowd = materialise(state.join(near, "class", "left").withColumn("near", F.coalesce("near", "component")))
    hot = hot_keys(crowd, "near", crowd.count()).withColumnRenamed("many", "crowd")
    salt = F.pmod(F.xxhash64("class"), F.ceil(F.coalesce("crowd", F.lit(1)) / CHUNK)).cast("int")
    state = materialise(crowd.join(hot, "near", "left").withColumn("chunk", F.xxhash64("near", salt)).drop("near", "crowd"))
    asked = _open(buckets, state, points, total, test).mapInArrow(partial(_asked, test=test), "chunk long, partner binary")
    members = materialise(asked.distinct())
    hubs = state.join(members.select("chunk").distinct(), "chunk", "left_semi").select("chunk", F.lit(False), "class")
    units = hubs.union(members.select("chunk", F.lit(True), "partner")).toDF("unit", "member", "class")
    return materialise(links.union(_confirm(units, state, points, documents, test)))
