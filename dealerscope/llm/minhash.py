"""Near duplicates by b-bit MinHash.

Documents with one set of shingles form a class. A class has MINIMA minima; BANDS bands of ROWS of
them name its buckets, and of all minima the low BITS are packed into its signature. Two classes of
a bucket are candidates if their sizes allow the similarity and so does the estimate from the
signatures: equal places less those that are equal by chance. :mod:`linking` confirms candidates on
the full sets and passes over what is already joined.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dealerscope.llm.common import arrow_batch, materialise, mix64, texts_of
from dealerscope.llm.components import connected_components
from dealerscope.llm.linking import Test, link_classes, looked_up, sets_of, with_pivots

WORDS = 2
LEAST = 80  # least similarity, in hundredths
MINIMA = 256
BITS = 2
BANDS, ROWS = 32, 4  # a pair at the least similarity meets in no bucket with a chance of (1 - 0.8^4)^32, 5 in 10^8
SIGMAS = 6  # a candidate's estimate may be this many deviations below the least similarity

_RNG = np.random.default_rng(20)
_FACTORS = _RNG.integers(0, 2**64, MINIMA, dtype=np.uint64) | np.uint64(1)
_TURNS = _RNG.integers(0, 2**64, MINIMA, dtype=np.uint64)


def _class_of(shingles: np.ndarray) -> bytes:
    """128 bits that name a set: sums of two mixes of its hashes."""
    sums = (int(shingles.sum(dtype=np.uint64)), int(mix64(shingles).sum(dtype=np.uint64)))
    return sums[0].to_bytes(8, "little") + sums[1].to_bytes(8, "little")


def minima_of(sets: list[np.ndarray]) -> np.ndarray:
    """One row of MINIMA minima for each set; no set may be empty."""
    every = np.concatenate(sets)
    starts = np.cumsum([0, *map(len, sets)])[:-1]
    out = np.empty((len(sets), MINIMA), np.uint64)
    for i in range(MINIMA):
        out[:, i] = np.minimum.reduceat((every ^ _TURNS[i]) * _FACTORS[i], starts)
    return out


def bands_of(minima: np.ndarray) -> np.ndarray:
    """The buckets of each row, as signed 64-bit keys."""
    parts = minima[:, : BANDS * ROWS].reshape(len(minima), BANDS, ROWS)
    keys = np.zeros((len(minima), BANDS), np.uint64) + np.arange(1, BANDS + 1, dtype=np.uint64)
    for i in range(ROWS):
        keys = mix64(keys + parts[:, :, i])
    return keys.view(np.int64)


def signatures_of(minima: np.ndarray) -> np.ndarray:
    """The low bits of all minima, packed: MINIMA * BITS / 8 bytes a row."""
    low = (mix64(minima) & np.uint64((1 << BITS) - 1)).astype(np.uint8)
    each = 8 // BITS
    packed = np.zeros((len(minima), MINIMA // each), np.uint8)
    for i in range(each):
        packed |= low[:, i::each] << (BITS * i)
    return packed


_LANES = np.uint64(int("0" * (BITS - 1) + "1", 2) * ((2**64 - 1) // (2**BITS - 1)))


def equal_places(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many minima have equal low bits, for rows of packed signatures (as 64-bit words) that broadcast."""
    apart = a ^ b
    some = apart
    for i in range(1, BITS):
        some = some | (apart >> np.uint64(i))
    return MINIMA - np.bitwise_count(some & _LANES).sum(axis=-1, dtype=np.int64)


def similarity_from(places: np.ndarray) -> np.ndarray:
    """The similarity estimated from equal places, less the 2^-BITS that are equal by chance."""
    chance = 2.0**-BITS
    return np.clip((places / MINIMA - chance) / (1 - chance), 0, 1)


def least_places(least: int) -> int:
    """The fewest equal places with which a pair of the least similarity is still a candidate."""
    chance = 2.0**-BITS
    p = chance + (1 - chance) * least / 100
    return int(np.floor(MINIMA * p - SIGMAS * np.sqrt(MINIMA * p * (1 - p))))


_SURVEY = pa.schema(
    [("doc_id", pa.int64()), ("version", pa.int64()), ("n", pa.int32()), ("class", pa.binary()), ("bands", pa.list_(pa.int64())), ("signature", pa.binary())]
)


def _survey(batches: Iterator[pa.RecordBatch], words: int) -> Iterator[pa.RecordBatch]:
    """A row for each document; its bands and signature where its class is met first in the task."""
    seen: set[bytes] = set()
    for batch in batches:
        sizes, classes, bands, signatures = [], [], [], []
        for shingles_of_block in _in_lists(sets_of(texts_of(batch), words)):
            fresh = []
            for shingles in shingles_of_block:
                sizes.append(len(shingles))
                classes.append(_class_of(shingles) if len(shingles) else None)
                fresh.append(len(shingles) > 0 and classes[-1] not in seen)
                if fresh[-1]:
                    seen.add(classes[-1])
            chosen = [s for s, new in zip(shingles_of_block, fresh) if new]
            if chosen:
                minima = minima_of(chosen)
                found = iter(zip(bands_of(minima), signatures_of(minima)))
            for new in fresh:
                band, signature = next(found) if new else (None, None)
                bands.append(band)
                signatures.append(signature.tobytes() if new else None)
        yield arrow_batch(_SURVEY, batch.column("doc_id"), batch.column("version"), sizes, classes, bands, signatures)


def _in_lists(sets: Iterator[np.ndarray], most: int = 1 << 18) -> Iterator[list[np.ndarray]]:
    """Lists of sets of about ``most`` shingles together."""
    held: list[np.ndarray] = []
    size = 0
    for shingles in sets:
        held.append(shingles)
        size += len(shingles)
        if size >= most:
            yield held
            held, size = [], 0
    if held:
        yield held


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint64).reshape(len(column), -1)


class Signatures(Test):
    """Points are signatures; a pair may be linked if its sizes and its estimate allow it."""

    columns = ("signature",)

    def points(self, rows, ending: str = "") -> np.ndarray:
        return _matrix(rows.column(f"signature{ending}"))

    def pairwise(self, a, b, n_a, n_b):
        places = equal_places(a, b)
        return (places >= least_places(self.least)) & self.sizes_allow(n_a, n_b), places

    def one_with(self, hubs, n_hubs, points, at, n):
        return self.pairwise(hubs, points[at], n_hubs, n)[0]

    def search(self, units, points):
        for start, end in zip(units.starts[:-1].tolist(), units.starts[1:].tolist()):
            strays, members = start + np.flatnonzero(units.stray[start:end]), start + np.flatnonzero(units.member[start:end])
            for part in np.array_split(strays, 1 + len(strays) * len(members) // 1_000_000):
                fits, places = self.pairwise(points[units.row[part]][:, None], points[units.row[members]][None], units.n[part][:, None], units.n[members][None])
                at, to = np.nonzero(fits & (units.home[part][:, None] != units.home[members][None]))
                if len(at):
                    yield part[at], members[to], places[at, to]


def _links(classes: DataFrame, documents: DataFrame, words: int, least: int) -> DataFrame:
    """Links between classes that join every pair of similar ones by a path."""
    bands = materialise(classes.select("class", F.explode("bands").alias("key")))
    shared = bands.groupBy("key").agg(F.count(F.lit(1)).alias("many")).filter("many > 1").select("key")
    buckets = materialise(looked_up(bands, materialise(shared), "key", bands.count()))
    return link_classes(classes, with_pivots(buckets), documents, Signatures(words, least))


def near_duplicates(documents: DataFrame, words: int = WORDS, least: int = LEAST) -> DataFrame:
    """(doc_id, version, n_shingles, class, group, component_id, kept) for every row of documents.

    Words are runs of characters other than ASCII white space, A-Z lower-cased. A document's set holds
    its distinct runs of ``words`` words; with fewer words, the whole sequence as one; without words, or
    with a null text, it is empty and has no links. Documents are linked when their sets have a similarity of
    ``least`` hundredths or more, confirmed on the full sets. ``component_id`` is the least doc_id
    that links reach, ``kept`` whether it is the row's own; a row with a null id is kept only if its
    whole component has null ids, whose component_id is null. ``class`` names the set, ``group`` one
    class of the component (both null for an empty set), ``version`` the text. Exact copies and repeated
    rows are one class. Sets are known by hashes of 64 and 128 bits; a pair meets in no bucket or
    is passed over by its estimate with a chance of about 10^-7 at the least similarity, less above it.
    """
    frame = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    versions = frame.withColumn("version", F.xxhash64("text"))
    schema = "doc_id long, version long, n int, class binary, bands array<long>, signature binary"
    survey = materialise(versions.mapInArrow(partial(_survey, words=words), schema))
    rows = survey.filter("class IS NOT NULL").select("doc_id", "version", "n", "class")
    classes = survey.filter("class IS NOT NULL").groupBy("class").agg(
        F.min(F.struct(F.col("doc_id").isNull().alias("unknown"), "doc_id", "version")).alias("least"),
        F.first("n").alias("n"), F.first("bands", ignorenulls=True).alias("bands"), F.first("signature", ignorenulls=True).alias("signature"),
    )
    classes = materialise(classes.withColumn("least", F.struct("least.doc_id", "least.version")))
    joined = connected_components(_links(classes, frame, words, least)).withColumnsRenamed({"node": "class", "component": "group"})
    home = classes.select("class", F.col("least.doc_id").alias("least_id")).join(joined, "class", "left")
    home = materialise(home.withColumn("group", F.coalesce("group", "class")))
    ids = home.groupBy("group").agg(F.min("least_id").alias("component_id"))
    home = materialise(looked_up(home.select("class", "group"), ids, "group", home.count()))
    found = looked_up(rows, home, "class", rows.count()).select("doc_id", "version", F.col("n").alias("n_shingles"), "class", "group", "component_id")
    empty = survey.filter("class IS NULL").select("doc_id", "version", F.lit(0), F.lit(None).cast("binary"), F.lit(None).cast("binary"), "doc_id")
    members = found.union(empty.toDF(*found.columns))
    return members.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def without_near_duplicates(documents: DataFrame, words: int = WORDS, least: int = LEAST) -> DataFrame:
    """The documents, all their columns, of which one stays of each component.

    It is the one with the least doc_id (a null id comes last), then the least text hash; of
    repeated rows one stays. Documents without words all stay.
    """
    members = near_duplicates(documents, words, least)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("unknown"), "doc_id", "version")).alias("first")
    chosen = members.filter("n_shingles > 0").groupBy("group").agg(first).select("first.doc_id", "first.version")
    own = uuid.uuid4().hex  # no column of the documents has such a name
    names = {"doc_id": f"id_{own}", "version": f"of_{own}"}
    chosen = materialise(chosen.distinct()).withColumnsRenamed(names)
    words_in = F.coalesce("text", F.lit("")).rlike(r"[^ \t\n\x0B\f\r]")
    marked = documents.withColumn(f"text_{own}", F.xxhash64("text"))
    same: Column = F.col("doc_id").cast("long").eqNullSafe(F.col(f"id_{own}")) & (F.col(f"text_{own}") == F.col(f"of_{own}"))
    once = marked.filter(words_in).join(chosen, same, "left_semi").dropDuplicates(["doc_id", f"text_{own}"])
    return once.union(marked.filter(~words_in)).drop(f"text_{own}")
