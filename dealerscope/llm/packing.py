"""Packing of token sequences with minimum bin slack.

A document of more than a window is cut into full windows and a rest. What matters of the rests is
how many there are of each length, at most ``WINDOW - 1`` numbers. They are packed on the driver:
a bitset of reachable sums finds the lengths that fill a window beside the longest rest, and the
pattern is used as often as the counts allow. What no pattern fills is laid end to end, as one
number for each length. Spark numbers the rests of each length and computes the place of each
number, so the plan grows with the lengths and not with the rows.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass, field
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from dealerscope.llm.common import arrow_batch, materialise, texts_of
from dealerscope.llm.tokens import END_ID, encoder

WINDOW = 4096
_GROUP = 100_000  # rests of one length that a task numbers, about

_CUT = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("full", pa.list_(pa.int64())), ("rest", pa.int32()), ("ids", pa.large_binary())])
_PIECE = pa.schema(
    [("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()),
     ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())]
)
_PIECE_DDL = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def best_fill(counts: Mapping[int, int], lengths: Sequence[int], room: int, used: int = 0) -> dict[int, int]:
    """How many of each length come closest to ``room`` without passing it.

    ``lengths`` are the keys of ``counts`` in ascending order; one rest of length ``used`` is spoken for.
    ``reach`` has a bit for each sum; a length's count goes in as powers of two, longest first,
    until the room is filled exactly. The choice is read back from the bitsets before each step.
    """
    reach, full = 1, (1 << (room + 1)) - 1
    steps: list[tuple[int, int, int]] = []
    for i in range(bisect_right(lengths, room) - 1, -1, -1):
        length = lengths[i]
        left, take = min(counts[length] - (length == used), room // length), 1
        while left:
            take = min(take, left)
            steps.append((length, take, reach))
            reach |= (reach << (length * take)) & full
            left -= take
            take *= 2
        if reach >> room & 1:
            break
    at = reach.bit_length() - 1
    chosen: dict[int, int] = {}
    for length, take, before in reversed(steps):
        if not before >> at & 1:
            chosen[length] = chosen.get(length, 0) + take
            at -= length * take
    return chosen


@dataclass
class Plan:
    """Places of numbered rests: patterns, and a tail of rests end to end.

    A pattern has rests of ``length`` from number ``first`` on, ``each`` to a sequence, from
    ``sequence`` and ``offset`` on. ``tail`` gives the rests of a length from number ``first`` on,
    the first of them ``base`` tokens after the start of sequence ``tail_at``; they are cut where
    a sequence ends.
    """

    window: int = WINDOW
    sequences: int = 0
    patterns: list[tuple[int, int, int, int, int]] = field(default_factory=list)  # length, first, each, sequence, offset
    tail: dict[int, tuple[int, int, int]] = field(default_factory=dict)  # length: first, base, how many
    tail_at: int = 0

    def arrays(self) -> tuple[np.ndarray, np.ndarray]:
        """The patterns in order, and (first, base) of the tail by length; without a tail ``first`` is beyond all numbers."""
        ends = np.array([[1 << 47, 0]] * self.window, dtype=np.int64)
        for length, (first, base, _) in self.tail.items():
            ends[length] = first, base
        return np.array(sorted(self.patterns), dtype=np.int64).reshape(-1, 5), ends

    @property
    def rows(self) -> list[tuple[int, ...]]:
        """All places spelled out, a rest of the tail each: length, first, each, sequence, offset, start, size."""
        out = [(*pattern, 0, pattern[0]) for pattern in self.patterns]
        for length, (first, base, many) in self.tail.items():
            for i in range(many):
                out += [(length, first + i, 1, self.tail_at + s, *place) for s, *place in _parts(base + i * length, length, self.window)]
        return out


def _parts(at: int, length: int, window: int) -> list[tuple[int, int, int, int]]:
    """(sequence, offset, start, size) of a rest that starts ``at`` tokens after the tail's start."""
    sequence, offset = divmod(at, window)
    size = min(length, window - offset)
    parts = [(sequence, offset, 0, size)]
    return parts if size == length else [*parts, (sequence + 1, 0, size, length - size)]


def pack_lengths(histogram: Mapping[int, int], window: int = WINDOW) -> Plan:
    """Sequences for rests of the given counts by length, each under ``window``.

    The longest rest left opens a pattern. A length that no choice of the others fills any more
    goes to the tail, whose rests are laid end to end; so only the last sequence has padding.
    """
    left = {a: c for a, c in histogram.items() if a > 0 and c > 0}
    lengths, number = sorted(left), dict.fromkeys(left, 0)
    plan = Plan(window)
    base = 0
    while lengths:
        longest = lengths[-1]
        chosen = best_fill(left, lengths, window - longest, longest)
        chosen[longest] = chosen.get(longest, 0) + 1
        if sum(a * m for a, m in chosen.items()) < window:
            plan.tail[longest] = number[longest], base, left[longest]
            base += longest * left.pop(longest)
            lengths.pop()
            continue
        repeats = min(left[a] // m for a, m in chosen.items())
        place = 0
        for length in sorted(chosen, reverse=True):
            plan.patterns.append((length, number[length], chosen[length], plan.sequences, place))
            place += length * chosen[length]
            number[length] += chosen[length] * repeats
            left[length] -= chosen[length] * repeats
            if not left[length]:
                del left[length]
                del lengths[bisect_right(lengths, length) - 1]
        plan.sequences += repeats
    plan.tail_at = plan.sequences
    plan.sequences += -(-base // window)
    return plan


def _cut(batches: Iterator[pa.RecordBatch], tokenizer: str, window: int) -> Iterator[pa.RecordBatch]:
    end = np.uint32(END_ID).tobytes()
    for batch in batches:
        rows, size = [], 0
        for doc_id, text in zip(batch.column("doc_id").to_pylist(), texts_of(batch)):
            ids = encoder(tokenizer).encode(text) + end
            n = len(ids) // 4
            cut = n // window * window * 4
            full = [zlib.crc32(ids[i : i + 4 * window]) for i in range(0, cut, 4 * window)]
            rest = np.frombuffer(ids[cut:], "<u4")
            narrow = rest.max(initial=0) < 1 << 16
            rows.append((doc_id, n, full, len(rest), rest.astype("<u2" if narrow else "<u4").tobytes()))
            size += len(ids)
            if size > 1 << 24:
                yield arrow_batch(_CUT, *map(list, zip(*rows)))
                rows, size = [], 0
        if rows:
            yield arrow_batch(_CUT, *map(list, zip(*rows)))


def _place(
    batches: Iterator[pa.RecordBatch], patterns: np.ndarray, tail: np.ndarray, tail_at: int, before: np.ndarray, first_full: int, window: int
) -> Iterator[pa.RecordBatch]:
    keys = patterns[:, 0] << 48 | patterns[:, 1]
    places, ends = patterns.tolist(), tail.tolist()
    for batch in batches:
        names = ("doc_id", "n", "full", "rest", "ids", "rank", "fulls")
        rows: list[tuple] = []
        for doc_id, n, full, rest, ids, rank, fulls in zip(*(batch.column(name).to_pylist() for name in names)):
            sequence = first_full + int(before[rest]) + fulls
            for i, crc in enumerate(full):
                rows.append((doc_id, i * window, window, crc, n, sequence + i, 0))
            if not rest:
                continue
            wide = np.frombuffer(ids, "<u2" if len(ids) == 2 * rest else "<u4").astype("<u4").tobytes()
            first, at = ends[rest]
            if rank >= first:
                parts = [(tail_at + s, *place) for s, *place in _parts(at + (rank - first) * rest, rest, window)]
            else:
                _, first, each, sequence, offset = places[int(np.searchsorted(keys, rest << 48 | rank, side="right")) - 1]
                more, slot = divmod(rank - first, each)
                parts = [(sequence + more, offset + slot * rest, 0, rest)]
            for sequence, offset, start, size in parts:
                crc = zlib.crc32(wide[4 * start : 4 * (start + size)])
                rows.append((doc_id, n - rest + start, size, crc, n, sequence, offset))
        yield arrow_batch(_PIECE, *(map(list, zip(*rows)) if rows else [[]] * 7))


def pack_documents(documents: DataFrame, tokenizer: str, window: int = WINDOW) -> DataFrame:
    """Every piece as (doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset).

    All whole texts are encoded once (null text: empty) and end with END_ID. The rests are
    numbered by length: a length's rows are dealt to groups by a hash, numbered inside a group and
    moved on by the rows of the groups before, so a frequent length is spread over many tasks. At
    most ``window`` rows of counts reach the driver, and the plan that goes to the tasks does not grow
    with them. Repeated ids are separate documents, null ids
    are kept; an empty table has no pieces. Sequences 0 to p - 1 hold rests, the later ones a full
    window each.
    """
    frame = documents.select(F.col("doc_id").cast("long"), "text")
    schema = "doc_id long, n long, full array<long>, rest int, ids binary"
    cut = materialise(frame.mapInArrow(partial(_cut, tokenizer=tokenizer, window=window), schema), compression="zstd")
    counts = cut.groupBy("rest").agg(F.count(F.lit(1)).alias("docs"), F.sum(F.size("full")).alias("fulls")).orderBy("rest").collect()
    plan = pack_lengths({r["rest"]: r["docs"] for r in counts if r["rest"]}, window)
    before = np.zeros(window + 1, np.int64)
    for r in counts:
        before[r["rest"] + 1 :] += r["fulls"]
    groups = 1 + max((r["docs"] for r in counts), default=0) // _GROUP * 4
    dealt = cut.withColumn("dealt", F.pmod(F.xxhash64("doc_id", "n", F.crc32("ids")), F.lit(groups)).cast("int"))
    sums = dealt.groupBy("rest", "dealt").agg(F.count(F.lit(1)).alias("docs"), F.sum(F.size("full")).alias("fulls"))
    ahead = Window.partitionBy("rest").orderBy("dealt").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(
        "rest", "dealt", F.coalesce(F.sum("docs").over(ahead), F.lit(0)).alias("docs_ahead"),
        F.coalesce(F.sum("fulls").over(ahead), F.lit(0)).alias("fulls_ahead"),
    )
    inner = Window.partitionBy("rest", "dealt").orderBy("doc_id", "n", F.crc32("ids"))
    so_far = inner.rowsBetween(Window.unboundedPreceding, -1)
    ranked = dealt.withColumn("inner", F.row_number().over(inner) - 1)
    ranked = ranked.withColumn("inner_fulls", F.coalesce(F.sum(F.size("full")).over(so_far), F.lit(0)))
    ranked = ranked.join(sums, ["rest", "dealt"]).select(
        "doc_id", "n", "full", "rest", "ids", (F.col("inner") + F.col("docs_ahead")).alias("rank"),
        (F.col("inner_fulls") + F.col("fulls_ahead")).alias("fulls"),
    )
    patterns, tail = plan.arrays()
    placing = partial(
        _place, patterns=patterns, tail=tail, tail_at=plan.tail_at, before=before, first_full=plan.sequences, window=window
    )
    return ranked.mapInArrow(placing, _PIECE_DDL)
