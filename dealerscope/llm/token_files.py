"""Token ids of a corpus in Huffman-coded files, in ascending doc_id order.

``path/codes`` holds the code length of each id; the codes are canonical, so the lengths say all.
``path/blocks`` holds independent blocks (bucket, block, inside, n_tokens, doc_ids, counts,
starts, payload, offsets): the ids of the bucket before it and its own, the
documents of a block in order, their numbers of ids, the code bits of each from a byte boundary,
and the bit where every CHECKPOINT-th id of each document starts. Blocks are in order of bucket
and number. A reader needs the code lengths and any one block.
``starts`` has the byte of the payload where each document begins.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import cache, partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from dealerscope.llm.common import arrow_batch, in_blocks, materialise, texts_of
from dealerscope.llm.tokens import END_ID, encoder

LONGEST_CODE = 16
CHECKPOINT = 256  # ids between two bit offsets
BLOCK_IDS = 1 << 16  # a block ends with the document that reaches this
_AT_ONCE = 1 << 20  # ids coded or decoded together
_TEXTS_AT_ONCE = 1 << 24  # characters of texts tokenised together

_IDS = pa.schema([("doc_id", pa.int64()), ("ids", pa.large_binary())])
_CODED = pa.schema([("bucket", pa.int32()), ("doc_id", pa.int64()), ("n", pa.int64()), ("payload", pa.large_binary()), ("offsets", pa.large_binary())])
_BLOCK = pa.schema(
    [("bucket", pa.int32()), ("block", pa.int64()), ("inside", pa.int64()), ("n_tokens", pa.int64()), ("doc_ids", pa.list_(pa.int64())),
     ("counts", pa.list_(pa.int64())), ("starts", pa.list_(pa.int64())), ("payload", pa.large_binary()), ("offsets", pa.large_binary())]
)


def _tokenise(batches: Iterator[pa.RecordBatch], tokenizer: str) -> Iterator[pa.RecordBatch]:
    end = np.uint32(END_ID).tobytes()
    for batch in batches:
        ids, texts = batch.column("doc_id"), texts_of(batch)
        for part in in_blocks(texts, _TEXTS_AT_ONCE):
            out = [_narrow(found + end) for found in encoder(tokenizer).encode_each(texts[part])]
            yield arrow_batch(_IDS, ids[part.start : part.stop], out)


def _narrow(ids: bytes) -> bytes:
    """Two bytes for each id if all fit, marked by an odd length."""
    wide = np.frombuffer(ids, "<u4")
    return b"\0" + wide.astype("<u2").tobytes() if wide.max(initial=0) < 1 << 16 else ids


def _wide(ids: bytes) -> np.ndarray:
    return np.frombuffer(ids, "<u2", offset=1) if len(ids) % 2 else np.frombuffer(ids, "<u4")


def token_ids(documents: DataFrame, tokenizer: str) -> DataFrame:
    """(doc_id, ids) of every whole text; null text is empty; each ends with END_ID."""
    frame = documents.select(F.col("doc_id").cast("long"), "text")
    return frame.mapInArrow(partial(_tokenise, tokenizer=tokenizer), "doc_id long, ids binary")


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(1, np.int64)
    for batch in batches:
        for docs in _together([_wide(ids) for ids in batch.column("ids").to_pylist()]):
            found = np.bincount(np.concatenate(docs))
            if len(found) > len(total):
                total = np.concatenate((total, np.zeros(len(found) - len(total), np.int64)))
            total[: len(found)] += found
    used = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], names=["id", "count"])


def _together(docs: list[np.ndarray]) -> Iterator[list[np.ndarray]]:
    """Lists of documents of at most _AT_ONCE ids, or of one longer document."""
    first = 0
    while first < len(docs):
        last, size = first, 0
        while last < len(docs) and (last == first or size + len(docs[last]) <= _AT_ONCE):
            size += len(docs[last])
            last += 1
        yield docs[first:last]
        first = last


def code_lengths(counts: np.ndarray, longest: int = LONGEST_CODE) -> np.ndarray:
    """Lengths of an optimal prefix code for positive counts, none above ``longest``.

    Package-merge: a list for each bit, of the symbols and the pairs of the list before. The
    2n - 2 cheapest items of the last list are taken, then the items that their pairs hold, and
    so on; a symbol is as long as the number of lists in which it was taken. More symbols than
    codes of that length make the limit grow.
    """
    n = len(counts)
    if n < 2:
        return np.ones(n, np.int64)
    longest = max(longest, int(np.ceil(np.log2(n))))
    order = np.argsort(counts, kind="stable")
    symbols = counts[order].astype(np.int64)
    lists, pairs = [], np.zeros(0, np.int64)
    for _ in range(longest):
        merged = np.concatenate((symbols, pairs))
        rank = np.argsort(merged, kind="stable")
        lists.append(rank < n)
        merged = merged[rank]
        even = len(merged) // 2 * 2
        pairs = merged[:even:2] + merged[1:even:2]
    lengths, taken = np.zeros(n, np.int64), 2 * n - 2
    for is_symbol in reversed(lists):
        direct = int(is_symbol[:taken].sum())
        lengths[:direct] += 1
        taken = 2 * (taken - direct)
    out = np.empty(n, np.int64)
    out[order] = lengths
    return out


class Code:
    """Canonical codes: by length, then by id, counting up."""

    def __init__(self, ids: np.ndarray, lengths: np.ndarray):
        order = np.lexsort((ids, lengths))
        self.ids, self.sorted = ids[order], lengths[order]
        self.longest = int(self.sorted[-1]) if len(order) else 1
        steps = np.int64(1) << (self.longest - self.sorted)
        firsts = np.cumsum(steps) - steps  # codes, filled up to the longest length
        size = int(ids.max(initial=0)) + 1
        self.length, self.code = np.zeros(size, np.int64), np.zeros(size, np.uint64)
        self.length[self.ids] = self.sorted
        self.code[self.ids] = (firsts >> (self.longest - self.sorted)).astype(np.uint64)
        self.steps = steps

    @property
    def table(self) -> tuple[np.ndarray, np.ndarray]:
        """For each value of the next ``longest`` bits the id and the length of its code."""
        if not hasattr(self, "_table"):
            fill = (1 << self.longest) - int(self.steps.sum())
            ids = np.concatenate((np.repeat(self.ids, self.steps), np.zeros(fill, np.int64)))
            self._table = ids.astype(np.uint32), np.concatenate((np.repeat(self.sorted, self.steps), np.ones(fill, np.int64)))
        return self._table

    def encode(self, docs: list[np.ndarray]) -> list[tuple[bytes, bytes]]:
        """Bits of each document from a byte boundary, and the bit of every CHECKPOINT-th id."""
        counts = np.array([len(d) for d in docs])
        ids = np.concatenate(docs).astype(np.int64)
        lengths = self.length[ids]
        ends = np.cumsum(lengths)
        last = np.cumsum(counts)
        first = last - counts
        bits = ends[last - 1] - (ends[first] - lengths[first])
        sizes = (bits + 7) >> 3
        starts = np.cumsum(sizes) - sizes
        inside = ends - lengths - np.repeat(ends[first] - lengths[first], counts)
        at = inside + np.repeat(starts * 8, counts)
        word, shift = at >> 6, 64 - (at & 63) - lengths
        code = self.code[ids]
        over = np.flatnonzero(shift < 0)
        head = np.where(shift < 0, code >> np.maximum(-shift, 0).astype(np.uint64), code << np.maximum(shift, 0).astype(np.uint64))
        words = np.zeros((int(sizes.sum()) >> 3) + 2, np.uint64)
        new = np.flatnonzero(np.concatenate(([True], word[1:] != word[:-1])))
        words[word[new]] = np.bitwise_or.reduceat(head, new)
        words[word[over] + 1] |= code[over] << (64 + shift[over]).astype(np.uint64)  # one crossing for each word at most
        data = words.astype(">u8").tobytes()
        marks = inside.astype("<u4") if bits.max() < 1 << 32 else inside.astype("<u8")
        return [
            (data[s : s + z], marks[f:e:CHECKPOINT].tobytes())
            for s, z, f, e in zip(starts.tolist(), sizes.tolist(), first.tolist(), last.tolist())
        ]

    def decode(self, payload: np.ndarray, starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """The ids of runs of bits, laid end to end: all runs step on together by table look-up."""
        symbols, lengths = self.table
        data = np.concatenate((payload, np.zeros(8, np.uint8))).astype(np.uint32)
        ahead_of = (data[:-3] << 24) | (data[1:-2] << 16) | (data[2:-1] << 8) | data[3:]  # the 32 bits from each byte on
        out = np.empty(int(counts.sum()), np.uint32)
        place = np.cumsum(counts) - counts
        order = np.argsort(-counts, kind="stable")
        at, place, counts = starts[order].astype(np.int64), place[order], counts[order]
        room = 32 - self.longest
        for step in range(int(counts[0]) if len(counts) else 0):
            live = int(np.searchsorted(-counts, -step, side="left"))
            bit = at[:live]
            ahead = (ahead_of[bit >> 3] << (bit & 7).astype(np.uint32)) >> np.uint32(room)
            out[place[:live] + step] = symbols[ahead]
            at[:live] += lengths[ahead]
        return out


@cache
def _code(ids: bytes, lengths: bytes) -> Code:
    return Code(np.frombuffer(ids, np.int64), np.frombuffer(lengths, np.int64))


def _encode(batches: Iterator[pa.RecordBatch], code: tuple[bytes, bytes]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        buckets, doc_ids = batch.column("bucket"), batch.column("doc_id")
        docs = [_wide(ids) for ids in batch.column("ids").to_pylist()]
        first = 0
        for some in _together(docs):
            last = first + len(some)
            coded = _code(*code).encode(some)
            counts = [len(d) for d in some]
            yield arrow_batch(_CODED, buckets[first:last], doc_ids[first:last], counts, [c[0] for c in coded], [c[1] for c in coded])
            first = last


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted documents of some buckets as blocks; a block lies in one bucket."""
    rows: list[tuple] = []
    size = number = inside = 0

    def closed() -> pa.RecordBatch:
        ends = np.cumsum([len(r[3]) for r in rows])
        starts = [0, *ends[:-1].tolist()]
        return arrow_batch(
            _BLOCK, [rows[0][0]], [number], [inside], [size], [[r[1] for r in rows]], [[r[2] for r in rows]], [starts],
            [b"".join(r[3] for r in rows)], [b"".join(r[4] for r in rows)],
        )

    for batch in batches:
        for row in zip(*(batch.column(i).to_pylist() for i in range(5))):
            if rows and (row[0] != rows[0][0] or size >= BLOCK_IDS):
                yield closed()
                same = row[0] == rows[0][0]
                number, inside = (number + 1, inside + size) if same else (0, 0)
                rows, size = [], 0
            rows.append(row)
            size += row[2]
    if rows:
        yield closed()


def write_token_files(documents: DataFrame, path: str, tokenizer: str, buckets: int | None = None) -> None:
    """Tokenise, count, and write the files to ``path``.

    The ids are written once unsorted; their counts (one for each id of the vocabulary) make the
    code on the driver. Documents are coded where they are, and only the code bits are shuffled:
    to ``buckets`` ranges of doc_id between quantiles, sorted there and cut into blocks. Repeated
    ids keep a document each, a null id comes first, no rows make empty files.
    """
    spark = documents.sparkSession
    ids = materialise(token_ids(documents, tokenizer), compression="zstd")
    counts = ids.select("ids").mapInArrow(_count, "id long, count long").groupBy("id").agg(F.sum("count").alias("count"))
    found = counts.orderBy("id").collect()
    symbols = np.array([r["id"] for r in found], dtype=np.int64)
    lengths = code_lengths(np.array([r["count"] for r in found], dtype=np.int64))
    spark.createDataFrame(list(zip(symbols.tolist(), lengths.tolist())), "id long, length long").coalesce(1).write.parquet(f"{path}/codes")
    if buckets is None:
        buckets = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    bounds = ids.approxQuantile("doc_id", [i / buckets for i in range(1, buckets)], 0.25 / buckets) if found else []
    bucket = F.size(F.filter(F.array(*map(F.lit, sorted(set(bounds)))), lambda b: b <= F.col("doc_id"))) if bounds else F.lit(0)
    bucketed = ids.select(F.coalesce(F.when(F.col("doc_id").isNotNull(), bucket), F.lit(0)).alias("bucket"), "doc_id", "ids")
    schema = "bucket int, doc_id long, n long, payload binary, offsets binary"
    coded = bucketed.mapInArrow(partial(_encode, code=(symbols.tobytes(), lengths.tobytes())), schema)
    ordered = coded.repartition(F.col("bucket")).sortWithinPartitions("bucket", "doc_id", "n", F.crc32("payload"))
    schema = "bucket int, block long, inside long, n_tokens long, doc_ids array<long>, counts array<long>, starts array<long>, payload binary, offsets binary"
    ordered.mapInArrow(_blocks, schema).write.option("compression", "none").parquet(f"{path}/blocks")


def _decode(batches: Iterator[pa.RecordBatch], code: tuple[bytes, bytes], digest: bool) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = batch.to_pylist()
        first = 0
        while first < len(rows):
            last, size = first, 0
            while last < len(rows) and (last == first or size + rows[last]["n_tokens"] <= _AT_ONCE):
                size += rows[last]["n_tokens"]
                last += 1
            yield _decoded(rows[first:last], _code(*code), digest)
            first = last


def _decoded(rows: list[dict], code: Code, digest: bool) -> pa.RecordBatch:
    payload = np.frombuffer(b"".join(r["payload"] for r in rows), np.uint8)
    doc_ids = [d for r in rows for d in r["doc_ids"]]
    counts = np.array([c for r in rows for c in r["counts"]])
    before = np.concatenate([r["start"] + np.cumsum(r["counts"]) - r["counts"] for r in rows])
    runs = -(-counts // CHECKPOINT)
    marks = []
    for r in rows:
        n = sum(-(-c // CHECKPOINT) for c in r["counts"])
        marks.append(np.frombuffer(r["offsets"], "<u8" if len(r["offsets"]) == 8 * n else "<u4").astype(np.int64))
    in_run = np.full(int(runs.sum()), CHECKPOINT)
    in_run[np.cumsum(runs) - 1] = counts - (runs - 1) * CHECKPOINT
    sizes = np.cumsum([len(r["payload"]) for r in rows])
    base = np.concatenate([s + np.array(r["starts"]) for s, r in zip([0, *sizes[:-1]], rows)])
    ids = code.decode(payload, np.repeat(base * 8, runs) + np.concatenate(marks), in_run)
    cuts = np.cumsum(counts)
    docs = [ids[a:b] for a, b in zip((cuts - counts).tolist(), cuts.tolist())]
    last = pa.array([zlib.crc32(d.tobytes()) for d in docs] if digest else [d.astype(np.int64) for d in docs])
    names = ["doc_id", "start", "n_tokens", "ids_crc32" if digest else "ids"]
    return pa.RecordBatch.from_arrays([pa.array(doc_ids, pa.int64()), pa.array(before), pa.array(counts), last], names=names)


def read_token_files(spark: SparkSession, path: str, digest: bool = False) -> DataFrame:
    """(doc_id, start, n_tokens, ids) of every document in the files, decoded block by block.

    ``start`` counts the ids before the document: the sums of the buckets before (as many rows as
    the writer's setting), of the bucket's blocks before, and of the block's documents.
    With ``digest`` the ids' crc32, as little-endian unsigned 32-bit integers, stands for them.
    """
    blocks = spark.read.parquet(f"{path}/blocks")
    totals = blocks.groupBy("bucket").agg(F.sum("n_tokens").alias("total"))
    in_order = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select("bucket", F.coalesce(F.sum("total").over(in_order), F.lit(0)).alias("ahead"))
    placed = blocks.join(F.broadcast(totals), "bucket").withColumn("start", F.col("ahead") + F.col("inside"))
    codes = spark.read.parquet(f"{path}/codes").orderBy("id").collect()
    code = (np.array([r["id"] for r in codes], np.int64).tobytes(), np.array([r["length"] for r in codes], np.int64).tobytes())
    last = "ids_crc32 long" if digest else "ids array<long>"
    return placed.mapInArrow(partial(_decode, code=code, digest=digest), f"doc_id long, start long, n_tokens long, {last}")
