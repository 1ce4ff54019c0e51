"""Helpers that several operators of this subpackage share."""

from __future__ import annotations

import os
from collections.abc import Iterable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dealerscope.sources.durable import materialise

__all__ = ["arrow_batch", "in_blocks", "kept_for", "materialise", "mix64", "read_table", "remainder", "shingle_hashes", "shingles_of_each", "texts_of", "word_hashes"]


def share_package(spark: SparkSession) -> None:
    """Lets Python workers import this package from where the driver has it, if they see that folder.

    On a cluster without a shared installation, pass the package with ``--py-files`` as usual.
    """
    root = str(Path(__file__).resolve().parents[2])
    known = spark.sparkContext.environment
    if root not in known.get("PYTHONPATH", "").split(os.pathsep):
        known["PYTHONPATH"] = os.pathsep.join(filter(None, (root, known.get("PYTHONPATH"))))


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    share_package(spark)
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


_KEPT: dict[str, dict] = {}


def kept_for(operator: str) -> dict:
    """What a Python worker keeps from task to task for one operator; what it kept for another one goes.

    Spark reuses workers, so without this a pipeline's workers would hold the caches of all its stages.
    """
    if operator not in _KEPT:
        _KEPT.clear()
        pa.default_memory_pool().release_unused()
    return _KEPT.setdefault(operator, {})


def remainder(key: str, parts: int) -> Column:
    """crc32 of the key as text, modulo ``parts``; null for a null key."""
    return F.crc32(F.col(key).cast("string").cast("binary")) % F.lit(parts)


def texts_of(batch: pa.RecordBatch, name: str = "text") -> list[str]:
    """The texts of a batch, null as empty."""
    return [text or "" for text in batch.column(name).to_pylist()]


def arrow_batch(schema: pa.Schema, *columns: object) -> pa.RecordBatch:
    arrays = [
        column if isinstance(column, pa.Array) else pa.array(column, type=field.type)
        for column, field in zip(columns, schema, strict=True)
    ]
    return pa.RecordBatch.from_arrays(arrays, schema=schema)


def in_blocks(texts: list[str], most: int = 1 << 20) -> Iterator[slice]:
    """Slices of whole texts that hold about ``most`` characters, or one longer text."""
    start = size = 0
    for i, text in enumerate(texts):
        if i > start and size + len(text) > most:
            yield slice(start, i)
            start, size = i, 0
        size += len(text)
    if texts:
        yield slice(start, len(texts))


_A, _B = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective mix of unsigned 64-bit integers."""
    x = (x ^ (x >> np.uint64(30))) * _A
    x = (x ^ (x >> np.uint64(27))) * _B
    return x ^ (x >> np.uint64(31))


# Space and the five control characters U+0009 to U+000D end a word; A-Z become a-z.
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BREAK = np.zeros(256, dtype=bool)
_BREAK[[32, *range(9, 14)]] = True
_PUNCTUATION = _BREAK.copy()
_PUNCTUATION[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = True
_POWERS = np.cumprod(np.full(1 << 16, 0x9E3779B97F4A7C15 | 1, dtype=np.uint64))
_MIXED = mix64(_POWERS)
_BLOCK = 1 << 17  # bytes of texts that are hashed together: their arrays stay in a core's cache


def word_hashes(texts: Iterable[str], plain: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of the texts, and at which word each text starts (one more for the end).

    A word is a run of characters other than ASCII white space, if ``plain`` also other than ASCII
    punctuation; its A-Z are lower-cased, if ``plain`` all its letters. The hash is
    a polynomial in the word's UTF-8 bytes, mixed with its length. The texts are taken in parts
    of at most about a megabyte that end at a space, so a long text needs no large arrays.
    """
    hashes: list[np.ndarray] = []
    counts: list[int] = [0]
    pending: list[bytes] = []
    size = 0

    def flush() -> None:
        nonlocal size
        if pending:
            found, per_text = _hash_block(pending, plain)
            hashes.append(found)
            counts.extend(per_text)
            pending.clear()
            size = 0

    for text in texts:
        raw = (text.lower() if plain else text).encode("utf-8", "surrogatepass")
        if len(raw) <= 1 << 20:
            if size + len(raw) > _BLOCK:
                flush()
            pending.append(raw)
            size += len(raw)
            continue
        flush()
        total = begin = 0
        while begin < len(raw):
            end = begin + (1 << 20)
            cut = max(raw.rfind(b" ", begin, end), raw.rfind(b"\n", begin, end)) if end < len(raw) else len(raw)
            if cut <= begin:  # a very long word: to its own end
                ends = [e for e in (raw.find(b" ", end), raw.find(b"\n", end)) if e >= 0]
                cut = min(ends) if ends else len(raw)
            found, (n,) = _hash_block([raw[begin:cut]], plain)
            hashes.append(found)
            total += n
            begin = cut + 1
        counts.append(total)
    flush()
    return (np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)), np.cumsum(counts)


def _hash_block(raws: list[bytes], plain: bool) -> tuple[np.ndarray, list[int]]:
    data = _LOWER[np.frombuffer(b" ".join(raws) + b" ", dtype=np.uint8)]
    gaps = (_PUNCTUATION if plain else _BREAK)[data]
    starts = np.flatnonzero(~gaps & np.concatenate(([True], gaps[:-1])))
    bounds = np.cumsum([0] + [len(raw) + 1 for raw in raws])
    per_text = np.diff(np.searchsorted(starts, bounds)).tolist()
    if not len(starts):
        return np.zeros(0, np.uint64), per_text
    ends = np.flatnonzero(gaps[1:] & ~gaps[:-1]) + 1
    lengths = ends - starts
    begin = np.cumsum(lengths) - lengths
    place = np.arange(int(lengths.sum())) - np.repeat(begin, lengths)
    high = place >> 16 if lengths.max() > 1 << 16 else None  # of words this long only
    values = _MIXED[place] if high is None else mix64(_POWERS[place & 0xFFFF] + high.astype(np.uint64))
    values *= data[~gaps].astype(np.uint64) + np.uint64(1)
    sums = np.add.reduceat(values, begin)
    return mix64(sums + lengths.astype(np.uint64) * _A), per_text


def shingle_hashes(words: np.ndarray, length: int = 5) -> np.ndarray:
    """Hashes of all runs of ``length`` words; of the whole sequence if it is shorter; none of no words."""
    n = min(length, len(words))
    if not n:
        return np.zeros(0, np.uint64)
    total = np.zeros(len(words) - n + 1, dtype=np.uint64)
    for i in range(n):
        total += mix64(words[i : len(words) - n + 1 + i] + mix64(np.array([i + 1], np.uint64)))
    return mix64(total + np.uint64(n))


def shingles_of_each(words: np.ndarray, starts: np.ndarray, length: int = 5) -> Iterator[np.ndarray]:
    """``shingle_hashes`` of each text of ``word_hashes``: one pass over all words, then slices."""
    every = shingle_hashes(words, length) if len(words) >= length else np.zeros(0, np.uint64)
    for a, b in zip(starts[:-1].tolist(), starts[1:].tolist()):
        yield every[a : b - length + 1] if b - a >= length else shingle_hashes(words[a:b], length)
