"""Language identification with hyperdimensional profiles.

Each letter has a random vector of +1 and -1. A letter trigram is the product of its letters'
vectors, rotated by their place; a text is the sum of its trigrams; a language is the sum of its
texts. A text gets the language whose profile has the largest cosine with it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache, partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from dealerscope.llm.common import arrow_batch, in_blocks, kept_for, mix64, texts_of

DIMENSIONS = 1024
_SCALE = float(1 << 20)  # profiles are summed as whole numbers, in any order alike
_BLOCK = 1 << 18  # characters whose trigrams are counted together
_KEPT = 16_384  # trigram vectors that a Python worker keeps


@dataclass(frozen=True)
class Profiles:
    """``vectors``: one row for each of ``languages``, of length 1."""

    languages: tuple[str, ...]
    vectors: np.ndarray


@cache
def _letters() -> np.ndarray:
    return np.fromiter(map(str.isalpha, map(chr, range(0x110000))), dtype=bool, count=0x110000)


def _letter_vectors(codes: np.ndarray) -> np.ndarray:
    """A vector of +1 and -1 for each code point, from the code point alone."""
    lanes = np.arange(DIMENSIONS // 64, dtype=np.uint64)
    words = mix64((codes.astype(np.uint64)[:, None] + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15) + mix64(lanes + np.uint64(7)))
    bits = np.unpackbits(words.astype("<u8").view(np.uint8).reshape(len(codes), -1), axis=1)
    return bits.astype(np.int8) * np.int8(2) - np.int8(1)


def _gram_vectors(grams: np.ndarray) -> np.ndarray:
    first, second, third = (_letter_vectors((grams >> np.uint64(s)) & np.uint64(0x1FFFFF)) for s in (42, 21, 0))
    return np.roll(first, 2, axis=1) * np.roll(second, 1, axis=1) * third


class _Table:
    """Vectors of the trigrams that a worker met first, a byte an entry; others are made when needed."""

    def __init__(self) -> None:
        self.grams = np.zeros(0, np.uint64)
        self.rows = np.zeros(0, np.int64)
        self.vectors = np.empty((_KEPT, DIMENSIONS), np.int8)

    def of(self, grams: np.ndarray) -> np.ndarray:
        """``grams`` sorted and distinct."""
        at = np.searchsorted(self.grams, grams)
        known = np.zeros(len(grams), dtype=bool)
        inside = at < len(self.grams)
        known[inside] = self.grams[at[inside]] == grams[inside]
        out = np.empty((len(grams), DIMENSIONS), np.float32)
        out[known] = self.vectors[self.rows[at[known]]]
        if not known.all():
            fresh = grams[~known]
            made = _gram_vectors(fresh)
            out[~known] = made
            room = _KEPT - len(self.grams)
            if room > 0:
                merged = np.concatenate((self.grams, fresh[:room]))
                rows = len(self.grams) + np.arange(len(fresh[:room]))
                self.vectors[rows] = made[:room]
                rows = np.concatenate((self.rows, rows))
                order = np.argsort(merged)
                self.grams, self.rows = merged[order], rows[order]
        return out


def _table() -> _Table:
    kept = kept_for("language")
    if "table" not in kept:
        kept["table"] = _Table()
    return kept["table"]


def _pieces(texts: list[str]) -> Iterator[list[tuple[int, str]]]:
    """(text number, text or part of it), in lists of about _BLOCK characters; parts end at white space."""
    held: list[tuple[int, str]] = []
    size = 0
    for number, text in enumerate(texts):
        begin = 0
        while begin < len(text) or not begin:
            end = begin + _BLOCK
            if end < len(text):
                cut = max(text.rfind(" ", begin, end), text.rfind("\n", begin, end))
                ends = [e for e in (text.find(" ", end), text.find("\n", end)) if e >= 0]
                end = cut if cut > begin else min(ends, default=len(text))
            part = text[begin:end]
            if held and size + len(part) > _BLOCK:
                yield held
                held, size = [], 0
            held.append((number, part))
            size += len(part)
            begin = end + 1
    if held:
        yield held


def _gram_counts(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, trigram, count) of lower-cased letters, words set off by one blank; sorted by text and trigram.

    A trigram has a letter in the middle, so it lies in one word and a text may be cut between words.
    """
    found = []
    for pieces in _pieces(texts):
        numbers, parts = zip(*pieces)
        owner, grams, counts = _counts_of(list(parts))
        found.append((np.array(numbers)[owner], grams, counts))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64)
    owner, grams, counts = map(np.concatenate, zip(*found))
    order = np.lexsort((grams, owner))
    owner, grams, counts = owner[order], grams[order], counts[order]
    first = np.flatnonzero(np.concatenate(([True], (owner[1:] != owner[:-1]) | (grams[1:] != grams[:-1])))) if len(owner) else order
    return owner[first], grams[first], np.add.reduceat(counts, first) if len(first) else counts


def _counts_of(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    padded = [f" {text.lower()} " for text in texts]
    codes = np.frombuffer("".join(padded).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    lengths = np.array([len(text) for text in padded])
    owner = np.repeat(np.arange(len(texts)), lengths)
    letter = _letters()[codes]
    codes = np.where(letter, codes, 0).astype(np.uint64)
    keep = letter | np.concatenate(([False], letter[:-1]))  # one blank of a run
    keep[np.cumsum(lengths) - lengths] = True
    codes, owner = codes[keep], owner[keep]
    grams = (codes[:-2] << np.uint64(42)) | (codes[1:-1] << np.uint64(21)) | codes[2:]
    inside = (owner[:-2] == owner[2:]) & (codes[1:-1] != 0)
    grams, owner = grams[inside], owner[inside.nonzero()[0] + 2]
    values, index = np.unique(grams, return_inverse=True)
    pair, count = np.unique(owner * max(1, len(values)) + index, return_counts=True)
    return pair // max(1, len(values)), values[pair % max(1, len(values))], count


def _weights(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """As _gram_counts, the counts of a text scaled to length 1: long texts weigh as short ones."""
    owner, grams, counts = _gram_counts(texts)
    length = np.sqrt(np.bincount(owner, weights=counts.astype(float) ** 2, minlength=len(texts)))
    return owner, grams, counts / length[owner]


def _learn(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """One vector for each language and task: the sum over its texts."""
    sums: dict[str, np.ndarray] = {}
    for batch in batches:
        texts, langs = texts_of(batch), batch.column("lang").to_pylist()
        for part in in_blocks(texts):
            owner, grams, weights = _weights(texts[part])
            names = np.array(langs[part], dtype=object)
            for lang in sorted(set(names)):
                mine = (names == lang)[owner]
                values, index = np.unique(grams[mine], return_inverse=True)
                total = np.rint(np.bincount(index, weights=weights[mine], minlength=len(values)) * _SCALE)
                vector = np.zeros(DIMENSIONS)
                for i in range(0, len(values), 4096):
                    vector += total[i : i + 4096] @ _table().of(values[i : i + 4096])
                sums[lang] = sums.get(lang, 0) + np.rint(vector).astype(np.int64)
    yield arrow_batch(schema, list(sums), [v.tolist() for v in sums.values()])


def learn_profiles(documents: DataFrame, train: Column) -> Profiles:
    """Profiles of the languages named in ``lang``, from the rows where ``train`` holds.

    Each task sums its texts for each language, Spark adds these sums. Only languages times
    DIMENSIONS numbers reach the driver; the number of languages is the bound. Rows without
    text, letters or language teach nothing; without any such row there is no profile.
    """
    rows = documents.filter(train).select("text", "lang").filter("text IS NOT NULL AND lang IS NOT NULL")
    schema = pa.schema([("lang", pa.string()), ("vector", pa.list_(pa.int64()))])
    parts = rows.mapInArrow(partial(_learn, schema=schema), "lang string, vector array<long>")
    sums = parts.select("lang", F.posexplode("vector").alias("at", "value")).groupBy("lang", "at").agg(F.sum("value").alias("value"))
    cells = sums.groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("at", "value"))).alias("cells")).orderBy("lang").collect()
    found = [(r["lang"], np.array([c["value"] for c in r["cells"]], dtype=float)) for r in cells]
    found = [(lang, vector / np.linalg.norm(vector)) for lang, vector in found if vector.any()]
    vectors = np.array([v for _, v in found], dtype=np.float32).reshape(-1, DIMENSIONS)
    return Profiles(tuple(lang for lang, _ in found), vectors)


def _cosines(texts: list[str], profiles: Profiles) -> np.ndarray:
    """A row for each text; NaN where it has no letter."""
    owner, grams, weights = _weights(texts)
    out = np.full((len(texts), len(profiles.languages)), np.nan)
    starts = np.searchsorted(owner, np.arange(len(texts) + 1))
    for first in range(0, len(texts), 64):
        last = min(first + 64, len(texts))
        rows = slice(starts[first], starts[last])
        values, index = np.unique(grams[rows], return_inverse=True)
        vector = np.zeros((last - first, DIMENSIONS), np.float32)
        for i in range(0, len(values), 4096):
            here = (index >= i) & (index < i + 4096)
            size = min(4096, len(values) - i)
            cells = (owner[rows][here] - first) * size + index[here] - i
            counts = np.bincount(cells, weights=weights[rows][here], minlength=(last - first) * size)
            vector += counts.reshape(last - first, size).astype(np.float32) @ _table().of(values[i : i + 4096])
        length = np.linalg.norm(vector, axis=1, keepdims=True)
        with np.errstate(invalid="ignore", divide="ignore"):
            out[first:last] = (vector @ profiles.vectors.T) / length
    return out


def _predict(batches: Iterator[pa.RecordBatch], profiles: Profiles, names: list[str], into: tuple[str, str]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = texts_of(batch)
        langs: list[str] = []
        scores: list[float] = []
        for part in in_blocks(texts):
            cosines = _cosines(texts[part], profiles) if profiles.languages else np.full((part.stop - part.start, 1), np.nan)
            filled = np.where(np.isnan(cosines), -2, cosines)
            best, known = filled.argmax(axis=1), filled.max(axis=1) > -2
            langs += [profiles.languages[b] if k else "und" for b, k in zip(best, known)]
            scores += np.where(known, np.clip(filled.max(axis=1), 0, 1), 0.0).round(6).tolist()
        kept = [batch.column(name) for name in names]
        yield pa.RecordBatch.from_arrays(
            [*kept, pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=[*names, *into]
        )


def predict_language(
    documents: DataFrame, profiles: Profiles, columns: list[str] | None = None, into: tuple[str, str] = ("lang_pred", "score")
) -> DataFrame:
    """Every row with ``columns`` (all by default), and the prediction and its score in two columns named ``into``.

    Columns of those two names are replaced. The score is the cosine with the language's profile, 0
    where it is negative. A text that is null or has no letter, and any text if no language was
    learned, gets ``und`` and 0. Ties go to the first language by name. Repeated rows are scored
    each; the whole text is read.
    """
    names = documents.columns if columns is None else columns
    names = [name for name in names if name not in into]
    frame = documents.select(*(F.col(f"`{name}`") for name in dict.fromkeys([*names, "text"])))
    schema = StructType([frame.schema[name] for name in names])
    schema = schema.add(into[0], "string").add(into[1], "double")
    return frame.mapInArrow(partial(_predict, profiles=profiles, names=names, into=into), schema)
