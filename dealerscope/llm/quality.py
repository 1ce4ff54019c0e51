"""Document quality by attention-based multiple-instance learning.

A document is a bag of passages. Each passage is encoded, gated attention weights the encodings,
and the weighted sum is scored; only the document's label is known. The model learns on the driver
from a bounded sample of labelled documents, in numpy; scoring runs where the texts are.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache, partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dealerscope.llm.common import in_blocks, texts_of, word_hashes

SAMPLE = 4096  # labelled documents that the model learns from
PASSAGE = 64  # words of a passage; more in a text of over PASSAGES passages
PASSAGES = 64
_ENCODED, _ATTENTION = 32, 16
_EPOCHS, _BATCH, _RATE, _DECAY = 30, 64, 0.005, 1e-4

# Kinds of characters: small, capital and other letters, digits, blanks, newlines, ends of
# sentences, commas and the like, other ASCII marks, anything else.
_KINDS = 10
_WIDTH = _KINDS * _KINDS + 7


@cache
def _kinds() -> np.ndarray:
    out = np.full(0x110000, 9, np.int8)
    for code in range(0x110000):
        c = chr(code)
        if c.isalpha():
            out[code] = 0 if c.islower() else 1 if c.isupper() else 2
        elif c.isdigit():
            out[code] = 3
    for kind, chars in ((4, " \t\r\v\f"), (5, "\n"), (6, ".!?"), (7, ",;:"), (8, "\"#$%&'()*+-/<=>@[\\]^_`{|}~")):
        for c in chars:
            out[ord(c)] = kind
    return out


def _passages(texts: list[str], most: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """A row of features for each passage, and the document it is of. A text without words is one empty passage.

    Passages are PASSAGE words long; with ``most``, longer in a text that would have more of them.
    Shares of pairs of neighbouring kinds of characters; how many words differ, repeat the one
    before, are long; their mean length and its spread; the number of words; 1 for an empty passage.
    """
    hashes, starts = word_hashes(texts)
    words = np.diff(starts)
    size = np.full(len(words), PASSAGE) if most is None else np.maximum(PASSAGE, -(-words // most))
    many = np.maximum(1, -(-words // size))
    base = np.cumsum(many) - many
    owner = np.repeat(np.arange(len(texts)), many)
    total = int(many.sum())
    doc_of_word = np.repeat(np.arange(len(texts)), words)
    of_word = base[doc_of_word] + (np.arange(len(hashes)) - starts[doc_of_word]) // size[doc_of_word]
    count = np.bincount(of_word, minlength=total).astype(float)

    codes = np.frombuffer("".join(f"{t}\n" for t in texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    lengths = np.array([len(t) + 1 for t in texts])
    blank = (codes == 32) | ((codes >= 9) & (codes <= 13))
    begins = np.flatnonzero(~blank & np.concatenate(([True], blank[:-1])))
    ends = np.flatnonzero(blank[1:] & ~blank[:-1]) + 1
    # a character belongs to the passage of the word at or before it, or of its text's first
    doc_of_char = np.repeat(np.arange(len(texts)), lengths)
    word_of_char = np.cumsum(np.bincount(begins, minlength=len(codes))) - 1
    own = np.zeros(len(codes), dtype=bool)
    own[word_of_char >= 0] = doc_of_word[word_of_char[word_of_char >= 0]] == doc_of_char[word_of_char >= 0]
    of_char = base[doc_of_char]
    of_char[own] = of_word[word_of_char[own]]
    kind = _kinds()[codes]
    same = of_char[1:] == of_char[:-1]
    cell = of_char[:-1] * _KINDS**2 + kind[:-1] * _KINDS + kind[1:]
    pairs = np.bincount(cell[same], minlength=total * _KINDS**2).reshape(total, -1).astype(float)
    pairs /= np.maximum(1, pairs.sum(axis=1, keepdims=True))

    each = np.maximum(1, count)
    order = np.lexsort((hashes, of_word))
    fresh = np.ones(len(hashes), dtype=bool)
    fresh[1:] = (hashes[order][1:] != hashes[order][:-1]) | (of_word[order][1:] != of_word[order][:-1])
    distinct = np.bincount(of_word[order][fresh], minlength=total) / each
    again = np.zeros(len(hashes))
    again[1:] = (hashes[1:] == hashes[:-1]) & (of_word[1:] == of_word[:-1])
    length = (ends - begins).astype(float)
    mean = np.bincount(of_word, weights=length, minlength=total) / each
    spread = np.sqrt(np.maximum(0, np.bincount(of_word, weights=length**2, minlength=total) / each - mean**2))
    more = [
        distinct,
        np.bincount(of_word, weights=again, minlength=total) / each,
        np.bincount(of_word, weights=length > 20, minlength=total) / each,
        mean / 10,
        spread / 10,
        np.log1p(np.minimum(count, PASSAGE)) / 5,
        (count == 0).astype(float),
    ]
    return np.column_stack((pairs, *more)).astype(np.float32), owner


def _featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts, rows = texts_of(batch), []
        for part in in_blocks(texts):
            features, owner = _passages(texts[part], PASSAGES)
            cuts = np.searchsorted(owner, np.arange(part.stop - part.start + 1))
            rows += [features[a:b].tobytes() for a, b in zip(cuts[:-1], cuts[1:])]
        yield pa.RecordBatch.from_arrays([batch.column("label"), pa.array(rows, pa.binary())], names=["label", "passages"])


@dataclass
class AttentionModel:
    """Encoder, gated attention (tanh and sigmoid parts) and scorer; ``shift`` and ``scale`` fit the features."""

    weights: dict[str, np.ndarray]
    shift: np.ndarray
    scale: np.ndarray

    def _forward(self, x: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, ...]:
        w = self.weights
        h = np.tanh(x @ w["encode"] + w["encode_0"])
        t = np.tanh(h @ w["tanh"])
        g = 1 / (1 + np.exp(-(h @ w["gate"])))
        e = (t * g) @ w["attend"]
        e = np.exp(e - np.repeat(np.maximum.reduceat(e, starts), sizes))
        a = e / np.repeat(np.add.reduceat(e, starts), sizes)
        z = np.add.reduceat(a[:, None] * h, starts)
        return h, t, g, a, z, 1 / (1 + np.exp(-(z @ w["score"] + w["score_0"][0])))

    def score(self, features: np.ndarray, owner: np.ndarray, many: int) -> np.ndarray:
        sizes = np.bincount(owner, minlength=many)
        return self._forward((features - self.shift) / self.scale, np.cumsum(sizes) - sizes, sizes)[-1]

    def _gradient(self, x: np.ndarray, starts: np.ndarray, sizes: np.ndarray, label: np.ndarray) -> dict[str, np.ndarray]:
        w = self.weights
        h, t, g, a, z, p = self._forward(x, starts, sizes)
        off = (p - label) / len(label)
        out = {"score": z.T @ off, "score_0": np.array([off.sum()])}
        to_z = np.repeat(off[:, None] * w["score"], sizes, axis=0)
        to_a = (to_z * h).sum(axis=1)
        to_e = a * (to_a - np.repeat(np.add.reduceat(a * to_a, starts), sizes))
        out["attend"] = (t * g).T @ to_e
        to_tg = to_e[:, None] * w["attend"]
        to_t, to_g = to_tg * g * (1 - t**2), to_tg * t * g * (1 - g)
        out["tanh"], out["gate"] = h.T @ to_t, h.T @ to_g
        to_h = (a[:, None] * to_z + to_t @ w["tanh"].T + to_g @ w["gate"].T) * (1 - h**2)
        out["encode"], out["encode_0"] = x.T @ to_h, to_h.sum(axis=0)
        return out


def fit_attention(bags: list[np.ndarray], labels: np.ndarray, seed: int = 3) -> AttentionModel:
    """Adam on the log loss of the bags' labels; the same bags in the same order give the same model."""
    rng = np.random.default_rng(seed)
    every = np.concatenate(bags)
    shift, scale = every.mean(axis=0), np.maximum(every.std(axis=0), 1e-3)
    shapes = {
        "encode": (_WIDTH, _ENCODED), "encode_0": (_ENCODED,), "tanh": (_ENCODED, _ATTENTION), "gate": (_ENCODED, _ATTENTION),
        "attend": (_ATTENTION,), "score": (_ENCODED,), "score_0": (1,),
    }
    model = AttentionModel({k: rng.standard_normal(s) / np.sqrt(s[0]) if k[-1] != "0" else np.zeros(s) for k, s in shapes.items()}, shift, scale)
    scaled = [(bag - shift) / scale for bag in bags]
    first = {k: np.zeros(s) for k, s in shapes.items()}
    second = {k: np.zeros(s) for k, s in shapes.items()}
    step = 0
    for _ in range(_EPOCHS):
        order = rng.permutation(len(bags))
        for i in range(0, len(order), _BATCH):
            part = order[i : i + _BATCH]
            sizes = np.array([len(scaled[j]) for j in part])
            slopes = model._gradient(np.concatenate([scaled[j] for j in part]), np.cumsum(sizes) - sizes, sizes, labels[part])
            step += 1
            for k, slope in slopes.items():
                slope = slope + _DECAY * model.weights[k]
                first[k] = 0.9 * first[k] + 0.1 * slope
                second[k] = 0.999 * second[k] + 0.001 * slope**2
                model.weights[k] -= _RATE * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
    return model


def learn_quality(documents: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> AttentionModel | float:
    """A model of ``quality`` (0 or 1) for the documents that ``labels`` names.

    ``sample`` ids with the least hashes are used, at most; each gives at most PASSAGES rows of
    features, which is what reaches the driver. Of several labels of an id the least counts, of
    several texts the greatest; null and other labels are left out. Without labels of both kinds
    the result is their share of ones, or 0.5 if there are none.
    """
    once = labels.filter("quality IN (0, 1) AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("quality").alias("label"))
    chosen = once.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    texts = documents.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    texts = texts.groupBy("doc_id").agg(F.max("text").alias("text"), F.first("label").alias("label")).select("text", F.col("label").cast("int"))
    found = texts.mapInArrow(_featured, "label int, passages binary").orderBy("label", "passages").toArrow()
    y = found.column("label").to_numpy().astype(float)
    if not 0 < y.sum() < len(y):
        return float(y.mean()) if len(y) else 0.5
    return fit_attention([np.frombuffer(b, np.float32).reshape(-1, _WIDTH).astype(float) for b in found.column("passages").to_pylist()], y)


def _score(batches: Iterator[pa.RecordBatch], model: AttentionModel | float) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts, scores = texts_of(batch), []
        for part in in_blocks(texts):
            if isinstance(model, float):
                scores += [model] * (part.stop - part.start)
            else:
                scores += model.score(*_passages(texts[part]), part.stop - part.start).round(6).tolist()
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(scores, pa.float64())], names=["doc_id", "score"])


def score_quality(documents: DataFrame, model: AttentionModel | float) -> DataFrame:
    """(doc_id, score) of every row, from all passages of its whole text; a null text is scored as an empty one."""
    frame = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return frame.mapInArrow(partial(_score, model=model), "doc_id long, score double")
