"""The two learned operators against plain loops: profiles and cosines, attention scores and gradients."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from dealerscope.llm import language_id, quality

TEXTS = {
    "en": ["the cat sat on the mat", "a dog looked at The cat, twice!", "where is my mat?"],
    "de": ["die Katze saß auf der Matte", "ein Hund sah die Katze an", "wo ist Überall"],
    "fr": ["le chat était sur le tapis", "un chien regarde le chat"],
}


def _grams(text):
    """Letters with their neighbours, other characters as blanks."""
    letters = [c if c.isalpha() else None for c in f" {text.lower()} "]
    found = {}
    for a, b, c in zip(letters, letters[1:], letters[2:]):
        if b is not None:
            found[a, b, c] = found.get((a, b, c), 0) + 1
    return found


def _vector(gram):
    codes = np.array([0 if c is None else ord(c) for c in gram], np.uint64)
    first, second, third = language_id._letter_vectors(codes).astype(int)
    return np.roll(first, 2) * np.roll(second, 1) * third


def _bundle(text):
    grams = _grams(text)
    length = math.sqrt(sum(n * n for n in grams.values()))
    return sum(n / length * _vector(g) for g, n in grams.items())


def test_profiles_and_cosines_equal_a_dense_loop(spark):
    rows = [(i, text, lang) for i, (lang, text) in enumerate((lang, t) for lang, ts in TEXTS.items() for t in ts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    profiles = language_id.learn_profiles(docs, F.lit(True))
    assert profiles.languages == ("de", "en", "fr")
    dense = []
    for lang, vector in zip(profiles.languages, profiles.vectors):
        wanted = sum(_bundle(t) for t in TEXTS[lang])
        dense.append(wanted / np.linalg.norm(wanted))
        assert np.abs(vector - dense[-1]).max() < 1e-4
    asked = ["the mat", "die Matte", "tapis", "x", "Ünd", "the die le " * 40]
    found = {r["text"]: r for r in language_id.predict_language(spark.createDataFrame([(t,) for t in asked], "text string"), profiles).collect()}
    for text in asked:
        mine = _bundle(text)
        cosines = [float(mine @ d / np.linalg.norm(mine)) for d in dense]
        assert found[text]["lang_pred"] == profiles.languages[int(np.argmax(cosines))]
        assert abs(found[text]["score"] - max(0, max(cosines))) < 1e-4


def test_long_texts_are_counted_in_parts(monkeypatch):
    rng = random.Random(2)
    texts = ["".join(rng.choice("abc éß\n1.") for _ in range(rng.randrange(900))) for _ in range(20)] + ["", " ", "x" * 500]
    whole = language_id._gram_counts(texts)
    monkeypatch.setattr(language_id, "_BLOCK", 50)
    parts = language_id._gram_counts(texts)
    assert all(np.array_equal(a, b) for a, b in zip(whole, parts))
    plain = {(i, tuple(0 if c is None else ord(c) for c in g)): n for i, t in enumerate(texts) for g, n in _grams(t).items()}
    found = {(o, (int(g) >> 42, (int(g) >> 21) & 0x1FFFFF, int(g) & 0x1FFFFF)): n for o, g, n in zip(*(x.tolist() for x in parts))}
    assert found == plain


@pytest.fixture(scope="module")
def model():
    rng = np.random.default_rng(5)
    shapes = {
        "encode": (quality._WIDTH, quality._ENCODED), "encode_0": (quality._ENCODED,), "tanh": (quality._ENCODED, quality._ATTENTION),
        "gate": (quality._ENCODED, quality._ATTENTION), "attend": (quality._ATTENTION,), "score": (quality._ENCODED,), "score_0": (1,),
    }
    weights = {k: rng.standard_normal(s) * (0.3 if len(s) > 1 else 1) for k, s in shapes.items()}
    return quality.AttentionModel(weights, np.zeros(quality._WIDTH), np.ones(quality._WIDTH))


def _plain_score(w, bag):
    """One bag, passage by passage."""
    encoded, raw = [], []
    for x in bag:
        h = np.tanh(x @ w["encode"] + w["encode_0"])
        encoded.append(h)
        raw.append(sum(math.tanh(h @ w["tanh"][:, j]) / (1 + math.exp(-(h @ w["gate"][:, j]))) * w["attend"][j] for j in range(len(w["attend"]))))
    total = sum(math.exp(e) for e in raw)
    pooled = sum(math.exp(e) / total * h for e, h in zip(raw, encoded))
    return 1 / (1 + math.exp(-(pooled @ w["score"] + w["score_0"][0])))


def test_attention_scores_equal_a_plain_loop(model):
    rng = np.random.default_rng(6)
    bags = [rng.standard_normal((n, quality._WIDTH)) * 0.4 for n in (1, 4, 2, 7)]
    owner = np.repeat(np.arange(4), [1, 4, 2, 7])
    found = model.score(np.concatenate(bags), owner, 4)
    assert np.allclose(found, [_plain_score(model.weights, bag) for bag in bags], atol=1e-12)


def test_gradients_equal_numeric_differences(model):
    rng = np.random.default_rng(7)
    sizes = np.array([2, 1, 5])
    x = rng.standard_normal((8, quality._WIDTH)) * 0.4
    starts, labels = np.cumsum(sizes) - sizes, np.array([1.0, 0.0, 1.0])

    def loss():
        p = model._forward(x, starts, sizes)[-1]
        return float(-(labels * np.log(p) + (1 - labels) * np.log(1 - p)).mean())

    slopes = model._gradient(x, starts, sizes, labels)
    for name, weight in model.weights.items():
        assert slopes[name].shape == weight.shape
        for _ in range(12):
            at = tuple(int(rng.integers(0, n)) for n in weight.shape)
            kept, step = weight[at], 1e-5
            weight[at] = kept + step
            up = loss()
            weight[at] = kept - step
            down = loss()
            weight[at] = kept
            assert abs((up - down) / (2 * step) - slopes[name][at]) < 1e-7, name
