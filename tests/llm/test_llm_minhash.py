"""Near duplicates by b-bit MinHash against all pairs of sets."""

import itertools
import random
import re

import numpy as np
import pytest
from conftest import SMALL
from pyspark.sql import functions as F

from dealerscope.llm import linking, minhash, queries

EXTRA = ["version", "class", "n", "group", "kept", "bands", "signature", "component", "many", "unit", "key", "doc", "least"]


def _shingles(text, words):
    lowered = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
    found = re.findall(r"[^\x20\x09-\x0D]+", lowered)
    return {tuple(found[i : i + words]) for i in range(max(1, len(found) - words + 1))} if found else set()


def _components(rows, words=2, least=80):
    """{row number: (size, least doc_id reachable)}"""
    sets = [_shingles(text, words) for _, text in rows]
    by_shingle, home = {}, list(range(len(rows)))

    def find(i):
        while home[i] != i:
            home[i] = home[home[i]]
            i = home[i]
        return i

    for i, s in enumerate(sets):
        for shingle in s:
            by_shingle.setdefault(shingle, []).append(i)
    for i, s in enumerate(sets):
        near = {}
        for shingle in s:
            for j in by_shingle[shingle]:
                if j < i:
                    near[j] = near.get(j, 0) + 1
        for j, shared in near.items():
            if 100 * shared >= least * (len(s) + len(sets[j]) - shared):
                home[find(i)] = find(j)
    lowest = {}
    for i, (doc_id, _) in enumerate(rows):
        if doc_id is not None:
            lowest[find(i)] = min(lowest.get(find(i), doc_id), doc_id)
    return [(doc_id, len(s), lowest.get(find(i)) if s else doc_id) for i, ((doc_id, _), s) in enumerate(zip(rows, sets))]


def _found(spark, rows, **options):
    frame = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("mine") for c in EXTRA})
    out = minhash.near_duplicates(frame, **options).collect()
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in out)
    return sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in out), key=repr)


def _text(rng, many, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(many))


def _edited(rng, text, edits):
    words = text.split()
    for _ in range(edits):
        words[rng.randrange(len(words))] = f"e{rng.randrange(10**6)}"
    return " ".join(words)


def test_given_documents(spark):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    found = sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in queries.op11_minhash(spark, SMALL).collect())
    assert found == sorted(_components(rows))


def test_large_group_whose_members_are_linked_in_part(spark, monkeypatch):
    """Copies of copies at every distance, chains across the least similarity, and slices of a hot bucket."""
    monkeypatch.setattr(linking, "SLICE", 40)
    monkeypatch.setattr(linking, "HOT", 20)
    rng = random.Random(4)
    base = _text(rng, 120)
    texts = [_edited(rng, base, rng.randrange(0, 14)) for _ in range(260)]
    chain = _text(rng, 90)
    for _ in range(40):
        texts.append(chain)
        chain = _edited(rng, chain, 4)
    texts += [_text(rng, rng.randrange(1, 60)) for _ in range(150)]
    rng.shuffle(texts)
    rows = list(enumerate(texts))
    assert _found(spark, rows) == sorted(_components(rows), key=repr)


def test_other_words_and_least_similarity(spark):
    rng = random.Random(9)
    base = [_text(rng, 60) for _ in range(6)]
    rows = [(i, _edited(rng, base[i % 6], rng.randrange(0, 5))) for i in range(90)]
    assert _found(spark, rows, words=3, least=85) == sorted(_components(rows, 3, 85), key=repr)


LONG = " ".join(f"word{i % 977} of{i}" for i in range(30_000))
AWKWARD = [
    (1, "The cat sat on the mat"), (1, "The cat sat on the mat"), (2, None), (3, ""), (4, " \n\t\x0b "), (5, "one"), (6, "ONE"), (7, "one two"), (8, "Two one"),
    (None, "the CAT sat on the mat"), (None, "nobody's own words here"), (None, None), (9, LONG), (10, LONG + " end"), (1, "Another text under the same id"),
    (11, "É é"), (12, "é é"), (13, "a b c"), (14, "one\ntwo"),
]


def test_awkward_rows(spark):
    assert _found(spark, AWKWARD) == sorted(_components(AWKWARD), key=repr)
    frame = spark.createDataFrame(AWKWARD, "doc_id long, text string").withColumns({c: F.lit("mine") for c in EXTRA})
    one = minhash.without_near_duplicates(frame)
    assert one.columns == frame.columns
    kept = sorted(((r["doc_id"], r["text"]) for r in one.collect() if _shingles(r["text"], 2)), key=repr)
    assert [k[0] for k in kept] == [1, 1, 11, 12, 13, 5, 7, 8, 9, None]
    assert one.filter("version <> 'mine'").count() == 0
    assert one.count() == len(kept) + 4  # texts without words all stay
    nothing = frame.limit(0)
    assert minhash.near_duplicates(nothing).count() == 0 and minhash.without_near_duplicates(nothing).count() == 0


def test_estimates_are_corrected_for_chance():
    rng = np.random.default_rng(1)
    for share in (0.0, 0.3, 0.8, 0.95):
        estimates = []
        for _ in range(60):
            size, common = 600, round(600 * 2 * share / (1 + share))
            every = rng.integers(0, 2**64, 2 * size, dtype=np.uint64)
            pair = [np.unique(every[:size]), np.unique(np.concatenate((every[:common], every[size : 2 * size - common])))]
            packed = minhash.signatures_of(minhash.minima_of(pair)).view(np.uint64)
            estimates.append(float(minhash.similarity_from(minhash.equal_places(packed[0], packed[1]))))
        assert abs(np.mean(estimates) - share) < 0.02 and np.std(estimates) < 0.045
    assert minhash.signatures_of(np.zeros((1, minhash.MINIMA), np.uint64)).shape == (1, minhash.MINIMA * minhash.BITS // 8)
    # a pair at the least similarity is passed over about once in 10^9, one at half of it nearly always
    p = 0.25 + 0.75 * 0.8
    draws = rng.binomial(minhash.MINIMA, [[p], [0.25 + 0.75 * 0.4]], (2, 100_000))
    assert (draws[0] >= minhash.least_places(80)).all() and (draws[1] >= minhash.least_places(80)).mean() < 0.001


@pytest.mark.parametrize("bits", [[0, 3, 1], [2, 2, 2]])
def test_places_are_counted_by_lane(bits):
    a = np.zeros((1, minhash.MINIMA // 32), np.uint64)
    b = a.copy()
    for place, value in enumerate(bits):
        b[0, place] |= np.uint64(value << 2 * place)
    assert minhash.equal_places(a, b).tolist() == [minhash.MINIMA - sum(v > 0 for v in bits)]
    assert list(itertools.chain(minhash.equal_places(b, b))) == [minhash.MINIMA]
