"""Operators without SQL against brute force, round trips and held-out labels, on the smallest tables."""

import collections
import heapq
import itertools
import random
import re
import zlib
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest
from conftest import SMALL
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from dealerscope.llm import components, decontamination, line_dedup, linking, nearest, packing, queries, shingle_join, token_counts, token_files, tokens


@pytest.fixture(scope="module")
def texts(spark):
    return {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}


def _ids(path, all_texts):
    tokenizer = Tokenizer.from_file(path)
    return [np.array([*e.ids, tokens.END_ID], "<u4") for e in tokenizer.encode_batch(list(all_texts), add_special_tokens=False)]


def _crc(ids):
    return zlib.crc32(np.asarray(ids, "<u4").tobytes())


# -- tokens -----------------------------------------------------------------------------


@pytest.mark.parametrize("path", [queries.BYTE_BPE, queries.WORD_BPE])
def test_cached_encoding_is_the_librarys(path, texts):
    encoder, rng = tokens.Encoder(path), random.Random(1)
    assert encoder.cuts
    odd = ["It's  two\n\n lines\t tab", " a ", "don't Stop'S", "naïve “x” 日本語", "x́ y", "5a6 ²³ª", "<|endoftext|> x </w>", "a\x1cb\x85c", "A.\nB. \nC\n\n"]
    odd += ["".join(rng.choice("ab Z\n\n  .,'!1%é²ª|ſ¡ß\tx") for _ in range(rng.randint(0, 14))) for _ in range(3000)]
    for text in [*odd, *texts.values()]:
        assert encoder.encode(text) == encoder._whole(text), text[:50]


def test_token_files_query(spark, texts):
    rows = {r["doc_id"]: r for r in queries.op4_token_files(spark, SMALL).collect()}
    assert len(rows) == len(texts)
    start = 0
    for doc_id, ids in zip(sorted(texts), _ids(queries.BYTE_BPE, (texts[i] for i in sorted(texts)))):
        assert (rows[doc_id]["start"], rows[doc_id]["n_tokens"], rows[doc_id]["ids_crc32"]) == (start, len(ids), _crc(ids))
        start += len(ids)


def test_code_lengths_are_optimal_and_limited():
    rng = np.random.default_rng(2)
    for n in (1, 2, 3, 40, 300):
        counts = np.maximum(1, rng.pareto(0.5, n) * 10).astype(np.int64)
        lengths = token_files.code_lengths(counts, 40)
        heap, cost = list(map(int, counts)), 0
        heapq.heapify(heap)
        while len(heap) > 1:
            pair = heapq.heappop(heap) + heapq.heappop(heap)
            cost += pair
            heapq.heappush(heap, pair)
        assert n == 1 or (lengths * counts).sum() == cost
        short = token_files.code_lengths(counts, 9)
        assert short.max() <= 9 and (2.0 ** -short.astype(float)).sum() <= 1
    # no code of lengths up to 4 is cheaper than what package-merge gives for these weights
    weights = np.array([1, 1, 2, 3, 5, 8, 13])
    kraft = (ls for ls in itertools.combinations_with_replacement(range(1, 5), len(weights)) if sum(2.0**-x for x in ls) <= 1)
    best = min(sum(w * x for w, x in zip(sorted(weights, reverse=True), ls)) for ls in kraft)
    assert (token_files.code_lengths(weights, 4) * weights).sum() == best


def test_code_round_trip():
    rng = np.random.default_rng(3)
    ids = np.unique(rng.integers(0, 60_000, 900))
    code = token_files.Code(ids, token_files.code_lengths(rng.integers(1, 10_000, len(ids)) ** 2))
    docs = [rng.choice(ids, n) for n in (1, 255, 256, 257, 5000, 2)]
    coded = code.encode(docs)
    for doc, (payload, marks) in zip(docs, coded):
        marks = np.frombuffer(marks, "<u4").astype(np.int64)
        counts = np.minimum(token_files.CHECKPOINT, len(doc) - token_files.CHECKPOINT * np.arange(len(marks)))
        assert code.decode(np.frombuffer(payload, np.uint8), marks, counts).tolist() == doc.tolist()


def test_packing_query(spark, texts):
    pieces = collections.defaultdict(list)
    sequences = collections.defaultdict(list)
    for p in queries.op3_packing(spark, SMALL).collect():
        pieces[p["doc_id"]].append(p)
        sequences[p["sequence_id"]].append((p["offset"], p["length"]))
    for doc_id, ids in zip(texts, _ids(queries.WORD_BPE, texts.values())):
        at = 0
        for p in sorted(pieces[doc_id], key=lambda p: p["start"]):
            assert (p["start"], p["doc_tokens"], p["ids_crc32"]) == (at, len(ids), _crc(ids[at : at + p["length"]]))
            at += p["length"]
        assert at == len(ids)
    padding = 0
    for places in sequences.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= packing.WINDOW
        padding += packing.WINDOW - at
    assert padding < packing.WINDOW  # in the last sequence only


def test_best_fill_is_the_best():
    rng = random.Random(4)
    for _ in range(300):
        counts = {rng.randint(1, 30): rng.randint(1, 4) for _ in range(rng.randint(1, 6))}
        room = rng.randint(0, 80)
        sums = {0}
        for length, many in counts.items():
            sums = {s + length * k for s in sums for k in range(many + 1)}
        chosen = packing.best_fill(counts, sorted(counts), room)
        assert all(chosen[a] <= counts[a] for a in chosen)
        assert sum(a * m for a, m in chosen.items()) == max(s for s in sums if s <= room)


def test_every_rest_is_placed_once():
    rng = random.Random(5)
    for _ in range(60):
        histogram = {rng.randint(1, 99): rng.randint(1, 9) for _ in range(rng.randint(1, 12))}
        plan = packing.pack_lengths(histogram, 100)
        used, ends = collections.Counter(), collections.defaultdict(int)
        rows = plan.rows
        for length, first, each, sequence, offset, start, size in rows:
            same = [r for r in rows if r[0] == length and r[1] > first]
            last = min([r[1] for r in same], default=histogram[length])
            for rank in range(first, last):
                used[length, rank] += size
                ends[sequence + (rank - first) // each] += size
        assert used == {(a, i): a for a, c in histogram.items() for i in range(c)}
        assert max(ends.values()) <= 100 and sorted(ends) == list(range(plan.sequences))
        assert sum(100 - e for e in ends.values()) < 100


def test_counts_query_and_many_edits(spark, texts):
    rows = {r["doc_id"]: r for r in queries.op5_token_counts(spark, SMALL).collect()}
    masked = [re.sub(queries.PERSONAL, "[hidden]", t) for t in texts.values()]
    for doc_id, a, b in zip(texts, _ids(queries.BYTE_BPE, texts.values()), _ids(queries.BYTE_BPE, masked)):
        assert (rows[doc_id]["n_tokens"], rows[doc_id]["n_tokens_masked"]) == (len(a) - 1, len(b) - 1)
    assert sum(r["n_encoded"] for r in rows.values()) < sum(map(len, texts.values())) / 10
    rng = random.Random(6)
    tokenizer = Tokenizer.from_file(queries.BYTE_BPE)
    for _ in range(60):
        text = rng.choice(list(texts.values()))[:3000]
        tree = token_counts.build_tree(text, queries.BYTE_BPE)
        for _ in range(3):
            edits = []
            for _ in range(rng.randint(1, 5)):
                at = rng.randint(0, len(text))
                edits.append((at, at + rng.choice([0, 0, 1, 3, 300]), "".join(rng.choice(" a.b\n  Z9'é") for _ in range(rng.choice([0, 1, 2, 5, 700])))))
            wanted, at = "", 0
            for start, stop, new in sorted(edits):
                start = min(max(start, at), len(text))
                stop = min(max(start, stop), len(text))
                wanted += text[at:start] + new
                at = stop
            wanted += text[at:]
            text, _ = token_counts.edit_tree(tree, text, edits, queries.BYTE_BPE)
            assert text == wanted and tree.chars[1] == len(text)
            assert tree.tokens[1] == len(tokenizer.encode(text, add_special_tokens=False).ids)


# -- graphs, sets, vectors ------------------------------------------------------------


def _roots(nodes, edges):
    root = {n: n for n in nodes}

    def find(n):
        while root[n] != n:
            root[n] = root[root[n]]
            n = root[n]
        return n

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_components(spark):
    rng = random.Random(7)
    edges = [(i, i + 1) for i in range(100, 160)] + [(0, rng.randint(200, 400)) for _ in range(90)]
    edges += [(rng.randint(500, 900), rng.randint(500, 900)) for _ in range(150)] + [(7, 7), (None, 3)]
    frame = spark.createDataFrame(edges, "x long, y long")
    found = {r["node"]: r["component"] for r in components.connected_components(frame, "x", "y").collect()}
    plain = [(a, b) for a, b in edges if a is not None and a != b]
    assert found == _roots({n for e in plain for n in e}, plain)
    assert components.connected_components(frame.limit(0), "x", "y").count() == 0


def _similar(texts):
    sets = {}
    for doc_id, text in texts.items():
        words = re.findall(r"[^\x20\x09-\x0D]+", text.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))
        sets[doc_id] = {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()
    links = [
        (a, b) for a in sets for b in sets
        if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])
    ]
    return sets, _roots(sets, links)


def test_near_copies_in_chains(spark, monkeypatch):
    """Groups whose members are not all like one of them, short texts, and a line that many share."""
    rng = random.Random(8)
    words = [f"w{i}" for i in range(400)]
    texts = {}
    for group in range(6):
        body = [rng.choice(words) for _ in range(rng.choice([6, 30, 90]))]
        for _ in range(25):
            body = list(body)
            body[rng.randrange(len(body))] = rng.choice(words)  # each is a copy of the one before
            texts[len(texts)] = " ".join(body)
    common = [rng.choice(words) for _ in range(20)]
    for _ in range(60):
        texts[len(texts)] = " ".join([*common, *(rng.choice(words) for _ in range(rng.randint(2, 20)))])
    texts |= {len(texts) + i: t for i, t in enumerate(["a", "A", "a b", "", " ", "b a", "a  B\tc D", "a b c d"])}
    sets, wanted = _similar(texts)
    monkeypatch.setattr(linking, "SLICE", 16)
    monkeypatch.setattr(linking, "CHUNK", 4)
    monkeypatch.setattr(linking, "UNIT", 5)
    monkeypatch.setattr(linking, "HOT", 20)
    frame = spark.createDataFrame([(i, t) for i, t in texts.items()], "doc_id long, text string").repartition(3)
    found = shingle_join.join_similar(frame).members.collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in found} == {i: (len(sets[i]), wanted[i]) for i in texts}


def test_a_group_of_near_copies_is_not_compared_once_for_each_bucket(spark, monkeypatch):
    """Its classes go to a place once, whatever buckets they share there, and are searched there together."""
    rng = random.Random(21)
    words = [f"w{i}" for i in range(5000)]
    body = [rng.choice(words) for _ in range(200)]
    texts = {}
    for _ in range(60):
        body = list(body)
        for _ in range(2):
            body[rng.randrange(len(body))] = rng.choice(words)
        texts[len(texts)] = " ".join(body)
    sets, wanted = _similar(texts)
    met, opened = [], linking._open
    monkeypatch.setattr(linking, "_open", lambda *a: met.append(opened(*a).toArrow()) or opened(*a))
    frame = spark.createDataFrame([*texts.items()], "doc_id long, text string").repartition(3)
    found = shingle_join.join_similar(frame).members.collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in found} == {i: (len(sets[i]), wanted[i]) for i in texts}
    rows = [(r["place"], r["class"], r["member"]) for r in met[0].select(["place", "class", "member"]).to_pylist()]
    assert rows and len(rows) == len(set(rows))
    compared, overlaps = [], shingle_join._overlaps
    monkeypatch.setattr(shingle_join, "_overlaps", lambda a, at_a, b, at_b: compared.append(len(at_a)) or overlaps(a, at_a, b, at_b))
    strays, members = collections.Counter(), collections.Counter()
    for r in met[0].select(["place", "stray", "member"]).to_pylist():
        strays[r["place"]] += r["stray"]
        members[r["place"]] += r["member"]
    for part in linking._whole_units(iter(met[0].to_batches())):
        list(linking._pairs_in(part, shingle_join.Counts(5, 75)))
    assert sum(compared) <= 2 * sum(strays[p] * members[p] for p in strays)


def test_places_and_units_are_searched_where_that_is_less():
    rng = np.random.default_rng(4)
    place = np.repeat(np.arange(40), rng.integers(1, 12, 40))
    stray, member = rng.random(len(place)) < 0.5, rng.random(len(place)) < 0.9
    row = np.repeat(np.arange(len(place)), rng.integers(1, 6, len(place)))
    unit = place[row] * 100 + rng.integers(0, np.where(place % 2, 2, 30)[row])
    rows, starts = linking._in_units(place, stray, member, row, unit)
    found, compared = set(), collections.Counter()
    for a, b in itertools.pairwise(starts.tolist()):
        part = rows[a:b]
        assert len(set(place[part].tolist())) == 1
        pairs = {(i, j) for i in part[stray[part]].tolist() for j in part[member[part]].tolist()}
        found |= pairs
        compared[place[part[0]]] += len(pairs)
    every = collections.Counter()
    for u in np.unique(unit).tolist():
        part = row[unit == u]
        pairs = [(i, j) for i in part[stray[part]].tolist() for j in part[member[part]].tolist()]
        assert found >= set(pairs)
        every[u // 100] += len(pairs)
    whole = {p: int(stray[place == p].sum() * member[place == p].sum()) for p in every}
    assert all(compared[p] <= min(every[p], whole[p]) for p in every) and any(whole[p] < every[p] for p in every) and any(whole[p] > every[p] for p in every)


def test_buckets_are_those_of_shared_first_shingles(spark):
    """The shingles of few large rows: of buckets of the same classes one, with the text that the others were made from first."""
    rng = random.Random(5)
    words = [f"w{i}" for i in range(3000)]
    base = [rng.choice(words) for _ in range(160)]
    texts = [base]
    for _ in range(30):
        copy = list(base)
        for i in rng.sample(range(len(base)), rng.randint(2, 5)):
            copy[i] = rng.choice(words)
        texts.append(copy)
    texts = [" ".join(t) for t in texts] + [" ".join(rng.choice(words) for _ in range(100)) for _ in range(20)]
    texts += texts[3:6]  # exact copies are one class
    frequent = SimpleNamespace(value=(np.zeros(0, np.uint64), np.zeros(0, np.int64)))
    batches = pa.table({"text": texts}).to_batches(max_chunksize=9)
    wanted = collections.defaultdict(set)
    for found in shingle_join._prefixes(iter(batches), frequent):
        for shingle, key in zip(*(c.to_pylist() for c in found.columns)):
            wanted[shingle].add(key)
    kinds = collections.Counter(frozenset(keys) for keys in wanted.values() if len(keys) > 1)
    dealt = [list(shingle_join._dealt(iter([b]), frequent, 3)) for b in batches]
    assert sum(b.num_rows for d in dealt for b in d) <= 8 * len(batches) and len(kinds) > 8

    def by_part(found):
        return pa.Table.from_batches(found).sort_by("part").to_batches(max_chunksize=2)

    shared = list(shingle_join._shared(iter(by_part([b for d in dealt for b in d])), 3))
    distinct = pa.Table.from_batches(shingle_join._distinct(iter(by_part(shared)))).to_pylist()
    members, times = collections.defaultdict(set), {}
    for r in distinct:
        members[r["key"]].add(r["member"])
        times[r["key"]] = r["shingles"]
    assert {frozenset(m): times[k] for k, m in members.items()} == kinds and sum(map(len, members.values())) == len(distinct)
    assert all(wanted[k] == m for k, m in members.items())
    classes = [(shingle_join._class_of(s), len(s)) for s in linking.sets_of(texts, 5)]
    rows = spark.createDataFrame([(bytearray(c), shingle_join._key(c), n) for c, n in set(classes)], "class binary, key long, n int")
    none = spark.sparkContext.broadcast(frequent.value)
    buckets = shingle_join._buckets(spark.createDataFrame([(t,) for t in texts], "text string"), rows, none).collect()
    first = {r["key"]: bytes(r["a"]) for r in buckets}
    assert {k: {shingle_join._key(bytes(r["class"])) for r in buckets if r["key"] == k} for k in first} == members
    with_base = [k for k, m in members.items() if shingle_join._key(classes[0][0]) in m]
    assert with_base and all(first[k] == classes[0][0] for k in with_base)


def test_trees_lose_no_pair():
    """Several units of near copies, fine counts among them: searched as the operator does."""
    rng = np.random.default_rng(9)
    base = rng.poisson(0.4, (40, shingle_join.GROUPS))
    points = np.repeat(base, 8, axis=0)
    points = np.maximum(0, points + (rng.random(points.shape) < 0.03) - (rng.random(points.shape) < 0.03)).astype("<u4")
    sizes, labels = points.sum(axis=1).astype(np.int32), rng.integers(0, 60, len(points))
    stray, member = rng.random(len(points)) < 0.6, rng.random(len(points)) < 0.9
    starts = np.array([0, 1, 90, 90, 200, len(points)])
    test = shingle_join.Counts(5, 75)
    rows = pa.table({"counts": pa.array([shingle_join._packed(p) if i % 3 else p.astype("<u4").tobytes() for i, p in enumerate(points)], pa.binary()), "fine": pa.nulls(len(points), pa.binary())})
    found = set()
    for a, b, likely in test.search(linking.Units(starts, stray, member, sizes, labels), test.points(rows)):
        found |= set(zip(a.tolist(), b.tolist()))
    overlap = np.minimum(points[:, None, :], points[None, :, :]).sum(axis=2)
    unit = np.searchsorted(starts, np.arange(len(points)), side="right")
    wanted = {
        (i, j) for i in np.flatnonzero(stray).tolist() for j in np.flatnonzero(member).tolist()
        if unit[i] == unit[j] and labels[i] != labels[j] and 175 * overlap[i, j] >= 75 * (int(sizes[i]) + int(sizes[j]))
        and 100 * min(sizes[i], sizes[j]) >= 75 * max(sizes[i], sizes[j])
    }
    assert wanted and found == wanted


def test_the_query_builds_and_searches_trees_on_the_given_tables(spark, tmp_path, monkeypatch):
    """The buckets of the given documents, as the operator hands them to its tasks."""
    met = []

    def keep(rows, *rest):
        found = opened(rows, *rest)
        met.append(found.toArrow())
        return found

    opened = linking._open
    monkeypatch.setattr(linking, "_open", keep)
    queries.op6_ngram_jaccard(spark, SMALL).count()
    packed, searched, roots = [], [], shingle_join.RTrees.pack
    search = shingle_join.RTrees.search

    def pack(*arguments):
        packed.append(roots(*arguments))
        return packed[-1]

    def look(trees, points, *rest):
        searched.append(len(points))
        return search(trees, points, *rest)

    monkeypatch.setattr(shingle_join.RTrees, "pack", pack)
    monkeypatch.setattr(shingle_join.RTrees, "search", look)
    pairs = 0
    for table in met:
        for part in linking._whole_units(iter(table.to_batches())):
            pairs += sum(len(a) for a, _, _ in linking._pairs_in(part, shingle_join.Counts(5, 75)))
    assert len(met) == 2 and packed and searched
    assert sum(len(t.unit) for t in packed) > 0 and all(len(t.corner[-1]) == len(np.unique(t.unit)) for t in packed)


def test_fine_counts_rule_out_long_texts():
    rng = np.random.default_rng(3)
    every = rng.integers(0, 2**64, 30_000, dtype=np.uint64)
    sets = [every[:9000], every[500:9500], every[12_000:21_000], every[:200], every[:9000]]
    fine = [shingle_join._fine_counts(np.unique(s)) for s in sets]
    assert fine[3] is None and len(fine[0]) == 2048
    test = shingle_join.Counts(5, 75)
    assert test._fine_allows(fine[0], fine[1], 18_000) and test._fine_allows(fine[0], fine[4], 18_000)
    assert not test._fine_allows(fine[0], fine[2], 18_000)
    coarse = [np.bincount((s >> np.uint64(56)).astype(np.int64), minlength=256) for s in sets]
    assert test.bound_allows(np.minimum(coarse[0], coarse[2]).sum()[None], np.array([9000]), np.array([9000]))[0]  # not by the coarse ones
    other = np.bincount((np.unique(sets[1]) >> np.uint64(50)).astype(np.int64), minlength=1 << 14).astype("<u1").tobytes()
    assert test._fine_allows(fine[0], other, 18_000)  # compared on the coarser of the two


def test_nearest_query(spark):
    rows = {r["vec_id"]: r["embedding"] for r in spark.read.parquet(f"{SMALL}/embeddings.parquet").collect()}
    ids = np.array(sorted(rows))
    vectors = np.array([rows[i] for i in ids], dtype=float)
    found = collections.defaultdict(list)
    for r in queries.op1_nearest(spark, SMALL).orderBy("query_id", "rank").collect():
        found[r["query_id"]].append((r["rank"], r["vec_id"], r["score"]))
    hits = 0
    assert set(found) == {int(i) for i in ids if i % 20 == 0}
    for query, near in found.items():
        scores = vectors @ vectors[np.searchsorted(ids, query)]
        scores[np.searchsorted(ids, query)] = -np.inf
        hits += len(set(ids[np.lexsort((ids, -scores))[:20]].tolist()) & {v for _, v, _ in near})
        assert [r for r, _, _ in near] == list(range(1, 21))
        assert all(abs(s - scores[np.searchsorted(ids, v)]) < 1e-12 for _, v, s in near)
        assert near == sorted(near, key=lambda x: (-x[2], x[1]))
    assert hits >= 0.9 * 20 * len(found)


def test_many_equal_vectors(spark):
    """A third of the rows is one vector; it needs no more than its smallest ids, and ties go to them."""
    rows = [(i, [1.0, 0.0, 0.0] if i % 3 == 0 else [float(i % 7), float(i % 5), 1.0]) for i in range(600)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    found = collections.defaultdict(list)
    for r in nearest.nearest(table, table.filter("vec_id % 20 = 0"), top=5).orderBy("rank").collect():
        found[r["query_id"]].append(r["vec_id"])
    for query, near in found.items():
        own = dict(rows)[query]
        wanted = sorted((i for i, _ in rows if i != query), key=lambda i: (-sum(a * b for a, b in zip(dict(rows)[i], own)), i))
        assert near == wanted[:5]


# -- texts ------------------------------------------------------------------------------


def _plain(text):
    return " " + " ".join(re.findall(r"[^\s!-/:-@\[-`{-~]+", text.lower())) + " "


def test_leaks_query(spark, texts):
    items = {r["item_id"]: r["text"] for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()}
    bodies = {i: _plain(t) for i, t in texts.items()}
    whole = {(d, i) for i, item in items.items() for d, body in bodies.items() if _plain(item) in body}
    found = queries.op2_decontamination(spark, SMALL).collect()
    assert whole and {(r["doc_id"], r["item_id"]) for r in found} == whole


def test_search_finds_all_above_the_threshold(spark):
    rng = random.Random(10)
    words = [f"w{int(rng.paretovariate(0.6))}" for _ in range(3000)]
    items = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(5, 30))), None) for i in range(300)]
    batch = pa.RecordBatch.from_pydict({"item_id": [i for i, _, _ in items], "text": [t for _, t, _ in items]})
    table = pa.Table.from_batches(list(decontamination._item_terms([batch])))
    df = table.group_by("term").aggregate([("item_id", "count")]).rename_columns(["term", "df"])
    index = decontamination._build(items, table.join(df, "term"), 17.0, len(items), 0.3)
    for _ in range(60):
        text = " ".join([*(rng.choice(words) for _ in range(40)), *rng.choice(items)[1].split()[: rng.randint(0, 30)]])
        body = decontamination.word_hashes([text], plain=True)[0]
        scores = np.zeros(len(items))
        for term in np.unique(body):
            at = np.searchsorted(index.terms, term)
            if at < len(index.terms) and index.terms[at] == term:
                part = slice(index.first[at], index.first[at + 1])
                scores[index.items[part]] += index.impacts[part]
        for threshold in (0.3, 0.6):
            assert sorted(i for i, _ in index.search(body, threshold)) == [i for i, s in enumerate(scores) if s >= threshold]


def test_reworded_and_partial_leaks(spark):
    item = "which of the seven old bridges over the river was built before the great fire of the town and why"
    rows = [(1, f"noise before it. {item.upper()}! and after"), (2, " ".join(item.split()[:9])), (3, item.replace("seven", "nine")), (4, "of the " * 40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    table = spark.createDataFrame([(9, item), (8, "other words that are nowhere to be found in these texts at all")], "item_id long, text string")
    assert {(r["doc_id"], r["item_id"]) for r in decontamination.find_leaks(docs, table).collect()} == {(1, 9)}


def test_languages_held_out(spark):
    known = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "lang")
    rows = queries.op9_language_id(spark, SMALL).join(known, "doc_id").filter("held_out").collect()
    assert rows and sum(r["lang"] == r["lang_pred"] for r in rows) >= 0.95 * len(rows)


def test_quality_held_out(spark):
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    rows = queries.op8_quality(spark, "/root/testdata/sf0.01").join(labels, "doc_id").filter("held_out").collect()
    assert sum(r["predicted"] == r["quality"] for r in rows) >= 0.95 * len(rows)
    assert np.mean([r["predicted"] for r in rows if r["quality"] == 1]) >= 0.98


# -- pipeline ---------------------------------------------------------------------------


def test_pipeline_stages(spark, texts):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").withColumn("score", F.lit("mine"))
    items = {r["item_id"]: _plain(r["text"]) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()}
    stages = dict(corpus_pipeline.STAGES)
    named = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = {r["doc_id"]: r["text"] for r in named.collect()}
        after = line_dedup.materialise(stage(spark, named, SMALL))
        assert after.columns == docs.columns and after.count() <= len(before), name
        kept = {r["doc_id"]: r["text"] for r in after.collect()}
        if name == "language id":
            assert kept == {i: t for i, t in before.items() if any(map(str.isalpha, t))}
        elif name == "line dedup":
            assert all(set(t.split("\n")) <= set(before[i].split("\n")) for i, t in kept.items())
            assert all(r["n_chars"] == len(r["text"]) for r in after.collect())
        elif name == "ngram jaccard join":
            sets, roots = _similar(before)
            assert set(kept) == {i for i in before if roots[i] == i}
        else:
            assert set(kept) == {i for i, t in before.items() if not any(p in _plain(t) for p in items.values())}
        named = after
    pieces = stages["packing"](spark, named, SMALL)
    assert sorted(map(tuple, corpus_pipeline.run(spark, SMALL).collect())) == sorted(map(tuple, pieces.collect()))
