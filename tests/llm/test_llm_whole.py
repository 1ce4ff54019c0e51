"""Whole results where an operator once did less, each against a plain reference."""

import itertools
import random
import re
import zlib
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from dealerscope.llm import components, decontamination, language_id, packing, quality, queries, shingle_join, token_counts, token_files, tokens
from dealerscope.sources.durable import fresh_path

# -- tokens -----------------------------------------------------------------------------

ADDED = ["one <|endoftext|> two", "<|endoftext|>", "a<|startoftext|>b<|endoftext|><|endoftext|>c", "one <|ENDOFTEXT|> two", "x  <|endoftext|>\n\ny", "<|endoftext| >"]


@pytest.mark.parametrize("path", [queries.BYTE_BPE, queries.WORD_BPE])
def test_added_tokens_are_the_librarys(path):
    untouched, encoder, rng = Tokenizer.from_file(path), tokens.Encoder(path), random.Random(11)
    pieces = ["<|endoftext|>", "<|startoftext|>", "<|", "|>", "endoftext", " ", "a", "It's", "\n", "Zé"]
    made = ["".join(rng.choices(pieces, k=rng.randint(1, 9))) for _ in range(2000)]
    for text in [*ADDED, *made]:
        wanted = untouched.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(encoder.encode(text), "<u4").tolist() == wanted, text


def test_added_tokens_in_the_operators(spark):
    docs = spark.createDataFrame(list(enumerate(ADDED)), "doc_id long, text string")
    ids = {}
    for path in (queries.BYTE_BPE, queries.WORD_BPE):
        untouched = Tokenizer.from_file(path)
        ids[path] = [[*untouched.encode(t, add_special_tokens=False).ids, tokens.END_ID] for t in ADDED]
    folder = fresh_path(spark)
    token_files.write_token_files(docs, folder, queries.BYTE_BPE)
    rows = sorted(token_files.read_token_files(spark, folder).collect(), key=lambda r: r["doc_id"])
    assert [list(r["ids"]) for r in rows] == ids[queries.BYTE_BPE]
    assert [r["start"] for r in rows] == list(itertools.accumulate(map(len, ids[queries.BYTE_BPE]), initial=0))[:-1]
    pieces = {p["doc_id"]: p["doc_tokens"] for p in packing.pack_documents(docs, queries.WORD_BPE).collect()}
    assert [pieces[i] for i in range(len(ADDED))] == list(map(len, ids[queries.WORD_BPE]))
    counts = {r["doc_id"]: r for r in token_counts.recount_masked(docs, queries.BYTE_BPE, "one|two", "<|endoftext|>").collect()}
    untouched = Tokenizer.from_file(queries.BYTE_BPE)
    for i, text in enumerate(ADDED):
        masked = text.replace("one", "<|endoftext|>").replace("two", "<|endoftext|>")
        assert counts[i]["n_tokens"] == len(ids[queries.BYTE_BPE][i]) - 1
        assert counts[i]["n_tokens_masked"] == len(untouched.encode(masked, add_special_tokens=False).ids)


# -- leaks ------------------------------------------------------------------------------


def _shingles(text):
    words = re.findall(r"[^\s!-/:-@\[-`{-~]+", text.lower())
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)}


def test_edited_copies_at_every_position(spark, tmp_path):
    """One word changed, at each place of items of 5 to 60 words: all that share 3/4 of the shingles leak."""
    rng = random.Random(12)
    items = {n: [f"w{int(rng.paretovariate(0.5))}" for _ in range(n)] for n in range(5, 61, 5)}
    copies = [(n, [*words[:i], "changed", *words[i + 1 :]]) for n, words in items.items() for i in range(n)]
    rows = [(d, " ".join(["before", *copy, "after"])) for d, (_, copy) in enumerate(copies)]
    benchmark = [(n, " ".join(words)) for n, words in items.items()]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(benchmark, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    wanted = set()
    for d, text in rows:
        for n, item in benchmark:
            if len(_shingles(item) & _shingles(text)) >= 0.75 * len(_shingles(item)):
                wanted.add((d, n))
    found = {(r["doc_id"], r["item_id"]) for r in queries.op2_decontamination(spark, str(tmp_path)).collect()}
    assert len(wanted) > 250 and wanted <= found
    docs, table = spark.read.parquet(f"{tmp_path}/documents.parquet"), spark.read.parquet(f"{tmp_path}/benchmark.parquet")
    clean = {r["doc_id"] for r in decontamination.decontaminate(docs, table).collect()}
    assert clean == set(range(len(rows))) - {d for d, _ in found}


def test_a_given_answer_is_not_part_of_the_whole(spark):
    item = "what is the name of the long river that runs through the old town"
    docs = spark.createDataFrame([(1, item), (2, f"{item} silver water")], "doc_id long, text string")
    table = spark.createDataFrame([(1, item, "silver water")], "item_id long, text string, answer string")
    found = decontamination.find_leaks(docs, table, whole=decontamination.WHOLE).collect()
    assert [(r["doc_id"], r["item_id"]) for r in found] == [(2, 1)]


# -- packing ----------------------------------------------------------------------------


def test_the_plan_does_not_grow_with_the_rows():
    """A third of the rests are 3,000 long, for which the fillers run out."""
    rng = np.random.default_rng(13)
    lengths, counts = np.unique(np.clip(rng.lognormal(np.log(200), 0.7, 4000).astype(int), 1, 4095), return_counts=True)
    sizes = []
    for times in (10, 1000):
        histogram = dict(zip(lengths.tolist(), (counts * times).tolist()))
        histogram[3000] = histogram.get(3000, 0) + 2000 * times
        plan = packing.pack_lengths(histogram)
        sizes.append(sum(array.size for array in plan.arrays()))
        assert plan.sequences == -(-sum(a * c for a, c in histogram.items()) // packing.WINDOW)
    assert sizes[1] < 2 * sizes[0]


def test_a_long_tail_is_placed_whole(spark):
    """Rests of one length with nothing to fill beside them, in cut places too."""
    words = [f"{'a ' * (59 + i % 2 * 11)}" for i in range(200)]
    docs = spark.createDataFrame(list(enumerate(words)), "doc_id long, text string")
    pieces = packing.pack_documents(docs, queries.WORD_BPE, 100).collect()
    filled, held = {}, {}
    for p in sorted(pieces, key=lambda p: (p["sequence_id"], p["offset"])):
        assert p["offset"] == filled.get(p["sequence_id"], 0)
        filled[p["sequence_id"]] = p["offset"] + p["length"]
        held.setdefault(p["doc_id"], []).append((p["start"], p["length"], p["ids_crc32"]))
    assert sorted(filled) == list(range(len(filled))) and sum(100 - f for f in filled.values()) < 100
    untouched = Tokenizer.from_file(queries.WORD_BPE)
    for i, text in enumerate(words):
        ids = np.array([*untouched.encode(text, add_special_tokens=False).ids, tokens.END_ID], "<u4")
        assert sum(size for _, size, _ in held[i]) == len(ids)
        assert all(crc == zlib.crc32(ids[start : start + size].tobytes()) for start, size, crc in held[i])


# -- quality ----------------------------------------------------------------------------


def test_every_passage_of_a_long_text_is_scored():
    """A passage of a long text has the features that it has as a text of its own; the training sample is bounded."""
    rng = random.Random(14)
    words = [rng.choice(["a", "bb", "Ccc.", "12", "dddd,", "x" * 25]) for _ in range(quality.PASSAGE * (quality.PASSAGES * 2 + 5))]
    parts = [" ".join(words[i : i + quality.PASSAGE]) for i in range(0, len(words), quality.PASSAGE)]
    features, owner = quality._passages([" ".join(words), "short"])
    alone, _ = quality._passages([f"{part} " for part in parts[:-1]])
    assert np.bincount(owner).tolist() == [len(parts), 1]
    counted = slice(quality._KINDS**2, None)  # the pairs of kinds differ by the line end alone
    assert np.allclose(features[: len(parts) - 1, counted], alone[:, counted])
    assert len(quality._passages([" ".join(words)], quality.PASSAGES)[0]) <= quality.PASSAGES


# -- pipeline ---------------------------------------------------------------------------


@pytest.mark.parametrize("lang", [None, "en"])
def test_no_learned_language_keeps_texts_with_letters(spark, lang):
    rows = [(1, "The cat sat on the mat.", None), (2, "Überall 12", None), (3, "日本語", None), (4, "12 !?", lang), (5, "", lang), (6, None, lang)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    kept = corpus_pipeline.known_language(spark, docs, "")
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == [1, 2, 3]


def test_a_long_text_in_a_foreign_script_goes(spark):
    known = ["The cat sat on the mat and looked at the old dog of the house."] * 3
    greek = "Η γάτα κάθισε στο χαλί και κοίταξε τον γέρικο σκύλο του σπιτιού. " * 4
    docs = spark.createDataFrame([*((i, t, "en") for i, t in enumerate(known)), (8, known[0], None), (9, greek, None)], "doc_id long, text string, lang string")
    kept = corpus_pipeline.known_language(spark, docs, "")
    assert sorted(r["doc_id"] for r in kept.collect()) == [0, 1, 2, 8]


def test_few_edges_are_few_files(spark):
    held = {"spark.sql.shuffle.partitions": "64", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {name: spark.conf.get(name) for name in held}
    try:
        for name, value in held.items():
            spark.conf.set(name, value)
        found = components.connected_components(spark.createDataFrame([(i, i + 1) for i in range(300)], "a long, b long"))
        assert {r["component"] for r in found.collect()} == {0} and found.count() == 301
        assert len(found.inputFiles()) == 1
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)


TOGETHER = ["", "a", " a b", "a ", "\n", "one\n\ntwo, three", "\nb", "é it's 12!", "x  y", "日本 語", "<|endoftext|> a", "z\n\n", " \n", "one two " * 50]


def test_texts_encoded_together_are_the_same(monkeypatch):
    one, many = tokens.Encoder(queries.BYTE_BPE), tokens.Encoder(queries.BYTE_BPE)
    assert many.encode_each(TOGETHER) == [one.encode(text) for text in TOGETHER]
    monkeypatch.setattr(tokens, "_CACHED", 0)
    asked, merge = [], many.words.merge
    many.words.clear()
    many.words.parts.clear()
    many.words.merge = lambda word: asked.append(word) or merge(word)
    many.encode_each(["rare words", "of rare words", "and rare words"])
    assert len(asked) == len(set(asked)) == 5  # rare, and words, of, rare after a blank, and


def test_a_worker_keeps_the_caches_of_one_operator():
    first = tokens.encoder(queries.BYTE_BPE)
    assert tokens.encoder(queries.BYTE_BPE) is first
    language_id._table()
    assert tokens.encoder(queries.BYTE_BPE) is not first
    list(shingle_join._survey(iter([])))
    assert language_id._table().grams.size == 0


def test_prefixes_go_out_in_parts():
    texts = [" ".join(f"w{k}x{i}" for i in range(400)) for k in range(2000)]
    batch = pa.RecordBatch.from_arrays([pa.array(texts)], names=["text"])
    frequent = SimpleNamespace(value=(np.zeros(0, np.uint64), np.zeros(0, np.int64)))
    found = [part.num_rows for part in shingle_join._prefixes(iter([batch]), frequent)]
    assert sum(found) == 2000 * 100 and max(found) < 1 << 18 and len(found) > 1
