"""Nulls, empty and very long texts, ties, repeated rows, empty tables and clashing column names."""

import math

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from dealerscope.llm import (
    decontamination, language_id, line_dedup, nearest, packing, quality, shingle_join, token_counts, token_files, url_filters,
)
from dealerscope.sources.durable import fresh_path

BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")
WORD_BPE = public_tokenizers.path("word_bpe_49k.json")
LONG = " ".join(f"word{i % 977} of{i}" for i in range(30_000))
ROWS = [
    (1, "The cat sat on the mat and looked at the dog.", "en"),
    (1, "The cat sat on the mat and looked at the dog.", "en"),
    (2, None, "en"),
    (3, "", None),
    (4, " \n\t ", "en"),
    (5, "...!? 123", None),
    (None, "The cat sat on the mat and looked at the dog.", "en"),
    (6, LONG, None),
    (7, "Überall süße Bären \U0001f600 日本語\x00 x", "de"),
    (1, "Another text under the same id", "en"),
]
# columns that operators make themselves
EXTRA = ["score", "class", "key", "version", "tokens", "rank", "start", "bucket", "lines_removed", "kept_", "text_hash_", "n", "gone_", "gone_id_", "gone_hash_", "lines_", "leaked_", "kept_id_", "version_", "lang_pred", "group", "unit", "member", "component"]


@pytest.fixture(scope="module")
def docs(spark):
    frame = spark.createDataFrame(ROWS, "doc_id long, text string, lang string")
    return frame.withColumns({name: F.lit("mine") for name in EXTRA})


@pytest.fixture(scope="module")
def none(docs):
    return docs.limit(0)


def _by_id(frame, *columns):
    return sorted(((r["doc_id"], *(r[c] for c in columns)) for r in frame.collect()), key=repr)


def test_languages(docs, none):
    profiles = language_id.learn_profiles(docs, F.lit(True))
    assert profiles.languages == ("de", "en")
    out = language_id.predict_language(docs, profiles)
    assert out.columns == [c for c in docs.columns if c not in ("score", "lang_pred")] + ["lang_pred", "score"]
    found = {(r["doc_id"], r["text"]): (r["lang_pred"], r["score"]) for r in out.collect()}
    assert len(found) == len(set((i, t) for i, t, _ in ROWS))
    assert all(found[k] == ("und", 0.0) for k in found if k[0] in (2, 3, 4, 5))
    assert found[1, ROWS[0][1]][0] == "en" and found[7, ROWS[8][1]][0] == "de"
    assert all(0 <= score <= 1 for _, score in found.values())
    nothing = language_id.learn_profiles(none, F.lit(True))
    assert nothing.languages == () and language_id.predict_language(none, profiles).count() == 0
    assert {r["lang_pred"] for r in language_id.predict_language(docs, nothing).collect()} == {"und"}


def test_quality(spark, docs, none):
    labels = spark.createDataFrame([(1, 1, 0), (1, 1, 0), (2, 0, None), (3, None, 1), (6, 0, 0), (7, 7, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    model = quality.learn_quality(docs, labels)
    assert isinstance(model, quality.AttentionModel)
    scores = quality.score_quality(docs, model).collect()
    assert len(scores) == len(ROWS) and all(0 <= r["score"] <= 1 for r in scores)
    empty = {r["score"] for r in scores if r["doc_id"] in (2, 3)}
    assert len(empty) == 1  # null and empty texts alike
    assert quality.learn_quality(none, labels) == 0.5
    assert quality.learn_quality(docs, labels.filter("quality = 1")) == 1.0
    assert {r["score"] for r in quality.score_quality(docs, 0.5).collect()} == {0.5}
    assert quality.score_quality(none, model).count() == 0


def test_lines(spark, docs, none):
    out = line_dedup.dedup_lines(docs)
    assert set(out.columns) == set(docs.columns) and out.count() == len(ROWS)
    assert [r["text"] for r in out.filter("doc_id = 2").collect()] == [None]
    assert {r["lines_removed"] for r in out.collect()} == {0}  # runs of under 25 words stay
    assert {r["lines_removed"] for r in line_dedup.dedup_lines(docs, 5).filter("doc_id = 1").collect()} == {1, 0}
    assert line_dedup.dedup_lines(none).count() == 0


def test_similar(docs, none):
    members = shingle_join.join_similar(docs).members
    found = {(r["doc_id"], r["n_shingles"], r["component_id"]) for r in members.collect()}
    assert members.count() == len(ROWS)
    assert {f for f in found if f[0] in (2, 3, 4, 5)} == {(2, 0, 2), (3, 0, 3), (4, 0, 4), (5, 1, 5)}
    assert (None, 7, 1) in found and (1, 7, 1) in found and (1, 2, 1) in found
    kept = shingle_join.one_of_each(docs)
    assert kept.columns == docs.columns
    assert sorted((r["doc_id"], r["text"]) for r in kept.filter("text IS NOT NULL").collect()) == sorted(
        {(i, t) for i, t, _ in ROWS if t is not None and i is not None}
    )
    assert shingle_join.join_similar(none).members.count() == 0 and shingle_join.one_of_each(none).count() == 0


def test_leaks(spark, docs, none):
    items = spark.createDataFrame(
        [(1, "cat sat on the MAT, and looked at the dog"), (1, "zzz"), (2, None), (3, ""), (4, "too short"), (None, "x y z a b c d"), (5, "of100 word101 of101 word102 of102 word103")],
        "item_id long, text string",
    ).withColumn("score", F.lit("mine"))
    found = decontamination.find_leaks(docs, items.filter("text <> 'zzz' OR text IS NULL"))
    assert sorted((r["doc_id"] or 0, r["item_id"]) for r in found.collect()) == [(0, 1), (1, 1), (1, 1), (6, 5)]
    assert decontamination.find_leaks(docs, items.limit(0)).count() == 0
    assert decontamination.find_leaks(none, items).count() == 0
    clean = decontamination.decontaminate(docs, items.filter("text <> 'zzz' OR text IS NULL"))
    assert clean.columns == docs.columns
    assert sorted(str(r["doc_id"]) for r in clean.collect()) == ["1", "2", "3", "4", "5", "7"]


def test_short_items_are_one_shingle(spark, docs):
    items = spark.createDataFrame([(1, "word101 OF101 word102 of102"), (2, "the DOG."), (3, "dog the"), (4, "bären")], "item_id long, text string")
    found = sorted((r["doc_id"] or 0, r["item_id"]) for r in decontamination.find_leaks(docs, items).collect())
    assert found == [(0, 2), (1, 2), (1, 2), (6, 1), (7, 4)]
    assert sorted(str(r["doc_id"]) for r in decontamination.decontaminate(docs, items).collect()) == ["1", "2", "3", "4", "5"]


def test_pipeline_stages_keep_columns_of_any_name(spark, docs):
    """Every stage that gives documents back leaves their own columns alone."""
    import corpus_pipeline

    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, "/root/testdata/sf0.001")
        assert out.columns == docs.columns, name
        assert all(r[c] == "mine" for r in out.collect() for c in EXTRA), name


def test_foreign_texts_by_letters_and_cosine(spark):
    import corpus_pipeline

    cases = [(0.0, 5, False), (0.0, 41, False), (0.0, 60, True), (0.05, 100, True), (0.06, 100, False), (0.09, 10_000, True), (0.1, 10_000, False)]
    rows = spark.createDataFrame([(s, float(n), w) for s, n, w in cases], "score double, letters double, wanted boolean")
    found = rows.withColumn("found", corpus_pipeline._foreign(F.col("score"), F.col("letters"))).collect()
    assert all(r["found"] == r["wanted"] for r in found)


def test_packing(docs, none):
    pieces = packing.pack_documents(docs, WORD_BPE).collect()
    assert {p["doc_id"] for p in pieces} == {r[0] for r in ROWS}
    ends = {}
    for p in sorted(pieces, key=lambda p: (p["sequence_id"], p["offset"])):
        assert p["offset"] == ends.get(p["sequence_id"], 0)
        ends[p["sequence_id"]] = p["offset"] + p["length"]
    assert max(ends.values()) <= packing.WINDOW and len({p["sequence_id"] for p in pieces}) == len(ends)
    assert sum(p["length"] for p in pieces if p["doc_id"] == 3) == 1  # the end id alone
    assert packing.pack_documents(none, WORD_BPE).count() == 0


def test_token_files(spark, docs, none):
    path = fresh_path(spark)
    token_files.write_token_files(docs, path, BYTE_BPE, buckets=3)
    rows = sorted(token_files.read_token_files(spark, path).collect(), key=lambda r: r["start"])
    assert [r["doc_id"] for r in rows] == sorted((r[0] for r in ROWS), key=lambda i: (i is not None, i))
    assert [r["start"] for r in rows] == [sum(x["n_tokens"] for x in rows[:i]) for i in range(len(rows))]
    assert all(r["ids"][-1] == 2 and len(r["ids"]) == r["n_tokens"] for r in rows)
    empty = fresh_path(spark)
    token_files.write_token_files(none, empty, BYTE_BPE)
    assert token_files.read_token_files(spark, empty).count() == 0


def test_counts(spark, docs, none):
    out = token_counts.recount_masked(docs, BYTE_BPE, "cat|[0-9]{3,}", "dog")
    found = _by_id(out, "n_edits")
    assert len(found) == len(ROWS)
    assert (1, 1) in found and (1, 0) in found and (None, 1) in found and (2, 0) in found and (5, 1) in found
    assert token_counts.recount_masked(none, BYTE_BPE, "a", "b").count() == 0
    by_id = {r["doc_id"]: r for r in out.filter("doc_id IS NULL OR n_edits = 1 AND doc_id = 1").collect()}
    assert by_id[None]["n_tokens_masked"] == by_id[1]["n_tokens_masked"]  # the same text under no id
    edits = spark.createDataFrame([(1, 0, 3, None), (1, 2, 9, "A"), (99, 0, 1, "x"), (None, 0, 1, "x"), (3, None, 1, "x"), (7, 500, 900, " end")], "doc_id long, start long, stop long, replacement string")
    after = token_counts.apply_edits(docs, token_counts.count_trees(docs, BYTE_BPE), edits, BYTE_BPE)
    assert sorted(r["text"] for r in after.collect()) == sorted(["A" + ROWS[0][1][9:], "A" + ROWS[9][1][9:], ROWS[8][1] + " end", "x" + ROWS[0][1][1:]])


def test_nearest(spark):
    rows = [(1, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [2.0, 0.0]), (4, [2.0, 0.0]), (5, [0.0, 0.0]), (6, None), (7, [1.0, None]),
            (8, [math.nan, 1.0]), (9, [math.inf, 1.0]), (10, [1.0]), (None, [1.0, 1.0]), (11, [-0.0, 1.0])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("score", F.lit("mine"))
    found = nearest.nearest(table, table.filter("vec_id IN (1, 2, 5, 10)")).collect()
    ordered = sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in found)
    assert ordered == [
        (1, 1, 3, 2.0), (1, 2, 4, 2.0), (1, 3, 2, 0.0), (1, 4, 11, 0.0),
        (2, 1, 11, 1.0), (2, 2, 1, 0.0), (2, 3, 3, 0.0), (2, 4, 4, 0.0),
    ]
    assert nearest.nearest(table.limit(0), table).count() == 0 and nearest.nearest(table, table.limit(0)).count() == 0


def test_urls(spark):
    pages = spark.createDataFrame(
        [(1, None, None), (2, "no scheme", ""), (None, "http://A.org/x", "<html>"), (3, "ftp://B.com", None), (3, "ftp://B.com", None)],
        "page_id long, url string, html string",
    ).withColumn("rule", F.lit("mine"))
    out = url_filters.judge_urls(pages, [("block", "b.com", "")])
    assert sorted(map(repr, (tuple(r) for r in out.collect()))) == sorted(
        map(repr, [(1, "", "", None, "allow", False), (2, "", "", None, "allow", False), (None, "a.org", "/x", None, "allow", False),
                   (3, "b.com", "", "b.com", "block", False), (3, "b.com", "", "b.com", "block", False)])
    )
    assert url_filters.judge_urls(pages.limit(0), []).count() == 0
    assert {r["verdict"] for r in url_filters.judge_urls(pages, []).collect()} == {"allow"}


def test_the_code_of_page_links_compiles(spark):
    """Without the fallback to interpreted rows a projection that is too large would raise."""
    pages = [(1, "http://a.net/x/y", '<link rel="canonical" href="z?q=1">'), (2, "http://b.net", "<meta http-equiv=refresh content='0; url=//c.net/d'>"), (3, None, None)]
    frame = spark.createDataFrame(pages, "page_id long, url string, html string")
    spark.conf.set("spark.sql.codegen.fallback", "false")
    try:
        found = sorted(tuple(r) for r in url_filters.page_links(frame).collect())
    finally:
        spark.conf.unset("spark.sql.codegen.fallback")
    assert found == [("http://a.net/x/y", "http://a.net/x/z?q=1"), ("http://b.net", "http://c.net/d")]
