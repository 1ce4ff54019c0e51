"""A training corpus from raw documents: five stages, each written and read again."""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dealerscope.llm import decontamination, language_id, line_dedup, packing, shingle_join
from dealerscope.llm.common import read_table, share_package
from dealerscope.sources.durable import fresh_path

NOISE = language_id.DIMENSIONS**-0.5  # deviation of the cosine of two texts that share no trigram
MOST = 0.1  # no text of a cosine of this or more is taken for foreign


def _foreign(score: Column, letters: Column) -> Column:
    """Whether a text's best cosine is too low for its number of letters.

    In a learned language the cosine grows as the root of the letters, by 0.015 at least, less three
    deviations of noise: at most about one such text in a thousand is below. That is negative up to 41
    letters, where noise alone decides and no text is taken for foreign. From 166 letters on the
    bound is MOST, which a text without a known trigram reaches about once in a thousand.
    """
    return score < F.least(F.lit(MOST), 0.015 * F.sqrt(letters) - 3.1 * NOISE)


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the texts that have no letter or are like none of the languages that ``lang`` names.

    Where ``lang`` names no language of any text with letters, every text that has a letter is
    kept. Null and empty texts have no letter and go; repeated rows end alike; all columns are kept.
    """
    share_package(spark)
    profiles = language_id.learn_profiles(docs, F.lit(True))
    if not profiles.languages:
        return docs.filter(F.col("text").rlike(r"\p{L}"))
    own = uuid.uuid4().hex  # no column of the documents has such a name
    lang, score = f"lang_{own}", f"score_{own}"
    scored = language_id.predict_language(docs, profiles, into=(lang, score))
    letters = F.regexp_count("text", F.lit(r"\p{L}")).cast("double")
    return scored.filter((F.col(lang) != "und") & ~_foreign(F.col(score), letters)).select(_own(docs))


def _own(docs: DataFrame) -> list[Column]:
    return [F.col(f"`{name}`") for name in docs.columns]


def without_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of runs of lines go; so does a document of which nothing is left.

    A text that was null or blank before stays as it is. ``n_chars`` follows the text.
    """
    removed = f"removed_{uuid.uuid4().hex}"
    kept = line_dedup.dedup_lines(docs, removed=removed).filter(f"{removed} = 0 OR trim(BOTH ' \t\r\n' FROM text) <> ''")
    columns = [
        F.when(F.col(removed) > 0, F.length("text")).otherwise(F.col(name)).alias(name) if name == "n_chars" else F.col(f"`{name}`")
        for name in docs.columns
    ]
    return kept.select(columns)


def one_of_similar(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group joined by similarity of 5-word shingles: the one of the least id, a null id last.

    Of repeated rows one stays; null texts and texts without words all stay.
    """
    return shingle_join.one_of_each(docs).select(_own(docs))


def without_benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item; null and empty texts hold none, repeated rows end alike."""
    return decontamination.decontaminate(docs, read_table(spark, sf_dir, "benchmark")).select(_own(docs))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of training sequences. A null text counts as empty: its end token; repeated rows are packed each."""
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("language id", known_language),
    ("line dedup", without_repeated_lines),
    ("ngram jaccard join", one_of_similar),
    ("benchmark decontamination", without_benchmarks),
    ("packing", packed),
]

ORACLE_SQL = None  # tokens, profiles and similarity have no SQL; tests hold the stages against brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, from the table of documents to the packed pieces."""
    docs = read_table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        path = fresh_path(spark)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
