"""Removal of repeated runs of lines, found by winnowing over line hashes. DataFrame functions only.

A run counts if its lines hold ``min_words`` words. From every line the shortest such run on, and
to every line the shortest one back, is a window; its fingerprint is the least hash of its lines.
Equal windows have equal fingerprints, so a run that occurs twice shares a fingerprint in two
places. Only windows around such fingerprints are compared, by all their line hashes. The windows forward and back
reach both ends of a repeated run, so together they are the match extended both ways.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dealerscope.llm.common import materialise

MIN_WORDS = 25


def _keyed(documents: DataFrame) -> DataFrame:
    """A document is known by its id and its text's hash."""
    return documents.withColumn("text_hash_", F.xxhash64("text"))


def line_windows(documents: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """(doc_id, text_hash_, back, at, first, last, content, mark, mark_at) for every window.

    Lines end at a newline and are compared without blanks around them; empty lines are skipped.
    ``at`` is the number of the window's first line that is not empty, ``first`` and ``last`` are
    places of lines in the text. ``content`` is a hash of 128 bits over the hashes of the window's lines.
    """
    lines = _keyed(documents.select("doc_id", "text")).filter("text IS NOT NULL").withColumn(
        "item", F.expr(r"filter(transform(split(text, '\n'), (x, i) -> struct(i AS at, trim(BOTH ' \t\r' FROM x) AS line)), x -> x.line <> '')")
    )
    columns = lines.filter("size(item) > 0").select(
        "doc_id",
        "text_hash_",
        F.expr("item.at").alias("at"),
        F.expr("transform(item, x -> xxhash64(x.line))").alias("hash"),
        F.expr(r"transform(item, x -> size(split(x.line, '\\s+')))").alias("words"),
    )
    # how many lines it takes; none if the text ends before
    fold = "(s, x) -> if(s.sum >= {w}, s, struct(s.sum + x AS sum, s.many + 1 AS many)), s -> if(s.sum >= {w}, s.many, 0)".format(w=min_words)
    start = "struct(0 AS sum, 0 AS many)"
    ahead = f"aggregate(slice(words, i, {min_words}), {start}, {fold})"
    back = f"aggregate(reverse(slice(words, greatest(i - {min_words} + 1, 1), least(i, {min_words}))), {start}, {fold})"
    spans = F.expr(
        f"flatten(transform(sequence(1, size(words)), i -> array("
        f"named_struct('back', false, 'end', i, 'many', {ahead}), named_struct('back', true, 'end', i, 'many', {back}))))"
    )
    spans = columns.withColumn("span", F.explode(F.filter(spans, lambda s: s["many"] > 0)))
    spans = spans.select(
        "doc_id", "text_hash_", "at", "hash", "span.back", "span.many",
        F.expr("if(span.back, span.end - span.many + 1, span.end)").alias("from"),
    )
    spans = spans.withColumn("inside", F.expr("slice(hash, from, many)")).withColumn("mark", F.array_min("inside"))
    return spans.select(
        "doc_id", "text_hash_", "back", F.col("from").alias("window"),
        F.expr("at[from - 1]").alias("first"), F.expr("at[from + many - 2]").alias("last"),
        F.struct(F.xxhash64("inside"), F.xxhash64(F.lit(1), "inside")).alias("content"), "mark",
        (F.col("from") + F.array_position("inside", F.col("mark"))).cast("int").alias("mark_at"),
    )


def repeated_lines(documents: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """(doc_id, text_hash_, lines): the places of lines to delete, for documents that have some.

    Of the places where a window's content occurs, the first by (doc_id, text hash, line) stays;
    a null id is before all others.
    """
    windows = materialise(line_windows(documents, min_words))
    place = F.struct("doc_id", "text_hash_", "mark_at")
    marks = windows.groupBy("mark").agg(F.min(place).alias("low"), F.max(place).alias("high"))
    candidates = windows.join(marks.filter("low <> high").select("mark"), "mark", "left_semi")
    here = F.struct("doc_id", "text_hash_", "window")
    firsts = candidates.groupBy("back", "content").agg(F.min(here).alias("earliest"), F.max(here).alias("latest"))
    met = candidates.join(firsts.filter("earliest <> latest"), ["back", "content"])
    later = met.filter(here != F.col("earliest")).select("doc_id", "text_hash_", F.explode(F.sequence("first", "last")).alias("line"))
    return later.groupBy("doc_id", "text_hash_").agg(F.collect_set("line").alias("lines"))


def dedup_lines(documents: DataFrame, min_words: int = MIN_WORDS, removed: str = "lines_removed") -> DataFrame:
    """All rows and columns of ``documents``, the text without later repeated runs, and how many lines went.

    A line goes if it lies in a run of lines with ``min_words`` words or more that occurs earlier,
    in a document before or further up (it may overlap itself: of one line again and again, the
    first stays); an empty line goes with the run around it. What is left
    keeps its order and newlines, a text may become empty, null stays null. Rows with the same id
    and text are one document and end alike. ``removed`` names the column of the count; a column of
    that name is replaced, all others are kept whatever their names.
    """
    own = uuid.uuid4().hex  # no column of the documents has such a name
    hashed, lines, gone_id, gone_hash, gone = (f"{name}_{own}" for name in ("hash", "lines", "gone_id", "gone_hash", "gone"))
    keyed = documents.drop(removed).withColumn(hashed, F.xxhash64("text"))
    deleted = repeated_lines(documents, min_words).toDF(gone_id, gone_hash, gone)
    same = F.col("doc_id").eqNullSafe(F.col(gone_id)) & (F.col(hashed) == F.col(gone_hash))
    joined = keyed.join(deleted, same, "left").withColumn(lines, F.when(F.col(gone).isNotNull(), F.split("text", "\n")))
    kept = F.expr(rf"concat_ws('\n', transform(array_except(sequence(0, size({lines}) - 1), {gone}), i -> {lines}[i]))")
    text = F.when(F.col(gone).isNull(), F.col("text")).otherwise(kept)
    columns = [text.alias("text") if name == "text" else F.col(f"`{name}`") for name in documents.columns if name != removed]
    return joined.select(*columns, F.coalesce(F.size(gone), F.lit(0)).alias(removed))
