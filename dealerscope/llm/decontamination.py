"""Benchmark decontamination: every training passage is a query to a BM25 index of test items.

An item's impacts are scaled so that a passage with all its words scores 1, so one threshold holds
for short and long items. Passages overlap by half and are twice as long as the longest item, so a
leaked item lies in one of them whole.
"""

from __future__ import annotations

import uuid
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dealerscope.llm.common import arrow_batch, in_blocks, materialise, shingle_hashes, texts_of, word_hashes

SHINGLE = 5
OVERLAP = 0.75  # of the question's shingles, and of the answer's words
WHOLE = 0.75  # of the shingles of an item without a given answer
THRESHOLD = 0.5  # of an item's own score
K1, B = 1.2, 0.75
POSTINGS = 2_000_000  # of one index; more items make more indexes, each queried by all passages
_BLOCK = 64  # postings under one maximum
_DONE = 1 << 62  # the current item of a list at its end
_ESSENTIAL = 0.8  # of an item's score lies in its essential words


def _split(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Without a given answer, an item's last third is its answer; an item without a whole shingle is both."""
    if len(words) < SHINGLE:
        return words, words
    cut = len(words) - -(-len(words) // 3)
    return words[:cut], words[cut:]


def _held(part: np.ndarray, words: np.ndarray) -> float:
    """Share of the shingles of a part of an item that the words have."""
    n = min(SHINGLE, len(part))
    return float(np.isin(np.unique(shingle_hashes(part, n)), shingle_hashes(words, n)).mean())


def _item_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["item_id", "term", "times", "length"]
    for batch in batches:
        rows = [[], [], [], []]
        words, starts = word_hashes(texts_of(batch), plain=True)
        for item, a, b in zip(batch.column("item_id").to_pylist(), starts[:-1].tolist(), starts[1:].tolist()):
            if b > a:
                terms, times = np.unique(words[a:b], return_counts=True)
                for row, values in zip(rows, ([item] * len(terms), terms.view(np.int64), times, [b - a] * len(terms))):
                    row.append(pa.array(values, pa.int64()))
        columns = [pa.concat_arrays(row) if row else pa.array([], pa.int64()) for row in rows]
        yield pa.RecordBatch.from_arrays(columns, names=names)


@dataclass
class Index:
    """Postings by term, with block maxima; what verification needs of each item; essential postings."""

    item_ids: np.ndarray
    questions: list[np.ndarray]
    answers: list[np.ndarray]
    wholes: list[np.ndarray]
    given: list[bool]  # the answer is not a part of the item's text
    longest: int
    terms: np.ndarray  # sorted hashes
    first: np.ndarray  # of each term's postings, one more for the end
    items: np.ndarray
    impacts: np.ndarray
    essential: np.ndarray  # of the postings
    need: np.ndarray  # an item's least essential score for the threshold

    def __post_init__(self) -> None:
        self.lists: dict[int, tuple] = {}
        keep = np.concatenate(([0], np.cumsum(self.essential)))
        self.essential_first = keep[self.first]
        self.essential_items, self.essential_impacts = self.items[self.essential], self.impacts[self.essential]
        self.maybe = np.zeros(1 << 20, dtype=bool)
        used = self.terms[np.diff(self.essential_first) > 0]
        self.maybe[(used >> np.uint64(44)).astype(np.int64)] = True

    def list_of(self, term: int) -> tuple:
        """A term's items, impacts, block maxima and largest impact, as the search reads them."""
        if term not in self.lists:
            a, b = int(self.first[term]), int(self.first[term + 1])
            impacts = self.impacts[a:b]
            blocks = np.maximum.reduceat(impacts, np.arange(0, b - a, _BLOCK))
            self.lists[term] = (self.items[a:b].tolist(), impacts.tolist(), blocks.tolist(), float(impacts.max()))
        return self.lists[term]

    def lookup(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place, term number) of the words that may have essential postings."""
        place = np.flatnonzero(self.maybe[(words >> np.uint64(44)).astype(np.int64)])
        at = np.minimum(np.searchsorted(self.terms, words[place]), len(self.terms) - 1)
        hit = self.terms[at] == words[place]
        return place[hit], at[hit]

    def search(self, words: np.ndarray, threshold: float) -> list[tuple[int, float]]:
        """All (item, score) with a score of the threshold or more, by block-max WAND.

        Lists are kept in order of their current item. The first at which the lists' largest
        impacts reach the threshold is the pivot; if the impacts of the blocks around it do not,
        the lists skip to the end of the nearest block.
        """
        found = np.unique(words)
        at = np.minimum(np.searchsorted(self.terms, found), len(self.terms) - 1)
        # of each list: current item, its place, the items, their impacts, block maxima, largest impact
        cursors = [[lists[0][0], 0, *lists] for lists in map(self.list_of, at[self.terms[at] == found].tolist())]
        out: list[tuple[int, float]] = []

        def skip(cursor: list, item: int) -> None:
            if cursor[0] < item:
                cursor[1] = bisect_left(cursor[2], item, cursor[1])
                cursor[0] = cursor[2][cursor[1]] if cursor[1] < len(cursor[2]) else _DONE

        while True:
            cursors.sort(key=itemgetter(0))
            while cursors and cursors[-1][0] == _DONE:
                cursors.pop()
            total, pivot = 0.0, -1
            for i, cursor in enumerate(cursors):
                total += cursor[5]
                if total >= threshold:
                    pivot = i
                    break
            if pivot < 0:
                return out
            item = cursors[pivot][0]
            while pivot + 1 < len(cursors) and cursors[pivot + 1][0] == item:
                pivot += 1
            bound, nearest = 0.0, _DONE if pivot + 1 == len(cursors) else cursors[pivot + 1][0]
            for now, place, items, _, blocks, _ in cursors[: pivot + 1]:
                ahead = place if now == item else bisect_left(items, item, place)
                if ahead < len(items):
                    block = ahead // _BLOCK
                    bound += blocks[block]
                    nearest = min(nearest, items[min((block + 1) * _BLOCK, len(items)) - 1] + 1)
            if bound < threshold:
                for cursor in cursors[: pivot + 1]:
                    skip(cursor, max(nearest, item + 1))
                continue
            score = 0.0
            for cursor in cursors[: pivot + 1]:
                skip(cursor, item)
                if cursor[0] == item:
                    score += cursor[3][cursor[1]]
                    skip(cursor, item + 1)
            if score >= threshold:
                out.append((item, score))

    def overlaps(self, words: np.ndarray, item: int) -> tuple[float, float]:
        """Shares of the question's shingles and of the answer's words that the passage has."""
        question, answer = self.questions[item], self.answers[item]
        return _held(question, words), float(np.isin(answer, words).mean())

    def whole_overlap(self, words: np.ndarray, item: int) -> float:
        """Share of the shingles of an item without a given answer that the passage has."""
        return 0.0 if self.given[item] else _held(self.wholes[item], words)


def _build(items: list[tuple[int, str, str | None]], postings: pa.Table, mean_length: float, many: int, threshold: float) -> Index:
    ids = np.array([i[0] for i in items], np.int64)
    words, starts = word_hashes([i[1] for i in items], plain=True)
    parts = [_split(words[a:b]) for a, b in zip(starts[:-1], starts[1:])]
    has_answer = [False] * len(items)
    for i, (_, text, answer) in enumerate(items):
        if answer is not None and len(given := word_hashes([answer], plain=True)[0]):
            parts[i] = (words[starts[i] : starts[i + 1]], given)
            has_answer[i] = True
    column = {name: postings.column(name).to_numpy() for name in ("item_id", "term", "times", "length", "df")}
    item = np.searchsorted(ids, column["item_id"])
    idf = np.log(1 + (many - column["df"] + 0.5) / (column["df"] + 0.5))
    impact = idf * column["times"] * (K1 + 1) / (column["times"] + K1 * (1 - B + B * column["length"] / mean_length))
    impact /= np.bincount(item, weights=impact, minlength=len(ids))[item]
    # the rarest words of an item, until they hold the essential share of its score
    order = np.lexsort((column["term"], column["df"], item))
    before = np.cumsum(impact[order]) - impact[order]
    before -= before[np.searchsorted(item[order], item[order])]
    essential = np.zeros(len(item), dtype=bool)
    essential[order] = before < _ESSENTIAL
    held = np.bincount(item[essential], weights=impact[essential], minlength=len(ids))
    terms = column["term"].view(np.uint64)
    order = np.lexsort((item, terms))
    unique, first = np.unique(terms[order], return_index=True)
    return Index(
        ids, [p[0] for p in parts], [p[1] for p in parts], [words[a:b] for a, b in zip(starts[:-1], starts[1:])], has_answer, int(np.diff(starts).max(initial=1)), unique,
        np.concatenate((first, [len(order)])), item[order], impact[order], essential[order], threshold - (1 - held) - 1e-9,
    )


_FOUND = pa.schema(
    [("doc_id", pa.int64()), ("item_id", pa.int64()), ("score", pa.float64()), ("question_overlap", pa.float64()), ("answer_overlap", pa.float64())]
)


def _leaks(batches: Iterator[pa.RecordBatch], shared: Broadcast, threshold: float, overlap: float, whole: float | None) -> Iterator[pa.RecordBatch]:
    index: Index = shared.value
    stride = max(64, index.longest)
    many = len(index.item_ids)
    for batch in batches:
        ids, rows = batch.column("doc_id").to_pylist(), []
        texts = texts_of(batch)
        for part in in_blocks(texts):
            words, starts = word_hashes(texts[part], plain=True)
            lengths = np.diff(starts)
            passages = np.maximum(1, -(-lengths // stride) - 1)
            base = np.cumsum(passages) - passages
            place, term = index.lookup(words)
            doc = np.searchsorted(starts, place, side="right") - 1
            in_doc = (place - starts[doc]) // stride
            size = np.diff(index.essential_first)[term]
            posting = np.repeat(index.essential_first[term] - (np.cumsum(size) - size), size) + np.arange(size.sum())
            item, impact = index.essential_items[posting], index.essential_impacts[posting]
            codes, weights = [], []
            for step in (0, 1):  # a word is in two passages
                at = in_doc - step
                inside = np.repeat((at >= 0) & (at < passages[doc]), size)
                codes.append((np.repeat(base[doc] + at, size) * many + item)[inside])
                weights.append(impact[inside])
            pairs, index_of = np.unique(np.concatenate(codes), return_inverse=True)
            sums = np.bincount(index_of, weights=np.concatenate(weights), minlength=len(pairs))
            likely = np.unique(pairs[sums >= index.need[pairs % many]] // many)
            best: dict[tuple[int, int], tuple[float, float, float]] = {}
            for passage in likely.tolist():
                d = int(np.searchsorted(base, passage, side="right")) - 1
                start = int(starts[d]) + (passage - int(base[d])) * stride
                body = words[start : min(start + 2 * stride, int(starts[d + 1]))]
                for item_at, score in index.search(body, threshold):
                    asked, answered = index.overlaps(body, item_at)
                    split = asked >= overlap and answered >= overlap
                    if split or (whole is not None and index.whole_overlap(body, item_at) >= whole):
                        best[d, item_at] = max(best.get((d, item_at), (0, 0, 0)), (asked, answered, score))
            for (d, item_at), (asked, answered, score) in sorted(best.items()):
                rows.append((ids[part.start + d], int(index.item_ids[item_at]), round(score, 6), round(asked, 6), round(answered, 6)))
        yield arrow_batch(_FOUND, *(map(list, zip(*rows)) if rows else [[]] * 5))


def find_leaks(
    documents: DataFrame, items: DataFrame, threshold: float = THRESHOLD, overlap: float = OVERLAP, whole: float | None = None
) -> DataFrame:
    """(doc_id, item_id, score, question_overlap, answer_overlap) for every leaked item of every document.

    ``items`` has item_id and text, and may have an answer; without one the last third of the
    words is the answer. Words are runs of characters other than ASCII white space and punctuation,
    lower-cased. A passage that scores ``threshold`` of an item's own BM25 score, and holds
    ``overlap`` of the question's 5-word shingles and of the answer's words, leaks the item; the
    best passage of a document is given. With ``whole``, so does one that scores as much and holds
    that share of all shingles of an item without a given answer, as a changed word breaks five
    shingles and may be in the question. An item of one to four words is one shingle, question and
    answer alike: a passage that holds it whole leaks it. Null texts and texts without words leak
    nothing; repeated items count once, repeated documents are searched each.

    The index is built from counts that Spark makes over all items, and sent to all tasks in parts
    of about POSTINGS postings; a larger item set is searched part by part, each by all documents.
    """
    spark = documents.sparkSession
    answer = F.col("answer") if "answer" in items.columns else F.lit(None)
    once = items.groupBy(F.col("item_id").cast("long").alias("item_id")).agg(
        F.min(F.struct("text", answer.cast("string").alias("answer"))).alias("row")
    )
    once = materialise(once.filter("item_id IS NOT NULL AND row.text IS NOT NULL").select("item_id", "row.text", "row.answer"))
    terms = materialise(once.mapInArrow(_item_terms, "item_id long, term long, times long, length long"))
    sizes = terms.groupBy("item_id").agg(F.first("length").alias("length"), F.count(F.lit(1)).alias("terms"))
    many, mean_length, postings = sizes.agg(F.count(F.lit(1)), F.avg("length"), F.sum("terms")).first()
    found = spark.createDataFrame([], "doc_id long, item_id long, score double, question_overlap double, answer_overlap double")
    shards = -(-(postings or 0) // POSTINGS)
    shard = F.pmod(F.xxhash64("item_id"), F.lit(shards))
    counted = terms.join(terms.groupBy("term").agg(F.count(F.lit(1)).alias("df")), "term")
    for number in range(shards):
        part = counted.filter(shard == number).toArrow()
        kept = sizes.select("item_id").filter(shard == number)
        rows = [tuple(r) for r in once.join(kept, "item_id", "left_semi").orderBy("item_id").collect()]
        if rows:
            shared = spark.sparkContext.broadcast(_build(rows, part, mean_length, many, threshold))
            frame = documents.select(F.col("doc_id").cast("long"), "text")
            search = lambda batches, shared=shared: _leaks(batches, shared, threshold, overlap, whole)
            leaks = frame.mapInArrow(search, found.schema)
            found = leaks if number == 0 else found.union(leaks)
    return found


def decontaminate(documents: DataFrame, items: DataFrame) -> DataFrame:
    """The documents that leak no item, with all their columns, whatever their names.

    A document is known by its text, so null ids do no harm and repeated rows end alike; null and
    empty texts stay, and without items all documents do.
    """
    texts = documents.select(F.xxhash64("text").alias("doc_id"), "text")
    leaked = f"leaked_{uuid.uuid4().hex}"  # no column of the documents has such a name
    leaks = materialise(find_leaks(texts, items, whole=WHOLE).select(F.col("doc_id").alias(leaked)).distinct())
    return documents.join(leaks, F.xxhash64("text") == F.col(leaked), "left_anti")
