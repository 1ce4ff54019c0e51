"""Token counts that follow edits.

A text is cut into segments at blanks where no pre-token crosses. Their counts are the leaves of a
segment tree kept for each document, next to their lengths. An edit encodes the segments it touches
again, as far as the characters around their cuts changed, and renews the sums above them.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dealerscope.llm.common import arrow_batch, materialise, texts_of
from dealerscope.llm.tokens import encoder

SEGMENT = 256  # characters, or a little more up to the next cut
_CUT = re.compile(r"(?<=\S) (?=\S)")  # the blank starts the next segment


class CountTree:
    """``tokens`` and ``chars`` as binary trees in arrays: node 1 is the root, node i has 2i and 2i + 1."""

    def __init__(self, tokens: list[int], chars: list[int]):
        self.leaves = 1 << max(0, len(tokens) - 1).bit_length()
        self.tokens, self.chars = self._sums(tokens), self._sums(chars)

    def _sums(self, leaves: list[int]) -> np.ndarray:
        sums = np.zeros(2 * self.leaves, np.int64)
        sums[self.leaves : self.leaves + len(leaves)] = leaves
        level = self.leaves
        while level > 1:
            sums[level // 2 : level] = sums[level : 2 * level : 2] + sums[level + 1 : 2 * level : 2]
            level //= 2
        return sums

    @classmethod
    def stored(cls, tokens: list[int], chars: list[int]) -> CountTree:
        tree = cls.__new__(cls)
        tree.tokens, tree.chars = np.array(tokens, np.int64), np.array(chars, np.int64)
        tree.leaves = len(tokens) // 2
        return tree

    def find(self, place: int) -> tuple[int, int]:
        """The leaf that holds a character, and where the leaf starts."""
        node, start = 1, 0
        while node < self.leaves:
            node *= 2
            if place - start >= self.chars[node] and self.chars[node + 1]:
                start += int(self.chars[node])
                node += 1
        return node - self.leaves, start

    def put(self, leaf: int, tokens: int, chars: int) -> None:
        node = self.leaves + leaf
        tokens, chars = tokens - int(self.tokens[node]), chars - int(self.chars[node])
        while node:
            self.tokens[node] += tokens
            self.chars[node] += chars
            node //= 2


def segments(text: str) -> list[str]:
    out, last = [], 0
    while found := _CUT.search(text, last + SEGMENT):
        out.append(text[last : found.start()])
        last = found.start()
    return [*out, text[last:]]


def build_tree(text: str, tokenizer: str) -> CountTree:
    parts = segments(text)
    encode = encoder(tokenizer).encode
    return CountTree([len(encode(p)) // 4 for p in parts], [len(p) for p in parts])


def edit_tree(tree: CountTree, text: str, edits: list[tuple[int, int, str]], tokenizer: str) -> tuple[str, int]:
    """Applies edits to a text and its tree: the new text, and how many characters were encoded.

    Edits are (start, stop, replacement) in places of the given text, in order. One that reaches
    back into an earlier one starts where that ends; places beyond the text are its end.
    """
    clean: list[tuple[int, int, str]] = []
    at = 0
    for start, stop, new in sorted(edits):
        start = min(max(start, at, 0), len(text))
        stop = min(max(stop, start), len(text))
        clean.append((start, stop, new))
        at = stop
    # regions of whole segments; a cut stays one if the characters before, at and after it stay
    regions: list[list] = []
    for start, stop, new in clean:
        left, begin = tree.find(max(0, start - 1))
        while left and start < begin + 2:
            left, begin = tree.find(begin - 1)
        right, first = tree.find(min(stop, max(0, len(text) - 1)))
        end = first + int(tree.chars[tree.leaves + right])
        while end < len(text) and end - 1 < stop:
            right, first = tree.find(end)
            end = first + int(tree.chars[tree.leaves + right])
        if regions and left <= regions[-1][1]:
            if right > regions[-1][1]:
                regions[-1][1], regions[-1][3] = right, end
            regions[-1][4].append((start, stop, new))
        else:
            regions.append([left, right, begin, end, [(start, stop, new)]])
    encode = encoder(tokenizer).encode
    pieces, last, encoded = [], 0, 0
    for left, right, begin, end, changes in regions:
        pieces.append(text[last:begin])
        body, at = [], begin
        for start, stop, new in changes:
            body += [text[at:start], new]
            at = stop
        region = "".join([*body, text[at:end]])
        encoded += len(region)
        pieces.append(region)
        last = end
        parts = segments(region)
        room = right - left + 1
        if len(parts) > room:  # more segments than leaves: the last leaf takes the rest
            parts = [*parts[: room - 1], "".join(parts[room - 1 :])]
        for i in range(room):
            part = parts[i] if i < len(parts) else ""
            tree.put(left + i, len(encode(part)) // 4, len(part))
    pieces.append(text[last:])
    return "".join(pieces), encoded


def _built(batches: Iterator[pa.RecordBatch], tokenizer: str) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        trees = [build_tree(text, tokenizer) for text in texts_of(batch)]
        columns = [pa.array([t.tokens for t in trees], pa.list_(pa.int64())), pa.array([t.chars for t in trees], pa.list_(pa.int64()))]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("version"), *columns], names=["doc_id", "version", "tokens", "chars"])


def _versioned(documents: DataFrame) -> DataFrame:
    version = F.xxhash64(F.coalesce("text", F.lit("")))
    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), version.alias("version"), "text")


def count_trees(documents: DataFrame, tokenizer: str) -> DataFrame:
    """(doc_id, version, tokens, chars) of every row: the trees of its whole text, null as empty.

    ``version`` is the text's hash; with the id it says which text a tree is of. ``tokens[1]`` is
    the count of the document. Only byte-level tokenizers cut at blanks in this way.
    """
    return _versioned(documents).mapInArrow(partial(_built, tokenizer=tokenizer), "doc_id long, version long, tokens array<long>, chars array<long>")


def _edited(batches: Iterator[pa.RecordBatch], tokenizer: str) -> Iterator[pa.RecordBatch]:
    names = ["doc_id", "version", "text", "tokens", "chars", "n_edits", "n_encoded"]
    for batch in batches:
        out: list[list] = [[] for _ in names]
        for row in batch.to_pylist():
            tree = CountTree.stored(row["tokens"], row["chars"])
            edits = [(e["start"], e["stop"], e["replacement"] or "") for e in row["edits"]]
            text, encoded = edit_tree(tree, row["text"] or "", edits, tokenizer)
            for column, value in zip(out, (row["doc_id"], row["version"], text, tree.tokens, tree.chars, len(edits), encoded)):
                column.append(value)
        types = (pa.int64(), pa.int64(), pa.string(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.int64(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types)], names=names)


def apply_edits(documents: DataFrame, trees: DataFrame, edits: DataFrame, tokenizer: str) -> DataFrame:
    """(doc_id, version, text, tokens, chars, n_edits, n_encoded) of the edited documents.

    ``edits`` has doc_id, start, stop and replacement (null: deletion), in places of the text that
    ``documents`` has, and may name the text's version. A document's edits are gathered; those of
    an unknown id, or without places, do nothing. A null id is an id like others. ``version`` is
    still that of the text before. Repeated rows give one.
    """
    names = ["doc_id", "version"] if "version" in edits.columns else ["doc_id"]
    known = edits.filter("start IS NOT NULL AND stop IS NOT NULL").withColumn("doc_id", F.col("doc_id").cast("long"))
    # as a struct a key equals itself even where the id is null
    changes = known.groupBy(F.struct(*names).alias("of")).agg(F.collect_list(F.struct("start", "stop", "replacement")).alias("edits"))
    frame = _versioned(documents).dropDuplicates().withColumns({"of": F.struct(*names), "key": F.struct("doc_id", "version")})
    once = trees.select(F.struct("doc_id", "version").alias("key"), "tokens", "chars").dropDuplicates(["key"])
    joined = frame.join(changes, "of").join(once, "key").drop("of", "key")
    schema = "doc_id long, version long, text string, tokens array<long>, chars array<long>, n_edits long, n_encoded long"
    return joined.mapInArrow(partial(_edited, tokenizer=tokenizer), schema)


_SPANS = pa.schema([("doc_id", pa.int64()), ("version", pa.int64()), ("start", pa.int64()), ("stop", pa.int64()), ("replacement", pa.string())])


def _spans(batches: Iterator[pa.RecordBatch], pattern: str, replacement: str) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = zip(batch.column("doc_id").to_pylist(), batch.column("version").to_pylist(), texts_of(batch))
        found = [(doc_id, version, m.start(), m.end(), replacement) for doc_id, version, text in rows for m in re.finditer(pattern, text)]
        yield arrow_batch(_SPANS, *(map(list, zip(*found)) if found else [[]] * 5))


def masking_edits(documents: DataFrame, pattern: str, replacement: str) -> DataFrame:
    """An edit for every match of a pattern, as (doc_id, version, start, stop, replacement)."""
    schema = "doc_id long, version long, start long, stop long, replacement string"
    return _versioned(documents).dropDuplicates().mapInArrow(partial(_spans, pattern=pattern, replacement=replacement), schema)


def recount_masked(documents: DataFrame, tokenizer: str, pattern: str, replacement: str) -> DataFrame:
    """(doc_id, n_tokens, n_tokens_masked, n_edits, n_encoded) of every row.

    All texts are counted once and their trees written. Then what ``pattern`` matches (a regular
    expression that Java and Python read alike) is masked, and only the regions around the matches
    are encoded again. Rows of one id and different texts are told apart by the text; a null id is
    an id like others.
    """
    trees = materialise(count_trees(documents, tokenizer))
    touched = documents.filter(F.col("text").rlike(pattern))
    after = apply_edits(touched, trees, masking_edits(touched, pattern, replacement), tokenizer)
    key = F.struct("doc_id", "version").alias("key")
    after = after.select(key, F.col("tokens")[1].alias("masked"), "n_edits", "n_encoded")
    counted = trees.select("doc_id", key, F.col("tokens")[1].alias("n_tokens")).join(after, "key", "left")
    return counted.select(
        "doc_id", "n_tokens", F.coalesce("masked", "n_tokens").alias("n_tokens_masked"),
        F.coalesce("n_edits", F.lit(0)).alias("n_edits"), F.coalesce("n_encoded", F.lit(0)).alias("n_encoded"),
    )
