"""Token ids of whole texts, by the tokenizers library with a cache of words."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import regex
from tokenizers import Tokenizer

from dealerscope.llm.common import in_blocks, kept_for

END_ID = 2
_CACHED = 300_000  # words, and parts of words, that a Python worker keeps
_LONGEST = 48  # characters of a kept word
_TOGETHER = 1 << 23  # characters of texts whose distinct words are looked up together

# Characters for which a blank always ends a pre-token and nothing joins or folds across it.
_ODD = re.compile("[^\n\x20-\x7e¡-ſ]")
_MARKS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"  # ASCII punctuation that starts no contraction

# How the two kinds of tokenizer split text before their merges.
_BY_BYTE = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_BY_WORD = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"

_BYTES = {b: chr(b) for b in [*range(33, 127), *range(161, 173), *range(174, 256)]}
_BYTES |= {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in _BYTES)}
_NONE = b""


class _Words(dict):
    """Ids of words, as bytes of unsigned 32-bit integers; a missing word is encoded.

    A word is split into pre-tokens, each of which goes straight to the tokenizer's merges. The
    words met first are kept, up to a bound, frequent ones among them.
    """

    def __init__(self, tokenizer: Tokenizer, lower: bool):
        super().__init__()
        self.merge, self.lower = tokenizer.model.tokenize, lower
        self.split = regex.compile(_BY_WORD if lower else _BY_BYTE).findall
        self.parts: dict[str, bytes] = {}
        self[""] = _NONE
        size = tokenizer.get_vocab_size(with_added_tokens=True)
        self.packed = [i.to_bytes(4, "little") for i in range(size)]

    def _part(self, part: str) -> bytes:
        if part.isascii() and part.isprintable() and " " not in part:
            mapped = part
        else:
            mapped = part.encode().decode("latin-1").translate(_BYTES)
        packed = self.packed
        found = b"".join([packed[token.id] for token in self.merge(mapped)])
        if len(self.parts) < _CACHED and len(part) <= _LONGEST:
            self.parts[part] = found
        return found

    def __missing__(self, word: str) -> bytes:
        plain = word.lower() if self.lower else word
        head = plain.rstrip(_MARKS)
        if (head[1:] if head[:1] == " " else head).isalpha():
            tail = plain[len(head) :]
            found = self.parts.get(head) or self._part(head)
            if tail:
                found += self.parts.get(tail) or self._part(tail)
        else:
            found = b"".join([self.parts.get(part) or self._part(part) for part in self.split(plain)])
        if len(self) < _CACHED and len(word) <= _LONGEST:
            self[word] = found
        return found


class Encoder:
    """Encodes as ``Tokenizer.encode(text, add_special_tokens=False)`` does.

    Two kinds are known: byte-level, where a blank belongs to the word after it, and word-level,
    where white space only separates. A text of plain characters is cut at its blanks and newlines,
    where both kinds start a new pre-token, and the words are looked up; any other text, and any
    other kind of tokenizer, goes to the library whole. To the byte-level kind runs of white space
    are no plain text either, but for two newlines inside the text. Nor is a text that holds an
    added token such as <|endoftext|>, which is one id, as the library has it by default.
    """

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        self.by_word = self.tokenizer.normalizer is not None
        self.words = _Words(self.tokenizer, self.by_word)
        sample = "It's a Wörd, 12 !!\nand|more.\n\nEnd"
        added = self.tokenizer.get_added_tokens_decoder().values()
        self.added = [token.content for token in added]
        folded = self.by_word and any(token.normalized for token in added)  # found in other spellings too
        self.cuts = not folded and self._cut(sample) == self._whole(sample)

    def _whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def _cut(self, text: str) -> bytes:
        words = text.split() if self.by_word else text.replace(" ", "\0 ").replace("\n", "\0\n\0").split("\0")
        return b"".join(map(self.words.__getitem__, words))

    def _plain(self, text: str) -> bool:
        if _ODD.search(text) or any(token in text for token in self.added):
            return False
        runs = "  " in text or " \n" in text or "\n " in text or "\n\n\n" in text or text.endswith("\n\n")
        return self.by_word or not runs

    def encode(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit integers."""
        if not text:
            return _NONE
        return self._cut(text) if self.cuts and self._plain(text) else self._whole(text)

    def encode_each(self, texts: list[str]) -> list[bytes]:
        """``encode`` of each text; to the byte-level kind, plain texts go together, each distinct word once."""
        if self.by_word or not self.cuts:
            return [self.encode(text) for text in texts]
        out = [_NONE] * len(texts)
        plain = []
        for i, text in enumerate(texts):
            if len(text) <= _TOGETHER and self._plain(text):
                plain.append(i)
            else:
                out[i] = self.encode(text)
        for part in in_blocks([texts[i] for i in plain], _TOGETHER):
            mine = plain[part]
            for i, ids in zip(mine, self._cut_each([texts[i].encode() for i in mine])):
                out[i] = ids
        return out

    def _cut_each(self, raws: list[bytes]) -> list[bytes]:
        """``_cut`` of each text: words begin at a text, a blank, a newline and after a newline."""
        data = b"".join(raws)
        chars = np.frombuffer(data, np.uint8)
        ends = np.cumsum([len(raw) for raw in raws])
        cuts = np.zeros(len(data) + 1, dtype=bool)
        cuts[ends] = cuts[0] = True
        cuts[:-1] |= chars == 32
        lines = np.flatnonzero(chars == 10)
        cuts[lines] = cuts[lines + 1] = True
        at = np.flatnonzero(cuts)
        words = pa.StringArray.from_buffers(len(at) - 1, pa.py_buffer(at.astype(np.int32)), pa.py_buffer(data)).dictionary_encode()
        distinct = words.dictionary.to_numpy(zero_copy_only=False).tolist()
        ids = pa.array([self.words[word] for word in distinct], pa.large_binary()).take(words.indices)
        _, starts, packed = ids.buffers()
        starts = np.frombuffer(starts, np.int64)[ids.offset :][: len(ids) + 1]
        ends = starts[np.searchsorted(at, ends)].tolist()
        packed = packed.to_pybytes() if packed is not None else _NONE
        return [packed[a:b] for a, b in zip([int(starts[0]), *ends], ends)]


def encoder(path: str) -> Encoder:
    """One for each Python worker and file, while the worker encodes."""
    kept = kept_for("tokens")
    if path not in kept:
        kept[path] = Encoder(path)
    return kept[path]
