"""Token ids of whole texts, each distinct word encoded once per task process.

The vocabulary is a BPE with word ends, whose normaliser lowers letters and
whose words are runs of letters, single digits, runs of other characters, and
the English contractions. Texts of Latin-1 characters only are cut into those
words with array operations, and their words are looked up; a word not seen
before is encoded by the tokenizer itself. Every other text, and any text that
holds one of the special tokens' strings, is encoded by the tokenizer as a whole.
"""

from __future__ import annotations

import os
from functools import cache

import numpy as np

from cohortloom.llm.blocks import LOWER, Block, ranges, span_hashes

_SPACE, _LETTER, _DIGIT, _OTHER = 0, 1, 2, 3
_MAX_WORDS = 1_500_000
_APART = 100_000


def _latin1_classes() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Class of every ASCII byte, and of U+0080..BF and U+00C0..FF by their second byte."""
    plain = np.full(256, _OTHER, np.uint8)
    plain[[9, 10, 11, 12, 13, 32]] = _SPACE
    plain[48:58] = _DIGIT
    plain[65:91] = plain[97:123] = _LETTER
    low = np.full(256, _OTHER, np.uint8)
    low[[0x85, 0xA0]] = _SPACE
    low[[0xAA, 0xB5, 0xBA]] = _LETTER
    low[[0xB2, 0xB3, 0xB9, 0xBC, 0xBD, 0xBE]] = _DIGIT
    high = np.full(256, _LETTER, np.uint8)
    high[[0x97, 0xB7]] = _OTHER
    return plain, low, high


_PLAIN, _LOW, _HIGH = _latin1_classes()
# The contractions that the vocabulary keeps as words of their own.
_CONTRACTIONS = ("s", "t", "re", "ve", "m", "ll", "d")


class WordEncoder:
    """A tokenizer with a table of the words it has met."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(path)
        vocab = self.tokenizer.get_vocab()
        self.closing = np.zeros(max(vocab.values()) + 1, bool)
        self.closing[[i for word, i in vocab.items() if word.endswith("</w>")]] = True
        self.special = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self._clear()

    def _clear(self) -> None:
        self.keys = np.zeros(0, np.uint64)
        self.first = np.zeros(0, np.int64)
        self.count = np.zeros(0, np.int64)
        self.flat = np.zeros(0, np.uint32)

    def _encode(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)

    def _encode_words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids, begins and ends of words, one call for all; each ends with the only closing id it has."""
        ids = self._encode(b" ".join(words).decode())
        ends = np.flatnonzero(self.closing[ids]) + 1
        if len(ends) != len(words) or (len(ends) and ends[-1] != len(ids)):
            parts = [self._encode(w.decode()) for w in words]
            ids = np.concatenate(parts)
            ends = np.cumsum([len(x) for x in parts])
        return ids, np.concatenate(([0], ends[:-1])), ends

    def _learn(self, keys: np.ndarray, words: list[bytes]) -> None:
        if len(self.keys) + len(keys) > _MAX_WORDS:
            raise _TableFull
        ids, starts, ends = self._encode_words(words)
        at = np.searchsorted(self.keys, keys)
        self.first = np.insert(self.first, at, starts + len(self.flat))
        self.count = np.insert(self.count, at, ends - starts)
        self.keys = np.insert(self.keys, at, keys)
        self.flat = np.concatenate((self.flat, ids))

    def encode_block(self, block: Block) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after the other, and how many each text has."""
        direct = self._needs_tokenizer(block)
        data, begin, apart = _segment(block)
        if direct.any():
            covered = np.repeat(direct, np.diff(block.offsets))
            begin &= ~covered
        starts = np.flatnonzero(begin)
        edges = np.flatnonzero(begin | apart)
        ends = edges[np.searchsorted(edges, starts) + 1] if len(starts) else starts
        hashes = span_hashes(data, starts, ends)
        keys, sample, place = np.unique(hashes, return_index=True, return_inverse=True)
        if len(keys) > _MAX_WORDS:
            at = place
            first, count, flat = self._apart(data, starts[sample], ends[sample])
        else:
            at = self._places(keys, data, starts[sample], ends[sample])[place]
            first, count, flat = self.first, self.count, self.flat
        n_ids = count[at]
        ids = flat[np.repeat(first[at], n_ids) + ranges(n_ids)]
        owner = np.searchsorted(block.offsets, starts, "right") - 1
        per_text = np.bincount(owner, n_ids, minlength=len(block)).astype(np.int64)
        if direct.any():
            parts = np.split(ids, np.cumsum(per_text)[:-1])
            for i in np.flatnonzero(direct):
                parts[i] = self._encode(block.text(i).decode())
                per_text[i] = len(parts[i])
            ids = np.concatenate(parts)
        return ids, per_text

    def _places(self, keys, data, starts, ends) -> np.ndarray:
        for _ in range(2):
            at = np.searchsorted(self.keys, keys)
            known = np.zeros(len(keys), bool)
            inside = at < len(self.keys)
            known[inside] = self.keys[at[inside]] == keys[inside]
            if known.all():
                return at
            new = np.flatnonzero(~known)
            words = [data[starts[i] : ends[i]].tobytes() for i in new]
            try:
                self._learn(keys[new], words)
            except _TableFull:
                self._clear()
                words = [data[a:b].tobytes() for a, b in zip(starts, ends, strict=True)]
                self._learn(keys, words)
        return np.searchsorted(self.keys, keys)

    def _apart(self, data, starts, ends) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """first, count and flat of the words of one text that the table has no room for."""
        first, count, flat, n = [], [], [], 0
        for i in range(0, len(starts), _APART):
            spans = zip(starts[i : i + _APART], ends[i : i + _APART], strict=True)
            ids, begin, end = self._encode_words([data[a:b].tobytes() for a, b in spans])
            first.append(begin + n)
            count.append(end - begin)
            flat.append(ids)
            n += len(ids)
        return np.concatenate(first), np.concatenate(count), np.concatenate(flat)

    def _needs_tokenizer(self, block: Block) -> np.ndarray:
        out = np.zeros(len(block), bool)
        far = np.flatnonzero(block.data > 0xC3)
        out[np.searchsorted(block.offsets, far, "right") - 1] = True
        raw = block.data.tobytes()
        for mark in self.special:
            at = raw.find(mark)
            while at >= 0:
                out[np.searchsorted(block.offsets, at, "right") - 1] = True
                at = raw.find(mark, at + 1)
        return out


class _TableFull(Exception):
    pass


def _segment(block: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lowered bytes, where words begin, and which bytes are white space."""
    data = LOWER[block.data]
    n = len(data)
    kind = _PLAIN[data]
    lead = np.flatnonzero(data >= 0xC2)
    lead = lead[lead + 1 < n]
    second = data[lead + 1]
    kind[lead] = np.where(data[lead] == 0xC2, _LOW[second], _HIGH[second])
    kind[lead + 1] = kind[lead]
    # U+00C0..DE but the multiplication sign become U+00E0..FE.
    upper = lead[(data[lead] == 0xC3) & (second <= 0x9E) & (second != 0x97)]
    data[upper + 1] += 32
    begin = np.empty(n, bool)
    begin[:1] = True
    begin[1:] = (kind[1:] != kind[:-1]) | (kind[1:] == _DIGIT)
    begin[lead + 1] = False
    apart = kind == _SPACE
    begin &= ~apart
    quote = np.flatnonzero((data == 39) & begin)
    quote = quote[quote + 1 < n]
    quote = quote[kind[quote + 1] == _LETTER]
    for ending in _CONTRACTIONS:
        raw = ending.encode()
        hit = quote[quote + len(raw) < n]
        for i, byte in enumerate(raw):
            hit = hit[data[hit + 1 + i] == byte]
        begin[hit + 1] = False
        rest = hit + 1 + len(raw)
        rest = rest[rest < n]
        begin[rest[kind[rest] == _LETTER]] = True
    return data, begin, apart


@cache
def encoder(path: str) -> WordEncoder:
    """The encoder of this process; its word table serves all tasks that run in it."""
    return WordEncoder(path)
