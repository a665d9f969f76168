"""Token ids of a public tokenizer file, fast: words are cut by pattern, looked up, and only new words are encoded.

A text goes the quick way only if every character is of a set for which the file's normalizer is plain lower-casing
and its pattern is known; any other text, and one that holds an added token's string, is encoded by the tokenizer
itself. Words that aren't known yet are encoded together: the merges of all words of a batch run in step, each round
merging in every word its pair of the lowest rank.
"""

from __future__ import annotations

import json
import re

import numpy as np

CACHED_WORDS = 400_000  # then the table starts anew

#: Fixed values of this tokenizer file: what its normalizer and its splitter must be for the quick way.
_NORMALIZER = ["NFC", "Replace", "Lowercase"]
_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"

_QUICK = re.compile("[^\\x09-\\x0d\\x20-\\x7e\\u00a1-\\u00a9\\u00ab-\\u00b1\\u00b4-\\u00b8\\u00bb\\u00bf-\\u012f\\u0131-\\u0148\\u014a-\\u017e\\u2010-\\u2027]")
_SPLIT = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_]+|\d|(?:[^\w\s]|_)+")
_NONE = np.int64(1 << 40)


def _byte_letters() -> list[str]:
    """The letter that stands for each byte in a byte-level vocabulary: itself if printable, else the next one from 256 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    out, extra = [], 0
    for b in range(256):
        out.append(chr(b) if b in plain else chr(256 + extra))
        extra += b not in plain
    return out


class Merges:
    """Byte pair merging of many words at once."""

    def __init__(self, model: dict):
        vocab, end = model["vocab"], model["end_of_word_suffix"]
        letters = _byte_letters()
        self.inner = np.array([vocab[x] for x in letters], np.int64)
        self.last = np.array([vocab[x + end] for x in letters], np.int64)
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        keys = np.array([(vocab[a] << 20) | vocab[b] for a, b in pairs], np.int64)
        made = np.array([vocab[a + b] for a, b in pairs], np.int64)
        # hash tables tried in turn; each takes the pairs that find an empty place in it
        self.tables, rank = [], np.arange(len(keys))
        self.bits = max(12, (4 * len(keys)).bit_length())
        left = np.arange(len(keys))
        while len(left):
            odd = np.random.default_rng(len(self.tables)).integers(1, 1 << 62, dtype=np.int64) | 1
            place = self._place(keys[left], odd)
            _, one = np.unique(place, return_index=True)
            key, value = np.full(1 << self.bits, -1, np.int64), np.full(1 << self.bits, _NONE, np.int64)
            key[place[one]], value[place[one]] = keys[left[one]], rank[left[one]]
            self.tables.append((odd, key, value))
            left = np.delete(left, one)
        self.made = made

    def _place(self, keys: np.ndarray, odd: int) -> np.ndarray:
        return (keys.astype(np.uint64) * np.uint64(odd) >> np.uint64(64 - self.bits)).astype(np.int64)

    def _ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        keys = (a << 20) | b
        out = np.full(len(keys), _NONE, np.int64)
        todo = np.arange(len(keys))
        for odd, key, value in self.tables:
            at = self._place(keys[todo], odd)
            same = key[at] == keys[todo]
            out[todo[same]] = value[at[same]]
            todo = todo[~same & (key[at] >= 0)]
            if not len(todo):
                break
        return out

    def encode(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all words, one after another, and the number of each word's ids."""
        raw = [w.encode() for w in words]
        sizes = np.array([len(x) for x in raw], np.int64)
        data = np.frombuffer(b"".join(raw), np.uint8)
        stop = np.cumsum(sizes)
        symbols = self.inner[data]
        symbols[stop - 1] = self.last[data[stop - 1]]
        word = np.repeat(np.arange(len(words)), sizes)
        ranks = np.full(len(symbols), _NONE, np.int64)
        inside = np.flatnonzero(word[1:] == word[:-1])
        ranks[inside] = self._ranks(symbols[inside], symbols[inside + 1])
        done: list[tuple[np.ndarray, np.ndarray]] = []
        while len(symbols):
            first = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
            sizes = np.diff(np.append(first, len(word)))
            least = np.repeat(np.minimum.reduceat(ranks, first), sizes)
            if (over := least == _NONE).any():
                done.append((symbols[over], word[over]))
                symbols, word, ranks, least = symbols[~over], word[~over], ranks[~over], least[~over]
                if not len(symbols):
                    break
            hit = ranks == least
            if (again := hit[1:] & hit[:-1]).any():  # runs of one symbol: every other pair, from the left
                for i in np.flatnonzero(again) + 1:
                    if hit[i - 1]:
                        hit[i] = False
            at = np.flatnonzero(hit)
            symbols[at] = self.made[ranks[at]]
            keep = np.ones(len(symbols), bool)
            keep[at + 1] = False
            new = np.cumsum(keep) - 1
            symbols, word, ranks = symbols[keep], word[keep], ranks[keep]
            changed = np.zeros(len(symbols), bool)
            changed[new[at]] = True
            changed[np.maximum(new[at] - 1, 0)] = True
            near = np.flatnonzero(changed)
            ranks[near] = _NONE
            near = near[near + 1 < len(word)]
            near = near[word[near] == word[near + 1]]
            ranks[near] = self._ranks(symbols[near], symbols[near + 1])
        symbols, word = np.concatenate([x for x, _ in done]), np.concatenate([x for _, x in done])
        return symbols[np.argsort(word, kind="stable")], np.bincount(word, minlength=len(words))


class Encoder:
    """``Tokenizer.from_file(path).encode(text, add_special_tokens=False).ids`` for many texts."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path) as file:  # a tokenizer file that is installed on every machine
            spec = json.load(file)
        normalizers = [x["type"] for x in (spec["normalizer"] or {}).get("normalizers", [])]
        splits = (spec["pre_tokenizer"] or {}).get("pretokenizers", [{}])
        model = spec["model"]
        self.quick = normalizers == _NORMALIZER and splits[0].get("pattern", {}).get("Regex") == _PATTERN and model["type"] == "BPE" and bool(model.get("end_of_word_suffix")) and not model.get("dropout")
        self.added = [x["content"] for x in spec["added_tokens"]]
        if self.quick:
            self.merges = Merges(model)
            self._clear()

    def _clear(self) -> None:
        self.known: dict[str, int] = {}
        self.ids, self.starts, self.counts = np.zeros(1 << 20, np.uint32), np.zeros(1 << 18, np.int64), np.zeros(1 << 18, np.int32)
        self.used = 0

    def _learn(self, words: list[str]) -> None:
        ids, counts = self.merges.encode(words)
        n, m = len(self.known), len(words)
        while self.used + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        while n + m > len(self.starts):
            self.starts, self.counts = np.concatenate([self.starts, np.zeros_like(self.starts)]), np.concatenate([self.counts, np.zeros_like(self.counts)])
        self.ids[self.used : self.used + len(ids)] = ids
        self.starts[n : n + m] = self.used + np.cumsum(counts) - counts
        self.counts[n : n + m] = counts
        self.used += len(ids)
        self.known.update(zip(words, range(n, n + m), strict=True))

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        """The ids of each text, as unsigned 32-bit integers; a null text has none."""
        words: list[str] = []
        ends, slow = [], {}
        for i, text in enumerate(texts):
            if text:
                if not self.quick or _QUICK.search(text) or any(x in text for x in self.added):
                    slow[i] = np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)
                else:
                    words += _SPLIT.findall(text.lower())
            ends.append(len(words))
        if words:
            if len(self.known) > CACHED_WORDS:
                self._clear()
            if new := list(set(words).difference(self.known)):
                self._learn(new)
        which = np.fromiter(map(self.known.__getitem__, words), np.int64, len(words)) if words else np.zeros(0, np.int64)
        n = self.counts[which].astype(np.int64) if words else which
        stop = np.cumsum(n)
        flat = self.ids[np.arange(stop[-1]) + np.repeat(self.starts[which] - (stop - n), n)] if words else np.zeros(0, np.uint32)
        cuts = np.concatenate([[0], stop])[np.array(ends, np.int64)] if ends else np.zeros(0, np.int64)
        out, at = [], 0
        for i, end in enumerate(cuts):
            out.append(slow.get(i, flat[at:end]))
            at = end
        return out


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One for each file and process."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]
