"""Byte-pair ids of whole batches of texts as arrays.

Nothing in the tokenizer joins characters across white space, so a text's ids are those
of its words in turn. Words are told apart by their 64-bit hashes and each new one is
encoded once. Most words are Latin letters with some closing punctuation; for those the
tokenizer's steps are simple (lower case, split off the punctuation, merge bytes), and
the merges of all new words run together on flat arrays: each step looks up the rank of
every neighbouring pair, and every word merges its lowest-ranked pair wherever it occurs.
All other words (digits, symbols inside, other letters) go to the tokenizers library,
which also gives the ids of the punctuation; tests hold both ways against it.
"""
from __future__ import annotations

import json
import os

import numpy as np

from pitscreen.llm import textnum

MOST_WORDS = 500_000     # whose ids a worker keeps
CLOSING = np.isin(np.arange(256), list(b".,;:!?"))
LETTER = np.isin(np.arange(256), list(b"abcdefghijklmnopqrstuvwxyz"))
NO_RANK = np.int64(1 << 40)
LATIN = 0xC3             # first byte of U+00C0 to U+00FF; of these, 0x97 and 0xB7 are no letters


def _byte_letters() -> list[str]:
    """The printable stand-in of each byte in byte-level vocabularies: itself if printable Latin-1, else 256 and up in order."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return [chr(b) if b in plain else chr(256 + rest.index(b)) for b in range(256)]


class WordBpe:
    """Ids of texts by the vocabulary and merges of a tokenizer file."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core, and each thread keeps memory
        from tokenizers import Tokenizer
        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as file:
            model = json.load(file)["model"]
        vocab, suffix = model["vocab"], model["end_of_word_suffix"]
        letters = _byte_letters()
        self.inner = np.array([vocab[c] for c in letters], np.int64)
        self.last = np.array([vocab[c + suffix] for c in letters], np.int64)
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        keys = np.array([vocab[a] << 20 | vocab[b] for a, b in merges], np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.rank = keys[order], order.astype(np.int64)
        self.made = np.array([vocab[a + b] for a, b in merges], np.int64)
        self.closings: dict[bytes, np.ndarray] = {}
        self._forget()

    def _forget(self) -> None:
        """Known words: sorted hashes, and where their ids stand in `flat`."""
        self.hashes, self.at, self.count = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.flat = np.zeros(0, np.int32)

    def merge(self, data: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids, and their number for each word, of words that are one piece for the tokenizer: lower-case bytes and their lengths."""
        symbols = self.inner[data]
        ends = np.cumsum(lengths)
        symbols[ends - 1] = self.last[data[ends - 1]]
        word = np.repeat(np.arange(len(lengths)), lengths)
        done_ids, done_word = [symbols[:0]], [word[:0]]
        while len(symbols):
            key = symbols[:-1] << 20 | symbols[1:]
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            rank = np.where((self.keys[at] == key) & (word[:-1] == word[1:]), self.rank[at], NO_RANK)
            rank = np.append(rank, NO_RANK)
            first = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
            low = np.minimum.reduceat(rank, first)
            each = np.repeat(low, np.diff(np.append(first, len(word))))
            going = each < NO_RANK
            done_ids.append(symbols[~going]), done_word.append(word[~going])
            hit = (rank == each) & going
            run = np.flatnonzero(hit)
            if len(run):  # of touching pairs (as in "aaa"), the first, third, ... merge
                opens = np.append(True, np.diff(run) > 1)
                nth = np.arange(len(run)) - np.flatnonzero(opens)[np.cumsum(opens) - 1]
                hit[run[nth % 2 == 1]] = False
            symbols = np.where(hit, self.made[np.where(hit, rank, 0)], symbols)
            keep = going & ~np.append(False, hit[:-1])
            symbols, word = symbols[keep], word[keep]
        ids, word = np.concatenate(done_ids).astype(np.int32), np.concatenate(done_word)
        return ids[np.argsort(word, kind="stable")], np.bincount(word, minlength=len(lengths))

    def _library(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, np.int32) for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def _encode(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids, and their number for each word, of the words data[start:end]."""
        core = end.copy()
        while (more := CLOSING[data[core - 1]] & (core > start + 1)).any():
            core -= more
        before = np.append(np.uint8(0), data[:-1])
        second = (before == LATIN) & (data >= 0x80) & (data < 0xC0) & (data != 0x97) & (data != 0xB7)
        lower = textnum.LOWER[data] + np.uint8(0x20) * (second & (data < 0x9F))
        fine = LETTER[lower] & (data < 0x80) | second | (data == LATIN) & np.append(second[1:], False)
        bad = np.append(0, np.cumsum(~fine))
        simple = bad[core] == bad[start]
        number = np.zeros(len(start), np.int64)
        parts: list[tuple[np.ndarray, np.ndarray]] = []      # (words, their ids one word after another)
        picked = np.flatnonzero(simple)
        lengths = (core - start)[picked]
        ids, number[picked] = self.merge(lower[_spans(start[picked], lengths)], lengths)
        parts.append((picked, ids))
        other = np.flatnonzero(~simple)
        found = self._library([data[a:b].tobytes().decode("utf-8", "replace") for a, b in zip(start[other].tolist(), end[other].tolist())])
        number[other] = [len(x) for x in found]
        if found:
            parts.append((other, np.concatenate(found)))
        closed = np.flatnonzero(simple & (core < end))
        texts = [data[a:b].tobytes() for a, b in zip(core[closed].tolist(), end[closed].tolist())]
        new = sorted(set(texts).difference(self.closings))
        if len(self.closings) + len(new) > 10_000:
            self.closings, new = {}, sorted(set(texts))
        self.closings.update(zip(new, self._library([t.decode() for t in new])))
        tails = [self.closings[t] for t in texts]
        full = number.copy()
        full[closed] += [len(t) for t in tails]
        at = np.cumsum(full) - full
        out = np.zeros(int(full.sum()), np.int32)
        for words, ids in parts:
            out[_spans(at[words], number[words])] = ids
        if tails:
            out[_spans(at[closed] + number[closed], (full - number)[closed])] = np.concatenate(tails)
        return out, full

    def texts(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the texts data[offsets[i]:offsets[i + 1]], one text after another, and their number for each text."""
        found = textnum.words(data, offsets)
        if not len(found.doc):
            return np.zeros(0, np.int32), np.zeros(len(offsets) - 1, np.int64)
        keys, first, which = np.unique(found.hash, return_index=True, return_inverse=True)
        if len(self.hashes) + len(keys) > MOST_WORDS:
            self._forget()
        new = ~np.isin(keys, self.hashes, assume_unique=True)
        if new.any():
            ids, number = self._encode(data, found.start[first[new]], found.end[first[new]])
            place = np.searchsorted(self.hashes, keys[new])
            self.at = np.insert(self.at, place, len(self.flat) + np.cumsum(number) - number)
            self.count = np.insert(self.count, place, number)
            self.hashes = np.insert(self.hashes, place, keys[new])
            self.flat = np.concatenate([self.flat, ids])
        known = np.searchsorted(self.hashes, keys)[which]
        number = self.count[known]
        return self.flat[_spans(self.at[known], number)], np.bincount(found.doc, weights=number, minlength=len(offsets) - 1).astype(np.int64)


def _spans(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The positions of all spans, one span after another."""
    shift = start - (np.cumsum(length) - length)
    return np.repeat(shift, length) + np.arange(int(length.sum()))
