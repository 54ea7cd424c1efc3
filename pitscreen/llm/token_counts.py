"""Word-piece counts by a linear longest-match automaton.

Greedy longest match cuts a word into the longest vocabulary entry it starts with, and
so on; the last piece must be an entry that may end a word. The vocabulary is a trie of
bytes; an entry that may only end a word carries an end mark as its last symbol. Where
all that is left is an entry that may not end a word, the next shorter entry is taken, so
a vocabulary with every byte in both forms spells every word. Each node has a failure link: where the walk goes on if no
child fits, after popping the pieces that are then certain. Only the number of those
pieces is kept, so the count of a word's pieces is a walk of its bytes without
backtracking and without building pieces. Counts of frequent words are remembered.
"""
from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from pitscreen.llm.common import as_long, buffers, chunks, utf8
from pitscreen.llm.word_bpe import _byte_letters

END = 256
MOST_WORDS = 600_000


def vocabulary(path: str) -> list[tuple[int, ...]]:
    """Entries of a byte-level vocabulary file as symbols: bytes, and END at the end of entries that close a word."""
    with open(path, encoding="utf-8") as file:
        model = json.load(file)["model"]
    byte_of = {c: b for b, c in enumerate(_byte_letters())}
    suffix = model.get("end_of_word_suffix") or ""
    out = []
    for entry in model["vocab"]:
        closes = bool(suffix) and entry.endswith(suffix) and entry != suffix
        letters = entry[:-len(suffix)] if closes else entry
        if all(c in byte_of for c in letters):
            out.append(tuple(byte_of[c] for c in letters) + ((END,) if closes else ()))
    return out


class Automaton:
    """A trie with failure links; `pops[node]` counts the pieces that following the link closes, `tail[node]` the
    pieces of the node's path where the word ends there (-1: none)."""

    def __init__(self, entries: list[tuple[int, ...]]):
        self.children: list[dict[int, int]] = [{}]
        entry = [False]
        depth = [0]
        for symbols in entries:
            node = 0
            for s in symbols:
                nxt = self.children[node].get(s)
                if nxt is None:
                    nxt = self.children[node][s] = len(self.children)
                    self.children.append({}), entry.append(False), depth.append(depth[node] + 1)
                node = nxt
            entry[node] = True
        self.link = [-1] * len(self.children)
        self.pops = [0] * len(self.children)
        self.tail = [-1] * len(self.children)
        mark = END in self.children[0]     # the end mark is a piece of its own
        self.tail[0] = 1 if mark else -1
        level = [0]
        while level:
            below = []
            for node in level:
                for symbol, child in self.children[node].items():
                    below.append(child)
                    at, popped = self.link[node], self.pops[node]
                    while at >= 0 and symbol not in self.children[at]:
                        popped += self.pops[at]
                        at = self.link[at]
                    cut = (self.children[at][symbol], popped) if at >= 0 else (-1, 0)   # by entries shorter than the path
                    self.link[child], self.pops[child] = (0, 1) if entry[child] else cut
                    at, popped = (self.link[child], self.pops[child]) if mark else cut
                    if END in self.children[child]:
                        self.tail[child] = 1
                    elif at >= 0 and self.tail[at] >= 0:
                        self.tail[child] = popped + self.tail[at]
            level = below

    def pieces(self, word: bytes) -> int:
        """Pieces of the greedy longest match; -1 if some part of the word matches no entry."""
        children, link, pops = self.children, self.link, self.pops
        node = count = 0
        for symbol in word:
            while symbol not in children[node]:
                count += pops[node]
                node = link[node]
                if node < 0:
                    return -1
            node = children[node][symbol]
        return count + self.tail[node] if self.tail[node] >= 0 else -1


_AUTOMATA: dict[str, tuple[Automaton, dict[bytes, int]]] = {}


def _count(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if path not in _AUTOMATA:
            _AUTOMATA[path] = Automaton(vocabulary(path)), {}
        automaton, known = _AUTOMATA[path]
        for batch in batches:
            data, offsets = buffers(batch.column(1))
            for a, b in chunks(offsets):
                n_words, n_tokens = [], []
                for x, y in zip(offsets[a:b].tolist(), offsets[a + 1:b + 1].tolist()):
                    words = data[x:y].tobytes().lower().split()
                    if len(known) + len(words) > MOST_WORDS:
                        known.clear()
                    for word in set(words).difference(known):
                        known[word] = max(1, automaton.pieces(word))
                    n_words.append(len(words)), n_tokens.append(sum(map(known.__getitem__, words)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(n_words, pa.int64()), pa.array(n_tokens, pa.int64())], names=["doc_id", "n_words", "n_tokens"])
    return run


def count_tokens(docs: DataFrame, vocabulary_path: str) -> DataFrame:
    """(doc_id, n_words, n_tokens) for every row of `docs` (doc_id, text, any other columns).

    Words are runs outside ASCII white space with letters A-Z lower-cased; a word that the vocabulary cannot
    spell, because it lacks a byte of it, is one unknown piece. A null or empty text has no words. Every row comes back, also one with a null
    id or a repeated one; an empty table gives an empty result.
    """
    return docs.select(as_long("doc_id").alias("doc_id"), utf8().alias("text")).mapInArrow(_count(vocabulary_path), "doc_id long, n_words long, n_tokens long")
