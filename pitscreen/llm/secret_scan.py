"""Secret scans over a trigram inverted index.

From each rule's regex follows a Boolean query of trigrams that every match must
hold. Each Arrow batch is an index segment: postings (rows that hold a trigram) of
the trigrams the queries name, found in one array pass over the batch. A query
intersects and unites postings, and only the rows it leaves are searched with the
regex. A rule without mandatory trigrams is searched in every row.
"""
from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache
from re import _constants as C, _parser as P
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from pitscreen.llm.common import as_long, buffers, chunks, utf8
from pitscreen.llm.textnum import LOWER


class Rule(NamedTuple):
    kind: str
    regex: str
    group: int = 0      # the group whose length counts
    least: int = 1      # its least length; shorter matches are dropped


# Base kinds in their order, then well-known public token formats.
BASE = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 18),
    Rule("hex", r"[0-9a-f]{16,}", 0, 16),
)
MORE = (
    Rule("pem", r"-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{16,}"),
    Rule("forge", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("login", r"[a-z]{2,16}://[A-Za-z0-9._~%-]{1,64}:[^\x00-\x20/@:]{6,128}@"),
)

ALL = ("all",)
MOST_STRINGS = 24


def _and(parts: list) -> tuple:
    parts = [p for p in dict.fromkeys(parts) if p != ALL]
    return ALL if not parts else parts[0] if len(parts) == 1 else ("and", *parts)


def _or(parts: list) -> tuple:
    parts = list(dict.fromkeys(parts))
    return ALL if ALL in parts or not parts else parts[0] if len(parts) == 1 else ("or", *parts)


def _of_strings(strings: frozenset[str]) -> tuple:
    """What holds of a text that contains one of the strings."""
    return _or([_and([("tri", s[i:i + 3]) for i in range(len(s) - 2)]) for s in sorted(strings)])


def _item(op, value) -> tuple[frozenset[str] | None, tuple]:
    """The strings that an element of a parsed regex can match, if they are few, and a query that a match implies."""
    if op is C.LITERAL:
        return frozenset([chr(value).lower()]), ALL
    if op is C.AT:
        return frozenset([""]), ALL
    if op is C.IN and len(value) <= 8 and all(o is C.LITERAL for o, _ in value):
        return frozenset(chr(v).lower() for _, v in value), ALL
    if op is C.SUBPATTERN:
        return _sequence(value[3])
    if op is C.BRANCH:
        each = [_sequence(x) for x in value[1]]
        if all(strings is not None for strings, _ in each) and len(united := frozenset().union(*[s for s, _ in each])) <= MOST_STRINGS:
            return united, ALL
        return None, _or([query if strings is None else _of_strings(strings) for strings, query in each])
    if op in (C.MAX_REPEAT, C.MIN_REPEAT, C.POSSESSIVE_REPEAT):
        low, high, inner = value
        strings, query = _sequence(inner)
        if strings is not None and (low, high) == (0, 1):
            return strings | {""}, ALL
        if strings is not None and low == high and len(strings) == 1:
            return frozenset(s * low for s in strings), ALL
        return None, ALL if low == 0 else query if strings is None else _of_strings(strings)
    return None, ALL


def _sequence(parsed) -> tuple[frozenset[str] | None, tuple]:
    whole, current, query = True, frozenset([""]), []
    for op, value in parsed:
        strings, implied = _item(op, value)
        query.append(implied)
        if strings is not None and len(current) * len(strings) <= MOST_STRINGS:
            current = frozenset(a + b for a in current for b in strings)
            continue
        whole = False
        query.append(_of_strings(current))
        current = strings if strings is not None else frozenset([""])
    return (current, _and(query)) if whole and all(q == ALL for q in query) else (None, _and([*query, _of_strings(current)]))


def trigram_query(regex: str) -> tuple:
    """A Boolean query over lower-case trigrams that holds of every text with a match; ALL if there is none."""
    strings, query = _sequence(P.parse(regex, re.ASCII))
    return _and([query, _of_strings(strings)]) if strings is not None else query


def named_trigrams(query: tuple) -> set[bytes]:
    if query[0] == "tri":
        return {query[1].encode()} if query[1].isascii() else set()
    return set().union(*[named_trigrams(q) for q in query[1:]]) if query != ALL else set()


@lru_cache(maxsize=8)
def _prepared(rules: tuple[Rule, ...]):
    queries = [trigram_query(r.regex) for r in rules]
    trigrams = sorted(set().union(*map(named_trigrams, queries)))
    slot = np.zeros(1 << 24, np.uint8 if len(trigrams) < 255 else np.uint16)
    for i, t in enumerate(trigrams):
        slot[t[0] << 16 | t[1] << 8 | t[2]] = i + 1
    return [re.compile(r.regex, re.ASCII) for r in rules], queries, {t: i + 1 for i, t in enumerate(trigrams)}, slot


def postings(data: np.ndarray, offsets: np.ndarray, slot: np.ndarray) -> dict[int, np.ndarray]:
    """Rows that hold each of the indexed trigrams, ascending."""
    if len(data) < 3:
        return {}
    low = LOWER[data].astype(np.uint32)
    found = slot[low[:-2] << 16 | low[1:-1] << 8 | low[2:]]
    at = np.flatnonzero(found)
    row = np.searchsorted(offsets, at, side="right") - 1
    inside = at + 3 <= offsets[row + 1]
    keys = np.unique(found[at][inside].astype(np.int64) << 32 | row[inside])
    which, rows = keys >> 32, keys & 0xFFFFFFFF
    cuts = np.flatnonzero(np.diff(which)) + 1
    return {int(w[0]): r for w, r in zip(np.split(which, cuts), np.split(rows, cuts)) if len(w)}


def candidates(query: tuple, index: dict[int, np.ndarray], slots: dict[bytes, int], rows: int) -> np.ndarray:
    if query[0] == "all":
        return np.arange(rows)
    if query[0] == "tri":
        return index.get(slots.get(query[1].encode(), -1), np.zeros(0, np.int64)) if query[1].isascii() else np.arange(rows)
    each = [candidates(q, index, slots, rows) for q in query[1:]]
    out = each[0]
    for x in each[1:]:
        out = np.intersect1d(out, x, assume_unique=True) if query[0] == "and" else np.union1d(out, x)
    return out


def find(data: np.ndarray, offsets: np.ndarray, rules: tuple[Rule, ...]) -> dict[int, list[tuple[int, int, int]]]:
    """(start, rule, end) of every span by row, in code points, by start and then by rule."""
    regexes, queries, slots, slot = _prepared(rules)
    index = postings(data, offsets, slot)
    texts: dict[int, str] = {}
    spans: dict[int, list[tuple[int, int, int]]] = {}
    for number, (rule, regex, query) in enumerate(zip(rules, regexes, queries)):
        for row in candidates(query, index, slots, len(offsets) - 1).tolist():
            if row not in texts:
                texts[row] = data[offsets[row]:offsets[row + 1]].tobytes().decode("utf-8", "replace")
            for m in regex.finditer(texts[row]):
                if m.end(rule.group) - m.start(rule.group) >= rule.least:
                    spans.setdefault(row, []).append((m.start(), number, m.end()))
    return {row: sorted(found) for row, found in spans.items()}


def _scan(rules: tuple[Rule, ...]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = buffers(batch.column(1))
            for a, b in chunks(offsets, 1 << 22):
                at = offsets[a:b + 1]
                found = find(data[at[0]:at[-1]], at - at[0], rules)
                kinds = [[rules[k].kind for _, k, _ in found.get(i, ())] for i in range(b - a)]
                starts = [[s for s, _, _ in found.get(i, ())] for i in range(b - a)]
                ends = [[e for _, _, e in found.get(i, ())] for i in range(b - a)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(kinds, pa.list_(pa.string())), pa.array(starts, pa.list_(pa.int64())), pa.array(ends, pa.list_(pa.int64()))], names=["doc_id", "kinds", "starts", "ends"])
    return run


def scan(docs: DataFrame, rules: tuple[Rule, ...] = BASE + MORE) -> DataFrame:
    """(doc_id, kinds, starts, ends) for every row of `docs` (doc_id, text, any other columns): the spans of all
    rules by start, then by the order of the rules; code points, ends exclusive; matches of one rule do not overlap.

    A null text is empty and has no spans; every row comes back, also one with a null id or a repeated one.
    """
    return docs.select(as_long("doc_id").alias("doc_id"), utf8().alias("text")).mapInArrow(
        _scan(rules), "doc_id long, kinds array<string>, starts array<long>, ends array<long>")


def digest(found: DataFrame, base: tuple[Rule, ...] = BASE) -> DataFrame:
    """The spans of `scan` as counts of the base kinds, a checksum of their spans and a list of all spans."""
    spans = F.arrays_zip("kinds", "starts", "ends")
    text = lambda column: F.array_join(F.transform(column, lambda s: F.concat_ws(":", s["kinds"], s["starts"], s["ends"])), ",")
    names = [r.kind for r in base]
    counts = [F.size(F.expr(f"filter(kinds, k -> k = '{n}')")).cast("long").alias(f"n_{n}") for n in names]
    return found.select("doc_id", *counts, F.sha2(text(F.filter(spans, lambda s: s["kinds"].isin(names))).cast("binary"), 256).alias("base_sha256"), text(spans).alias("spans"))


def _redact(rules: tuple[Rule, ...], mask: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index("text")
            texts = batch.column(at)
            filled = texts.fill_null("").cast(pa.large_binary())
            data, offsets = buffers(filled)
            out = texts.to_pylist()
            for a, b in chunks(offsets, 1 << 22):
                piece = offsets[a:b + 1]
                for row, spans in find(data[piece[0]:piece[-1]], piece - piece[0], rules).items():
                    text, done, parts = out[a + row], 0, []
                    for start, _, end in spans:
                        if start >= done:
                            parts += [text[done:start], mask]
                        done = max(done, end)
                    out[a + row] = "".join([*parts, text[done:]])
            columns = batch.columns
            columns[at] = pa.array(out, texts.type)
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)
    return run


def redact(docs: DataFrame, rules: tuple[Rule, ...] = BASE + MORE, mask: str = "[SECRET]") -> DataFrame:
    """`docs` with every span (overlapping ones together) replaced by `mask`; a null text stays null, n_chars follows the text."""
    out = docs.mapInArrow(_redact(rules, mask), docs.schema)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def span_checksum(spans: list[tuple[str, int, int]]) -> str:
    return hashlib.sha256(",".join(f"{k}:{s}:{e}" for k, s, e in spans).encode()).hexdigest()
