"""Hashed text features and small logistic models fitted on bounded samples."""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from pitscreen.llm import textnum
from pitscreen.llm.common import as_long

PUNCTUATION = np.zeros(256, bool)
PUNCTUATION[[i for i in range(33, 127) if not chr(i).isalnum()]] = True


def trimmed(data: np.ndarray, found: textnum.Words, rounds: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of words without up to `rounds` ASCII punctuation marks at either end (one byte stays)."""
    start, end = found.start.copy(), found.end.copy()
    for _ in range(rounds):
        start += PUNCTUATION[data[start]] & (end - start > 1)
        end -= PUNCTUATION[data[end - 1]] & (end - start > 1)
    return start, end


def labelled_ids(labels: DataFrame, columns: list[str], most: int, keep: Column | None = None) -> DataFrame:
    """At most `most` labelled doc_ids with their labels, chosen by the digest of the id: the same on every run.

    Null ids and null labels are left out; of several labels of one id the greatest counts.
    """
    labels = labels.select(as_long("doc_id").alias("doc_id"), *[F.col(c).cast("int") for c in columns]).dropna()
    if keep is not None:
        labels = labels.filter(keep)
    one = labels.groupBy("doc_id").agg(*[F.max(c).alias(c) for c in columns])
    return one.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)


def with_labels(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows of `docs` whose id is in the bounded table `ids`."""
    return docs.join(F.broadcast(ids), "doc_id")


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -35.0, 35.0)))


def fit_logistic(x: np.ndarray, y: np.ndarray, penalty: float, steps: int = 300, weight: np.ndarray | None = None, prior: np.ndarray | float = 0.0) -> tuple[np.ndarray, float]:
    """Weights and bias of a logistic regression on soft targets, by accelerated gradient steps with a fixed step size.

    The penalty pulls the weights to `prior`, where they also start.
    """
    n, d = x.shape
    weight = np.ones(n) if weight is None else weight
    weight = weight / weight.sum()
    reach = max(1e-9, float((weight[:, None] * x * x).sum()))  # bounds the largest eigenvalue of the weighted Gram matrix
    rate = 1.0 / (0.25 * (min(reach, _top_eigenvalue(x, weight)) + 1.0) + penalty)
    w, b = np.zeros(d) + prior, float(np.log((weight @ y + 1e-3) / (1 - weight @ y + 1e-3)))
    lead_w, lead_b, pace = w.copy(), b, 1.0
    for _ in range(steps):
        error = weight * (sigmoid(x @ lead_w + lead_b) - y)
        new_w = lead_w - rate * (error @ x + penalty * (lead_w - prior))
        new_b = lead_b - rate * error.sum()
        after = (1 + (1 + 4 * pace * pace) ** 0.5) / 2
        lead_w = new_w + (pace - 1) / after * (new_w - w)
        lead_b = new_b + (pace - 1) / after * (new_b - b)
        w, b, pace = new_w, new_b, after
    return w, b


def row_blocks(x: np.ndarray, rows: int = 128) -> Iterator[tuple[slice, np.ndarray]]:
    """The rows of `x` as doubles, a few at a time: a product of floats with doubles would copy the whole of `x`."""
    for a in range(0, len(x), rows):
        yield slice(a, a + rows), x[a:a + rows].astype(float)


def _top_eigenvalue(x: np.ndarray, weight: np.ndarray, rounds: int = 15) -> float:
    v = np.ones(x.shape[1]) / np.sqrt(max(1, x.shape[1]))
    size = 0.0
    for _ in range(rounds):
        after = np.zeros(x.shape[1])
        for at, part in row_blocks(x):
            after += (weight[at] * (part @ v)) @ part
        v = after
        size = float(np.linalg.norm(v))
        if size < 1e-12:
            return 1e-9
        v /= size
    return 1.1 * size


def fit_platt(margin: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset that turn margins into calibrated probabilities."""
    a, b = fit_logistic(margin[:, None].astype(float), y.astype(float), 1e-4, 400)
    return float(a[0]), float(b)


WORD_BITS = 10
CHAR_BITS = 10
CHAR_SIZES = (3, 4, 5)
WIDTH = (1 << WORD_BITS) + (1 << CHAR_BITS)


def frequencies(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A row of WIDTH square roots of relative frequencies for each text: hashed words and word pairs, then
    hashed byte n-grams. A word that repeats the one before is one shared pair; a text without words is all zeros."""
    rows = len(offsets) - 1
    found = textnum.words(data, offsets)
    words = (found.hash >> np.uint64(64 - WORD_BITS)).astype(np.int64)
    same = found.doc[1:] == found.doc[:-1]
    pairs = textnum.mix(found.hash[:-1] * np.uint64(0xC2B2AE3D27D4EB4F) + found.hash[1:])
    pairs = np.where(found.hash[1:] == found.hash[:-1], np.uint64(7), pairs >> np.uint64(64 - WORD_BITS)).astype(np.int64)[same]
    wide = np.bincount(found.doc * (1 << WORD_BITS) + words, minlength=rows << WORD_BITS) + np.bincount(found.doc[1:][same] * (1 << WORD_BITS) + pairs, minlength=rows << WORD_BITS)
    row = np.repeat(np.arange(rows), np.diff(offsets))
    chars = np.zeros(rows << CHAR_BITS, np.int64)
    code = data.astype(np.uint32) + np.uint32(1)
    gram = code.copy()
    for size in range(2, max(CHAR_SIZES) + 1):
        gram = gram[:-1] * np.uint32(0x01000193) + code[size - 1:]
        if size in CHAR_SIZES and len(gram):
            inside = row[:len(gram)] == row[size - 1:]
            spread = (gram ^ gram >> np.uint32(15)) * np.uint32(0x9E3779B1)
            chars += np.bincount((row[:len(gram)] << CHAR_BITS)[inside] + (spread[inside] >> np.uint32(32 - CHAR_BITS)).astype(np.int64), minlength=rows << CHAR_BITS)
    out = np.zeros((rows, WIDTH), np.float32)
    for counts, low, bits in ((wide, 0, WORD_BITS), (chars, 1 << WORD_BITS, CHAR_BITS)):
        counts = counts.reshape(rows, 1 << bits).astype(np.float32)
        out[:, low:low + (1 << bits)] = np.sqrt(counts / np.maximum(1.0, counts.sum(axis=1, keepdims=True)))
    return out
