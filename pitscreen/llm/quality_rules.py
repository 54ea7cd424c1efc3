"""Quality rules: fixed text rules, and a calibrated classifier held against a fixed threshold.

The classifier is a logistic regression over square roots of hashed word, word-pair
and byte n-gram frequencies, fitted on at most SAMPLE labelled rows. A fifth of those
is kept out of the fit and calibrates its margins (Platt). Texts are scored in Arrow
batches; the rules need the whole text and are computed next to the score.
"""
from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from pitscreen.llm.common import as_long, buffers, chunks, stored, utf8
from pitscreen.llm.hashed import WIDTH, fit_logistic, fit_platt, frequencies, labelled_ids, sigmoid, with_labels

SAMPLE = 6_000
PENALTY = 2e-5
KEEP_AT = 0.5
SYMBOLS = b"#*$%&|<>"
RULES = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"
_SYMBOL_TABLE = np.isin(np.arange(256), list(SYMBOLS))


def repeated_words(words: list[bytes], window: int = 5) -> int:
    """Words that stand in a window of words found twice or more in the text, first occurrences included."""
    count = len(words) - window + 1
    if count < 2 or len(set(words)) > len(words) - window:
        return 0
    first: dict[tuple, int] = {}
    inside = bytearray(len(words))
    mark = b"\x01" * window
    for i, gram in enumerate(zip(*[words[j:] for j in range(window)])):
        at = first.setdefault(gram, i)
        if at != i:
            inside[at:at + window] = mark
            inside[i:i + window] = mark
    return sum(inside)


def duplicate_lines(text: bytes) -> int:
    """Lines with a word that equal an earlier line."""
    lines = [x for x in text.split(b"\n") if x.split(None, 1)]
    return len(lines) - len(set(lines))


def rules(data: np.ndarray, offsets: np.ndarray) -> dict[str, list[int]]:
    symbols = np.concatenate([[0], np.cumsum(_SYMBOL_TABLE[data])])
    white = np.isin(data, [9, 10, 11, 12, 13, 32])
    points = np.concatenate([[0], np.cumsum(((data & 0xC0) != 0x80) & ~white)])
    out: dict[str, list[int]] = {name.split()[0]: [] for name in RULES.split(", ")}
    out["word_chars"] = np.diff(points[offsets]).tolist()
    out["n_symbols"] = np.diff(symbols[offsets]).tolist()
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
        text = data[a:b].tobytes()
        words = text.split()
        out["n_words"].append(len(words))
        out["n_dup_lines"].append(duplicate_lines(text))
        out["n_repeat_words"].append(repeated_words(words))
    return out


def _vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = buffers(batch.column(1))
        for a, b in chunks(offsets):
            at = offsets[a:b + 1]
            x = frequencies(data[at[0]:at[-1]], at - at[0])
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), batch.column(2).slice(a, b - a), pa.array([r.astype(np.float16).tobytes() for r in x], pa.binary())], names=["doc_id", "label", "vector"])


def sample_vectors(docs: DataFrame, ids: DataFrame, label: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids, features and labels of the bounded sample, by id. Its rows pass the driver's JVM a partition at a time."""
    texts = docs.select(as_long("doc_id").alias("doc_id"), utf8().alias("text"))
    rows = stored(with_labels(texts, ids).select("doc_id", "text", label).mapInArrow(_vectors, "doc_id long, label int, vector binary"), "vectors")
    found = sorted((r["doc_id"], bytes(r["vector"]), r["label"]) for r in rows.toLocalIterator())
    x = np.empty((len(found), WIDTH), np.float32)
    for i, (_, vector, _) in enumerate(found):
        x[i] = np.frombuffer(vector, np.float16)
    return np.array([r[0] for r in found], np.int64), x, np.array([r[2] for r in found], np.int64)


def fit(docs: DataFrame, labels: DataFrame, most: int = SAMPLE):
    """(weights, bias, slope, offset) of the calibrated classifier, or None where the labels hold a single class."""
    ids, x, y = sample_vectors(docs, labelled_ids(labels, ["quality"], most), "quality")
    y = (y > 0).astype(float)
    if len(set(y)) < 2:
        return None
    apart = ids % 5 == 4
    if len(set(y[apart])) < 2 or len(set(y[~apart])) < 2:
        apart[:] = False
    w, b = fit_logistic(x[~apart], y[~apart], PENALTY, 500)
    slope, offset = fit_platt((x @ w + b)[apart], y[apart]) if apart.any() else (1.0, 0.0)
    return w, b, slope, offset


def _judge(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fitted = model.value
        for batch in batches:
            data, offsets = buffers(batch.column(1))
            for a, b in chunks(offsets):
                at = offsets[a:b + 1]
                text, at = data[at[0]:at[-1]], at - at[0]
                found = rules(text, at)
                if fitted is None:
                    p = np.ones(b - a)
                else:
                    w, bias, slope, offset = fitted
                    p = sigmoid(slope * (frequencies(text, at) @ w + bias) + offset)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), *[pa.array(found[name.split()[0]], pa.int64()) for name in RULES.split(", ")], pa.array(p.astype(float))],
                                                 names=["doc_id", *[name.split()[0] for name in RULES.split(", ")], "quality"])
    return run


def judge(docs: DataFrame, labels: DataFrame, most: int = SAMPLE, keep_at: float = KEEP_AT) -> DataFrame:
    """The rules' figures, base_failed, the calibrated probability `quality` and kept, for every row of `docs`.

    `docs` has doc_id, text and any other columns. A null text has no words, lines or symbols and fails the
    base rules. Every row comes back, also one with a null id or a repeated one; an empty table gives an
    empty result. Labels of one class teach nothing: then what passes the base rules is kept.
    """
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, most))
    found = docs.select(as_long("doc_id").alias("doc_id"), utf8().alias("text")).mapInArrow(_judge(model), f"doc_id long, {RULES}, quality double")
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return found.withColumn("base_failed", failed).withColumn("kept", ~failed & (F.col("quality") >= keep_at))
