"""Quality classifier: ordinal regression on graded ratings.

Grades follow from the labels: 0 for poor text, 1 for good but toxic text, 2 for good
text. A cumulative-link model shares one weight vector over hashed text features:
P(grade >= k) = sigmoid(w.x - t_k) with rising thresholds t_1 < t_2. It gives an
expected grade and the tail probabilities; selection keeps rows whose probability of
at least KEEP_GRADE reaches KEEP_AT. It is fitted on at most SAMPLE labelled rows.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from pitscreen.llm.common import as_long, buffers, chunks, utf8
from pitscreen.llm.hashed import _top_eigenvalue, frequencies, labelled_ids, row_blocks, sigmoid
from pitscreen.llm.quality_rules import sample_vectors

SAMPLE = 6_000
PENALTY = 2e-5
STEPS = 500
GRADES = 3
KEEP_GRADE = 1
KEEP_AT = 0.5


def fit_ordinal(x: np.ndarray, grade: np.ndarray, grades: int = GRADES, penalty: float = PENALTY, steps: int = STEPS) -> tuple[np.ndarray, np.ndarray]:
    """Weights and rising thresholds of a cumulative-link model, by accelerated gradient steps on the exact likelihood.

    Thresholds are the first one and logarithms of the steps between them, so that they stay in order. A step
    passes over `x` once, in blocks of rows, so that it needs no copy of the sample.
    """
    n, d = x.shape
    tails = np.array([(grade >= k).mean() for k in range(1, grades)])
    tails = np.clip(tails, 1e-3, 1 - 1e-3)
    start = -np.log(tails / (1 - tails))
    gaps = np.log(np.maximum(np.diff(start), 1e-2))
    state = np.concatenate([np.zeros(d), start[:1], gaps])
    rate = 1.0 / (0.5 * (_top_eigenvalue(x, np.full(n, 1.0 / n)) + 1.0) + penalty)

    def slope(state: np.ndarray) -> np.ndarray:
        w, steps_up = state[:d], np.exp(state[d + 1:])
        cut = state[d] + np.concatenate([[0.0], np.cumsum(steps_up)])
        low, high, by_weight = np.empty(n), np.empty(n), penalty * w
        for at, part in row_blocks(x):
            m, own = len(part), grade[at, None]
            above = np.concatenate([np.ones((m, 1)), sigmoid((part @ w)[:, None] - cut[None, :]), np.zeros((m, 1))], axis=1)
            share = np.maximum(np.take_along_axis(above, own, 1) - np.take_along_axis(above, own + 1, 1), 1e-9)[:, 0]
            bend = above * (1 - above)
            low[at] = np.take_along_axis(bend, own, 1)[:, 0] / share
            high[at] = np.take_along_axis(bend, own + 1, 1)[:, 0] / share
            by_weight += (high[at] - low[at]) / n @ part
        by_cut = np.zeros(grades - 1)
        for k in range(1, grades):
            by_cut[k - 1] = (low[grade == k].sum() - high[grade == k - 1].sum()) / n
        after = np.cumsum(by_cut[::-1])[::-1]
        return np.concatenate([by_weight, after[:1], after[1:] * steps_up])

    lead, pace = state.copy(), 1.0
    for _ in range(steps):
        new = lead - rate * slope(lead)
        onward = (1 + (1 + 4 * pace * pace) ** 0.5) / 2
        lead = new + (pace - 1) / onward * (new - state)
        state, pace = new, onward
    return state[:d], state[d] + np.concatenate([[0.0], np.cumsum(np.exp(state[d + 1:]))])


def fit(docs: DataFrame, labels: DataFrame, most: int = SAMPLE):
    """Weights and thresholds, or None where the labels hold a single grade."""
    graded = labels.withColumn("grade", F.when(F.col("quality") < 1, 0).when(F.coalesce("toxic", F.lit(0)) > 0, 1).otherwise(2)).filter("quality is not null")
    _, x, y = sample_vectors(docs, labelled_ids(graded, ["grade"], most), "grade")
    return fit_ordinal(x, y) if len(set(y.tolist())) > 1 else None


def _rate(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fitted = model.value
        for batch in batches:
            data, offsets = buffers(batch.column(1))
            for a, b in chunks(offsets):
                at = offsets[a:b + 1]
                if fitted is None:
                    tail = np.ones((b - a, GRADES - 1))
                else:
                    tail = sigmoid((frequencies(data[at[0]:at[-1]], at - at[0]) @ fitted[0])[:, None] - fitted[1][None, :])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(tail.sum(axis=1).astype(float)), pa.array(tail[:, KEEP_GRADE - 1].astype(float))], names=["doc_id", "expected_grade", "tail"])
    return run


def rate(docs: DataFrame, labels: DataFrame, most: int = SAMPLE, keep_at: float = KEEP_AT) -> DataFrame:
    """(doc_id, expected_grade, tail, kept) for every row of `docs` (doc_id, text, any other columns).

    A null or empty text has no features and is rated by the thresholds alone. Every row comes back, also
    one with a null id or a repeated one; an empty table gives an empty result. Labels of one grade teach
    nothing: then every row is kept.
    """
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, most))
    found = docs.select(as_long("doc_id").alias("doc_id"), utf8().alias("text")).mapInArrow(_rate(model), "doc_id long, expected_grade double, tail double")
    return found.withColumn("kept", F.col("tail") >= keep_at)


def _select(model, keep_at: float):
    rated = _rate(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            text = batch.column(batch.schema.get_field_index("text")).cast(pa.large_binary()).fill_null(b"")
            tail = np.concatenate([p.column(2).to_numpy() for p in rated(iter([pa.RecordBatch.from_arrays([pa.array(np.zeros(batch.num_rows, np.int64)), text], names=["doc_id", "text"])]))])
            yield batch.filter(pa.array(tail >= keep_at))
    return run


def select(docs: DataFrame, labels: DataFrame, most: int = SAMPLE, keep_at: float = KEEP_AT) -> DataFrame:
    """The rows of `docs` that `rate` keeps, with all their columns."""
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, most))
    return docs.mapInArrow(_select(model, keep_at), docs.schema)
