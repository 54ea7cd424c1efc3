"""What the fit on the bounded sample holds in the driver beside the sample itself."""
import tracemalloc

import numpy as np
from pyspark.sql import functions as F

from pitscreen.llm import hashed, quality_classifier, quality_rules
from pitscreen.llm.hashed import WIDTH, _top_eigenvalue, labelled_ids


def peak_of(call):
    tracemalloc.start()
    try:
        return call(), tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()


def sample(n, width, seed=3):
    rng = np.random.default_rng(seed)
    x = np.sqrt(rng.random((n, width)) * (rng.random((n, width)) < 0.2) / 10).astype(np.float16).astype(np.float32)
    grade = rng.integers(0, 3, n)
    x[:, 0] = grade / 4 + rng.random(n) / 2
    return x, grade


def test_fit_copies_no_sample():
    x, grade = sample(3_000, WIDTH)
    _, peak = peak_of(lambda: quality_classifier.fit_ordinal(x, grade, steps=2))
    assert peak < x.nbytes / 3, (peak, x.nbytes)   # a copy as doubles would be twice the sample


def test_blocks_of_rows_sum_up_to_all_rows(monkeypatch):
    """Of 300 rows the last block is a part."""
    x, grade = sample(300, 60)
    weight = np.random.default_rng(1).random(300) / 300
    w, cut = quality_classifier.fit_ordinal(x, grade, steps=20)
    top = _top_eigenvalue(x, weight)
    whole = lambda x: iter([(slice(0, len(x)), x.astype(float))])
    monkeypatch.setattr(hashed, "row_blocks", whole)
    monkeypatch.setattr(quality_classifier, "row_blocks", whole)
    v, at = quality_classifier.fit_ordinal(x, grade, steps=20)
    assert np.abs(w).max() > 0.1 and np.allclose(w, v, rtol=0, atol=1e-12) and np.allclose(cut, at, rtol=0, atol=1e-12)
    assert abs(top / _top_eigenvalue(x, weight) - 1) < 1e-12


def test_sample_comes_a_partition_at_a_time(spark, monkeypatch):
    """Never a collect of the vectors; the same rows and order whatever the partitions, repeated ids included."""
    rng = np.random.default_rng(9)
    texts = [" ".join(f"w{k}" for k in rng.integers(0, 50, rng.integers(0, 30))) for _ in range(80)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(3, "another text"), (3, texts[3]), (4, None), (None, "none")], "doc_id long, text string")
    ids = labelled_ids(docs.filter("doc_id is not null").select("doc_id", (F.col("doc_id") % 3).alias("grade")), ["grade"], 50)
    wide, one = docs.repartition(7), docs.coalesce(1)
    monkeypatch.setattr(type(docs), "collect", lambda self: (_ for _ in ()).throw(AssertionError("collected")))
    a, x, y = quality_rules.sample_vectors(wide, ids, "grade")
    b, z, u = quality_rules.sample_vectors(one, ids, "grade")
    assert x.dtype == np.float32 and x.shape == (len(a), WIDTH) and (np.diff(a) >= 0).all() and len(set(a.tolist())) == 50
    assert (a == b).all() and (x == z).all() and (y == u).all() and (y == a % 3).all()
    none = quality_rules.sample_vectors(docs.limit(0), ids, "grade")
    assert [len(v) for v in none] == [0, 0, 0]
