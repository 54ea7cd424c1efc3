"""The pipeline as a chain: what a stage keeps, it hands on whole."""
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from pitscreen.llm import packing
from pitscreen.llm.common import stored

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Good prose, junk, exact and near copies, secrets, null and repeated ids, null and empty texts, one long text."""
    rng = random.Random(13)
    words = ["the", "river", "carries", "stones", "and", "wind", "over", "hills", "while", "people", "read", "quiet", "letters", "near", "water"]
    prose = lambda n: " ".join(rng.choice(words) for _ in range(n)).capitalize() + "."
    junk = lambda n: " ".join("".join(rng.choice("#$%&@!~^xqz0123456789") for _ in range(rng.randrange(2, 12))) for _ in range(n))
    good = [prose(rng.randrange(40, 120)) + "\n  Second line.\tTabbed" for _ in range(160)]
    rows = [(i, t, "en", f"s{i % 3}", len(t)) for i, t in enumerate(good)]
    rows += [(200 + i, junk(60), "en", "s1", 0) for i in range(80)]
    rows += [(300 + i, good[0], "en", "s2", 0) for i in range(20)] + [(330, good[1] + " more", "en", "s0", 0)]
    rows += [(340, good[2] + ' password = "abcdefghijklmnop1234"', "en", "s0", 0)]
    rows += [(None, good[3], "en", "s0", 0), (None, None, None, None, None), (5, good[0], "en", "s2", 0), rows[7], (350, "", "en", "s1", 0), (351, None, "en", None, 0), (360, prose(30_000), "en", "s1", 0)]
    labels = [(i, 1, 0) for i in range(120)] + [(200 + i, 0, 0) for i in range(60)]
    out = tmp_path_factory.mktemp("corpus")
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{out}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{out}/labels.parquet")
    return str(out), rows


def test_stages_hand_whole_texts_on(spark, folder):
    path, rows = folder
    docs, seen = spark.read.parquet(f"{path}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        before = Counter((r.doc_id, r.text) for r in docs.collect())
        docs = stored(stage(spark, docs, path), "test-stage")
        if name != "packing":
            assert docs.columns == [c.split()[0] for c in SCHEMA.split(", ")], name
            seen[name] = (before, Counter((r.doc_id, r.text) for r in docs.collect()))
    start, kept = seen["quality classifier"]
    assert not kept - start and not any(200 <= (i or 0) < 280 for i, _ in kept) and sum(i is not None and i < 160 for i, _ in kept) >= 155
    before, after = seen["n-gram Jaccard join"]
    assert not after - before and not any(300 <= (i or 0) <= 330 for i, _ in after) and after[7, rows[7][1]] == 1
    assert {i for i, _ in after if i is not None and i < 160} == {i for i, _ in before if i is not None and i < 160}
    assert all(after[None, t] == n for (i, t), n in before.items() if i is None)
    before, after = seen["secret scans"]
    assert sum(before.values()) == sum(after.values()) and all(after[k] == n for k, n in before.items() if k[0] != 340)
    assert not any("abcdefghijklmnop1234" in (t or "") for _, t in after)
    before, after = seen["mixing"]
    assert set(after) <= set(before) and max(after[k] / before[k] for k in after) <= 3
    texts = Counter()
    for r in docs.select("doc_id", "doc_tokens", "length", "sequence_id", "offset").collect():
        texts[r.sequence_id] += r.length
    assert texts and max(texts.values()) <= packing.WINDOW and sum(texts.values()) == docs.agg(F.sum("length")).first()[0]


def test_run_equals_its_stages_and_takes_empty_tables(spark, folder, tmp_path):
    path, _ = folder
    once = Counter((r.doc_id, r.start, r.length, r.ids_crc32) for r in corpus_pipeline.run(spark, path).collect())
    assert once and once == Counter((r.doc_id, r.start, r.length, r.ids_crc32) for r in corpus_pipeline.run(spark, path).collect())
    for name in ("documents", "labels"):
        spark.read.parquet(f"{path}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
