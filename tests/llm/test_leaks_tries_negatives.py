"""Benchmark decontamination, the conversation trie and hard negatives against plain Python."""
import hashlib
import math
import random
import re
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from pitscreen.llm import conversation_trie, decontaminate, hard_negatives
from pitscreen.llm.skew import salted_join

WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
DOCS = "doc_id long, text string, key string, row string, start string, item_id string, print string"
ITEMS = "item_id long, text string, doc_id string, size string"
TALKS = "conv_id long, turn long, role string, text string, pos string, depth string, own string"
VECTORS = "vec_id long, embedding array<float>, label int, row string, block string, shard string"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def same_rows(df, expected):
    key = lambda r: tuple((x is not None, x) for x in r)
    assert sorted(map(tuple, df.collect()), key=key) == sorted(map(tuple, expected), key=key)


def test_salted_join_equals_the_plain_join(spark):
    many = spark.range(3000).select(F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id") % 50).alias("k"), F.col("id").alias("v"))
    few = spark.range(0, 40).select((F.col("id") % 20).alias("k"), F.col("id").alias("w"))
    for how in ("inner", "left"):
        same_rows(salted_join(many, few, ["k"], how, share=8).select("k", "v", "w"), many.join(few, "k", how).select("k", "v", "w").collect())
    assert salted_join(many.filter("v < 0"), few, ["k"]).count() == 0


def words(text):
    return WORD.findall(bytes(b + 32 if 65 <= b <= 90 else b for b in (text or "").encode()))


def expected_leaks(docs, items, window=10):
    found = defaultdict(set)
    for item_id, text, *_ in items:
        w = words(text)
        for i in range(len(w) - min(window, len(w)) + 1 if w else 0):
            found[tuple(w[i:i + window])].add(item_id)
    sizes = {len(k) for k in found}
    for doc_id, text, *_ in docs:
        w = words(text)
        hit, names = set(), set()
        for size in sizes:
            for i in range(len(w) - size + 1):
                if tuple(w[i:i + size]) in found:
                    hit |= set(range(i, i + size))
                    names |= found[tuple(w[i:i + size])]
        names = sorted(str(n) for n in names if n is not None)
        yield doc_id, len(w), len(hit), len(names), sha(",".join(names)), bool(hit)


@pytest.fixture(scope="module")
def leaky():
    rng = random.Random(11)
    vocabulary = [f"w{i}" for i in range(60)] + ["Été", "naïve", "日本", "x1", "The"]
    prose = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items = [(i, prose(n), "clash", "clash") for i, n in enumerate((10, 11, 14, 30, 60, 9, 3, 1, 10))]
    common = items[3][1].split()[4:20]
    items += [(20 + i, " ".join([prose(8), *common, prose(7)]), None, None) for i in range(6)]      # one passage in many items
    items += [(2, prose(12), "c", "c"), (None, prose(15), "c", "c"), (30, "", "c", "c"), (31, None, "c", "c"), (32, "... !?", "c", "c"), items[4]]
    docs = []
    for i in range(60):
        text = prose(rng.randrange(0, 80)).split()
        for _ in range(rng.randrange(3)):
            source = words_of(items[rng.randrange(len(items))][1])
            a = rng.randrange(len(source) + 1)
            at = rng.randrange(len(text) + 1)
            text[at:at] = source[a:a + rng.randrange(8, 40)]
        docs.append((i, rng.choice([" ", "\n", "-_", ". "]).join(text).replace("w1 ", "W1 "), *["c"] * 5))
    docs += [(100 + i, " ".join(common), *["c"] * 5) for i in range(40)]                              # one passage in many documents
    docs += [(200, "", *["c"] * 5), (201, None, *["c"] * 5), (None, items[1][1], *["c"] * 5), docs[3], (3, "other text", *["c"] * 5), (202, " ".join(common), *["c"] * 5)]
    docs.append((203, prose(40_000) + " " + items[0][1] + " " + prose(200), *["c"] * 5))
    return docs, items


def words_of(text):
    return (text or "").split()


@pytest.mark.parametrize("bits", [24, 7])
def test_decontamination_finds_every_shared_window(spark, leaky, bits):
    docs, items = leaky
    got = decontaminate.contamination(spark.createDataFrame(docs, DOCS).repartition(3), spark.createDataFrame(items, ITEMS).repartition(2), bits=bits)
    same_rows(got, expected_leaks(docs, items))


def test_decontamination_of_empty_tables(spark, leaky):
    docs, items = (spark.createDataFrame(rows, schema) for rows, schema in zip(leaky, (DOCS, ITEMS)))
    assert decontaminate.contamination(docs.limit(0), items).count() == 0
    got = decontaminate.contamination(docs, items.limit(0))
    assert got.count() == len(leaky[0]) and got.filter("n_hit > 0 or n_items > 0 or contaminated").count() == 0


def test_without_leaks_judges_each_row_by_its_own_text(spark, leaky):
    docs, items = leaky
    want = [d for d, e in zip(docs, expected_leaks(docs, items)) if not e[5]]
    got = decontaminate.without_leaks(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS))
    assert got.columns == [c.split()[0] for c in DOCS.split(", ")]
    same_rows(got, want)


def expected_trie(rows):
    talks = defaultdict(list)
    for conv_id, turn, role, text, *_ in rows:
        if conv_id is not None:
            role, text = role or "", text or ""
            talks[conv_id].append(((turn is not None, turn or 0), hashlib.md5(role.encode()).hexdigest()[:16], hashlib.md5(text.encode()).hexdigest()[:16], role, text))
    talks = {c: [t[3:] for t in sorted(t)] for c, t in talks.items()}
    nodes = defaultdict(list)
    for c, own in talks.items():
        h = zlib.crc32(str(c).encode()) % 6
        path = talks.get(c - int(math.fmod(c, 100)), [])[:h] + own[h:]
        for d in range(len(path) + 1):
            nodes[tuple(path[:d])].append((c, d == len(path)))
    below = defaultdict(list)
    for key in nodes:
        if key:
            below[key[:-1]].append(key)

    totals = {}
    for key in sorted(nodes, key=len, reverse=True):
        kids = below[key]
        own = (len(nodes[key]) - 1) * len(key[-1][1]) if key else 0
        totals[key] = (sum(totals[k][0] for k in kids) if kids else 1, own + sum(totals[k][1] for k in kids))
    for key, members in nodes.items():
        low = lambda k: min(c for c, _ in nodes[k])
        ends = ",".join(map(str, sorted(c for c, end in members if end)))
        yield (low(key), len(key), low(key[:-1]) if key else None, len(members), len(below[key]), *totals[key], sha(ends))


@pytest.fixture(scope="module")
def talks():
    rng = random.Random(3)
    extra = ["clash"] * 3
    rows = []
    for c in [*range(0, 400, 3), *range(700, 760), -250, -200, 1005, 1006]:                            # 1000 is absent
        for t in range(rng.randrange(1, 9)):
            rows.append((c, t, rng.choice(["user", "assistant", None]), rng.choice(["hi", "hello", "", None, "été 日本", f"only {c} {t}"]), *extra))
    rows += [(c, t, "user", "same opening", *extra) for c in range(2000, 2090) for t in range(3)]      # copies of one conversation
    rows += [(5000, t, "user", f"turn {t % 7}", *extra) for t in range(500)] + [(5100, t, "user", f"turn {t % 7}", *extra) for t in range(480)]
    rows += [(3000, None, "user", "null first", *extra), (3000, 0, "user", "then", *extra), (3000, 0, "user", "a tie", *extra), (3000, 0, "user", "a tie", *extra), (3001, 5, None, None, *extra)]
    rows += [(None, 1, "user", "nobody", *extra), (4000, 1, "user", "x" * 200_000, *extra), rows[5]]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("shard", [2048, 3])
def test_trie_has_every_node_once(spark, talks, shard):
    turns = conversation_trie.turns(spark.createDataFrame(talks, TALKS).repartition(3))
    same_rows(conversation_trie.trie(conversation_trie.rebuilt(turns), shard), expected_trie(talks))


def test_trie_of_an_empty_table_and_of_one_turnless_conversation(spark, talks):
    talks = spark.createDataFrame(talks, TALKS)
    assert conversation_trie.trie(conversation_trie.rebuilt(conversation_trie.turns(talks.limit(0)))).count() == 0
    alone = next(c for c in range(101, 200) if zlib.crc32(str(c).encode()) % 6 > 1)
    got = conversation_trie.trie(conversation_trie.rebuilt(conversation_trie.turns(spark.createDataFrame([(alone, 0, "u", "gone", "", "", "")], TALKS)))).collect()
    assert [tuple(r) for r in got] == [(alone, 0, None, 1, 0, 1, 0, sha(str(alone)))]


def expected_negatives(rows):
    used = set()
    for vec_id, x, label, *_ in rows:
        if vec_id is not None and label is not None and x is not None and all(v is not None and math.isfinite(v) for v in x):
            used.add((vec_id, (label + 1) % 10 if vec_id % 7 == 0 else label, tuple(math.floor(256 * v) for v in x)))
    for a in used:
        if a[0] % 100:
            continue
        scored = [(-max(1 - (1 << 63), min((1 << 63) - 1, sum(p * q for p, q in zip(a[2], r[2])))), r[0], r[1]) for r in used if r != a]
        for ps, p, _ in sorted(s for s in scored if s[2] == a[1])[:5]:
            band = sorted(s for s in scored if s[2] != a[1] and 30 * -ps <= 100 * -s[0] <= 90 * -ps)[:10]
            yield from ((a[0], p, i + 1, n, -ps, -ns) for i, (ns, n, _) in enumerate(band))


@pytest.fixture(scope="module")
def vectors():
    rng = random.Random(8)
    centre = [[rng.gauss(0, 1) for _ in range(6)] for _ in range(4)]
    unit = lambda v: [x / math.sqrt(sum(y * y for y in v)) for x in v]
    clash = ["c"] * 3
    rows = []
    for i in range(700):
        v = unit([x + rng.gauss(0, 0.6) for x in centre[i % 4]])
        rows.append((i, [f32(x) for x in v], rng.randrange(10), *clash))
    hot = [f32(x) for x in unit(centre[0])]
    rows += [(1000 + i, hot, i % 10, *clash) for i in range(300)]                                       # one vector in a third of the rows
    rows += [(2000, None, 1, *clash), (2001, [1.0, None, 0.0, 0.0, 0.0, 0.0], 1, *clash), (2002, [float("nan")] * 6, 1, *clash), (2003, [float("inf")] + [0.0] * 5, 1, *clash)]
    rows += [(2100, hot, None, *clash), (None, hot, 1, *clash), (2200, [0.0] * 6, 3, *clash), (2300, [], 3, *clash), (2400, [1.0, 1.0], 3, *clash), rows[5], rows[100]]
    rows += [(100, [f32(-x) for x in hot], 2, *clash), (2500, [f32(1e18), 0.0, 0.0, 0.0, 0.0, 0.0], 4, *clash), (2501, [f32(-1e18)] + [0.0] * 5, 5, *clash)]
    return rows


def f32(x):
    import numpy as np
    return float(np.float32(x))


def shifted():
    return F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))


@pytest.mark.parametrize("sizes", [{}, {"shard": 60, "block": 2, "together": 2}])
def test_hard_negatives_are_exact(spark, vectors, sizes):
    rows = hard_negatives.quantized(spark.createDataFrame(vectors, VECTORS).repartition(3), shifted())
    got = hard_negatives.mine(rows, F.col("vec_id") % 100 == 0, **sizes)
    want = list(expected_negatives(vectors))
    assert len(want) > 100
    same_rows(got, want)


def test_hard_negatives_of_empty_and_anchorless_tables(spark, vectors):
    some = spark.createDataFrame(vectors, VECTORS)
    for rows in (some.limit(0), some.filter("vec_id % 100 <> 0"), some.filter("vec_id = 200")):
        assert hard_negatives.mine(hard_negatives.quantized(rows, shifted()), F.col("vec_id") % 100 == 0).count() == 0


def test_the_shared_list_stops_early_with_a_certificate():
    import numpy as np
    import pyarrow as pa
    rng = np.random.default_rng(1)
    x = np.floor(256 * np.concatenate([rng.normal([1, 0, 0], 0.05, (3000, 3)), rng.normal([-1, 0, 0], 0.05, (3000, 3))]))
    table = pa.table({"row": np.arange(6000), "vec_id": np.arange(6000), "label": np.zeros(6000, np.int64), "vector": [v.tobytes() for v in x]})
    shared, seen = hard_negatives.Shared(table), []
    best = hard_negatives.Best(5)

    def take(m, score, part):
        seen.extend(part.tolist())
        best.add(score, shared.ids[part])
        return best.floor()

    hard_negatives.walk(shared, x[:1], np.array([-np.inf]), take)
    exact = (x @ x[0]).astype(np.int64)
    assert list(best.score) == sorted(exact, reverse=True)[:5] and len(seen) < 4000
