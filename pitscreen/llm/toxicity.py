"""Toxicity by weak supervision.

Voters look at a text: fixed lexicons by theme, patterns (an insult after "you",
masked words, shouting), and lexicons of whole words and word beginnings that the
training labels bring out. A generative label model explains how often the votes
occur together: a hidden class, and for each voter how often it votes in either
class. Voters that stay correlated within a class are put into one block that is
modelled jointly, so copies of one signal count once. The label, where a training row
has one, is a voter too, so its noise is estimated like any other. A linear
classifier over hashed words and word beginnings is then fitted to the posteriors.

Counts of vote patterns cover all training rows; there are at most 3 * 2**voters of
them. Only the lexicons and the classifier are fitted on a bounded sample, at most
SAMPLE labelled rows.
"""
from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from pitscreen.llm import textnum
from pitscreen.llm.common import as_long, buffers, chunks, stored, utf8
from pitscreen.llm.hashed import fit_logistic, labelled_ids, sigmoid, trimmed, with_labels

SAMPLE = 12_000
BITS = 18                    # of a hashed word or word beginning
STEMS = (4, 5, 6)            # lengths of word beginnings in bytes
FEATURES = 2048              # learned at most
PENALTY = 1e-4
THRESHOLD = 0.7

# Everyday English insults by theme.
LEXICONS = {
    "stupid": "idiot idiots moron morons stupid dumb fool imbecile cretin brainless halfwit dimwit",
    "worthless": "loser losers worthless pathetic useless trash garbage scum vermin filth",
    "disgust": "disgusting vile filthy repulsive revolting nasty",
    "mock": "clown clowns freak freaks creep weirdo",
    "hate": "hate hateful bastard bitch asshole fuck fucking shit bullshit whore slut",
}
SECOND_PERSON = "you your you're youre ur u"
VOTERS = (*LEXICONS, "at_you", "masked", "shouting", "words", *[f"stem{k}" for k in STEMS])
LEARNED = len(LEXICONS) + 3


def _hash(word: str) -> int:
    data = np.frombuffer(word.encode(), np.uint8)
    return int(textnum.words(data, np.array([0, len(data)])).hash[0])


def _lexicon() -> tuple[np.ndarray, np.ndarray]:
    bits = {}
    for number, words in enumerate(LEXICONS.values()):
        for word in words.split():
            bits[_hash(word)] = 1 << number
    keys = np.array(sorted(bits), np.uint64)
    return keys, np.array([bits[int(k)] for k in keys], np.int64)


def _member(values: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Index into the sorted keys, or -1."""
    at = np.minimum(np.searchsorted(keys, values), len(keys) - 1)
    return np.where(keys[at] == values, at, -1)


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashed words and word beginnings as (row, feature), and the votes of the fixed voters by row.

    Feature k * 2**BITS + h: h is the hash of a whole word (k = 0) or of a beginning of STEMS[k - 1] bytes.
    """
    data = textnum.LOWER[data]
    rows = len(offsets) - 1
    found = textnum.words(data, offsets)
    votes = np.zeros(rows, np.int64)
    if len(found.doc):
        start, end = trimmed(data, found)
        whole = textnum.span_hash(found.sums, start, end)
        keys, masks = _LEXICON
        hit = _member(whole, keys)
        bad = np.flatnonzero(hit >= 0)
        np.bitwise_or.at(votes, found.doc[bad], masks[hit[bad]])
        at_you = np.zeros(len(bad), bool)
        for back in (1, 2, 3):
            ok = bad >= back
            near = np.where(ok, bad - back, 0)
            at_you |= ok & (found.doc[near] == found.doc[bad]) & (_member(whole[near], _YOU) >= 0)
        np.bitwise_or.at(votes, found.doc[bad[at_you]], 1 << len(LEXICONS))
        doc, out = [found.doc], [(whole >> np.uint64(64 - BITS)).astype(np.int64)]
        for k, size in enumerate(STEMS, 1):
            long = end - start > size
            doc.append(found.doc[long])
            out.append((k << BITS) + (textnum.span_hash(found.sums, start[long], start[long] + size) >> np.uint64(64 - BITS)).astype(np.int64))
        doc, out = np.concatenate(doc), np.concatenate(out)
    else:
        doc = out = np.zeros(0, np.int64)
    for row in range(rows):
        text = data[offsets[row]:offsets[row + 1]].tobytes()
        if b"**" in text and _MASKED.search(text):
            votes[row] |= 1 << len(LEXICONS) + 1
        if text.count(b"!!") > 2:
            votes[row] |= 1 << len(LEXICONS) + 2
    return doc, out, votes


_LEXICON = _lexicon()
_YOU = np.array(sorted(_hash(w) for w in SECOND_PERSON.split()), np.uint64)
_MASKED = re.compile(rb"\b[a-z]\*{2,}[a-z]*")


def _sample_features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = buffers(batch.column(1))
        for a, b in chunks(offsets):
            at = offsets[a:b + 1]
            doc, out, votes = features(data[at[0]:at[-1]], at - at[0])
            both = np.unique(doc << 32 | out)
            cut = np.searchsorted(both >> 32, np.arange(b - a + 1))
            lists = pa.ListArray.from_arrays(pa.array(cut, pa.int32()), pa.array((both & 0xFFFFFFFF).astype(np.int32)))
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), batch.column(2).slice(a, b - a), pa.array(votes), lists], names=["doc_id", "toxic", "votes", "features"])


def _tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many toxic and other rows hold each feature, as one row for a partition's feature."""
    counts = np.zeros((2, (len(STEMS) + 1) << BITS), np.int32)
    for batch in batches:
        for toxic, row in zip(batch.column(0).to_pylist(), batch.column(1)):
            counts[int(toxic == 1)][row.values.to_numpy()] += 1
    some = np.flatnonzero(counts[1] + counts[0])   # single ones too: a feature may be alone in each of many partitions
    if len(some):
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(counts[1][some]), pa.array(counts[0][some])], names=["feature", "toxic", "other"])


def _chosen(chosen):
    """Rows of the sample, cut to the chosen features (by their place among them)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = chosen.value
        for batch in batches:
            lists = []
            for row in batch.column(3):
                place = _member(row.values.to_numpy().astype(np.int64), keys)
                lists.append(place[place >= 0].astype(np.int32))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(lists, pa.list_(pa.int32()))], names=["doc_id", "toxic", "votes", "features"])
    return run


def learned_lexicon(counts: np.ndarray, least: int = 3, precision: float = 0.5) -> np.ndarray:
    """Features (rows of [feature, toxic rows, other rows]) whose rows are toxic with at least this share: the lower
    end of the 90 % score interval of the share counts."""
    n = counts[:, 1] + counts[:, 2]
    share, z = counts[:, 1] / np.maximum(n, 1), 1.645
    low = (share + z * z / (2 * n) - z * np.sqrt(share * (1 - share) / n + z * z / (4 * n * n))) / (1 + z * z / n)
    return np.sort(counts[(counts[:, 1] >= least) & (low >= precision)][:, 0])


class LabelModel:
    """P(votes | class) with one table for each block of voters, and the class shares."""

    def __init__(self, voters: int, most_in_block: int = 5, rounds: int = 60, linked: float = 0.25):
        self.voters, self.most, self.rounds, self.linked = voters, most_in_block, rounds, linked
        self.blocks = [[v] for v in range(voters)]

    def _codes(self, votes: np.ndarray) -> list[np.ndarray]:
        return [sum(((votes >> v & 1) << i) for i, v in enumerate(block)) for block in self.blocks]

    def _learn(self, votes, gold, count, posterior) -> None:
        self.share = float((count @ posterior + 1) / (count.sum() + 2))
        self.tables = []
        for block, code in zip(self.blocks, self._codes(votes)):
            table = np.stack([np.bincount(code, weights=count * p, minlength=1 << len(block)) + 0.5 for p in (1 - posterior, posterior)])
            self.tables.append(table / table.sum(axis=1, keepdims=True))
        have = gold >= 0
        table = np.stack([np.bincount(gold[have], weights=(count * p)[have], minlength=2) + 0.5 for p in (1 - posterior, posterior)])
        self.gold = table / table.sum(axis=1, keepdims=True)

    def posterior(self, votes: np.ndarray, gold: np.ndarray) -> np.ndarray:
        odds = np.full(len(votes), np.log(self.share / (1 - self.share)))
        for table, code in zip(self.tables, self._codes(votes)):
            odds += np.log(table[1][code] / table[0][code])
        return sigmoid(odds + np.where(gold >= 0, np.log(self.gold[1] / self.gold[0])[np.maximum(gold, 0)], 0.0))

    def fit(self, votes: np.ndarray, gold: np.ndarray, count: np.ndarray) -> "LabelModel":
        """Expectation-maximization from the labels, where there are some, and else from a majority of the voters."""
        any_vote = np.minimum(1.0, sum((votes >> v & 1) for v in range(self.voters)) / 2.0)
        start = np.where(gold == 1, 0.9, np.where(gold == 0, 0.05, 0.05 + 0.6 * any_vote))
        for _ in range(2):
            posterior = start
            for _ in range(self.rounds):
                self._learn(votes, gold, count, posterior)
                posterior = self.posterior(votes, gold)
            self.correlation = self._correlations(votes, count, posterior)
            self.blocks = self._joined()
        posterior = start
        for _ in range(self.rounds):
            self._learn(votes, gold, count, posterior)
            posterior = self.posterior(votes, gold)
        bits = np.stack([votes >> v & 1 for v in range(self.voters)])
        self.accuracy = np.array([(count * np.where(b == 1, posterior, 1 - posterior)).sum() / count.sum() for b in bits])
        return self

    def _correlations(self, votes, count, posterior) -> np.ndarray:
        """Correlations of the votes within a class, over both classes."""
        bits = np.stack([(votes >> v & 1) for v in range(self.voters)]).astype(float)
        within = np.zeros((self.voters, self.voters))
        for p in (count * (1 - posterior), count * posterior):
            centred = bits - (bits @ p / max(p.sum(), 1e-9))[:, None]
            within += (centred * p) @ centred.T
        spread = np.sqrt(np.maximum(np.diag(within), 1e-9))
        return within / spread[:, None] / spread[None, :]

    def _joined(self) -> list[list[int]]:
        blocks = [[v] for v in range(self.voters)]
        pairs = sorted(((abs(self.correlation[i, j]), i, j) for i in range(self.voters) for j in range(i)), reverse=True)
        for size, i, j in pairs:
            a, b = next(x for x in blocks if i in x), next(x for x in blocks if j in x)
            if size >= self.linked and a is not b and len(a) + len(b) <= self.most:
                blocks.remove(b)
                a += b
        return blocks


def _votes(lexicon):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = np.zeros((len(STEMS) + 1) << BITS, bool)
        kinds[lexicon.value] = True
        for batch in batches:
            data, offsets = buffers(batch.column(1))
            for a, b in chunks(offsets):
                at = offsets[a:b + 1]
                doc, out, votes = features(data[at[0]:at[-1]], at - at[0])
                hit = kinds[out]
                np.bitwise_or.at(votes, doc[hit], 1 << (LEARNED + (out[hit] >> BITS)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(votes)], names=["doc_id", "votes"])
    return run


def _score(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, weights, bias = model.value
        table = np.zeros((len(STEMS) + 1) << BITS, np.float64)
        table[keys] = weights
        for batch in batches:
            data, offsets = buffers(batch.column(1))
            for a, b in chunks(offsets):
                at = offsets[a:b + 1]
                doc, out, _ = features(data[at[0]:at[-1]], at - at[0])
                hit = table[out] != 0
                both = np.unique(doc[hit] << 32 | out[hit])
                margin = np.bincount(both >> 32, weights=table[both & 0xFFFFFFFF], minlength=b - a) + bias
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(sigmoid(margin))], names=["doc_id", "score"])
    return run


def _fixed_features() -> np.ndarray:
    return np.unique((_LEXICON[0] >> np.uint64(64 - BITS)).astype(np.int64))


def held_out(doc_id: Column) -> Column:
    """Whether labels of this row stay unseen: crc32 of the id as text, modulo 3, is 1; a null id is not held out."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(3)) == 1, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, most: int = SAMPLE) -> tuple[np.ndarray, np.ndarray, float]:
    """Features, weights and bias of the classifier, from the rows that are not held out.

    Without any training label of either class the fixed voters alone decide: the lexicon features carry fixed weights.
    """
    spark = docs.sparkSession
    texts = docs.select(as_long("doc_id").alias("doc_id"), utf8().alias("text")).filter(~held_out(F.col("doc_id")))
    ids = labelled_ids(labels, ["toxic"], most, ~held_out(F.col("doc_id")))
    sample = stored(with_labels(texts, ids).select("doc_id", "text", "toxic")
                    .mapInArrow(_sample_features, "doc_id long, toxic int, votes long, features array<int>"), "toxic-sample")
    size = {r["toxic"]: r["count"] for r in sample.groupBy("toxic").count().collect()}
    if len(size) < 2:
        keys = _fixed_features()
        return keys, np.full(len(keys), 4.0), -2.0
    tally = sample.select("toxic", "features").mapInArrow(_tally, "feature int, toxic int, other int").groupBy("feature").agg(F.sum("toxic").alias("toxic"), F.sum("other").alias("other"))
    best = tally.filter("toxic >= 3 and toxic > other").orderBy(F.desc(F.col("toxic") - F.col("other")), "feature").limit(FEATURES)
    counts = np.array([list(r) for r in best.select("feature", "toxic", "other").collect()], np.int64).reshape(-1, 3)
    lexicon = learned_lexicon(counts)

    votes = texts.mapInArrow(_votes(spark.sparkContext.broadcast(lexicon)), "doc_id long, votes long")
    gold = labels.select(as_long("doc_id").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).dropna().groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    patterns = np.array([list(r) for r in votes.join(gold, "doc_id", "left").groupBy("votes", F.coalesce("toxic", F.lit(-1)).alias("toxic")).count().collect()], np.int64)
    model = LabelModel(len(VOTERS)).fit(patterns[:, 0], np.clip(patterns[:, 1], -1, 1), patterns[:, 2].astype(float))

    keys = np.union1d(lexicon, _fixed_features())
    rows = sample.mapInArrow(_chosen(spark.sparkContext.broadcast(keys)), "doc_id long, toxic int, votes long, features array<int>").collect()
    rows.sort(key=lambda r: (r["doc_id"], r["votes"], r["features"]))
    x = np.zeros((len(rows), len(keys)), np.float32)
    mask = np.zeros(len(rows), np.int64)
    in_lexicon = np.isin(keys, lexicon)
    for i, row in enumerate(rows):
        x[i, row["features"]] = 1
        mask[i] = row["votes"]
        for place in row["features"]:
            if in_lexicon[place]:
                mask[i] |= 1 << int(LEARNED + (keys[place] >> BITS))
    target = model.posterior(mask, np.array([r["toxic"] for r in rows]))
    weights, bias = fit_logistic(x, target, PENALTY, 600, prior=np.where(np.isin(keys, _fixed_features()), 4.0, 1.0))
    return keys, weights, bias


def score(docs: DataFrame, labels: DataFrame, most: int = SAMPLE, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of `docs` (doc_id, text, any other columns).

    A null or empty text gets the score of the bias alone. Every row comes back, also one with a null id
    (never held out) or a repeated one. An empty table gives an empty result. Labels of held-out rows are
    never read; only the text enters a score.
    """
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, most))
    scored = docs.select(as_long("doc_id").alias("doc_id"), utf8().alias("text")).mapInArrow(_score(model), "doc_id long, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
