"""Hard-negative mining over anchor-clustered shared lists.

Anchors are clustered by direction. For a cluster with centre c and largest angle b between
c and a member, a candidate x at angle t from c scores at most |a||x|cos(max(0, t - b)) with
any member a. A task holds a shard of candidates and one cluster block: it sorts the
candidates by |x|cos(max(0, t - b)) once, and every member of the block walks that one list
until the bound of what follows is below what the member still needs - a certificate, so
results are exact whatever the clustering. Members walk in blocks of candidates whose scores
are one matrix product.

A first pass finds each anchor's positives; a second one, with the band of scores that each
positive allows, its negatives. Candidates are dealt into shards of bounded size and anchors
into blocks of bounded size, and both are repeated so that a task meets a bounded number of
either: tasks, not their size, grow with the table, and pairs of vectors never become rows.
"""
from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from pitscreen.llm.common import as_long, stored

SHARD = 8192
BLOCK = 256
BLOCKS = 32            # anchor blocks that visit a shard in one task
CLUSTERS = 16
SAMPLE = 4096          # anchors that the centres are fitted on
STEP = 256
EXACT = float(1 << 53)
MOST = (1 << 63) - 1
SCHEMA = "row long, vec_id long, label long, vector binary"


def quantized(vectors: DataFrame, label: Column, scale: int = 256) -> DataFrame:
    """(row, vec_id, label, vector): floor(scale * component) of every row that takes part, as packed doubles.

    Rows with a null id, label or vector, or a null or non-finite component, take no part; an empty vector does, with
    score 0. Exact repeats of a row are one row; rows that share an id but differ are rows of their own. `row` is the
    digest of a row's content.
    """
    rows = vectors.select(as_long("vec_id").alias("vec_id"), label.cast("long").alias("label"), F.col("embedding").cast("array<double>").alias("x"))
    rows = rows.filter("vec_id is not null and label is not null and x is not null and forall(x, v -> v is not null and not isnan(v) and abs(v) < double('infinity'))")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(2)
            offsets = column.offsets.to_numpy()
            flat = np.floor(scale * column.values.to_numpy()) + 0.0
            packed = [flat[a:b].tobytes() for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(packed, pa.binary())], names=["vec_id", "label", "vector"])

    packed = rows.mapInArrow(pack, "vec_id long, label long, vector binary").distinct()
    return packed.select(F.xxhash64("vec_id", "label", "vector").alias("row"), "vec_id", "label", "vector")


def matrix(column: pa.Array) -> np.ndarray:
    """Packed vectors as rows; shorter ones are filled with zeros, which change no inner product."""
    parts = [np.frombuffer(x.as_py(), np.float64) for x in column]
    out = np.zeros((len(parts), max((len(p) for p in parts), default=0)))
    for i, p in enumerate(parts):
        out[i, :len(p)] = p
    return out


def scores(a: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Integer inner products of all rows of `a` with all rows of `x`; beyond 64 bits they stop at the largest long."""
    width = min(a.shape[1], x.shape[1])
    a, x = a[:, :width], x[:, :width]
    with np.errstate(over="ignore"):
        reach = float(np.sqrt((a * a).sum(axis=1).max(initial=0.0)) * np.sqrt((x * x).sum(axis=1).max(initial=0.0)))
    if reach < EXACT:
        return (a @ x.T).astype(np.int64)
    left, right = ([[int(v) for v in row] for row in m.tolist()] for m in (a, x))
    return np.array([[max(-MOST, min(MOST, sum(p * q for p, q in zip(u, v)))) for v in right] for u in left], np.int64).reshape(len(a), len(x))


def _lengths(x: np.ndarray) -> np.ndarray:
    most = np.abs(x).max(axis=1, initial=0.0)
    safe = np.where(most > 0, most, 1.0)
    return most * np.sqrt(((x / safe[:, None]) ** 2).sum(axis=1))


def _directions(x: np.ndarray) -> np.ndarray:
    length = _lengths(x)
    return x / np.where(length > 0, length, 1.0)[:, None]


def centres(sample: np.ndarray, clusters: int = CLUSTERS, rounds: int = 10) -> np.ndarray:
    """Spherical k-means, started from points far apart."""
    x = _directions(sample)
    if not len(x):
        return x
    picked, nearest = [0], x @ x[0]
    while len(picked) < min(clusters, len(x)):
        picked.append(int(nearest.argmin()))
        nearest = np.maximum(nearest, x @ x[picked[-1]])
    out = x[picked]
    for _ in range(rounds):
        to = (x @ out.T).argmax(axis=1)
        sums = np.zeros_like(out)
        np.add.at(sums, to, x)
        alive = _lengths(sums) > 0
        out[alive] = _directions(sums[alive])
    return out


class Shared:
    """A shard's candidates; `ordered` gives them by falling bound for a cluster block."""

    def __init__(self, batch: pa.Table):
        self.row, self.ids, self.label = (batch.column(c).to_numpy() for c in ("row", "vec_id", "label"))
        self.x = matrix(batch.column("vector").combine_chunks())
        self.length, self.direction = _lengths(self.x), _directions(self.x)

    def ordered(self, members: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        width = max(members.shape[1], self.x.shape[1])
        m, d = (np.pad(v, ((0, 0), (0, width - v.shape[1]))) for v in (_directions(members), self.direction))
        centre = _directions(m.sum(axis=0)[None])[0]
        spread = np.arccos(np.clip(m @ centre, -1, 1)).max(initial=0.0)
        bound = self.length * np.cos(np.maximum(0.0, np.arccos(np.clip(d @ centre, -1, 1)) - spread))
        order = np.argsort(-bound, kind="stable")
        return order, bound[order]


def walk(shared: Shared, members: np.ndarray, need: np.ndarray, take: Callable[[int, np.ndarray, np.ndarray], float]) -> None:
    """Every member walks the shared list until the bound of the rest is below what it needs.

    `take(member, scores, candidates)` receives each stretch of the list and returns the smallest score that could
    still matter to the member, from `need` on upwards.
    """
    order, bound = shared.ordered(members)
    lengths = _lengths(members)
    need = need.astype(float)
    active = np.arange(len(members))
    at, step = 0, STEP
    while at < len(order) and len(active):
        # rounding of norms and angles: far below 1e-6 of the product of the lengths
        reach = lengths[active] * (bound[at] + 1e-6 * shared.length.max(initial=0.0)) + 1.0
        active = active[reach >= need[active]]
        part = order[at:at + step]
        found = scores(members[active], shared.x[part])
        for i, m in enumerate(active.tolist()):
            need[m] = take(m, found[i], part)
        at, step = at + step, min(2 * step, 4096)


def _best(score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best scores, ties to the smaller id."""
    return np.lexsort((ids, -score))[:k]


class Best:
    """The k best (score, id) met so far."""

    def __init__(self, k: int):
        self.k, self.score, self.ids = k, np.zeros(0, np.int64), np.zeros(0, np.int64)

    def add(self, score: np.ndarray, ids: np.ndarray) -> None:
        if len(self.score) >= self.k:
            some = score >= self.score[-1]
            score, ids = score[some], ids[some]
        if len(score):
            score, ids = np.concatenate([self.score, score]), np.concatenate([self.ids, ids])
            top = _best(score, ids, self.k)
            self.score, self.ids = score[top], ids[top]

    def floor(self, low: float = -np.inf) -> float:
        return max(low, float(self.score[-1])) if len(self.score) >= self.k else low


def _positives(shared: Shared, block: pa.Table, count: int) -> dict:
    members, row, label = matrix(block.column("vector").combine_chunks()), block.column("row").to_numpy(), block.column("label").to_numpy()
    best = [Best(count) for _ in row]

    def take(m: int, score: np.ndarray, part: np.ndarray) -> float:
        mine = (shared.label[part] == label[m]) & (shared.row[part] != row[m])
        best[m].add(score[mine], shared.ids[part[mine]])
        return best[m].floor()

    walk(shared, members, np.full(len(row), -np.inf), take)
    sizes = [len(b.ids) for b in best]
    return {"row": np.repeat(row, sizes), "positive_id": np.concatenate([b.ids for b in best]), "positive_score": np.concatenate([b.score for b in best])}


def bands(positive: np.ndarray, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
    """Smallest and largest integer score with low * positive <= 100 * score <= high * positive."""
    p = [int(v) for v in positive]
    return np.array([-(-low * v // 100) for v in p], np.int64), np.array([high * v // 100 for v in p], np.int64)


def _negatives(shared: Shared, block: pa.Table, count: int, low: int, high: int) -> dict:
    members, row, label = matrix(block.column("vector").combine_chunks()), block.column("row").to_numpy(), block.column("label").to_numpy()
    positive = [np.array(p, np.int64) for p in block.column("positive_scores").to_pylist()]
    spans = [bands(p, low, high) for p in positive]
    best = [[Best(count) for _ in p] for p in positive]

    def take(m: int, score: np.ndarray, part: np.ndarray) -> float:
        lows, highs = spans[m]
        other = (shared.label[part] != label[m]) & (score >= lows.min()) & (score <= highs.max())
        score, ids = score[other], shared.ids[part[other]]
        for b, l, h in zip(best[m], lows.tolist(), highs.tolist()):
            some = (score >= l) & (score <= h)
            if some.any():
                b.add(score[some], ids[some])
        return min(b.floor(l) for b, l in zip(best[m], lows.tolist()))

    walk(shared, members, np.array([s[0].min(initial=MOST) for s in spans]), take)
    which = [(m, i, len(b.ids)) for m, of in enumerate(best) for i, b in enumerate(of) if len(b.ids)]
    each = [best[m][i] for m, i, _ in which]
    return {"row": np.repeat(row[[m for m, _, _ in which]], [n for _, _, n in which]) if which else np.zeros(0, np.int64),
            "place": np.repeat([i for _, i, _ in which], [n for _, _, n in which]) if which else np.zeros(0, np.int64),
            "negative_id": np.concatenate([b.ids for b in each]) if each else np.zeros(0, np.int64),
            "negative_score": np.concatenate([b.score for b in each]) if each else np.zeros(0, np.int64)}


def _visits(find: Callable[[Shared, pa.Table], dict], names: list[str]):
    """A mapInArrow function over rows sorted by (shard, part, block): a shard's candidates (block -1), then its anchor blocks."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mark, waiting, shared = None, [], None

        def settle() -> Iterator[pa.RecordBatch]:
            nonlocal shared
            if not waiting:
                return
            table = pa.Table.from_batches(waiting)
            if mark[2] < 0:
                shared = (mark[:2], Shared(table))
            elif shared and shared[0] == mark[:2]:
                found = find(shared[1], table)
                yield pa.RecordBatch.from_arrays([pa.array(found[c], pa.int64()) for c in names], names=names)

        for batch in batches:
            cols = [batch.column(c).to_numpy() for c in ("shard", "part", "block")]
            change = np.zeros(len(cols[0]), bool)
            for c in cols:
                change[1:] |= c[1:] != c[:-1]
            cuts = [0, *np.flatnonzero(change).tolist(), len(cols[0])]
            for a, b in zip(cuts[:-1], cuts[1:]):
                if a == b:
                    continue
                now = tuple(int(c[a]) for c in cols)
                if now != mark:
                    yield from settle()
                    mark, waiting = now, []
                waiting.append(batch.slice(a, b - a))
        yield from settle()
    return run


def _met(candidates: DataFrame, anchors: DataFrame, shards: int, together: int, several: int, find, names: list[str]) -> DataFrame:
    """Rows of `find` over every shard of candidates and every block of anchors."""
    parts = -(-several // together)
    extra = F.lit(None).cast("array<long>")
    left = candidates.select("*", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"), F.lit(-1).alias("block"), extra.alias("positive_scores"))
    right = anchors.select("row", "vec_id", "label", "vector", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"),
                           F.floor(F.col("block") / together).cast("int").alias("part"), "block", "positive_scores" if "positive_scores" in anchors.columns else extra.alias("positive_scores"))
    both = left.select(*right.columns).unionByName(right).repartition("shard", "part").sortWithinPartitions("shard", "part", "block", "vec_id")
    return both.mapInArrow(_visits(find, names), ", ".join(f"{c} long" for c in names))


def blocks(anchors: DataFrame, clusters: int = CLUSTERS, sample: int = SAMPLE, size: int = BLOCK) -> tuple[DataFrame, int]:
    """Anchors with the block of about `size` members at most that they belong to, and the number of blocks.

    The centres are fitted on the `sample` anchors with the smallest digests; blocks of one cluster are dealt by digest.
    """
    picked = anchors.orderBy(F.xxhash64("row"), "row").limit(sample).select("vector").toArrow().column("vector").combine_chunks()
    centre = centres(matrix(picked), clusters)
    shared = anchors.sparkSession.sparkContext.broadcast(centre)   # `clusters` vectors

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, c = _directions(matrix(batch.column(3))), shared.value
            width = min(x.shape[1], c.shape[1])
            to = (x[:, :width] @ c[:, :width].T).argmax(axis=1) if len(c) else np.zeros(len(x), np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(to, pa.int64())], names=[*batch.schema.names, "cluster"])

    assigned = stored(anchors.select("row", "vec_id", "label", "vector").mapInArrow(nearest, SCHEMA + ", cluster long"), "assigned")
    sizes = {r["cluster"]: r["count"] for r in assigned.groupBy("cluster").count().collect()}   # at most `clusters` rows
    block, first = F.lit(0).cast("long"), 0
    for cluster, count in sorted(sizes.items()):
        several = -(-count // size)
        block = F.when(F.col("cluster") == cluster, F.lit(first) + F.pmod(F.xxhash64(F.lit(7), "row"), F.lit(several))).otherwise(block)
        first += several
    return assigned.withColumn("block", block.cast("int")), max(1, first)


def mine(rows: DataFrame, anchor: Column, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90,
         shard: int = SHARD, block: int = BLOCK, together: int = BLOCKS) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) over `rows` as `quantized` gives them.

    Anchors are the rows that satisfy `anchor`. An anchor's positives are its first `positives` other rows of its label;
    for each of them, negatives are the first `negatives` rows of other labels whose score s satisfies
    low * positive <= 100 * s <= high * positive. Higher scores come first, ties by smaller id. Vectors of different widths
    meet as if filled with zeros; zero vectors score 0; anchors without positives or without negatives have no rows; an
    empty table gives an empty result. A task meets about `shard` candidates and `together` blocks of `block` anchors.
    """
    rows = stored(rows, "vectors")
    count = rows.count()
    shards = max(1, -(-count // shard))
    candidates = rows.withColumn("shard", F.pmod(F.xxhash64(F.lit(3), "row"), F.lit(shards)).cast("int"))
    anchors, several = blocks(rows.filter(anchor), size=block)

    found = _met(candidates, anchors, shards, together, several, lambda s, b: _positives(s, b, positives), ["row", "positive_id", "positive_score"])
    order = Window.partitionBy("row").orderBy(F.desc("positive_score"), "positive_id")
    top = stored(found.withColumn("place", F.row_number().over(order) - 1).filter(F.col("place") < positives), "positives")
    known = top.groupBy("row").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "positive_score"))), lambda s: s["positive_score"]).alias("positive_scores"))
    ready = stored(anchors.join(known, "row"), "ready")

    met = _met(candidates, ready, shards, together, several, lambda s, b: _negatives(s, b, negatives, low, high), ["row", "place", "negative_id", "negative_score"])
    order = Window.partitionBy("row", "place").orderBy(F.desc("negative_score"), "negative_id")
    kept = met.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= negatives)
    named = top.join(anchors.select("row", F.col("vec_id").alias("anchor_id")), "row")
    return kept.join(named, ["row", "place"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
