"""Approximate nearest neighbours by low-dimensional stable projections and kd-trees.

Inner products become distances: with the largest norm M of all vectors, x turns into
(x, sqrt(M^2 - |x|^2)) and a query into (q, 0); then the nearest point has the largest
inner product. A Gaussian projection to DIMENSIONS coordinates keeps distances up to a
chi-square factor: projected^2 / true^2 is chi-square with DIMENSIONS degrees of
freedom. Vectors are dealt into shards of bounded size by the hash of their ids. In a
shard a kd-tree over the projections gives the leaves nearest to the projected query;
their members give a first k-th distance. Further leaves are opened by the distance of
their boxes, until the chi-square test says that a point at least as near as the current
k-th would have been met with probability `certainty`. A block of queries goes through
the leaves together: one matrix product scores a leaf for all queries that open it, and
what may be among the k best is scored again row by row. The best of all shards meet.

Queries visit all shards, so on vectors without structure, where hardly a box can be ruled
out, work is queries times vectors, in matrix products; nothing is broadcast but the
projection itself and no pair of vectors becomes a row before it is a result.
"""
from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from pitscreen.llm.common import as_long, stored

DIMENSIONS = 12
LEAF = 96
GROWTH = 4             # so many times the leaves of a round are opened in the next one
ROWS = 1 << 14         # pairs scored row by row at a time
CROWD = 1 << 18        # pairs held between cuts to the k best
SHARD = 1 << 16        # vectors of a shard at most
WIDE = 1 << 22         # components of them at most
SMALL = 4096           # vectors worth a shard, while there are fewer than TASKS
BLOCK = 1024
TASKS = 12
CERTAINTY = 0.95
SEED = 20240229


def chi_square(x: np.ndarray, degrees: int = DIMENSIONS) -> np.ndarray:
    """Distribution function for an even number of degrees of freedom."""
    half = np.asarray(x, float) / 2
    term = total = np.ones_like(half)
    for i in range(1, degrees // 2):
        term = term * half / i
        total = total + term
    return 1 - np.exp(-half) * total


def chi_square_point(p: float, degrees: int = DIMENSIONS) -> float:
    low, high = 0.0, 50.0 * degrees
    for _ in range(80):
        mid = (low + high) / 2
        low, high = (mid, high) if chi_square(np.array(mid), degrees) < p else (low, mid)
    return (low + high) / 2


def projection(width: int, degrees: int = DIMENSIONS) -> np.ndarray:
    """A fixed Gaussian matrix for vectors of `width` components and the added one."""
    return np.random.default_rng(SEED).standard_normal((width + 1, degrees))


def lift(x: np.ndarray, most: float) -> np.ndarray:
    norms = (x * x).sum(axis=1)
    return np.concatenate([x, np.sqrt(np.maximum(0.0, most - norms))[:, None]], axis=1)


class Tree:
    """A kd-tree over projected points: members by leaf, and the leaves' bounding boxes.

    `order` puts the members of each leaf side by side; `points` is in that order.
    """

    def __init__(self, points: np.ndarray, leaf: int = LEAF):
        groups, leaves = [np.arange(len(points))], []
        while groups:
            group = groups.pop()
            if len(group) <= leaf:
                leaves.append(group)
                continue
            spread = points[group].max(axis=0) - points[group].min(axis=0)
            axis = int(spread.argmax())
            half = len(group) // 2
            if spread[axis]:        # else one point many times: any cut will do
                group = group[np.argpartition(points[group, axis], half)]
            groups += [group[:half], group[half:]]
        self.order = np.concatenate(leaves)
        self.points = points[self.order]
        self.norms = np.einsum("ij,ij->i", self.points, self.points)
        self.sizes = np.array([len(g) for g in leaves])
        self.first = np.cumsum(self.sizes) - self.sizes
        self.low = np.stack([points[g].min(axis=0) for g in leaves])
        self.high = np.stack([points[g].max(axis=0) for g in leaves])

    def boxes(self, queries: np.ndarray) -> np.ndarray:
        """Squared distances of projected queries (rows) from the leaves' boxes (columns)."""
        out = np.zeros((len(queries), len(self.sizes)))
        for low, high, at in zip(self.low.T, self.high.T, queries.T):
            side = np.maximum(low - at[:, None], at[:, None] - high)
            np.maximum(side, 0.0, out=side)
            out += side * side
        return out

    def members(self, leaves: np.ndarray) -> np.ndarray:
        """Places in the order of the members of some leaves."""
        size = self.sizes[leaves]
        return np.repeat(self.first[leaves] - np.cumsum(size) + size, size) + np.arange(size.sum())


def search(tree: Tree, ids: np.ndarray, vectors: np.ndarray, most: float, query_id: int, query: np.ndarray, projected: np.ndarray, k: int, ratio: float) -> tuple[np.ndarray, np.ndarray]:
    """Ids and inner products of the k best members found for one query, best first, ties to the smaller id."""
    return search_block(tree, ids, vectors, most, np.array([query_id]), query[None], projected[None], k, ratio)[1:]


def search_block(tree: Tree, ids: np.ndarray, vectors: np.ndarray, most: float, query_ids: np.ndarray, queries: np.ndarray, projected: np.ndarray, k: int, ratio: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Place of the query, id and inner product of the k best members found of each query: by query, best first, ties to the smaller id.

    `ids` and `vectors` are in the tree's order. Every query opens leaves by the distance of their boxes, nearest first, GROWTH
    times as many in a round as before, until the next box fails the test against its k-th so far. A round goes leaf by leaf:
    one product scores a leaf for all queries that open it. Products only screen, with room for their rounding; what may be
    among the k best is scored row by row, so that equal vectors get equal scores.
    """
    norm = np.einsum("ij,ij->i", queries, queries) + most
    slack = 1e-9 * norm
    away = tree.boxes(projected)
    place = np.empty(away.shape, np.int64)      # of a leaf among those of a query
    np.put_along_axis(place, np.argsort(away, axis=1, kind="stable"), np.arange(away.shape[1])[None], axis=1)
    held = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)      # places of queries and members, products
    least = np.full(len(queries), -np.inf)      # the k-th so far

    def exact(asker: np.ndarray, found: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        score = np.empty(len(found))
        for low in range(0, len(found), ROWS):
            score[low:low + ROWS] = (vectors[found[low:low + ROWS]] * queries[asker[low:low + ROWS]]).sum(axis=1)
        best = np.lexsort((ids[found], -score, asker))
        asker, found, score = asker[best], found[best], score[best]
        counts = np.bincount(asker, minlength=len(queries))
        top = np.arange(len(asker)) - np.repeat(np.cumsum(counts) - counts, counts) < k
        return asker[top], found[top], score[top]

    def settle(parts: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """What may still be among the k best, with the k-th of each query renewed."""
        asker, found, score = (np.concatenate(x) for x in zip(*parts))
        other = ids[found] != query_ids[asker]
        asker, found, score = asker[other], found[other], score[other]
        best = np.lexsort((-score, asker))
        counts = np.bincount(asker, minlength=len(queries))
        full = counts >= k
        least[full] = score[best[(np.cumsum(counts) - counts)[full] + k - 1]]
        keep = ~(score < (least - slack)[asker])
        asker, found, score = asker[keep], found[keep], score[keep]
        return exact(asker, found) if len(found) > CROWD else (asker, found, score)    # many copies share the k-th place

    at, to = 0, max(2, 2 * k // LEAF + 1)
    while True:
        with np.errstate(invalid="ignore"):
            reach = np.where(least > -np.inf, ratio * np.maximum(0.0, norm - 2.0 * least) + slack, np.inf)
        want = (place >= at) & (place < to) & ~(away > reach[:, None])
        opened = np.flatnonzero(want.any(axis=0))
        if not len(opened):
            break
        members, low, parts, waiting, floor = tree.members(opened), 0, [held], 0, least - slack
        for leaf, size in zip(opened.tolist(), tree.sizes[opened].tolist()):
            first, who = members[low], np.flatnonzero(want[:, leaf])
            low += size
            asked, bar = (queries, floor) if len(who) == len(queries) else (queries[who], floor[who])
            product = asked @ vectors[first:first + size].T
            near = np.flatnonzero(~(product < bar[:, None]))
            parts.append((who[near // size], first + near % size, product.ravel()[near]))
            waiting += len(near)
            if waiting > CROWD:
                held = settle(parts)
                parts, waiting, floor = [held], 0, least - slack
        held = settle(parts)
        at, to = to, GROWTH * to
    asker, found, score = exact(*held[:2])
    return asker, ids[found], score


def _vectors(column: pa.Array, width: int) -> np.ndarray:
    """Vectors of one width, none of them with a null."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), width)


def _shard_search(most: float, width: int, k: int, certainty: float):
    ratio = chi_square_point(certainty)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by task (a shard and some query blocks), members before queries."""
        matrix = projection(width)
        state = {"task": None, "ids": [], "rows": [], "tree": None}

        def answer(query_ids, queries):
            if not state["ids"]:
                return None
            if state["tree"] is None:
                state["members"] = np.concatenate(state["ids"])
                state["vectors"] = np.concatenate(state["rows"])
                state["tree"] = Tree(lift(state["vectors"], most) @ matrix)
                state.update(members=state["members"][state["tree"].order], vectors=state["vectors"][state["tree"].order], rows=[])
            projected = np.concatenate([queries, np.zeros((len(queries), 1))], axis=1) @ matrix
            asker, found, score = search_block(state["tree"], state["members"], state["vectors"], most, query_ids, queries, projected, k, ratio)
            return pa.RecordBatch.from_arrays([pa.array(query_ids[asker]), pa.array(found), pa.array(score)], names=["query_id", "vec_id", "score"])

        for batch in batches:
            task, block = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            ids, vectors = batch.column(2).to_numpy(), _vectors(batch.column(3), width)
            cuts = np.flatnonzero((task[1:] != task[:-1]) | (block[1:] != block[:-1])) + 1
            for low, high in zip([0, *cuts.tolist()], [*cuts.tolist(), len(ids)]):
                if task[low] != state["task"]:
                    state.update(task=task[low], ids=[], rows=[], tree=None)
                if block[low] < 0:
                    state["ids"].append(ids[low:high]), state["rows"].append(vectors[low:high])
                else:
                    for first in range(low, high, BLOCK):       # a block may be larger where most ids are queries
                        last = min(high, first + BLOCK)
                        out = answer(ids[first:last], vectors[first:last])
                        if out is not None and out.num_rows:
                            yield out
    return run


def nearest(vectors: DataFrame, k: int = 20, query_every: int = 20, certainty: float = CERTAINTY, shard: int | None = None) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found of each row whose id is divisible by `query_every`.

    `vectors` has vec_id, embedding and any other columns. Vectors that are null, zero, empty, or hold null or
    non-finite components take no part, nor do rows with a null id. Shorter vectors are filled with zeros, which change
    no inner product. Rows that repeat an id count once, with the least of their vectors. Ties go to
    the smaller id. With fewer than k candidates all are returned; an empty table gives an empty result.
    """
    embedding = F.col("embedding").cast("array<double>")
    fine = F.expr("size(embedding) > 0 and forall(embedding, v -> v is not null and not isnan(v) and abs(v) < double('Infinity')) and exists(embedding, v -> v <> 0)")
    rows = vectors.select(as_long("vec_id").alias("vec_id"), embedding.alias("embedding")).filter("vec_id is not null and embedding is not null").filter(fine)
    rows = stored(rows.groupBy("vec_id").agg(F.min("embedding").alias("embedding")), "vectors")
    square = F.expr("aggregate(embedding, double(0), (t, v) -> t + v * v)")
    width, held, most = rows.agg(F.max(F.size("embedding")), F.count("*"), F.max(square)).first()
    out = "query_id long, vec_id long, score double"
    if not held:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    shards = math.ceil(held / (shard or max(1, min(SHARD, WIDE // width))))
    if not shard:
        shards = max(shards, min(TASKS, math.ceil(held / SMALL)))   # every query visits every shard: no more than keep the cores busy
    filled = F.when(F.size("embedding") < width, F.concat("embedding", F.array_repeat(F.lit(0.0), F.lit(width) - F.size("embedding")))).otherwise(F.col("embedding"))
    rows = rows.withColumn("embedding", filled)
    queries = rows.filter(F.col("vec_id") % query_every == 0)
    blocks = max(1, math.ceil(held / query_every / BLOCK))
    lanes = min(blocks, max(1, math.ceil(TASKS / shards)))   # a task gets a shard's members and the query blocks of one lane
    every = lambda column, n: F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias(column)
    home = F.pmod(F.xxhash64("vec_id"), F.lit(shards)).cast("int").alias("shard")
    block = F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(blocks)).cast("int").alias("block")
    members = rows.select(home, every("lane", lanes), F.lit(-1).alias("block"), "vec_id", "embedding")
    asked = queries.select(every("shard", shards), F.pmod(block, F.lit(lanes)).cast("int").alias("lane"), block, "vec_id", "embedding")
    tasks = members.unionByName(asked).withColumn("task", F.col("shard") * lanes + F.col("lane"))
    tasks = tasks.repartitionById(shards * lanes, "task").sortWithinPartitions("task", "block", "vec_id")
    found = tasks.select("task", "block", "vec_id", "embedding").mapInArrow(_shard_search(most, width, k, certainty), out)
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best).cast("int")).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
