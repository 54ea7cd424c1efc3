"""A prefix trie of conversations from vertical bitmaps.

Conversations are sequences of turns. A shard is a range of conversation ids; for each
depth it keeps, per turn, the bitset of the shard's conversations that have this turn
there. A depth-first walk intersects the bitset of a node with the postings one turn
further: each intersection is a child, its popcount the number of members, and what no
posting covers ends here. Taking the posting of the first member not yet covered, a node
costs as many intersections as it has children.

Shards only ever see hashes and lengths of turns. Nodes of different shards are one node
if the hash of their whole sequence is the same (128 bits); counts, smallest members and
end lists are added up per node, so a first turn that most conversations share is one row
a shard. A second walk over the same shards adds up what subtrees need: each node belongs
to its smallest member, so the nodes of a member are the rest of its path from some depth
on, and a subtree's distinct turns are sums over its members - one number per member and
node, instead of a sum over all pairs of node and ancestor.
"""
from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from pitscreen.llm.common import as_long, stored
from pitscreen.llm.skew import salted_join

SHARD = 2048          # conversations
SHARD_TURNS = 1 << 18
HEADS = 6
FAMILY = 100
MASK = (1 << 64) - 1


def turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, pos, t1, t2, chars): the turns of each conversation from 0 on, as two hashes and a length.

    Rows are ordered by turn, null first, ties by the digests of role and text; null role and text are empty. Rows without
    conv_id take no part; repeated rows are turns of their own.
    """
    text, role = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("text", "role"))
    rows = conversations.select(as_long("conv_id").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.xxhash64(role, text).alias("t1"),
                                F.xxhash64(F.lit(1), text, role).alias("t2"), F.length(text).cast("long").alias("chars"), F.substring(F.md5(role.cast("binary")), 1, 16).alias("m1"), F.substring(F.md5(text.cast("binary")), 1, 16).alias("m2"))
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "m1", "m2")
    return rows.filter("conv_id is not null").select("conv_id", (F.row_number().over(order) - 1).cast("long").alias("pos"), "t1", "t2", "chars")


def rebuilt(ordered: DataFrame, family: int = FAMILY, heads: int = HEADS) -> DataFrame:
    """Turns where each conversation c begins with the first h turns of conversation c - c % family (all if it has
    fewer, none if it is absent) in place of its own first h, h = crc32(decimal c) % heads. Depths count from 1;
    depth 0 is a row without a turn for every conversation, so that one without turns is there too.
    """
    every = ordered.groupBy("conv_id").agg(F.count("*").alias("n"))
    every = every.withColumn("head", F.pmod(F.crc32(F.col("conv_id").cast("string").cast("binary")), F.lit(heads))).withColumn("base", F.col("conv_id") - F.col("conv_id") % family)
    first = ordered.filter((F.col("conv_id") % family == 0) & (F.col("pos") < heads - 1)).select(F.col("conv_id").alias("base"), "pos", "t1", "t2", "chars")
    held = first.groupBy("base").agg(F.count("*").alias("held"))
    every = every.join(held, "base", "left").withColumn("kept", F.least("head", F.coalesce("held", F.lit(0))))
    lead = every.select("conv_id", "base", "kept").join(first, "base").filter("pos < kept").select("conv_id", (F.col("pos") + 1).alias("depth"), "t1", "t2", "chars")
    own = (ordered.join(every.select("conv_id", "head", "kept"), "conv_id").filter("pos >= head")
           .select("conv_id", (F.col("kept") + F.col("pos") - F.col("head") + 1).alias("depth"), "t1", "t2", "chars"))
    zero = F.lit(0).cast("long")
    return every.select("conv_id", zero.alias("depth"), zero.alias("t1"), zero.alias("t2"), zero.alias("chars")).unionByName(lead).unionByName(own)


def _mix(x: int) -> int:
    x = (x ^ x >> 32) * 0xD6E8FEB86659FD93 & MASK
    x = (x ^ x >> 29) * 0xA0761D6478BD642F & MASK
    return x ^ x >> 32


def walk(first: np.ndarray, turn: list[tuple[int, int]]) -> Iterator[tuple[int, int, int, int, int, list[int], list[int]]]:
    """Nodes of a shard, parents first: key, parent's key (two 64-bit numbers each), depth, members and members that end.

    Conversation i has the turns turn[first[i]:first[i + 1]], the first of which is the root's. Members are given as
    places in the shard, ascending.
    """
    n = len(first) - 1
    first = first.tolist()
    length = [first[i + 1] - first[i] for i in range(n)]
    postings: list[dict] = [{} for _ in range(max(length, default=0))]
    for i in range(n):
        bit = 1 << i
        for depth, t in enumerate(turn[first[i]:first[i + 1]]):
            at = postings[depth]
            at[t] = at.get(t, 0) | bit
    stack = [(bits, t, 0, 0, 0) for t, bits in (postings[0] if postings else {}).items()]
    while stack:
        bits, t, k1, k2, depth = stack.pop()
        own1, own2 = _mix(k1 + t[0] & MASK), _mix(k2 * 3 + t[1] + 1 & MASK)
        members, ends = [], []
        rest = bits
        while rest:
            low = rest & -rest
            i = low.bit_length() - 1
            members.append(i)
            if length[i] == depth + 1:
                ends.append(i)
                bits ^= low
            rest ^= low
        yield own1, own2, k1, k2, depth, members, ends
        while bits:
            i = (bits & -bits).bit_length() - 1
            follow = turn[first[i] + depth + 1]
            child = bits & postings[depth + 1][follow]
            stack.append((child, follow, own1, own2, depth + 1))
            bits ^= child


def _shards(take: Callable[[dict, np.ndarray], pa.RecordBatch], most: int):
    """A mapInArrow function over rows sorted by (conv_id, depth) that hands whole shards to `take`."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting, rows, convs, last = [], 0, 0, None

        def pour() -> pa.RecordBatch:
            table = {name: np.concatenate([w[name] for w in waiting]) for name in waiting[0]}
            first = np.flatnonzero(np.diff(table["conv_id"], prepend=~table["conv_id"][:1]) != 0)
            return take(table, np.append(first, len(table["conv_id"])))

        for batch in batches:
            columns = {name: batch.column(name).to_numpy(zero_copy_only=False) for name in batch.schema.names}
            ids = columns["conv_id"]
            starts = np.flatnonzero(np.diff(ids, prepend=ids[:1] if len(ids) and ids[0] == last else ~ids[:1]) != 0).tolist()
            at = 0
            for start in starts:
                if convs >= most or rows + start - at >= SHARD_TURNS:
                    if start > at:
                        waiting.append({k: v[at:start] for k, v in columns.items()})
                    if waiting:
                        yield pour()
                    waiting, rows, convs, at = [], 0, 0, start
                convs += 1
            waiting.append({k: v[at:] for k, v in columns.items()})
            rows += len(ids) - at
            last = ids[-1] if len(ids) else last
        if waiting:
            yield pour()
    return run


def _signed(values: list[int]) -> pa.Array:
    return pa.array(np.array(values, np.uint64).view(np.int64))


def _turn_list(table: dict) -> list[tuple[int, int]]:
    return list(zip((table["t1"].view(np.uint64)).tolist(), (table["t2"].view(np.uint64)).tolist()))


def _local_nodes(table: dict, first: np.ndarray) -> pa.RecordBatch:
    ids, chars = table["conv_id"], table["chars"]
    out: dict[str, list] = {c: [] for c in ("k1", "k2", "p1", "p2", "depth", "n", "conv_id", "chars", "end", "ends")}
    conv = ids[first[:-1]].tolist()
    for k1, k2, p1, p2, depth, members, ends in walk(first, _turn_list(table)):
        for name, value in zip(out, (k1, k2, p1, p2, depth, len(members), conv[members[0]], int(chars[first[members[0]] + depth]),
                                     conv[ends[0]] if ends else None, ",".join(str(conv[i]) for i in ends) if ends else None)):
            out[name].append(value)
    return pa.RecordBatch.from_arrays([*[_signed(out[c]) for c in ("k1", "k2", "p1", "p2")], *[pa.array(out[c], pa.int64()) for c in ("depth", "n", "conv_id", "chars", "end")], pa.array(out["ends"], pa.string())], names=list(out))


def _member_sums(table: dict, first: np.ndarray) -> pa.RecordBatch:
    """For each node, the sum over its members of the characters from its depth on that the member does not own, and of owned leaves."""
    chars, own, leaf = table["chars"], table["own"], table["leaf"]
    left = np.zeros(len(chars) + 1, np.int64)
    left[:-1] = chars[::-1].cumsum()[::-1]
    left[:-1] -= np.repeat(left[first[1:]], np.diff(first))     # characters from a turn to its conversation's end
    left[-1] = 0
    size = np.diff(first)
    begin = first[:-1]
    own_at = np.minimum(own[begin], size)                        # a member that owns nothing has its own part at its end
    kept = np.where(own_at < size, left[np.minimum(begin + own_at, len(chars) - 1)], 0)
    leaves = np.where(own_at < size, leaf[begin], 0)
    out: dict[str, list] = {c: [] for c in ("k1", "k2", "saved", "leaves")}
    for k1, k2, _, _, depth, members, _ in walk(first, _turn_list(table)):
        m = np.array(members)
        ahead = own_at[m] > depth
        saved = int((left[begin[m] + depth] - kept[m])[ahead].sum())
        for name, value in zip(out, (k1, k2, saved, int(leaves[m].sum()))):
            out[name].append(value)
    return pa.RecordBatch.from_arrays([_signed(out["k1"]), _signed(out["k2"]), pa.array(out["saved"], pa.int64()), pa.array(out["leaves"], pa.int64())], names=list(out))


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of the joined end lists of each node, over rows sorted by node and first id: one list is held at a time."""
    import hashlib
    key, digest = None, None
    for batch in batches:
        found = []
        for k1, k2, ends in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
            if (k1, k2) != key:
                if key is not None:
                    found.append((*key, digest.hexdigest()))
                key, digest = (k1, k2), hashlib.sha256()
            else:
                digest.update(b",")
            digest.update(ends.as_py().encode())
        if found:
            yield _digest_rows(found)
    if key is not None:
        yield _digest_rows([(*key, digest.hexdigest())])


def _digest_rows(found: list[tuple]) -> pa.RecordBatch:
    k1, k2, sha = zip(*found)
    return pa.RecordBatch.from_arrays([pa.array(k1, pa.int64()), pa.array(k2, pa.int64()), pa.array(sha, pa.string())], names=["k1", "k2", "ends_sha256"])


def trie(sequences: DataFrame, shard: int = SHARD) -> DataFrame:
    """Nodes of the trie over (conv_id, depth, t1, t2, chars), as `rebuilt` gives them.

    Columns: conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens (over the subtree:
    members but one, times the characters of the node's turn), ends_sha256. An empty table has no node, not even a root.
    Each (conv_id, depth) is there once and depths are without gaps. A conversation is held by one task, as 40 bytes a turn.
    The end list of a node is streamed through one task for its digest, 2,048 ids a row, since that has to be one hash. `shard`
    bounds the conversations of a shard.
    """
    keys = ["k1", "k2"]
    sequences = stored(sequences, "sequences")
    # ranges of whole conversations: end lists of two shards do not interleave
    placed = sequences.repartitionByRange("conv_id").sortWithinPartitions("conv_id", "depth")
    local = stored(placed.mapInArrow(_shards(_local_nodes, shard), "k1 long, k2 long, p1 long, p2 long, depth long, n long, conv_id long, chars long, end long, ends string"), "local-nodes")
    nodes = stored(local.groupBy(*keys).agg(F.first("p1").alias("p1"), F.first("p2").alias("p2"), F.first("depth").alias("depth"), F.sum("n").alias("n_convs"),
                                            F.min("conv_id").alias("conv_id"), F.count("ends").alias("parts"), F.min("ends").alias("one")), "nodes")
    below = nodes.filter("depth > 0").groupBy(F.col("p1").alias("k1"), F.col("p2").alias("k2")).agg(F.count("*").alias("n_children"))
    full = stored(nodes.join(below, keys, "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)).cast("long")), "full")

    owners = full.groupBy("conv_id").agg(F.min("depth").alias("own"), F.max_by("n_children", "depth").alias("under"))
    owners = owners.select("conv_id", "own", (F.col("under") == 0).cast("long").alias("leaf"))
    marked = (sequences.join(owners, "conv_id", "left").withColumn("own", F.coalesce("own", F.lit(1 << 62))).withColumn("leaf", F.coalesce("leaf", F.lit(0)).cast("long")))
    marked = stored(marked, "marked").repartitionByRange("conv_id").sortWithinPartitions("conv_id", "depth")
    sums = marked.mapInArrow(_shards(_member_sums, shard), "k1 long, k2 long, saved long, leaves long").groupBy(*keys).agg(F.sum("saved").alias("saved_tokens"), F.sum("leaves").alias("n_leaves"))

    several = local.filter("ends is not null").join(nodes.filter("parts > 1").select(*keys), keys, "left_semi").select(*keys, "ends", "end")
    many = (several.repartition(*keys).sortWithinPartitions(*keys, "end").select(*keys, "ends")
            .mapInArrow(_digests, "k1 long, k2 long, ends_sha256 string"))
    named = salted_join(full.filter("depth > 0").select(F.col("p1"), F.col("p2"), "k1", "k2"), full.select(F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("conv_id").alias("parent_conv_id")), ["p1", "p2"])
    out = (full.drop("p1", "p2").join(named.select(*keys, "parent_conv_id"), keys, "left").join(sums, keys).join(many, keys, "left"))
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
                      F.coalesce("ends_sha256", F.sha2(F.coalesce("one", F.lit("")), 256)).alias("ends_sha256"))
