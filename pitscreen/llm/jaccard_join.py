"""N-gram Jaccard join by grouped prefixes.

A document is the set of its distinct word shingles; two link when
denominator * |A & B| >= numerator * |A | B|. With a global order of all shingles,
linked sets share a shingle among the first n - ceil(t * n) + 1 of each (their
prefixes). The join collapses documents with one prefix and one size into a group,
finds pairs of groups over the prefix shingles, expands them and verifies members:

1. a sketch counts all shingles; rare shingles come first, so that frequent
   passages stay out of the prefixes. The sketch only orders: its errors cost
   time, never a link;
2. each document becomes (size, set checksum, prefix); equal sets become a class,
   equal prefixes and sizes a group;
3. groups that share a prefix shingle gather, by the smallest such group, in
   blocks of at most `BLOCK` classes of about one size. Only pairs of blocks are
   emitted, never pairs of documents: a group of m near copies costs (m / BLOCK)**2
   rows, and is dealt out over that many tasks;
4. a task verifies a pair of blocks exactly and returns a spanning forest of its
   links with the number of links of each class; components follow from those.
"""
from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from pitscreen.llm import textnum
from pitscreen.llm.common import as_long, buffers, chunks, stored, utf8
from pitscreen.llm.graph import components
from pitscreen.llm.skew import salted_join

SKETCH_BITS = 24
PART_BITS = 16
BLOCK = 64
BLOCK_SHINGLES = 1 << 17
BITMAP = 512
SMALL = 64


def _sets(column: pa.Array, size: int) -> Iterator[tuple[int, list[np.ndarray]]]:
    data, offsets = buffers(column)
    for a, b in chunks(offsets):
        at = offsets[a:b + 1]
        yield a, textnum.shingles(textnum.words(data[at[0]:at[-1]], at - at[0], lower=True), b - a, size)


def _count_parts(size: int, bits: int):
    """Counts of all shingles by the top bits of their hashes (65,535 stands for more), as compressed parts of one array."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << bits, np.uint16)
        waiting, held = [], 0

        def pour():
            nonlocal waiting, held
            if held:   # texts without words have no shingle to count
                bins = np.sort((np.concatenate(waiting) >> np.uint64(64 - bits)).astype(np.uint32))
                first = np.flatnonzero(np.concatenate([[True], bins[1:] != bins[:-1]]))
                bins, more = bins[first], np.diff(first, append=len(bins))
                counts[bins] = np.minimum(65535, counts[bins] + more)
            waiting, held = [], 0

        for batch in batches:
            for _, sets in _sets(batch.column(0), size):
                waiting += sets
                held += sum(map(len, sets))
                if held > 1 << 20:
                    pour()
        pour()
        width = 1 << min(bits, PART_BITS)
        parts = [i for i in range(len(counts) // width) if counts[i * width:(i + 1) * width].any()]
        for i in parts:
            yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([zlib.compress(counts[i * width:(i + 1) * width].tobytes(), 1)], pa.binary())], names=["part", "counts"])
    return run


def _add_parts(part: pa.Table) -> pa.Table:
    total = sum(np.frombuffer(zlib.decompress(x.as_py()), np.uint16).astype(np.uint32) for x in part.column("counts"))
    level = np.minimum(255, np.round(8 * np.log2(total + 1.0))).astype(np.uint8)
    return pa.table({"part": part.column("part").slice(0, 1), "levels": pa.array([level.tobytes()], pa.binary())})


def shingle_levels(docs: DataFrame, size: int, bits: int = SKETCH_BITS) -> np.ndarray:
    """About log2 of how many documents hold a shingle, by hash bin: 2**bits bytes whatever the corpus."""
    parts = docs.select(utf8().alias("text")).mapInArrow(_count_parts(size, bits), "part int, counts binary")
    rows = parts.groupBy("part").applyInArrow(_add_parts, "part int, levels binary").collect()
    levels = np.zeros(1 << bits, np.uint8)
    for row in rows:
        piece = np.frombuffer(row["levels"], np.uint8)
        levels[row["part"] * len(piece):(row["part"] + 1) * len(piece)] = piece
    return levels


def _describe(size: int, numerator: int, denominator: int, levels, bits: int):
    schema = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("s1", pa.int64()), ("s2", pa.int64()), ("ph", pa.int64()), ("bits", pa.list_(pa.int64())), ("prefix", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order = levels.value
        for batch in batches:
            ids = batch.column(0)
            for a, sets in _sets(batch.column(1), size):
                n, s1, s2, ph, bits_of, prefix = [], [], [], [], [], []
                for s in sets:
                    k = len(s)
                    n.append(k)
                    if not k:
                        s1.append(0), s2.append(0), ph.append(0), bits_of.append(None), prefix.append(None)
                        continue
                    p = k - (numerator * k + denominator - 1) // denominator + 1
                    key = (order[s >> np.uint64(64 - bits)].astype(np.uint64) << np.uint64(55)) | (s >> np.uint64(9))
                    key = np.sort(np.partition(key, p - 1)[:p]) if p < k else np.sort(key)
                    s1.append(int(s.sum().astype(np.int64)))
                    s2.append(int(np.bitwise_xor.reduce(textnum.mix(s + np.uint64(0x51ED27))).astype(np.int64)))
                    ph.append(int((np.bitwise_xor.reduce(textnum.mix(key)) ^ key.sum()).astype(np.int64)))
                    bits_of.append(np.packbits(np.bincount((s & np.uint64(BITMAP - 1)).astype(np.int64), minlength=BITMAP).astype(np.uint8) & 1).view(np.int64))
                    prefix.append(key.astype(np.int64))
                yield pa.RecordBatch.from_arrays([ids.slice(a, len(sets)), pa.array(n, pa.int64()), pa.array(s1, pa.int64()), pa.array(s2, pa.int64()), pa.array(ph, pa.int64()), pa.array(bits_of, schema.field("bits").type), pa.array(prefix, schema.field("prefix").type)], schema=schema)
    return run


def _links(sets: list[np.ndarray], side: np.ndarray, counts: np.ndarray, numerator: int, denominator: int) -> tuple[np.ndarray, np.ndarray]:
    """Which sets link, between the sides 0 and 1 or within the only side, and how many documents each set links to."""
    m = len(sets)
    sizes = np.array([len(s) for s in sets], np.int64)
    both = np.concatenate(sets)
    row = np.repeat(np.arange(m), sizes)
    order = np.argsort(both, kind="stable")
    both, row = both[order], row[order]
    new = np.ones(len(both), bool)
    new[1:] = both[1:] != both[:-1]
    column = np.cumsum(new) - 1
    shared = np.bincount(column)[column] > 1
    row, column = row[shared], column[shared]
    if len(column):
        _, column = np.unique(column, return_inverse=True)
    common = np.zeros((m, m), np.float32)
    width = 8192
    for low in range(0, int(column.max()) + 1 if len(column) else 0, width):
        a, b = np.searchsorted(column, [low, low + width])
        dense = np.zeros((m, int(column[b - 1]) - low + 1), np.float32)
        dense[row[a:b], column[a:b] - low] = 1
        common += dense @ dense.T
    common = np.rint(common).astype(np.int64)
    union = sizes[:, None] + sizes[None, :] - common
    link = denominator * common >= numerator * union
    np.fill_diagonal(link, False)
    if side.any():
        link &= side[:, None] != side[None, :]
    return link, link @ counts


def _verify(size: int, numerator: int, denominator: int):
    schema = pa.schema([("rep", pa.int64()), ("root", pa.int64()), ("links", pa.int64())])

    def settle(parts: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets = [s for p in parts for _, some in _sets(p.column(4), size) for s in some]
        rows = pa.Table.from_batches(parts)
        first, ids, counts, block = (rows.column(i).to_numpy() for i in (0, 2, 3, 5))
        link, links = _links(sets, (block != first).astype(np.int64), counts.astype(np.int64), numerator, denominator)
        root = np.arange(len(sets))
        for i in range(len(sets)):
            if root[i] == i and link[i].any():
                seen = np.zeros(len(sets), bool)
                seen[i] = True
                edge = seen
                while edge.any():
                    edge = link[edge].any(axis=0) & ~seen
                    seen |= edge
                root[seen] = i
        low = {}
        for i, r in enumerate(root.tolist()):
            low[r] = min(low.get(r, ids[i]), ids[i])
        some = np.flatnonzero(links)
        if len(some):
            yield pa.RecordBatch.from_arrays([pa.array(ids[some]), pa.array([int(low[r]) for r in root[some].tolist()], pa.int64()), pa.array(links[some].astype(np.int64))], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair, parts = None, []
        for batch in batches:
            a, b = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            cuts = (np.flatnonzero((a[1:] != a[:-1]) | (b[1:] != b[:-1])) + 1).tolist()
            for low, high in zip([0, *cuts], [*cuts, len(a)]):
                if (a[low], b[low]) != pair:
                    if parts:
                        yield from settle(parts)
                    pair, parts = (a[low], b[low]), []
                parts.append(batch.slice(low, high - low))
        if parts:
            yield from settle(parts)
    return run


def _may_link(pairs: DataFrame, placed: DataFrame, numerator: int, denominator: int) -> DataFrame:
    """Pairs of blocks without those whose members cannot link, as far as that is cheap to see.

    The shingles two sets do not share number at least the bits in which their parity bitmaps differ; linked
    sets have at most (denominator - numerator) / (denominator + numerator) of their joint size. Pairs with
    more than SMALL pairs of members are kept unseen.
    """
    counted = pairs.join(placed.groupBy(F.col("block").alias("a")).agg(F.count("*").alias("na")), "a").join(placed.groupBy(F.col("block").alias("b")).agg(F.count("*").alias("nb")), "b")
    counted = stored(counted, "counted")
    left = placed.select(F.col("block").alias("a"), F.col("bits").alias("x"), F.col("n").alias("nx"), F.struct("rep", "s1").alias("ix"))
    right = placed.select(F.col("block").alias("b"), F.col("bits").alias("y"), F.col("n").alias("ny"), F.struct("rep", "s1").alias("iy"))
    apart = F.expr("aggregate(zip_with(x, y, (p, q) -> bit_count(p ^ q)), 0, (t, c) -> t + c)")
    seen = (counted.filter(F.col("na") * F.col("nb") <= SMALL).join(left, "a").join(right, "b").filter("a <> b or ix < iy")
            .filter(apart * (denominator + numerator) <= (F.col("nx") + F.col("ny")) * (denominator - numerator)).select("a", "b").distinct())
    return seen.unionByName(counted.filter(F.col("na") * F.col("nb") > SMALL).select("a", "b"))


def near_duplicates(docs: DataFrame, size: int = 5, numerator: int = 80, denominator: int = 100, bits: int = SKETCH_BITS) -> DataFrame:
    """(doc_id, n_shingles, component_id, n_links) for each row of `docs` (doc_id, text, any other columns).

    component_id is the smallest doc_id reachable over links, n_links the number of documents
    the row's text links to, copies included, itself not. A null text is empty; a text without
    words has no shingles, links with nothing and is its own component. Rows with a null doc_id
    come back with a null component. Rows that repeat a doc_id are versions of one document:
    each comes back, and whatever one of them links to is linked with all. An empty table gives
    an empty result. Letters A-Z are lower-cased, white space is ASCII white space.
    """
    spark = docs.sparkSession
    docs = docs.select(as_long("doc_id").alias("doc_id"), utf8().alias("text"))
    levels = spark.sparkContext.broadcast(shingle_levels(docs, size, bits))
    schema = "doc_id long, n long, s1 long, s2 long, ph long, bits array<long>, prefix array<long>"
    rows = stored(docs.mapInArrow(_describe(size, numerator, denominator, levels, bits), schema), "sets")
    levels.destroy()  # what follows reads `rows`
    known = rows.filter("n > 0 and doc_id is not null")

    classes = stored(known.groupBy("n", "ph", "s1", "s2").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies"), F.first("bits").alias("bits")), "classes")
    ratio = math.log(denominator / numerator)
    bucket = F.floor(F.log(F.col("n").cast("double")) / F.lit(ratio)).cast("int")
    groups = known.groupBy("n", "ph").agg(F.min("doc_id").alias("gid"), F.first("prefix").alias("prefix")).withColumn("sb", bucket)
    posting = groups.select("gid", "sb", F.explode("prefix").alias("token"))
    shared = posting.groupBy("token").agg(F.min("gid").alias("pivot"), F.count("*").alias("held")).filter("held > 1").select("token", "pivot")
    hits = stored(posting.join(shared, "token"), "hits")

    named = classes.join(classes.groupBy("n", "ph").agg(F.min("rep").alias("gid"), F.count("*").alias("members")), ["n", "ph"])
    placed = (named.join(hits.groupBy("gid").agg(F.min("pivot").alias("pivot")), "gid", "left")
              .filter("members > 1 or pivot is not null").withColumn("pivot", F.coalesce("pivot", "gid")).withColumn("sb", bucket))
    room = placed.groupBy("pivot", "sb").agg(F.ceil(F.greatest(F.count("*") / BLOCK, F.sum("n") / BLOCK_SHINGLES)).alias("salts"))
    placed = stored(placed.join(room, ["pivot", "sb"]).withColumn("salt", F.pmod(F.xxhash64("rep", "s1"), "salts"))
                    .select("rep", "gid", "sb", "copies", "n", "s1", "bits", F.xxhash64("pivot", "sb", "salt").alias("block")), "placed")

    tokens = hits.select("gid", "token").unionByName(placed.groupBy("gid").count().filter("count > 1").select("gid", F.xxhash64(F.lit("group"), "gid").alias("token")))
    spots = tokens.join(placed.select("gid", "sb", "block").distinct(), "gid").select("token", "sb", "block").distinct()
    left, right = spots.alias("l"), spots.alias("r")
    across = left.join(right, F.expr("l.token = r.token and l.block < r.block and abs(l.sb - r.sb) <= 1")).select(F.col("l.block").alias("a"), F.col("r.block").alias("b")).distinct()
    within = placed.groupBy("block").count().filter("count > 1").select(F.col("block").alias("a"), F.col("block").alias("b"))
    pairs = stored(_may_link(across.unionByName(within), placed, numerator, denominator), "pairs")

    sides = pairs.select("a", "b", F.explode(F.array_distinct(F.array("a", "b"))).alias("block"))
    needed = placed.join(sides.select("block").distinct(), "block").select(F.col("rep").alias("doc_id"), "block", "copies")
    texts = docs.hint("merge").join(needed, "doc_id")  # one plan for every size
    sent = sides.join(texts, "block").select("a", "b", "doc_id", "copies", "text", "block").repartition("a", "b").sortWithinPartitions("a", "b", "doc_id")
    links = stored(sent.mapInArrow(_verify(size, numerator, denominator), "rep long, root long, links long"), "links")

    # what a class's members share is put together per class; only then do the rows, of which one class may have most, meet it
    known_of = classes.select("n", "ph", "s1", "s2", "rep", "copies").join(links.groupBy("rep").agg(F.sum("links").alias("links")), "rep", "left")
    out = stored(salted_join(rows.select("n", "ph", "s1", "s2", "doc_id"), known_of, ["n", "ph", "s1", "s2"], "left").select("doc_id", "n", "rep", "copies", "links"), "members")
    versions = out.filter("doc_id <> rep").select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
    edges = links.select(F.col("rep").alias("a"), F.col("root").alias("b")).unionByName(versions)
    found = components(edges).withColumnRenamed("node", "doc_id")
    return (out.join(found, "doc_id", "left")
            .select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id"),
                    F.when(F.col("doc_id").isNotNull(), F.coalesce("links", F.lit(0)) + F.coalesce("copies", F.lit(1)) - 1).alias("n_links")))


def one_per_component(docs: DataFrame, size: int = 5, numerator: int = 80, denominator: int = 100) -> DataFrame:
    """One row of `docs` for each component of near copies, all columns kept: that with the smallest doc_id, then digest.

    Rows are judged by (doc_id, text): of two rows with one doc_id only the one that is a copy goes, and rows that repeat
    both are one. Rows with a null doc_id stay; texts without words are copies of nothing; very long texts are compared
    whole; an empty table gives an empty result.
    """
    key = F.xxhash64(as_long("doc_id"), utf8())
    rows = stored(docs.filter("doc_id is not null").select(key.alias("__key"), as_long("doc_id").alias("__id")), "keys")
    found = near_duplicates(docs.filter("doc_id is not null").select(key.alias("doc_id"), "text"), size, numerator, denominator)
    found = stored(found.select(F.col("doc_id").alias("__key"), F.col("component_id").alias("__component")).distinct(), "found")
    named = rows.groupBy("__key").agg(F.min("__id").alias("__id"), F.count("*").alias("__times"))
    first = named.join(found, "__key").groupBy("__component").agg(F.min(F.struct("__id", "__key")).alias("__first"))
    kept = stored(first.select("__first.__key").join(named.select("__key", "__times"), "__key"), "kept")
    keyed = docs.withColumn("__key", F.when(F.col("doc_id").isNotNull(), key)).hint("merge")   # one plan for every size
    once = keyed.join(kept.filter("__times = 1").select("__key"), "__key", "left_semi").unionByName(docs.filter("doc_id is null").withColumn("__key", F.lit(None).cast("long")))
    again = keyed.join(kept.filter("__times > 1").select("__key"), "__key", "left_semi").dropDuplicates(["__key"])
    return once.unionByName(again).select(docs.columns)
