"""Benchmark decontamination by winnowing.

A text is its sequence of words. Of every `window - gram + 1` consecutive hashes of `gram` words
the smallest is kept: every window of `window` words has one kept hash, its fingerprint, and
equal windows have equal ones. So a span of at least `window` words that a document shares
with an item is found, however it is placed.

1. the fingerprints of all items set bits of a Bloom filter of fixed size; a task that reads
   documents keeps only fingerprints that pass it. The filter only prunes: what it lets
   through by mistake finds no partner;
2. a kept fingerprint is extended to the windows it stands for, and fingerprint and window
   hash together are joined with those of the items. Joining on the fingerprint alone would
   pair a common phrase with every item that has it;
3. the joined windows of a document are united into its hit words. Documents with the same
   set of windows share a class, and only classes meet the items of their windows, so a
   passage in many items and many documents is not paired out.

An item of fewer words than a window is one window of its own length; it is looked up by the
hash of all document windows of that length, since winnowing promises nothing below `window`.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from pitscreen.llm import textnum
from pitscreen.llm.common import as_long, buffers, chunks, stored, utf8
from pitscreen.llm.skew import salted_join

WINDOW = 10
GRAM = 6
BLOOM_BITS = 24
PART_BITS = 16
FACTOR = np.uint64(0xC2B2AE3D27D4EB4F)

#: Words are runs of digits, ASCII letters and bytes beyond ASCII; A-Z are lower-cased, all else is a gap.
FOLD = np.full(256, 32, np.uint8)
for _low, _high in ((48, 58), (97, 123), (128, 256)):
    FOLD[_low:_high] = np.arange(_low, _high)
FOLD[65:91] = np.arange(97, 123)


def found_words(data: np.ndarray, offsets: np.ndarray) -> textnum.Words:
    return textnum.words(FOLD[data], offsets)


def grams(h: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all runs of `size` consecutive word hashes; runs of other lengths get other hashes."""
    count = max(0, len(h) - size + 1)
    out = np.full(count, size, np.uint64)
    for j in range(size):
        out = (out + h[j:j + count]) * FACTOR
    return textnum.mix(out)


def key_of(h: np.ndarray, start: np.ndarray, size: int) -> np.ndarray:
    """Hashes of the runs of `size` words that begin at the words `start`."""
    out = np.full(len(start), size, np.uint64)
    for j in range(size):
        out = (out + h[start + j]) * FACTOR
    return textnum.mix(out)


def inside(found: textnum.Words, size: int) -> np.ndarray:
    """First words of all runs of `size` words that lie in one text."""
    return np.flatnonzero(found.doc[:max(0, len(found.doc) - size + 1)] == found.doc[size - 1:])


def fingerprints(found: textnum.Words, start: np.ndarray, size: int, window: int, gram: int) -> np.ndarray:
    """The fingerprint of each window that begins at `start`; a run shorter than `window` is its own."""
    if size < window:
        return textnum.mix(key_of(found.hash, start, size))
    short = grams(found.hash, gram)
    best = short[start]
    for j in range(1, window - gram + 1):
        np.minimum(best, short[start + j], out=best)
    return textnum.mix(best)


def _item_windows(window: int, gram: int):
    schema = pa.schema([("item_id", pa.string()), ("size", pa.int32()), ("key", pa.int64()), ("print", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = buffers(batch.column(1))
            for a, b in chunks(offsets):
                at = offsets[a:b + 1]
                found = found_words(data[at[0]:at[-1]], at - at[0])
                sizes = np.minimum(window, np.bincount(found.doc, minlength=b - a))
                for size in sorted(set(sizes[sizes > 0].tolist())):
                    start = inside(found, size)
                    start = start[sizes[found.doc[start]] == size]
                    mark = fingerprints(found, start, size, window, gram)
                    item = batch.column(0).take(pa.array(a + found.doc[start]))
                    yield pa.RecordBatch.from_arrays([item, pa.array(np.full(len(start), size), pa.int32()), pa.array(key_of(found.hash, start, size).view(np.int64)), pa.array(mark.view(np.int64))], schema=schema)
    return run, "item_id string, size int, key long, print long"


def spots(prints: np.ndarray, bits: int) -> list[np.ndarray]:
    """The two flags of each fingerprint: its first and its second `bits` bits."""
    return [(prints >> np.uint64(64 - bits * i) & np.uint64((1 << bits) - 1)).astype(np.int64) for i in (1, 2)]


def bloom(of: DataFrame, bits: int = BLOOM_BITS) -> np.ndarray:
    """2**bits flags as 64-bit words, 2 MB at 24 bits whatever the benchmark. A full filter costs time, no match."""
    both = of.select(F.explode(F.array(*[F.shiftrightunsigned("print", 64 - bits * i).bitwiseAND(F.lit((1 << bits) - 1)) for i in (1, 2)])).alias("spot"))
    words = (both.groupBy(F.shiftright("spot", 6).cast("int").alias("word"))
             .agg(F.bit_or(F.expr("shiftleft(1L, cast(spot & 63 as int))")).alias("flags")).toArrow())
    out = np.zeros(1 << (bits - 6), np.int64)
    out[words.column("word").to_numpy()] = words.column("flags").to_numpy()
    return out.view(np.uint64)


HIT = pa.struct([("key", pa.int64()), ("print", pa.int64()), ("start", pa.int32()), ("size", pa.int32())])


def _candidates(window: int, gram: int, sizes: list[int], filter_bits, bits: int):
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("maybe", pa.list_(HIT))])

    def passing(marks: np.ndarray, flags: np.ndarray) -> np.ndarray:
        kept = np.flatnonzero(np.diff(marks, prepend=~marks[:1]) != 0)   # neighbouring windows mostly share theirs
        keep = np.ones(len(kept), bool)
        for spot in spots(marks[kept], bits):
            keep &= (flags[spot >> 6] >> (spot & 63).astype(np.uint64) & np.uint64(1)).astype(bool)
        return np.repeat(keep, np.diff(kept, append=len(marks)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flags = filter_bits.value
        for batch in batches:
            data, offsets = buffers(batch.column(1))
            for a, b in chunks(offsets):
                at = offsets[a:b + 1]
                found = found_words(data[at[0]:at[-1]], at - at[0])
                parts = []
                for size in sizes:
                    start = inside(found, size)
                    mark = fingerprints(found, start, size, window, gram)
                    some = passing(mark, flags)
                    start, mark = start[some], mark[some]
                    parts.append((start, key_of(found.hash, start, size), mark, np.full(len(start), size)))
                start, key, mark, size = (np.concatenate(x) for x in zip(*parts)) if parts else [np.zeros(0, np.int64)] * 4
                order = np.argsort(start, kind="stable")
                start, key, mark, size = start[order], key[order].view(np.int64), mark[order].view(np.int64), size[order]
                counts = np.bincount(found.doc, minlength=b - a)
                doc = found.doc[start] if len(start) else np.zeros(0, np.int64)
                first = (np.cumsum(counts) - counts)[doc] if len(start) else start
                ends = np.searchsorted(doc, np.arange(b - a + 1)).astype(np.int32)
                hits = pa.StructArray.from_arrays([pa.array(key, pa.int64()), pa.array(mark, pa.int64()), pa.array(start - first, pa.int32()), pa.array(size, pa.int32())], fields=list(HIT))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(counts, pa.int64()), pa.ListArray.from_arrays(pa.array(ends), hits)], schema=schema)
    return run


def matches(docs: DataFrame, items: DataFrame, window: int = WINDOW, gram: int = GRAM, bits: int = BLOOM_BITS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Three stored tables: rows (row, doc_id, n_words) of all documents, spans (row, start, size, key), one for each
    occurrence of an item's window in a document (counted in words from 0), and of (key, item_id), the items of each window.

    A null or empty text has no words; an item without words has no window. Rows that repeat a doc_id stand for themselves,
    as `row` tells; items that repeat an item_id are one item with the windows of all its texts. An item with a null id marks
    words but is not named. Long texts are read whole. An empty table of documents gives three empty tables, one of items
    no spans. Other columns are ignored.
    """
    spark = docs.sparkSession
    make, schema = _item_windows(window, gram)
    of = stored(items.select(F.col("item_id").cast("string").alias("item_id"), utf8().alias("text")).mapInArrow(make, schema).distinct(), "item-windows")
    sizes = sorted(r["size"] for r in of.select("size").distinct().collect())   # at most `window` of them
    shared = spark.sparkContext.broadcast(bloom(of, bits))
    read = docs.select(as_long("doc_id").alias("doc_id"), utf8().alias("text")).mapInArrow(
        _candidates(window, gram, sizes, shared, bits), "doc_id long, n_words long, maybe array<struct<key: long, print: long, start: int, size: int>>")
    rows = stored(read.withColumn("row", F.monotonically_increasing_id()), "fingerprints")
    shared.destroy()   # what follows reads `rows`
    maybe = stored(rows.select("row", F.inline("maybe")), "maybe")
    spans = salted_join(maybe, of.select("key", "print").distinct(), ["key", "print"]).select("row", "start", "size", "key")
    return rows.select("row", "doc_id", "n_words"), stored(spans, "spans"), of.select("key", "item_id")


def contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW, gram: int = GRAM, bits: int = BLOOM_BITS) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated) for each row of `docs`.

    n_hit counts the words inside any occurrence of an item's window, n_items the named items with such windows;
    items_sha256 is of their ids, sorted as strings and joined by commas. The cases of `matches` hold; an empty
    table gives an empty result. A document's spans, and the item ids of one set of windows, meet in one group.
    """
    rows, spans, of = matches(docs, items, window, gram, bits)
    before = Window.partitionBy("row").orderBy("start", "size", "key").rowsBetween(Window.unboundedPreceding, -1)
    reached = F.coalesce(F.max(F.col("start") + F.col("size")).over(before), F.lit(0))
    new = F.greatest(F.lit(0), F.col("start") + F.col("size") - F.greatest(F.col("start"), reached))
    hit = (spans.withColumn("new", new).groupBy("row")
           .agg(F.sum("new").alias("n_hit"), F.sort_array(F.collect_set("key")).alias("keys"))
           .withColumn("class", F.sha2(F.array_join(F.col("keys").cast("array<string>"), ","), 256)))
    hit = stored(hit, "hit")
    classes = hit.groupBy("class").agg(F.first("keys").alias("keys")).select("class", F.explode("keys").alias("key"))
    named = (stored(classes, "classes").join(of.dropna(), "key").select("class", "item_id").distinct()
             .groupBy("class").agg(F.count("*").alias("n_items"), F.sha2(F.array_join(F.sort_array(F.collect_list("item_id")), ","), 256).alias("items_sha256")))
    some = salted_join(hit.select("class", "row", "n_hit"), named, ["class"], "left").drop("class")
    return rows.join(some, "row", "left").select(
        "doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"),
        F.coalesce("items_sha256", F.sha2(F.lit(""), 256)).alias("items_sha256"), F.coalesce(F.col("n_hit") > 0, F.lit(False)).alias("contaminated"))


def without_leaks(docs: DataFrame, items: DataFrame, most: float = 0.0, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """The rows of `docs` of whose words at most the share `most` is hit, all columns kept.

    Rows are told apart by doc_id (null is one) and text digest, so of two rows with one id only the hit one goes.
    """
    key = F.xxhash64(as_long("doc_id"), F.sha2(utf8(), 256))
    found = contamination(docs.select(key.alias("doc_id"), "text"), items, window, gram)
    gone = found.filter(F.col("n_hit") > F.col("n_words") * F.lit(float(most))).select(F.col("doc_id").alias("__gone")).distinct()
    return docs.join(gone, key == F.col("__gone"), "left_anti")
