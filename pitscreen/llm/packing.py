"""Packing token pieces into fixed windows by minimum bin slack.

Documents are tokenized once; what exceeds a window is cut off as full windows and
the rest of a document, shorter than a window, is one piece. Only the counts of
pieces by length (one per possible length) reach the planner. It fills one window
after another: the longest open length first, then a subset-sum table, one bitset
per length, finds the multiset of open lengths that comes closest to the window, and
backtracking through the bitsets gives how often each length is used. A filling is
repeated as long as its lengths last, so there are a few thousand fillings whatever
the number of documents. Pieces take the places of their length by rank.

Ranks are taken within (length, part of the ids' hash) and moved by the counts of
earlier parts, so that a length that a third of all pieces share stays spread out.
"""
from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from pitscreen.llm.common import as_long, buffers, chunks, stored, utf8
from pitscreen.llm.word_bpe import WordBpe

WINDOW = 2048
END_ID = 1
PARTS = 1024
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


_TOKENIZERS: dict[str, WordBpe] = {}


def _cut(path: str, window: int, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if path not in _TOKENIZERS:
            _TOKENIZERS[path] = WordBpe(path)
        for batch in batches:
            data, offsets = buffers(batch.column(1))
            doc_ids = batch.column(0).to_pylist()
            for a, b in chunks(offsets):
                span = offsets[a:b + 1]
                ids, number = _TOKENIZERS[path].texts(data[span[0]:span[-1]], span - span[0])
                ids = np.insert(ids, np.cumsum(number), end_id).astype("<u4")
                rows: list[tuple] = []
                low = 0
                for doc_id, total in zip(doc_ids[a:b], (number + 1).tolist()):
                    for at in range(0, total, window):
                        length = min(window, total - at)
                        rows.append((doc_id, at, length, zlib.crc32(ids[low + at:low + at + length]), total))
                    low += total
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens"])
    return run


def fill(counts: dict[int, int], window: int = WINDOW) -> tuple[dict[int, int], int]:
    """The multiset of open lengths, with the longest among them, whose sum comes closest to the window."""
    longest = max(counts)
    room = window - longest
    mask = (1 << (room + 1)) - 1
    reach = [1]
    steps: list[tuple[int, int]] = []
    for length in sorted(counts, reverse=True):
        left = min(counts[length] - (length == longest), room // length)
        times = 1
        while left > 0:
            times = min(times, left)
            steps.append((length, times))
            reach.append(reach[-1] | (reach[-1] << (length * times)) & mask)
            left -= times
            times *= 2
        if reach[-1] >> room & 1:
            break
    best = reach[-1].bit_length() - 1
    used = {longest: 1}
    rest = best
    for (length, times), below in zip(reversed(steps), reversed(reach[:-1])):
        if not below >> rest & 1:
            used[length] = used.get(length, 0) + times
            rest -= length * times
    return used, longest + best


def fillings(counts: dict[int, int], window: int = WINDOW) -> list[tuple[dict[int, int], int]]:
    """How to fill windows with all pieces: (times each length is used, how many windows are filled so)."""
    counts = {k: v for k, v in counts.items() if v}
    out = []
    while counts:
        used, _ = fill(counts, window)
        windows = min(counts[length] // times for length, times in used.items())
        out.append((used, windows))
        for length, times in used.items():
            counts[length] -= times * windows
            if not counts[length]:
                del counts[length]
    return out


def places(plan: list[tuple[dict[int, int], int]]) -> list[tuple[int, int, int, int, int, int]]:
    """(length, first rank, last rank, uses in a window, offset, first sequence): a row for each filling and length."""
    taken: dict[int, int] = {}
    first, rows = 0, []
    for used, windows in plan:
        offset = 0
        for length, times in sorted(used.items(), reverse=True):
            low = taken.get(length, 0)
            rows.append((length, low, low + times * windows - 1, times, offset, first))
            taken[length] = low + times * windows
            offset += length * times
        first += windows
    return rows


def pack(docs: DataFrame, tokenizer: str, window: int = WINDOW, end_id: int = END_ID) -> DataFrame:
    """Pieces of `docs` (doc_id, text, any other columns) with their places: doc_id, start, length, ids_crc32,
    doc_tokens, sequence_id, offset.

    Every row is a document of its own, also a repeated one or one with a null id; a null or empty text
    is the end id alone; an empty table gives an empty result. Sequences number from 0 without gaps.
    """
    spark = docs.sparkSession
    pieces = stored(docs.select(as_long("doc_id").alias("doc_id"), utf8().alias("text")).mapInArrow(_cut(tokenizer, window, end_id), PIECES)
                    .withColumn("part", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(PARTS))), "pieces")
    counts = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}  # a row for each length at most
    plan = spark.createDataFrame(places(fillings(counts, window)), "length long, low long, high long, times long, at long, first long")

    parts = pieces.groupBy("length", "part").agg(F.count("*").alias("held"))
    before = F.sum("held").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    parts = parts.select("length", "part", F.coalesce(before, F.lit(0)).alias("base"))
    within = Window.partitionBy("length", "part").orderBy("doc_id", "start", "ids_crc32")
    ranked = pieces.withColumn("place", F.row_number().over(within) - 1).join(parts, ["length", "part"]).withColumn("place", F.col("place") + F.col("base"))
    own = F.expr("filter(fills, f -> place between f.low and f.high)[0]")
    by_length = plan.groupBy("length").agg(F.collect_list(F.struct("low", "high", "times", "at", "first")).alias("fills"))  # as bounded as the plan
    put = ranked.join(F.broadcast(by_length), "length").withColumn("f", own)
    nth = F.col("place") - F.col("f.low")
    return put.select("doc_id", "start", "length", "ids_crc32", "doc_tokens",
                      (F.col("f.first") + F.floor(nth / F.col("f.times"))).cast("long").alias("sequence_id"),
                      (F.col("f.at") + F.pmod(nth, F.col("f.times")) * F.col("length")).cast("long").alias("offset"))
