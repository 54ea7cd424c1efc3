"""Mixing sources to target weights with a time-varying curriculum.

Sources get target word counts by weight. Each source has a weight schedule over
training time t in [0, 1]; its integral is the source's demand up to t. A copy of a
document covers an interval of its source's word stream; the inverse of the demand
at the middle of that interval is the copy's training position, and a range sort by
position gives the training order. Everything runs as built-in columns.

The word stream of a source orders documents by the digest of their ids, so reruns
agree. Running sums are taken within (source, first digits of the digest) and moved
by the sums of earlier digits: a source with most rows is spread over 4096 groups.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from pitscreen.llm.common import WORD, as_long, stored

WEIGHTS = (5, 2, 1)
#: Per weight, how its share moves: the schedule is 1 - slope at the start, 1 + slope at the end.
SLOPES = (0.6, 0.0, -0.6)
MOST_REPEATS = 3
DIGITS = 3


def n_words(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def _cyclic(values: tuple, at: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (F.pmod(at - 1, F.lit(len(values))) + 1).cast("int"))


def source_targets(sized: DataFrame) -> DataFrame:
    """(source, source_size, target, slope): one row per source, null being the last source.

    Targets share the sum of all sizes by weight; a target above MOST_REPEATS times its source's
    size stops there and what it leaves is shared again. Sorted by cap / weight, the stopped
    sources come first, so running sums solve it in one pass over the sources.
    """
    per = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    everything = Window.partitionBy()
    ranked = per.withColumn("at", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())))
    ranked = (ranked.withColumn("weight", _cyclic(WEIGHTS, F.col("at"))).withColumn("slope", _cyclic(SLOPES, F.col("at")))
              .withColumn("cap", F.col("source_size") * MOST_REPEATS))
    by_need = Window.orderBy((F.col("cap") / F.col("weight")).asc(), F.col("at"))
    run = by_need.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    left = F.sum("source_size").over(everything) - (F.sum("cap").over(run) - F.col("cap"))
    open_weight = F.sum("weight").over(everything) - (F.sum("weight").over(run) - F.col("weight"))
    ranked = ranked.withColumn("level", left.cast("double") / open_weight.cast("double"))
    level = F.max("level").over(everything)
    target = F.least(F.col("cap").cast("double"), F.col("weight").cast("double") * level)
    return ranked.select("source", "source_size", target.alias("target"), "slope")


def position(middle: Column, target: Column, slope: Column) -> Column:
    """The time at which a source's demand, target * ((1 - slope) * t + slope * t * t), reaches `middle`."""
    share = F.least(middle / target, F.lit(1.0))   # the limit may lie half a word beyond the target
    keep = F.lit(1.0) - slope
    root = F.sqrt(keep * keep + F.lit(4.0) * slope * share)
    return F.when(slope == 0.0, share).otherwise((root - keep) / (F.lit(2.0) * slope))


def sizes(docs: DataFrame) -> DataFrame:
    return docs.select(as_long("doc_id").alias("doc_id"), F.col("source").cast("string").alias("source"), n_words(F.col("text")).alias("size"))


def schedule(sized: DataFrame) -> DataFrame:
    """(doc_id, source, size) to doc_id, source, size, source_size, target, taken, copies, position (of the
    first copy, null if none is taken), start, limit and slope, a row for each row.

    A null source is a source of its own, null doc_ids share one place in their source's stream,
    repeated rows are separate rows, an empty table gives an empty result. Copies of a source's documents
    are taken whole, in the order of its stream, epoch after epoch, up to the rounded target. The one copy that
    crosses it is taken or left, whichever is nearer, so a source's taken words miss the target by half that
    document at most. Very long texts are counted whole.
    """
    sized = sized.withColumn("digest", F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")))
    sized = stored(sized.withColumn("part", F.substring("digest", 1, DIGITS)), "sizes")
    parts = sized.groupBy("source", "part").agg(F.sum("size").alias("part_size"))
    before = F.sum("part_size").over(Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    parts = parts.withColumn("base", F.coalesce(before, F.lit(0)))
    targets = source_targets(sized).withColumnRenamed("source", "__source")
    parts = (parts.join(targets, parts["source"].eqNullSafe(targets["__source"])).drop("source").withColumnRenamed("part", "__part"))
    within = Window.partitionBy("source", "part").orderBy("digest", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = sized.withColumn("run", F.sum("size").over(within) - F.col("size"))
    rows = rows.join(parts, rows["source"].eqNullSafe(parts["__source"]) & (rows["part"] == parts["__part"]))
    rows = rows.withColumn("start", F.col("base") + F.col("run")).withColumn("limit", F.floor(F.col("target") + F.lit(0.5)))
    rows = rows.withColumn("copies", sum(is_taken(F.lit(e)).cast("long") for e in range(MOST_REPEATS)))
    rows = rows.withColumn("taken", F.col("copies") * F.col("size"))
    first = F.when(F.col("copies") > 0, copy_position(F.lit(0)))
    return rows.select("doc_id", "source", "size", "source_size", "target", "taken", "copies", first.alias("position"), "start", "limit", "slope")


def copy_start(copy: Column) -> Column:
    return F.col("start") + copy * F.col("source_size")


def is_taken(copy: Column) -> Column:
    """Whether a copy begins and, for the larger part, lies below the source's limit; of an empty document, whether it begins there."""
    begins = copy_start(copy) < F.col("limit")
    return begins & (F.lit(2) * copy_start(copy) + F.col("size") <= F.lit(2) * F.col("limit"))


def copy_position(copy: Column) -> Column:
    middle = copy_start(copy).cast("double") + F.col("size").cast("double") / F.lit(2.0)
    return position(middle, F.greatest(F.col("target"), F.lit(1.0)), F.col("slope"))


def mixture(docs: DataFrame) -> DataFrame:
    """The rows of `docs` in training order, a row as often as it is taken, all columns kept.

    Rows that share doc_id and source are scheduled as one document of their joint size. A null text has size 0.
    Every row keeps its whole text; rows with a null id or source stay rows of their own source. An empty table gives an
    empty result.
    """
    plan = schedule(sizes(docs).groupBy("doc_id", "source").agg(F.sum("size").alias("size")))
    times = (plan.filter("copies > 0").withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)))
             .select(F.col("doc_id").alias("__id"), F.col("source").alias("__source"), copy_position(F.col("copy")).alias("__position")))
    found = docs["doc_id"].cast("long").eqNullSafe(times["__id"]) & docs["source"].cast("string").eqNullSafe(times["__source"])
    return docs.join(times, found).orderBy("__position", "__id").select(docs.columns)
