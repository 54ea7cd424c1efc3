"""Temporal joins without pairing every row with every row.

The as-of joins tag both sides, union them and carry the latest right-hand
value forward inside one window per key: linear in the input, one exchange.
Right-hand sides must be unique per (key, time); callers reduce them first,
with partial aggregation, so a hot key is bounded by its distinct dates.
"""
from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F


def asof_backward(left: DataFrame, right: DataFrame, on: Sequence[str], left_time: str, right_time: str,
                  values: Sequence[str], strict: bool = False, per_column: bool = False) -> DataFrame:
    """Each left row with the last right row at or before its time (before, if
    `strict`). With `per_column`, each value is the last non-null one."""
    return _asof(left, right, on, left_time, right_time, values, strict, per_column, forward=False)


def asof_forward(left: DataFrame, right: DataFrame, on: Sequence[str], left_time: str, right_time: str,
                 values: Sequence[str], strict: bool = False) -> DataFrame:
    """Each left row with the first right row at or after its time."""
    return _asof(left, right, on, left_time, right_time, values, strict, False, forward=True)


def _asof(left, right, on, left_time, right_time, values, strict, per_column, forward):
    left_tag, right_tag = (0, 1) if strict else (1, 0)
    carried = F.struct(*[F.col(v) for v in values])
    probe = left.select(*on, F.col(left_time).alias("_t"), F.lit(left_tag).alias("_tag"),
                        F.struct(*[F.col(c) for c in left.columns]).alias("_row"))
    build = right.select(*on, F.col(right_time).alias("_t"), F.lit(right_tag).alias("_tag"),
                         carried.alias("_val"))
    both = probe.unionByName(build, allowMissingColumns=True)
    order = [F.col("_t").desc() if forward else F.col("_t").asc(), F.col("_tag").asc()]
    w = Window.partitionBy(*on).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    if per_column:
        picked = {v: F.last(F.col("_val")[v], ignorenulls=True).over(w) for v in values}
        out = both.withColumns(picked).where(F.col("_tag") == left_tag)
        return out.select("_row.*", *values)
    out = both.withColumn("_hit", F.last("_val", ignorenulls=True).over(w)).where(F.col("_tag") == left_tag)
    return out.select("_row.*", *[F.col("_hit")[v].alias(v) for v in values])


def asof_probes(left: DataFrame, right: DataFrame, on: Sequence[str], right_time: str, values: Sequence[str],
                probes: Mapping[str, tuple[Column, str]]) -> DataFrame:
    """Several as-of lookups of each left row in one pass over the right side.

    `probes` maps a name to (time, side); side is "before" (last right row before the time), "upto" (last one at or
    before it) or "from" (first one at or after it). Each name becomes a struct of `values`, null without a match. All
    probes of all rows are united with the right rows once: one exchange and one sort, however many probes and sides.
    Left rows are told apart by their content, so equal rows come back as one.
    """
    sides = {"before": 0, "from": 0, "upto": 2}   # places among the right rows (1) of the same time
    row = F.struct(*left.columns)
    wanted = F.array(*[F.struct(F.lit(name).alias("_name"), time.alias("_t"), F.lit(sides[side]).alias("_tag")) for name, (time, side) in probes.items()])
    ahead = F.col("_name").isin([name for name, (_, side) in probes.items() if side == "from"])
    probe = left.select(*on, row.alias("_row"), F.explode(wanted).alias("_p")).select(*on, "_row", "_p.*")
    build = right.select(*on, F.col(right_time).alias("_t"), F.lit(1).alias("_tag"), F.struct(*values).alias("_val"))
    both = probe.unionByName(build, allowMissingColumns=True)
    order = Window.partitionBy(*on).orderBy("_t", "_tag")
    past = F.last("_val", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    found = both.withColumns({"_past": past, "_next": F.expr("lead(_val) IGNORE NULLS").over(order)})
    hit = F.when(ahead, F.col("_next")).otherwise(F.col("_past"))
    met = found.where(F.col("_name").isNotNull()).groupBy(*on, "_row").agg(
        *[F.first(F.when(F.col("_name") == name, hit), ignorenulls=True).alias(name) for name in probes])
    return met.select("_row.*", *probes)


def within_days(value: Column, seen: Column, at: Column, days: int) -> Column:
    """A value as of `seen` that is void once older than `days` calendar days."""
    return F.when(F.datediff(at, seen) <= days, value)


def interval_join(left: DataFrame, right: DataFrame, on: Sequence[str], left_time: str, right_time: str,
                  days: int) -> DataFrame:
    """Right rows of the same key in [left_time - days, left_time], one output
    row per match. Time is cut in blocks as long as the interval, so a probe
    meets two blocks of its key rather than the whole key."""
    epoch = F.lit("1970-01-01").cast("date")
    block = lambda t: F.floor(F.datediff(t, epoch) / (days + 1))
    probe = left.withColumn("_block", F.explode(F.array_distinct(F.array(
        block(F.date_sub(F.col(left_time), days)), block(F.col(left_time))))))
    build = right.withColumn("_block", block(F.col(right_time)))
    joined = probe.join(build, [*on, "_block"]).drop("_block")
    return joined.where(F.col(right_time).between(F.date_sub(F.col(left_time), days), F.col(left_time)))
