"""Exact ranks and quantiles over groups of any size.

A window over a whole cross-section would put one group into one task. Here a
group is first reduced to one row per distinct value (partial aggregation, so
ties and hot values collapse before the shuffle). Values then fall into coarse
and fine bins of a logarithmic scale, which is the same for every group and any
size: a running total is the total of the coarse bins before, plus that of the
fine bins before within the coarse one, plus a window inside the fine bin. No
window holds more than a few hundred thousand rows, whatever the data: outliers
sit in coarse bins of their own, and a fine bin holds values that agree in about
seven digits. Nothing is counted or sampled beforehand, so the plan is one for
all sizes and a recomputed task gives the same bins.

Quantiles and cuts need no ranks: they are selected through a histogram, and
only the bins around the wanted places are sorted.
"""
from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

SCALE = 1e9           # below 1 / SCALE the scale is linear
COARSE = 64.0         # bins per factor e
FINE = 2.0 ** 18      # fine bins in a coarse one


def _bins(value: Column) -> tuple[Column, Column]:
    """Coarse and fine bin: floors of one rising function of the value."""
    v = value.cast("double")
    place = F.signum(v) * F.log1p(F.abs(v) * SCALE) * COARSE
    return F.floor(place), F.floor(place * FINE)


def running_totals(values: DataFrame, keys: Sequence[str], value: str, measures: Sequence[str]) -> DataFrame:
    """Add `<measure>_upto`, the total over rows of the key with a value at or below this one, and
    `<measure>_total`, that of the key. `values` holds one row per (key, value)."""
    keys = list(keys)
    coarse, fine = _bins(F.col(value))
    binned = values.withColumns({"_coarse": coarse, "_fine": fine})

    def offsets(group: list[str], bin_: str, mark: str, totals: bool) -> DataFrame:
        per = binned.groupBy(*group, bin_).agg(*[F.sum(m).alias(f"_t_{m}") for m in measures])
        before = Window.partitionBy(*group).orderBy(bin_).rowsBetween(Window.unboundedPreceding, -1)
        cols = [F.coalesce(F.sum(f"_t_{m}").over(before), F.lit(0)).alias(f"_{mark}_{m}") for m in measures]
        if totals:
            cols += [F.sum(f"_t_{m}").over(Window.partitionBy(*group)).alias(f"{m}_total") for m in measures]
        return per.select(*group, bin_, *cols)

    outer = offsets(keys, "_coarse", "o", True)
    inner = offsets([*keys, "_coarse"], "_fine", "i", False)
    inside = Window.partitionBy(*keys, "_coarse", "_fine").orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    out = binned.withColumns({f"_w_{m}": F.sum(m).over(inside) for m in measures})
    out = out.join(inner, [*keys, "_coarse", "_fine"]).join(outer, [*keys, "_coarse"])
    out = out.withColumns({f"{m}_upto": F.col(f"_w_{m}") + F.col(f"_i_{m}") + F.col(f"_o_{m}") for m in measures})
    return out.select(*values.columns, *[f"{m}_upto" for m in measures], *[f"{m}_total" for m in measures])


def _counted(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    values = (df.where(F.col(value).isNotNull()).groupBy(*keys, F.col(value).alias("_v"))
              .agg(F.count(F.lit(1)).alias("_c")))
    return running_totals(values, keys, "_v", ["_c"])


def bin_of(value: Column) -> Column:
    """One bin of a logarithmic scale with 4096 bins per factor e: values in it agree in about four digits."""
    v = value.cast("double")
    return F.floor(F.signum(v) * F.log1p(F.abs(v) * SCALE) * COARSE * 64)


def quantile_summary(df: DataFrame, keys: Sequence[str], value: str, probs: Mapping[str, float], sums: Mapping[str, Column] | None = None,
                     extremes: Mapping[str, tuple[Column, str]] | None = None) -> DataFrame:
    """Per group: the linearly interpolated quantiles of the non-null values, and totals over all its rows.

    Selection instead of ranking: one aggregate by distinct value yields the totals and a histogram together; running
    totals over the histogram (a row per bin) tell which bins hold a wanted place, and only those bins are opened and
    sorted. No value outside them is ranked or joined. `sums` are numbers to be added up per group, `extremes` anything
    with an order, of which "max" or "min" is kept.
    """
    if not keys:
        return quantile_summary(df.withColumn("_all", F.lit(1)), ["_all"], value, probs, sums, extremes).drop("_all")
    keys = list(keys)
    fold = {n: F.sum for n in sums or {}} | {n: getattr(F, how) for n, (_, how) in (extremes or {}).items()}
    sums = dict(sums or {}) | {n: c for n, (c, _) in (extremes or {}).items()}
    values = df.groupBy(*keys, F.col(value).alias("_v")).agg(F.count(F.lit(1)).alias("_c"), *[fold[n](c).alias(f"_t_{n}") for n, c in sums.items()])
    binned = values.withColumn("_bin", bin_of(F.col("_v")))
    of_key, before = Window.partitionBy(*keys), Window.partitionBy(*keys).orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
    known = F.when(F.col("_bin").isNotNull(), F.col("_c"))
    bins = binned.groupBy(*keys, "_bin").agg(F.sum("_c").alias("_c"), *[fold[n](f"_t_{n}").alias(f"_t_{n}") for n in sums])
    bins = bins.withColumns({"_n": F.coalesce(F.sum(known).over(of_key), F.lit(0)), "_below": F.coalesce(F.sum(known).over(before), F.lit(0)),
                             "_turn": F.row_number().over(of_key.orderBy("_bin")), **{n: fold[n](f"_t_{n}").over(of_key) for n in sums}})
    places = {}
    for name, p in probs.items():
        at = F.lit(float(p)) * (F.col("_n") - 1)
        places |= {f"_lo_{name}": F.floor(at), f"_hi_{name}": F.ceil(at)}
    holds_one = F.lit(False)
    for place in places.values():
        holds_one |= (F.col("_below") <= place) & (place < F.col("_below") + F.col("_c"))
    # the first bin of a group is kept as well: it carries the totals, also where every value is null
    opened = bins.where((F.col("_bin").isNotNull() & holds_one) | (F.col("_turn") == 1)).select(*keys, "_bin", "_n", "_below", *sums)
    inside = Window.partitionBy(*keys, "_bin").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    ranked = opened.join(binned.select(*keys, "_bin", "_v", "_c"), [*keys, "_bin"], "left").withColumn("_upto", F.col("_below") + F.sum("_c").over(inside))
    covers = lambda k: (F.col("_upto") - F.col("_c") <= k) & (k < F.col("_upto"))
    found = ranked.groupBy(*keys).agg(F.max("_n").alias("_n"), *[F.max(n).alias(n) for n in sums], *[F.max(F.when(covers(k), F.col("_v"))).alias(n) for n, k in places.items()])
    share = lambda p: F.lit(float(p)) * (F.col("_n") - 1) - F.floor(F.lit(float(p)) * (F.col("_n") - 1))
    return found.select(*keys, *sums, *[(F.col(f"_lo_{n}") + (F.col(f"_hi_{n}") - F.col(f"_lo_{n}")) * share(p)).alias(n) for n, p in probs.items()])


def exact_quantiles(df: DataFrame, keys: Sequence[str], value: str, probs: Mapping[str, float]) -> DataFrame:
    """Linearly interpolated quantiles of the non-null values, one column per entry of `probs`; groups without one are left out."""
    return quantile_summary(df.where(F.col(value).isNotNull()), keys, value, probs)


def average_ranks(df: DataFrame, keys: Sequence[str], value: str, name: str) -> DataFrame:
    """Add the 0-100 percentile rank within the non-null values of the group;
    ties share their average rank and NULL stays NULL."""
    mean_rank = F.col("_c_upto") - (F.col("_c") - 1) / 2
    ranks = _counted(df, keys, value).select(*keys, F.col("_v").alias(value), (mean_rank / F.col("_c_total") * 100).alias(name))
    return df.join(ranks, [*keys, value], "left")
