"""Joins whose left side may hold one key in a third of its rows."""
from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

#: A key is heavy from this part of all rows on, so there are at most as many heavy keys.
SHARE = 1024


def salted_join(many: DataFrame, few: DataFrame, keys: list[str], how: str = "inner", share: int = SHARE) -> DataFrame:
    """`many` joined with `few` on `keys`, equal to the plain join, with heavy keys of `many` dealt out.

    A key that holds more than 1/share of the rows of `many` is split into as many salts as its rows fill such
    parts, and its rows of `few` are repeated for each salt. The table of heavy keys has at most `share` rows by
    its definition, which is why it may be broadcast. `many` is read three times: pass a stored table. Null keys
    of `many` match nothing. `how` is inner or left.
    """
    total = many.count()
    named = [F.col(k).alias(f"__{k}") for k in keys]
    heavy = (many.groupBy(*keys).agg(F.count("*").alias("__held")).filter(F.col("__held") * share > total)
             .select(*named, F.ceil(F.col("__held") * share / F.lit(max(total, 1))).cast("long").alias("__salts")))
    same = [F.col(k) == F.col(f"__{k}") for k in keys]

    def marked(df: DataFrame) -> DataFrame:
        out = df.join(F.broadcast(heavy), same, "left").drop(*[f"__{k}" for k in keys])
        return out.withColumn("__salts", F.coalesce("__salts", F.lit(1)))

    spread = F.xxhash64(*[F.col(c) for c in many.columns if c not in keys]) if len(many.columns) > len(keys) else F.monotonically_increasing_id()
    left = marked(many).withColumn("__salt", F.pmod(spread, F.col("__salts"))).drop("__salts")
    right = marked(few).withColumn("__salt", F.explode(F.sequence(F.lit(0).cast("long"), F.col("__salts") - 1))).drop("__salts")
    return left.join(right, [*keys, "__salt"], how).drop("__salt")
