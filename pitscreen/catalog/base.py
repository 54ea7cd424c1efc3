"""Registry of queries with their SQL counterpart.

SQL texts name shared sub-queries from `ctes`; only the ones a text needs are
put in front of it. Both sides round doubles to six digits and widen integers.
"""
from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from .ctes import CTES

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def finish(df: DataFrame, digits: int | None = 6) -> DataFrame:
    cols = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            c = (c.cast("double") if digits is None else F.round(c.cast("double"), digits)) + F.lit(0.0)
        elif isinstance(f.dataType, (T.IntegerType, T.ShortType, T.ByteType)):
            c = c.cast("bigint")
        cols.append(c.alias(f.name))
    return df.select(*cols)


def _refers(sql: str, name: str) -> bool:
    return re.search(rf"\b(?:FROM|JOIN)\s+{name}\b", sql) is not None


def _needed(sql: str, found: list[str], open_: tuple[str, ...] = ()) -> None:
    for name, text in CTES.items():
        if name in found or name in open_ or not _refers(sql, name):
            continue
        _needed(text, found, (*open_, name))
        found.append(name)


def oracle(sql: str, d: str = "", i: str = "", digits: int | None = 6) -> str:
    number = "CAST({c} AS DOUBLE)" if digits is None else "round(CAST({c} AS DOUBLE), " + f"{digits})"
    swaps = [f"{number.format(c=c)} + 0.0::DOUBLE AS {c}" for c in d.split()]
    swaps += [f"CAST({c} AS BIGINT) AS {c}" for c in i.split()]
    found: list[str] = []
    _needed(sql, found)
    recursive = "RECURSIVE " if any(_refers(CTES[n], n) for n in found) else ""
    parts = [f"{n} AS ({CTES[n]})" for n in found] + [f"answer AS ({sql})"]
    replace = f" REPLACE ({', '.join(swaps)})" if swaps else ""
    return f"WITH {recursive}" + ",\n".join(parts) + f"\nSELECT *{replace} FROM answer"


def query(name: str, sql: str | None = None, d: str = "", i: str = "", digits: int | None = 6):
    """Register a query; `d` and `i` list the double and integer columns of its SQL."""
    def register(fn: Callable[[SparkSession, str], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = lambda spark, sf: finish(fn(spark, sf), digits)
        if sql is not None:
            ORACLES[name] = oracle(sql, d, i, digits)
        return fn
    return register
