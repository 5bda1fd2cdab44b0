"""Scopes whose missing fields agree with anything, joined by one equi-join.

Rows are matched by which of the wild fields they hold. A row is keyed once for every such pattern of the other side
(at most 2 ** fields, and only those that occur), by the values of the fields that both hold. Rows that agree then have
equal keys, and only they: no residual condition filters pairs.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def held(fields: tuple[str, ...]) -> Column:
    """A bit for each field that is not null."""
    return reduce(lambda a, b: a + b, [F.when(F.col(f).isNull(), 0).otherwise(1 << k) for k, f in enumerate(fields)], F.lit(0))


def _keyed(rows: DataFrame, others: DataFrame, fields: tuple[str, ...], mine: str, theirs: str) -> DataFrame:
    patterns = [r[0] for r in others.select(held(fields)).distinct().collect()]  # at most 2 ** fields numbers
    both = F.col(mine).bitwiseAND(F.col(theirs))
    values = F.to_json(F.array(*[F.when(both.bitwiseAND(F.lit(1 << k)) != 0, F.col(f).cast("string")) for k, f in enumerate(fields)]))
    every = F.array(*map(F.lit, patterns)) if patterns else F.array().cast("array<int>")
    return rows.withColumn(mine, held(fields)).withColumn(theirs, F.explode(every)).withColumn("_values", values)


def wildcard_join(left: DataFrame, right: DataFrame, on: tuple[str, ...], wild: tuple[str, ...]) -> DataFrame:
    """Pairs that agree on ``on`` and, where both hold a value, on ``wild``.

    left's columns keep their names (``on`` included); right's are to have other names, but for ``on`` and ``wild``,
    which are dropped. ``on`` never agrees on null.
    """
    l, r = _keyed(left, right, wild, "_l", "_r"), _keyed(right, left, wild, "_r", "_l").drop(*wild)  # noqa: E741
    return l.join(r, [*on, "_l", "_r", "_values"]).drop("_l", "_r", "_values")


def wildcard_matches(left: DataFrame, right: DataFrame, on: tuple[str, ...], wild: tuple[str, ...], name: str, also: tuple[str, ...] = ()) -> DataFrame:
    """``left``'s columns ``also``, ``on``, ``wild``, with _n, how many rows of ``right`` agree, and _first, their least ``name``.

    Rows of ``right`` are counted by key before they are joined, so that no pairs are formed.
    """
    r = _keyed(right, left, wild, "_r", "_l").groupBy(*on, "_l", "_r", "_values").agg(F.count("*").alias("_c"), F.min(name).alias("_m"))
    cols = [*also, *on, *wild]
    l = _keyed(left.select(*cols), right, wild, "_l", "_r")  # noqa: E741
    return l.join(r, [*on, "_l", "_r", "_values"]).groupBy(*cols).agg(F.sum("_c").alias("_n"), F.min("_m").alias("_first"))


def same_scope_day(left: str, right: str, fields: tuple[str, ...]) -> Column:
    """Whether the structs ``left`` and ``right`` are of one day and source, and agree where both hold a field."""
    same = F.col(f"{left}.day").eqNullSafe(F.col(f"{right}.day")) & F.col(f"{left}.source").eqNullSafe(F.col(f"{right}.source"))
    for f in fields:
        a, b = F.col(f"{left}.{f}"), F.col(f"{right}.{f}")
        same = same & F.coalesce(a == b, F.lit(True))
    return same
