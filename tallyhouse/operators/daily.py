"""Receipts to daily entries, totals, merges and exports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyhouse.functions.usage import sum_if_complete, weakest_authority


def aggregate_entries(receipts: DataFrame) -> DataFrame:
    """One entry per (day, source): tokens, calls where reported, weakest labels, coverage."""
    return receipts.groupBy("day", "source").agg(
        F.sum("tokens").alias("tokens"), F.sum("calls").alias("calls"), F.when(F.bool_or(F.col("fidelity") == "estimated"), "estimated").otherwise("exact").alias("fidelity"),
        weakest_authority(F.col("authority")).alias("authority"), F.max("coverage").alias("coverage"), F.count("*").alias("receipts"),
    )


def component_sums(receipts: DataFrame) -> DataFrame:
    """Components per (day, source); one is kept only if every receipt has it."""
    names = ("input_tokens", "output_tokens", "cached_input_tokens")
    return receipts.groupBy("day", "source").agg(*[sum_if_complete(F.col(c)).alias(c) for c in names])


def authority_entries(receipts: DataFrame) -> DataFrame:
    """Weakest authority per (day, source)."""
    return receipts.groupBy("day", "source").agg(weakest_authority(F.col("authority")).alias("authority"))


def by_origin(receipts: DataFrame) -> DataFrame:
    """Tokens by origin inside an entry, long form; receipts without an origin take no part."""
    return receipts.where("origin is not null").groupBy("day", "source", "origin").agg(F.sum("tokens").alias("tokens"))


def day_totals(entries: DataFrame) -> DataFrame:
    """Total, exact and estimated tokens and number of sources by day."""
    part = lambda f: F.coalesce(F.sum(F.when(F.col("fidelity") == f, F.col("tokens"))), F.lit(0)).alias(f)
    return entries.groupBy("day").agg(F.sum("tokens").alias("total"), part("exact"), part("estimated"), F.count("*").alias("n_sources"))


def merge_daily(daily: DataFrame, entries: DataFrame) -> DataFrame:
    """Replace entries of the same (day, source), keep the others; a new day is unreviewed."""
    key = ["day", "source"]
    kept = daily.select(*key, "tokens", "calls", "fidelity", "driver")
    drivers = daily.groupBy("day").agg(F.max("driver").alias("driver"), F.lit(True).alias("_known"))
    new = entries.join(drivers, "day", "left").select(*key, "tokens", "calls", "fidelity", F.when(F.col("_known").isNull(), "unreviewed").otherwise(F.col("driver")).alias("driver"))
    return kept.join(entries.select(*key), key, "left_anti").unionByName(new)


def export_wide(daily: DataFrame) -> DataFrame:
    """One row a day: total, sources joined by blanks, exact only if every entry is."""
    names = F.array_join(F.array_sort(F.collect_set("source")), " ")
    mixed = F.when(F.bool_and(F.col("fidelity") == "exact"), "exact").otherwise("mixed")
    return daily.groupBy("day").agg(F.sum("tokens").alias("total_tokens"), names.alias("sources"), mixed.alias("fidelity"))


def export_detail(daily: DataFrame, origins: DataFrame) -> DataFrame:
    """One row per (day, source, origin): calls blank when split, input on the first origin only."""
    key = ["day", "source"]
    w = Window.partitionBy(*key)
    rows = daily.join(origins.withColumnsRenamed({"tokens": "origin_tokens"}), key, "left")
    n, first = F.count("origin").over(w), F.row_number().over(w.orderBy(F.col("origin").asc_nulls_first()))
    rows = rows.withColumns({"_n": n, "_first": first})
    return rows.select(*key, F.coalesce("origin", F.lit("")).alias("origin"), F.coalesce("origin_tokens", "tokens").alias("tokens"), F.when(F.col("_n") <= 1, F.col("calls")).alias("calls"), F.when(F.col("_first") == 1, F.col("input_tokens")).alias("input_tokens"))


def check_export(stored: DataFrame, computed: DataFrame) -> DataFrame:
    """Rows that only one of two exports has."""
    side = lambda a, b, name: a.exceptAll(b.select(*a.columns)).withColumn("side", F.lit(name))
    return side(stored, computed, "stored").unionByName(side(computed, stored, "computed"))


def filter_daily(entries: DataFrame, source: str | None = None, fidelity: str | None = None, origin: str | None = None) -> DataFrame:
    """Entries of a dashboard filter. ``entries`` has origin and origin_tokens, long by origin.

    With an origin its tokens count, and calls only where it is the whole entry.
    """
    out = entries
    for column, value in (("source", source), ("fidelity", fidelity), ("origin", origin)):
        if value is not None:
            out = out.where(F.col(column) == value)
    if origin is None:
        return out.select("day", "source", "fidelity", "tokens", "calls").distinct()
    whole = F.col("origin_tokens") == F.col("tokens")
    rows = out.select("day", "source", "fidelity", F.col("origin_tokens").alias("tokens"), F.when(whole, F.col("calls")).alias("calls"))
    return rows.where((F.col("tokens") > 0) | F.col("calls").isNotNull())


def window_range(daily: DataFrame, days: int | None, as_of: str, opened: str | None = None) -> DataFrame:
    """(start, end) of what a dashboard shows: the last ``days`` days, or all from the earlier of the first row and ``opened``."""
    end = F.lit(as_of).cast("date")
    first = F.lit(as_of).cast("date") if days is None else F.date_sub(end, days - 1)
    if days is None:
        first = F.coalesce(F.least(F.lit(opened).cast("date"), F.min("day")), first)
    return daily.agg(F.min("day").alias("_"), first.alias("start")).select("start", end.alias("end"))


def visible_window(daily: DataFrame, days: int | None, as_of: str) -> DataFrame:
    """Rows of the last ``days`` days back from ``as_of``; every row without a number of days."""
    if days is None:
        return daily
    end = F.lit(as_of).cast("date")
    return daily.where((F.col("day") <= end) & (F.col("day") > F.date_sub(end, days)))


def has_activity(calls: Column, *components: Column) -> Column:
    """True for a measured use: positive calls or a positive component."""
    out = F.coalesce(calls > 0, F.lit(False))
    for c in components:
        out = out | F.coalesce(c > 0, F.lit(False))
    return out


def normalize_legacy(wide: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """A legacy row with a column per source as long entries; absent stays absent."""
    return wide.unpivot([key], columns, "source", "tokens").where("tokens is not null")


def union_receipts(*frames: DataFrame) -> DataFrame:
    """Receipts of all sources; columns that a source lacks are null."""
    out = frames[0]
    for df in frames[1:]:
        out = out.unionByName(df, allowMissingColumns=True)
    return out
