"""Dashboard figures and dataset-wide verdicts over daily entries, each from aggregates of a scan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyhouse.functions.usage import SAFE, SOURCE_LABELS, js_round, week_start
from tallyhouse.operators.acceptance import RETIRED


def request_size_summary(daily: DataFrame) -> DataFrame:
    """One row: days, median (at position floor(n / 2)) and mean of the daily tokens a call, and the range; none below two days.

    Entries without calls take no part. Means of days are few: the window without a key runs on them.
    """
    means = daily.where("calls > 0").groupBy("day").agg((F.sum("tokens") / F.sum("calls")).alias("x")).where("x > 0")
    placed = means.withColumns({"i": F.row_number().over(Window.orderBy("x", "day")) - 1, "n": F.count("*").over(Window.partitionBy())})
    middle = F.max(F.when(F.col("i") == F.floor(F.col("n") / 2), F.col("x")))
    return placed.agg(F.count("*").alias("days"), middle.alias("median"), F.avg("x").alias("mean"), F.min("x").alias("least"), F.max("x").alias("most")).where("days >= 2")


def cadence_summary(daily: DataFrame, start: str, end: str) -> DataFrame:
    """One row: days with evidence, days of the range, their share in per cent, the longest run of days and the run that ends with the range."""
    days = daily.where(F.col("day").between(start, end)).select("day").distinct()
    island = F.date_sub("day", F.row_number().over(Window.orderBy("day")))
    runs = days.withColumn("g", island).groupBy("g").agg(F.count("*").alias("n"), F.max("day").alias("last"))
    elapsed = F.datediff(F.lit(end), F.lit(start)) + 1
    now = F.max(F.when(F.col("last") == F.lit(end).cast("date"), F.col("n")))
    active = F.coalesce(F.sum("n"), F.lit(0))
    return runs.agg(active.alias("active"), F.first(elapsed).alias("_e"), F.coalesce(F.max("n"), F.lit(0)).alias("longest"), F.coalesce(now, F.lit(0)).alias("current")).select(
        "active", elapsed.cast("bigint").alias("elapsed"), js_round(100.0 * F.col("active") / elapsed).cast("bigint").alias("percent"), "longest", "current"
    )


def coverage_split(daily: DataFrame, start: str, as_of: str) -> DataFrame:
    """One row: days of the window, and how many are real, sample-only (every entry is a placeholder) and missing."""
    days = daily.where(F.col("day").between(start, as_of)).groupBy("day").agg(F.bool_and(F.col("fidelity") == "sample").alias("sample"))
    window = F.datediff(F.lit(as_of), F.lit(start)) + 1
    return days.agg(F.count_if(~F.col("sample")).alias("real"), F.count_if("sample").alias("sample_only")).select(window.cast("bigint").alias("window_days"), "real", "sample_only", (window - F.col("real") - F.col("sample_only")).alias("missing"))


def authority_overall(entries: DataFrame) -> DataFrame:
    """Tokens by source and authority with unrecorded ones apart, and a row ``*`` for all sources."""
    known = ("estimated", "reconstructed", "tool", "provider")
    part = [F.sum(F.when(F.col("authority") == a, F.col("tokens")).otherwise(0)).alias(a) for a in known]
    rest = F.sum(F.when(F.coalesce(F.col("authority").isin(*known), F.lit(False)), 0).otherwise(F.col("tokens"))).alias("unrecorded")
    rows = entries.groupBy("source").agg(*part, rest)
    return rows.unionByName(rows.agg(*[F.sum(c).alias(c) for c in (*known, "unrecorded")]).withColumn("source", F.lit("*")))


def source_coverage(entries: DataFrame) -> DataFrame:
    """By source: tokens, and how many entries are whole and how many have gaps."""
    gap = F.coalesce(F.col("coverage") == "incomplete", F.lit(False))
    return entries.groupBy("source").agg(F.sum("tokens").alias("tokens"), F.count_if(~gap).alias("whole"), F.count_if(gap).alias("incomplete"), F.when(F.bool_or(gap), "incomplete").alias("coverage"))


def freshness_of(daily: DataFrame, bounds: DataFrame, as_of: str) -> DataFrame:
    """First and last known day and the age class of every source, and of every surface of ``bounds`` (surface, first_day, last_day).

    Bounds tell what is known of a surface; they are no usage and add to nothing.
    """
    rows = daily.groupBy(F.col("source").alias("name")).agg(F.min("day").alias("first_day"), F.max("day").alias("last_day")).withColumn("kind", F.lit("source"))
    seen = bounds.groupBy(F.col("surface").alias("name")).agg(F.min("first_day").alias("first_day"), F.max("last_day").alias("last_day")).withColumn("kind", F.lit("surface"))
    age = F.datediff(F.lit(as_of).cast("date"), F.col("last_day"))
    return rows.unionByName(seen).withColumn("age", F.when(age <= 1, "current").when(age <= 7, "recent").otherwise("older"))


def ledger_overview(ledger: DataFrame, identities: DataFrame) -> DataFrame:
    """By source: entries that count, of them accepted and unverified; superseded, excluded and corrected-out ones; identities and dedupe level.

    dedupe: request (every counting entry has identities), snapshot (every one has at least a snapshot), mixed, or none (no
    entry has either). Identities are counted once a source, from the side table.
    """
    gone = F.col("disposition")
    counts = F.coalesce(~gone.isin(*RETIRED), F.lit(True))
    ok = F.coalesce(F.col("acceptance") == "accepted", F.lit(False))
    keyed, snap = F.col("n_keys") > 0, F.col("snapshot_key").isNotNull()
    n = F.count_if
    rows = ledger.groupBy("source").agg(
        n(counts).alias("active"), n(counts & ok).alias("accepted"), n(counts & ~ok).alias("unverified"), *[n(F.coalesce(gone == d, F.lit(False))).alias(d.replace("-", "_")) for d in RETIRED], F.sum(F.size("history")).alias("prior_versions"),
        n(counts & keyed).alias("_k"), n(counts & (keyed | snap)).alias("_s"),
    )
    ids = identities.join(ledger.where(counts).select("entry_id", "source"), "entry_id").groupBy("source").agg(F.count_distinct("key").alias("identities"))
    level = F.when(F.col("_s") == 0, "none").when(F.col("_k") == F.col("active"), "request").when((F.col("_s") == F.col("active")) & (F.col("_k") == 0), "snapshot").otherwise("mixed")
    return rows.join(ids, "source", "left").withColumns({"identities": F.coalesce("identities", F.lit(0)), "dedupe": level}).drop("_k", "_s")


def evaluate_whole(daily: DataFrame, as_of: str, start: str, weekly: bool = True, labels: tuple[str, ...] = tuple(SOURCE_LABELS)) -> DataFrame:
    """(check, count, verdict) of all dataset-wide checks: ok where nothing is found, else FAIL or WARN.

    daily: entries with day, source, total (the day's), driver, tokens, calls, fidelity, token_components (struct or null) and by_origin (map or
    null). Days are counted once, entries each. total_sum, duplicate_entry, out_of_window, open_day, unsupported_zero,
    adjacent_duplicate, sample, unlabelled (sources), typing, source_sum and origin_sum fail; open_week and unreviewed warn.
    """
    today = F.lit(as_of).cast("date")
    d, told = F.col("day"), F.col("token_components")
    used = F.lit(False)
    for f in daily.schema["token_components"].dataType.names:
        used = used | F.coalesce(told[f] > 0, F.lit(False))
    w = Window.partitionBy("source").orderBy("day")
    again = (F.datediff("day", F.lag("day").over(w)) == 1) & (F.col("tokens") == F.lag("tokens").over(w)) & F.col("calls").eqNullSafe(F.lag("calls").over(w)) & (F.col("tokens") > 0)
    parts = F.aggregate(F.map_values("by_origin"), F.lit(0).cast("bigint"), lambda a, x: a + F.coalesce(x, F.lit(0)))
    rows = daily.withColumns({"_again": F.coalesce(again, F.lit(False)), "_active": F.coalesce(F.col("calls") > 0, F.lit(False)) | used})
    odd = ~F.coalesce(F.col("fidelity").isin("exact", "estimated"), F.lit(False)) | F.col("tokens").isNull() | (F.col("tokens") < 0) | (F.col("tokens") > SAFE)
    entries = {"adjacent_duplicate": F.col("_again"), "sample": F.coalesce(F.col("fidelity") == "sample", F.lit(False)), "typing": odd, "origin_sum": F.coalesce(parts != F.col("tokens"), F.lit(False))}
    days = rows.groupBy("day").agg(F.max("total").alias("total"), F.sum("tokens").alias("sum"), F.bool_or("_active").alias("active"), F.max("driver").alias("driver"), (F.count("*") - F.count_distinct("source")).alias("twice"))
    per_day = {
        "total_sum": ~F.col("total").eqNullSafe(F.col("sum")), "out_of_window": (d > today) | (d < F.lit(start).cast("date")), "open_day": d == today, "unsupported_zero": (F.col("total") == 0) & ~F.col("active"),
        "open_week": (d >= week_start(today)) & (d < today) if weekly else F.lit(False), "unreviewed": F.coalesce("driver", F.lit("unreviewed")) == "unreviewed",
    }

    def counted(df: DataFrame, checks: dict[str, Column], *more: Column) -> DataFrame:
        names = [*checks, *(["duplicate_entry"] if more else [])]
        return df.agg(*[F.count_if(bad).alias(n) for n, bad in checks.items()], *more).unpivot([], names, "check", "count")

    out = counted(rows, entries).unionByName(counted(days, per_day, F.coalesce(F.sum("twice"), F.lit(0)).alias("duplicate_entry")))
    unknown = rows.select("source").distinct().where(~F.col("source").isin(*labels)).agg(F.count("*").alias("count")).select(F.lit("unlabelled").alias("check"), "count")
    whole = days.agg(F.coalesce(F.sum("total"), F.lit(0)).alias("a")).crossJoin(rows.agg(F.coalesce(F.sum("tokens"), F.lit(0)).alias("b"))).select(F.lit("source_sum").alias("check"), (F.col("a") != F.col("b")).cast("bigint").alias("count"))
    every = out.unionByName(unknown).unionByName(whole)
    return every.select("check", "count", F.when(F.col("count") == 0, "ok").when(F.col("check").isin("open_week", "unreviewed"), "WARN").otherwise("FAIL").alias("verdict"))


def dominates_whole(new: DataFrame, old: DataFrame, components: tuple[str, ...]) -> DataFrame:
    """By source: whether the new receipts reach the old ones on every day in tokens, calls and every component that the old ones tell."""
    cols = ("tokens", "calls", *components)
    rows = old.join(new.select("day", "source", *[F.col(c).alias(f"_{c}") for c in cols]), ["day", "source"], "left")
    ok = F.lit(True)
    for c in cols:
        ok = ok & (F.col(c).isNull() | F.coalesce(F.col(f"_{c}") >= F.col(c), F.lit(False)))
    return rows.groupBy("source").agg(F.bool_and(ok).alias("dominates"), F.count_if(~ok).alias("short_days"))
