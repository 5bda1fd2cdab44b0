"""Dashboard analytics over the daily record."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyhouse.functions.usage import js_round, origin_kind, week_start


def totals(daily: DataFrame) -> DataFrame:
    """(day, total) of the record."""
    return daily.groupBy("day").agg(F.sum("tokens").alias("total"))


def calendar(daily: DataFrame, start: str, end: str) -> DataFrame:
    """Every day of a range."""
    days = F.explode(F.sequence(F.lit(start).cast("date"), F.lit(end).cast("date")))
    return daily.sparkSession.range(1).select(days.alias("day"))


def with_gaps(daily: DataFrame, start: str, end: str) -> DataFrame:
    """Every day of the range with its total, null on days without evidence."""
    t = totals(daily.where(F.col("day").between(start, end)))
    return calendar(daily, start, end).join(t, "day", "left").withColumn("gap", F.col("total").isNull())


def _on_days(daily: DataFrame, before: int, after: int) -> Window:
    return Window.orderBy(F.unix_date("day")).rangeBetween(before, after)


def calendar_average(daily: DataFrame) -> DataFrame:
    """Average of the last seven calendar days and of the seven before; null unless all seven are there."""
    t = totals(daily)
    def part(lo: int, hi: int):  # noqa: ANN202
        w = _on_days(daily, lo, hi)
        return F.when(F.count("total").over(w) == 7, js_round(F.sum("total").over(w) / 7).cast("bigint"))
    rows = t.withColumns({"average": part(-6, 0), "before": part(-13, -7)})
    change = js_round(100.0 * (F.col("average") - F.col("before")) / F.nullif(F.col("before"), F.lit(0))).cast("bigint")
    return rows.select("day", "total", "average", "before", change.alias("delta_percent"))


def scanned_week(daily: DataFrame, as_of: str) -> DataFrame:
    """(week, average): the Sunday week of the newest row, or the one before if it is still open."""
    newest = daily.agg(F.max("day").alias("m")).select(week_start(F.col("m")).alias("w"))
    week = newest.select(F.when(F.date_add("w", 6) < F.lit(as_of).cast("date"), F.col("w")).otherwise(F.date_sub("w", 7)).alias("week"))
    rows = totals(daily).withColumn("week", week_start(F.col("day"))).groupBy("week").agg(F.sum("total").alias("total"))
    return week.join(rows, "week", "left").select("week", js_round(F.col("total") / 7).cast("bigint").alias("average"))


def weekly_series(daily: DataFrame, start: str, end: str) -> DataFrame:
    """Totals of Monday weeks, null for weeks without evidence."""
    weeks = calendar(daily, start, end).select(F.date_trunc("week", "day").cast("date").alias("week")).distinct()
    rows = totals(daily.where(F.col("day").between(start, end))).groupBy(F.date_trunc("week", "day").cast("date").alias("week")).agg(F.sum("total").alias("total"))
    return weeks.join(rows, "week", "left")


def day_runs(days: DataFrame) -> DataFrame:
    """Runs of consecutive days: first, last, length."""
    d = days.select("day").distinct()
    island = F.date_sub("day", F.row_number().over(Window.orderBy("day")))
    return d.withColumn("g", island).groupBy("g").agg(F.min("day").alias("first_day"), F.max("day").alias("last_day"), F.count("*").alias("days")).drop("g")


def adjacent_duplicates(daily: DataFrame) -> DataFrame:
    """Entries equal in tokens and calls to the same source's entry of the day before."""
    w = Window.partitionBy("source").orderBy("day")
    rows = daily.withColumns({"pd": F.lag("day").over(w), "pt": F.lag("tokens").over(w), "pc": F.lag("calls").over(w)})
    return rows.where((F.datediff("day", "pd") == 1) & (F.col("tokens") == F.col("pt")) & F.col("calls").eqNullSafe(F.col("pc"))).select("day", "source", "tokens")


def intensity(daily: DataFrame) -> DataFrame:
    """Quartile level 0 to 4 of each day, cut at sorted positions floor(f * n) of the totals above 0."""
    t = totals(daily)
    ranked = t.where("total > 0").withColumns({"i": F.row_number().over(Window.orderBy("total", "day")) - 1, "n": F.count("*").over(Window.partitionBy())})
    at = lambda f: F.max(F.when(F.col("i") == F.least(F.col("n") - 1, F.floor(F.col("n") * f)), F.col("total")))
    cuts = ranked.agg(at(0.25).alias("q1"), at(0.5).alias("q2"), at(0.75).alias("q3"))
    x = F.col("total")
    level = F.when(x <= 0, 0).when(x <= F.col("q1"), 1).when(x <= F.col("q2"), 2).when(x <= F.col("q3"), 3).otherwise(4)
    return t.crossJoin(F.broadcast(cuts)).select("day", "total", level.alias("level"))


def summarize(daily: DataFrame, start: str, end: str) -> DataFrame:
    """Headline figures of a range: totals, exact share, peak (earliest on ties), days, scale equivalents."""
    rows = daily.where(F.col("day").between(start, end))
    exact = F.sum(F.when(F.col("fidelity") == "exact", F.col("tokens")).otherwise(0))
    t = totals(rows).agg(F.max_by("day", F.struct("total", -F.unix_date("day"))).alias("peak_day"), F.max("total").alias("peak"), F.count("*").alias("evidence_days"))
    s = rows.agg(F.sum("tokens").alias("total"), exact.alias("exact"))
    elapsed = F.greatest(F.lit(1), F.datediff(F.lit(end), F.lit(start)) + 1)
    return s.crossJoin(t).select("total", "exact", (F.col("total") - F.col("exact")).alias("estimated"), js_round(100.0 * F.col("exact") / F.nullif(F.col("total"), F.lit(0))).cast("bigint").alias("exact_percent"), "peak_day", "peak", "evidence_days", elapsed.alias("elapsed_days"), *[F.floor(F.col("total") / n).cast("bigint").alias(f"per_{n}") for n in (1500, 90000, 11000)])


def _with_share(rows: DataFrame) -> DataFrame:
    everything = Window.partitionBy()
    return rows.withColumns({"share": F.col("tokens") / F.nullif(F.sum("tokens").over(everything), F.lit(0)), "place": F.rank().over(Window.orderBy(F.desc("tokens")))})


def driver_mix(daily: DataFrame) -> DataFrame:
    """Tokens, share and rank by label; null and unreviewed await review, unknown is reviewed."""
    d = F.col("driver")
    state = F.when(d.isNull() | (d == "unreviewed"), "awaiting").when(d == "unknown", "reviewed_unknown").otherwise("named")
    return _with_share(daily.groupBy(F.coalesce(d, F.lit("unreviewed")).alias("driver"), state.alias("state")).agg(F.sum("tokens").alias("tokens")))


def source_mix(daily: DataFrame) -> DataFrame:
    """Tokens by fidelity, calls, share and rank by source."""
    part = lambda f: F.sum(F.when(F.col("fidelity") == f, F.col("tokens")).otherwise(0)).alias(f)
    return _with_share(daily.groupBy("source").agg(F.sum("tokens").alias("tokens"), part("exact"), part("estimated"), F.sum("calls").alias("calls")))


def authority_split(receipts: DataFrame) -> DataFrame:
    """Tokens by source and authority, one column each; unrecorded ones apart."""
    known = ["estimated", "reconstructed", "tool", "provider", "unrecorded"]
    return receipts.withColumn("a", F.coalesce("authority", F.lit("unrecorded"))).groupBy("source").pivot("a", known).agg(F.sum("tokens"))


def origin_mix(receipts: DataFrame) -> DataFrame:
    """Tokens by kind of origin and origin."""
    o = F.coalesce("origin", F.lit("unattributed"))
    return _with_share(receipts.groupBy(origin_kind(o).alias("kind"), o.alias("origin")).agg(F.sum("tokens").alias("tokens")))


def cadence(daily: DataFrame) -> DataFrame:
    """Totals and active days by weekday (1 is Sunday)."""
    return totals(daily).groupBy(F.dayofweek("day").alias("weekday")).agg(F.sum("total").alias("tokens"), F.count("*").alias("active_days"))


def request_sizes(daily: DataFrame) -> DataFrame:
    """Daily tokens a call in eight bins of equal width in log10, with median and mean; none below two days."""
    rows = daily.where("calls > 0").groupBy("day").agg((F.sum("tokens") / F.sum("calls")).alias("x")).where("x > 0").withColumn("l", F.log10("x"))
    s = rows.agg(F.min("l").alias("lo"), F.max("l").alias("hi"), F.count("*").alias("n"))
    step = F.when(F.col("hi") > F.col("lo"), (F.col("hi") - F.col("lo")) / 8).otherwise(1.0)
    return rows.crossJoin(F.broadcast(s)).where("n >= 2").groupBy(F.least(F.lit(7), F.floor((F.col("l") - F.col("lo")) / step)).cast("int").alias("bin")).agg(F.count("*").alias("days"))


def coverage_report(daily: DataFrame, start: str, as_of: str) -> DataFrame:
    """Days, tokens and last day by source, beside the days of the window without evidence."""
    rows = daily.where(F.col("day").between(start, as_of))
    missing = with_gaps(daily, start, as_of).agg(F.count_if("gap").alias("missing_days"))
    per = rows.groupBy("source").agg(F.count_distinct("day").alias("days"), F.sum("tokens").alias("tokens"), F.max("day").alias("last_day"))
    return per.crossJoin(F.broadcast(missing))


def freshness(daily: DataFrame, as_of: str) -> DataFrame:
    """First and last known day by source and an age class."""
    age = F.datediff(F.lit(as_of).cast("date"), F.col("last_day"))
    rows = daily.groupBy("source").agg(F.min("day").alias("first_day"), F.max("day").alias("last_day"))
    return rows.withColumn("age", F.when(age <= 1, "current").when(age <= 7, "recent").otherwise("older"))


def observed_intervals(daily: DataFrame) -> DataFrame:
    """First and last day by source."""
    return daily.groupBy("source").agg(F.min("day").alias("first_day"), F.max("day").alias("last_day"))


def interval_days(intervals: DataFrame, start: str, end: str) -> DataFrame:
    """Status of every day by source: unknown < known_empty < covered. ``intervals``: source, from, to, status.

    The day side is generated from each interval, so no range join is left.
    """
    rank = F.when(F.col("status") == "covered", 3).when(F.col("status") == "known_empty", 2).otherwise(1)
    lo, hi = F.greatest(F.col("from"), F.lit(start).cast("date")), F.least(F.col("to"), F.lit(end).cast("date"))
    rows = intervals.where(lo <= hi).select("source", F.explode(F.sequence(lo, hi)).alias("day"), rank.alias("r"))
    return rows.groupBy("source", "day").agg(F.max("r").alias("rank"))


def missing_coverage(daily: DataFrame, intervals: DataFrame) -> DataFrame:
    """(source, days) of entries that no covered interval holds."""
    days = intervals.where("status = 'covered'").select("source", F.explode(F.sequence("from", "to")).alias("day")).distinct()
    return daily.join(days, ["source", "day"], "left_anti").groupBy("source").agg(F.count("*").alias("days"))


def unlabelled(daily: DataFrame, labels: DataFrame) -> DataFrame:
    """(source, days) of the sources that have no label."""
    return daily.join(labels.select("source").distinct(), "source", "left_anti").groupBy("source").agg(F.count_distinct("day").alias("days"))


def date_order_errors(rows: DataFrame, position: str = "position", day: str = "day") -> DataFrame:
    """(position, day, why): rows of a dataset whose day was there before (duplicate) or is not after the row above (unsorted).

    Daily rows are few; the window without a key runs on them, never on calls.
    """
    above = F.lag(day).over(Window.orderBy(position))
    before = F.row_number().over(Window.partitionBy(day).orderBy(position)) > 1
    found = rows.select(F.col(position).alias("position"), F.col(day).alias("day"), F.array(F.when(before, F.lit("duplicate")), F.when(F.col(day) <= above, F.lit("unsorted"))).alias("e"))
    return found.select("position", "day", F.explode(F.array_compact("e")).alias("why"))


def reference_overlap(a: DataFrame, b: DataFrame) -> DataFrame:
    """How many (day, source, tokens) of ``a`` occur in ``b``."""
    key = ["day", "source", "tokens"]
    return a.select(*key).distinct().join(b.select(*key).distinct(), key, "left_semi").agg(F.count("*").alias("shared"))


def top_drivers(daily: DataFrame, n: int = 5) -> DataFrame:
    """The ``n`` largest labels; the rest as other."""
    rows = daily.groupBy("source", "driver").agg(F.sum("tokens").alias("tokens")).withColumn("name", F.concat_ws("/", "source", "driver"))
    place = F.row_number().over(Window.orderBy(F.desc("tokens"), "name"))
    return rows.withColumn("name", F.when(place <= n, F.col("name")).otherwise("other")).groupBy("name").agg(F.sum("tokens").alias("tokens"))


def latest_days(daily: DataFrame, n: int = 30) -> DataFrame:
    """The latest ``n`` days with their trailing average."""
    return calendar_average(daily).orderBy(F.desc("day")).limit(n).select("day", "total", "average")


def evaluate(daily: DataFrame, as_of: str, start: str) -> DataFrame:
    """(check, count, verdict) of the dataset-wide checks."""
    d, by_source = F.col("day"), Window.partitionBy("source").orderBy("day")
    again = (F.datediff("day", F.lag("day").over(by_source)) == 1) & (F.col("tokens") == F.lag("tokens").over(by_source)) & F.col("calls").eqNullSafe(F.lag("calls").over(by_source))
    rows = daily.withColumns({"_again": again, "_place": F.row_number().over(Window.partitionBy("source", "day").orderBy("tokens"))})
    checks = {
        "future": (d > F.lit(as_of).cast("date"), "FAIL"), "before_window": (d < F.lit(start).cast("date"), "FAIL"), "duplicate_entry": (F.col("_place") == 2, "FAIL"),
        "unsupported_zero": ((F.col("tokens") == 0) & (F.coalesce("calls", F.lit(0)) == 0), "FAIL"), "adjacent_duplicate": (F.col("_again"), "FAIL"),
        "unreviewed": (F.col("driver").isNull() | (F.col("driver") == "unreviewed"), "WARN"), "open_week": (d >= week_start(F.lit(as_of).cast("date")), "WARN"),
    }
    # one scan counts every check; the counts are then turned into rows
    counted = rows.agg(*[F.count_if(bad).alias(name) for name, (bad, _) in checks.items()]).unpivot([], list(checks), "check", "count")
    level = F.when(F.col("check").isin(*[n for n, (_, v) in checks.items() if v == "FAIL"]), "FAIL").otherwise("WARN")
    return counted.select("check", "count", F.when(F.col("count") == 0, "ok").otherwise(level).alias("verdict"))


def validate_dataset(daily: DataFrame, as_of: str, start: str) -> DataFrame:
    """(rule, day, source) for every broken rule of the daily contract."""
    f = F.col
    rules = {
        "calls": f("calls") < 0, "date": (f("day") > F.lit(as_of).cast("date")) | (f("day") < F.lit(start).cast("date")), "driver": f("driver").isNull(),
        "fidelity": ~f("fidelity").isin("exact", "estimated"), "source": ~f("source").rlike("^[a-z][a-z0-9_]*$"), "tokens": (f("tokens") < 0) | (f("tokens") > 2**53 - 1),
    }
    broken = F.array_compact(F.array(*[F.when(F.coalesce(bad, F.lit(False)), name) for name, bad in rules.items()]))
    return daily.select(F.explode(broken).alias("rule"), "day", "source")


def synthetic_check(daily: DataFrame, first: str, last: str, origins: list[str], most: int) -> DataFrame:
    """One row: rows outside the date range, of other origins, and beyond the row limit."""
    return daily.agg(F.count_if(~F.col("day").between(first, last)).alias("outside"), F.count_if(~F.col("origin").isin(*origins)).alias("foreign_origin"), F.greatest(F.lit(0), F.count("*") - most).alias("beyond_limit"))
