"""The whole contracts of a receipt and of a daily entry, as tables of broken rules.

A rule is a condition that a row breaks. Counters that are no whole numbers are told apart by the readers;
here a counter is null (absent) or a number. Values of a broken rule are never shown, only its name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyhouse.functions.usage import AUTHORITY, SAFE
from tallyhouse.operators.receipts import cost_errors

# Labels a reviewed day may carry, and the components of a count.
DRIVERS = ("building:feature", "building:content", "building:spec", "building:infra", "fixing:bug", "fixing:pipeline", "fixing:data", "fixing:security", "maintenance:docs", "maintenance:sync", "maintenance:hygiene", "maintenance:deps", "shipping", "writing", "strategy", "research", "career", "mixed", "unknown")
COMPONENTS = ("input_tokens", "output_tokens", "cached_input_tokens", "cache_write_tokens", "reasoning_tokens")
SCHEMA_VERSION = 2


def no_counter(value: Column) -> Column:
    """True for a number that is no counter: negative or beyond what a double holds exactly."""
    return (value < 0) | (value > SAFE)


def blank(text: Column) -> Column:
    """True for missing or blank text."""
    return F.coalesce(F.trim(text), F.lit("")) == ""


def unsorted(values: Column) -> Column:
    """True for an array that is not in order, each value once."""
    return F.array_sort(F.array_distinct(values)) != values


def component_rules(c: Column) -> dict[str, Column]:
    """Rules of a struct of token components (null: none told)."""
    get = c.getField
    told = F.array_compact(F.array(*[get(n) for n in COMPONENTS]))
    return {
        "components_empty": c.isNotNull() & (F.size(told) == 0),
        "components_counter": F.exists(told, no_counter),
        "components_cached": get("cached_input_tokens") > get("input_tokens"),
        "components_reasoning": get("reasoning_tokens") > get("output_tokens"),
    }


def coverage_rules(coverage: Column, reasons: Column) -> dict[str, Column]:
    """Rules of coverage and of its reasons: reasons exactly where coverage is incomplete."""
    return {
        "coverage": coverage != "incomplete",
        "reasons_form": F.exists(reasons, lambda r: r.isNull() | ~r.rlike("^[a-z0-9_]+$")),
        "reasons_order": unsorted(reasons),
        "reasons_unasked": reasons.isNotNull() & ~F.coalesce(coverage == "incomplete", F.lit(False)),
        "reasons_missing": (coverage == "incomplete") & (F.coalesce(F.size(reasons), F.lit(0)) <= 0),
    }


def broken(rules: dict[str, Column]) -> Column:
    """Names of the rules that hold, in order."""
    return F.array_sort(F.array_compact(F.array(*[F.when(F.coalesce(bad, F.lit(False)), F.lit(name)) for name, bad in rules.items()])))


def receipt_errors(receipts: DataFrame) -> DataFrame:
    """Add ``errors`` (array) by the whole receipt contract.

    Columns: schema_version, day, source, provider, surface, account_alias, snapshot_key, authority, origin,
    machine_alias, first, last (interval), models, correlation_keys, coverage, coverage_reasons, tokens,
    calls, token_components (struct) and, where there is one, cost (struct). A receipt without a schema
    version is held only to its counters and its cost.
    """
    f = F.col
    counters = {"tokens": f("tokens").isNull() | no_counter(f("tokens")), "calls": no_counter(f("calls"))}
    lists = {}
    for name in ("models", "correlation_keys"):
        lists[f"{name}_blank"] = F.exists(name, blank)
        lists[f"{name}_order"] = unsorted(f(name))
    versioned = {
        "schema_version": f("schema_version") != SCHEMA_VERSION,
        **{f"{c}_blank": blank(f(c)) for c in ("provider", "surface", "account_alias", "snapshot_key", "authority")},
        "authority": ~F.coalesce(f("authority").isin(*AUTHORITY), F.lit(False)), "origin": blank(f("origin")) & blank(f("machine_alias")),
        "interval": ~F.coalesce((f("first") <= f("day")) & (f("last") >= f("day")), F.lit(False)), **lists,
        "correlation_keys_form": F.exists("correlation_keys", lambda k: ~k.rlike("^sha256:[a-f0-9]{64}$")),
        **coverage_rules(f("coverage"), f("coverage_reasons")), **component_rules(f("token_components")),
    }
    # another version is refused as a whole; its other fields are not judged
    known = F.coalesce(f("schema_version") == SCHEMA_VERSION, F.lit(False))
    rules = counters | {n: bad if n == "schema_version" else known & bad for n, bad in versioned.items()}
    errors = broken(rules)
    if "cost" in receipts.columns:
        errors = F.array_sort(F.concat(errors, F.transform(cost_errors(f("cost")), lambda e: F.concat(F.lit("cost_"), e))))
    return receipts.withColumn("errors", errors)


def dataset_errors(daily: DataFrame, timezone: str, window_start: str, today: str, require_reviewed: bool = False) -> DataFrame:
    """(rule, day, source) for every broken rule of the daily dataset, one row an entry; source is null for a whole day.

    Columns: day, source, timezone, total, driver, tokens, calls, fidelity, authority, coverage,
    coverage_reasons, token_components (struct) and by_origin (map). total, driver and timezone are the
    day's and repeat on its entries. A day is complete before ``today``.
    """
    f = F.col
    origins = F.map_values("by_origin")
    zero = F.lit(0).cast("bigint")
    entry = {
        "source": ~f("source").rlike("^[a-z0-9_]+$"), "tokens": f("tokens").isNull() | no_counter(f("tokens")), "calls": no_counter(f("calls")),
        "fidelity": ~F.coalesce(f("fidelity").isin("exact", "estimated"), F.lit(False)), "authority": f("authority").isNotNull() & ~f("authority").isin(*AUTHORITY),
        **coverage_rules(f("coverage"), f("coverage_reasons")), **component_rules(f("token_components")),
        "origin_form": F.exists(F.map_keys("by_origin"), lambda o: ~o.rlike("^[a-z0-9][a-z0-9._/-]*$")), "origin_counter": F.exists(origins, lambda x: x.isNull() | no_counter(x)),
        "origin_sum": f("by_origin").isNotNull() & (F.aggregate(origins, zero, lambda a, x: a + F.coalesce(x, zero)) != f("tokens")),
    }
    per_entry = daily.select(F.explode(broken(entry)).alias("rule"), "day", "source")
    used = F.exists(F.array(*[f("token_components").getField(c) for c in COMPONENTS]), lambda x: F.coalesce(x > 0, F.lit(False)))
    activity = F.coalesce(f("calls") > 0, F.lit(False)) | F.coalesce(used, F.lit(False))
    days = daily.groupBy("day").agg(
        F.min("total").alias("total"), F.max("total").alias("total2"), F.max("driver").alias("driver"), F.min("timezone").alias("zone"), F.max("timezone").alias("zone2"), F.count("timezone").alias("zones"),
        F.count("*").alias("n"), F.count_distinct("source").alias("sources"), F.sum(F.when(~no_counter(f("tokens")), f("tokens"))).alias("sum"), F.bool_or(activity).alias("active"),
    )
    labels = DRIVERS if require_reviewed else (*DRIVERS, "unreviewed")
    whole = {
        "duplicate": f("sources") < f("n"), "before_window": f("day") < F.lit(window_start).cast("date"), "not_complete": f("day") >= F.lit(today).cast("date"), "timezone": (f("zone") != timezone) | (f("zone2") != timezone) | (f("zones") < f("n")),
        "total": f("total").isNull() | no_counter(f("total")) | (f("total") != f("total2")), "total_sum": F.coalesce(f("sum"), zero) != f("total"), "sum_range": f("sum") > SAFE,
        "zero_total": (f("total") == 0) & ~f("active"), "driver": ~F.coalesce(f("driver").isin(*labels), F.lit(False)),
    }
    return per_entry.unionByName(days.select(F.explode(broken(whole)).alias("rule"), "day", F.lit(None).cast("string").alias("source")))
