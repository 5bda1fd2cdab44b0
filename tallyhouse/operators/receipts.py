"""Receipt-level rules: costs, transport, decisions, version history, retirements, evidence text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyhouse.functions.usage import SAFE

# The reviewed bases of a provider's cost figure, with its unit and where its currency is stated.
COST_BASES = {
    "perplexity_usage_total_cost": ("major", "documented"),
    "anthropic_cost_report_day": ("minor", "reported"),
    "openai_costs_day": ("major", "reported"),
}
DECIMAL_TEXT = r"^-?(0|[1-9][0-9]*)(\.[0-9]+)?([eE][-+]?[0-9]+)?$"


def cost_errors(cost: Column) -> Column:
    """Broken rules of a cost struct (schema_version, basis, amount, currency, unit, currency_basis); none for null."""
    get = cost.getField
    unit, stated = F.lit(None).cast("string"), F.lit(None).cast("string")
    for basis, (u, s) in COST_BASES.items():
        unit, stated = F.when(get("basis") == basis, u).otherwise(unit), F.when(get("basis") == basis, s).otherwise(stated)
    known = F.coalesce(get("basis").isin(*COST_BASES), F.lit(False))
    rules = {
        "amount": ~F.coalesce(get("amount").rlike(DECIMAL_TEXT), F.lit(False)), "basis": ~known, "currency": ~F.coalesce(get("currency").rlike("^[A-Za-z]{3}$"), F.lit(False)),
        "schema_version": ~F.coalesce(get("schema_version") == 1, F.lit(False)), "unit": known & ~(get("unit").eqNullSafe(unit) & get("currency_basis").eqNullSafe(stated)),
    }
    return F.array_compact(F.array(*[F.when(cost.isNotNull() & bad, F.lit(name)) for name, bad in rules.items()]))


def attach_cost(receipts: DataFrame, costs: DataFrame) -> DataFrame:
    """Receipts with their day's cost as written; a day without a figure stays without one."""
    return receipts.join(costs.select("day", F.col("amount").alias("cost_amount"), F.col("currency").alias("cost_currency")), "day", "left")


def normalize_receipts(receipts: DataFrame, source: str, provider: str, prefix: str) -> DataFrame:
    """Two historical capture transports of one source become surface api; the transport is kept apart."""
    old = F.col("surface").isin("native_api_capture", "tool_result_capture")
    hit = F.coalesce((F.col("source") == source) & (F.col("provider") == provider) & old & F.col("snapshot_key").startswith(prefix), F.lit(False))
    return receipts.withColumn("capture_method", F.when(hit, F.col("surface"))).withColumn("surface", F.when(hit, "api").otherwise(F.col("surface")))


def decision_errors(decisions: DataFrame) -> DataFrame:
    """Decisions with what is wrong: a repeated account, an unknown mode, no date or no evidence."""
    n = F.count("*").over(Window.partitionBy("source", "account"))
    errors = F.array(
        F.when(n > 1, F.lit("repeated")), F.when(~F.coalesce(F.col("mode").isin("additive", "overlapping", "quarantined"), F.lit(False)), F.lit("mode")),
        F.when(F.col("decided_on").isNull(), F.lit("date")), F.when(F.coalesce(F.trim("evidence"), F.lit("")) == "", F.lit("evidence")),
    )
    return decisions.withColumn("errors", F.array_compact(errors)).where(F.size("errors") > 0)


def append_history(ledger: DataFrame, incoming: DataFrame) -> DataFrame:
    """Ledger (key, tokens, calls, history) after forward versions; a version known from history is a replay.

    ``history``: array of struct(tokens, calls), oldest first.
    """
    new = incoming.select("key", F.col("tokens").alias("t"), F.col("calls").alias("c"))
    rows = ledger.join(new, "key", "left")
    version = lambda t, c: F.struct(F.col(t).alias("tokens"), F.col(c).alias("calls"))
    known = F.exists("history", lambda h: (h["tokens"] == F.col("t")) & h["calls"].eqNullSafe(F.col("c")))
    same = (F.col("t") == F.col("tokens")) & F.col("c").eqNullSafe(F.col("calls"))
    forward = F.coalesce((F.col("t") >= F.col("tokens")) & (F.col("c") >= F.col("calls")) & ~same & ~known, F.lit(False))
    return rows.select("key", F.when(forward, F.col("t")).otherwise(F.col("tokens")).alias("tokens"), F.when(forward, F.col("c")).otherwise(F.col("calls")).alias("calls"), F.when(forward, F.array_append("history", version("tokens", "calls"))).otherwise(F.col("history")).alias("history"), forward.alias("updated"))


def check_retirements(retired: DataFrame, active: DataFrame) -> DataFrame:
    """Retired entries (id, superseded_by) that do not have exactly one active accepted replacement."""
    found = active.groupBy(F.col("id").alias("superseded_by")).agg(F.count("*").alias("n"))
    return retired.join(found, "superseded_by", "left").where(F.coalesce("n", F.lit(0)) != 1).select("id", "superseded_by")


def corrected(outcomes: DataFrame, correctable: Column, reason: str | None, confirmed: bool) -> DataFrame:
    """Outcomes after a recorded correction: correctable errors become updates and keep the reason."""
    opened = F.lit(bool(reason and confirmed)) & (F.col("outcome") == "error") & correctable
    return outcomes.withColumn("correction", F.when(opened, reason)).withColumn("outcome", F.when(opened, "updated").otherwise(F.col("outcome")))


def message_receipts(messages: DataFrame, *counters: str) -> DataFrame:
    """Daily receipts of messages that carry their own counters, the latest record of each message counting."""
    w = Window.partitionBy("source", "message_id").orderBy(F.desc("ts"), *[F.desc(c) for c in counters])
    last = messages.withColumn("_n", F.row_number().over(w)).where("_n = 1")
    tokens = F.lit(0).cast("bigint")
    for c in counters:
        tokens = tokens + F.coalesce(c, F.lit(0))
    return last.groupBy(F.col("ts").cast("date").alias("day"), "source").agg(F.sum(tokens).alias("tokens"), F.count("*").alias("calls")).where(F.col("tokens").between(1, SAFE))


def interval_position(first: Column, last: Column, start: Column, end: Column) -> tuple[Column, Column]:
    """Where an interval begins inside a window and which share it takes, both clipped to 0 to 1."""
    days = (F.datediff(end, start) + 1).cast("double")
    lo, hi = F.greatest(first, start), F.least(last, end)
    return F.when(lo <= hi, F.datediff(lo, start) / days), F.when(lo <= hi, (F.datediff(hi, lo) + 1) / days)


def evidence_text(driver: Column, method: Column, signals: Column, families: dict[str, str], labels: dict[str, str]) -> Column:
    """A controlled sentence from a label, its method and its signals; null for an unknown label."""
    table = lambda d: F.create_map(*[F.lit(x) for kv in d.items() for x in kv])
    named = F.array_compact(F.transform(F.array_distinct(signals), lambda s: table(labels)[s]))
    basis = F.when(F.size(named) > 0, F.array_join(named, " and ")).otherwise("classified metadata")
    family = table(families)[driver]
    told = F.concat(F.lit("Automated classification: "), basis, F.lit(" supported "), family)
    return F.when(method == "unresolved", "No classified signal was available for this day").when(method == "source_derived", F.concat(F.lit("Source composition establishes "), family)).otherwise(told)
