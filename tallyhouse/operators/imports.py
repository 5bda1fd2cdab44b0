"""Whole daily entries, and the import of receipts into a dataset and its ledger as one plan.

A daily entry: day, source, timezone, driver, evidence (the day's, repeated on its entries), tokens, calls, fidelity,
authority, coverage, coverage_reasons, token_components and by_origin (map). What some contributor does not tell stays
absent in the sum: components field by field, authority as a whole, origins as a whole when an entry is rebuilt.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyhouse.functions.usage import sum_if_complete, weakest_authority
from tallyhouse.operators import evidence as ev
from tallyhouse.operators import ledger as rules
from tallyhouse.operators.acceptance import active
from tallyhouse.operators.contracts import COMPONENTS, SCHEMA_VERSION, blank, dataset_errors, receipt_errors
from tallyhouse.operators.evidence import PARTS
from tallyhouse.sources.scratch import stored

KEY = ["day", "source"]
DAILY = {
    "day": "date", "source": "string", "timezone": "string", "driver": "string", "evidence": "string", "tokens": "bigint", "calls": "bigint", "fidelity": "string", "authority": "string",
    "coverage": "string", "coverage_reasons": "array<string>", "token_components": PARTS, "by_origin": "map<string,bigint>",
}
DAILY_SCHEMA = ", ".join(f"{n} {t}" for n, t in DAILY.items())
_OWN = [c for c in DAILY if c not in (*KEY, "timezone", "driver", "evidence")]


def whole_entries(receipts: DataFrame, every_origin: bool = False) -> DataFrame:
    """One entry per (day, source) with everything that its receipts tell: sums, weakest labels, united reasons.

    calls are summed where reported; a component only if all have it; coverage is incomplete if any part is. Tokens by
    origin leave receipts without one out, or, with ``every_origin``, are absent unless all have one.
    """
    parts = [sum_if_complete(F.col(f"token_components.{c}")).alias(c) for c in COMPONENTS]
    reasons = F.array_sort(F.array_distinct(F.flatten(F.collect_set("coverage_reasons"))))
    sums = receipts.groupBy(*KEY).agg(
        F.sum("tokens").alias("tokens"), F.sum("calls").alias("calls"), F.when(F.bool_or(F.col("fidelity") == "estimated"), "estimated").otherwise("exact").alias("fidelity"), weakest_authority(F.col("authority")).alias("authority"),
        F.max(F.when(F.col("coverage") == "incomplete", F.col("coverage"))).alias("coverage"), reasons.alias("_reasons"), F.struct(*parts).alias("_parts"), (F.count("origin") == F.count("*")).alias("_all"),
    )
    origins = receipts.where("origin is not null").groupBy(*KEY, "origin").agg(F.sum("tokens").alias("t"))
    origins = origins.groupBy(*KEY).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("origin", "t")))).alias("_origins"))
    rows = sums.join(origins, KEY, "left")
    told = F.coalesce(*[F.col(f"_parts.{c}") for c in COMPONENTS])
    by_origin = F.when(F.col("_all") | F.lit(not every_origin), F.col("_origins"))
    cols = {"coverage_reasons": F.when(F.col("coverage").isNotNull() & (F.size("_reasons") > 0), F.col("_reasons")), "token_components": F.when(told.isNotNull(), F.col("_parts")), "by_origin": by_origin}
    return rows.select(*KEY, *[cols.get(c, F.col(c)).cast(DAILY[c]).alias(c) for c in _OWN])


def _text(parts: Column) -> Column:
    return F.to_json(parts, {"ignoreNullFields": "false"})


def _origin_text(origins: Column) -> Column:
    return F.to_json(F.array_sort(F.map_entries(origins)))


def entry_differences(ledger: DataFrame, daily: DataFrame) -> DataFrame:
    """(day, source, why): where active evidence and the dataset do not say the same.

    why: ledger (only there), dataset (only there), or the first of tokens, calls, token_components, origin_missing
    (the entry names origins, but not all of its evidence does) and by_origin that differs; absent is a value.
    """
    said = whole_entries(active(ledger), every_origin=True).select(*KEY, F.struct(*_OWN).alias("l"))
    rows = said.join(daily.select(*KEY, F.struct(*_OWN).alias("d")), KEY, "full_outer")
    l, d = F.col("l"), F.col("d")  # noqa: E741
    steps = (
        (d.isNull(), "ledger"), (l.isNull(), "dataset"), (~l["tokens"].eqNullSafe(d["tokens"]), "tokens"), (~l["calls"].eqNullSafe(d["calls"]), "calls"),
        (~_text(l["token_components"]).eqNullSafe(_text(d["token_components"])), "token_components"), (d["by_origin"].isNotNull() & l["by_origin"].isNull(), "origin_missing"),
        (d["by_origin"].isNotNull() & ~_origin_text(l["by_origin"]).eqNullSafe(_origin_text(d["by_origin"])), "by_origin"),
    )
    why = F.lit(None).cast("string")
    for condition, name in reversed(steps):
        why = F.when(condition, name).otherwise(why)
    return rows.select(*KEY, why.alias("why")).where("why is not null")


def rebuild_whole(daily: DataFrame, ledger: DataFrame, pairs: DataFrame) -> DataFrame:
    """``daily`` with the entries of ``pairs`` (day, source) built again from active evidence.

    Tokens, calls, coverage, components, authority and origins follow the evidence; fidelity and what belongs to the day
    stay. An entry without evidence goes.
    """
    hit = pairs.select(*KEY).distinct()
    fresh = whole_entries(active(ledger).join(hit, KEY, "left_semi"), every_origin=True)
    old = daily.join(hit, KEY, "left_semi").select(*KEY, "timezone", "driver", "evidence", "fidelity")
    return daily.join(hit, KEY, "left_anti").unionByName(fresh.drop("fidelity").join(old, KEY).select(*DAILY))


def merge_entries(daily: DataFrame, entries: DataFrame, drivers: DataFrame, timezone: str, evidence: str = "imported from local receipts; pending review") -> DataFrame:
    """``daily`` with ``entries`` in place of those of the same (day, source).

    A new day takes the first label of ``drivers`` (day, driver), else ``unreviewed``; on a known day the placeholders
    of fidelity ``sample`` go.
    """
    whole = lambda c: F.max(c).alias(c)
    known = daily.groupBy("day").agg(whole("timezone"), whole("driver"), whole("evidence"), F.lit(True).alias("_known"))
    first = drivers.where("driver is not null").groupBy("day").agg(F.min("driver").alias("_label"))
    rows = entries.join(known, "day", "left").join(first, "day", "left")
    old = F.col("_known").isNotNull()
    of_day = {"timezone": F.when(old, F.col("timezone")).otherwise(timezone), "driver": F.when(old, F.col("driver")).otherwise(F.coalesce("_label", F.lit("unreviewed"))), "evidence": F.when(old, F.col("evidence")).otherwise(evidence)}
    new = rows.withColumns(of_day).select(*DAILY)
    touched = entries.select("day").distinct().withColumn("_touched", F.lit(True))
    kept = daily.join(entries.select(*KEY), KEY, "left_anti").join(touched, "day", "left").where("_touched is null or fidelity <> 'sample'").select(*DAILY)
    return kept.unionByName(new)


def split_exclusions(daily: DataFrame, exclusions: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(daily without excluded entries, excluded (day, source), errors (day, source, why)).

    An exclusion names exact tokens and calls (null: none reported). One without an entry does nothing; one whose entry
    says otherwise is ``exclusion_mismatch``; one pair given twice is ``exclusion_repeated``.
    """
    named = exclusions.groupBy(*KEY).agg(F.count("*").alias("_n"), F.min("tokens").alias("_t"), F.min("calls").alias("_c"))
    met = daily.select(*KEY, "tokens", "calls").join(named, KEY)
    same = F.col("tokens").eqNullSafe(F.col("_t")) & F.col("calls").eqNullSafe(F.col("_c"))
    gone = met.where((F.col("_n") == 1) & same).select(*KEY)
    errors = met.where((F.col("_n") == 1) & ~same).select(*KEY, F.lit("exclusion_mismatch").alias("why")).unionByName(named.where("_n > 1").select(*KEY, F.lit("exclusion_repeated").alias("why")))
    return daily.join(gone, KEY, "left_anti"), gone, errors


def receipt_faults(receipts: DataFrame, identities: DataFrame, timezone: str) -> DataFrame:
    """(receipt_id, why): broken rules of the whole receipt contract, joined by commas; valid receipts are left out."""
    rows = receipt_errors(receipts.withColumn("correlation_keys", F.lit(None).cast("array<string>")))
    bad_key = identities.where(~F.col("key").rlike("^sha256:[a-f0-9]{64}$")).select("receipt_id").distinct().withColumn("_key", F.lit(True))
    twice = receipts.groupBy("receipt_id").agg((F.count("*") > 1).alias("_twice"))
    rows = rows.join(bad_key, "receipt_id", "left").join(twice, "receipt_id", "left")
    more = (
        ("correlation_keys_form", F.col("_key") & (F.col("schema_version") == SCHEMA_VERSION)), ("date", F.col("day").isNull()), ("fidelity", ~F.coalesce(F.col("fidelity").isin("exact", "estimated"), F.lit(False))), ("receipt_id", F.col("receipt_id").isNull() | F.col("_twice")),
        ("origin_form", ~F.col("origin").rlike("^[a-z0-9][a-z0-9._/-]*$")), ("source", blank(F.col("source")) | ~F.col("source").rlike("^[a-z0-9_]+$")), ("timezone", ~F.col("timezone").eqNullSafe(F.lit(timezone))),
    )
    every = F.array_sort(F.concat("errors", F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in more]))))
    return rows.select("receipt_id", F.array_join(every, ",").alias("why")).where("why <> ''").distinct()


@dataclass(frozen=True)
class Policy:
    """timezone; window_start, as_of: first and current day; weekly: whole weeks are imported, else whole days; horizon:
    days after which a day is final (null: never)."""

    as_of: str
    window_start: str
    timezone: str = "UTC"
    weekly: bool = True
    horizon: int | None = None


@dataclass(frozen=True)
class Import:
    """outcomes of the receipts, the new ledger, its identities and the new daily entries, states of receipts that were
    set aside (held, final, settled), and all errors (receipt_id, day, source, step, why). It counts only without errors."""

    outcomes: DataFrame
    ledger: DataFrame
    identities: DataFrame
    daily: DataFrame
    aside: DataFrame
    errors: DataFrame


_ERROR = (("receipt_id", "string"), ("day", "date"), ("source", "string"))


def plan_import(receipts: DataFrame, identities: DataFrame, ledger: DataFrame, ledger_ids: DataFrame, daily: DataFrame, policy: Policy, settled: DataFrame | None = None, exclusions: DataFrame | None = None, corrections: DataFrame | None = None) -> Import:
    """The whole import: contract, batch, cut-off, settled pairs, horizon, acceptance, daily entries, exclusions, no
    decrease, the dataset's contract, and the ledger against the dataset. Nothing is written but tables in scratch space.

    Receipts have the columns of the contract and driver. Every step reports all it finds; what cannot go on is left out of
    later steps. ``settled`` and ``exclusions``: day, source, tokens, calls; ``corrections``: receipt_id, reason.
    A (day, source) that receives receipts has as many tokens afterwards as these say, so a partial batch is a decrease.
    """
    spark = receipts.sparkSession
    errors: list[DataFrame] = []

    def report(df: DataFrame, step: str, why: Column | str = "why") -> None:
        cols = [(F.col(c) if c in df.columns else F.lit(None)).cast(t).alias(c) for c, t in _ERROR]
        errors.append(df.select(*cols, F.lit(step).alias("step"), (F.col(why) if isinstance(why, str) else why).alias("why")))

    none = spark.createDataFrame([], "day date, source string, tokens bigint, calls bigint")
    settled, exclusions = settled if settled is not None else none, exclusions if exclusions is not None else none
    receipts, identities = stored(receipts, "import"), stored(identities.select("receipt_id", "key"), "import")
    faults = stored(receipt_faults(receipts, identities, policy.timezone), "import")
    report(faults.join(receipts.select("receipt_id", *KEY), "receipt_id", "left"), "contract")
    valid = receipts.join(faults.select("receipt_id"), "receipt_id", "left_anti").where("receipt_id is not null")
    drivers = valid.select("receipt_id", "day", (F.col("driver") if "driver" in valid.columns else F.lit(None).cast("string")).alias("driver"))
    batch = ev.reconcile_batch(valid, identities)
    report(batch.errors.join(valid.select("receipt_id", *KEY), "receipt_id"), "batch")
    dated = rules.partition_complete(batch.receipts, policy.as_of, policy.window_start, policy.weekly)
    report(dated.where("state = 'error'"), "window", F.lit("date"))
    origins = daily.select(*KEY, F.explode(F.map_keys("by_origin")).alias("origin"))
    split = rules.split_settled(dated.where("state = 'kept'").drop("state"), settled, origins)
    report(rules.check_settled(daily, settled), "settled_before")
    report(split.where("state = 'foreign_origin'"), "settled", F.col("state"))
    report(rules.policy_overlap(settled, exclusions), "policy", F.lit("settled_and_excluded"))
    rows = split.where("state = 'kept'").drop("state")
    final = F.lit(False) if policy.horizon is None else F.col("day") < F.date_sub(F.lit(policy.as_of).cast("date"), policy.horizon)
    aside = dated.where("state = 'held'").select("receipt_id", "state").unionByName(split.where("state = 'dropped'").select("receipt_id", F.lit("settled").alias("state"))).unionByName(rows.where(final).select("receipt_id", F.lit("final").alias("state")))
    rows = stored(rows.where(~final), "import")
    ids = stored(batch.identities.join(rows.select("receipt_id"), "receipt_id", "left_semi"), "import")
    exact = daily.where("fidelity = 'exact'").select(*KEY)
    outcomes = stored(ev.accept_evidence(ledger, ledger_ids, rows, ids, exact, corrections), "import")
    contested = ev.entry_conflicts(outcomes)
    refused = stored(outcomes.where("outcome = 'error'").select("receipt_id", "why").unionByName(contested), "import")
    report(rows.join(refused, "receipt_id"), "accept")
    fine = stored(outcomes.join(refused.select("receipt_id"), "receipt_id", "left_anti"), "import")
    after, after_ids = ev.apply_outcomes(ledger, ledger_ids, rows, ids, fine, corrections)
    after = stored(after, "import")
    # entries that lost evidence to a stronger receipt: what they said has to be what the dataset says
    lost = stored(ledger.join(fine.where("change = 'supersede'").select("entry_id"), "entry_id", "left_semi").select(*KEY).distinct(), "import")
    report(entry_differences(ledger.join(lost, KEY, "left_semi"), daily.join(lost, KEY, "left_semi")), "transition")
    by_excluded = rows.join(fine.where("change = 'supersede'").select("receipt_id"), "receipt_id", "left_semi").join(exclusions.select(*KEY).distinct(), KEY, "left_semi")
    report(by_excluded, "transition", F.lit("excluded_authority"))
    remaining = after.join(fine.where("outcome = 'added'").select(F.col("new_id").alias("entry_id")), "entry_id", "left_anti")
    adjusted = rebuild_whole(daily, remaining, lost)
    # weaker receipts of known identities say nothing; equal measurements say what the entry has gathered
    used = fine.where("change <> 'weaker'").select("receipt_id", "entry_id", "new_id")
    kept = F.coalesce("new_id", "entry_id")
    told = after.select(F.col("entry_id").alias("_kept"), F.struct("tokens", "calls", "coverage", "coverage_reasons", "token_components").alias("a"))
    rich = rows.join(used.select("receipt_id", kept.alias("_kept")), "receipt_id").join(told, "_kept", "left")
    equal = F.coalesce(F.col("a.tokens") == F.col("tokens"), F.lit(False)) & F.col("a.calls").eqNullSafe(F.col("calls"))
    rich = rich.withColumns({c: F.when(equal, F.col(f"a.{c}")).otherwise(F.col(c)) for c in ("coverage", "coverage_reasons", "token_components")})
    entries = stored(whole_entries(rich), "import")
    merged = stored(merge_entries(adjusted, entries, drivers.join(rich.select("receipt_id"), "receipt_id", "left_semi"), policy.timezone), "import")
    result, gone, wrong = split_exclusions(merged, exclusions)
    result, gone = stored(result, "import"), stored(gone, "import")
    report(wrong, "exclusion")
    reviewed = rows.join(corrections.where("trim(reason) <> ''").select("receipt_id").distinct(), "receipt_id", "left_semi").select(*KEY).distinct() if corrections is not None else none.select(*KEY)
    exempt = gone.unionByName(lost).unionByName(reviewed)
    report(rules.exact_decreases(daily.join(exempt, KEY, "left_anti"), result), "decrease")
    report(rules.check_settled(result, settled), "settled_after")
    totals = result.groupBy("day").agg(F.sum("tokens").alias("total"))
    report(dataset_errors(result.join(totals, "day"), policy.timezone, policy.window_start, policy.as_of).withColumnRenamed("rule", "why"), "dataset")
    after = after.join(gone.withColumn("_gone", F.lit(True)), KEY, "left").withColumn("disposition", F.when(F.col("_gone"), "excluded").otherwise(F.col("disposition"))).select("entry_id", *ev.FIELDS, *ev.STATE)
    # a reviewed pair counts only what its receipts touched
    touched = fine.where("entry_id is not null or outcome = 'added'").select(kept.alias("entry_id")).distinct().withColumn("_touched", F.lit(True))
    out = after.join(reviewed.withColumn("_reviewed", F.lit(True)), KEY, "left").join(touched, "entry_id", "left")
    differs = entry_differences(after, result).select(*KEY, F.lit(True).alias("_differs"))
    out = out.join(differs, KEY, "left").withColumn("disposition", F.when(F.col("_reviewed") & F.col("_differs") & F.col("_touched").isNull() & F.col("disposition").isNull(), "corrected-out").otherwise(F.col("disposition")))
    after = stored(out.select("entry_id", *ev.FIELDS, *ev.STATE), "import")
    mine = entries.select(*KEY).join(gone, KEY, "left_anti")
    report(entry_differences(after.join(mine, KEY, "left_semi"), result.join(mine, KEY, "left_semi")).where("why in ('ledger', 'dataset', 'tokens', 'calls', 'token_components')"), "ledger")
    every = errors[0]
    for e in errors[1:]:
        every = every.unionByName(e)
    return Import(outcomes, after, after_ids, result, stored(aside, "import"), stored(every, "import"))
