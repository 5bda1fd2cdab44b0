"""Reconciliation and acceptance of receipts that carry many request identities.

A receipt: receipt_id, snapshot_key (may be null), day, source, scope, authority, fidelity, tokens, calls,
``keys`` (array of request identities, may be null or empty). A ledger entry has the same columns and a
``disposition`` (null while it counts). Key sets are compared as sets, by one digest a receipt; receipts
that share some identities meet on the identity, and no pairs of receipts are formed.

Order never matters: where a first-come rule would depend on it, every receipt concerned gets the error.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyhouse.functions.usage import authority_rank
from tallyhouse.operators import daily as entries_of
from tallyhouse.operators.ledger import counter_relation, exact_decreases, ledger_matches
from tallyhouse.sources.scratch import stored

#: Dispositions of entries that no longer count.
RETIRED = ("excluded", "corrected-out", "superseded")


def key_set(keys: Column) -> Column:
    """The identities in order, each once; none for null."""
    return F.array_sort(F.array_distinct(F.coalesce(keys, F.array().cast("array<string>"))))


def same_key_set(left: Column, right: Column) -> Column:
    """True if both hold the same identities, whatever their order and repeats."""
    return key_set(left) == key_set(right)


def active(ledger: DataFrame) -> DataFrame:
    """Entries that count: not excluded, corrected out or superseded."""
    return ledger.where(F.col("disposition").isNull() | ~F.col("disposition").isin(*RETIRED))


def set_disposition(ledger: DataFrame, decided: DataFrame) -> DataFrame:
    """Ledger with the dispositions of ``decided`` (receipt_id, disposition); an unknown name is refused as null."""
    known = decided.where(F.col("disposition").isin(*RETIRED)).groupBy("receipt_id").agg(F.max("disposition").alias("_new"))
    return ledger.join(known, "receipt_id", "left").withColumn("disposition", F.coalesce("_new", "disposition")).drop("_new")


def with_set_id(receipts: DataFrame) -> DataFrame:
    """Add ``keys`` as a set and ``set_id``, a digest of it; null without identities."""
    rows = receipts.withColumn("keys", key_set(F.col("keys")))
    return rows.withColumn("set_id", F.when(F.size("keys") > 0, F.sha2(F.to_json("keys"), 256)))


def resolve_identities(receipts: DataFrame) -> DataFrame:
    """(receipt_id, state, errors): what sharing identities with other receipts does to each.

    state: free (no identities), kept, dropped (a stronger receipt has the same set in the same scope and
    day) or error. errors, sorted and joined by commas: partial (another set shares an identity),
    cross_date and cross_scope (the same set elsewhere), equal_authority (the same set at equal rank).
    """
    rows = with_set_id(receipts).withColumn("rank", authority_rank(F.col("authority")))
    sets = rows.where("set_id is not null").groupBy("set_id").agg(
        F.count("*").alias("n"), F.min("day").alias("d0"), F.max("day").alias("d1"), F.min("scope").alias("s0"), F.max("scope").alias("s1"),
        F.count_distinct("rank").alias("ranks"), F.max("rank").alias("top"), F.first("keys").alias("keys"),
    )
    shared = sets.select("set_id", F.explode("keys").alias("key")).groupBy("key").agg(F.min("set_id").alias("lo"), F.max("set_id").alias("hi")).where("lo <> hi").select("key")
    partial = sets.select("set_id", F.explode("keys").alias("key")).join(shared, "key", "left_semi").select("set_id").distinct().withColumn("_partial", F.lit(True))
    judged = sets.join(partial, "set_id", "left")
    cross_date, cross_scope = F.col("d0") != F.col("d1"), F.col("s0") != F.col("s1")
    equal = ~cross_date & ~cross_scope & (F.col("ranks") < F.col("n"))
    found = F.array(*[F.when(c, F.lit(name)) for name, c in (("cross_date", cross_date), ("cross_scope", cross_scope), ("equal_authority", equal), ("partial", F.col("_partial")))])
    judged = judged.select("set_id", "top", F.array_join(F.array_compact(found), ",").alias("errors"))
    out = rows.join(judged, "set_id", "left")
    state = F.when(F.col("set_id").isNull(), "free").when(F.col("errors") != "", "error").when(F.col("rank") < F.col("top"), "dropped").otherwise("kept")
    return out.select("receipt_id", state.alias("state"), F.coalesce("errors", F.lit("")).alias("errors"))


def reconcile_snapshots(receipts: DataFrame, identity: tuple[str, ...] = ("day", "source", "scope", "fidelity"), components: tuple[str, ...] = ()) -> DataFrame:
    """One row a snapshot_key: the version that dominates, merged with its equals, and what is wrong.

    Versions with equal counters are one measurement: identities and coverage_reasons are united, each
    component is taken from whichever version has it, and differing values are an error. errors, sorted and
    joined by commas: component, conflict (versions of different days, sources, scopes or fidelities),
    crossing (no version dominates all), identity_loss (the kept version lacks an identity of another).
    """
    rows = receipts.where("snapshot_key is not null").withColumn("keys", key_set(F.col("keys")))
    reasons = "coverage_reasons" in rows.columns
    same = F.lit(True)
    for c in identity:
        same = same & F.coalesce(F.min(c) == F.max(c), F.lit(True)) & F.count(c).isin(F.lit(0), F.count(F.lit(1)))
    calls = F.coalesce("calls", F.lit(0))
    top = F.max(F.struct("tokens", calls.alias("calls")))
    heads = rows.groupBy("snapshot_key").agg(top.alias("top"), F.max(calls).alias("most_calls"), F.count("*").alias("versions"), (~same).alias("conflict"))
    # identities of every version, counted without gathering them
    ids = rows.select("snapshot_key", F.explode("keys").alias("key")).distinct().groupBy("snapshot_key").agg(F.count("*").alias("all_keys"))
    best = rows.join(heads.select("snapshot_key", "top"), "snapshot_key").where((F.col("tokens") == F.col("top.tokens")) & (calls == F.col("top.calls")))
    whole = [F.max(c).alias(c) for c in identity] + [F.max("authority").alias("authority"), F.max("calls").alias("calls"), F.max("tokens").alias("tokens"), key_set(F.flatten(F.collect_set("keys"))).alias("keys")]
    if reasons:
        whole.append(key_set(F.flatten(F.collect_set("coverage_reasons"))).alias("coverage_reasons"))
    clash = F.lit(False)
    for c in components:
        whole.append(F.max(c).alias(c))
        clash = clash | F.coalesce(F.min(c) != F.max(c), F.lit(False))
    merged = best.groupBy("snapshot_key").agg(*whole, clash.alias("component"))
    out = merged.join(heads, "snapshot_key").join(ids, "snapshot_key", "left")
    wrong = (("component", F.col("component")), ("conflict", F.col("conflict")), ("crossing", F.col("most_calls") > F.col("top.calls")), ("identity_loss", F.coalesce("all_keys", F.lit(0)) > F.size("keys")))
    errors = F.array_join(F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in wrong])), ",")
    return out.select("snapshot_key", *identity, "authority", "tokens", "calls", "keys", *(["coverage_reasons"] if reasons else []), *components, "versions", errors.alias("errors"))


def key_hits(ledger: DataFrame, incoming: DataFrame) -> DataFrame:
    """(receipt_id, hits, entry): the active entries of other snapshots that share an identity, and one of them."""
    held = with_set_id(active(ledger)).select("receipt_id", "snapshot_key", "keys", "set_id")
    known = held.select(F.col("receipt_id").alias("entry"), F.col("snapshot_key").alias("entry_snapshot"), F.explode("keys").alias("key"))
    asked = incoming.select("receipt_id", "snapshot_key", F.explode(key_set(F.col("keys"))).alias("key"))
    met = asked.join(known, "key").where(~F.coalesce(F.col("snapshot_key") == F.col("entry_snapshot"), F.lit(False)))
    # an identity belongs to one active entry in a sound ledger, so this is one row an identity, not a pair of receipts
    return met.groupBy("receipt_id").agg(F.count_distinct("entry").alias("hits"), F.min("entry").alias("entry"))


def accept_receipts(ledger: DataFrame, incoming: DataFrame, corrections: DataFrame | None = None) -> DataFrame:
    """(receipt_id, outcome, why, entry): added, updated, promoted, replay or error for each incoming receipt.

    ``entry`` is the ledger entry concerned. A known snapshot moves forward (updated), or repeats what is
    known (replay); it must keep its day, source, scope and identities, may not cross, and may share no identity with another
    entry of a different set or scope. An unknown one with the identities of one entry, as one equal set in
    the same day and scope, replaces it if its authority is higher (promoted) and does not lower an exact
    figure; a weaker one is a replay. A receipt without snapshot and identities is told from an equal entry of
    its scope and day only by its counters. ``corrections`` (receipt_id, reason): receipts whose decrease,
    crossing, loss of identities or changed counters were reviewed.
    """
    held = active(ledger)
    cols = ("receipt_id", "day", "source", "scope", "authority", "fidelity", "tokens", "calls", "keys")
    entry = lambda df, p: df.select(*[F.col(c).alias(f"{p}_{c}") for c in cols])
    rows = incoming
    if corrections is not None:
        rows = rows.join(corrections.where("trim(reason) <> ''").groupBy("receipt_id").agg(F.max("reason").alias("reason")), "receipt_id", "left")
    else:
        rows = rows.withColumn("reason", F.lit(None).cast("string"))
    by_snapshot = entry(held.where("snapshot_key is not null"), "s").join(held.select(F.col("receipt_id").alias("s_receipt_id"), F.col("snapshot_key")), "s_receipt_id")
    rows = rows.join(by_snapshot, "snapshot_key", "left").join(key_hits(ledger, incoming), "receipt_id", "left")
    rows = rows.join(entry(held, "k").withColumnRenamed("k_receipt_id", "entry"), "entry", "left")
    bare = held.where(F.col("snapshot_key").isNull() & (F.size(key_set(F.col("keys"))) == 0))
    bare = bare.groupBy(F.col("day").alias("b_day"), F.col("source").alias("b_source"), F.col("scope").alias("b_scope")).agg(F.min("receipt_id").alias("b_receipt_id"), F.sum("tokens").alias("b_tokens"), F.sum("calls").alias("b_calls"))
    free = F.col("snapshot_key").isNull() & (F.size(key_set(F.col("keys"))) == 0)
    rows = rows.join(bare, free & (F.col("day") == F.col("b_day")) & (F.col("source") == F.col("b_source")) & F.col("scope").eqNullSafe(F.col("b_scope")), "left")
    agrees = lambda p, *cs: _all(F.col(c).eqNullSafe(F.col(f"{p}_{c}")) for c in cs)
    reviewed = F.coalesce(F.trim("reason") != "", F.lit(False))
    known, hits = F.col("s_receipt_id").isNotNull(), F.coalesce("hits", F.lit(0))
    lost = F.size(F.array_except(key_set(F.col("s_keys")), key_set(F.col("keys")))) > 0
    zero = F.lit(0).cast("long")
    relation = F.when(F.col("s_calls").isNull() | F.col("calls").isNull(), counter_relation(F.col("s_tokens"), zero, F.col("tokens"), zero)).otherwise(counter_relation(F.col("s_tokens"), F.col("s_calls"), F.col("tokens"), F.col("calls")))
    equal_set = same_key_set(F.col("keys"), F.col("k_keys"))
    stronger = authority_rank(F.col("authority")) - authority_rank(F.col("k_authority"))
    lowers = (F.col("k_fidelity") == "exact") & ((F.col("tokens") < F.col("k_tokens")) | F.coalesce(F.col("k_calls").isNotNull() & (F.col("calls").isNull() | (F.col("calls") < F.col("k_calls"))), F.lit(False)) | (F.col("fidelity") != "exact"))
    steps = (
        (known & ~agrees("s", "day", "source", "scope"), "error", "snapshot_scope"),
        (known & (hits > 0) & ~(equal_set & agrees("k", "day", "scope")), "error", "foreign_identity"),
        (known & agrees("s", "tokens", "calls") & ~lost & ~reviewed, "replay", ""),
        (known & (relation == "crossing") & ~reviewed, "error", "crossing"),
        (known & (relation == "replay") & ~reviewed, "replay", ""),
        (known & lost & ~reviewed, "error", "identity_loss"),
        (known, "updated", ""),
        (hits > 1, "error", "several_entries"),
        ((hits == 1) & ~equal_set, "error", "partial"),
        ((hits == 1) & ~agrees("k", "day", "scope"), "error", "cross_scope"),
        ((hits == 1) & (stronger < 0), "replay", ""),
        ((hits == 1) & (stronger == 0) & agrees("k", "source", "tokens", "calls"), "replay", ""),
        ((hits == 1) & (stronger == 0), "error", "equal_authority"),
        ((hits == 1) & lowers & ~reviewed, "error", "decrease"),
        (hits == 1, "promoted", ""),
        (free & F.col("b_receipt_id").isNotNull() & agrees("b", "tokens", "calls"), "replay", ""),
        (free & F.col("b_receipt_id").isNotNull() & ~reviewed, "error", "uncheckable"),
        (free & F.col("b_receipt_id").isNotNull(), "updated", ""),
    )
    outcome, why = F.lit("added"), F.lit("")
    for condition, name, reason in reversed(steps):
        hit = F.coalesce(condition, F.lit(False))
        outcome, why = F.when(hit, name).otherwise(outcome), F.when(hit, reason).otherwise(why)
    concerned = F.when(outcome != "added", F.coalesce("s_receipt_id", "entry", "b_receipt_id"))
    return rows.select("receipt_id", outcome.alias("outcome"), why.alias("why"), concerned.alias("entry"))


def _all(conditions) -> Column:  # noqa: ANN001
    out = F.lit(True)
    for c in conditions:
        out = out & c
    return out


def retire(ledger: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Ledger in which the entries that promoted receipts replace are superseded, with the receipt that did it."""
    by = outcomes.where("outcome = 'promoted'").groupBy("entry").agg(F.min("receipt_id").alias("superseded_by")).withColumnRenamed("entry", "receipt_id")
    out = ledger.drop("superseded_by").join(by, "receipt_id", "left")
    return out.withColumn("disposition", F.when(F.col("superseded_by").isNotNull(), "superseded").otherwise(F.col("disposition")))


def rebuild_entries(before: DataFrame, after: DataFrame, daily: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Daily entries after a change of the ledger, and errors (day, source, why).

    ``before``, ``after``: the ledger; ``daily``: day, source, tokens, calls and more. Entries of a (day, source) that lost or
    changed evidence are built again from what is left, and vanish if nothing is; a changed entry whose
    old evidence did not match the dataset is an error. All other entries pass through.
    """
    sums = lambda df: active(df).groupBy("day", "source").agg(F.sum("tokens").alias("tokens"), F.sum("calls").alias("calls"))
    was, now = sums(before), sums(after)
    touched = was.exceptAll(now).select("day", "source").unionByName(now.exceptAll(was).select("day", "source")).distinct()
    errors = ledger_matches(was.join(touched, ["day", "source"], "left_semi"), daily.join(touched, ["day", "source"], "left_semi"))
    rebuilt = entries_of.aggregate_entries(active(after).join(touched, ["day", "source"], "left_semi")).select("day", "source", "tokens", "calls", "fidelity")
    kept = daily.join(touched, ["day", "source"], "left_anti")
    return kept.unionByName(rebuilt, allowMissingColumns=True), errors


@dataclass(frozen=True)
class ImportPlan:
    """What an import would do: outcome of each receipt, the new ledger and daily entries, and all errors.

    errors: (receipt_id, day, source, step, why). An import is written only if there are none.
    """

    outcomes: DataFrame
    ledger: DataFrame
    daily: DataFrame
    errors: DataFrame


def import_receipts(receipts: DataFrame, ledger: DataFrame, daily: DataFrame, as_of: str, window_start: str, settled: DataFrame | None = None, exclusions: DataFrame | None = None, horizon: int | None = None, corrections: DataFrame | None = None) -> ImportPlan:
    """The whole import as one plan: validation, cut-off, horizon, settled and excluded entries, snapshots, shared
    identities, acceptance, daily entries, and no decrease of an exact figure. The steps are tables in the shared
    folder; the dataset and the ledger are not touched. This is the short form, for receipts whose identities fit in an array
    and entries of tokens and calls; imports.plan_import is the whole one (histories, legacy entries, components, origins).

    ``receipts`` has the columns of this module and of validate_receipts, each receipt_id once.
    """
    from tallyhouse.operators import ledger as rules

    errors: list[DataFrame] = []

    def report(df: DataFrame, step: str, why: Column) -> None:
        errors.append(df.select(*[(F.col(c) if c in df.columns else F.lit(None)).cast(t).alias(c) for c, t in (("receipt_id", "string"), ("day", "date"), ("source", "string"))], F.lit(step).alias("step"), why.cast("string").alias("why")))

    judged = stored(rules.partition_complete(rules.validate_receipts(receipts), as_of, window_start), "import")
    report(judged.where("errors <> ''"), "validate", F.col("errors"))
    report(judged.where("errors = '' and state = 'error'"), "window", F.lit("date"))
    rows = judged.where("errors = '' and state = 'kept'").drop("errors", "state")
    if horizon is not None:
        rows = rules.after_horizon(rows, as_of, horizon)
    if settled is not None and exclusions is not None:
        report(rules.policy_overlap(settled, exclusions), "policy", F.lit("settled_and_excluded"))
    if settled is not None:
        report(rules.check_settled(daily, settled), "settled", F.col("why"))
        named = daily.select("day", "source", F.explode(F.map_keys("by_origin")).alias("origin")) if "by_origin" in daily.columns else daily.select("day", "source", F.lit(None).cast("string").alias("origin")).limit(0)
        split = rules.split_settled(rows, settled, named)
        report(split.where("state = 'foreign_origin'"), "settled", F.col("state"))
        rows = split.where("state = 'kept'").drop("state")
    rows = stored(rows, "import")
    snapshots = stored(reconcile_snapshots(rows), "import")
    report(snapshots.where("errors <> ''"), "snapshot", F.col("errors"))
    # of a snapshot's versions the one that dominates goes on; equal ones are one measurement, under the least id
    top = F.max(F.struct("tokens", F.coalesce("calls", F.lit(0)).alias("calls"))).alias("top")
    best = rows.where("snapshot_key is not null").groupBy("snapshot_key").agg(top)
    chosen = rows.join(best, "snapshot_key").where((F.col("tokens") == F.col("top.tokens")) & (F.coalesce("calls", F.lit(0)) == F.col("top.calls"))).groupBy("snapshot_key").agg(F.min("receipt_id").alias("receipt_id"))
    merged = chosen.join(snapshots.where("errors = ''").select("snapshot_key", F.col("keys").alias("_keys")), "snapshot_key")
    rows = rows.join(merged.select("receipt_id", "_keys"), "receipt_id", "left").where("snapshot_key is null or _keys is not null").withColumn("keys", F.coalesce("_keys", key_set(F.col("keys")))).drop("_keys")
    rows = stored(rows, "import")
    shared = stored(resolve_identities(rows), "import")
    report(rows.join(shared.where("state = 'error'").select("receipt_id", "errors"), "receipt_id"), "identity", F.col("errors"))
    rows = rows.join(shared.where("state in ('free', 'kept')").select("receipt_id"), "receipt_id", "left_semi")
    rows = stored(rows, "import")
    outcomes = stored(accept_receipts(ledger, rows, corrections), "import")
    report(rows.join(outcomes.where("outcome = 'error'").select("receipt_id", "why"), "receipt_id"), "accept", F.col("why"))
    retired = retire(ledger, outcomes)
    updated = outcomes.where("outcome = 'updated'").groupBy("entry").agg(F.min("receipt_id").alias("receipt_id"))
    stays = retired.join(updated.select(F.col("entry").alias("receipt_id")), "receipt_id", "left_anti")
    # an updated entry keeps its id, so that its history stays with it
    new = rows.join(outcomes.where("outcome in ('added', 'promoted')").select("receipt_id"), "receipt_id", "left_semi")
    newer = rows.join(updated, "receipt_id").drop("receipt_id").withColumnRenamed("entry", "receipt_id")
    accepted = new.unionByName(newer).withColumns({"disposition": F.lit(None).cast("string"), "superseded_by": F.lit(None).cast("string")})
    after = stored(stays.unionByName(accepted, allowMissingColumns=True).select(*stays.columns), "import")
    rebuilt, mismatches = rebuild_entries(ledger, after, daily)
    rebuilt = stored(rebuilt, "import")
    report(mismatches, "ledger", F.col("why"))
    gone = daily.select("day", "source").limit(0)
    if exclusions is not None:  # what is excluded is the merged entry, and only with the very figures that were named
        judged = stored(rules.apply_exclusions(rebuilt, exclusions), "import")
        report(judged.where("state = 'mismatch'"), "exclusion", F.col("state"))
        gone = judged.where("state = 'excluded'").select("day", "source")
        rebuilt = rebuilt.join(gone, ["day", "source"], "left_anti")
    # what a stronger receipt replaced was held against it by accept_receipts; nothing else may fall
    replaced = ledger.join(outcomes.where("outcome = 'promoted'").select(F.col("entry").alias("receipt_id")), "receipt_id", "left_semi").select("day", "source").distinct()
    lowered = exact_decreases(daily, rebuilt).join(replaced.unionByName(gone), ["day", "source"], "left_anti")
    if corrections is not None:
        fixed = after.join(corrections.select("receipt_id"), "receipt_id", "left_semi").select("day", "source").distinct()
        lowered = lowered.join(fixed, ["day", "source"], "left_anti")
    report(lowered, "decrease", F.col("why"))
    every = errors[0]
    for e in errors[1:]:
        every = every.unionByName(e)
    return ImportPlan(outcomes, after, rebuilt, stored(every, "import"))


def write_import(plan: ImportPlan, folder: str, dry_run: bool = False) -> str | None:
    """Write the plan's ledger and daily entries as one new version; nothing on a dry run. Errors refuse the write."""
    from tallyhouse.sources.logs import write_dataset

    found = plan.errors.limit(1).collect()
    if found:
        raise ValueError(f"import refused: {found[0]['step']} {found[0]['why']}")
    return None if dry_run else write_dataset(plan.daily, plan.ledger, folder)
