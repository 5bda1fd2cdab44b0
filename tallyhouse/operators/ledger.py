"""Reconciliation of receipts and the ledger of accepted evidence.

Order never matters here: any crossing pair of snapshots and any pair of equal authority is a conflict.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyhouse.functions.usage import authority_name, authority_rank, week_start
from tallyhouse.operators.scopes import wildcard_join
from tallyhouse.sources.scratch import shared_dir


def counter_relation(old_tokens: Column, old_calls: Column, tokens: Column, calls: Column) -> Column:
    """forward (nothing falls), replay (nothing rises) or crossing."""
    return F.when((tokens >= old_tokens) & (calls >= old_calls), "forward").when((tokens <= old_tokens) & (calls <= old_calls), "replay").otherwise("crossing")


def dominant_snapshot(versions: DataFrame) -> DataFrame:
    """(key, tokens, calls, versions, conflict): the largest version; crossing versions conflict.

    Versions cross if one has more tokens and fewer calls than another: fewer calls than the running
    maximum over strictly smaller tokens.
    """
    grouped = versions.groupBy("key", "tokens").agg(F.min("calls").alias("lo"), F.max("calls").alias("hi"), F.count("*").alias("n"))
    w = Window.partitionBy("key").orderBy("tokens").rowsBetween(Window.unboundedPreceding, -1)
    rows = grouped.withColumn("crosses", F.coalesce(F.col("lo") < F.max("hi").over(w), F.lit(False)))
    top = F.max(F.struct("tokens", "hi"))
    return rows.groupBy("key").agg(top.alias("top"), F.sum("n").alias("versions"), F.bool_or("crosses").alias("conflict")).select("key", F.col("top.tokens").alias("tokens"), F.col("top.hi").alias("calls"), "versions", "conflict")


def merge_equivalent(receipts: DataFrame, fields: tuple[str, ...] = ("source", "day")) -> DataFrame:
    """One row per (key, tokens, calls); a field with differing values is a conflict and left null."""
    same = lambda f: F.coalesce(F.min(f) == F.max(f), F.lit(True))
    aggs = [F.when(same(f), F.max(f)).alias(f) for f in fields]
    clash = F.lit(False)
    for f in fields:
        clash = clash | ~same(f)
    return receipts.groupBy("key", "tokens", "calls").agg(F.count("*").alias("merged"), *aggs, clash.alias("conflict"))


def identity_loss(receipts: DataFrame) -> DataFrame:
    """Per scope: identities of weaker receipts that the kept (strongest) one lacks. Rows: scope, authority, request_id."""
    ranked = receipts.withColumn("r", authority_rank(F.col("authority")))
    best = Window.partitionBy("scope")
    rows = ranked.withColumn("kept", F.col("r") == F.max("r").over(best))
    per_id = rows.groupBy("scope", "request_id").agg(F.bool_or("kept").alias("kept"))
    return per_id.groupBy("scope").agg(F.count("*").alias("identities"), F.count_if(~F.col("kept")).alias("lost"))


def identity_overlaps(keys: DataFrame) -> DataFrame:
    """Pairs of different receipts that share a request id, and whether their scopes agree. An equi-join on the id."""
    left = keys.select("request_id", F.col("source").alias("a"), F.col("scope").alias("scope_a"))
    right = keys.select("request_id", F.col("source").alias("b"), F.col("scope").alias("scope_b"))
    pairs = left.join(right, "request_id").where("a < b")
    kind = F.when(F.col("scope_a") == F.col("scope_b"), "identical").otherwise("cross_scope")
    return pairs.select("request_id", "a", "b", kind.alias("kind"))


def resolve_authority(keys: DataFrame) -> DataFrame:
    """(request_id, scope): the strongest authority wins; two receipts of that rank conflict."""
    ranked = keys.withColumn("r", authority_rank(F.col("authority")))
    per_rank = ranked.groupBy("request_id", "scope", "r").agg(F.count("*").alias("n"), F.min("source").alias("source"))
    top = per_rank.groupBy("request_id", "scope").agg(F.max(F.struct("r", "n", "source")).alias("t"), F.sum("n").alias("receipts"))
    return top.select("request_id", "scope", authority_name(F.col("t.r")).alias("authority"), F.col("t.source").alias("source"), "receipts", (F.col("t.n") > 1).alias("conflict"))


def check_against_ledger(ledger: DataFrame, incoming: DataFrame) -> DataFrame:
    """Class of each incoming receipt: uncheckable, new, counted, or conflict. Both: request_id, source, scope."""
    known = ledger.select("request_id", F.col("source").alias("ledger_source"), F.col("scope").alias("ledger_scope"))
    hits = incoming.join(known, "request_id", "left").groupBy("request_id", "source", "scope").agg(
        F.count("ledger_source").alias("hits"), F.coalesce(F.bool_and(F.col("ledger_scope") == F.col("scope")), F.lit(True)).alias("agrees"), F.coalesce(F.bool_or(F.col("ledger_source") == F.col("source")), F.lit(False)).alias("own"),
    )
    kind = F.when(F.col("request_id").isNull(), "uncheckable").when(F.col("hits") == 0, "new").when(~F.col("agrees"), "conflict").when(F.col("own"), "counted").otherwise("conflict")
    return hits.withColumn("class", kind).select("request_id", "source", "class", "hits")


def accept(ledger: DataFrame, incoming: DataFrame) -> DataFrame:
    """Outcome of each incoming (request_id, source, scope, authority): added, promoted, replay or error.

    Same scope: a weaker one than the ledger's is a replay, a stronger one is promoted, an equal rank is a
    replay from the same source and otherwise an error. Another scope: error.
    """
    best = ledger.withColumn("r", authority_rank(F.col("authority"))).groupBy("request_id").agg(F.max(F.struct("r", "source", "scope")).alias("l"))
    rows = incoming.withColumn("r", authority_rank(F.col("authority"))).join(best, "request_id", "left")
    held = F.col("l.r")
    outcome = F.when(held.isNull(), "added").when(F.col("l.scope") != F.col("scope"), "error").when(F.col("r") > held, "promoted").when(F.col("r") < held, "replay").when(F.col("l.source") == F.col("source"), "replay").otherwise("error")
    return rows.select("request_id", "source", outcome.alias("outcome"))


def plan_transitions(ledger: DataFrame, incoming: DataFrame) -> DataFrame:
    """Ledger entries that a stronger incoming receipt of the same id and scope retires, by (old, new) source."""
    outcomes = accept(ledger, incoming).where("outcome = 'promoted'").select("request_id", F.col("source").alias("new_source"))
    return ledger.select("request_id", F.col("source").alias("old_source")).join(outcomes, "request_id").groupBy("old_source", "new_source").agg(F.count("*").alias("retired"))


def combine_identity_free(receipts: DataFrame, scope: tuple[str, ...] = ("day", "source", "scope")) -> DataFrame:
    """Receipts without identities, merged by the columns of their scope before acceptance; null equals null."""
    return receipts.groupBy(*scope).agg(F.sum("tokens").alias("tokens"), F.sum("calls").alias("calls"), F.count("*").alias("merged"))


def ledger_matches(ledger: DataFrame, daily: DataFrame) -> DataFrame:
    """(day, source) pairs where both sides' tokens or calls differ, null-safe, with the side that lacks it."""
    left = ledger.select("day", "source", F.col("tokens").alias("lt"), F.col("calls").alias("lc"))
    right = daily.select("day", "source", F.col("tokens").alias("dt"), F.col("calls").alias("dc"))
    rows = left.join(right, ["day", "source"], "full_outer").where(~(F.col("lt").eqNullSafe(F.col("dt")) & F.col("lc").eqNullSafe(F.col("dc"))))
    why = F.when(F.col("lt").isNull(), "ledger").when(F.col("dt").isNull(), "dataset").otherwise("differ")
    return rows.select("day", "source", why.alias("why"))


def ledger_summary(ledger: DataFrame, active: Column) -> DataFrame:
    """Per source: entries, active ones, distinct identities and scopes."""
    return ledger.groupBy("source").agg(F.count("*").alias("entries"), F.count_if(active).alias("active"), F.count_distinct("request_id").alias("identities"), F.count_distinct("scope").alias("scopes"))


def drop_settled(receipts: DataFrame, settled: DataFrame) -> DataFrame:
    """Receipts whose (day, source) is not settled."""
    return receipts.join(settled.select("day", "source").distinct(), ["day", "source"], "left_anti")


def split_settled(receipts: DataFrame, settled: DataFrame, origins: DataFrame) -> DataFrame:
    """Receipts with state: kept (not settled), dropped (settled), or foreign_origin.

    ``origins`` (day, source, origin): the origins that committed entries name. A receipt of a settled pair from an
    origin that its entry does not have is new evidence and no repetition; an entry that names none is not judged.
    """
    key = ["day", "source"]
    pairs = settled.select(*key).distinct().withColumn("_settled", F.lit(True))
    named = origins.select(*key).distinct().withColumn("_named", F.lit(True))
    rows = receipts.join(pairs, key, "left").join(named, key, "left").join(origins.select(*key, "origin").distinct().withColumn("_own", F.lit(True)), [*key, "origin"], "left")
    state = F.when(F.col("_settled").isNull(), "kept").when(F.col("origin").isNotNull() & F.col("_named").isNotNull() & F.col("_own").isNull(), "foreign_origin").otherwise("dropped")
    return rows.withColumn("state", state).select(*receipts.columns, "state")


def check_settled(daily: DataFrame, settled: DataFrame) -> DataFrame:
    """Settled entries inside the covered dates that are missing, or whose tokens or calls changed (absent calls are a value)."""
    span = daily.agg(F.min("day").alias("first"), F.max("day").alias("last"))
    now = daily.select("day", "source", F.col("tokens").alias("t"), F.col("calls").alias("c"), F.lit(True).alias("there"))
    rows = settled.join(now, ["day", "source"], "left").crossJoin(F.broadcast(span)).where(F.col("day").between(F.col("first"), F.col("last")))
    changed = ~(F.col("tokens").eqNullSafe(F.col("t")) & F.col("calls").eqNullSafe(F.col("c")))
    return rows.where(F.col("there").isNull() | changed).select("day", "source", F.when(F.col("there").isNull(), "missing").otherwise("changed").alias("why"))


def apply_exclusions(daily: DataFrame, exclusions: DataFrame) -> DataFrame:
    """Entries and what an exclusion does to each: kept, excluded, or mismatch if its counters differ."""
    e = exclusions.select("day", "source", F.col("tokens").alias("et"), F.col("calls").alias("ec"), F.lit(True).alias("hit"))
    rows = daily.join(e, ["day", "source"], "left")
    same = F.col("tokens").eqNullSafe(F.col("et")) & F.col("calls").eqNullSafe(F.col("ec"))
    return rows.select("day", "source", F.when(F.col("hit").isNull(), "kept").when(same, "excluded").otherwise("mismatch").alias("state"))


def policy_overlap(settled: DataFrame, exclusions: DataFrame) -> DataFrame:
    """Pairs that are settled and excluded at once; each side is made distinct first, so that no pair meets its copies."""
    return settled.select("day", "source").distinct().intersect(exclusions.select("day", "source").distinct())


def same_scope_day(left: DataFrame, right: DataFrame, wild: tuple[str, ...]) -> DataFrame:
    """Pairs on (day, source) whose other fields agree, a null agreeing with anything; right's fields get the suffix _r."""
    renamed = right.select("day", "source", *wild, *[F.col(c).alias(f"{c}_r") for c in right.columns if c not in ("day", "source")])
    return wildcard_join(left, renamed, ("day", "source"), wild)


def exact_decreases(before: DataFrame, after: DataFrame) -> DataFrame:
    """Exact entries that vanish, lose fidelity, or fall in tokens or calls; the first reason counts."""
    a = after.select("day", "source", F.col("tokens").alias("t2"), F.col("calls").alias("c2"), F.col("fidelity").alias("f2"), F.lit(True).alias("there"))
    rows = before.where("fidelity = 'exact'").join(a, ["day", "source"], "left")
    why = F.when(F.col("there").isNull(), "disappeared").when(F.col("f2") != "exact", "fidelity").when(F.col("t2") < F.col("tokens"), "tokens").when(F.col("calls").isNotNull() & (F.col("c2").isNull() | (F.col("c2") < F.col("calls"))), "calls")
    return rows.select("day", "source", why.alias("why")).where("why is not null")


def reconcile_report(report: DataFrame, transcript: DataFrame) -> DataFrame:
    """Day by day: which side has it, and whether both are close (within 15 %)."""
    rows = report.select("day", F.col("tokens").alias("a")).join(transcript.select("day", F.col("tokens").alias("b")), "day", "full_outer")
    side = F.when(F.col("b").isNull(), "report").when(F.col("a").isNull(), "transcript").otherwise("both")
    close = F.abs(F.col("a") - F.col("b")) / F.nullif(F.greatest("a", "b"), F.lit(0)) <= 0.15
    return rows.groupBy(side.alias("side")).agg(F.count("*").alias("days"), F.count_if(F.coalesce(close, F.lit(False))).alias("close_days"), F.sum("a").alias("report_tokens"), F.sum("b").alias("transcript_tokens"))


def apply_quarantine(receipts: DataFrame, decisions: DataFrame) -> DataFrame:
    """Receipts admitted by an additive decision for their (source, account)."""
    return receipts.join(decisions.where("mode = 'additive'").select("source", "account").distinct(), ["source", "account"], "left_semi")


def dominates_legacy(new: DataFrame, old: DataFrame) -> DataFrame:
    """Per source: whether the new receipts reach the old ones' tokens and calls on every day."""
    n = new.select("day", "source", F.col("tokens").alias("t2"), F.col("calls").alias("c2"))
    rows = old.join(n, ["day", "source"], "left")
    ok = F.coalesce((F.col("t2") >= F.col("tokens")) & (F.col("calls").isNull() | (F.col("c2") >= F.col("calls"))), F.lit(False))
    return rows.groupBy("source").agg(F.bool_and(ok).alias("dominates"), F.count_if(~ok).alias("short_days"))


def partition_complete(receipts: DataFrame, as_of: str, window_start: str, weekly: bool = True) -> DataFrame:
    """Receipts with state kept, held (day or week still open) or error (future, or before the window)."""
    today, day = F.lit(as_of).cast("date"), F.col("day")
    cutoff = week_start(today) if weekly else today
    state = F.when((day > today) | (day < F.lit(window_start).cast("date")), "error").when(day < cutoff, "kept").otherwise("held")
    return receipts.withColumn("state", state)


def after_horizon(receipts: DataFrame, as_of: str, days: int) -> DataFrame:
    """Receipts that are not yet final; the condition is plain, so it reaches a partitioned scan."""
    return receipts.where(F.col("day") >= F.date_sub(F.lit(as_of).cast("date"), days))


def validate_receipts(receipts: DataFrame) -> DataFrame:
    """Broken rules of each receipt, sorted and joined by commas; empty if valid."""
    f = F.col
    rules = [
        ("authority", ~f("authority").isin("estimated", "reconstructed", "tool", "provider")), ("calls", f("calls") < 0), ("cached_over_input", f("cached_input_tokens") > f("input_tokens")),
        ("coverage", f("coverage").isNotNull() & (f("coverage") != "incomplete")), ("estimate_with_provider", (f("fidelity") == "estimated") & (f("authority") == "provider")), ("no_origin", f("origin").isNull()),
        ("tokens", (f("tokens") < 0) | (f("tokens") > 2**53 - 1)), ("zero_without_activity", (f("tokens") == 0) & ~F.coalesce(f("calls") > 0, F.lit(False))),
    ]
    errors = F.array_compact(F.array(*[F.when(F.coalesce(bad, F.lit(False)), name) for name, bad in rules]))
    return receipts.withColumn("errors", F.array_join(errors, ","))


def component_errors(receipts: DataFrame) -> DataFrame:
    """Counts of component rules that are broken, by source."""
    f = F.col
    return receipts.groupBy("source").agg(F.count_if(f("cached_input_tokens") > f("input_tokens")).alias("cached_over_input"), F.count_if(f("input_tokens") + f("output_tokens") != f("tokens")).alias("parts_differ"), F.count_if(f("cached_input_tokens").isNull()).alias("absent"))


def limit_findings(errors: DataFrame, n: int, by: str, order: list[str]) -> DataFrame:
    """The first ``n`` findings of each group, with how many there are."""
    w = Window.partitionBy(by)
    rows = errors.withColumns({"place": F.row_number().over(w.orderBy(*order)), "total": F.count("*").over(w)})
    return rows.where(F.col("place") <= n)


def order_ledger(entries: DataFrame, by: list[str], place: str = "place") -> DataFrame:
    """All entries with their place (from 1) in the order of ``by``; ties are broken by an entry's canonical form.

    A sort by ranges and the sizes of the ranges before give the place; no task sees the whole table.
    """
    names = entries.columns
    form = F.to_json(F.struct(*sorted(names)), {"ignoreNullFields": "false"})
    keys = [*by, "_form"]
    dealt = entries.withColumn("_form", form).repartitionByRange(*keys).sortWithinPartitions(*keys)
    dealt = dealt.select(*names, F.spark_partition_id().alias("_part"), F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1).alias("_pos"))
    path = shared_dir(entries.sparkSession, "order")  # written, so that counts and places see the same ranges
    dealt.write.parquet(path)
    rows = entries.sparkSession.read.schema(dealt.schema).parquet(path)
    sizes = rows.groupBy("_part").agg(F.count("*").alias("_n"))
    before = sizes.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"))
    return rows.join(F.broadcast(before), "_part").select((F.col("_before") + F.col("_pos") + 1).alias(place), *names)
