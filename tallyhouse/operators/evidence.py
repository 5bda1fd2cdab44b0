"""Accepted evidence with version histories, and the acceptance of receipts against it.

A receipt: receipt_id, snapshot_key, day, source, the five scope fields, authority, fidelity, tokens, calls, coverage,
coverage_reasons and token_components. Its request identities stand in a side table (receipt_id, key), so that no row
ever gathers them; a row has only ``n_keys`` and ``key_set``, a digest that does not depend on order. A ledger entry has
the same columns, named by entry_id, with acceptance (``accepted``; anything else is an unverified legacy entry),
acceptance_basis, disposition, superseded_by, correction and history, the versions that went before.

A version is what a measurement says: tokens, calls, identities, coverage and components. Prior versions are exploded
into an index of (entry, digest of the version), which incoming receipts meet by an equi-join.

Order never matters: a receipt that meets several entries is an error, where a first-come rule would take the first.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyhouse.functions.usage import authority_rank
from tallyhouse.operators.acceptance import active
from tallyhouse.operators.contracts import COMPONENTS
from tallyhouse.operators.ledger import counter_relation
from tallyhouse.operators.scopes import same_scope_day, wildcard_matches
from tallyhouse.sources.scratch import stored

#: Fields of a receipt's scope; a missing one agrees with anything.
SCOPE = ("provider", "surface", "account_alias", "origin", "machine_alias")
PARTS = "struct<" + ",".join(f"{c}:bigint" for c in COMPONENTS) + ">"
VERSION = f"struct<tokens:bigint,calls:bigint,n_keys:bigint,key_set:string,coverage:string,coverage_reasons:array<string>,token_components:{PARTS}>"
#: Columns of a receipt beside its id, with their types.
FIELDS = {
    "snapshot_key": "string", "day": "date", "source": "string", **dict.fromkeys(SCOPE, "string"), "authority": "string", "fidelity": "string", "tokens": "bigint", "calls": "bigint",
    "coverage": "string", "coverage_reasons": "array<string>", "token_components": PARTS, "n_keys": "bigint", "key_set": "string",
}
STATE = {"acceptance": "string", "acceptance_basis": "string", "disposition": "string", "superseded_by": "string", "correction": "string", "history": f"array<{VERSION}>"}
LEDGER_SCHEMA = ", ".join(f"{n} {t}" for n, t in {"entry_id": "string", **FIELDS, **STATE}.items())
IDENTITY_SCHEMA = "entry_id string, key string"

# On what an accepted entry rests.
MATCHED, MIGRATED, REVIEWED = "matched-final-dataset", "matched-final-dataset-after-legacy-migration", "identity-free-correction-after-review"


def identities_of(receipts: DataFrame, keys: str = "keys", name: str = "receipt_id") -> DataFrame:
    """The side table (receipt_id, key) of an array column of identities, each once."""
    return receipts.select(name, F.explode(keys).alias("key")).where("key is not null").distinct()


def with_key_sets(receipts: DataFrame, identities: DataFrame, name: str = "receipt_id") -> DataFrame:
    """``receipts`` with n_keys (0: none) and key_set (null: none), from the side table.

    The digest is the exclusive-or of two 64-bit hashes of each identity, with their number: it is summed up before the
    shuffle, and no group is gathered.
    """
    each = identities.select(name, "key").distinct().groupBy(name).agg(F.count("*").alias("n_keys"), F.bit_xor(F.xxhash64("key")).alias("_a"), F.bit_xor(F.xxhash64(F.lit("second"), "key")).alias("_b"))
    sets = each.select(name, "n_keys", F.concat_ws("-", "n_keys", F.hex("_a"), F.hex("_b")).alias("key_set"))
    return receipts.drop("n_keys", "key_set").join(sets, name, "left").withColumn("n_keys", F.coalesce("n_keys", F.lit(0)))


def normalized(receipts: DataFrame) -> DataFrame:
    """Receipts with every column of a receipt, absent ones null; coverage reasons as a set, no empty components."""
    have = set(receipts.columns)
    rows = receipts.select("receipt_id", *[(F.col(c) if c in have else F.lit(None)).cast(t).alias(c) for c, t in FIELDS.items()])
    told = F.coalesce(*[F.col(f"token_components.{c}") for c in COMPONENTS])
    reasons = F.array_sort(F.array_distinct("coverage_reasons"))
    return rows.withColumns({"token_components": F.when(told.isNotNull(), F.col("token_components")), "coverage_reasons": F.when(F.size(reasons) > 0, reasons)})


def version_of(at: str = "") -> Column:
    """The version struct of a row, or of the struct named ``at``."""
    of = lambda c: F.col(f"{at}.{c}" if at else c)
    return F.struct(*[of(c).alias(c) for c in ("tokens", "calls", "n_keys", "key_set", "coverage", "coverage_reasons", "token_components")]).cast(VERSION)


def version_id(version: Column) -> Column:
    """Digest of a version; versions with equal digests say the same."""
    return F.sha2(F.to_json(version, {"ignoreNullFields": "false"}), 256)


def merged_components(left: Column, right: Column) -> tuple[Column, Column]:
    """Components of two equal measurements: each from whichever side has it; and whether any differ."""
    clash = F.lit(False)
    for c in COMPONENTS:
        clash = clash | F.coalesce(left[c] != right[c], F.lit(False))
    both = F.struct(*[F.coalesce(left[c], right[c]).alias(c) for c in COMPONENTS])
    return F.when(left.isNotNull() | right.isNotNull(), both), clash


def merged_coverage(left: Column, right: Column, left_reasons: Column, right_reasons: Column) -> tuple[Column, Column]:
    """Coverage is incomplete if either side is; its reasons are united."""
    none = F.array().cast("array<string>")
    reasons = F.array_sort(F.array_union(F.coalesce(left_reasons, none), F.coalesce(right_reasons, none)))
    incomplete = F.coalesce(left == "incomplete", F.lit(False)) | F.coalesce(right == "incomplete", F.lit(False))
    return F.when(incomplete, "incomplete"), F.when(incomplete & (F.size(reasons) > 0), reasons)


@dataclass(frozen=True)
class Batch:
    """Receipts that go on, their identities, and (receipt_id, why) of those that may not."""

    receipts: DataFrame
    identities: DataFrame
    errors: DataFrame


def reconcile_batch(receipts: DataFrame, identities: DataFrame) -> Batch:
    """One receipt a snapshot, and one a set of identities: a batch held against itself.

    Of a snapshot's versions the one with most tokens and calls goes on, under the least id of its equals. Errors:
    conflict (versions of several days, sources, scopes or fidelities), crossing (none has most of both), component
    (equal versions tell a component differently), identity_loss (the version lacks an identity of another, or its
    equals have other sets). Of receipts with equal sets in one day, provider and account the strongest authority goes
    on. Errors: partial (sets that share only some), cross_date, cross_scope, equal_authority.
    """
    rows = stored(with_key_sets(normalized(receipts), identities), "batch")
    ids = identities.select("receipt_id", "key").distinct()
    calls = F.coalesce("calls", F.lit(0))
    snaps = rows.where("snapshot_key is not null").withColumn("_calls", calls)
    parts = [F.col(f"token_components.{c}") for c in COMPONENTS]
    clash = F.lit(False)
    for p in parts:
        clash = clash | F.coalesce(F.min(p) != F.max(p), F.lit(False))
    merged = F.struct(*[F.max(p).alias(c) for c, p in zip(COMPONENTS, parts, strict=True)])
    same = F.lit(True)
    whole = ("day", "source", "fidelity", *SCOPE)
    for c in whole:
        same = same & F.coalesce(F.min(c) == F.max(c), F.lit(True)) & F.count(c).isin(F.lit(0), F.count(F.lit(1)))
    equals = snaps.groupBy("snapshot_key", "tokens", "_calls").agg(
        F.min("receipt_id").alias("receipt_id"), merged.alias("_parts"), clash.alias("_clash"), F.max("coverage").alias("_coverage"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("coverage_reasons")))).alias("_reasons"),
        F.count_distinct(F.coalesce("key_set", F.lit(""))).alias("_sets"),
    )
    heads = snaps.groupBy("snapshot_key").agg(F.max(F.struct("tokens", "_calls")).alias("top"), F.max("_calls").alias("most"), (~same).alias("conflict"))
    clashes = equals.groupBy("snapshot_key").agg(F.bool_or("_clash").alias("component"))
    all_keys = ids.join(snaps.select("receipt_id", "snapshot_key"), "receipt_id").select("snapshot_key", "key").distinct().groupBy("snapshot_key").agg(F.count("*").alias("all_keys"))
    top = equals.join(heads, "snapshot_key").where((F.col("tokens") == F.col("top.tokens")) & (F.col("_calls") == F.col("top._calls"))).join(clashes, "snapshot_key").join(all_keys, "snapshot_key", "left")
    top = top.join(rows.select("receipt_id", "n_keys"), "receipt_id")
    wrong = (("component", F.col("component")), ("conflict", F.col("conflict")), ("crossing", F.col("most") > F.col("_calls")), ("identity_loss", (F.coalesce("all_keys", F.lit(0)) > F.col("n_keys")) | (F.col("_sets") > 1)))
    top = stored(top.withColumn("why", F.array_join(F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in wrong])), ",")), "batch")
    good = top.where("why = ''").select("receipt_id", F.lit(True).alias("_head"), "_parts", "_coverage", "_reasons")
    kept = rows.join(good, "receipt_id", "left").where("snapshot_key is null or _head")
    told = F.coalesce(*[F.col(f"_parts.{c}") for c in COMPONENTS])
    pick = lambda new, old: F.when(F.col("_head"), new).otherwise(F.col(old))
    kept = kept.withColumns({"token_components": pick(F.when(told.isNotNull(), F.col("_parts")), "token_components").cast(PARTS), "coverage": pick(F.col("_coverage"), "coverage"), "coverage_reasons": pick(F.when(F.size("_reasons") > 0, F.col("_reasons")), "coverage_reasons")})
    kept = stored(kept.select(*rows.columns), "batch")
    rank = authority_rank(F.col("authority"))
    sets = kept.where("n_keys > 0").groupBy("key_set").agg(
        F.count("*").alias("n"), (F.min("day") != F.max("day")).alias("cross_date"), F.count_distinct(F.coalesce(rank, F.lit(0))).alias("ranks"), F.max(F.coalesce(rank, F.lit(0))).alias("strongest"),
        ((F.count("provider") < F.count("*")) | (F.count("account_alias") < F.count("*")) | (F.min("provider") != F.max("provider")) | (F.min("account_alias") != F.max("account_alias"))).alias("elsewhere"),
    )
    used = ids.join(kept.where("n_keys > 0").select("receipt_id", "key_set"), "receipt_id")
    shared = used.groupBy("key").agg(F.min("key_set").alias("a"), F.max("key_set").alias("b")).where("a <> b")
    partial = used.join(shared.select("key"), "key", "left_semi").select("key_set").distinct().withColumn("partial", F.lit(True))
    judged = sets.join(partial, "key_set", "left")
    several = F.col("n") > 1
    found = (("cross_date", several & F.col("cross_date")), ("cross_scope", several & ~F.col("cross_date") & F.coalesce("elsewhere", F.lit(True))), ("equal_authority", several & ~F.col("cross_date") & ~F.coalesce("elsewhere", F.lit(True)) & (F.col("ranks") < F.col("n"))), ("partial", F.coalesce("partial", F.lit(False))))
    judged = judged.select("key_set", "strongest", F.array_join(F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in found])), ",").alias("why"))
    out = stored(kept.join(judged, "key_set", "left").withColumn("_rank", F.coalesce(rank, F.lit(0))), "batch")
    goes_on = out.where("why is null or (why = '' and _rank = strongest)").select(*rows.columns)
    errors = top.where("why <> ''").select("receipt_id", "why").unionByName(out.where("why <> ''").select("receipt_id", "why"))
    return Batch(goes_on, ids.join(goes_on.select("receipt_id"), "receipt_id", "left_semi"), errors)


def prior_versions(ledger: DataFrame) -> DataFrame:
    """The index of prior versions: (entry_id, version), each once."""
    return ledger.select("entry_id", F.explode("history").alias("v")).select("entry_id", version_id(F.col("v")).alias("version")).distinct()


def evidence_pairs(ledger: DataFrame, ledger_ids: DataFrame, incoming: DataFrame, incoming_ids: DataFrame) -> DataFrame:
    """(receipt_id, entry_id, snap, overlap): entries of a receipt's snapshot, or that share identities, and how many.

    In a sound ledger an identity belongs to one active entry, so this is some rows a receipt, not pairs of everything.
    """
    snap = incoming.where("snapshot_key is not null").select("receipt_id", "snapshot_key").join(ledger.select("entry_id", "snapshot_key"), "snapshot_key").select("receipt_id", "entry_id", F.lit(True).alias("snap"), F.lit(0).cast("bigint").alias("overlap"))
    asked = incoming_ids.join(incoming.select("receipt_id"), "receipt_id", "left_semi").select("receipt_id", "key")
    known = ledger_ids.join(ledger.select("entry_id"), "entry_id", "left_semi").select("entry_id", "key")
    keys = asked.join(known, "key").groupBy("receipt_id", "entry_id").agg(F.lit(False).alias("snap"), F.count("*").alias("overlap"))
    return snap.unionByName(keys).groupBy("receipt_id", "entry_id").agg(F.bool_or("snap").alias("snap"), F.sum("overlap").alias("overlap"))


def _facts(pairs: DataFrame, ledger: DataFrame, incoming: DataFrame) -> DataFrame:
    """Each pair with what the rules ask: i (the receipt), e (the entry), and conditions on both."""
    side = lambda df, name, key: df.select(key, F.struct(*[F.col(c) for c in df.columns if c != key]).alias(name))
    rows = pairs.join(side(incoming, "i", "receipt_id"), "receipt_id").join(side(ledger, "e", "entry_id"), "entry_id")
    i, e = F.col("i"), F.col("e")
    same_set = i["key_set"].eqNullSafe(e["key_set"])
    counters = (i["tokens"] == e["tokens"]) & i["calls"].eqNullSafe(e["calls"]) & same_set
    parts, clash = merged_components(e["token_components"], i["token_components"])
    coverage, reasons = merged_coverage(e["coverage"], i["coverage"], e["coverage_reasons"], i["coverage_reasons"])
    rows = rows.withColumns({
        "scope": same_scope_day("i", "e", SCOPE), "same_set": same_set, "counters": counters, "clash": counters & clash, "lost": F.col("overlap") < e["n_keys"],
        "one_scope": (i["day"].eqNullSafe(e["day"])) & (F.coalesce((i["provider"] == e["provider"]) & (i["account_alias"] == e["account_alias"]), F.lit(False))
            | (F.coalesce(i["provider"], e["provider"], i["account_alias"], e["account_alias"]).isNull() & i["source"].eqNullSafe(e["source"]) & i["origin"].eqNullSafe(e["origin"]))),
        "relation": F.when(e["calls"].isNull() | i["calls"].isNull(), counter_relation(e["tokens"], F.lit(0), i["tokens"], F.lit(0))).otherwise(counter_relation(e["tokens"], e["calls"], i["tokens"], i["calls"])),
        "stronger": F.coalesce(authority_rank(i["authority"]), F.lit(0)) - F.coalesce(authority_rank(e["authority"]), F.lit(0)),
        "_parts": F.when(counters, parts).otherwise(i["token_components"]).cast(PARTS), "_coverage": F.when(counters, coverage).otherwise(i["coverage"]), "_reasons": F.when(counters, reasons).otherwise(i["coverage_reasons"]),
    })
    merged = F.struct(i["tokens"], i["calls"], i["n_keys"], i["key_set"], F.col("_coverage"), F.col("_reasons"), F.col("_parts")).cast(VERSION)
    # raw: as it came; told: after what an equal measurement adds
    rows = rows.withColumns({"now": version_id(version_of("e")), "raw": version_id(version_of("i")), "told": version_id(merged)})
    prior = prior_versions(ledger.select("entry_id", "history")).withColumnRenamed("version", "told").withColumn("_prior", F.lit(True))
    return rows.join(prior, ["entry_id", "told"], "left").withColumn("prior", F.coalesce("_prior", F.lit(False))).drop("_prior")


def accept_evidence(ledger: DataFrame, ledger_ids: DataFrame, incoming: DataFrame, incoming_ids: DataFrame, exact: DataFrame, corrections: DataFrame | None = None) -> DataFrame:
    """(receipt_id, outcome, why, entry_id, change, new_id): added, updated, promoted, replay or error for each receipt.

    ``incoming`` is a batch that went through reconcile_batch; ``exact`` (day, source): committed entries with exact
    figures. change, for what is not a replay or an error: new, forward (the old version goes into the history),
    detail (equal counters, more components or coverage), promote (a legacy entry is accepted), supersede (a new entry
    that retires entry_id); weaker marks a replay of what stronger evidence tells. new_id names an added entry: its receipt_id, with a number
    if the ledger has used that name. ``corrections`` (receipt_id, reason): reviewed receipts.

    A receipt of an accepted snapshot: snapshot_scope, component and foreign_identity are errors; equal counters with
    more detail update; a version that is current or was before is a replay; crossing and identity_loss are errors unless
    reviewed; anything lower is a replay; else it moves forward. Otherwise, identities of an accepted entry: an equal
    set in one scope is a replay if it is weaker, or as strong and equal, an error if it is as strong and differs
    (equal_authority), and supersedes the entry if it is stronger, unless that lowers an exact figure (decrease);
    others are errors (cross_scope, partial). Otherwise a legacy entry of its snapshot or identities: an error in another scope
    (legacy_scope), or if its identities are not kept or its counters do not simply grow (legacy_ambiguous) unless reviewed;
    else it is promoted. A receipt with neither snapshot nor identities meets the entry of its day, source
    and scope that has neither: a replay if equal, updated with more detail, else an error (uncheckable) unless reviewed;
    an equal legacy one is promoted. More entries than one are an error (several_entries).
    """
    live = stored(active(ledger), "evidence")
    free = F.col("snapshot_key").isNull() & (F.col("n_keys") == 0)
    on, bare = ("day", "source"), live.where(free)
    asked = incoming.where(free)
    accepted = F.coalesce(F.col("acceptance") == "accepted", F.lit(False))
    plain = wildcard_matches(asked, bare.where(accepted), on, SCOPE, "entry_id", ("receipt_id",)).select("receipt_id", F.col("_first").alias("entry_id"), F.col("_n").alias("b_n"))
    # of the legacy ones only an equal version counts, so the version is part of the key
    versioned = lambda df: df.withColumn("version", version_id(version_of()))
    old = wildcard_matches(versioned(asked), versioned(bare.where(~accepted)), (*on, "version"), SCOPE, "entry_id", ("receipt_id",)).select("receipt_id", F.col("_first").alias("g_entry"))
    pairs = evidence_pairs(live, ledger_ids, incoming, incoming_ids).withColumn("b_n", F.lit(None).cast("bigint"))
    pairs = pairs.unionByName(plain.select("receipt_id", "entry_id", F.lit(False).alias("snap"), F.lit(0).cast("bigint").alias("overlap"), "b_n"))
    facts = stored(_facts(pairs, live, incoming), "evidence")
    ok = F.coalesce(F.col("e.acceptance") == "accepted", F.lit(False))
    lowers = (F.col("i.tokens") < F.col("e.tokens")) | (F.col("e.calls").isNotNull() & (F.col("i.calls").isNull() | (F.col("i.calls") < F.col("e.calls")))) | (F.col("i.fidelity") != "exact")
    kind = F.when(F.col("b_n").isNotNull(), "b").when(ok & F.col("snap"), "s").when(ok, "k").otherwise("l")
    slim = facts.select("receipt_id", "entry_id", kind.alias("kind"), "b_n", F.col("e.day").alias("day"), F.col("e.source").alias("source"), F.struct("entry_id", "scope", "one_scope", "same_set", "counters", "clash", "lost", "relation", "stronger", "prior", (F.col("now") == F.col("told")).alias("equal"), (F.col("now") == F.col("raw")).alias("equal_raw"), F.coalesce(lowers, F.lit(False)).alias("lowers")).alias("f"))
    pinned = exact.select("day", "source").distinct().withColumn("pinned", F.lit(True))
    slim = slim.join(pinned, ["day", "source"], "left")
    one = lambda k: F.max(F.when(F.col("kind") == k, F.struct("f", F.coalesce("pinned", F.lit(False)).alias("pinned")))).alias(k)
    n = lambda k: F.count_if(F.col("kind") == k).alias(f"n_{k}")
    foreign = F.coalesce(F.bool_or((F.col("kind") == "k") & ~(F.col("f.scope") & F.col("f.same_set"))), F.lit(False))
    met = slim.groupBy("receipt_id").agg(*[one(k) for k in "sklb"], *[n(k) for k in "skl"], F.max("b_n").alias("n_b"), foreign.alias("foreign"))
    rows = incoming.select("receipt_id").join(met, "receipt_id", "left").join(old, "receipt_id", "left")
    if corrections is not None:
        fixed = corrections.where("trim(reason) <> ''").select("receipt_id").distinct().withColumn("fixed", F.lit(True))
        rows = rows.join(fixed, "receipt_id", "left").withColumn("fixed", F.coalesce("fixed", F.lit(False)))
    else:
        rows = rows.withColumn("fixed", F.lit(False))
    s, k, l, b = (F.col(f"{x}.f") for x in "sklb")  # noqa: E741
    fixed, has_s, has_k, has_l, has_b = F.col("fixed"), F.col("s").isNotNull(), F.col("k").isNotNull(), F.col("l").isNotNull(), F.col("b").isNotNull()
    murky = l["lost"] | (l["relation"] == "crossing") | ((l["relation"] == "replay") & ~l["equal_raw"])
    equal_known = has_k & k["same_set"] & k["one_scope"]
    steps = (
        (F.col("n_s") > 1, "error", "several_entries", ""),
        (has_s & ~s["scope"], "error", "snapshot_scope", ""),
        (has_s & s["clash"], "error", "component", ""),
        (has_s & F.col("foreign"), "error", "foreign_identity", ""),
        (has_s & s["counters"] & ~s["equal"], "updated", "", "detail"),
        (has_s & ~fixed & (s["equal"] | s["prior"]), "replay", "", ""),
        (has_s & ~fixed & (s["relation"] == "crossing"), "error", "crossing", ""),
        (has_s & ~fixed & (s["relation"] == "replay"), "replay", "", ""),
        (has_s & ~fixed & s["lost"], "error", "identity_loss", ""),
        (has_s, "updated", "", "forward"),
        (F.col("n_k") > 1, "error", "several_entries", ""),
        (equal_known & (k["stronger"] < 0), "replay", "", "weaker"),
        (equal_known & (k["stronger"] == 0) & k["scope"] & k["equal_raw"], "replay", "", ""),
        (equal_known & (k["stronger"] == 0), "error", "equal_authority", ""),
        (equal_known & F.col("k.pinned") & k["lowers"] & ~fixed, "error", "decrease", ""),
        (equal_known, "added", "", "supersede"),
        (has_k & ~k["scope"], "error", "cross_scope", ""),
        (has_k, "error", "partial", ""),
        (F.col("n_l") > 1, "error", "several_entries", ""),
        (has_l & ~l["scope"], "error", "legacy_scope", ""),
        (has_l & murky & ~fixed, "error", "legacy_ambiguous", ""),
        (has_l, "promoted", "", "promote"),
        (F.col("n_b") > 1, "error", "several_entries", ""),
        (has_b & b["clash"], "error", "component", ""),
        (has_b & b["counters"] & ~b["equal"], "updated", "", "detail"),
        (has_b & b["counters"], "replay", "", ""),
        (has_b & ~fixed, "error", "uncheckable", ""),
        (has_b, "updated", "", "forward"),
        (F.col("g_entry").isNotNull(), "promoted", "", "promote"),
    )
    verdict = F.struct(F.lit("added").alias("outcome"), F.lit("").alias("why"), F.lit("new").alias("change"))
    for condition, outcome, why, change in reversed(steps):
        verdict = F.when(F.coalesce(condition, F.lit(False)), F.struct(F.lit(outcome).alias("outcome"), F.lit(why).alias("why"), F.lit(change).alias("change"))).otherwise(verdict)
    entry = F.when(F.col("v.change") != "new", F.coalesce(s["entry_id"], k["entry_id"], l["entry_id"], b["entry_id"], F.col("g_entry")))
    used = ledger.groupBy(F.regexp_replace("entry_id", "#[0-9]+$", "").alias("receipt_id")).agg(F.count("*").alias("_used"))
    name = F.when(F.col("_used").isNull(), F.col("receipt_id")).otherwise(F.concat_ws("#", "receipt_id", "_used"))
    rows = rows.join(used, "receipt_id", "left").withColumn("v", verdict)
    return rows.select("receipt_id", "v.outcome", "v.why", entry.alias("entry_id"), "v.change", F.when(F.col("v.outcome") == "added", name).alias("new_id"))


def entry_conflicts(outcomes: DataFrame) -> DataFrame:
    """(receipt_id, why): receipts of one batch that would change the same entry, by any route; none of them may."""
    changing = outcomes.where("change not in ('', 'new', 'weaker') and entry_id is not null")
    again = changing.groupBy("entry_id").agg(F.count("*").alias("n")).where("n > 1")
    return changing.join(again.select("entry_id"), "entry_id", "left_semi").select("receipt_id", F.lit("contested_entry").alias("why"))


def apply_outcomes(ledger: DataFrame, ledger_ids: DataFrame, incoming: DataFrame, incoming_ids: DataFrame, outcomes: DataFrame, corrections: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(ledger, identities) after the outcomes; errors and replays change nothing.

    A forward move appends the old version to the history and unites the identities; detail and promotion keep the
    history; a new entry is named new_id, and what it supersedes is retired under that name.
    """
    reasons = corrections.where("trim(reason) <> ''").groupBy("receipt_id").agg(F.max(F.trim("reason")).alias("_reason")) if corrections is not None else None
    changed = outcomes.where("change in ('forward', 'detail', 'promote')").select("receipt_id", "entry_id", "change")
    changed = changed.join(reasons, "receipt_id", "left") if reasons is not None else changed.withColumn("_reason", F.lit(None).cast("string"))
    news = changed.join(incoming.select("receipt_id", F.struct(*FIELDS).alias("i")), "receipt_id").drop("receipt_id")
    gone = outcomes.where("change = 'supersede'").select("entry_id", F.col("new_id").alias("_by"))
    rows = ledger.join(news, "entry_id", "left").join(gone, "entry_id", "left")
    is_change, is_detail, forward = F.col("change").isNotNull(), F.coalesce(F.col("change") == "detail", F.lit(False)), F.coalesce(F.col("change") == "forward", F.lit(False))
    old, i = F.struct(*[F.col(c).alias(c) for c in FIELDS]), F.col("i")
    parts, _ = merged_components(F.col("token_components"), i["token_components"])
    coverage, reasons_of = merged_coverage(F.col("coverage"), i["coverage"], F.col("coverage_reasons"), i["coverage_reasons"])
    special = {"token_components": parts, "coverage": coverage, "coverage_reasons": reasons_of}
    bare = F.col("snapshot_key").isNull() & (F.col("n_keys") == 0)
    none = F.array().cast(f"array<{VERSION}>")
    basis = F.when(is_detail, F.coalesce("acceptance_basis", F.lit(MATCHED))).when(F.col("change") == "promote", MIGRATED).when(bare, REVIEWED).otherwise(MATCHED)
    # a gap that was known once is not closed by a receipt that says nothing of it
    new_of = lambda c: F.coalesce(i[c], F.col(c)) if c in ("coverage", "coverage_reasons") else i[c]
    out = {c: F.when(is_detail & F.lit(c in special), special.get(c, i[c])).when(is_change, new_of(c)).otherwise(F.col(c)).cast(t) for c, t in FIELDS.items()}
    state = {
        "acceptance": F.when(is_change, "accepted").otherwise(F.col("acceptance")), "acceptance_basis": F.when(is_change, basis).otherwise(F.col("acceptance_basis")),
        "disposition": F.when(F.col("_by").isNotNull(), "superseded").otherwise(F.col("disposition")), "superseded_by": F.coalesce("_by", "superseded_by"), "correction": F.when(is_change & ~is_detail, F.coalesce("_reason", "correction")).otherwise(F.col("correction")),
        "history": F.when(forward, F.concat(F.coalesce("history", none), F.array(version_of("o")))).otherwise(F.col("history")),
    }
    kept = rows.withColumn("o", old).select("entry_id", *[v.alias(c) for c, v in {**out, **state}.items()])
    added = outcomes.where("outcome = 'added'").select("receipt_id", "new_id").join(incoming, "receipt_id")
    added = added.join(reasons, "receipt_id", "left") if reasons is not None else added.withColumn("_reason", F.lit(None).cast("string"))
    fresh = {"acceptance": F.lit("accepted"), "acceptance_basis": F.lit(MATCHED), "disposition": F.lit(None), "superseded_by": F.lit(None), "correction": F.col("_reason"), "history": none}
    added = added.select(F.col("new_id").alias("entry_id"), *FIELDS, *[fresh[c].cast(t).alias(c) for c, t in STATE.items()])
    moved = changed.select("receipt_id", "entry_id").unionByName(outcomes.where("outcome = 'added'").select("receipt_id", F.col("new_id").alias("entry_id")))
    ids = stored(ledger_ids.select("entry_id", "key").unionByName(incoming_ids.join(moved, "receipt_id").select("entry_id", "key")).distinct(), "evidence")
    return with_key_sets(kept.unionByName(added), ids, "entry_id").select("entry_id", *FIELDS, *STATE), ids


def check_evidence(ledger: DataFrame, ledger_ids: DataFrame, incoming: DataFrame, incoming_ids: DataFrame) -> DataFrame:
    """(receipt_id, class, n): what each receipt is against the whole ledger, retired entries too; n hits of a class.

    uncheckable (neither snapshot nor identities), new, counted, legacy_hit (unverified), older_version (a prior one,
    recorded), evolved (forward), variant (an older one, unrecorded), and conflict_scope, conflict_identities,
    conflict_crossing, conflict_partial. A recorded older version counts as a hit of its entry beside its own class.
    """
    facts = _facts(evidence_pairs(ledger, ledger_ids, incoming, incoming_ids), ledger, incoming)
    ok = F.coalesce(F.col("e.acceptance") == "accepted", F.lit(False))
    hit = F.when(ok, "counted").otherwise("legacy_hit")
    replaced = F.col("same_set") & F.col("one_scope") & (F.col("stronger") != 0)
    prior = F.col("prior_raw")
    index = prior_versions(ledger.select("entry_id", "history")).withColumnRenamed("version", "raw").withColumn("prior_raw", F.lit(True))
    facts = facts.join(index, ["entry_id", "raw"], "left").withColumn("prior_raw", F.coalesce("prior_raw", F.lit(False)))
    equal = F.col("now") == F.col("raw")
    snap = F.when(~F.col("scope"), F.array(F.lit("conflict_scope"))).when(equal, F.array(hit)).when(prior, F.array(F.lit("older_version"), hit)).when(F.col("lost"), F.array(F.lit("conflict_identities")))
    snap = snap.when(F.col("relation") == "forward", F.array(F.lit("evolved"))).when(F.col("relation") == "crossing", F.array(F.lit("conflict_crossing"))).otherwise(F.array(F.lit("variant")))
    other = F.when(replaced, F.array(hit)).when(~F.col("scope"), F.array(F.lit("conflict_scope"))).when(~F.col("same_set"), F.array(F.lit("conflict_partial"))).otherwise(F.array(hit))
    found = facts.select("receipt_id", F.explode(F.when(F.col("snap"), snap).otherwise(other)).alias("class")).groupBy("receipt_id", "class").agg(F.count("*").alias("n"))
    lone = incoming.join(facts.select("receipt_id").distinct(), "receipt_id", "left_anti")
    free = F.col("snapshot_key").isNull() & (F.col("n_keys") == 0)
    return found.unionByName(lone.select("receipt_id", F.when(free, "uncheckable").otherwise("new").alias("class"), F.lit(1).cast("bigint").alias("n")))

