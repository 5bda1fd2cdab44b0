"""Registered queries: receipts with many identities against each other and against the ledger."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyhouse.operators import acceptance as a
from tallyhouse.operators import contracts, daily, ledger
from tallyhouse.plans.usage_queries import RANK, add

EMPTY = "cast([] as varchar[])"
SETS = f""", c as (select *, {RANK} as r from claims), sets as (select keys, count(*) as n, min(day) as d0, max(day) as d1, min(scope) as s0, max(scope) as s1, count(distinct r) as ranks, max(r) as top from c where len(keys) > 0 group by 1),
    ex as (select keys, unnest(keys) as key from sets), part as (select distinct keys from ex where key in (select key from ex group by 1 having count(distinct keys) > 1)),
    j as (select s.keys, top, concat_ws(',', case when d0 <> d1 then 'cross_date' end, case when s0 <> s1 then 'cross_scope' end, case when d0 = d1 and s0 = s1 and ranks < n then 'equal_authority' end, case when p.keys is not null then 'partial' end) as errors from sets s left join part p on s.keys = p.keys),
    o as (select receipt_id, case when j.keys is null then 'free' when errors <> '' then 'error' when r < top then 'dropped' else 'kept' end as state, coalesce(errors, '') as errors from c left join j on c.keys = j.keys)"""
add("j5_identity_classes", ["claims"], SETS + " select receipt_id, state, errors from o")(a.resolve_identities)
add("r3_identity_sets", ["claims"], SETS.replace("from claims)", "from (select * exclude (keys), case when keys is not null then [keys[1] || ':' || day] end as keys from claims))") + " select state, errors, count(*) as n from o group by 1, 2")(
    lambda c: a.resolve_identities(c.withColumn("keys", F.when(F.col("keys").isNotNull(), F.array(F.concat_ws(":", F.get("keys", F.lit(0)), "day"))))).groupBy("state", "errors").agg(F.count("*").alias("n")))
add("u4_same_set", ["claims"], ", p as (select day, scope, max(case when source = 'view' then keys end) as l, max(case when source = 'click' then keys end) as r from claims where source in ('view', 'click') group by day, scope) select day, scope, coalesce(l, []) = coalesce(r, []) as same from p")(
    lambda c: (lambda p: p.select("day", "scope", a.same_key_set(F.concat("r", "r"), F.reverse("l")).alias("same")))(c.where("source in ('view', 'click')").groupBy("day", "scope").agg(*[F.coalesce(F.max(F.when(F.col("source") == s, F.col("keys"))), F.array().cast("array<string>")).alias(n) for s, n in (("view", "l"), ("click", "r"))])))
VERSIONS = ", v as (select concat(source, ':', scope, ':', day) as snapshot_key, * exclude (snapshot_key) from claims)"
ID = "coalesce(min({0}) <> max({0}), false) or count({0}) not in (0, count(*))"
SNAPS = VERSIONS + f""", h as (select snapshot_key, max(tokens) as tokens, arg_max(calls, tokens * 10000 + calls) as calls, max(calls) as most, count(*) as versions, {" or ".join(ID.format(x) for x in ("day", "source", "scope", "fidelity"))} as conflict from v group by 1),
    b as (select v.snapshot_key, max(v.day) as day, max(v.source) as source, max(v.authority) as authority, coalesce(list_sort(list_distinct(flatten(list(v.keys)))), {EMPTY}) as keys from v join h on v.snapshot_key = h.snapshot_key and v.tokens = h.tokens and v.calls = h.calls group by 1),
    i as (select snapshot_key, count(distinct key) as n from (select snapshot_key, unnest(keys) as key from v) group by 1)
    select h.snapshot_key, h.tokens, h.calls, len(b.keys) as n_keys, h.versions, concat_ws(',', case when conflict then 'conflict' end, case when most > h.calls then 'crossing' end, case when coalesce(i.n, 0) > len(b.keys) then 'identity_loss' end) as errors from h join b using (snapshot_key) left join i using (snapshot_key)"""
add("r1_r2_snapshots", ["claims"], SNAPS)(
    lambda c: a.reconcile_snapshots(c.withColumn("snapshot_key", F.concat_ws(":", "source", "scope", "day"))).select("snapshot_key", "tokens", "calls", F.size("keys").cast("bigint").alias("n_keys"), "versions", "errors"))
LEDGER = ", l as (select *, case when tokens % 13 = 0 then 'superseded' when tokens % 17 = 0 then 'reviewed' end as disposition from claims where source in ('view', 'click')), i as (select * exclude (tokens, snapshot_key, authority), tokens + tokens % 3 - 1 as tokens, case when tokens % 7 <> 0 then snapshot_key end as snapshot_key, case when tokens % 5 = 0 then 'provider' else authority end as authority from claims where source in ('click', 'signup', 'error')), act as (select * from l where disposition is null or disposition not in ('excluded', 'corrected-out', 'superseded'))"


def _sides(c):
    old = c.where("source in ('view', 'click')").withColumn("disposition", F.when(F.col("tokens") % 13 == 0, "superseded").when(F.col("tokens") % 17 == 0, "reviewed"))
    new = c.where("source in ('click', 'signup', 'error')").withColumn("snapshot_key", F.when(F.col("tokens") % 7 != 0, F.col("snapshot_key"))).withColumn("authority", F.when(F.col("tokens") % 5 == 0, "provider").otherwise(F.col("authority")))
    return old, new.withColumn("tokens", F.col("tokens") + F.col("tokens") % 3 - 1)


add("r12_active", ["claims"], LEDGER + " select source, count(*) as n, cast(sum(tokens) as bigint) as tokens from act group by 1")(
    lambda c: a.active(_sides(c)[0]).groupBy("source").agg(F.count("*").alias("n"), F.sum("tokens").alias("tokens")))
NUMBER = "case {0}authority when 'estimated' then 1 when 'reconstructed' then 2 when 'tool' then 3 when 'provider' then 4 end"
SAME = " and ".join("x.{0} is not distinct from {{0}}.{0}".format(c) for c in ("day", "scope"))
ACCEPT = LEDGER + f""", hit as (select i.receipt_id, count(distinct e.receipt_id) as hits, min(e.receipt_id) as entry from (select receipt_id, snapshot_key, unnest(keys) as key from i) i join (select receipt_id, snapshot_key, unnest(keys) as key from act) e on i.key = e.key and not coalesce(i.snapshot_key = e.snapshot_key, false) group by 1),
    bare as (select day, source, scope, min(receipt_id) as receipt_id, sum(tokens) as tokens, sum(calls) as calls from act where snapshot_key is null and coalesce(len(keys), 0) = 0 group by 1, 2, 3),
    j as (select x.receipt_id, s.receipt_id as sid, k.receipt_id as kid, b.receipt_id as bid, coalesce(h.hits, 0) as hits, x.day is not distinct from s.day and x.source is not distinct from s.source and x.scope is not distinct from s.scope as s_same,
        coalesce(x.keys, []) = coalesce(k.keys, []) as equal_set, {SAME.format("k")} as k_same, x.tokens = s.tokens and x.calls = s.calls as s_equal, len(list_filter(coalesce(s.keys, []), lambda q: not list_contains(coalesce(x.keys, []), q))) > 0 as lost,
        case when x.tokens >= s.tokens and x.calls >= s.calls then 'forward' when x.tokens <= s.tokens and x.calls <= s.calls then 'replay' else 'crossing' end as relation, {NUMBER.format("x.")} - {NUMBER.format("k.")} as stronger,
        x.source = k.source and x.tokens = k.tokens and x.calls = k.calls as k_equal, k.fidelity = 'exact' and (x.tokens < k.tokens or x.calls < k.calls or x.fidelity <> 'exact') as lowers, x.tokens = b.tokens and x.calls = b.calls as b_equal
        from i x left join (select * from act where snapshot_key is not null) s on x.snapshot_key = s.snapshot_key left join hit h on x.receipt_id = h.receipt_id left join act k on h.entry = k.receipt_id
        left join bare b on x.snapshot_key is null and coalesce(len(x.keys), 0) = 0 and x.day = b.day and x.source = b.source and x.scope is not distinct from b.scope),
    w as (select *, case when sid is not null then case when not s_same then 'error:snapshot_scope' when hits > 0 and not (equal_set and k_same) then 'error:foreign_identity' when s_equal and not lost then 'replay:' when relation = 'crossing' then 'error:crossing' when relation = 'replay' then 'replay:' when lost then 'error:identity_loss' else 'updated:' end
        when hits > 1 then 'error:several_entries' when hits = 1 then case when not equal_set then 'error:partial' when not k_same then 'error:cross_scope' when stronger < 0 then 'replay:' when stronger = 0 and k_equal then 'replay:' when stronger = 0 then 'error:equal_authority' when lowers then 'error:decrease' else 'promoted:' end
        when bid is not null then case when b_equal then 'replay:' else 'error:uncheckable' end else 'added:' end as verdict from j),
    o as (select receipt_id, split_part(verdict, ':', 1) as outcome, split_part(verdict, ':', 2) as why, case when verdict <> 'added:' then coalesce(sid, kid, bid) end as entry from w)"""
add("r6_accept_sets", ["claims"], ACCEPT + " select receipt_id, outcome, why, entry from o")(lambda c: a.accept_receipts(*_sides(c)))
RETIRED = ", gone as (select distinct entry from o where outcome = 'promoted'), left_over as (select * from act where receipt_id not in (select entry from gone)), was as (select day, source, sum(tokens) as tokens, sum(calls) as calls from act group by 1, 2), touched as (select distinct day, source from act where receipt_id in (select entry from gone))"
add("r4_rebuilt", ["claims"], ACCEPT + RETIRED + """ select day, source, cast(tokens as bigint) as tokens, cast(calls as bigint) as calls from was where (day, source) not in (select (day, source) from touched)
    union all select day, source, cast(sum(tokens) as bigint), cast(sum(calls) as bigint) from left_over where (day, source) in (select (day, source) from touched) group by 1, 2""")(
    lambda c: (lambda old, new: a.rebuild_entries(old, a.retire(old, a.accept_receipts(old, new)), daily.aggregate_entries(a.active(old).withColumn("coverage", F.lit(None).cast("string"))).select("day", "source", "tokens", "calls", "fidelity"))[0].select("day", "source", "tokens", "calls"))(*[x.withColumn("coverage", F.lit(None).cast("string")) for x in _sides(c)]))
add("r5_replacement", ["claims"], ACCEPT + " select why, count(*) as n from o where why = 'decrease' or outcome = 'promoted' group by 1")(
    lambda c: a.accept_receipts(*_sides(c)).where("why = 'decrease' or outcome = 'promoted'").groupBy("why").agg(F.count("*").alias("n")))
add("j4_policy_overlap", ["claims"], "select distinct day, source from claims where tokens % 3 = 0 intersect select distinct day, source from claims where tokens % 5 = 0")(
    lambda c: ledger.policy_overlap(c.where("tokens % 3 = 0"), c.where("tokens % 5 = 0")))
add("r9_scope_columns", ["claims"], "select day, source, scope, authority, fidelity, cast(sum(tokens) as bigint) as tokens, cast(sum(calls) as bigint) as calls, count(*) as merged from claims where coalesce(len(keys), 0) = 0 group by 1, 2, 3, 4, 5")(
    lambda c: ledger.combine_identity_free(c.where(F.size(a.key_set(F.col("keys"))) == 0), ("day", "source", "scope", "authority", "fidelity")))


# receipts with faults: every rule of the contract is broken by some rows
FAULTY = """, q as (select *, tokens % 29 as f, case when tokens % 29 = 1 then 1 when tokens % 29 <> 2 then 2 end as schema_version, case when tokens % 29 = 3 then ' ' else source end as provider, case when tokens % 29 <> 4 then scope end as surface,
    case when tokens % 29 <> 5 then 'machine/m' end as origin, case when tokens % 29 = 6 then day + 1 else day end as first, case when tokens % 29 = 7 then ['b', 'a'] when tokens % 29 = 8 then [''] else ['a', 'b'] end as models,
    case when tokens % 29 = 9 then keys else ['sha256:' || sha256(receipt_id)] end as correlation_keys, case when tokens % 29 in (10, 11, 12, 13) then 'incomplete' when tokens % 29 = 14 then 'odd' end as coverage,
    case when tokens % 29 = 10 then ['gap'] when tokens % 29 = 11 then ['Gap'] when tokens % 29 = 12 then ['z', 'a'] when tokens % 29 = 15 then ['gap'] end as reasons, case when tokens % 29 = 16 then -1 else tokens end as t, case when tokens % 29 = 17 then -5 else calls end as c,
    case when tokens % 29 = 18 then 'odd' else authority end as auth, case when tokens % 29 = 19 then tokens + 1 else tokens end as i, case when tokens % 29 = 20 then 7 else 3 end as o from claims)"""


def _faulty(c):
    k, t = F.col("tokens") % 29, F.col("tokens")
    one = lambda n, yes, no=None: F.when(k == n, yes).otherwise(no)
    words = lambda *w: F.array(*map(F.lit, w))
    return c.select(
        "receipt_id", "day", "source", "snapshot_key", F.when(k == 1, 1).when(k != 2, 2).alias("schema_version"), one(3, F.lit(" "), F.col("source")).alias("provider"), F.when(k != 4, F.col("scope")).alias("surface"), F.lit("a").alias("account_alias"),
        F.when(k != 5, "machine/m").alias("origin"), F.lit(None).cast("string").alias("machine_alias"), one(6, F.date_add("day", 1), F.col("day")).alias("first"), F.col("day").alias("last"), F.when(k == 7, words("b", "a")).when(k == 8, words("")).otherwise(words("a", "b")).alias("models"),
        one(9, F.col("keys"), F.array(F.concat(F.lit("sha256:"), F.sha2("receipt_id", 256)))).alias("correlation_keys"), F.when(k.between(10, 13), "incomplete").when(k == 14, "odd").alias("coverage"),
        F.when(k.isin(10, 15), words("gap")).when(k == 11, words("Gap")).when(k == 12, words("z", "a")).alias("coverage_reasons"), one(16, F.lit(-1).cast("long"), t).alias("tokens"), one(17, F.lit(-5).cast("long"), F.col("calls")).alias("calls"), one(18, F.lit("odd"), F.col("authority")).alias("authority"),
        F.struct(t.alias("input_tokens"), F.lit(3).cast("long").alias("output_tokens"), one(19, t + 1, t).alias("cached_input_tokens"), F.lit(None).cast("long").alias("cache_write_tokens"), one(20, F.lit(7), F.lit(3)).cast("long").alias("reasoning_tokens")).alias("token_components"),
    )


RECEIPT_RULES = (
    ("authority", "auth not in ('estimated', 'reconstructed', 'tool', 'provider')"), ("calls", None), ("components_cached", "i > tokens"), ("components_reasoning", "o > 3"), ("correlation_keys_form", "len(list_filter(correlation_keys, lambda k: not regexp_matches(k, '^sha256:[a-f0-9]{64}$'))) > 0"),
    ("correlation_keys_order", "false"), ("coverage", "coverage <> 'incomplete'"), ("interval", "first > day"), ("models_blank", "f = 8"), ("models_order", "f = 7"), ("origin", "origin is null"), ("provider_blank", "trim(provider) = ''"), ("reasons_form", "f = 11"), ("reasons_missing", "coverage = 'incomplete' and coalesce(len(reasons), 0) = 0"),
    ("reasons_order", "f = 12"), ("reasons_unasked", "reasons is not null and coalesce(coverage, '') <> 'incomplete'"), ("schema_version", None), ("snapshot_key_blank", "snapshot_key is null"), ("surface_blank", "surface is null"), ("tokens", None),
)
ALWAYS = {"calls": "c < 0", "schema_version": "schema_version <> 2", "tokens": "t < 0"}
CHECKED = ", ".join(f"case when {ALWAYS[n] if c is None else 'schema_version = 2 and (' + c + ')'} then '{n}' end" for n, c in RECEIPT_RULES)
add("p1_contract", ["claims"], FAULTY + f" select receipt_id, concat_ws(',', {CHECKED}) as errors from q")(
    lambda c: contracts.receipt_errors(_faulty(c)).select("receipt_id", F.array_join("errors", ",").alias("errors")))
DAYS = FAULTY + """, e as (select day, source, min(f) as g, sum(tokens) as tokens, sum(calls) as calls, max(tokens) as top from claims_f group by 1, 2)""".replace("claims_f", "q") + """,
    d as (select *, sum(tokens) over (partition by day) as s from e)"""
add("a30_contract", ["claims"], DAYS + """ select rule, day, case when source = 'view' and g = 5 then 'View' else source end as source from (select day, source, g, unnest([case when g = 0 then 'fidelity' end, case when g = 1 then 'calls' end, case when g = 2 then 'authority' end, case when g = 3 then 'origin_sum' end, case when g = 3 then 'origin_form' end, case when g = 4 then 'reasons_missing' end, case when source = 'view' and g = 5 then 'source' end]) as rule from d) where rule is not null
    union all select unnest(list_filter([case when day < date '2024-01-03' then 'before_window' end, case when day >= date '2024-01-29' then 'not_complete' end, case when day(day) % 5 = 0 then 'total_sum' end, case when day(day) % 7 = 0 then 'driver' end, case when day(day) % 11 = 0 then 'timezone' end], lambda r: r is not null)) as rule, day, null as source from (select distinct day from d)""")(
    lambda c: (lambda d: contracts.dataset_errors(d, "UTC", "2024-01-03", "2024-01-29"))(_entries(c)))


def _entries(c):
    g = F.col("g")
    e = c.groupBy("day", "source").agg(F.min(F.col("tokens") % 29).alias("g"), F.sum("tokens").alias("tokens"), F.sum("calls").alias("calls"), F.max("tokens").alias("top"))
    total = e.groupBy("day").agg(F.sum("tokens").alias("total"))
    part = F.struct(*[F.col("top").cast("long").alias(n) if n == "input_tokens" else F.lit(None).cast("long").alias(n) for n in contracts.COMPONENTS])
    number = F.dayofmonth("day")
    return e.join(total, "day").select(
        "day", F.when((F.col("source") == "view") & (g == 5), "View").otherwise(F.col("source")).alias("source"), F.when(number % 11 == 0, "CET").otherwise("UTC").alias("timezone"), (F.col("total") + (number % 5 == 0).cast("int")).alias("total"), F.when(number % 7 == 0, "odd").otherwise("shipping").alias("driver"),
        "tokens", F.when(g == 1, -F.col("calls")).otherwise(F.col("calls")).alias("calls"), F.when(g == 0, "sample").otherwise("exact").alias("fidelity"), F.when(g == 2, "odd").alias("authority"), F.when(g == 4, "incomplete").alias("coverage"), F.lit(None).cast("array<string>").alias("coverage_reasons"), part.alias("token_components"),
        F.when(g == 3, F.create_map(F.lit("Machine/m"), F.col("tokens") + 1)).when(g == 6, F.create_map(F.lit("machine/m"), F.col("tokens"))).alias("by_origin"),
    )


def _import(c):
    """A first import: no ledger, no dataset, a window and an open week."""
    rows = c.withColumns({"origin": F.lit("machine/m"), "coverage": F.lit(None).cast("string"), "input_tokens": F.lit(None).cast("long"), "cached_input_tokens": F.lit(None).cast("long")})
    empty = rows.withColumns({"disposition": F.lit(None).cast("string"), "superseded_by": F.lit(None).cast("string")}).limit(0)
    before = daily.aggregate_entries(empty).select("day", "source", "tokens", "calls", "fidelity")
    plan = a.import_receipts(rows, empty, before, "2024-01-25", "2024-01-05")
    found = plan.errors.groupBy(F.concat_ws(":", "step", "why").alias("part")).agg(F.count("*").alias("tokens"))
    return plan.daily.select(F.lit("entry").alias("part"), "day", "source", "tokens", "calls").unionByName(found, allowMissingColumns=True)


add("r15_import_plan", ["claims"], SETS.replace("from claims)", "from claims where day >= date '2024-01-05' and day < date '2024-01-21')") + """ select 'entry' as part, c.day, c.source, cast(sum(tokens) as bigint) as tokens, cast(sum(calls) as bigint) as calls from c join o on c.receipt_id = o.receipt_id where state in ('free', 'kept') group by 2, 3
    union all select 'identity:' || errors, null, null, count(*), null from o where state = 'error' group by 1 union all select 'window:date', null, null, count(*), null from claims where day < date '2024-01-05' or day > date '2024-01-25'""")(_import)
