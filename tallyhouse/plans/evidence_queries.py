"""Registered queries: evidence with histories, whole entries and the whole import, over claims of the event table.

The SQL keeps identities in lists and compares versions field by field, where Spark uses digests and side tables.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyhouse.operators import evidence as ev
from tallyhouse.operators import imports as im
from tallyhouse.operators import ledger as rules
from tallyhouse.operators.contracts import COMPONENTS
from tallyhouse.plans.usage_queries import RANK, add
from tallyhouse.sources import dataset
from tallyhouse.sources.scratch import shared_dir

# the ledger: claims of two sources, some of them legacy, retired or with one prior version
LEDGER = """, l as (select receipt_id as entry_id, snapshot_key, day, source, case when tokens % 6 <> 0 then 'cli' end as surface, scope as account, 'm/' || (tokens % 3) as origin, authority, fidelity, tokens, calls, coalesce(keys, []) as keys,
    case when tokens % 4 <> 0 then tokens end as inp, cast(null as bigint) as outp, tokens % 11 <> 0 as ok, tokens % 5 = 0 as hist, tokens % 13 = 0 as gone from claims where source in ('view', 'click')), act as (select * from l where not gone),
    i as (select receipt_id, case when m is distinct from 7 then snapshot_key end as snapshot_key, day, source, case when m = 5 then 'web' when tokens % 6 <> 0 then 'cli' end as surface, scope as account, 'm/' || (tokens % 3) as origin, case when m = 7 then 'provider' else authority end as authority, fidelity,
    tokens + case m when 1 then 3 when 2 then -4 when 3 then 5 when 4 then 1 else 0 end as tokens, calls - case when m in (2, 3) then 1 else 0 end as calls, case when m = 4 then coalesce(keys, [])[2:] else coalesce(keys, []) end as keys,
    case when m = 2 then null when m = 8 then tokens + 1 when tokens % 4 <> 0 then tokens end as inp, case when m = 6 then 1 end as outp from (select *, case when source = 'click' then tokens % 9 end as m from claims where source in ('click', 'signup')))"""
AUTHORITY = RANK.replace("authority", "{0}.authority")


def facts(ledger: str) -> str:
    """SQL of the pairs of receipts and entries that share a snapshot or identities, with what the rules ask."""
    return f""", pr as (select i.receipt_id, e.entry_id, true as snap from i join {ledger} e on i.snapshot_key = e.snapshot_key union all
        select distinct a.receipt_id, b.entry_id, false from (select receipt_id, unnest(keys) as key from i) a join (select entry_id, unnest(keys) as key from {ledger}) b on a.key = b.key),
    pp as (select receipt_id, entry_id, bool_or(snap) as snap from pr group by 1, 2),
    f as (select i.receipt_id, e.entry_id, snap, e.ok, i.day is not distinct from e.day and i.source = e.source and coalesce(i.surface = e.surface, true) and i.account = e.account and i.origin = e.origin as scope, i.day is not distinct from e.day and i.account = e.account as one_scope,
        i.keys = e.keys as same_set, i.tokens = e.tokens and i.calls = e.calls and i.keys = e.keys as counters, len(list_filter(e.keys, lambda k: not list_contains(i.keys, k))) > 0 as lost,
        coalesce(i.inp <> e.inp, false) or coalesce(i.outp <> e.outp, false) as differ, i.inp is not distinct from e.inp and i.outp is not distinct from e.outp as same_parts, (i.inp is null or e.inp is not null) and (i.outp is null or e.outp is not null) as no_more,
        case when i.tokens >= e.tokens and i.calls >= e.calls then 'forward' when i.tokens <= e.tokens and i.calls <= e.calls then 'replay' else 'crossing' end as relation, {AUTHORITY.format("i")} - {AUTHORITY.format("e")} as stronger,
        e.hist and i.tokens = e.tokens - 4 and i.calls = e.calls - 1 and i.keys = e.keys and i.inp is null and i.outp is null as prior, i.tokens < e.tokens or i.calls < e.calls or i.fidelity <> 'exact' as lowers, day(e.day) % 2 = 0 as pinned
        from pp join i using (receipt_id) join {ledger} e using (entry_id))"""


BARE = """, fr as (select i.receipt_id, e.entry_id, e.ok, i.tokens = e.tokens and i.calls = e.calls as counters, coalesce(i.inp <> e.inp, false) or coalesce(i.outp <> e.outp, false) as differ, (i.inp is null or e.inp is not null) and (i.outp is null or e.outp is not null) as no_more,
    i.inp is not distinct from e.inp and i.outp is not distinct from e.outp as same_parts from i join act e on i.snapshot_key is null and len(i.keys) = 0 and e.snapshot_key is null and len(e.keys) = 0 and i.day = e.day and i.source = e.source and coalesce(i.surface = e.surface, true) and i.account = e.account and i.origin = e.origin)"""
PICK = "(select {} from f where f.receipt_id = i.receipt_id and {})"
VERDICT = LEDGER + facts("act") + BARE + """, s as (select * from f where ok and snap), k as (select * from f where ok and not snap), g as (select * from f where not ok), nk as (select receipt_id, count(*) as n from k group by 1), ng as (select receipt_id, count(*) as n from g group by 1),
    k1 as (select k.* from k join nk using (receipt_id) where n = 1), g1 as (select g.* from g join ng using (receipt_id) where n = 1), foreign_k as (select distinct receipt_id from k where not (scope and same_set)), nb as (select receipt_id, count(*) as n, min(entry_id) as entry_id from fr where ok group by 1), fb as (select fr.* from fr join nb using (receipt_id) where ok and nb.n = 1), fl as (select receipt_id, min(entry_id) as entry_id from fr where not ok and counters and same_parts group by 1),
    v as (select i.receipt_id, case
        when s.entry_id is not null then case when not s.scope then 'error:snapshot_scope:' when s.counters and s.differ then 'error:component:' when x.receipt_id is not null then 'error:foreign_identity:' when s.counters and not s.no_more then 'updated::detail' when s.counters or s.prior then 'replay::'
            when s.relation = 'crossing' then 'error:crossing:' when s.relation = 'replay' then 'replay::' when s.lost then 'error:identity_loss:' else 'updated::forward' end
        when nk.n > 1 then 'error:several_entries:'
        when k1.entry_id is not null then case when k1.same_set and k1.one_scope then case when k1.stronger < 0 then 'replay::weaker' when k1.stronger = 0 and k1.scope and k1.counters and k1.same_parts then 'replay::' when k1.stronger = 0 then 'error:equal_authority:' when k1.pinned and k1.lowers then 'error:decrease:' else 'added::supersede' end
            when not k1.scope then 'error:cross_scope:' else 'error:partial:' end
        when ng.n > 1 then 'error:several_entries:'
        when g1.entry_id is not null then case when not g1.scope then 'error:legacy_scope:' when g1.lost or g1.relation = 'crossing' or (g1.relation = 'replay' and not (g1.counters and g1.same_parts)) then 'error:legacy_ambiguous:' else 'promoted::promote' end
        when nb.n > 1 then 'error:several_entries:'
        when fb.entry_id is not null then case when not fb.counters then 'error:uncheckable:' when fb.differ then 'error:component:' when not fb.no_more then 'updated::detail' else 'replay::' end
        when fl.entry_id is not null then 'promoted::promote' else 'added::new' end as verdict, coalesce(s.entry_id, kk.entry_id, gg.entry_id, nb.entry_id, fl.entry_id) as entry_id
        from i left join s on s.receipt_id = i.receipt_id left join foreign_k x on x.receipt_id = i.receipt_id left join nk on nk.receipt_id = i.receipt_id left join k1 on k1.receipt_id = i.receipt_id left join ng on ng.receipt_id = i.receipt_id left join g1 on g1.receipt_id = i.receipt_id
        left join nb on nb.receipt_id = i.receipt_id left join fb on fb.receipt_id = i.receipt_id left join fl on fl.receipt_id = i.receipt_id left join (select receipt_id, max(entry_id) as entry_id from k group by 1) kk on kk.receipt_id = i.receipt_id left join (select receipt_id, max(entry_id) as entry_id from g group by 1) gg on gg.receipt_id = i.receipt_id),
    o as (select receipt_id, split_part(verdict, ':', 1) as outcome, split_part(verdict, ':', 2) as why, split_part(verdict, ':', 3) as change, case when verdict <> 'added::new' then entry_id end as entry_id from v)"""


def _parts(inp, outp):
    return F.struct(*[{"input_tokens": inp, "output_tokens": outp}.get(c, F.lit(None)).cast("bigint").alias(c) for c in COMPONENTS])


def _common(c):
    scope = {"provider": F.lit("p"), "surface": F.when(F.col("tokens") % 6 != 0, "cli"), "account_alias": F.col("scope"), "origin": F.concat(F.lit("m/"), F.col("tokens") % 3), "machine_alias": F.lit(None).cast("string")}
    return c.withColumns({**scope, "coverage": F.lit(None).cast("string"), "coverage_reasons": F.lit(None).cast("array<string>"), "inp": F.when(F.col("tokens") % 4 != 0, F.col("tokens"))})


def sides(c):
    """(ledger, its identities, receipts, their identities) of the claims."""
    rows, t, none = _common(c), F.col("tokens"), F.lit(None).cast("bigint")
    old = rows.where("source in ('view', 'click')").withColumnRenamed("receipt_id", "entry_id")
    old_ids = ev.identities_of(old, name="entry_id")
    whole = ev.with_key_sets(ev.normalized(old.withColumn("token_components", _parts(F.col("inp"), none)).withColumn("receipt_id", F.col("entry_id"))), old_ids.withColumnRenamed("entry_id", "receipt_id"))
    before = F.struct((t - 4).alias("tokens"), (F.col("calls") - 1).alias("calls"), "n_keys", "key_set", F.lit(None).alias("coverage"), F.lit(None).alias("coverage_reasons"), F.lit(None).alias("token_components"))
    state = {"acceptance": F.when(t % 11 != 0, "accepted").otherwise("legacy-unverified"), "acceptance_basis": F.lit(None), "disposition": F.when(t % 13 == 0, "superseded"), "superseded_by": F.lit(None), "correction": F.lit(None)}
    history = F.when(t % 5 == 0, F.array(before.cast(ev.VERSION))).otherwise(F.array().cast(f"array<{ev.VERSION}>"))
    entries = whole.withColumnRenamed("receipt_id", "entry_id").withColumns({n: v.cast("string") for n, v in state.items()}).withColumn("history", history).select("entry_id", *ev.FIELDS, *ev.STATE)
    m = F.col("m")
    new = rows.where("source in ('click', 'signup')").withColumn("m", F.when(F.col("source") == "click", t % 9))
    by = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in {1: 3, 2: -4, 3: 5, 4: 1}.items() for x in kv]), m.cast("int")), F.lit(0))
    parts = _parts(F.when(m == 2, None).when(m == 8, t + 1).otherwise(F.col("inp")), F.when(m == 6, 1))
    new = new.withColumns({"snapshot_key": F.when(F.coalesce(m != 7, F.lit(True)), F.col("snapshot_key")), "surface": F.when(m == 5, "web").otherwise(F.col("surface")), "authority": F.when(m == 7, "provider").otherwise(F.col("authority")), "token_components": parts, "keys": F.when(m == 4, F.slice("keys", 2, 99)).otherwise(F.col("keys")), "calls": F.col("calls") - F.when(m.isin(2, 3), 1).otherwise(0), "tokens": t + by})
    ids = ev.identities_of(new)
    return entries, old_ids, ev.with_key_sets(ev.normalized(new), ids), ids


def _accept(c):
    return ev.accept_evidence(*sides(c), c.select("day", "source").distinct().where(F.dayofmonth("day") % 2 == 0))


add("r6_histories", ["claims"], VERDICT + " select receipt_id, outcome, why, change, entry_id from o")(lambda c: _accept(c).drop("new_id"))


def _histories(c):
    held, held_ids, new, ids = sides(c)
    outcomes = _accept(c)
    fine = outcomes.join(ev.entry_conflicts(outcomes), "receipt_id", "left_anti")
    after, _ = ev.apply_outcomes(held, held_ids, new, ids, fine)
    return after.select("entry_id", "tokens", "calls", "n_keys", F.col("token_components.input_tokens").alias("inp"), F.col("token_components.output_tokens").alias("outp"), "acceptance", "disposition", F.size("history").cast("bigint").alias("versions"), F.greatest(F.array_max(F.transform("history", lambda v: v["tokens"])), F.lit(0)).alias("top_version"))


add("r8_histories", ["claims"], VERDICT + """, ch as (select * from o where change in ('forward', 'detail', 'promote', 'supersede') and entry_id not in (select entry_id from o where change in ('forward', 'detail', 'promote', 'supersede') group by 1 having count(*) > 1)),
    n as (select l.*, c.change, i.receipt_id as rid, i.tokens as t2, i.calls as c2, i.keys as k2, i.inp as inp2, i.outp as outp2 from l left join ch c on l.entry_id = c.entry_id left join i on i.receipt_id = c.receipt_id)
    select entry_id, case when change in ('forward', 'promote') then t2 else tokens end as tokens, case when change in ('forward', 'promote') then c2 else calls end as calls, case when change in ('forward', 'promote') then len(list_distinct(keys || k2)) else len(keys) end as n_keys,
    case when change in ('forward', 'promote') then inp2 when change = 'detail' then coalesce(inp, inp2) else inp end as inp, case when change in ('forward', 'promote') then outp2 when change = 'detail' then coalesce(outp, outp2) else outp end as outp,
    case when ok or change in ('forward', 'detail', 'promote') then 'accepted' else 'legacy-unverified' end as acceptance, case when change = 'supersede' or gone then 'superseded' end as disposition, cast(hist as bigint) + cast(coalesce(change = 'forward', false) as bigint) as versions,
    greatest(case when hist then tokens - 4 else 0 end, case when change = 'forward' then tokens else 0 end) as top_version from n
    union all select i.receipt_id || case when i.receipt_id in (select entry_id from l) then '#1' else '' end, i.tokens, i.calls, len(i.keys), i.inp, i.outp, 'accepted', null, 0, 0 from o join i using (receipt_id) where outcome = 'added' and (change = 'new' or receipt_id in (select receipt_id from ch))""")(_histories)
add("j6_classes", ["claims"], LEDGER + facts("l") + """, c as (select receipt_id, unnest(case when snap then case when not scope then ['conflict_scope'] when counters and same_parts then [hit] when prior then ['older_version', hit] when lost then ['conflict_identities'] when relation = 'forward' then ['evolved'] when relation = 'crossing' then ['conflict_crossing'] else ['variant'] end
    when same_set and one_scope and stronger <> 0 then [hit] when not scope then ['conflict_scope'] when not same_set then ['conflict_partial'] else [hit] end) as class from (select *, case when ok then 'counted' else 'legacy_hit' end as hit from f))
    select receipt_id, class, count(*) as n from c group by 1, 2 union all select receipt_id, case when snapshot_key is null and len(keys) = 0 then 'uncheckable' else 'new' end, 1 from i where receipt_id not in (select receipt_id from f)""")(
    lambda c: (lambda held, held_ids, new, ids: ev.check_evidence(held, held_ids, new, ids))(*sides(c)))

# whole entries: what the active ledger says against a dataset that differs from it here and there
SAID = LEDGER + """, e as (select day, source, cast(sum(tokens) as bigint) as tokens, cast(sum(calls) as bigint) as calls, case when count(inp) = count(*) then cast(sum(inp) as bigint) end as inp from act group by 1, 2),
    og as (select day, source, string_agg(origin || '=' || t, ',' order by origin) as origins from (select day, source, origin, cast(sum(tokens) as bigint) as t from act group by 1, 2, 3) group by 1, 2)"""


def _said(c):
    held = sides(c)[0]
    return held, im.whole_entries(held.where("disposition is null"), every_origin=True)


add("a1_whole_entries", ["claims"], SAID + " select e.day, e.source, tokens, calls, inp, origins from e join og using (day, source)")(
    lambda c: _said(c)[1].select("day", "source", "tokens", "calls", F.col("token_components.input_tokens").alias("inp"), F.array_join(F.transform(F.array_sort(F.map_entries("by_origin")), lambda o: F.concat_ws("=", o["key"], o["value"])), ",").alias("origins")))
add("r10_whole_entries", ["claims"], SAID + """ select day, source, case when day(day) = 9 then 'dataset' when day(day) % 7 = 0 then 'tokens' when day(day) % 5 = 0 and calls is not null then 'calls' when day(day) % 3 = 0 then 'token_components' else 'by_origin' end as why from e
    where day(day) = 9 or day(day) % 7 = 0 or day(day) % 5 = 0 or (day(day) % 3 = 0 and inp is not null) or day(day) = 8""")(
    lambda c: (lambda held, said: (lambda n: im.entry_differences(held.where(F.dayofmonth("day") != 9), said.withColumns({"tokens": F.when(n % 7 == 0, F.col("tokens") + 1).otherwise(F.col("tokens")), "calls": F.when(n % 5 != 0, F.col("calls")), "token_components": F.when((n % 3 != 0) | (n % 7 == 0), F.col("token_components")), "by_origin": F.when(n == 8, F.create_map(F.lit("m/9"), F.col("tokens"))).otherwise(F.col("by_origin"))})))(F.dayofmonth("day")))(*_said(c)))
add("r14_whole_entries", ["claims"], SAID + """, d as (select *, day(day) % 4 = 0 as sample from e where day(day) < 20 and source = 'view'), n as (select * from e where day(day) > 10 and source = 'click'), nd as (select distinct day from n)
    select day, source, tokens, inp, case when (select count(*) from d x where x.day = n.day) > 0 then 'writing' when day(day) % 2 = 0 then 'shipping' else 'unreviewed' end as driver from n
    union all select day, source, tokens, inp, 'writing' from d where not (sample and day in (select day from nd))""")(
    lambda c: (lambda said: im.merge_entries(
        said.where("dayofmonth(day) < 20 and source = 'view'").withColumns({"timezone": F.lit("UTC"), "driver": F.lit("writing"), "evidence": F.lit("e"), "fidelity": F.when(F.dayofmonth("day") % 4 == 0, "sample").otherwise("exact")}).select(*im.DAILY),
        said.where("dayofmonth(day) > 10 and source = 'click'"), said.select("day", F.when(F.dayofmonth("day") % 2 == 0, "shipping").alias("driver")), "UTC").select("day", "source", "tokens", F.col("token_components.input_tokens").alias("inp"), "driver"))(_said(c)[1]))
add("j3_exact_exclusions", ["claims"], SAID + """, x as (select day, source, case when day(day) % 2 = 0 then tokens else tokens + 1 end as tokens, case when day(day) % 6 <> 0 then calls end as calls from e where day(day) < 20)
    select day, source, case when x.day is null then 'kept' when x.tokens = e.tokens and x.calls is not distinct from e.calls then 'excluded' else 'exclusion_mismatch' end as state from e left join x using (day, source)""")(
    lambda c: (lambda said: (lambda kept, gone, errors: kept.join(errors, im.KEY, "left").select(*im.KEY, F.coalesce("why", F.lit("kept")).alias("state")).unionByName(gone.select(*im.KEY, F.lit("excluded").alias("state"))))(*im.split_exclusions(
        said, said.where("dayofmonth(day) < 20").select("day", "source", (F.col("tokens") + F.dayofmonth("day") % 2).alias("tokens"), F.when(F.dayofmonth("day") % 6 != 0, F.col("calls")).alias("calls")))))(_said(c)[1]))
add("j1_settled_split", ["receipts"], ", s as (select distinct day, source from receipts where day(day) = 1), og as (select day, source, origin from receipts where origin is not null and right(origin, 1) <> '2') select day, source, scope, origin, case when s.day is null then 'kept' when origin is not null and exists (select 1 from og where og.day = r.day and og.source = r.source) and not exists (select 1 from og where og.day = r.day and og.source = r.source and og.origin = r.origin) then 'foreign_origin' else 'dropped' end as state from receipts r left join s using (day, source)")(
    lambda r: rules.split_settled(r, r.where(F.dayofmonth("day") == 1).select("day", "source"), r.where("origin is not null and right(origin, 1) <> '2'").select("day", "source", "origin")).select("day", "source", "scope", "origin", "state"))
add("j2_settled_calls", ["receipts"], ", d as (select day, source, cast(sum(tokens) as bigint) as tokens, cast(sum(calls) as bigint) as calls from receipts group by 1, 2), s as (select day, source, case when source = 'view' then tokens + 1 else tokens end as tokens, case when source = 'click' then calls - 1 when source = 'error' then null else calls end as calls from d where day(day) < 4), n as (select * from d where not (day(day) = 2 and source = 'purchase')) select s.day, s.source, case when n.tokens is null then 'missing' else 'changed' end as why from s left join n using (day, source) where n.tokens is null or s.tokens <> n.tokens or s.calls is distinct from n.calls")(
    lambda r: (lambda d: rules.check_settled(d.where("not (dayofmonth(day) = 2 and source = 'purchase')"), d.where("dayofmonth(day) < 4").select("day", "source", (F.col("tokens") + F.when(F.col("source") == "view", 1).otherwise(0)).alias("tokens"), F.when(F.col("source") == "click", F.col("calls") - 1).when(F.col("source") != "error", F.col("calls")).alias("calls"))))(r.groupBy("day", "source").agg(F.sum("tokens").alias("tokens"), F.sum("calls").alias("calls"))))


def _import(c):
    """A first import of all claims: a window, an open week, and receipts that do not bear one another."""
    rows = _common(c).withColumns({"schema_version": F.lit(2), "timezone": F.lit("UTC"), "first": F.col("day"), "last": F.col("day"), "models": F.lit(None).cast("array<string>"), "snapshot_key": F.col("receipt_id"), "surface": F.lit("cli"), "driver": F.when(F.dayofmonth("day") % 2 == 0, "shipping"), "token_components": F.when(F.col("inp").isNotNull(), _parts(F.col("inp"), F.lit(None).cast("bigint")))})
    ids = ev.identities_of(rows).withColumn("key", F.concat(F.lit("sha256:"), F.sha2("key", 256)))
    none = lambda schema: c.sparkSession.createDataFrame([], schema)
    plan = im.plan_import(rows, ids, none(ev.LEDGER_SCHEMA), none(ev.IDENTITY_SCHEMA), none(im.DAILY_SCHEMA), im.Policy("2024-01-25", "2024-01-05"))
    found = plan.errors.groupBy(F.concat_ws(":", "step", "why").alias("part")).agg(F.count("*").alias("tokens"))
    held = plan.aside.groupBy("state").agg(F.count("*").alias("tokens")).withColumnRenamed("state", "part")
    told = plan.daily.select(F.lit("entry").alias("part"), "day", "source", "tokens", "calls", F.col("token_components.input_tokens").alias("inp"), "driver", "authority", F.size("by_origin").cast("bigint").alias("origins"))
    return told.unionByName(found, allowMissingColumns=True).unionByName(held, allowMissingColumns=True)


SETS = f""", c as (select *, {RANK} as r from claims), sets as (select keys, count(*) as n, min(day) as d0, max(day) as d1, min(scope) as s0, max(scope) as s1, count(distinct r) as ranks, max(r) as top from c where len(keys) > 0 group by 1), ex as (select keys, unnest(keys) as key from sets), part as (select distinct keys from ex where key in (select key from ex group by 1 having count(distinct keys) > 1)),
    j as (select s.keys, top, concat_ws(',', case when d0 <> d1 then 'cross_date' end, case when d0 = d1 and s0 <> s1 then 'cross_scope' end, case when d0 = d1 and s0 = s1 and ranks < n then 'equal_authority' end, case when p.keys is not null then 'partial' end) as errors from sets s left join part p on s.keys = p.keys),
    o as (select c.*, case when c.tokens % 4 <> 0 then c.tokens end as inp, coalesce(errors, '') as errors, errors is null or (errors = '' and r = top) as goes from c left join j on c.keys = j.keys), k as (select * from o where goes and day >= date '2024-01-05' and day <= date '2024-01-25')"""
add("r15_whole_import", ["claims"], SETS + f""" select 'entry' as part, day, source, cast(sum(tokens) as bigint) as tokens, cast(sum(calls) as bigint) as calls, case when count(inp) = count(*) then cast(sum(inp) as bigint) end as inp, case when day(day) % 2 = 0 then 'shipping' else 'unreviewed' end as driver,
    case min({RANK}) when 1 then 'estimated' when 2 then 'reconstructed' when 3 then 'tool' else 'provider' end as authority, count(distinct tokens % 3) as origins from k where day < date '2024-01-21' group by 2, 3
    union all select 'batch:' || errors, null, null, count(*), null, null, null, null, null from o where errors <> '' group by 1 union all select 'window:date', null, null, count(*), null, null, null, null, null from o where goes and (day < date '2024-01-05' or day > date '2024-01-25')
    union all select 'held', null, null, count(*), null, null, null, null, null from k where day >= date '2024-01-21'""")(_import)


def _committed(c):
    """Two versions committed one after the other, and both read back."""
    said = _said(c)[1].withColumns({"timezone": F.lit("UTC"), "driver": F.lit("writing"), "evidence": F.lit("e")}).select(*im.DAILY)
    spark = c.sparkSession
    root = shared_dir(spark, "dataset")
    none = spark.createDataFrame([], ev.LEDGER_SCHEMA), spark.createDataFrame([], ev.IDENTITY_SCHEMA)
    first = dataset.commit_version(spark, root, said.where("source = 'view'"), *none, base=0)
    dataset.commit_version(spark, root, said, *none, base=first)
    told = lambda v: v.daily.select(F.lit(v.number).alias("version"), "day", "source", "tokens", F.col("token_components.input_tokens").alias("inp"), F.size("by_origin").cast("bigint").alias("origins"))
    return told(dataset.read_version(spark, root, 1)).unionByName(told(dataset.read_version(spark, root)))


add("s3_committed_versions", ["claims"], SAID + " select v.version, e.day, e.source, tokens, inp, len(string_split(origins, ',')) as origins from e join og using (day, source) join (select unnest([1, 2]) as version) v on v.version = 2 or e.source = 'view'")(_committed)
