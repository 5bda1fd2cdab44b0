"""Registered queries: validation, gates, reconciliation, ledger."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tallyhouse.operators import daily, ledger, privacy
from tallyhouse.plans.usage_queries import ENTRIES, RANK, add, add_table

RULES = [
    ("authority", "authority not in ('estimated', 'reconstructed', 'tool', 'provider')"), ("calls", "calls < 0"), ("cached_over_input", "cached_input_tokens > input_tokens"), ("coverage", "coverage is not null and coverage <> 'incomplete'"),
    ("estimate_with_provider", "fidelity = 'estimated' and authority = 'provider'"), ("no_origin", "origin is null"), ("tokens", "tokens < 0 or tokens > 9007199254740991"), ("zero_without_activity", "tokens = 0 and not coalesce(calls > 0, false)"),
]
VALID = "concat_ws(',', " + ", ".join(f"case when {c} then '{n}' end" for n, c in RULES) + ")"
add("p1_validate", ["receipts"], f"select day, source, scope, origin, {VALID} as errors from receipts")(
    lambda r: ledger.validate_receipts(r).select("day", "source", "scope", "origin", "errors"))
add("p2_components", ["receipts"], "select source, count(case when cached_input_tokens > input_tokens then 1 end) as cached_over_input, count(case when input_tokens + output_tokens <> tokens then 1 end) as parts_differ, count(case when cached_input_tokens is null then 1 end) as absent from receipts group by 1")(ledger.component_errors)
add("p6_cutoff", ["receipts"], "select state, count(*) as n, min(day) as first_day, max(day) as last_day from (select day, case when day > date '2024-01-25' or day < date '2024-01-05' then 'error' when day < date '2024-01-25' - cast(dayofweek(date '2024-01-25') as int) then 'kept' else 'held' end as state from receipts) group by 1")(
    lambda r: ledger.partition_complete(r, "2024-01-25", "2024-01-05").groupBy("state").agg(F.count("*").alias("n"), F.min("day").alias("first_day"), F.max("day").alias("last_day")))
add("p8_horizon", ["receipts"], "select day, source, scope, origin, tokens from receipts where day >= date '2024-01-25' - 10")(
    lambda r: ledger.after_horizon(r, "2024-01-25", 10).select("day", "source", "scope", "origin", "tokens"))


def _find(column):
    rules = (
        ("absolute_path", r"(?i)/(Users|home)/[^/\s]+|(?i)[A-Z]:\\Users\\[^\\\s]+"), ("authorization", r"(?i)\bBearer\s+([^\s$]|\$[^{]|\$$)"), ("email", r"(?i)\b[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,}\b"),
        ("markup", r"(?i)</?[a-z][^>]*>"), ("secret", r"\b(sk-|pplx-|ghp_|github_pat_)[A-Za-z0-9_-]{16,}\b"), ("url", r"(?i)(https?|file)://"),
    )
    plain = f"replace({column}, '<synthetic>', 'synthetic')"
    return "concat_ws(',', " + ", ".join(f"case when regexp_matches({plain}, '{p}') then '{n}' end" for n, p in rules) + ")"


add_table("p14_privacy", ["documents", "pages"], f"select 'd' || doc_id as id, {_find('text')} as findings from documents union all select 'p' || page_id, {_find('html')} from pages")(
    lambda d, p: d.select(F.concat(F.lit("d"), "doc_id").alias("id"), privacy.privacy_findings(F.col("text")).alias("findings")).union(p.select(F.concat(F.lit("p"), "page_id"), privacy.privacy_findings(F.col("html")))))
#: Texts at the edges of the rules, by doc_id modulo 11, in SQL that both engines run.
ODD = ("'mail ' || doc_id || '@b.co'", "'Bearer ${key}'", "'bearer abc' || doc_id", "'C:' || chr(92) || 'Users' || chr(92) || 'me'", "'file://x'", "'pplx-abcdefghijklmnop' || doc_id", "'<synthetic> only'", "'xsk-abcdefghijklmnopq'", "'a@b.co_x /home/'", "'sk-abcdefghijklmno-'")
ODD_SQL = "case doc_id % 11 " + " ".join(f"when {k} then {v}" for k, v in enumerate(ODD)) + " else 'plain' end"
add_table("p14_odd_texts", ["documents"], f"select doc_id, {_find('t')} as findings from (select doc_id, {ODD_SQL} as t from documents)")(
    lambda d: d.select("doc_id", privacy.privacy_findings(F.expr(ODD_SQL)).alias("findings")))
add("p16_labels", ["daily"], "select day, source, case when driver is null then 'missing' when driver not in ('feature', 'bugfix', 'unknown', 'unreviewed') then 'unknown_label' else 'unreviewed' end as why from daily where driver is null or driver = 'unreviewed'")(
    lambda d: privacy.label_errors(d, ["feature", "bugfix", "unknown", "unreviewed"], True).select("day", "source", "why"))

SETTLED = "settled as (select day, source, cast(sum(tokens) as bigint) as tokens, cast(sum(calls) as bigint) as calls from receipts where day(day) = 1 group by 1, 2)"


def _settled(r):
    return r.where(F.dayofmonth("day") == 1).groupBy("day", "source").agg(F.sum("tokens").alias("tokens"), F.sum("calls").alias("calls"))


add("j1_settled_anti", ["receipts"], f", {SETTLED} select day, source, scope, origin, tokens from receipts r where not exists (select 1 from settled s where s.day = r.day and s.source = r.source)")(
    lambda r: ledger.drop_settled(r, _settled(r)).select("day", "source", "scope", "origin", "tokens"))
add("j2_settled_check", ["receipts"], f", {SETTLED}, d as (select day, source, cast(sum(tokens) as bigint) as tokens, cast(sum(calls) as bigint) as calls from receipts where not (day(day) = 1 and source = 'click') group by 1, 2) select s.day, s.source, case when d.tokens is null then 'missing' else 'changed' end as why from settled s left join d using (day, source) where s.day between (select min(day) from d) and (select max(day) from d) and (d.tokens is null or s.tokens <> d.tokens or s.calls is distinct from d.calls)")(
    lambda r: ledger.check_settled(r.where("not (dayofmonth(day) = 1 and source = 'click')").groupBy("day", "source").agg(F.sum("tokens").alias("tokens"), F.sum("calls").alias("calls")), _settled(r)))
E_CTE = f", e as ({ENTRIES})"
add("j3_exclusions", ["receipts"], E_CTE + ", x as (select day, source, case when tokens % 2 = 1 then tokens + 1 else tokens end as tokens, calls from e where day(day) = 2) select e.day, e.source, case when x.day is null then 'kept' when x.tokens is not distinct from e.tokens and x.calls is not distinct from e.calls then 'excluded' else 'mismatch' end as state from e left join x on e.day = x.day and e.source = x.source")(
    lambda r: (lambda e: ledger.apply_exclusions(e, e.where(F.dayofmonth("day") == 2).withColumn("tokens", F.col("tokens") + F.col("tokens") % 2)))(daily.aggregate_entries(r)))
add("j5_overlap", ["keys"], "select a.request_id, a.source as a, b.source as b, case when a.scope = b.scope then 'identical' else 'cross_scope' end as kind from keys a join keys b on a.request_id = b.request_id and a.source < b.source")(ledger.identity_overlaps)


SIDES = ", l as (select * from keys where source in ('tool_a', 'tool_n')), i as (select request_id, source, case when source = 'tool_r' then 'provider' else authority end as authority, scope from keys where source in ('tool_r', 'tool_n'))"


def _plain(k):
    return k.where("source in ('tool_a', 'tool_n')"), k.where("source in ('tool_r', 'tool_n')").withColumn("authority", F.when(F.col("source") == "tool_r", "provider").otherwise(F.col("authority")))


add("j6_ledger_check", ["keys"], SIDES + " select i.request_id, i.source, count(l.source) as hits, case when count(l.source) = 0 then 'new' when not coalesce(bool_and(l.scope = i.scope), true) then 'conflict' when coalesce(bool_or(l.source = i.source), false) then 'counted' else 'conflict' end as class from i left join l on i.request_id = l.request_id group by 1, 2, i.scope")(
    lambda k: ledger.check_against_ledger(*_plain(k)))
add("j7_wildcard_scope", ["receipts"], "select l.day, l.source, count(*) as pairs from receipts l join receipts r on l.day = r.day and l.source = r.source and (l.origin is null or r.origin is null or l.origin = r.origin) and (l.coverage is null or r.coverage is null or l.coverage = r.coverage) where l.scope < r.scope group by 1, 2")(
    lambda r: ledger.same_scope_day(r, r, ("origin", "coverage")).where("scope < scope_r").groupBy("day", "source").agg(F.count("*").alias("pairs")))
add("j8_no_decrease", ["daily"], "select day, source, case when a.tokens is null then 'disappeared' when a.fidelity <> 'exact' then 'fidelity' when a.tokens < b.tokens then 'tokens' when b.calls is not null and (a.calls is null or a.calls < b.calls) then 'calls' end as why from daily b left join (select day, source, case when tokens % 7 = 0 then 'estimated' else fidelity end as fidelity, case when tokens % 5 = 0 then tokens - 1 else tokens end as tokens, case when tokens % 3 = 0 then null else calls end as calls from daily where tokens % 11 <> 0) a using (day, source) where b.fidelity = 'exact' and (a.tokens is null or a.fidelity <> 'exact' or a.tokens < b.tokens or a.calls is null or a.calls < b.calls)")(
    lambda d: ledger.exact_decreases(d, d.where("tokens % 11 <> 0").select("day", "source", F.when(F.col("tokens") % 7 == 0, "estimated").otherwise(F.col("fidelity")).alias("fidelity"), F.when(F.col("tokens") % 5 == 0, F.col("tokens") - 1).otherwise(F.col("tokens")).alias("tokens"), F.when(F.col("tokens") % 3 != 0, F.col("calls")).alias("calls"))))
add("j11_reconcile", ["daily", "calls"], ", a as (select day, cast(sum(tokens) as bigint) as a from daily group by 1), b as (select day, cast(sum(input * 100 + output) as bigint) as b from calls group by 1) select case when b is null then 'report' when a is null then 'transcript' else 'both' end as side, count(*) as days, count(case when abs(a - b) / greatest(a, b) <= 0.15 then 1 end) as close_days, cast(sum(a) as bigint) as report_tokens, cast(sum(b) as bigint) as transcript_tokens from a full join b using (day) group by 1")(
    lambda d, c: ledger.reconcile_report(d.groupBy("day").agg(F.sum("tokens").alias("tokens")), c.groupBy("day").agg(F.sum(F.col("input") * 100 + F.col("output")).alias("tokens"))))
add("j12_quarantine", ["calls"], "select source, account, count(*) as n from calls where source || account in ('tool_aa0', 'tool_na1') group by 1, 2")(
    lambda c: ledger.apply_quarantine(c, c.sparkSession.createDataFrame([("tool_a", "a0", "additive"), ("tool_n", "a1", "additive"), ("tool_r", "a2", "overlapping")], "source string, account string, mode string")).groupBy("source", "account").agg(F.count("*").alias("n")))
add("j20_dominates", ["receipts"], E_CTE + " select o.source, bool_and(coalesce(n.tokens >= o.tokens and (o.calls is null or n.calls >= o.calls), false)) as dominates, count(case when not coalesce(n.tokens >= o.tokens and (o.calls is null or n.calls >= o.calls), false) then 1 end) as short_days from e o left join (select day, source, case when tokens % 9 = 0 then tokens - 1 else tokens end as tokens, calls from e) n on n.day = o.day and n.source = o.source group by 1")(
    lambda r: (lambda e: ledger.dominates_legacy(e.withColumn("tokens", F.col("tokens") - (F.col("tokens") % 9 == 0).cast("int")), e))(daily.aggregate_entries(r)))
add("w5_dominance", ["snaps"], ", g as (select key, tokens, min(calls) lo, max(calls) hi, count(*) n from snaps group by 1, 2), c as (select *, coalesce(lo < max(hi) over (partition by key order by tokens rows between unbounded preceding and 1 preceding), false) as crosses from g) select key, max(tokens) as tokens, arg_max(hi, tokens) as calls, cast(sum(n) as bigint) as versions, bool_or(crosses) as conflict from c group by 1")(ledger.dominant_snapshot)
add("r1_merge", ["snaps"], "select tokens, calls, count(*) as merged, source, case when min(day) is not distinct from max(day) then max(day) end as day, min(day) is distinct from max(day) as conflict from (select source, day, tokens, calls from snaps) group by source, tokens, calls")(
    lambda s: ledger.merge_equivalent(s.withColumn("key", F.col("source"))).select("tokens", "calls", "merged", "source", "day", "conflict"))
add("r2_identity_loss", ["keys"], f", k as (select *, {RANK} as r from keys), m as (select *, r = max(r) over (partition by scope) as kept from k), p as (select scope, request_id, bool_or(kept) as kept from m group by 1, 2) select scope, count(*) as identities, count(case when not kept then 1 end) as lost from p group by 1")(ledger.identity_loss)
add("r3_authority", ["keys"], f", k as (select *, {RANK} as r from keys), t as (select request_id, scope, max(r) as r, count(*) as receipts from k group by 1, 2) select t.request_id, t.scope, any_value(k.authority) as authority, min(k.source) as source, t.receipts, count(*) > 1 as conflict from t join k on k.request_id = t.request_id and k.scope = t.scope and k.r = t.r group by 1, 2, 5")(ledger.resolve_authority)
OUTCOME = f", b as (select request_id, max({RANK}) as r from l group by 1), lb as (select b.request_id, b.r, max(l.source) as source, max(l.scope) as scope from b join l on l.request_id = b.request_id and {RANK.replace('authority', 'l.authority')} = b.r group by 1, 2), o as (select i.request_id, i.source, case when lb.r is null then 'added' when lb.scope <> i.scope then 'error' when {RANK.replace('authority', 'i.authority')} > lb.r then 'promoted' when {RANK.replace('authority', 'i.authority')} < lb.r then 'replay' when lb.source = i.source then 'replay' else 'error' end as outcome from i left join lb on i.request_id = lb.request_id)"
add("r6_accept", ["keys"], SIDES + OUTCOME + " select request_id, source, outcome from o")(lambda k: ledger.accept(*_plain(k)))
add("r4_transition", ["keys"], SIDES + OUTCOME + " select l.source as old_source, o.source as new_source, count(*) as retired from l join o on l.request_id = o.request_id where o.outcome = 'promoted' group by 1, 2")(lambda k: ledger.plan_transitions(*_plain(k)))
add("r7_relation", ["snaps"], ", p as (select *, lag(tokens) over w as t, lag(calls) over w as c from snaps window w as (partition by key order by event_id)) select relation, count(*) as n from (select case when tokens >= t and calls >= c then 'forward' when tokens <= t and calls <= c then 'replay' else 'crossing' end as relation from p where t is not null) group by 1")(
    lambda s: (lambda w: s.withColumns({"t": F.lag("tokens").over(w), "c": F.lag("calls").over(w)}).where("t is not null").groupBy(ledger.counter_relation(F.col("t"), F.col("c"), F.col("tokens"), F.col("calls")).alias("relation")).agg(F.count("*").alias("n")))(Window.partitionBy("key").orderBy("event_id")))
add("r9_identity_free", ["receipts"], "select day, source, scope, cast(sum(tokens) as bigint) as tokens, cast(sum(calls) as bigint) as calls, count(*) as merged from receipts group by 1, 2, 3")(ledger.combine_identity_free)
add("r10_cross_check", ["receipts"], E_CTE + ", d as (select day, source, case when tokens % 13 = 0 then tokens + 1 else tokens end as tokens, calls from e where tokens % 17 <> 0) select day, source, case when e.tokens is null then 'ledger' when d.tokens is null then 'dataset' else 'differ' end as why from e full join d using (day, source) where e.tokens is distinct from d.tokens or e.calls is distinct from d.calls")(
    lambda r: (lambda e: ledger.ledger_matches(e, e.where("tokens % 17 <> 0").withColumn("tokens", F.col("tokens") + (F.col("tokens") % 13 == 0).cast("int"))))(daily.aggregate_entries(r)))
add("a26_ledger_summary", ["keys"], "select source, count(*) as entries, count(case when authority <> 'estimated' then 1 end) as active, count(distinct request_id) as identities, count(distinct scope) as scopes from keys group by 1")(
    lambda k: ledger.ledger_summary(k, F.col("authority") != "estimated"))
add("r15_import", ["receipts"], f", {SETTLED}, ok as (select * from receipts r where {VALID} in ('', 'no_origin') and day >= date '2024-01-05' and day < date '2024-01-25' - cast(dayofweek(date '2024-01-25') as int) and not exists (select 1 from settled s where s.day = r.day and s.source = r.source)) {ENTRIES.replace('from receipts', 'from ok')}")(
    lambda r: daily.aggregate_entries(ledger.drop_settled(ledger.partition_complete(ledger.validate_receipts(r).where("errors in ('', 'no_origin')"), "2024-01-25", "2024-01-05").where("state = 'kept'"), _settled(r))))
add("t1_ledger_order", ["keys"], "select row_number() over (order by scope, source, request_id) as place, request_id, source from keys")(
    lambda k: ledger.order_ledger(k, ["scope", "source", "request_id"]).select("place", "request_id", "source"))
add("t1_ledger_order_all", ["keys"], "select row_number() over (order by scope, source, request_id) as place, * from keys")(
    lambda k: ledger.order_ledger(k, ["scope", "source", "request_id"]))
add("u2_intersect", ["keys"], "select request_id from keys where source = 'tool_a' intersect select request_id from keys where source = 'tool_n'")(
    lambda k: k.where("source = 'tool_a'").select("request_id").intersect(k.where("source = 'tool_n'").select("request_id")))
add("u3_except", ["keys"], "select request_id from keys where source = 'tool_a' except select request_id from keys where source = 'tool_n'")(
    lambda k: k.where("source = 'tool_a'").select("request_id").join(k.where("source = 'tool_n'").select("request_id"), "request_id", "left_anti").distinct())
