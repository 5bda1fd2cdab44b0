"""Registered queries: dashboard figures and verdicts over the daily binding and the claims' ledger."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyhouse.operators import panels as p
from tallyhouse.plans.evidence_queries import LEDGER, sides
from tallyhouse.plans.usage_queries import add

SAMPLED = ", s as (select *, case when day(day) % 9 = 0 then 'sample' else fidelity end as f from daily)"


def _sampled(d):
    return d.withColumn("fidelity", F.when(F.dayofmonth("day") % 9 == 0, "sample").otherwise(F.col("fidelity")))


add("a23_request_size_summary", ["daily"], ", m as (select day, sum(tokens) / sum(calls) as x from daily where calls > 0 group by 1), r as (select *, row_number() over (order by x, day) - 1 as i, count(*) over () as n from m where x > 0) select count(*) as days, max(case when i = n // 2 then x end) as median, round(avg(x), 4) as mean, min(x) as least, max(x) as most from r having count(*) >= 2")(
    lambda d: p.request_size_summary(d).withColumn("mean", F.round("mean", 4)))
add("a22_cadence_summary", ["daily"], ", d as (select distinct day from daily where day between date '1997-01-01' and date '1998-07-31' and day(day) % 13 <> 0), g as (select day - cast(row_number() over (order by day) as int) as g, day from d), r as (select count(*) as n, max(day) as last from g group by g) select cast(sum(n) as bigint) as active, date '1998-07-31' - date '1997-01-01' + 1 as elapsed, cast(floor(100.0 * sum(n) / (date '1998-07-31' - date '1997-01-01' + 1) + 0.5) as bigint) as percent, max(n) as longest, coalesce(max(case when last = date '1998-07-31' then n end), 0) as current from r")(
    lambda d: p.cadence_summary(d.where("dayofmonth(day) % 13 <> 0"), "1997-01-01", "1998-07-31"))
add("a24_coverage_split", ["daily"], SAMPLED + ", d as (select day, bool_and(f = 'sample') as sample from s where day between date '1997-01-01' and date '1998-12-31' group by 1) select 730 as window_days, count(case when not sample then 1 end) as real, count(case when sample then 1 end) as sample_only, 730 - count(*) as missing from d")(
    lambda d: p.coverage_split(_sampled(d), "1997-01-01", "1998-12-31"))
A = ", ".join(f"cast(sum(case when authority = '{a}' then tokens else 0 end) as bigint) as {a}" for a in ("estimated", "reconstructed", "tool", "provider"))
OPEN = "cast(sum(case when authority is null then tokens else 0 end) as bigint) as unrecorded"
add("a20_authority_overall", ["receipts"], f", r as (select source, tokens, case when tokens % 6 <> 0 then authority end as authority from receipts) select source, {A}, {OPEN} from r group by 1 union all select '*', {A}, {OPEN} from r")(
    lambda r: p.authority_overall(r.withColumn("authority", F.when(F.col("tokens") % 6 != 0, F.col("authority")))))
add("a19_source_coverage", ["receipts"], "select source, cast(sum(tokens) as bigint) as tokens, count(case when coverage is null then 1 end) as whole, count(coverage) as incomplete, case when count(coverage) > 0 then 'incomplete' end as coverage from receipts group by 1")(p.source_coverage)
add("a25_freshness_surfaces", ["daily"], ", r as (select source as name, min(day) as first_day, max(day) as last_day, 'source' as kind from daily where source <> 'low' or day < date '1998-01-01' group by 1 union all select driver, min(day), max(day) - 4, 'surface' from daily where driver is not null group by 1) select name, first_day, last_day, kind, case when date '1998-08-03' - last_day <= 1 then 'current' when date '1998-08-03' - last_day <= 7 then 'recent' else 'older' end as age from r")(
    lambda d: p.freshness_of(d.where("source <> 'low' or day < '1998-01-01'"), d.where("driver is not null").groupBy(F.col("driver").alias("surface")).agg(F.min("day").alias("first_day"), F.date_sub(F.max("day"), 4).alias("last_day")), "1998-08-03"))
add("a26_ledger_overview", ["claims"], LEDGER + """, k as (select source, count(distinct key) as identities from (select source, unnest(keys) as key from act) group by 1),
    g as (select source, count(case when not gone then 1 end) as active, count(case when not gone and ok then 1 end) as accepted, count(case when not gone and not ok then 1 end) as unverified, 0 as excluded, 0 as corrected_out, count(case when gone then 1 end) as superseded, count(case when hist then 1 end) as prior_versions,
    count(case when not gone and len(keys) > 0 then 1 end) as kk, count(case when not gone and (len(keys) > 0 or snapshot_key is not null) then 1 end) as ss from l group by 1)
    select g.source, active, accepted, unverified, excluded, corrected_out, superseded, prior_versions, coalesce(identities, 0) as identities, case when ss = 0 then 'none' when kk = active then 'request' when ss = active and kk = 0 then 'snapshot' else 'mixed' end as dedupe from g left join k using (source)""")(
    lambda c: (lambda held, ids, *_: p.ledger_overview(held, ids))(*sides(c)))
WHOLE = """, e as (select *, case when tokens % 17 = 0 then 0 else tokens end as t, case when tokens % 17 = 0 then null else calls end as c, case when day(day) % 9 = 0 then 'sample' else fidelity end as f, tokens % 19 = 0 as off from daily), tt as (select day, cast(sum(t) as bigint) + case when day(day) = 7 then 1 else 0 end as total, sum(t) as s, max(driver) as dr, bool_or(coalesce(c > 0, false) or t % 2 = 1) as act from e group by 1),
    n as (select *, lag(day) over w as pd, lag(t) over w as pt, lag(c) over w as pc from e window w as (partition by source order by day))"""
CHECKS = (
    ("total_sum", "select count(*) from tt where total <> s"), ("out_of_window", "select count(*) from tt where day > date '1998-07-30' or day < date '1992-02-01'"), ("open_day", "select count(*) from tt where day = date '1998-07-30'"), ("unsupported_zero", "select count(*) from tt where total = 0 and not act"),
    ("open_week", "select count(*) from tt where day >= date '1998-07-26' and day < date '1998-07-30'"), ("unreviewed", "select count(*) from tt where coalesce(dr, 'unreviewed') = 'unreviewed'"), ("adjacent_duplicate", "select count(*) from n where day - pd = 1 and t = pt and c is not distinct from pc and t > 0"), ("sample", "select count(*) from e where f = 'sample'"),
    ("typing", "select count(*) from e where f = 'sample'"), ("origin_sum", "select count(*) from e where off"), ("duplicate_entry", "select 0"), ("unlabelled", "select count(distinct source) from e"), ("source_sum", "select case when (select sum(total) from tt) <> (select sum(t) from e) then 1 else 0 end"),
)


def _whole(d):
    zero = F.col("tokens") % 17 == 0
    t = F.when(zero, 0).otherwise(F.col("tokens"))
    off = (F.col("tokens") % 19 == 0).cast("bigint")
    rows = _sampled(d).withColumns({"by_origin": F.create_map("origin", t + off), "calls": F.when(~zero, F.col("calls")), "tokens": t.cast("bigint")}).withColumn("token_components", F.struct((F.col("tokens") % 2).alias("input_tokens")))
    total = rows.groupBy("day").agg((F.sum("tokens") + F.when(F.dayofmonth("day") == 7, 1).otherwise(0)).alias("total"))
    return p.evaluate_whole(rows.join(total, "day"), "1998-07-30", "1992-02-01")


add("a29_evaluate_whole", ["daily"], WHOLE + " select \"check\", count, case when count = 0 then 'ok' when \"check\" in ('open_week', 'unreviewed') then 'WARN' else 'FAIL' end as verdict from (" + " union all ".join(f"select '{n}' as \"check\", cast(({q}) as bigint) as count" for n, q in CHECKS) + ") v")(_whole)
add("j20_dominates_whole", ["receipts"], ", o as (select day, source, cast(sum(tokens) as bigint) as tokens, cast(sum(calls) as bigint) as calls, cast(sum(input_tokens) as bigint) as i, case when count(cached_input_tokens) = count(*) then cast(sum(cached_input_tokens) as bigint) end as c from receipts group by 1, 2) select source, bool_and(ok) as dominates, count(case when not ok then 1 end) as short_days from (select source, not (source = 'view' and day(day) = 3) and not (source = 'error' and day(day) = 4 and c is not null) and not (source = 'click' and day(day) = 5) as ok from o) group by 1")(
    lambda r: (lambda o: p.dominates_whole(o.where("not (source = 'click' and dayofmonth(day) = 5)").withColumns({"input_tokens": F.col("input_tokens") - F.when((F.col("source") == "view") & (F.dayofmonth("day") == 3), 1).otherwise(0), "cached_input_tokens": F.when(~((F.col("source") == "error") & (F.dayofmonth("day") == 4)), F.col("cached_input_tokens"))}), o, ("input_tokens", "cached_input_tokens")))(
        r.groupBy("day", "source").agg(F.sum("tokens").alias("tokens"), F.sum("calls").alias("calls"), F.sum("input_tokens").alias("input_tokens"), F.when(F.count("cached_input_tokens") == F.count("*"), F.sum("cached_input_tokens")).alias("cached_input_tokens"))))
