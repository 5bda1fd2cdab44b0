"""Registered queries: analytics over the daily record."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tallyhouse.operators import analytics as a
from tallyhouse.operators.ledger import limit_findings
from tallyhouse.plans.usage_queries import add

T = ", t as (select day, cast(sum(tokens) as bigint) as total from daily group by 1)"
W = "over (order by epoch(day) / 86400 range between {} preceding and {} {})"
S = "share, rank() over (order by tokens desc) as place"
SHARE = "tokens / sum(tokens) over () as " + S

add("j19_unlabelled", ["daily"], "select source, count(distinct day) as days from daily where source not in ('urgent', 'high', 'low') group by 1")(
    lambda d: a.unlabelled(d, d.where("source in ('urgent', 'high', 'low')").select("source")))
ORDERED = ", r as (select day, source, day + (case when source = 'low' then -2 else 0 end) as d, row_number() over (order by day, source) as position from daily)"
add("w12_date_order", ["daily"], ORDERED + ", e as (select position, d as day, row_number() over (partition by d order by position) > 1 as again, d <= lag(d) over (order by position) as below from r) select position, day, 'duplicate' as why from e where again union all select position, day, 'unsorted' from e where below")(
    lambda d: a.date_order_errors(d.select(F.date_add("day", F.when(F.col("source") == "low", -2).otherwise(0)).alias("day"), F.row_number().over(Window.orderBy("day", "source")).alias("position"))))
add("a16_totals", ["daily"], T + " select day, total from t")(a.totals)
add("w6_trailing7", ["daily"], T + ", c as (select day, total, case when count(*) over w = 7 then cast(floor(sum(total) over w / 7 + 0.5) as bigint) end as average, case when count(*) over v = 7 then cast(floor(sum(total) over v / 7 + 0.5) as bigint) end as before from t window w as (order by day range between interval 6 day preceding and current row), v as (order by day range between interval 13 day preceding and interval 7 day preceding)) select *, cast(floor(100.0 * (average - before) / nullif(before, 0) + 0.5) as bigint) as delta_percent from c")(a.calendar_average)
add("w7_scanned_week", ["daily"], T + ", m as (select max(day) - cast(dayofweek(max(day)) as int) as w from t), k as (select case when w + 6 < date '1998-08-03' then w else w - 7 end as week from m) select k.week, cast(floor(sum(total) / 7 + 0.5) as bigint) as average from k left join t on t.day between k.week and k.week + 6 group by 1")(
    lambda d: a.scanned_week(d, "1998-08-03"))
add("w8_weekly", ["daily"], T + ", w as (select distinct cast(date_trunc('week', cast(x as date)) as date) as week from range(date '1994-01-01', date '1995-12-31' + interval 1 day, interval 1 day) r(x)) select w.week, cast(sum(total) as bigint) as total from w left join t on cast(date_trunc('week', t.day) as date) = w.week and t.day between date '1994-01-01' and date '1995-12-31' group by 1")(
    lambda d: a.weekly_series(d, "1994-01-01", "1995-12-31"))


def _bounds(d):
    """First and last day of a table: one row, so that a series covers all of it."""
    r = d.agg(F.min("day").cast("string").alias("a"), F.max("day").cast("string").alias("b")).first()
    return r["a"], r["b"]


DAYS = "b as (select min(day) as d0, max(day) as d1 from daily), c as (select cast(x as date) as day from b, range(d0, d1 + interval 1 day, interval 1 day) r(x))"
add("w8_weekly_all", ["daily"], T + ", " + DAYS + ", w as (select distinct cast(date_trunc('week', day) as date) as week from c) select w.week, cast(sum(total) as bigint) as total from w left join t on cast(date_trunc('week', t.day) as date) = w.week group by 1")(
    lambda d: a.weekly_series(d, *_bounds(d)))
add("w9_runs", ["daily"], ", g as (select day, day - cast(row_number() over (order by day) as int) as g from (select distinct day from daily where source = 'urgent')) select min(day) as first_day, max(day) as last_day, count(*) as days from g group by g")(
    lambda d: a.day_runs(d.where("source = 'urgent'")))
add("w10_adjacent_dup", ["daily"], ", r as (select day, source, tokens % 20 as tokens, calls % 2 as calls from daily), p as (select *, lag(day) over w as pd, lag(tokens) over w as pt, lag(calls) over w as pc from r window w as (partition by source order by day)) select day, source, tokens from p where day - pd = 1 and tokens = pt and calls is not distinct from pc")(
    lambda d: a.adjacent_duplicates(d.withColumns({"tokens": F.col("tokens") % 20, "calls": F.col("calls") % 2})))
add("w11_intensity", ["daily"], T + ", r as (select total, row_number() over (order by total, day) - 1 as i, count(*) over () as n from t where total > 0), q as (select max(case when i = least(n - 1, floor(n * 0.25)) then total end) as q1, max(case when i = least(n - 1, floor(n * 0.5)) then total end) as q2, max(case when i = least(n - 1, floor(n * 0.75)) then total end) as q3 from r) select day, total, case when total <= 0 then 0 when total <= q1 then 1 when total <= q2 then 2 when total <= q3 then 3 else 4 end as level from t, q")(a.intensity)
add("a17_summary", ["daily"], T + ", s as (select cast(sum(tokens) as bigint) as total, cast(sum(case when fidelity = 'exact' then tokens else 0 end) as bigint) as exact from daily where day between date '1994-01-01' and date '1995-12-31'), p as (select * from t where day between date '1994-01-01' and date '1995-12-31') select total, exact, total - exact as estimated, cast(floor(100.0 * exact / nullif(total, 0) + 0.5) as bigint) as exact_percent, (select day from p order by total desc, day limit 1) as peak_day, (select max(total) from p) as peak, (select count(*) from p) as evidence_days, 730 as elapsed_days, total // 1500 as per_1500, total // 90000 as per_90000, total // 11000 as per_11000 from s")(
    lambda d: a.summarize(d, "1994-01-01", "1995-12-31"))
add("a18_drivers", ["daily"], f"select driver, state, tokens, {SHARE} from (select coalesce(driver, 'unreviewed') as driver, case when driver is null or driver = 'unreviewed' then 'awaiting' when driver = 'unknown' then 'reviewed_unknown' else 'named' end as state, cast(sum(tokens) as bigint) as tokens from daily group by 1, 2)")(a.driver_mix)
add("a19_sources", ["daily"], f"select source, tokens, exact, estimated, calls, {SHARE} from (select source, cast(sum(tokens) as bigint) as tokens, cast(sum(case when fidelity = 'exact' then tokens else 0 end) as bigint) as exact, cast(sum(case when fidelity = 'estimated' then tokens else 0 end) as bigint) as estimated, cast(sum(calls) as bigint) as calls from daily group by 1)")(a.source_mix)
add("a20_authority", ["receipts"], "select source, " + ", ".join(f"cast(sum(case when coalesce(authority, 'unrecorded') = '{x}' then tokens end) as bigint) as {x}" for x in ("estimated", "reconstructed", "tool", "provider", "unrecorded")) + " from receipts group by 1")(a.authority_split)
add("a21_origins", ["receipts"], f"select kind, origin, tokens, {SHARE} from (select case when origin like 'machine/%' then 'machine' when origin like 'account/%' then 'account' else 'unattributed' end as kind, coalesce(origin, 'unattributed') as origin, cast(sum(tokens) as bigint) as tokens from receipts group by 1, 2)")(a.origin_mix)
add("a22_weekday", ["daily"], T + " select dayofweek(day) + 1 as weekday, cast(sum(total) as bigint) as tokens, count(*) as active_days from t group by 1")(a.cadence)
add("a23_request_size", ["daily"], ", x as (select log10(sum(tokens) / sum(calls)) as l from daily where calls > 0 group by day), s as (select min(l) lo, max(l) hi, count(*) n from x) select cast(least(7, floor((l - lo) / case when hi > lo then (hi - lo) / 8 else 1 end)) as int) as bin, count(*) as days from x, s where n >= 2 group by 1")(a.request_sizes)
add("a24_coverage", ["daily"], T + ", g as (select count(*) as missing_days from range(date '1997-01-01', date '1998-12-31' + interval 1 day, interval 1 day) r(x) where cast(x as date) not in (select day from t)) select source, count(distinct day) as days, cast(sum(tokens) as bigint) as tokens, max(day) as last_day, any_value(missing_days) as missing_days from daily, g where day between date '1997-01-01' and date '1998-12-31' group by 1")(
    lambda d: a.coverage_report(d, "1997-01-01", "1998-12-31"))
add("a25_freshness", ["daily"], "select source, min(day) as first_day, max(day) as last_day, case when date '1998-08-05' - max(day) <= 1 then 'current' when date '1998-08-05' - max(day) <= 7 then 'recent' else 'older' end as age from daily group by 1")(
    lambda d: a.freshness(d, "1998-08-05"))
add("a27_bounds", ["daily"], "select source, min(day) as first_day, max(day) as last_day from daily group by 1")(a.observed_intervals)
CHECKS = [
    ("future", "select 1 from daily where day > date '1998-01-01'", "FAIL"), ("before_window", "select 1 from daily where day < date '1992-02-01'", "FAIL"), ("duplicate_entry", "select 1 from daily group by day, source having count(*) > 1", "FAIL"),
    ("unsupported_zero", "select 1 from daily where tokens = 0 and coalesce(calls, 0) = 0", "FAIL"), ("adjacent_duplicate", "select 1 from (select *, lag(day) over w as pd, lag(tokens) over w as pt, lag(calls) over w as pc from daily window w as (partition by source order by day)) where day - pd = 1 and tokens = pt and calls is not distinct from pc", "FAIL"),
    ("unreviewed", "select 1 from daily where driver is null or driver = 'unreviewed'", "WARN"), ("open_week", "select 1 from daily where day >= date '1998-01-01' - cast(dayofweek(date '1998-01-01') as int)", "WARN"),
]
add("a29_evaluate", ["daily"], " union all ".join(f"select '{n}' as \"check\", count(*) as count, case when count(*) = 0 then 'ok' else '{v}' end as verdict from ({q})" for n, q, v in CHECKS))(
    lambda d: a.evaluate(d, "1998-01-01", "1992-02-01"))
add("a30_validate", ["daily"], "select rule, day, source from (select 'date' as rule, * from daily where day > date '1998-01-01' or day < date '1992-02-01' union all select 'driver', * from daily where driver is null union all select 'calls', * from daily where calls < 0 union all select 'source', * from daily where not regexp_matches(source, '^[a-z][a-z0-9_]*$') union all select 'tokens', * from daily where tokens < 0)")(
    lambda d: a.validate_dataset(d, "1998-01-01", "1992-02-01"))
add("t5_findings", ["daily"], ", e as (select source, day, tokens from daily where driver is null) select * from (select source, day, row_number() over (partition by source order by day, tokens) as place, count(*) over (partition by source) as total from e) where place <= 12")(
    lambda d: limit_findings(d.where("driver is null").select("source", "day", "tokens"), 12, "source", ["day", "tokens"]).select("source", "day", "place", "total"))
add("a31_synthetic", ["daily"], "select count(case when day not between date '1993-01-01' and date '1997-12-31' then 1 end) as outside, count(case when origin not in ('machine/c0', 'machine/c1') then 1 end) as foreign_origin, greatest(0, count(*) - 5000) as beyond_limit from daily")(
    lambda d: a.synthetic_check(d, "1993-01-01", "1997-12-31", ["machine/c0", "machine/c1"], 5000))
add("j14_calendar", ["daily"], T + ", c as (select cast(x as date) as day from range(date '1998-07-01', date '1998-09-30' + interval 1 day, interval 1 day) r(x)) select c.day, t.total, t.total is null as gap from c left join t using (day)")(
    lambda d: a.with_gaps(d, "1998-07-01", "1998-09-30"))
IV = ", iv as (select source, date_trunc('month', day) as m, min(day) as f, max(day) as t, case when month(any_value(day)) % 4 = 1 then 'known_empty' else 'covered' end as status from daily where month(day) % 2 = 1 group by 1, 2)"


def _intervals(d):
    odd = d.where(F.month("day") % 2 == 1)
    return odd.groupBy("source", F.trunc("day", "month").alias("m")).agg(F.min("day").alias("from"), F.max("day").alias("to"), F.when(F.month(F.min("day")) % 4 == 1, "known_empty").otherwise("covered").alias("status"))


add("j15_interval_join", ["daily"], IV + ", c as (select cast(x as date) as day from range(date '1994-01-01', date '1994-12-31' + interval 1 day, interval 1 day) r(x)) select iv.source, c.day, max(case status when 'covered' then 3 when 'known_empty' then 2 else 1 end) as rank from iv join c on c.day between iv.f and iv.t group by 1, 2")(
    lambda d: a.interval_days(_intervals(d), "1994-01-01", "1994-12-31"))
add("j15_interval_join_all", ["daily"], IV + ", " + DAYS + " select iv.source, c.day, max(case status when 'covered' then 3 when 'known_empty' then 2 else 1 end) as rank from iv join c on c.day between iv.f and iv.t group by 1, 2")(
    lambda d: a.interval_days(_intervals(d), *_bounds(d)))
add("j16_missing", ["daily"], IV + " select source, count(*) as days from daily d where not exists (select 1 from iv where iv.source = d.source and iv.status = 'covered' and d.day between iv.f and iv.t) group by 1")(
    lambda d: a.missing_coverage(d, _intervals(d)))
add("j17_reference", ["daily"], "select count(*) as shared from daily where day(day) % 2 = 1")(
    lambda d: a.reference_overlap(d, d.withColumn("tokens", F.col("tokens") + (F.dayofmonth("day") % 2 == 0).cast("int"))))
add("t2_latest30", ["daily"], T + " select day, total, case when count(*) over w = 7 then cast(floor(sum(total) over w / 7 + 0.5) as bigint) end as average from t window w as (order by day range between interval 6 day preceding and current row) order by day desc limit 30")(a.latest_days)
add("t3_top5", ["daily"], ", r as (select concat_ws('/', source, driver) as name, cast(sum(tokens) as bigint) as tokens from daily group by source, driver) select name, cast(sum(tokens) as bigint) as tokens from (select case when row_number() over (order by tokens desc, name) <= 5 then name else 'other' end as name, tokens from r) group by 1")(a.top_drivers)
