"""Registered queries: streams over the events table, run until nothing is left."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyhouse.plans.registry import register
from tallyhouse.streaming import streams as s

K = "cast(regexp_extract(props, '([0-9]+)', 1) as bigint)"
CLOSED = "(select max(ts) - interval 2 day from events)"


def _add(name, make, sql, after=lambda df: df):
    register(name, lambda spark, sf_dir: after(s.run_available(make(s.capture_stream(spark, sf_dir)), name)), sql)


_add("x1_capture_stream", lambda c: c.select("event_id", "session", "source", "k"), f"select event_id, user_id as session, event_type as source, {K} as k from events")
_add("x2_daily_stream", s.daily_stream, f"select * from (select cast(ts as date) as day, event_type as source, count(*) as calls, cast(sum(cast(floor(value * 10) as bigint)) as bigint) as tokens from events group by 1, 2) where day + 1 <= {CLOSED}")
_add("x3_week_stream", s.week_stream, f"select * from (select cast(ts as date) - cast(dayofweek(cast(ts as date)) as int) as week, count(*) as calls from events group by 1) where week + 7 <= {CLOSED}")
_add("x4_dedupe_stream", s.dedupe_stream, f"select distinct concat_ws(':', event_type, user_id, {K}) as response_id from events")
_add("x5_state_stream", s.increments_stream, f"select session, event_id, (b is null or k < b) as fresh, case when b is null or k < b then k else k - b end as d_k from (select user_id as session, event_id, {K} as k, lag({K}) over (partition by user_id order by ts, event_id) as b from events)")
_add("x5_ordered_stream", s.ordered_increments, f"select session, event_id, fresh, d_k from (select session, event_id, ts, (b is null or k < b) as fresh, case when b is null or k < b then k else k - b end as d_k from (select user_id as session, event_id, ts, {K} as k, lag({K}) over (partition by user_id order by ts, event_id) as b from events)) where ts < {CLOSED}")
register("x6_late_side", lambda spark, sf_dir: (lambda sides: sides[0].groupBy("source").agg(F.count("*").alias("n")).withColumn("side", F.lit("on_time")).unionByName(sides[1].groupBy("source").agg(F.count("*").alias("n")).withColumn("side", F.lit("late"))))(s.late_side_tables(s.capture_stream(spark, sf_dir), "2024-01-25", 10)),
    "select event_type as source, case when cast(ts as date) < date '2024-01-25' - 10 then 'late' else 'on_time' end as side, count(*) as n from events group by 1, 2")
_add("x6_late_stream", lambda c: s.late_split(c, "2024-01-25", 10).select("event_id", "source", "late"), "select source, late, count(*) as n from (select event_type as source, cast(ts as date) < date '2024-01-25' - 10 as late from events) group by 1, 2", lambda df: df.groupBy("source", "late").agg(F.count("*").alias("n")))
