"""Increases across batches: late rows are put in order, and a session is forgotten after a while."""

import datetime
import itertools

from tallyhouse.streaming import streams as s

T0 = datetime.datetime(2024, 1, 1)
SCHEMA = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def test_late_rows_and_forgotten_sessions(spark, tmp_path):
    hours = lambda h: T0 + datetime.timedelta(hours=h)
    # (batch, event, session, hour, counter): event 3 comes a batch late, but within the delay; 9 comes after four days
    rows = [(0, 1, 7, 0, 10), (0, 2, 7, 30, 40), (0, 4, 8, 5, 3), (1, 3, 7, 20, 25), (1, 5, 7, 60, 41), (2, 6, 8, 70, 5), (2, 7, 7, 75, 2), (3, 9, 8, 170, 9), (3, 10, 7, 171, 1), (4, 11, 9, 400, 1)]
    for batch, group in itertools.groupby(rows, key=lambda r: r[0]):
        df = spark.createDataFrame([(e, hours(h), u, "view", 1.0, f'{{"k": {k}}}') for _, e, u, h, k in group], SCHEMA).coalesce(1)
        df.write.mode("append").parquet(f"{tmp_path}/in/b{batch}")
    stream = spark.readStream.schema(SCHEMA).option("recursiveFileLookup", True).option("maxFilesPerTrigger", 1).parquet(f"file://{tmp_path}/in")
    from pyspark.sql import functions as F

    calls = stream.select("event_id", F.col("ts").cast("timestamp").alias("ts"), F.col("user_id").alias("session"), F.regexp_extract("props", "([0-9]+)", 1).cast("bigint").alias("k"))
    got = {(r.session, r.event_id): (r.fresh, r.d_k) for r in s.run_available(s.ordered_increments(calls, "2 days", forget_days=4), "ordered").collect()}
    want, last = {}, {}
    for _, e, u, h, k in sorted(rows, key=lambda r: (r[3], r[1])):
        if h >= 400 - 48:
            continue  # the watermark has not passed it
        known = last.get(u)
        fresh = known is None or k < known[0] or h - known[1] > 96
        want[u, e] = (fresh, k if fresh else k - known[0])
        last[u] = (k, h)
    assert got == want and got[7, 3] == (False, 15) and got[7, 2] == (False, 15) and got[8, 9] == (True, 9)


def test_sessions_share_buckets(spark, tmp_path):
    """300 rows of 30 sessions in two buckets, in order within a millisecond."""
    rows = [(e, T0 + datetime.timedelta(hours=e % 50, microseconds=299 - e), e % 30, "view", 1.0, f'{{"k": {e * 7 % 90}}}') for e in range(300)]
    rows.append((300, T0 + datetime.timedelta(days=9), 99, "view", 1.0, '{"k": 1}'))
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(f"{tmp_path}/in")
    out = s.run_available(s.ordered_increments(s.capture_stream(spark, f"file://{tmp_path}/in", "*.parquet"), buckets=2), "bucketed").collect()
    want, last = {}, {}
    for e, _, u, *_ in sorted(rows[:300], key=lambda r: (r[1], r[0])):
        k = e * 7 % 90
        fresh = u not in last or k < last[u]
        want[u, e] = (fresh, k if fresh else k - last[u])
        last[u] = k
    assert {(r.session, r.event_id): (r.fresh, r.d_k) for r in out} == want and len(out) == 300
