"""Rules that no driver table shows: order, ties, streams against batches."""

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tallyhouse.functions import usage as u
from tallyhouse.operators import daily, extract, ledger
from tallyhouse.streaming import streams

VERSIONS = st.lists(st.tuples(st.integers(0, 5), st.integers(0, 5)), min_size=1, max_size=8)


@settings(max_examples=8, deadline=None)
@given(VERSIONS)
def test_dominance_is_free_of_order(spark, versions):
    make = lambda rows: spark.createDataFrame([("k", t, c) for t, c in rows], "key string, tokens long, calls long")
    one, two = (ledger.dominant_snapshot(make(rows)).first() for rows in (versions, versions[::-1]))
    assert one == two
    crossing = any(a[0] < b[0] and a[1] > b[1] for a in versions for b in versions)
    assert one.conflict == crossing


def test_absent_component_is_not_zero(spark):
    rows = spark.createDataFrame([("a", 1), ("a", None), ("b", 2), ("b", 3)], "g string, x long")
    got = {r.g: r.s for r in rows.groupBy("g").agg(u.sum_if_complete(F.col("x")).alias("s")).collect()}
    assert got == {"a": None, "b": 5}


def test_table_convention(spark):
    rows = spark.createDataFrame([(None, None, 9, None), (None, None, 9, 1), (10, 2, None, 4), (10, 2, None, 0)], "i long, o long, t long, r long")
    cols = [F.col(c) for c in ("i", "o", "t", "r")]
    assert [r.x for r in rows.select(u.table_tokens(*cols, None).alias("x")).collect()] == [9, None, None, 12]
    assert [r.x for r in rows.select(u.table_tokens(*cols, "inclusive").alias("x")).collect()] == [9, None, 8, 12]


def test_dates_and_rounding(spark):
    rows = spark.createDataFrame([("2025-02-29",), ("2024-02-29",), ("2024-2-9",), (None,)], "d string")
    assert [r.x for r in rows.select(u.is_calendar_date(F.col("d")).alias("x")).collect()] == [False, True, False, False]
    assert spark.range(1).select(u.js_round(F.lit(-2.5)).alias("x")).first().x == -2


def test_prefix_of_a_fork(spark):
    records = spark.createDataFrame([(1, 0, "a"), (1, 1, "b"), (2, 0, "a"), (2, 1, "b"), (2, 2, "c"), (3, 0, "a"), (3, 1, "x")], "id long, pos long, value string")
    links = spark.createDataFrame([(2, 1), (3, 1)], "id long, parent long")
    assert {r.id: r.prefix for r in extract.inherited_prefix(records, links).collect()} == {2: 2, 3: 1}


def test_weakest_label_wins(spark):
    rows = spark.createDataFrame([("d", "s", 1, 1, "exact", "tool", None), ("d", "s", 2, None, "estimated", "provider", "incomplete")], "day string, source string, tokens long, calls long, fidelity string, authority string, coverage string")
    got = daily.aggregate_entries(rows).first()
    assert (got.tokens, got.calls, got.fidelity, got.authority, got.coverage) == (3, 1, "estimated", "tool", "incomplete")


def test_stream_over_several_files_equals_batch(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet").orderBy("ts", "event_id")
    n = events.count()
    rows = events.collect()
    for i in range(3):
        spark.createDataFrame(rows[i * n // 3 : (i + 1) * n // 3], events.schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    source = streams.capture_stream(spark, str(tmp_path / "in"), "*.parquet", per_trigger=1)
    got = streams.run_available(streams.increments_stream(source), "steps").select("session", "event_id", "fresh", "d_k")
    batch = events.select("event_id", "ts", F.col("user_id").alias("session"), F.regexp_extract("props", "([0-9]+)", 1).cast("bigint").alias("k"))
    want = extract.increments(batch).select("session", "event_id", "fresh", "d_k")
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0
