"""The whole order of a ledger, taken by ranges."""

from tallyhouse.operators import ledger
from tallyhouse.plans import registry


def test_ledger_order_has_every_entry(spark):
    rows = [(f"s{i % 3}", f"r{i * 7919 % 500:03}", i) for i in range(500)] + [("s1", "r0", None), ("s1", "r0", 4)]
    df = spark.createDataFrame(rows, "scope string, request_id string, v long").repartition(7)
    got = sorted(ledger.order_ledger(df, ["scope", "request_id"]).collect())
    assert [r.place for r in got] == list(range(1, 503))
    assert [(r.scope, r.request_id) for r in got] == sorted((a, b) for a, b, _ in rows)
    all_keys = registry.queries()["t1_ledger_order_all"](spark, "/root/testdata/sf0.001")
    assert all_keys.count() == all_keys.select("place").distinct().count() > 100
