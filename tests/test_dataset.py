"""Committed versions: order, refusal of a stale base, writes that die, and import after import."""

import json

import pytest
from pyspark.sql import functions as F
from test_evidence import POLICY, D, E, found, importable, parts, small_frames  # noqa: F401

from tallyhouse.operators import evidence as ev
from tallyhouse.operators import imports as im
from tallyhouse.sources import dataset as ds


def tables(spark, *rows):
    daily = spark.createDataFrame([(d, s, "UTC", "writing", "e", t, None, "exact", "tool", "incomplete", ["gap"], parts(input_tokens=t), {"m/2": 1, "m/1": t - 1}) for d, s, t in rows], im.DAILY_SCHEMA)
    return daily, spark.createDataFrame([], ev.LEDGER_SCHEMA), spark.createDataFrame([("e1", "k")], ev.IDENTITY_SCHEMA)


def text(df):
    return sorted(json.dumps(r.asDict(True), default=str, sort_keys=True) for r in df.collect())


def test_versions_are_read_back(spark, tmp_path):
    root = f"file://{tmp_path}/set"
    assert ds.read_version(spark, root).number == 0 and ds.versions(spark, root) == []
    one, two = tables(spark, (E, "b", 7), (D, "a", 5), (D, "c", 4)), tables(spark, (D, "a", 6))
    assert ds.commit_version(spark, root, *one, base=0) == 1 and ds.commit_version(spark, root, *two, base=1) == 2
    newest, older = ds.read_version(spark, root), ds.read_version(spark, root, 1)
    assert (newest.number, older.number) == (2, 1) and text(newest.daily) == text(two[0]) and text(older.daily) == text(one[0])
    assert text(older.identities) == text(one[2]) and older.ledger.columns == one[1].columns
    with pytest.raises(ValueError, match="no version 9"):
        ds.read_version(spark, root, 9)
    days = ds.nested_days(one[0])
    assert [(r.date, r.total, sorted(r.sources)) for r in days.collect()] == [(D, 9, ["a", "c"]), (E, 7, ["b"])]


def test_one_of_two_writers_is_refused(spark, tmp_path, monkeypatch):
    root = f"file://{tmp_path}/set"
    ds.commit_version(spark, root, *tables(spark, (D, "a", 5)), base=0)
    with pytest.raises(ds.StaleBaseError):
        ds.commit_version(spark, root, *tables(spark, (D, "a", 6)), base=0)
    # both have seen version 1; the other one is faster
    ds.commit_version(spark, root, *tables(spark, (D, "a", 7)), base=1)
    with monkeypatch.context() as m:
        m.setattr(ds, "versions", lambda *_: [1])
        with pytest.raises(ds.StaleBaseError, match="another writer"):
            ds.commit_version(spark, root, *tables(spark, (D, "a", 8)), base=1)
    assert ds.read_version(spark, root).daily.first().tokens == 7 and ds.versions(spark, root) == [1, 2]


def test_a_write_that_dies_is_not_seen(spark, tmp_path):
    root = f"file://{tmp_path}/set"
    ds.commit_version(spark, root, *tables(spark, (D, "a", 5)), base=0)
    daily, ledger, ids = tables(spark, (D, "a", 6))
    dies = daily.withColumn("tokens", F.raise_error(F.lit("lost")).cast("bigint"))
    with pytest.raises(Exception, match="lost"):
        ds.commit_version(spark, root, dies, ledger, ids, base=1)
    assert ds.read_version(spark, root).number == 1 and ds.commit_version(spark, root, daily, ledger, ids, base=1) == 2


def test_import_write_read_import(spark, tmp_path):
    root = f"file://{tmp_path}/set"
    rows = {"r1": dict(keys=["a", "b"], token_components=parts(input_tokens=4)), "r2": dict(day=E, source="other", origin="m/2")}
    for turn, outcome in ((1, "added"), (2, "replay")):
        base = ds.read_version(spark, root)
        plan = im.plan_import(*importable(spark, rows), base.ledger, base.identities, base.daily, POLICY)
        assert found(plan) == [] and {r.outcome for r in plan.outcomes.collect()} == {outcome}
        assert ds.write_plan(spark, root, plan, base.number, dry_run=True) is None and ds.write_plan(spark, root, plan, base.number) == turn
    first, second = ds.read_version(spark, root, 1), ds.read_version(spark, root, 2)
    assert text(first.daily) == text(second.daily) and text(first.ledger) == text(second.ledger)
    late = im.plan_import(*importable(spark, {"r1": dict(fidelity="odd")}), first.ledger, first.identities, first.daily, POLICY)
    with pytest.raises(ValueError, match="contract fidelity"):
        ds.write_plan(spark, root, late, 2)
