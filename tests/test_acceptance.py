"""Acceptance of receipts with many identities, case by case, and the whole import."""

import datetime

import pytest
from pyspark.sql import functions as F

from tallyhouse.operators import acceptance as a

SCHEMA = "receipt_id string, snapshot_key string, day date, source string, scope string, authority string, fidelity string, tokens long, calls long, keys array<string>"
D = datetime.date(2025, 1, 4)


def receipt(i, snap=None, keys=None, day=D, source="tool", scope="s", authority="tool", fidelity="exact", tokens=10, calls=2):
    return (i, snap, day, source, scope, authority, fidelity, tokens, calls, keys)


def frame(spark, rows, ledger=False):
    df = spark.createDataFrame(rows, SCHEMA)
    return df.withColumn("disposition", F.lit(None).cast("string")) if ledger else df


def test_identity_classes(spark):
    other = D + datetime.timedelta(days=1)
    rows = [receipt("free"), receipt("strong", keys=["a", "b"], authority="provider"), receipt("weak", keys=["b", "a", "a"]), receipt("part", keys=["c", "d"]), receipt("part2", keys=["d"]), receipt("d1", keys=["e"]), receipt("d2", keys=["e"], day=other), receipt("s1", keys=["f"]), receipt("s2", keys=["f"], scope="t"), receipt("q1", keys=["g"]), receipt("q2", keys=["g"]), receipt("alone", keys=["h"])]
    got = {r.receipt_id: (r.state, r.errors) for r in a.resolve_identities(frame(spark, rows)).collect()}
    assert got == {"free": ("free", ""), "strong": ("kept", ""), "weak": ("dropped", ""), "alone": ("kept", "")} | {k: ("error", e) for e, ks in {"partial": ("part", "part2"), "cross_date": ("d1", "d2"), "cross_scope": ("s1", "s2"), "equal_authority": ("q1", "q2")}.items() for k in ks}


def test_snapshots_are_merged_or_refused(spark):
    rows = [receipt("1", "a", ["x"]), receipt("2", "a", ["x", "y"], tokens=12, calls=3), receipt("3", "b", ["x", "z"]), receipt("4", "b", ["x"], tokens=12, calls=3), receipt("5", "c", tokens=5, calls=9), receipt("6", "c", tokens=9, calls=5), receipt("7", "d", source="u"), receipt("8", "d"), receipt("9", "e"), receipt("10", "e", ["k"])]
    df = frame(spark, rows).withColumn("coverage_reasons", F.when(F.col("receipt_id") == "9", F.array(F.lit("gap"))).when(F.col("receipt_id") == "10", F.array(F.lit("late"), F.lit("gap"))))
    df = df.withColumn("input", F.when(F.col("receipt_id") == "9", 4)).withColumn("output", F.when(F.col("snapshot_key") == "e", F.length("receipt_id")))
    got = {r.snapshot_key: r for r in a.reconcile_snapshots(df, components=("input", "output")).collect()}
    assert {k: r.errors for k, r in got.items()} == {"a": "", "b": "identity_loss", "c": "crossing", "d": "conflict", "e": "component"}
    assert (got["a"].tokens, got["a"].keys, got["e"].coverage_reasons, got["e"].input) == (12, ["x", "y"], ["gap", "late"], 4)


def test_outcomes(spark):
    ledger = [receipt("L1", "s1", ["a"]), receipt("L2", "s2", ["b", "c"]), receipt("L3", None, None, source="bare"), receipt("L4", "s4", ["d"]), receipt("L5", "s5", ["e"], tokens=50)]
    new = {
        "forward": (receipt("", "s1", ["a", "z"], tokens=11), "updated", ""), "same": (receipt("", "s1", ["a"]), "replay", ""), "behind": (receipt("", "s1", ["a"], tokens=9), "replay", ""),
        "cross": (receipt("", "s1", ["a"], tokens=11, calls=1), "error", "crossing"), "lost": (receipt("", "s1", [], tokens=11), "error", "identity_loss"), "moved": (receipt("", "s1", ["a"], scope="t"), "error", "snapshot_scope"),
        "thief": (receipt("", "s1", ["a", "d"], tokens=11), "error", "foreign_identity"), "stronger": (receipt("", "n1", ["c", "b"], authority="provider"), "promoted", ""), "weaker": (receipt("", "n2", ["b", "c"], authority="estimated"), "replay", ""),
        "equal": (receipt("", "n3", ["b", "c"], source="u"), "error", "equal_authority"), "partial": (receipt("", "n4", ["b"]), "error", "partial"), "two": (receipt("", "n5", ["a", "b"]), "error", "several_entries"),
        "scope": (receipt("", "n6", ["d"], scope="t", authority="provider"), "error", "cross_scope"), "lower": (receipt("", "n7", ["e"], authority="provider"), "error", "decrease"), "fixed": (receipt("", "n8", ["e"], authority="provider"), "promoted", ""),
        "bare_same": (receipt("", source="bare"), "replay", ""), "bare_new": (receipt("", source="bare", tokens=11), "error", "uncheckable"), "fresh": (receipt("", "n9", ["q"]), "added", ""),
    }
    rows = [(name, *r[1:]) for name, (r, _, _) in new.items()]
    fixes = spark.createDataFrame([("fixed", "reviewed"), ("lower", " ")], "receipt_id string, reason string")
    got = {r.receipt_id: (r.outcome, r.why, r.entry) for r in a.accept_receipts(frame(spark, ledger, True), frame(spark, rows), fixes).collect()}
    assert {k: v[:2] for k, v in got.items()} == {k: v[1:] for k, v in new.items()}
    assert (got["stronger"][2], got["forward"][2], got["fresh"][2], got["bare_new"][2]) == ("L2", "L1", None, "L3")


def test_dispositions(spark):
    ledger = frame(spark, [receipt(x) for x in "abcd"], True)
    decided = spark.createDataFrame([("a", "excluded"), ("b", "corrected-out"), ("c", "odd")], "receipt_id string, disposition string")
    assert {r.receipt_id for r in a.active(a.set_disposition(ledger, decided)).collect()} == {"c", "d"}


def whole(spark, rows):
    extra = {"origin": F.lit("machine/m"), "coverage": F.lit(None).cast("string"), "cached_input_tokens": F.lit(None).cast("long"), "input_tokens": F.lit(None).cast("long")}
    return frame(spark, rows).withColumns(extra)


def test_whole_import(spark, tmp_path):
    ledger = whole(spark, [receipt("L1", "s1", ["a"], authority="tool"), receipt("L2", "s2", ["b"], source="other", tokens=7)]).withColumn("disposition", F.lit(None).cast("string"))
    daily = spark.createDataFrame([(D, "tool", 10, 2, "exact"), (D, "other", 7, 2, "exact")], "day date, source string, tokens long, calls long, fidelity string")
    rows = [receipt("r1", "s1", ["a", "c"], tokens=15, calls=3), receipt("r1old", "s1", ["a"], tokens=12), receipt("r2", "p2", ["b"], source="api", authority="provider", tokens=9), receipt("r3", "open", ["x"], day=datetime.date(2025, 1, 20))]
    plan = a.import_receipts(whole(spark, rows), ledger, daily, "2025-01-20", "2024-12-01")
    assert plan.errors.collect() == []
    assert {(r.source, r.tokens) for r in plan.daily.collect()} == {("tool", 15), ("api", 9)}
    assert {(r.receipt_id, r.disposition, r.superseded_by) for r in plan.ledger.collect()} == {("L1", None, None), ("L2", "superseded", "r2"), ("r2", None, None)}
    assert a.write_import(plan, str(tmp_path), dry_run=True) is None and not list(tmp_path.iterdir())
    target = a.write_import(plan, str(tmp_path))
    assert spark.read.parquet(f"{target}/daily").count() == 2 and spark.read.parquet(f"{target}/ledger").count() == 3


def test_import_reports_every_kind_of_error(spark, tmp_path):
    ledger = whole(spark, [receipt("L1", "s1", ["a"]), receipt("L2", "s2", ["b"], source="other", tokens=7)]).withColumn("disposition", F.lit(None).cast("string"))
    daily = spark.createDataFrame([(D, "tool", 11, 2, "exact"), (D, "other", 7, 2, "exact")], "day date, source string, tokens long, calls long, fidelity string")
    settled = spark.createDataFrame([(D, "other", 8, 2)], "day date, source string, tokens long, calls long")
    rows = [receipt("bad", "v", tokens=-1), receipt("future", "w", day=datetime.date(2025, 3, 1)), receipt("x1", "x", tokens=5, calls=9), receipt("x2", "x", tokens=9, calls=5), receipt("p1", "y", ["m", "n"]), receipt("p2", "z", ["n"]), receipt("c", "s1", ["a"], tokens=20, calls=1), receipt("u", "s3", ["q"], source="tool", tokens=3)]
    plan = a.import_receipts(whole(spark, rows), ledger, daily, "2025-01-20", "2024-12-01", settled=settled, exclusions=settled)
    got = {(r.step, r.why) for r in plan.errors.collect()}
    assert {("validate", "tokens"), ("window", "date"), ("snapshot", "crossing"), ("identity", "partial"), ("accept", "crossing"), ("policy", "settled_and_excluded"), ("settled", "changed"), ("exclusion", "mismatch"), ("ledger", "differ")} <= got
    with pytest.raises(ValueError):
        a.write_import(plan, str(tmp_path))


def test_policy_overlap_is_a_set_of_pairs(spark):
    """Copies of a pair never meet each other, and a missing day equals a missing day, as in INTERSECT."""
    from tallyhouse.operators import ledger

    some = spark.range(60_000).selectExpr("case when id % 3 < 2 then id % 3 end as day", "'s' as source")
    other = spark.range(60_000).selectExpr("case when id % 3 < 2 then 1 + id % 3 end as day", "'s' as source")
    assert sorted((r.day, r.source) for r in ledger.policy_overlap(some, other).where("day is not null").collect()) == [(1, "s")]
    assert ledger.policy_overlap(some, other).where("day is null").count() == 1
