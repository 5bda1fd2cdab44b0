"""Receipt rules on hand-made rows."""

import datetime

from pyspark.sql import functions as F

from tallyhouse.operators import privacy, receipts

COST = "schema_version int, basis string, amount string, currency string, unit string, currency_basis string"


def test_costs(spark):
    good = (1, "openai_costs_day", "0.00700000", "usd", "major", "reported")
    rows = [(0, good), (1, None), (2, good[:2] + ("007",) + good[3:]), (3, (1, "other", "1", "US", "major", "reported")), (4, good[:4] + ("minor", "reported"))]
    df = spark.createDataFrame(rows, f"i int, cost struct<{COST.replace(' ', ':').replace(',:', ',')}>")
    got = {r.i: r.e for r in df.select("i", receipts.cost_errors(F.col("cost")).alias("e")).collect()}
    assert got == {0: [], 1: [], 2: ["amount"], 3: ["basis", "currency"], 4: ["unit"]}


def test_transport_becomes_api(spark):
    df = spark.createDataFrame([("s", "p", "native_api_capture", "p:1"), ("s", "p", "cli", "p:1"), ("s", "p", "tool_result_capture", None)], "source string, provider string, surface string, snapshot_key string")
    got = [(r.surface, r.capture_method) for r in receipts.normalize_receipts(df, "s", "p", "p:").collect()]
    assert got == [("api", "native_api_capture"), ("cli", None), ("tool_result_capture", None)]


def test_history_and_replay(spark):
    h = "key string, tokens long, calls long, history array<struct<tokens:bigint,calls:bigint>>"
    ledger = spark.createDataFrame([("a", 5, 2, []), ("b", 5, 2, [(7, 3)]), ("c", 5, 2, [])], h)
    new = spark.createDataFrame([("a", 6, 2), ("b", 7, 3), ("c", 9, 1)], "key string, tokens long, calls long")
    got = {r.key: (r.tokens, r.updated, len(r.history)) for r in receipts.append_history(ledger, new).collect()}
    assert got == {"a": (6, True, 1), "b": (5, False, 1), "c": (5, False, 0)}


def test_retirements_decisions_and_corrections(spark):
    retired = spark.createDataFrame([("a", "x"), ("b", "y"), ("c", "z")], "id string, superseded_by string")
    active = spark.createDataFrame([("x",), ("y",), ("y",)], "id string")
    assert {r.id for r in receipts.check_retirements(retired, active).collect()} == {"b", "c"}
    d = spark.createDataFrame([("s", "a", "additive", "2025-01-01", "e"), ("s", "b", "odd", None, " ")], "source string, account string, mode string, decided_on string, evidence string")
    assert [(r.account, r.errors) for r in receipts.decision_errors(d).collect()] == [("b", ["mode", "date", "evidence"])]
    o = spark.createDataFrame([("error", True), ("error", False), ("added", True)], "outcome string, ok boolean")
    assert [r.outcome for r in receipts.corrected(o, F.col("ok"), "typo", True).collect()] == ["updated", "error", "added"]
    assert [r.outcome for r in receipts.corrected(o, F.col("ok"), None, True).collect()] == ["error", "error", "added"]


def test_messages_intervals_and_sentences(spark):
    t = datetime.datetime(2025, 1, 4, 10)
    m = spark.createDataFrame([("s", "m", t, 1, 2), ("s", "m", t + datetime.timedelta(hours=1), 3, 4), ("s", "n", t, 0, None)], "source string, message_id string, ts timestamp, input long, output long")
    assert [(r.tokens, r.calls) for r in receipts.message_receipts(m, "input", "output").collect()] == [(7, 2)]
    day = lambda x: F.lit(x).cast("date")
    at, share = receipts.interval_position(day("2024-12-30"), day("2025-01-05"), day("2025-01-01"), day("2025-01-10"))
    assert spark.range(1).select(at, share).first()[:] == (0.0, 0.5)
    s = spark.createDataFrame([("f", "model", ["x", "x", "?"]), ("f", "unresolved", []), ("?", "model", [])], "driver string, method string, signals array<string>")
    got = [r.t for r in s.select(receipts.evidence_text(F.col("driver"), F.col("method"), F.col("signals"), {"f": "feature work"}, {"x": "commits"}).alias("t")).collect()]
    assert got == ["Automated classification: commits supported feature work", "No classified signal was available for this day", None]


def test_labels_and_lines(spark):
    p = spark.createDataFrame([("manual", 0.5, ["a"], "sha256:" + "0" * 64), ("odd", 2.0, [], "x")], "method string, confidence double, signals array<string>, digest string")
    assert [r.errors for r in privacy.provenance_errors(p).collect()] == [[], ["method", "confidence", "signals", "digest"]]
    j = spark.createDataFrame([('{"source":"s","extra":1,"correlation_keys":["nope"]}',), ('{"source":"s"}',)], "j string").select(F.parse_json("j").alias("receipt"))
    assert [r.findings for r in privacy.receipt_privacy(j, ["source", "correlation_keys"]).collect()] == [["unknown_field", "bad_digest"], []]
    iv = spark.createDataFrame([("s", "2025-01-01", "2025-01-02", "covered", "note")], "source string, from string, to string, status string, note string")
    shown, counts = privacy.public_view(iv, spark.createDataFrame([("s", "id")], "source string, identity string"))
    assert shown.columns == ["source", "from", "to", "status"] and counts.columns == ["source", "entries"]
