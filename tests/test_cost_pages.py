"""Cost pages: one result a day, digits as written; and receipts that fail by file and line."""

import json

from tallyhouse.sources import logs


def test_pages_of_both_shapes(spark, tmp_path):
    a = {"data": [{"starting_at": "2025-01-04T00:00:00Z", "results": [{"amount": "0.00700000", "currency": "usd"}]}, {"starting_at": "2025-01-05T00:00:00Z", "results": [{"amount": "1", "currency": "usd"}, {"amount": "2", "currency": "usd"}]}, {"starting_at": "2025-01-06T00:00:00Z", "results": []}, {"starting_at": "2025-01-07T00:00:00Z", "results": [{"amount": "3.10", "currency": "usd"}]}]}
    (tmp_path / "a.jsonl").write_text(json.dumps(a) + "\n")
    got = {r.day.day: (r.amount, r.currency) for r in logs.read_cost_pages(spark, f"file://{tmp_path}/a.jsonl", "a").collect()}
    assert got == {4: ("0.00700000", "USD"), 7: ("3.10", "USD")}
    b = '{"data": [{"start_time": 1735948800, "results": [{"amount": {"value": 12.50, "currency": "usd"}}]}, {"start_time": 1736035200, "results": [{"amount": {"value": 1e-3, "currency": "eur"}}]}]}'
    (tmp_path / "b.jsonl").write_text(b + "\n" + '{"data": [{"start_time": 1736121600, "results": [{"amount": {"currency": "usd"}}]}]}' + "\n")
    got = {r.day.day: (r.amount, r.currency) for r in logs.read_cost_pages(spark, f"file://{tmp_path}/b.jsonl", "b").collect()}
    assert got == {4: ("12.50", "USD"), 5: ("1e-3", "EUR")}


def test_failing_receipts_are_named_by_line(spark, tmp_path):
    (tmp_path / "r.jsonl").write_text('{"tokens": 5}\n\n{"tokens": "5"}\nno json\n{"tokens": 6}\n')
    good, bad = logs.read_receipts(spark, f"file://{tmp_path}")
    assert sorted(r.tokens for r in good.collect()) == [5, 6] and sorted((r.file.rsplit("/", 1)[1], r.line_no) for r in bad.collect()) == [("r.jsonl", 3), ("r.jsonl", 4)]
