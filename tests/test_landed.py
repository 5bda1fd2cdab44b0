"""From landed logs to receipts to daily rows: positions, malformed counters, forks, identities."""

import datetime
import json

import pytest
from pyspark.sql import functions as F
from test_evidence import POLICY, found, small_frames  # noqa: F401

from tallyhouse.operators import evidence as ev
from tallyhouse.operators import imports as im
from tallyhouse.operators import landed
from tallyhouse.sources import lines

ME = landed.Origin("p", "cli", "a", "m1", "machine/m1")


def put(folder, **files):
    for name, rows in files.items():
        path = folder / (name.replace("__", "/") + ".jsonl")
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text("".join((r if isinstance(r, str) else json.dumps(r)) + "\n" for r in rows))
    return f"file://{folder}"


def test_lines_are_numbered_over_splits(spark, tmp_path):
    texts = {n: [f"{n} {i} " + "x" * (i % 37) if i % 5 else "" for i in range(size)] for n, size in (("a", 3000), ("b", 1), ("c", 400))}
    for n, ls in texts.items():
        (tmp_path / f"{n}.txt").write_text("\n".join(ls) + ("\n" if n != "c" else ""))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        rows = lines.numbered_lines(spark, f"file://{tmp_path}")
        assert spark.read.text(f"file://{tmp_path}").select("_metadata.file_block_start").distinct().count() > 5
        got = {(r.file.rsplit("/", 1)[1][0], r.line_no): r.value for r in rows.collect()}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert got == {(n, i): v for n, ls in texts.items() for i, v in enumerate(ls, 1)}


def call(ts, rid=None, mid=None, uuid=None, model="m", **usage):
    return {"timestamp": f"2025-01-0{ts}:00:00Z", "requestId": rid, "uuid": uuid, "message": {"id": mid, "model": model, "usage": usage}}


FULL = dict(input_tokens=10, cache_creation_input_tokens=2, output_tokens=5, cache_read_input_tokens=100)


def test_transcripts_become_receipts(spark, tmp_path):
    path = put(tmp_path, one=[call("4T10", "r1", **FULL), call("4T11", "r1", **{**FULL, "output_tokens": 9}), "{broken", "", call("4T12", None, "m1", **FULL)], two__deep=[call("5T10", uuid="u1", **FULL), call("5T11", **FULL), {"timestamp": "x"}, call("6T10", "r3", input_tokens=0)])
    calls, errors = lines.transcript_calls(spark, path, "tool_a")
    assert [(r.file.rsplit("/", 1)[1], r.line_no) for r in errors.collect()] == [("one.jsonl", 3)]
    assert {r.identity: r.n for r in calls.groupBy("identity").agg(F.count("*").alias("n")).collect()} == {"request": 4, "line": 1, "position": 1}
    gates = lines.gate(calls, position=("file", "line_no"))
    assert gates.first().unknown is False
    receipts, ids = landed.transcript_days(lines.known_only(calls, gates), ME)
    got = {r.day.day: r for r in receipts.collect()}
    assert set(got) == {4, 5} and (got[4].tokens, got[4].calls, got[4].token_components.input_tokens, got[4].token_components.cached_input_tokens) == (38, 2, 224, 200) and got[5].tokens == 34
    assert ids.groupBy("receipt_id").count().collect()[0].asDict() == {"receipt_id": "tool_a:machine/m1:2025-01-04", "count": 2}
    # and on to daily rows; a second run says nothing new
    empty = [spark.createDataFrame([], s) for s in (ev.LEDGER_SCHEMA, ev.IDENTITY_SCHEMA, im.DAILY_SCHEMA)]
    first = im.plan_import(receipts, ids, *empty, POLICY)
    assert found(first) == [] and {(r.day.day, r.tokens, r.calls, r.by_origin["machine/m1"]) for r in first.daily.collect()} == {(4, 38, 2, 38), (5, 34, 2, 34)}


@pytest.mark.parametrize("bad", ['"10"', "6.5", "-1", "[]", "9007199254740992"])
def test_a_malformed_counter_makes_the_source_unknown(spark, tmp_path, bad):
    usage = json.dumps(call("4T10", "r1", **FULL)).replace(": 10,", f": {bad},")
    path = put(tmp_path / "t", one=[call("4T09", "r0", **FULL), usage])
    calls, _ = lines.transcript_calls(spark, path, "tool_a")
    row = lines.gate(calls, position=("file", "line_no")).first()
    assert row.unknown and row.n_bad == 1 and row.paths == ["$.message.usage.input_tokens"] and row.first_malformed.line_no == 2
    assert lines.known_only(calls, lines.gate(calls)).count() == 0


def shut(ts, event, requests=1, **usage):
    return {"type": "session.shutdown", "id": event, "timestamp": f"2025-01-0{ts}:00:00Z", "data": {"modelMetrics": {"m": {"requests": {"count": requests}, "usage": usage}}}}


def test_sessions_become_receipts(spark, tmp_path):
    path = put(tmp_path, s1__events=[shut("4T10", "e1", 2, inputTokens=100, outputTokens=10, cacheReadTokens=40), {"type": "other"}, shut("4T11", "e2", 3, inputTokens=150, outputTokens=20, cacheReadTokens=50), shut("5T10", "e3", 1, inputTokens=30, outputTokens=5), shut("5T11", "e4", 2, inputTokens=30, outputTokens=5)], s2__events=[{**shut("4T10", "e9", inputTokens=1000, outputTokens=1), "ephemeral": True}])
    totals, errors = lines.session_totals(spark, path, "tool_s")
    assert errors.count() == 0
    receipts, ids = landed.session_days(totals, ME)
    got = {r.day.day: (r.tokens, r.calls, r.token_components.input_tokens, r.token_components.cached_input_tokens) for r in receipts.collect()}
    assert got == {4: (60 + 10 + 40 + 10, 3, 150, 50), 5: (35, 1, 30, 0)} and ids.count() == 3
    bad, _ = lines.session_totals(spark, put(tmp_path / "bad", s1__events=[shut("4T10", "e1", inputTokens="7", outputTokens=1.5)]), "tool_s")
    assert lines.gate(bad).first().paths == ["$.usage.inputTokens", "$.usage.outputTokens"]


def test_reports_become_receipts(spark):
    d = datetime.datetime(2025, 1, 4, 10)
    rows = spark.createDataFrame([(d, "m", 100, 10, 40, 7, 3), (d, "n", 50, None, 0, 1, 2), (d + datetime.timedelta(days=1), "m", 0, 0, 0, 0, None)], "ts timestamp, model string, input long, cache_write long, cached long, output long, calls long")
    outside = {r.day.day: r for r in landed.report_days(rows, ME, "rep", inclusive=False)[0].collect()}
    assert set(outside) == {4} and (outside[4].tokens, outside[4].calls, outside[4].authority, outside[4].token_components.input_tokens, outside[4].token_components.output_tokens) == (168, 5, "provider", None, 8)
    inside = {r.day.day: (r.tokens, r.calls) for r in landed.report_days(rows, ME, "rep", inclusive=True)[0].collect()}
    assert inside == {4: (118, 5), 5: (0, None)}


def use(total, last=None, when="4T10", ordinal=None, **more):
    counts = lambda n: {"input_tokens": n, "output_tokens": n // 2, "cached_input_tokens": 0, "total_tokens": n + n // 2}
    r = {"timestamp": f"2025-01-0{when}:00:00Z", "type": "event_msg", "payload": {"type": "token_count", "info": {"total_token_usage": counts(total), "last_token_usage": counts(total if last is None else last)}}, **more}
    return r if ordinal is None else {**r, "ordinal": ordinal}


def meta(thread, **more):
    return {"timestamp": "2025-01-04T09:00:00Z", "type": "session_meta", "payload": {"id": thread, **more}}


def item(text, id=None):  # noqa: A002
    return {"timestamp": "2025-01-04T09:30:00Z", "type": "response_item", "payload": {"type": "message", "text": text, **({"id": id} if id else {})}}


def owned(thread):
    return {"timestamp": "2025-01-04T11:00:00Z", "type": "event_msg", "payload": {"type": "thread_settings_applied", "thread_id": thread}}


def later(rows):
    return [{**r, "timestamp": "2025-01-05T08:00:00Z"} for r in rows]


def test_forks(spark, tmp_path):
    parent = [meta("P"), item("hello", "x1"), use(10, ordinal=2), use(30, 20, ordinal=3), use(60, 30, ordinal=4)]
    plain = [{k: v for k, v in r.items() if k != "ordinal"} for r in parent]
    copied = later([plain[0], item("hello"), *plain[2:4]])  # one side without an id, other times, no ordinals
    rolls = {
        "P": parent,
        "by_ordinal": [meta("A", forked_from_id="P", forked_from_ordinal_exclusive=4), *copied, use(70, 40, "6T10")],
        "by_owner": [meta("B", forked_from_id="P"), *copied, owned("B"), use(70, 40, "6T10")],
        "unproven": [meta("C", forked_from_id="P"), *copied, use(70, 40, "6T10")],
        "other_owner": [meta("D", forked_from_id="P"), *copied, owned("Z"), use(70, 40, "6T10")],
        "whole_parent": [meta("E", forked_from_id="P", forked_from_ordinal_exclusive=5), *copied, *later(plain[4:]), use(70, 10, "6T10")],
        "referenced": [meta("F", forked_from_id="P", history_base={"a": 1}), use(70, 40, "6T10")],
        "orphan": [meta("G", forked_from_id="none"), use(70, 40, "6T10")],
        "lost": [meta("H", forked_from_id="none", history_base={"a": 1}), use(5, 5, "6T10")],
        "twin1": [meta("T"), use(1)], "twin2": [meta("T"), use(2)], "ambiguous": [meta("I", forked_from_id="T"), use(7, 7, "6T10")],
    }
    path = put(tmp_path, **rolls)
    records, metas, events, errors = lines.rollout_records(spark, path)
    from tallyhouse.operators import rollouts

    linked = rollouts.link_rollouts(metas)
    starts = metas.select(F.col("rollout").alias("parent"), F.col("meta_pos").alias("parent_from"))
    prefixes = rollouts.proven_prefixes(records, linked.join(starts, "parent", "left").withColumn("child_from", F.col("meta_pos") + 1))
    got = {r.rollout[:-6]: (r.until, r.matched, r.reason) for r in prefixes.collect()}
    # whole_parent's ordinals end at 4, right below its boundary, but the parent's first records have none
    assert got == {"by_ordinal": (5, 4, None), "by_owner": (5, 4, None), "unproven": (None, 4, "copied_fork_prefix_unverified"), "other_owner": (None, 4, "copied_fork_prefix_unverified"), "whole_parent": (None, 5, "copied_fork_prefix_unverified")}
    assert {r.rollout[:-6]: r.reason for r in linked.where("reason is not null").collect()} == {"orphan": "copied_fork_parent_missing", "lost": "referenced_fork_parent_missing", "ambiguous": "copied_fork_parent_ambiguous"}
    own = {k: [r.pos for r in rs] for k, rs in _by(rollouts.local_events(events, prefixes), "rollout")}
    assert own["by_ordinal.jsonl"] == [5] and own["by_owner.jsonl"] == [6] and len(own["unproven.jsonl"]) == 3 and own["P.jsonl"] == [2, 3, 4]
    days, ids = landed.fork_days(records, metas, events, ME, "tool_r")
    rows = {r.day.day: r for r in days.collect()}
    assert errors.count() == 0 and ids.count() == 0 and rows[6].coverage_reasons == ["copied_fork_parent_ambiguous", "copied_fork_parent_missing", "copied_fork_prefix_unverified", "referenced_fork_parent_missing"]
    # day 5: what the three unproven forks copied; day 4: the parent and the twins
    assert (rows[4].tokens, rows[4].calls, rows[4].coverage) == (60 + 30 + 1 + 2 + 1, 5, None) and rows[5].calls == 2 * 3 + 1 and rows[6].token_components.cached_input_tokens == 0


def _by(df, key):
    out: dict = {}
    for r in sorted(df.collect(), key=lambda r: r.pos):
        out.setdefault(r[key], []).append(r)
    return out.items()


def test_rollout_copies_resets_and_contradictions(spark, tmp_path):
    put(tmp_path, r1=[meta("A"), {"type": "turn_context", "payload": {"model": "big"}}, use(10), use(10), use(4, 4), "{bad"], odd=[meta("B"), use(3)])
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "r1.jsonl").write_text(json.dumps(meta("A")) + "\n" + json.dumps(use(999)) + "\n")
    bad = use(5)
    bad["payload"]["info"]["last_token_usage"]["cached_input_tokens"] = 6
    put(tmp_path, worse=[meta("C"), bad])
    records, metas, events, errors = lines.rollout_records(spark, f"file://{tmp_path}")
    assert metas.count() == 3 and [(r.rollout, r.line_no) for r in errors.collect()] == [("r1.jsonl", 6)]
    gates = {r.rollout: (r.n_rows, r.unknown) for r in lines.gate(events, by=("rollout",)).collect()}
    assert gates == {"r1.jsonl": (3, False), "odd.jsonl": (1, False), "worse.jsonl": (1, True)}
    from tallyhouse.operators import rollouts

    none = spark.createDataFrame([], "rollout string, first int, until int, matched bigint, reason string")
    own = rollouts.local_events(events.where("rollout = 'r1.jsonl'"), none)
    assert [(r.pos, r.reset, r.model) for r in sorted(own.collect(), key=lambda r: r.pos)] == [(2, False, "big"), (4, True, "big")]
