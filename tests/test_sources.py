"""Readers over small hand-made files."""

import gzip
import json

import pyarrow as pa
from pyspark.sql import functions as F

from tallyhouse.sources import logs


def lines(path, items):
    path.write_text("\n".join(i if isinstance(i, str) else json.dumps(i) for i in items) + "\n")
    return str(path)


def test_receipts_tell_missing_zero_and_malformed_apart(spark, tmp_path):
    base = {"schema_version": 2, "date": "2025-01-04", "source": "tool", "tokens": 4200, "calls": 0, "fidelity": "exact"}
    p = lines(tmp_path / "r.jsonl", [base, {k: v for k, v in base.items() if k != "calls"}, base | {"tokens": "10"}, base | {"calls": 6.5}, "not json", '{"tokens": 1, "provider_reported_cost": {"amount": 0.00700000}}'])
    good, bad = logs.read_receipts(spark, p)
    assert {(r.tokens, r.calls) for r in good.collect() if r.source} == {(4200, None), (4200, 0)}
    assert bad.count() == 3
    assert [r.cost_amount for r in good.where("cost_amount is not null").collect()] == ["0.00700000"]


def test_dataset_goes_long(spark, tmp_path):
    (tmp_path / "d.json").write_text(json.dumps([{"date": "2025-01-04", "timezone": "UTC", "total": 6, "driver": "x", "evidence": "e", "sources": {"a": {"tokens": 4, "calls": 1, "fidelity": "exact", "by_origin": {"machine/m": 4}}, "b": {"tokens": 2, "fidelity": "estimated"}}}]))
    got = {r.source: (r.tokens, r.calls) for r in logs.read_dataset(spark, str(tmp_path / "d.json")).collect()}
    assert got == {"a": (4, 1), "b": (2, None)}


def test_transcripts(spark, tmp_path):
    use = {"input_tokens": 5, "cache_creation_input_tokens": 1, "cache_read_input_tokens": 0, "output_tokens": 7}
    lines(tmp_path / "t.jsonl", [{"uuid": "u", "requestId": "r", "timestamp": "2025-01-04T10:00:00Z", "message": {"id": "m", "model": "x", "usage": use}}, {"uuid": "v", "timestamp": "2025-01-04T10:00:00Z", "message": {"usage": use | {"input_tokens": "5"}}}, {"type": "note"}])
    got = logs.read_transcripts(spark, str(tmp_path)).orderBy("uuid").collect()
    assert [(r.request_id, r.input, r.cache_write, r.output, r.malformed) for r in got] == [("r", 5, 1, 7, False), (None, None, 1, 7, True)]


def test_compressed_copy_of_a_rollout_is_ignored(spark, tmp_path):
    item = {"timestamp": "2025-01-04T10:00:00Z", "type": "event_msg", "payload": {"type": "token_count", "info": {"total_token_usage": {"total_tokens": 9}}}}
    lines(tmp_path / "a.jsonl", [item])
    for name in ("a.jsonl.zst", "b.jsonl.zst"):
        with pa.CompressedOutputStream(str(tmp_path / name), "zstd") as out:
            out.write((json.dumps(item) + "\n").encode())
    got = logs.read_rollouts(spark, str(tmp_path)).collect()
    assert sorted(r.base for r in got) == ["a.jsonl", "b.jsonl"] and {r.total for r in got} == {9}


def test_session_totals_and_chat_sessions(spark, tmp_path):
    (tmp_path / "s").mkdir(), (tmp_path / "c").mkdir()
    lines(tmp_path / "s/s.jsonl", [{"type": "session.shutdown", "id": "e", "timestamp": "2025-01-04T10:00:00Z", "data": {"modelMetrics": {"m": {"requests": {"count": 2}, "usage": {"inputTokens": 3, "outputTokens": 4}}}}}, {"type": "other"}])
    assert [(r.model, r.requests, r.input, r.cached) for r in logs.read_session_totals(spark, str(tmp_path / "s")).collect()] == [("m", 2, 3, None)]
    message = {"id": "i", "type": "gemini", "timestamp": "2025-01-04T10:00:00Z", "tokens": {"input": 1, "output": 2, "thoughts": 3}}
    lines(tmp_path / "c/a.jsonl", [message, {"type": "user"}])
    (tmp_path / "c/b.json").write_text(json.dumps({"messages": [message]}))
    assert [(r.input, r.thoughts, r.cached) for r in logs.read_chat_sessions(spark, str(tmp_path / "c")).collect()] == [(1, 3, None)] * 2


def test_task_messages_and_key_values(spark, tmp_path):
    (tmp_path / "t.json").write_text(json.dumps([{"ts": 1735985000000, "type": "say", "say": "api_req_started", "text": json.dumps({"tokensIn": 1, "tokensOut": 2, "cacheWrites": 0, "cacheReads": 0})}, {"say": "text", "text": "x"}]))
    assert [(r.input, r.output) for r in logs.read_task_messages(spark, str(tmp_path)).collect()] == [(1, 2)]
    kv = spark.createDataFrame([("bubbleId:a:b", '{"tokenCount":{"inputTokens":3,"outputTokens":0}}'), ("bubbleId:a:c", '{"tokenCount":{"inputTokens":0,"outputTokens":0}}'), ("x", "{}")], "key string, value string")
    assert [r.input for r in logs.messages_from_kv(kv).collect()] == [3]


def test_threads_responses_and_digests(spark):
    packed = pa.compress(b'{"a":1}', "zstd", asbytes=True)
    t = spark.createDataFrame([("1", "zstd", packed), ("2", "plain", b'{"b":2}'), ("3", "zstd", b"junk")], "id string, data_type string, data binary")
    assert {r.id: r.json for r in logs.decode_threads(t).collect()} == {"1": '{"a":1}', "2": '{"b":2}', "3": None}
    text = spark.createDataFrame([('log {"a": {"b": 1}} more {bad} {"c": 2}',), (None,)], "t string")
    assert [r.json for r in logs.responses_from_text(text, "t").collect()] == ['{"a": {"b": 1}}', '{"c": 2}']
    d = spark.createDataFrame([('{"a":1,"b":{"c":2,"d":3}}', '{"b":{"d":3,"c":2},"a":1}')], "x string, y string")
    assert d.select((logs.response_digest(F.col("x")) == logs.response_digest(F.col("y"))).alias("same")).first().same
    r = spark.createDataFrame([('{"id":"i","model":"m","usage":{"prompt_tokens":1,"completion_tokens":2,"total_tokens":5}}',)], "j string").select(F.parse_json("j").alias("v"))
    got = logs.read_responses(r, "search").first()
    assert (got.prompt, got.completion, got.total) == (1, 2, 5)


def test_exports_and_reports(spark, tmp_path):
    (tmp_path / "m.json").write_text(json.dumps([{"id": "c", "create_time": 1735985000.0, "mapping": {"n": {"id": "n", "message": {"id": "k", "author": {"role": "user"}, "content": {"parts": ["ab", "c"]}}}, "root": {"id": "root"}}}]))
    assert [(r.role, r.text) for r in logs.read_export_mapping(spark, str(tmp_path / "m.json")).collect()] == [("user", "abc")]
    (tmp_path / "e.json").write_text(json.dumps([{"uuid": "u", "chat_messages": [{"uuid": "x", "sender": "human", "created_at": "2025-01-04T10:00:00Z", "text": "plain", "content": [{"type": "text", "text": "part"}], "attachments": [{"extracted_content": "!"}]}]}]))
    assert [(r.role, r.text) for r in logs.read_export_messages(spark, str(tmp_path / "e.json")).collect()] == [("human", "part!")]
    a = lines(tmp_path / "a.jsonl", [{"data": [{"starting_at": "2025-01-04T00:00:00Z", "results": [{"model": "m", "uncached_input_tokens": 5, "cache_creation": {"x": 1, "y": 2}, "cache_read_input_tokens": 0, "output_tokens": 3}]}]}])
    assert [(r.input, r.cache_write, r.output) for r in logs.read_usage_pages(spark, a, "a").collect()] == [(5, 3, 3)]
    b = lines(tmp_path / "b.jsonl", [{"data": [{"start_time": 1735948800, "results": [{"model": "m", "input_tokens": 5, "num_model_requests": 2}]}]}])
    assert [(r.input, r.output, r.calls) for r in logs.read_usage_pages(spark, b, "b").collect()] == [(5, None, 2)]
    c = lines(tmp_path / "c.jsonl", ['{"starting_at": "2025-01-04", "results": [{"amount": "12.3400", "currency": "usd"}]}', '{"starting_at": "2025-01-05", "results": [{"amount": "1"}, {"amount": "2"}]}'])
    assert [(str(r.day), r.amount, r.currency) for r in logs.read_cost_pages(spark, c).collect()] == [("2025-01-04", "12.3400", "USD")]


def test_gzip_lines_are_read(spark, tmp_path):
    with gzip.open(tmp_path / "z.jsonl.gz", "wt") as f:
        f.write('{"a": 1}\n')
    assert logs.json_lines(spark, str(tmp_path)).count() == 1


def test_responses_are_parsed_once(spark):
    """The condition on cached input is not pushed to where every use of a counter parses the response again."""
    v = F.parse_json(F.concat(F.lit('{"id":"'), F.col("id").cast("string"), F.lit('","usage":{"prompt_tokens":5,"prompt_cache_hit_tokens":'), F.col("id").cast("string"), F.lit("}}")))
    out = logs.read_responses(spark.range(9).select(v.alias("v")), "compatible")
    assert sorted((r.id, r.cached) for r in out.collect()) == [(str(k), k) for k in range(6)]
    assert out._jdf.queryExecution().optimizedPlan().toString().count('{"id":"') == 1
