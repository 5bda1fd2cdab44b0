"""Registered queries: the given tables landed as the log formats that the readers take, and read again."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyhouse.functions import usage as u
from tallyhouse.operators import daily
from tallyhouse.plans.bindings import bind, duck
from tallyhouse.plans.registry import register
from tallyhouse.sources import logs
from tallyhouse.sources.scratch import shared_dir


def _add(name: str, needs: list[str], sql: str, make: Callable[..., DataFrame]) -> None:
    register(name, lambda spark, sf_dir: make(spark, *[bind(spark, sf_dir, n) for n in needs]), duck(*needs) + sql)


def _lines(df: DataFrame, line: Column) -> str:
    """One JSON text a line."""
    path = shared_dir(df.sparkSession, "landed")
    df.select(line.alias("value")).write.text(path)
    return path


def _documents(df: DataFrame, item: Column, size: int | None = 1 << 22) -> str:
    """JSON arrays of the items, a file each, ended by the item that brings them to ``size`` characters.

    Without a size every task writes one document, however long, an item a line. Rows stay in their tasks, and a task holds
    no more than the document that it writes.
    """
    path = shared_dir(df.sparkSession, "landed")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[str] = []
        length = 0
        for batch in batches:
            items = batch.column(0).to_pylist()
            if size is None:
                out = [f",{x}" for x in items]
                if out and not held:
                    held, out[0] = ["["], "[" + out[0][1:]
            else:
                out = []
                for x in items:
                    held.append(x)
                    length += len(x)
                    if length >= size:
                        out.append(f"[{','.join(held)}]")
                        held, length = [], 0
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], ["value"])
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(["]" if size is None else f"[{','.join(held)}]"])], ["value"])

    rows = df.select(F.to_json(item).alias("value")).mapInArrow(run, "value string")
    rows.write.option("maxRecordsPerFile", 0 if size is None else 1).text(path)
    return path


def _sessions(df: DataFrame, item: Column, name: str, size: int = 1 << 15) -> str:
    """JSON objects, a file each, whose field ``name`` is an array of ``size`` items, or the rest of a task."""
    path = shared_dir(df.sparkSession, "landed")
    rows = df.select(item.alias("item"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Array] = []
        n = 0
        for batch in batches:
            items = batch.column(0)
            while len(items):
                held.append(items.slice(0, size - n))
                items, n = items.slice(len(held[-1])), n + len(held[-1])
                if n == size:
                    yield packed(held)
                    held, n = [], 0
        if held:
            yield packed(held)

    def packed(held: list[pa.Array]) -> pa.RecordBatch:
        items = pa.concat_arrays(held)
        return pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array([0, len(items)], pa.int32()), items)], [name])

    rows.mapInArrow(run, f"{name} array<{rows.schema[0].dataType.simpleString()}>").write.option("maxRecordsPerFile", 1).json(path)
    return path


def _named(**columns: Column) -> Column:
    return F.struct(*[c.alias(n) for n, c in columns.items()])


def _s1(spark: SparkSession, c: DataFrame) -> DataFrame:
    common = {"schema_version": F.lit(2), "date": F.col("day").cast("string"), "source": F.col("source"), "calls": F.col("calls"), "fidelity": F.col("fidelity"), "correlation_keys": F.col("keys"), "provider_reported_cost": _named(amount=F.concat((F.col("tokens") % 90).cast("string"), F.lit(".5000")))}
    good, bad = F.to_json(_named(tokens=F.col("tokens"), **common)), F.to_json(_named(tokens=F.col("tokens").cast("string"), **common))
    rows, wrong = logs.read_receipts(spark, _lines(c, F.when(F.col("tokens") % 10 == 0, bad).otherwise(good)))
    read = rows.groupBy("date", "source", "fidelity").agg(F.count("*").alias("n"), F.sum("tokens").alias("tokens"), F.sum("calls").alias("calls"), F.sum(F.size(F.coalesce("correlation_keys", F.array().cast("array<string>")))).alias("keys"), F.max("cost_amount").alias("cost"))
    return read.unionByName(wrong.groupBy().agg(F.lit("refused").alias("date"), F.count("*").alias("n")), allowMissingColumns=True)


_add("s1_receipts", ["claims"], "select cast(day as varchar) as date, source, fidelity, count(*) as n, cast(sum(tokens) as bigint) as tokens, cast(sum(calls) as bigint) as calls, cast(sum(coalesce(len(keys), 0)) as bigint) as keys, max((tokens % 90) || '.5000') as cost from claims where tokens % 10 <> 0 group by 1, 2, 3 union all select 'refused', null, null, count(*), null, null, null, null from claims where tokens % 10 = 0", _s1)


def _s2(spark: SparkSession, d: DataFrame) -> DataFrame:
    entry = _named(tokens=F.col("tokens"), calls=F.col("calls"), fidelity=F.col("fidelity"), by_origin=F.create_map("origin", "tokens"))
    days = d.groupBy("day").agg(F.map_from_entries(F.collect_list(F.struct("source", entry))).alias("sources"), F.max("driver").alias("driver"), F.sum("tokens").alias("total"))
    item = _named(date=F.col("day").cast("string"), timezone=F.lit("UTC"), total=F.col("total"), driver=F.col("driver"), evidence=F.lit("e"), sources=F.col("sources"))
    return logs.read_dataset(spark, _documents(days, item)).select("date", "driver", "source", "tokens", "calls", "fidelity", F.map_keys("by_origin")[0].alias("origin"))


_add("s2_dataset", ["daily"], "select cast(day as varchar) as date, max(driver) over (partition by day) as driver, source, tokens, calls, fidelity, origin from daily", _s2)
_add("s3_dataset_sink", ["daily", "claims"], "select 'daily' as side, source, count(*) as n, cast(sum(tokens) as bigint) as tokens from daily group by 2 union all select 'ledger', source, count(*), cast(sum(tokens) as bigint) from claims group by 2",
     lambda spark, d, c: (lambda folder: spark.read.parquet(f"{folder}/daily").groupBy(F.lit("daily").alias("side"), "source").agg(F.count("*").alias("n"), F.sum("tokens").alias("tokens")).unionByName(spark.read.parquet(f"{folder}/ledger").groupBy(F.lit("ledger").alias("side"), "source").agg(F.count("*").alias("n"), F.sum("tokens").alias("tokens"))))(logs.write_dataset(d, c, shared_dir(spark, "dataset"))))


def _s4(spark: SparkSession, c: DataFrame) -> DataFrame:
    use = {"input_tokens": F.col("input"), "cache_creation_input_tokens": F.when(F.col("cache_write") > 0, F.col("cache_write")), "cache_read_input_tokens": F.col("cached")}
    line = lambda output: F.to_json(_named(requestId=F.col("request_id"), uuid=F.col("account"), timestamp=F.lit("2025-01-04T10:00:00Z"), message=_named(model=F.col("source"), usage=_named(output_tokens=output, **use))))
    rows = logs.read_transcripts(spark, _lines(c, F.when(F.col("output") % 50 == 0, line(F.col("output") + 0.5)).otherwise(line(F.col("output")))))
    return rows.groupBy("model", "malformed").agg(F.count("*").alias("n"), F.count_distinct("request_id").alias("ids"), F.sum("input").alias("input"), F.sum("cache_write").alias("cache_write"), F.count("cache_write").alias("written"), F.sum("cached").alias("cached"), F.sum("output").alias("output"))


_add("s4_transcripts", ["calls"], "select source as model, output % 50 = 0 as malformed, count(*) as n, count(distinct request_id) as ids, cast(sum(input) as bigint) as input, cast(sum(case when cache_write > 0 then cache_write end) as bigint) as cache_write, count(case when cache_write > 0 then 1 end) as written, cast(sum(cached) as bigint) as cached, cast(sum(case when output % 50 <> 0 then output end) as bigint) as output from calls group by 1, 2", _s4)
_add("s5_rollouts", ["counters"], "select event_id as ordinal, source as type, cast(session as varchar) as id, k as total, case when k % 3 = 0 then k % 5 end as last, case when k % 4 = 0 then 'p' || session end as parent from counters",
     lambda spark, c: logs.read_rollouts(spark, _lines(c, F.to_json(_named(timestamp=F.lit("2025-01-04T10:00:00Z"), ordinal=F.col("event_id"), type=F.col("source"), payload=_named(type=F.lit("token_count"), id=F.col("session").cast("string"), forked_from_id=F.when(F.col("k") % 4 == 0, F.concat(F.lit("p"), "session")), info=_named(total_token_usage=_named(total_tokens=F.col("k")), last_token_usage=F.when(F.col("k") % 3 == 0, _named(total_tokens=F.col("k") % 5)))))))).select("ordinal", "type", "id", "total", "last", "parent"))
_add("s6_session_totals", ["counters"], "select event_id, source as model, k as requests, amount as input, k + 1 as output, case when k % 2 = 0 then k end as cached from (select cast(event_id as varchar) as event_id, source, k, amount from counters)",
     lambda spark, c: logs.read_session_totals(spark, _lines(c, F.to_json(_named(type=F.lit("session.shutdown"), id=F.col("event_id").cast("string"), timestamp=F.lit("2025-01-04T10:00:00Z"), data=_named(modelMetrics=F.create_map("source", _named(requests=_named(count=F.col("k")), usage=_named(inputTokens=F.col("amount"), outputTokens=F.col("k") + 1, cacheReadTokens=F.when(F.col("k") % 2 == 0, F.col("k")))))))))).select("event_id", "model", "requests", "input", "output", "cached"))
_add("s7_chat_sessions", ["calls"], "select request_id as message_id, source as model, input, output, case when cached > 0 then cached end as cached, cache_write as thoughts from calls where account <> 'a2'",
     lambda spark, c: logs.read_chat_sessions(spark, _sessions(c, _named(id=F.col("request_id"), type=F.when(F.col("account") != "a2", "gemini").otherwise("user"), timestamp=F.lit("2025-01-04T10:00:00Z"), model=F.col("source"), tokens=_named(input=F.col("input"), output=F.col("output"), cached=F.when(F.col("cached") > 0, F.col("cached")), thoughts=F.col("cache_write"))), "messages")).select("message_id", "model", "input", "output", "cached", "thoughts"))
_add("s8_tasks", ["calls"], "select input, output, cache_write, cached, count(*) as n from calls where source <> 'tool_a' group by 1, 2, 3, 4",
     lambda spark, c: logs.read_task_messages(spark, _documents(c, _named(ts=F.lit(1735985000000), say=F.when(F.col("source") != "tool_a", "api_req_started").otherwise("text"), text=F.to_json(_named(tokensIn=F.col("input"), tokensOut=F.col("output"), cacheWrites=F.col("cache_write"), cacheReads=F.col("cached")))))).groupBy("input", "output", "cache_write", "cached").agg(F.count("*").alias("n")))
_add("s10_key_values", ["counters"], "select 'bubbleId:' || session || ':' || event_id as key, k as input, case when k % 2 = 0 then amount end as output, source as model from counters where session % 3 <> 0 and (k > 0 or (k % 2 = 0 and amount > 0))",
     lambda spark, c: logs.messages_from_kv(c.select(F.concat(F.when(F.col("session") % 3 != 0, "bubbleId:").otherwise("composer:"), "session", F.lit(":"), "event_id").alias("key"), F.to_json(_named(createdAt=F.lit("2025-01-04T10:00:00Z"), tokenCount=_named(inputTokens=F.col("k"), outputTokens=F.when(F.col("k") % 2 == 0, F.col("amount"))), modelInfo=_named(modelName=F.col("source")))).alias("value"))).select("key", "input", "output", "model"))


def _s11(spark: SparkSession, c: DataFrame) -> DataFrame:
    @F.pandas_udf("binary")
    def zstd(x: pd.Series) -> pd.Series:
        return x.map(lambda t: pa.compress(t.encode(), "zstd", asbytes=True))

    text = F.to_json(_named(total=F.col("k"), source=F.col("source")))
    kind = F.when(F.col("k") % 2 == 0, "zstd").otherwise("plain")
    packed = c.select(F.col("event_id").cast("string").alias("id"), kind.alias("data_type"), F.when(F.col("k") == 7, F.encode(F.lit("é"), "iso-8859-1")).when(F.col("k") % 2 == 0, zstd(text)).otherwise(F.encode(text, "utf-8")).alias("data"))
    return logs.decode_threads(packed).select(F.col("id").cast("bigint").alias("id"), F.get_json_object("json", "$.total").cast("bigint").alias("total"), F.get_json_object("json", "$.source").alias("source"))


_add("s11_threads", ["counters"], "select event_id as id, case when k <> 7 then k end as total, case when k <> 7 then source end as source from counters", _s11)
_add("s12_export_mapping", ["chat"], "select cast(conv_id as varchar) as id, conv_id || '-' || turn as message_id, role, case when turn % 2 = 0 then 'm' else 'd' end as model, case when turn % 3 = 0 then text else 'a' || text end as text from chat",
     lambda spark, c: logs.read_export_mapping(spark, _documents(c.groupBy("conv_id").agg(F.map_from_entries(F.collect_list(F.struct(F.concat_ws("-", "conv_id", "turn"), _named(message=_named(author=_named(role=F.col("role")), content=_named(parts=F.when(F.col("turn") % 3 != 0, F.array(F.lit("a"), F.col("text"))), text=F.col("text")), metadata=_named(model_slug=F.when(F.col("turn") % 2 == 0, "m"))))))).alias("mapping")), _named(id=F.col("conv_id").cast("string"), create_time=F.lit(1735985000.0), default_model_slug=F.lit("d"), mapping=F.col("mapping")))).select("id", "message_id", "role", "model", "text"))
_add("s13_export_messages", ["chat"], "select cast(conv_id as varchar) as uuid, cast(turn as varchar) as message_id, role, case when turn % 3 = 0 then text else 'a' || text end || case when turn % 2 = 0 then '!' else '' end as text from chat",
     lambda spark, c: logs.read_export_messages(spark, _documents(c.groupBy("conv_id").agg(F.collect_list(_named(uuid=F.col("turn").cast("string"), sender=F.col("role"), created_at=F.lit("2025-01-04T10:00:00Z"), text=F.col("text"), content=F.when(F.col("turn") % 3 != 0, F.array(_named(type=F.lit("thinking"), text=F.lit(None).cast("string"), thinking=F.lit("a")), _named(type=F.lit("text"), text=F.col("text"), thinking=F.lit(None).cast("string")))), attachments=F.when(F.col("turn") % 2 == 0, F.array(_named(extracted_content=F.lit("!")))))).alias("m")), _named(uuid=F.col("conv_id").cast("string"), chat_messages=F.col("m")))).select("uuid", "message_id", "role", "text"))
_add("s14_usage_pages", ["calls"], "select source as model, count(*) as n, cast(sum(input) as bigint) as input, cast(sum(case when cached % 3 = 0 then cache_write + 1 when cached % 3 = 1 then cache_write end) as bigint) as cache_write, count(case when cached % 3 < 2 then 1 end) as reported, cast(sum(output) as bigint) as output from calls group by 1",
     lambda spark, c: logs.read_usage_pages(spark, _lines(c.groupBy("day").agg(F.collect_list(_named(model=F.col("source"), uncached_input_tokens=F.col("input"), cache_creation=F.when(F.col("cached") % 3 == 0, F.create_map(F.lit("a"), F.col("cache_write"), F.lit("b"), F.lit(1).cast("bigint"))), cache_creation_input_tokens=F.when(F.col("cached") % 3 == 1, F.col("cache_write")), cache_read_input_tokens=F.col("cached"), output_tokens=F.col("output"))).alias("r")), F.to_json(_named(data=F.array(_named(starting_at=F.col("day").cast("string"), results=F.col("r")))))), "a").groupBy("model").agg(F.count("*").alias("n"), F.sum("input").alias("input"), F.sum("cache_write").alias("cache_write"), F.count("cache_write").alias("reported"), F.sum("output").alias("output")))
_add("s15_cost_pages", ["daily"], "select day, tokens || '.0700' as amount, 'USD' as currency from (select day, sum(tokens)::bigint as tokens, count(*) as n from daily group by 1) where tokens % 4 <> 0",
     lambda spark, d: logs.read_cost_pages(spark, _lines(d.groupBy("day").agg(F.sum("tokens").alias("tokens")), F.to_json(_named(starting_at=F.col("day").cast("string"), results=F.when(F.col("tokens") % 4 == 0, F.array_repeat(_named(amount=F.lit("1"), currency=F.lit("usd")), 2)).otherwise(F.array(_named(amount=F.concat(F.col("tokens").cast("string"), F.lit(".0700")), currency=F.lit("usd")))))))))
_add("s16_responses", ["calls"], "select source as model, count(*) as n, cast(sum(input) as bigint) as prompt, cast(sum(output) as bigint) as completion, cast(sum(case when cached % 2 = 0 then cached else cache_write end) as bigint) as cached from calls where case when cached % 2 = 0 then cached else cache_write end <= input group by 1",
     lambda spark, c: logs.read_responses(c.select(F.parse_json(F.to_json(_named(id=F.col("request_id"), model=F.col("source"), usage=_named(prompt_tokens=F.col("input"), completion_tokens=F.col("output"), prompt_tokens_details=F.when(F.col("cached") % 2 == 0, _named(cached_tokens=F.col("cached"))), prompt_cache_hit_tokens=F.when(F.col("cached") % 2 == 1, F.col("cache_write")))))).alias("v")), "compatible").groupBy("model").agg(F.count("*").alias("n"), F.sum("prompt").alias("prompt"), F.sum("completion").alias("completion"), F.sum("cached").alias("cached")))
_add("s17_mixed_text", ["counters"], "select event_id, source, k from counters union all select event_id, 'nested', null from counters where k % 2 = 0",
     lambda spark, c: logs.responses_from_text(c.select(F.concat(F.lit("log "), F.to_json(_named(event_id=F.col("event_id"), source=F.col("source"), k=F.col("k"))), F.lit(" {odd} "), F.when(F.col("k") % 2 == 0, F.to_json(_named(event_id=F.col("event_id"), source=F.lit("nested"), more=_named(deep=F.lit(1))))).otherwise("tail")).alias("t")), "t").select(F.get_json_object("json", "$.event_id").cast("bigint").alias("event_id"), F.get_json_object("json", "$.source").alias("source"), F.get_json_object("json", "$.k").cast("bigint").alias("k")))


def _s21(spark: SparkSession, d: DataFrame) -> DataFrame:
    folder = shared_dir(spark, "policy")
    d.where("driver is null").select(F.col("day").cast("string").alias("date"), "source", "tokens", F.lit("reviewed").alias("reason")).write.json(f"{folder}/settled.jsonl")
    return logs.read_policy(spark, folder, "settled").select("date", "source", "tokens", "reason")


_add("s21_policy", ["daily"], "select cast(day as varchar) as date, source, tokens, 'reviewed' as reason from daily where driver is null", _s21)


def _s20(spark: SparkSession, d: DataFrame) -> DataFrame:
    path = shared_dir(spark, "export")
    daily.export_wide(d).write.csv(path, header=True)
    stored = spark.read.csv(path, header=True, schema="day date, total_tokens long, sources string, fidelity string")
    return daily.check_export(stored, daily.export_wide(d.where("not (dayofmonth(day) = 9 and source = 'low')")))


WIDE = "select day, cast(sum(tokens) as bigint) as total_tokens, array_to_string(list_sort(list(distinct source)), ' ') as sources, case when bool_and(fidelity = 'exact') then 'exact' else 'mixed' end as fidelity from {} group by 1"
_add("s20_csv_parity", ["daily"], f", a as ({WIDE.format('daily')}), b as ({WIDE.format("(select * from daily where not (day(day) = 9 and source = 'low'))")}) select *, 'stored' as side from (select * from a except all select * from b) union all select *, 'computed' from (select * from b except all select * from a)", _s20)
_add("f13_response_digest", ["keys"], """select request_id, source, 'sha256:' || sha256('{"a":{"b":"' || source || '","c":"' || scope || '"},"id":"' || request_id || '"}') as digest from keys""",
     lambda spark, k: k.withColumn("json", F.to_json(_named(id=F.col("request_id"), a=_named(c=F.col("scope"), b=F.col("source"))))).select("request_id", "source", logs.response_digest(F.col("json")).alias("digest")))
_add("f17_instants", ["counters"], "select source, min(event_id + 1700000000) as first, max(event_id + 1700000000) as last from counters group by 1",
     lambda spark, c: c.groupBy("source").agg(*[f(F.unix_timestamp(u.to_instant(F.when(F.col("k") % 2 == 0, (F.col("event_id") + 1700000000) * 1000).otherwise(F.col("event_id") + 1700000000)))).alias(n) for f, n in ((F.min, "first"), (F.max, "last"))]))
