"""Readers of usage logs and conversation exports.

Lines are parsed as VARIANT, so that a counter that is missing, zero or malformed stays told apart: a value
counts only if it is a whole number in the accepted range, anything else is malformed. Readers name the malformed paths
of a row; ``lines.gate`` makes a source with one of them unknown.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyhouse.functions.usage import SAFE, cache_writes
from tallyhouse.sources.lines import SESSION, counters_of, numbered_json

RECEIPT_FIELDS = {
    "date": "string", "timezone": "string", "source": "string", "provider": "string", "surface": "string", "account_alias": "string", "origin": "string", "machine_alias": "string", "snapshot_key": "string",
    "authority": "string", "fidelity": "string", "coverage": "string", "driver": "string", "provenance": "string", "models": "array<string>", "correlation_keys": "array<string>", "coverage_reasons": "array<string>",
}
COMPONENTS = ("input_tokens", "output_tokens", "cached_input_tokens", "cache_write_tokens", "reasoning_tokens")


def counter(v: Column, path: str) -> Column:
    """A whole counter at a path; null if missing or malformed."""
    kind = F.schema_of_variant(F.coalesce(F.try_variant_get(v, path, "variant"), F.parse_json(F.lit("null"))))
    number = F.try_variant_get(v, path, "bigint")
    return F.when((kind == "BIGINT") & number.between(0, SAFE), number)


def malformed(v: Column, path: str) -> Column:
    """True if something other than a whole counter is there."""
    kind = F.schema_of_variant(F.coalesce(F.try_variant_get(v, path, "variant"), F.parse_json(F.lit("null"))))
    return (kind != "VOID") & counter(v, path).isNull()


def json_lines(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(file, line, v): the text of every line that is not blank, of plain or compressed files; v is null if it is no JSON."""
    rows = spark.read.option("recursiveFileLookup", True).text(paths).select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("line"))
    return rows.where(F.trim("line") != "").withColumn("v", F.try_parse_json("line"))


def read_receipts(spark: SparkSession, paths: str | list[str]) -> tuple[DataFrame, DataFrame]:
    """Receipts, and the lines that fail, with file and number: not JSON, or with a malformed counter. Any of these fails an import.

    Cost amounts are taken from the text, so that their digits stay as written.
    """
    rows = numbered_json(spark, paths).withColumnRenamed("value", "line")
    v = F.col("v")
    bad = v.isNull() | malformed(v, "$.tokens") | malformed(v, "$.calls")
    for c in COMPONENTS:
        bad = bad | malformed(v, f"$.token_components.{c}")
    good = rows.where(~bad).select(
        "file", counter(v, "$.schema_version").cast("int").alias("schema_version"), *[F.try_variant_get(v, f"$.{n}", t).alias(n) for n, t in RECEIPT_FIELDS.items()],
        counter(v, "$.tokens").alias("tokens"), counter(v, "$.calls").alias("calls"), F.struct(*[counter(v, f"$.token_components.{c}").alias(c) for c in COMPONENTS]).alias("token_components"),
        F.nullif(F.regexp_extract("line", r'"amount"\s*:\s*"?(-?[0-9]+(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?)', 1), F.lit("")).alias("cost_amount"),
    )
    return good, rows.where(bad).select("file", "line_no", "line")


def read_dataset(spark: SparkSession, path: str) -> DataFrame:
    """The nested daily dataset as one row per (date, source)."""
    entry = "struct<tokens:bigint,calls:bigint,fidelity:string,authority:string,coverage:string,coverage_reasons:array<string>,by_origin:map<string,bigint>>"
    rows = spark.read.schema(f"date string, timezone string, total bigint, driver string, evidence string, sources map<string,{entry}>").json(path, multiLine=True)
    return rows.select("date", "timezone", "driver", "evidence", F.explode("sources").alias("source", "e")).select("date", "timezone", "driver", "evidence", "source", "e.*")


def write_dataset(daily: DataFrame, ledger: DataFrame, folder: str) -> str:
    """Write both tables into one new version folder; a reader takes the folder whose _SUCCESS files are both there."""
    import uuid

    target = f"{folder}/version-{uuid.uuid4().hex}"
    ledger.write.parquet(f"{target}/ledger")
    daily.write.parquet(f"{target}/daily")
    return target


def read_transcripts(spark: SparkSession, path: str) -> DataFrame:
    """Calls of transcript logs: identity, model, counters and whether one is malformed."""
    rows = json_lines(spark, path)
    v, at = F.col("v"), "$.message.usage."
    names = {"input": "input_tokens", "cache_write": "cache_creation_input_tokens", "cached": "cache_read_input_tokens", "output": "output_tokens"}
    bad = F.lit(False)
    for n in names.values():
        bad = bad | malformed(v, at + n)
    text = lambda p: F.try_variant_get(v, p, "string")
    found = rows.where(F.try_variant_get(v, "$.message.usage", "variant").isNotNull())
    return found.select("file", text("$.requestId").alias("request_id"), text("$.message.id").alias("message_id"), text("$.uuid").alias("uuid"), F.to_timestamp(text("$.timestamp")).alias("ts"), text("$.message.model").alias("model"), *[counter(v, at + n).alias(k) for k, n in names.items()], bad.alias("malformed"))


def read_rollouts(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Records of rollout logs; of a plain and a compressed copy of one name, the plain one counts."""
    rows = json_lines(spark, paths)
    base = F.regexp_replace(F.element_at(F.split("file", "/"), -1), r"\.zst$", "")
    best = rows.select("file", base.alias("base")).distinct().withColumn("n", F.row_number().over(Window.partitionBy("base").orderBy(F.col("file").endswith(".zst"), "file"))).where("n = 1")
    v = F.col("v")
    text = lambda p: F.try_variant_get(v, p, "string")
    return rows.join(best.select("file", "base"), "file").select("base", F.to_timestamp(text("$.timestamp")).alias("ts"), counter(v, "$.ordinal").alias("ordinal"), text("$.type").alias("type"), text("$.payload.type").alias("kind"), text("$.payload.id").alias("id"), text("$.payload.model").alias("model"), counter(v, "$.payload.info.total_token_usage.total_tokens").alias("total"), counter(v, "$.payload.info.last_token_usage.total_tokens").alias("last"), F.try_variant_get(v, "$.payload.forked_from_id", "string").alias("parent"))


def read_session_totals(spark: SparkSession, path: str) -> DataFrame:
    """Cumulative totals per session, model and shutdown event, with the paths that hold no whole counter."""
    rows = json_lines(spark, path).where(F.try_variant_get("v", "$.type", "string") == "session.shutdown")
    v = F.col("v")
    shown = rows.select("file", F.try_variant_get(v, "$.id", "string").alias("event_id"), F.to_timestamp(F.try_variant_get(v, "$.timestamp", "string")).alias("ts"), F.explode(F.try_variant_get(v, "$.data.modelMetrics", "map<string,variant>")).alias("model", "m"))
    return shown.withColumn("c", counters_of(F.col("m"), SESSION)).select("file", "event_id", "ts", "model", "c.requests", "c.input", "c.output", "c.cached", "c.malformed")


CHAT = ("input", "output", "cached", "thoughts", "tool")


def _chat_record(v: Column) -> list[Column]:
    text = lambda p: F.try_variant_get(v, p, "string")
    return [text("$.sessionId").alias("session"), text("$.id").alias("message_id"), text("$.type").alias("type"), F.to_timestamp(text("$.timestamp")).alias("ts"), text("$.model").alias("model"), *[counter(v, f"$.tokens.{c}").alias(c) for c in CHAT], counters_of(v, {c: f"$.tokens.{c}" for c in CHAT})["malformed"].alias("malformed")]


def read_chat_sessions(spark: SparkSession, path: str) -> DataFrame:
    """Messages of chat sessions, logged a line each (.jsonl) or as one document (.json)."""
    lines = json_lines(spark, path).where(F.col("file").endswith(".jsonl")).select("file", *_chat_record(F.col("v")))
    whole = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").text(path, wholetext=True)
    items = whole.select(F.col("_metadata.file_path").alias("file"), F.explode(F.try_variant_get(F.try_parse_json("value"), "$.messages", "array<variant>")).alias("m"))
    return lines.unionByName(items.select("file", *_chat_record(F.col("m")))).where("type = 'gemini'")


def read_task_messages(spark: SparkSession, path: str) -> DataFrame:
    """Requests of task stores: arrays of messages whose text is JSON again."""
    whole = spark.read.option("recursiveFileLookup", True).text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.try_parse_json("value").alias("v"))
    m = whole.select("file", F.explode(F.try_variant_get("v", "$", "array<variant>")).alias("m"))
    m = m.where(F.try_variant_get("m", "$.say", "string") == "api_req_started").withColumn("t", F.try_parse_json(F.try_variant_get("m", "$.text", "string")))
    c = counters_of(F.col("t"), {"input": "$.tokensIn", "output": "$.tokensOut", "cache_write": "$.cacheWrites", "cached": "$.cacheReads"})
    return m.withColumn("c", c).select("file", F.timestamp_millis(F.try_variant_get("m", "$.ts", "bigint")).alias("ts"), "c.*")


def with_task_models(messages: DataFrame, history: DataFrame) -> DataFrame:
    """Requests with the model of their task, by the last folder of their file; ``history``: task (folder), model."""
    task = F.element_at(F.split("file", "/"), -2)
    known = history.where("task is not null").groupBy("task").agg(F.max("model").alias("model"))
    return messages.withColumn("task", task).join(known, "task", "left")


def usage_from_tables(usage: DataFrame, sessions: DataFrame) -> DataFrame:
    """Rows of a usage table with their session's provider."""
    return usage.join(sessions.select(F.col("id").alias("session_id"), "provider_name"), "session_id", "left")


def messages_from_kv(rows: DataFrame) -> DataFrame:
    """Messages of a key/value store (key, value): bubbles with counts above zero, or with a malformed one."""
    v = F.try_parse_json("value")
    found = rows.where(F.col("key").startswith("bubbleId:")).select("key", F.to_timestamp(F.try_variant_get(v, "$.createdAt", "string")).alias("ts"), counter(v, "$.tokenCount.inputTokens").alias("input"), counter(v, "$.tokenCount.outputTokens").alias("output"), F.try_variant_get(v, "$.modelInfo.modelName", "string").alias("model"), counters_of(v, {"input": "$.tokenCount.inputTokens", "output": "$.tokenCount.outputTokens"})["malformed"].alias("malformed"))
    return found.where("coalesce(input, 0) + coalesce(output, 0) > 0 or size(malformed) > 0")


def decode_threads(threads: DataFrame) -> DataFrame:
    """(id, data_type, data) to (id, json): zstd blobs are unpacked; an undecodable one gives null."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in batches:
            out = []
            for kind, data in zip(df["data_type"], df["data"]):
                try:
                    raw = pa.CompressedInputStream(pa.BufferReader(bytes(data)), "zstd").read() if kind == "zstd" else bytes(data)
                    out.append(raw.decode("utf-8"))
                except (OSError, UnicodeDecodeError, TypeError):
                    out.append(None)
            yield pd.DataFrame({"id": df["id"], "json": out})

    return threads.select("id", "data_type", "data").mapInPandas(run, "id string, json string")


def read_export_mapping(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Messages of conversation exports that map node ids to nodes."""
    node = "struct<id:string,message:struct<id:string,create_time:double,author:struct<role:string>,content:struct<parts:array<string>,text:string>,metadata:struct<model_slug:string>>>"
    rows = spark.read.schema(f"id string, create_time double, default_model_slug string, mapping map<string,{node}>").json(paths, multiLine=True)
    n = rows.select("id", "create_time", "default_model_slug", F.explode("mapping").alias("node", "n")).where("n.message is not null")
    text = F.coalesce(F.array_join("n.message.content.parts", ""), F.col("n.message.content.text"), F.lit(""))
    return n.select("id", F.coalesce("n.message.id", "node").alias("message_id"), F.col("n.message.author.role").alias("role"), F.timestamp_seconds(F.coalesce("n.message.create_time", "create_time")).alias("ts"), F.coalesce("n.message.metadata.model_slug", "default_model_slug").alias("model"), text.alias("text"))


def read_export_messages(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Messages of conversation exports with typed parts; the parts beat the plain text."""
    part = "struct<type:string,text:string,thinking:string>"
    message = f"struct<uuid:string,sender:string,role:string,created_at:string,text:string,content:array<{part}>,attachments:array<struct<extracted_content:string>>>"
    rows = spark.read.schema(f"uuid string, created_at string, chat_messages array<{message}>, messages array<{message}>").json(paths, multiLine=True)
    m = rows.select("uuid", F.explode(F.coalesce("chat_messages", "messages")).alias("m"))
    parts = F.array_join(F.transform("m.content", lambda p: F.coalesce(p["text"], p["thinking"], F.lit(""))), "")
    attached = F.coalesce(F.array_join(F.transform("m.attachments", lambda x: F.coalesce(x["extracted_content"], F.lit(""))), ""), F.lit(""))
    body = F.coalesce(F.nullif(parts, F.lit("")), F.col("m.text"), F.lit(""))
    return m.select("uuid", F.col("m.uuid").alias("message_id"), F.coalesce("m.sender", "m.role").alias("role"), F.to_timestamp("m.created_at").alias("ts"), F.concat(body, attached).alias("text"))


def read_usage_pages(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """Results of landed usage-report pages of shape ``a`` (ISO starts) or ``b`` (epoch starts), with malformed paths."""
    pages = json_lines(spark, path).select(F.explode(F.try_variant_get("v", "$.data", "array<variant>")).alias("b"))
    r = pages.select("b", F.explode(F.try_variant_get("b", "$.results", "array<variant>")).alias("r"))
    v = F.col("r")
    if kind == "a":
        total, reported = cache_writes(F.try_variant_get(v, "$.cache_creation", "map<string,bigint>"), counter(v, "$.cache_creation_input_tokens"))
        writes = F.when(reported, total)
        odd = lambda x: (F.schema_of_variant(x) != "BIGINT") | ~F.coalesce(F.try_variant_get(x, "$", "bigint").between(0, SAFE), F.lit(False))
        parts = F.map_values(F.try_variant_get(v, "$.cache_creation", "map<string,variant>"))
        malformed_a = F.array_compact(F.array_append(counters_of(v, {c: f"$.{c}" for c in ("uncached_input_tokens", "cache_creation_input_tokens", "cache_read_input_tokens", "output_tokens")})["malformed"], F.when(F.exists(parts, odd), F.lit("$.cache_creation"))))
        return r.select(F.to_timestamp(F.try_variant_get("b", "$.starting_at", "string")).alias("ts"), F.try_variant_get(v, "$.model", "string").alias("model"), counter(v, "$.uncached_input_tokens").alias("input"), writes.alias("cache_write"), counter(v, "$.cache_read_input_tokens").alias("cached"), counter(v, "$.output_tokens").alias("output"), F.lit(None).cast("bigint").alias("calls"), malformed_a.alias("malformed"))
    malformed_b = counters_of(v, {c: f"$.{c}" for c in ("input_tokens", "input_cached_tokens", "output_tokens", "num_model_requests")})["malformed"]
    return r.select(F.timestamp_seconds(F.try_variant_get("b", "$.start_time", "bigint")).alias("ts"), F.try_variant_get(v, "$.model", "string").alias("model"), counter(v, "$.input_tokens").alias("input"), F.lit(None).cast("bigint").alias("cache_write"), counter(v, "$.input_cached_tokens").alias("cached"), counter(v, "$.output_tokens").alias("output"), counter(v, "$.num_model_requests").alias("calls"), malformed_b.alias("malformed"))


def read_cost_pages(spark: SparkSession, path: str, kind: str | None = None) -> DataFrame:
    """(day, amount, currency) of days with exactly one result, the amount's digits as written.

    Without ``kind`` a line is one bucket. Pages hold buckets in ``data``: of shape ``a`` (starting_at, amount and currency) or
    ``b`` (start_time in seconds, amount with value and currency). A page's amounts are read off its text in order and dealt
    to its buckets by how many results each has; a page whose amounts are not as many as its results is left out.
    """
    rows = json_lines(spark, path)
    number = r'"?(-?[0-9]+(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?)'
    money = lambda r: F.upper(F.coalesce(F.try_variant_get(r, "$.currency", "string"), F.try_variant_get(r, "$.amount.currency", "string")))
    if kind is None:
        results = F.try_variant_get("v", "$.results", "array<variant>")
        amount = F.regexp_extract("line", r'"(?:amount|value)"\s*:\s*' + number, 1)
        return rows.where(F.size(results) == 1).select(F.to_date(F.try_variant_get("v", "$.starting_at", "string")).alias("day"), amount.alias("amount"), money(F.get(results, F.lit(0))).alias("currency"))
    field = "amount" if kind == "a" else "value"
    every = F.regexp_extract_all("line", F.lit(rf'"{field}"\s*:\s*' + number), F.lit(1))
    results_of = lambda b: F.try_variant_get(b, "$.results", "array<variant>")
    pages = rows.select(every.alias("amounts"), F.try_variant_get("v", "$.data", "array<variant>").alias("data"))
    pages = pages.withColumn("sizes", F.transform("data", lambda b: F.coalesce(F.size(results_of(b)), F.lit(0))))
    total = lambda xs: F.aggregate(xs, F.lit(0), lambda a, x: a + x)
    pages = pages.where(total(F.col("sizes")) == F.size("amounts")).select("amounts", "sizes", F.posexplode("data").alias("at", "b"))
    one = pages.where(F.get("sizes", F.col("at")) == 1).withColumn("before", total(F.slice("sizes", F.lit(1), F.col("at"))))
    start = F.to_date(F.try_variant_get("b", "$.starting_at", "string")) if kind == "a" else F.to_date(F.timestamp_seconds(F.try_variant_get("b", "$.start_time", "bigint")))
    return one.select(start.alias("day"), F.get("amounts", F.col("before")).alias("amount"), money(F.get(results_of(F.col("b")), F.lit(0))).alias("currency"))


def read_responses(rows: DataFrame, kind: str) -> DataFrame:
    """Counters of captured responses (VARIANT column v) of kind search, local, compatible or evaluation.

    A compatible response may tell cached input nested or flat; rows that cache more than they asked are
    inconsistent and dropped.
    """
    v = F.col("v")
    paths = {
        "search": ("$.usage.prompt_tokens", "$.usage.completion_tokens", "$.usage.total_tokens", None), "local": ("$.prompt_eval_count", "$.eval_count", None, None),
        "compatible": ("$.usage.prompt_tokens", "$.usage.completion_tokens", None, "$.usage.prompt_tokens_details.cached_tokens"), "evaluation": ("$.usage.input_tokens", "$.usage.output_tokens", None, None),
    }[kind]
    got = [(counter(v, p) if p else F.lit(None).cast("bigint")).alias(n) for p, n in zip(paths, ("prompt", "completion", "total", "cached"))]
    told = F.struct(F.try_variant_get(v, "$.id", "string").alias("id"), F.try_variant_get(v, "$.model", "string").alias("model"), *got, counter(v, "$.usage.prompt_cache_hit_tokens").alias("_flat"))
    # a generator's output: the condition below is not pushed under it, where each use would parse the response again
    out = rows.select(F.inline(F.array(told)))
    if kind == "compatible":
        out = out.withColumn("cached", F.coalesce("cached", "_flat")).where("cached is null or prompt is null or cached <= prompt")
    return out.drop("_flat")


def responses_from_text(rows: DataFrame, column: str) -> DataFrame:
    """Every balanced JSON object inside mixed text, one a row."""

    def objects(text: str) -> Iterator[str]:
        decoder, at = json.JSONDecoder(), 0
        while (at := text.find("{", at)) >= 0:
            try:
                _, end = decoder.raw_decode(text, at)
                yield text[at:end]
                at = end
            except ValueError:
                at += 1

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in batches:
            yield pd.DataFrame({"json": [o for t in df[column].dropna() for o in objects(t)]}, dtype=str)

    return rows.select(column).mapInPandas(run, "json string")


def response_digest(json_text: Column) -> Column:
    """Digest of a response with its keys sorted at every level."""

    @F.pandas_udf("string")
    def canonical(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else json.dumps(json.loads(t), sort_keys=True, separators=(",", ":"), ensure_ascii=False))

    return F.concat(F.lit("sha256:"), F.sha2(canonical(json_text), 256))


def read_policy(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A policy table (settled, exclusions, intervals, decisions) from JSON lines."""
    return spark.read.json(f"{folder}/{name}.jsonl")
