"""Lines with their positions, and counters under one typed contract, for the readers of logs.

A contract is a table of counter names and paths. One expression gives each counter, null where it is absent or no whole
number of the accepted range, and the paths that hold something else, so that absent, zero and malformed stay apart in every
format. ``gate`` turns these paths into the verdict on a source: one malformed counter makes it unknown.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyhouse.functions.usage import SAFE
from tallyhouse.operators import rollouts
from tallyhouse.sources.scratch import stored


def numbered_lines(spark: SparkSession, paths: str | list[str], **options: str | bool) -> DataFrame:
    """(file, line_no, value): every line of text files with its number in the file, from 1, blank lines counted.

    Large files are read in splits by many tasks. The lines of each split are counted where they are, and the counts of the
    splits before give the offset of a split; only these counts are shuffled.
    """
    reader = spark.read.options(**{"recursiveFileLookup": True, **options})
    rows = reader.text(paths).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("_block"), "value").withColumn("_id", F.monotonically_increasing_id())
    # the scan deals splits alike each time, so that a second pass meets the same ids
    splits = stored(rows.groupBy("file", "_block").agg(F.min("_id").alias("_first"), F.count("*").alias("_n")), "lines")
    later = splits.select("file", F.col("_block").alias("_b"), "_n")
    before = splits.drop("_n").join(later, "file").groupBy("file", "_block", "_first").agg(F.coalesce(F.sum(F.when(F.col("_b") < F.col("_block"), F.col("_n"))), F.lit(0)).alias("_before"))
    at = before.select("file", "_block", (F.col("_before") - F.col("_first") + 1).alias("_shift"))
    return rows.join(at, ["file", "_block"]).select("file", (F.col("_id") + F.col("_shift")).alias("line_no"), "value")


def numbered_json(spark: SparkSession, paths: str | list[str], **options: str | bool) -> DataFrame:
    """(file, line_no, value, v): lines that are not blank, parsed; v is null where a line is no JSON."""
    return numbered_lines(spark, paths, **options).where(F.trim("value") != "").withColumn("v", F.try_parse_json("value"))


def counters_of(v: Column, contract: dict[str, str]) -> Column:
    """A struct of the contract's counters and ``malformed``, the array of paths that hold no whole counter."""
    values, bad = [], []
    for name, path in contract.items():
        raw = F.coalesce(F.try_variant_get(v, path, "variant"), F.parse_json(F.lit("null")))
        number = F.try_variant_get(v, path, "bigint")
        good = F.coalesce((F.schema_of_variant(raw) == "BIGINT") & number.between(0, SAFE), F.lit(False))
        values.append(F.when(good, number).alias(name))
        bad.append(F.when(~good & (F.schema_of_variant(raw) != "VOID"), F.lit(path)))
    return F.struct(*values, F.array_compact(F.array(*bad)).alias("malformed"))


def gate(rows: DataFrame, at: str = "c", by: tuple[str, ...] = ("source",), position: tuple[str, ...] = ()) -> DataFrame:
    """Per source: rows, malformed ones, whether it is unknown, and the paths concerned; with the first ``position``."""
    bad = F.size(F.col(f"{at}.malformed")) > 0
    first = [F.min(F.when(bad, F.struct(*position))).alias("first_malformed")] if position else []
    paths = F.array_sort(F.array_distinct(F.flatten(F.collect_set(f"{at}.malformed"))))
    return rows.groupBy(*by).agg(F.count("*").alias("n_rows"), F.count_if(bad).alias("n_bad"), F.bool_or(bad).alias("unknown"), paths.alias("paths"), *first)


def known_only(rows: DataFrame, gates: DataFrame, by: tuple[str, ...] = ("source",)) -> DataFrame:
    """Rows of sources that are not unknown."""
    return rows.join(gates.where("unknown").select(*by), list(by), "left_anti")


# Where the formats keep their counters.
TRANSCRIPT = {"input": "$.message.usage.input_tokens", "cache_write": "$.message.usage.cache_creation_input_tokens", "output": "$.message.usage.output_tokens", "cached": "$.message.usage.cache_read_input_tokens"}
SESSION = {"input": "$.usage.inputTokens", "output": "$.usage.outputTokens", "cached": "$.usage.cacheReadTokens", "requests": "$.requests.count"}


def transcript_calls(spark: SparkSession, paths: str | list[str], source: str) -> tuple[DataFrame, DataFrame]:
    """(calls, errors) of transcript logs: identities, time, model, counters ``c``; and (file, line_no) of lines that are no JSON.

    A call's id is its request's, else its message's, else the line's own, else its position; only the first two make a
    request identity (``keyed``).
    """
    rows = numbered_json(spark, paths)
    v = F.col("v")
    text = lambda p: F.try_variant_get(v, p, "string")
    asked = F.coalesce(text("$.requestId"), text("$.message.id"))
    usage = F.try_variant_get(v, "$.message.usage", "variant")
    found = rows.where(usage.isNotNull() & (F.schema_of_variant(usage) != "VOID") & text("$.timestamp").isNotNull())
    position = F.concat_ws(":", "file", "line_no")
    calls = found.select(
        F.lit(source).alias("source"), "file", "line_no", F.coalesce(asked, text("$.uuid"), position).alias("request_id"), asked.isNotNull().alias("keyed"), F.when(asked.isNotNull(), "request").when(text("$.uuid").isNotNull(), "line").otherwise("position").alias("identity"),
        F.to_timestamp(text("$.timestamp")).alias("ts"), text("$.message.model").alias("model"), counters_of(v, TRANSCRIPT).alias("c"),
    )
    return calls, rows.where("v is null").select("file", "line_no")


def session_totals(spark: SparkSession, paths: str | list[str], source: str) -> tuple[DataFrame, DataFrame]:
    """(totals, errors) of session event logs: the cumulative counters of each model at every shutdown; and lines that are no JSON."""
    rows = numbered_json(spark, paths)
    text = lambda p: F.try_variant_get("v", p, "string")
    ended = rows.where((text("$.type") == "session.shutdown") & ~F.coalesce(F.try_variant_get("v", "$.ephemeral", "boolean"), F.lit(False)))
    each = ended.select("file", "line_no", text("$.id").alias("event_id"), text("$.timestamp").alias("_at"), F.explode(F.try_variant_get("v", "$.data.modelMetrics", "map<string,variant>")).alias("model", "m"))
    return each.select(F.lit(source).alias("source"), "file", "line_no", "event_id", F.to_timestamp("_at").alias("ts"), "model", counters_of(F.col("m"), SESSION).alias("c")), rows.where("v is null").select("file", "line_no")


def rollout_records(spark: SparkSession, paths: str | list[str]) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(records, metas, events, errors) of rollout logs, plain and ``.zst``; of two copies of a name the plain one counts.

    records and metas as rollouts.proven_prefixes and link_rollouts take them; events: rollout, pos, ts, model (the one that the
    latest turn set), last, total, c (its malformed paths); errors: rollout, line_no of lines that are no JSON.
    """
    rows = numbered_json(spark, paths)
    name = F.regexp_replace(F.element_at(F.split("file", "/"), -1), r"\.zst$", "")
    copies = rows.select("file").distinct().withColumn("rollout", name)
    kept = copies.groupBy("rollout").agg(F.min(F.struct(F.col("file").endswith(".zst").alias("packed"), "file")).alias("k")).select("rollout", "k.file")
    rows = rows.join(kept, "file")
    from pyspark.sql import Window

    line = Window.partitionBy("rollout").orderBy("line_no")
    parsed = rows.where("v is not null").withColumn("pos", F.row_number().over(line) - 1)
    v = F.col("v")
    text = lambda p: F.try_variant_get(v, p, "string")
    turn = F.when(text("$.type") == "turn_context", text("$.payload.model"))
    tokens = (text("$.payload.type") == "token_count") & text("$.timestamp").isNotNull()
    contract = {f"{at}_{c}": f"$.payload.info.{at}_token_usage.{path}" for at in ("last", "total") for c, path in rollouts.COUNTERS.items()}
    has = lambda p: F.coalesce(F.schema_of_variant(F.try_variant_get(v, p, "variant")) != "VOID", F.lit(False))
    told = F.when(tokens & has("$.payload.info.last_token_usage") & has("$.payload.info.total_token_usage"), counters_of(v, contract))
    meta = (text("$.type") == "session_meta") & text("$.payload.id").isNotNull()
    whole = parsed.select(
        "rollout", "pos", F.try_variant_get(v, "$.ordinal", "bigint").alias("ordinal"), *[c.alias(n) for n, c in rollouts.record_identity(v).items()], text("$.timestamp").alias("_ts"), F.last(turn, ignorenulls=True).over(line.rowsBetween(Window.unboundedPreceding, 0)).alias("model"), told.alias("c"),
        F.when(meta, F.struct("pos", text("$.payload.id").alias("thread"), text("$.payload.forked_from_id").alias("parent_thread"), has("$.payload.history_base").alias("referenced"), F.try_variant_get(v, "$.payload.forked_from_ordinal_exclusive", "bigint").alias("boundary"))).alias("meta"),
    )
    whole = stored(whole, "rollouts")
    part = lambda at: F.struct(*[F.col(f"c.{at}_{c}").alias(c) for c in rollouts.COUNTERS])
    events = whole.where("c is not null").select("rollout", "pos", F.to_timestamp("_ts").alias("ts"), "model", part("last").alias("last"), part("total").alias("total"), F.struct("c.malformed").alias("c"))
    # figures that contradict one another, or without a time, are malformed as well
    odd = reduce(lambda a, b: a | b, [rollouts.usage_faults("last"), rollouts.usage_faults("total"), F.col("ts").isNull()])
    events = events.withColumn("c", F.struct(F.when(odd, F.concat("c.malformed", F.array(F.lit("contradiction")))).otherwise(F.col("c.malformed")).alias("malformed")))
    metas = whole.where("meta is not null").groupBy("rollout").agg(F.min("meta").alias("m")).select("rollout", "m.thread", "m.parent_thread", "m.referenced", "m.boundary", F.col("m.pos").alias("meta_pos"))
    return whole.drop("c", "meta", "model", "_ts"), metas, events, rows.where("v is null").select("rollout", "line_no")
