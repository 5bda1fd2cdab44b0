"""From usage logs to daily receipts: rewrites, cumulative counters, forks, conventions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyhouse.functions.usage import sum_if_complete, table_tokens, task_tokens, utf16_length

#: Breaks ties between rewrites of one request: the latest, then the largest counters, then the origin.
REWRITE_ORDER = ("ts", "output", "input", "cached", "cache_write", "origin")


def request_identity(request_id: Column, message_id: Column, uuid: Column, file: Column, ts: Column) -> tuple[Column, Column]:
    """The id that a call is deduplicated by, and whether it gives a correlation key."""
    fallback = F.concat_ws("@", file, ts.cast("string"))
    return F.coalesce(request_id, message_id, uuid, fallback), F.coalesce(request_id, message_id).isNotNull()


def latest_per_request(calls: DataFrame) -> DataFrame:
    """The latest write of every (source, request_id); an aggregate, so rewrites are combined before the shuffle."""
    return latest_by(calls, ["source", "request_id"], REWRITE_ORDER)


def latest_by(rows: DataFrame, keys: list[str], order: tuple[str, ...]) -> DataFrame:
    """The row of each key that is greatest in ``order``, then in its other columns by name."""
    rest = [c for c in sorted(rows.columns) if c not in keys and c not in order]
    top = rows.groupBy(*keys).agg(F.max(F.struct(*order, *rest)).alias("_top"))
    return top.select(*[c if c in keys else F.col(f"_top.{c}").alias(c) for c in rows.columns])


def adjacent_dedupe(counters: DataFrame) -> DataFrame:
    """Mark a snapshot equal to the one before in its session (repeat) and a total that fell (reset)."""
    w = Window.partitionBy("session").orderBy("ts", "event_id")
    before = F.lag("k").over(w)
    return counters.withColumns({"repeat": F.coalesce(F.col("k") == before, F.lit(False)), "reset": F.coalesce(F.col("k") < before, F.lit(False))})


def increments(counters: DataFrame, fields: tuple[str, ...] = ("k",)) -> DataFrame:
    """Increase of every cumulative field since the row before; if any field fell, counting starts afresh."""
    w = Window.partitionBy("session").orderBy("ts", "event_id")
    rows = counters.withColumns({f"_b_{f}": F.lag(f).over(w) for f in fields})
    fresh = F.lit(False)
    for f in fields:
        fresh = fresh | F.col(f"_b_{f}").isNull() | (F.col(f) < F.col(f"_b_{f}"))
    rows = rows.withColumn("fresh", fresh)
    return rows.withColumns({f"d_{f}": F.when(F.col("fresh"), F.col(f)).otherwise(F.col(f) - F.col(f"_b_{f}")) for f in fields}).drop(*[f"_b_{f}" for f in fields])


def carry_model(records: DataFrame, model: str = "model") -> DataFrame:
    """The model that the latest record so far in the session has set."""
    w = Window.partitionBy("session").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    return records.withColumn("carried", F.last(model, ignorenulls=True).over(w))


def link_forks(sessions: DataFrame) -> DataFrame:
    """(id, parent, candidates, state): each session's parent among earlier ones with the same key."""
    w = Window.partitionBy("key").orderBy("id")
    out = sessions.withColumns({"parent": F.min("id").over(w.rowsBetween(Window.unboundedPreceding, -1)), "candidates": F.count("*").over(w) - 1})
    state = F.when(F.col("candidates") == 0, "missing").when(F.col("candidates") == 1, "unique").otherwise("ambiguous")
    return out.select("id", "parent", "candidates", state.alias("state"))


def inherited_prefix(records: DataFrame, links: DataFrame) -> DataFrame:
    """(id, parent, prefix): how many leading records a child shares with its parent.

    ``records``: id, pos, value. ``links``: id, parent. Child and parent meet on the position, so the join
    stays an equi-join; the first position without an equal record ends the prefix.
    """
    child = records.join(links.where("parent is not null").select("id", "parent"), "id")
    other = records.select(F.col("id").alias("parent"), "pos", F.col("value").alias("theirs"))
    met = child.join(other, ["parent", "pos"], "left").withColumn("same", F.coalesce(F.col("value") == F.col("theirs"), F.lit(False)))
    return met.groupBy("id", "parent").agg(F.coalesce(F.min(F.when(~F.col("same"), F.col("pos"))), F.max("pos") + 1).alias("prefix"))


def assert_counters(rows: DataFrame, bad: Column) -> DataFrame:
    """Per source: rows, malformed rows, and whether one of them makes the source unknown."""
    return rows.groupBy("source").agg(F.count("*").alias("n_rows"), F.count_if(bad).alias("n_bad"), F.coalesce(F.bool_or(bad), F.lit(False)).alias("unknown"))


def transcript_receipts(calls: DataFrame) -> DataFrame:
    """Daily receipts of a transcript: latest rewrites, cache outside input, days without tokens dropped."""
    tokens = F.col("input") + F.col("cache_write") + F.col("output")
    out = latest_per_request(calls).groupBy("day", "source", "origin").agg(
        F.sum(tokens).alias("tokens"), F.count("*").alias("calls"), sum_if_complete(F.col("input")).alias("input_tokens"), sum_if_complete(F.col("output")).alias("output_tokens"),
        sum_if_complete(F.col("cached")).alias("cached_input_tokens"), sum_if_complete(F.col("cache_write")).alias("cache_write_tokens"),
    )
    return out.where("tokens > 0")


def rollout_receipts(counters: DataFrame) -> DataFrame:
    """Daily receipts of cumulative rollouts: repeats skipped, resets counted; only wholly empty days drop."""
    rows = adjacent_dedupe(counters).where(~F.col("repeat"))
    out = rows.groupBy("day", "source").agg(F.sum("amount").alias("tokens"), F.count("*").alias("calls"), F.count_if("reset").alias("resets"))
    return out.where("tokens > 0 or calls > 0").withColumn("coverage_reason", F.when(F.col("resets") > 0, "counter_reset"))


def session_receipts(counters: DataFrame) -> DataFrame:
    """Daily receipts of session totals: positive increases, dated by their snapshot."""
    rows = increments(counters).where("d_k > 0")
    return rows.groupBy("day", "source").agg(F.sum("d_k").alias("tokens"), F.count("*").alias("calls"), F.count_if("fresh").alias("fresh_starts"))


def table_receipts(rows: DataFrame, convention: str | None) -> DataFrame:
    """Daily receipts of a ledger table; a source with an undecided row is unknown and has no tokens."""
    tokens = table_tokens(F.col("input"), F.col("output"), F.col("total"), F.col("cached"), convention)
    counted = rows.withColumn("_t", tokens)
    unknown = counted.groupBy("source").agg(F.count_if(F.col("_t").isNull()).alias("undecided"))
    days = counted.groupBy("day", "source").agg(F.sum("_t").alias("tokens"), F.count("*").alias("calls")).join(unknown, "source")
    return days.where("tokens > 0 or undecided > 0").select("day", "source", F.when(F.col("undecided") == 0, F.col("tokens")).alias("tokens"), "calls", "undecided")


def task_receipts(messages: DataFrame, convention: str | None) -> DataFrame:
    """Daily receipts of tasks, with how many messages each convention decided."""
    i, o, w, r = (F.col(c) for c in ("input", "output", "cache_write", "cached"))
    kind = F.when((w == 0) & (r == 0), "plain").when(i < r + w, "legacy").otherwise("given")
    rows = messages.withColumns({"_t": task_tokens(i, o, w, r, convention), "_k": kind})
    counts = [F.count_if(F.col("_k") == k).alias(f"n_{k}") for k in ("plain", "legacy", "given")]
    return rows.groupBy("day", "source").agg(F.sum("_t").alias("tokens"), F.count("*").alias("calls"), *counts).where("tokens > 0")


def estimate_chat(messages: DataFrame) -> DataFrame:
    """Estimated tokens of conversations: a quarter of each message's UTF-16 units, rounded up.

    Of a turn that is logged again, the row greatest by role, length and text counts.
    """
    rows = messages.where(F.col("role").isin("user", "assistant")).withColumn("units", utf16_length(F.coalesce("text", F.lit(""))))
    rows = latest_by(rows.select("conv_id", "turn", "day", "role", "units"), ["conv_id", "turn"], ("role", "units"))
    return rows.groupBy("day").agg(F.sum(F.ceil(F.col("units") / 4)).alias("tokens"), F.count_if(F.col("role") == "assistant").alias("calls"))


def message_chars(parts: Column, text: Column, attached: Column) -> Column:
    """UTF-16 units of a message: its typed parts if they hold any, else its text; attachments are added."""
    total = lambda xs: F.aggregate(F.transform(F.coalesce(xs, F.array().cast("array<string>")), lambda x: utf16_length(F.coalesce(x, F.lit("")))), F.lit(0), lambda a, x: a + x)
    own = total(parts)
    return F.when(own > 0, own).otherwise(utf16_length(F.coalesce(text, F.lit("")))) + total(attached)


def chat_session_receipts(messages: DataFrame) -> DataFrame:
    """Daily receipts of chat sessions (session, message_id, ts, model, input, output, cached, thoughts, tool, day, source).

    The latest record of a message counts. Tokens: input without cached input, output, thoughts and tool
    prompts; a missing counter is 0. A message without time, or with more cached than input, makes its source
    unknown: none of its days is returned.
    """
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    good = F.col("ts").isNotNull() & (zero("cached") <= zero("input"))
    unknown = messages.where(~good).select("source").distinct()
    last = latest_by(messages.join(unknown, "source", "left_anti"), ["source", "session", "message_id"], ("ts",))
    tokens = zero("input") - zero("cached") + zero("output") + zero("thoughts") + zero("tool")
    models = F.array_join(F.array_sort(F.collect_set("model")), ",")
    return last.groupBy("day", "source").agg(F.sum(tokens).alias("tokens"), F.count("*").alias("calls"), F.sum(zero("cached")).alias("cached"), F.sum(zero("thoughts")).alias("thoughts"), models.alias("models")).where("tokens > 0")


def thread_receipts(threads: DataFrame) -> DataFrame:
    """Daily receipts of agent threads (id, source, created, updated, input, output, cache_write, cached, requests, model).

    A thread counts whole on the day it was created, else last changed. Cached reads are left out. A
    thread without a day or a counter makes its source unknown: none of its days is returned.
    """
    rows = threads.withColumn("day", F.coalesce("created", "updated").cast("date"))
    bad = F.col("day").isNull() | F.col("input").isNull() | F.col("output").isNull() | F.col("cache_write").isNull() | F.col("cached").isNull()
    rows = rows.join(rows.where(bad).select("source").distinct(), "source", "left_anti")
    models = F.array_join(F.array_sort(F.collect_set("model")), ",")
    return rows.groupBy("day", "source").agg(F.sum(F.col("input") + F.col("cache_write") + F.col("output")).alias("tokens"), F.sum(F.coalesce("requests", F.lit(0))).cast("bigint").alias("calls"), F.sum("cached").alias("cached"), models.alias("models")).where("tokens > 0")


def since(rows: DataFrame, first: str | None) -> DataFrame:
    """Rows from a day on; all of them without a day. A plain condition, so it reaches a partitioned scan."""
    return rows if first is None else rows.where(F.col("day") >= F.lit(first).cast("date"))


def report_receipts(results: DataFrame) -> DataFrame:
    """Daily receipts of a usage report per account: endpoints and models as sorted sets.

    Tokens are input, cache writes and output; calls are summed as reported (null where no result reports any), never counted
    from rows.
    """
    as_set = lambda c: F.array_join(F.array_sort(F.collect_set(c)), ",")
    tokens = F.coalesce("input", F.lit(0)) + F.coalesce("cache_write", F.lit(0)) + F.coalesce("output", F.lit(0))
    return results.groupBy("day", "account").agg(
        F.sum(tokens).alias("tokens"), F.sum("calls").alias("calls"), as_set("source").alias("models"), as_set("origin").alias("endpoints"), sum_if_complete(F.col("cached")).alias("cached_input_tokens"),
    )


def report_months(days: DataFrame) -> DataFrame:
    """Active days, tokens, first and last day by month."""
    return days.groupBy(F.trunc("day", "month").alias("month")).agg(F.count_distinct("day").alias("days"), F.sum("tokens").alias("tokens"), F.min("day").alias("first_day"), F.max("day").alias("last_day"))
