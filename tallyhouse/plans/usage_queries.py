"""Registered queries: scalar functions, extraction and daily entries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyhouse.functions import usage as u
from tallyhouse.operators import daily, extract
from tallyhouse.plans.bindings import bind, duck
from tallyhouse.plans.registry import register
from tallyhouse.profile import Profile
from tallyhouse.sources.tables import table

UNITS = "(length({0}) + length(regexp_replace({0}, '[^\\x{{10000}}-\\x{{10FFFF}}]', '', 'g')))"
LATEST = "latest as (select * exclude (rn) from (select *, row_number() over (partition by source, request_id order by ts desc, output desc, input desc, cached desc, cache_write desc, origin desc) rn from calls) where rn = 1)"
RANK = "case authority when 'estimated' then 1 when 'reconstructed' then 2 when 'tool' then 3 when 'provider' then 4 end"
NAME = "case {} when 1 then 'estimated' when 2 then 'reconstructed' when 3 then 'tool' when 4 then 'provider' end"
WEAKEST = NAME.format(f"case when count({RANK}) = count(*) then min({RANK}) end")


def add(name, needs, sql):
    """Register a query over bindings; its SQL follows the bindings' WITH clause."""
    def wrap(make):
        register(name, lambda spark, sf_dir: make(*[bind(spark, sf_dir, n) for n in needs]), duck(*needs) + sql)
        return make
    return wrap


def add_table(name, needs, sql):
    """Register a query over plain tables."""
    def wrap(make):
        register(name, lambda spark, sf_dir: make(*[table(spark, sf_dir, n) for n in needs]), sql)
        return make
    return wrap


add("p5_day_bucket", ["calls"], "select cast(ts - interval 5 hour as date) as day, count(*) as n from calls group by 1")(
    lambda c: c.groupBy(u.day_of(F.col("ts"), Profile(timezone="GMT-5")).alias("day")).agg(F.count("*").alias("n")))
add("p7_week_start", ["daily"], "select day - cast(dayofweek(day) as int) as week, cast(sum(tokens) as bigint) as tokens from daily group by 1")(
    lambda d: d.groupBy(u.week_start(F.col("day")).alias("week")).agg(F.sum("tokens").alias("tokens")))
add("f1_headline_in", ["calls"], "select source, cast(sum(greatest(0, input - cached) + output) as bigint) as tokens from calls group by 1")(
    lambda c: c.groupBy("source").agg(F.sum(u.headline_inclusive(F.col("input"), F.col("cached"), F.col("output"))).alias("tokens")))
add("f2_headline_out", ["calls"], "select source, cast(sum(input + cache_write + output) as bigint) as tokens, cast(sum(cached) as bigint) as cached from calls group by 1")(
    lambda c: c.groupBy("source").agg(F.sum(u.headline_exclusive(F.col("input"), F.col("cache_write"), F.col("output"))).alias("tokens"), F.sum("cached").alias("cached")))
add("f3_convention", ["calls"], "select source, cast(sum(case when cached > 0 then greatest(0, input - cached) + output else input + output end) as bigint) as inclusive, count(case when cached > 0 then 1 end) as undecided from calls group by 1")(
    lambda c: c.groupBy("source").agg(F.sum(u.table_tokens(F.col("input"), F.col("output"), F.lit(None).cast("bigint"), F.col("cached"), "inclusive")).alias("inclusive"), F.count_if(u.table_tokens(F.col("input"), F.col("output"), F.lit(None).cast("bigint"), F.col("cached"), None).isNull()).alias("undecided")))
add("f4_tie_break", ["calls"], "select source, cast(sum(case when cache_write = 0 and cached = 0 then input + output when input < cached + cache_write then input + cache_write + output else greatest(0, input - cached) + output end) as bigint) as tokens from calls group by 1")(
    lambda c: c.groupBy("source").agg(F.sum(u.task_tokens(F.col("input"), F.col("output"), F.col("cache_write"), F.col("cached"), "inclusive")).alias("tokens")))
LOCAL = "case when regexp_matches(m, '^qwen') then 'qwen_local' when regexp_matches(m, '^gemma') then 'gemma_local' when regexp_matches(m, '^llama') then 'llama_local' when regexp_matches(m, '^deepseek') then 'deepseek_local' when regexp_matches(m, '^gpt[-_]?oss') then 'gpt_oss' else trim(regexp_replace(m, '[^a-z0-9]+', '_', 'g'), '_') || '_local' end"
add_table("f5_model_source", ["part"], f"select case when p_partkey % 3 < 2 then {LOCAL} else 'hosted_' || trim(regexp_replace(lower(p_brand), '[^a-z0-9]+', '_', 'g'), '_') end as source, count(*) as n from (select *, case p_partkey % 7 when 0 then 'qwen3:8b' when 1 then 'gemma-2' when 2 then 'llama3' when 3 then 'deepseek r1' when 4 then 'gpt-oss:20b' when 5 then 'my llama' else lower(p_name) end as m from part) group by 1")(
    lambda p: p.groupBy(u.source_of(F.coalesce(F.try_element_at(F.array(*map(F.lit, ("Qwen3:8b", "Gemma-2", "LLAMA3", "DeepSeek R1", "gpt-oss:20b", "my llama"))), (F.col("p_partkey") % 7 + 1).cast("int")), F.col("p_name")), F.when(F.col("p_partkey") % 3 == 0, "LMStudio").when(F.col("p_partkey") % 3 == 2, F.col("p_brand"))).alias("source")).agg(F.count("*").alias("n")))
add("f7_response_total", ["calls"], "select source, cast(sum(greatest(input + output, cached + output)) as bigint) as tokens, count(case when cached + output < input + output then 1 end) as errors from calls group by 1")(
    lambda c: c.groupBy("source").agg(F.sum(u.response_tokens(F.col("input"), F.col("output"), F.col("cached") + F.col("output"))[0]).alias("tokens"), F.count_if(u.response_tokens(F.col("input"), F.col("output"), F.col("cached") + F.col("output"))[1]).alias("errors")))
add_table("f11_utf16", ["documents"], "select doc_id, length(text) + length(regexp_replace(text, '[^\\x{10000}-\\x{10FFFF}]', '', 'g')) as units from documents")(
    lambda d: d.select("doc_id", u.utf16_length(F.col("text")).cast("bigint").alias("units")))
add("f12_key", ["keys"], "select request_id, source, 'sha256:' || sha256(source || ':' || request_id) as key from keys")(
    lambda k: k.select("request_id", "source", u.request_key(F.concat_ws(":", "source", "request_id")).alias("key")))
add_table("f14_slug", ["customer"], "select c_custkey, regexp_replace(regexp_replace(lower(c_name), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') as slug from customer")(
    lambda c: c.select("c_custkey", u.slug(F.col("c_name")).alias("slug")))
add("f16_date", ["receipts"], "select count(*) as n, count(case when try_cast(t as date) is not null then 1 end) as real_days from (select case when tokens % 3 = 0 then substr(cast(day as varchar), 1, 8) || '31' else cast(day as varchar) end as t from receipts)")(
    lambda r: r.select(F.when(F.col("tokens") % 3 == 0, F.concat(F.substring(F.col("day").cast("string"), 1, 8), F.lit("31"))).otherwise(F.col("day").cast("string")).alias("t")).agg(F.count("*").alias("n"), F.count_if(u.is_calendar_date(F.col("t"))).alias("real_days")))
TOKENS = "case when t >= 1000000 then cast(cast(floor(t * 10 / 1000000 + 0.5) as bigint) // 10 as varchar) || '.' || cast(cast(floor(t * 10 / 1000000 + 0.5) as bigint) % 10 as varchar) || 'M' when t >= 1000 then cast(cast(floor(t / 1000 + 0.5) as bigint) as varchar) || 'K' else cast(t as varchar) end"
add("f18_format", ["daily"], f"select source, t as tokens, {TOKENS} as text, case when p = 0 then '0%' when p < 1 then '<1%' else cast(cast(floor(p + 0.5) as bigint) as varchar) || '%' end as share from (select source, t, 100.0 * t / sum(t) over () as p from (select source, cast(sum(tokens) as bigint) t from daily group by 1))")(
    lambda d: (lambda s: s.crossJoin(F.broadcast(s.agg(F.sum("tokens").alias("all_tokens")))).select("source", "tokens", u.format_tokens(F.col("tokens")).alias("text"), u.share_text(F.col("tokens"), F.col("all_tokens")).alias("share")))(d.groupBy("source").agg(F.sum("tokens").alias("tokens"))))
add("f18_small_numbers", ["calls"], f"select request_id, origin, t as tokens, {TOKENS} as text from (select distinct request_id, origin, case when input % 3 = 0 then input else output end as t from calls)")(
    lambda c: (lambda t: c.select("request_id", "origin", t.alias("tokens"), u.format_tokens(t).alias("text")).distinct())(F.when(F.col("input") % 3 == 0, F.col("input")).otherwise(F.col("output"))))
add("f15_origin_parts", ["receipts"], "select distinct o as origin, case when o is null then 'unattributed' when starts_with(o, 'account/') then 'account' else 'machine' end as kind, case when not starts_with(o, 'account/') then split_part(o, '/', 1) end as machine, case when not starts_with(o, 'account/') then nullif(split_part(o, '/', 2), '') end as profile from (select case when tokens % 4 = 0 then 'account/' || source when tokens % 4 = 1 then source else origin end as o from receipts)")(
    lambda r: (lambda o: r.select(o.alias("origin"), u.origin_parts(o).alias("p")).select("origin", "p.*").distinct())(F.when(F.col("tokens") % 4 == 0, F.concat(F.lit("account/"), "source")).when(F.col("tokens") % 4 == 1, F.col("source")).otherwise(F.col("origin"))))
add("f17_texts", ["counters"], "select event_id, cast(floor(epoch(ts)) as bigint) as seconds from (select event_id, case when k % 4 < 3 then ts end as ts from counters)")(
    lambda c: c.select("event_id", F.unix_timestamp(u.any_instant(F.when(F.col("k") % 4 == 0, F.unix_timestamp("ts").cast("string")).when(F.col("k") % 4 == 1, F.unix_millis("ts").cast("string")).when(F.col("k") % 4 == 2, F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'")).otherwise("no time"))).alias("seconds")))
add_table("f20_round", ["lineitem"], "select cast(floor((l_discount - 0.05) * 10 + 0.5) as bigint) as r, count(*) as n from lineitem group by 1")(
    lambda t: t.groupBy(u.js_round((F.col("l_discount") - 0.05) * 10).cast("bigint").alias("r")).agg(F.count("*").alias("n")))
add("f24_label", ["calls"], "select distinct s as source, case s when 'openai_api' then 'OpenAI API' when 'gpt_oss' then 'GPT-OSS' when 'zed_agent' then 'Zed agent' else array_to_string(list_transform(string_split(s, '_'), lambda p: upper(p[1]) || p[2:]), ' ') end as label from (select case input % 7 when 0 then 'openai_api' when 1 then 'gpt_oss' when 2 then 'zed_agent' when 3 then 'myNew_thing' else source end as s from calls)")(
    lambda c: c.select(F.coalesce(F.try_element_at(F.array(*map(F.lit, ("openai_api", "gpt_oss", "zed_agent", "myNew_thing"))), (F.col("input") % 7 + 1).cast("int")), F.col("source")).alias("source")).distinct().withColumn("label", u.source_label(F.col("source"))))

add("w1_latest", ["calls"], f", {LATEST} select source, request_id, day, input, output, cached from latest")(
    lambda c: extract.latest_per_request(c).select("source", "request_id", "day", "input", "output", "cached"))
BEFORE = "lag(k) over (partition by session order by ts, event_id)"
add("w2_adjacent", ["counters"], f"select session, event_id, k, coalesce(k = b, false) as repeat, coalesce(k < b, false) as reset from (select *, {BEFORE} as b from counters)")(
    lambda c: extract.adjacent_dedupe(c).select("session", "event_id", "k", "repeat", "reset"))
add("w3_increments", ["counters"], f"select session, event_id, (b is null or k < b) as fresh, case when b is null or k < b then k else k - b end as d_k from (select *, {BEFORE} as b from counters)")(
    lambda c: extract.increments(c).select("session", "event_id", "fresh", "d_k"))
add("w4_carry", ["counters"], "select session, event_id, last_value(case when k % 7 = 0 then 'm' || k end ignore nulls) over (partition by session order by ts, event_id rows between unbounded preceding and current row) as carried from counters")(
    lambda c: extract.carry_model(c.withColumn("model", F.when(F.col("k") % 7 == 0, F.concat(F.lit("m"), "k")))).select("session", "event_id", "carried"))
FORKS = "heads as (select doc_id as id, split_part(text, chr(10), 1) as key from documents), forks as (select id, min(id) over w as parent, count(*) over w as candidates from heads window w as (partition by key order by id rows between unbounded preceding and 1 preceding))"


def _heads(d):
    return d.select(F.col("doc_id").alias("id"), F.substring_index("text", "\n", 1).alias("key"))


add_table("j9_parent_link", ["documents"], f"with {FORKS} select id, parent, candidates, case when candidates = 0 then 'missing' when candidates = 1 then 'unique' else 'ambiguous' end as state from forks")(
    lambda d: extract.link_forks(_heads(d)))
add_table("j10_prefix", ["documents"], f"with {FORKS}, lines as (select doc_id as id, unnest(range(len(string_split(text, chr(10))))) as pos, unnest(string_split(text, chr(10))) as value from documents), met as (select c.id, f.parent, c.pos, coalesce(c.value = p.value, false) as same from lines c join forks f on c.id = f.id and f.parent is not null left join lines p on p.id = f.parent and p.pos = c.pos) select id, parent, coalesce(min(case when not same then pos end), max(pos) + 1) as prefix from met group by 1, 2")(
    lambda d: extract.inherited_prefix(d.select(F.col("doc_id").alias("id"), F.posexplode(F.split("text", "\n")).alias("pos", "value")).withColumn("pos", F.col("pos").cast("bigint")), extract.link_forks(_heads(d))))
add("p10_malformed", ["counters"], "select source, count(*) as n_rows, count(case when amount < 0 or k = 99 then 1 end) as n_bad, coalesce(bool_or(amount < 0 or k = 99), false) as unknown from counters group by 1")(
    lambda c: extract.assert_counters(c, (F.col("amount") < 0) | (F.col("k") == 99)))
add("a6_transcript_daily", ["calls"], f", {LATEST} select day, source, origin, cast(sum(input + cache_write + output) as bigint) as tokens, count(*) as calls, cast(sum(input) as bigint) as input_tokens, cast(sum(output) as bigint) as output_tokens, cast(sum(cached) as bigint) as cached_input_tokens, cast(sum(cache_write) as bigint) as cache_write_tokens from latest group by 1, 2, 3 having sum(input + cache_write + output) > 0")(extract.transcript_receipts)
add("a7_rollout_daily", ["counters"], f"select day, source, cast(sum(amount) as bigint) as tokens, count(*) as calls, count(case when k < b then 1 end) as resets, case when count(case when k < b then 1 end) > 0 then 'counter_reset' end as coverage_reason from (select *, {BEFORE} as b from counters) where coalesce(k <> b, true) group by 1, 2")(extract.rollout_receipts)
add("a8_session_daily", ["counters"], f"select day, source, cast(sum(d) as bigint) as tokens, count(*) as calls, count(case when fresh then 1 end) as fresh_starts from (select day, source, (b is null or k < b) as fresh, case when b is null or k < b then k else k - b end as d from (select *, {BEFORE} as b from counters)) where d > 0 group by 1, 2")(extract.session_receipts)
add("a10_table_daily", ["calls"], "select day, source, cast(sum(case when cached > 0 then greatest(0, input - cached) + output else input + output end) as bigint) as tokens, count(*) as calls, 0 as undecided from calls group by 1, 2")(
    lambda c: extract.table_receipts(c.withColumn("total", F.col("input") + F.col("output")), "inclusive"))
add("a11_task_daily", ["calls"], "select day, source, cast(sum(case when cache_write = 0 and cached = 0 then input + output when input < cached + cache_write then input + cache_write + output else input + cache_write + output end) as bigint) as tokens, count(*) as calls, count(case when cache_write = 0 and cached = 0 then 1 end) as n_plain, count(case when not (cache_write = 0 and cached = 0) and input < cached + cache_write then 1 end) as n_legacy, count(case when not (cache_write = 0 and cached = 0) and input >= cached + cache_write then 1 end) as n_given from calls group by 1, 2")(
    lambda c: extract.task_receipts(c, "legacy"))
add("a14_chat_estimate", ["chat"], "select day, cast(sum(ceil((length(text) + length(regexp_replace(text, '[^\\x{10000}-\\x{10FFFF}]', '', 'g'))) / 4.0)) as bigint) as tokens, count(case when role = 'assistant' then 1 end) as calls from chat where role in ('user', 'assistant') group by 1")(extract.estimate_chat)
add_table("f10_message_chars", ["documents"], f"select doc_id, cast(case when replace(text, 'e', '') <> '' then {UNITS.format("replace(text, 'e', '')")} else {UNITS.format('lang')} end + {UNITS.format('source')} as bigint) as units from documents")(
    lambda d: d.select("doc_id", extract.message_chars(F.split("text", "e"), F.col("lang"), F.array("source")).cast("bigint").alias("units")))
add("p9_since", ["daily"], "select day, source, tokens from daily where day >= date '1995-03-15'")(
    lambda d: extract.since(d, "1995-03-15").select("day", "source", "tokens"))
SESSIONS = "s as (select account as session, request_id as message_id, ts, day, source, origin as model, input, output, case when source = 'tool_r' and input < 300 then input + 1 else least(cached, input) end as cached, cache_write as thoughts, case when cached % 3 <> 0 then cached end as tool from calls), k as (select * from s qualify row_number() over (partition by source, session, message_id order by ts desc, cached desc, day desc, input desc, model desc, output desc, thoughts desc, tool desc nulls last) = 1)"


def _sessions(c):
    cached = F.when((F.col("source") == "tool_r") & (F.col("input") < 300), F.col("input") + 1).otherwise(F.least("cached", "input"))
    return c.select(F.col("account").alias("session"), F.col("request_id").alias("message_id"), "ts", "day", "source", F.col("origin").alias("model"), "input", "output", cached.alias("cached"), F.col("cache_write").alias("thoughts"), F.when(F.col("cached") % 3 != 0, F.col("cached")).alias("tool"))


add("a9_chat_sessions", ["calls"], f", {SESSIONS} select day, source, cast(sum(input - cached + output + thoughts + coalesce(tool, 0)) as bigint) as tokens, count(*) as calls, cast(sum(cached) as bigint) as cached, cast(sum(thoughts) as bigint) as thoughts, array_to_string(list_sort(list(distinct model)), ',') as models from k where source not in (select source from s where cached > input) group by 1, 2")(
    lambda c: extract.chat_session_receipts(_sessions(c)))
add("a13_threads", ["calls"], "select day, source, cast(sum(input + cache_write + output) as bigint) as tokens, cast(sum(n) as bigint) as calls, cast(sum(cached) as bigint) as cached, array_to_string(list_sort(list(distinct origin)), ',') as models from (select case when cached % 5 <> 0 then day else day + 1 end as day, case when source = 'tool_n' then 'tool_a' else source end as source, input, output, cache_write, cached, origin, input % 4 as n from calls) where source <> 'tool_r' group by 1, 2 having sum(input + cache_write + output) > 0")(
    lambda c: extract.thread_receipts(c.select(F.when(F.col("source") == "tool_n", "tool_a").otherwise(F.col("source")).alias("source"), F.when(F.col("cached") % 5 != 0, F.col("day")).alias("created"), F.date_add("day", 1).alias("updated"), F.when(F.col("source") != "tool_r", F.col("input")).alias("input"), "output", "cache_write", "cached", (F.col("input") % 4).alias("requests"), F.col("origin").alias("model"))))
add("a10_table_undecided", ["calls"], "select day, source, case when source <> 'tool_n' then cast(sum(case when cached > 0 then null else input + output end) as bigint) end as tokens, count(*) as calls, case when source = 'tool_n' then (select count(*) from calls where source = 'tool_n' and cached > 0) else 0 end as undecided from (select day, source, input, output, case when source = 'tool_n' then cached else 0 end as cached from calls) group by 1, 2")(
    lambda c: extract.table_receipts(c.withColumn("total", F.col("input") + F.col("output")).withColumn("cached", F.when(F.col("source") == "tool_n", F.col("cached")).otherwise(0)), None))
add_table("f6_config_model", ["part"], "select p_brand, case p_partkey % 4 when 0 then 'claude-opus-4-6' when 1 then 'gemini-3-pro-preview' when 2 then 'claude-sonnet-4-5' end as model, count(*) as n from part group by 1, 2")(
    lambda p: p.select("p_brand", u.model_of_config(F.element_at(F.array(F.lit(" Claude Opus 4.6"), F.lit("Gemini 3"), F.lit("ANTHROPIC - Sonnet 4.5 "), F.lit("my sonnet")), (F.col("p_partkey") % 4 + 1).cast("int"))).alias("model")).groupBy("p_brand", "model").agg(F.count("*").alias("n")))
add("f8_compatible", ["calls"], "select source, cast(sum(case when c <= input then input - c + output end) as bigint) as tokens, count(case when c > input then 1 end) as refused from (select source, input, output, coalesce(case when cached % 2 = 0 then cached end, case when cache_write % 3 <> 0 then cache_write end, 0) as c from calls) group by 1")(
    lambda c: (lambda t: c.groupBy("source").agg(F.sum(t).alias("tokens"), F.count_if(t.isNull()).alias("refused")))(u.compatible_tokens(F.col("input"), F.col("output"), F.when(F.col("cached") % 2 == 0, F.col("cached")), F.when(F.col("cache_write") % 3 != 0, F.col("cache_write")))))
add("f9_cache_writes", ["calls"], "select source, cast(sum(case when cached % 2 = 0 then cached + cache_write when cached % 3 = 0 then cache_write else 0 end) as bigint) as writes, count(case when cached % 2 = 0 or cached % 3 = 0 then 1 end) as reported from calls group by 1")(
    lambda c: (lambda w, told: c.groupBy("source").agg(F.sum(w).alias("writes"), F.count_if(told).alias("reported")))(*u.cache_writes(F.when(F.col("cached") % 2 == 0, F.create_map(F.lit("a"), F.col("cached"), F.lit("b"), F.col("cache_write"), F.lit("c"), F.lit(None).cast("bigint"))), F.when(F.col("cached") % 3 == 0, F.col("cache_write")))))
add("a15_report_daily", ["calls"], "select day, account, cast(sum(input + cache_write + output) as bigint) as tokens, cast(sum(case when cached % 5 = 0 then 2 end) as bigint) as calls, array_to_string(list_sort(list(distinct source)), ',') as models, array_to_string(list_sort(list(distinct origin)), ',') as endpoints, cast(sum(cached) as bigint) as cached_input_tokens from calls group by 1, 2")(
    lambda c: extract.report_receipts(c.withColumn("calls", F.when(F.col("cached") % 5 == 0, 2).cast("bigint"))))
add("a16_months", ["daily"], "select cast(date_trunc('month', day) as date) as month, count(distinct day) as days, cast(sum(tokens) as bigint) as tokens, min(day) as first_day, max(day) as last_day from daily group by 1")(extract.report_months)
add("s9_ledger_join", ["calls"], "select c.source, coalesce(s.scope, 'none') as provider, count(*) as n, cast(sum(c.input) as bigint) as input from calls c left join (select distinct account, 'p' || account as scope from calls where account <> 'a2') s on c.account = s.account group by 1, 2")(
    lambda c: c.join(c.where("account <> 'a2'").select("account", F.concat(F.lit("p"), "account").alias("scope")).distinct(), "account", "left").groupBy("source", F.coalesce("scope", F.lit("none")).alias("provider")).agg(F.count("*").alias("n"), F.sum("input").alias("input")))

ENTRIES = f"select day, source, cast(sum(tokens) as bigint) as tokens, cast(sum(calls) as bigint) as calls, case when bool_or(fidelity = 'estimated') then 'estimated' else 'exact' end as fidelity, {WEAKEST} as authority, max(coverage) as coverage, count(*) as receipts from receipts group by 1, 2"
add("a1_entries", ["receipts"], ENTRIES)(daily.aggregate_entries)
add("a2_components", ["receipts"], "select day, source, " + ", ".join(f"case when count({c}) = count(*) then cast(sum({c}) as bigint) end as {c}" for c in ("input_tokens", "output_tokens", "cached_input_tokens")) + " from receipts group by 1, 2")(daily.component_sums)
add("a3_authority", ["receipts"], f"select day, source, {WEAKEST} as authority from receipts group by 1, 2")(daily.authority_entries)
add("a4_by_origin", ["receipts"], "select day, source, origin, cast(sum(tokens) as bigint) as tokens from receipts where origin is not null group by 1, 2, 3")(daily.by_origin)
add("a5_totals", ["calls"], f", {LATEST}, e as (select day, source, sum(input + cache_write + output) as tokens from latest group by 1, 2) select day, cast(sum(tokens) as bigint) as total, cast(sum(tokens) as bigint) as exact, 0 as estimated, count(*) as n_sources from e group by 1")(
    lambda c: daily.day_totals(daily.aggregate_entries(extract.transcript_receipts(c).withColumns({"fidelity": F.lit("exact"), "authority": F.lit("tool"), "coverage": F.lit(None).cast("string")}))))
add("r14_merge", ["daily", "receipts"], f", e as ({ENTRIES}), e2 as (select date '1995-01-01' + (datediff('day', date '1970-01-01', day) % 400)::int as day, 'urgent' as source, sum(tokens) as tokens, sum(calls) as calls, max(fidelity) as fidelity from e group by 1), dr as (select day, max(driver) as driver from daily group by 1) select day, source, tokens, calls, fidelity, driver from daily where (day, source) not in (select (day, source) from e2) union all select e2.day, e2.source, cast(e2.tokens as bigint), cast(e2.calls as bigint), e2.fidelity, case when dr.day is null then 'unreviewed' else dr.driver end from e2 left join dr on e2.day = dr.day")(
    lambda d, r: daily.merge_daily(d, daily.aggregate_entries(r).groupBy(F.date_add(F.lit("1995-01-01").cast("date"), (F.datediff("day", F.lit("1970-01-01")) % 400)).alias("day"), F.lit("urgent").alias("source")).agg(F.sum("tokens").alias("tokens"), F.sum("calls").alias("calls"), F.max("fidelity").alias("fidelity"))))
WIDE = "select day, cast(sum(tokens) as bigint) as total_tokens, array_to_string(list_sort(list(distinct source)), ' ') as sources, case when bool_and(fidelity = 'exact') then 'exact' else 'mixed' end as fidelity from {} group by 1"
add("s18_export_wide", ["daily"], WIDE.format("daily"))(daily.export_wide)
DETAIL = f", e as ({ENTRIES}), c as (select day, source, case when count(input_tokens) = count(*) then cast(sum(input_tokens) as bigint) end as input_tokens from receipts group by 1, 2), o as (select day, source, origin, cast(sum(tokens) as bigint) as origin_tokens from receipts where origin is not null group by 1, 2, 3), j as (select e.*, c.input_tokens, o.origin, o.origin_tokens, count(o.origin) over (partition by e.day, e.source) as n, row_number() over (partition by e.day, e.source order by o.origin nulls first) as f from e join c using (day, source) left join o on e.day = o.day and e.source = o.source) "
add("s19_export_detail", ["receipts"], DETAIL + "select day, source, coalesce(origin, '') as origin, coalesce(origin_tokens, tokens) as tokens, case when n <= 1 then calls end as calls, case when f = 1 then input_tokens end as input_tokens from j")(
    lambda r: daily.export_detail(daily.aggregate_entries(r).join(daily.component_sums(r), ["day", "source"]), daily.by_origin(r)))
add("s20_parity", ["daily"], "select day, source, tokens, side from (select day, source, tokens, 'stored' as side from daily where day < date '1993-01-01' union all select day, source, tokens + 1, 'computed' from daily where day < date '1993-01-01') where day < date '1993-01-01'")(
    lambda d: (lambda x: daily.check_export(x, x.withColumn("tokens", F.when(F.col("day") < "1993-01-01", F.col("tokens") + 1).otherwise(F.col("tokens")))))(d.select("day", "source", "tokens")))
LONG = f", e as ({ENTRIES}), o as (select day, source, origin, cast(sum(tokens) as bigint) as origin_tokens from receipts where origin is not null group by 1, 2, 3) "


def _long(r):
    return daily.aggregate_entries(r).join(daily.by_origin(r).withColumnRenamed("tokens", "origin_tokens"), ["day", "source"], "left")


add("p11_filter", ["receipts"], LONG + "select e.day, e.source, e.fidelity, o.origin_tokens as tokens, case when o.origin_tokens = e.tokens then e.calls end as calls from e join o on e.day = o.day and e.source = o.source where o.origin = 'machine/m1' and (o.origin_tokens > 0 or (o.origin_tokens = e.tokens and e.calls is not null))")(
    lambda r: daily.filter_daily(_long(r), origin="machine/m1"))
add("p12_window", ["daily"], "select day, source, tokens from daily where day <= date '1995-06-30' and day > date '1995-06-30' - 90")(
    lambda d: daily.visible_window(d, 90, "1995-06-30").select("day", "source", "tokens"))
add("p12_whole_window", ["daily"], "select least(date '1991-06-01', min(day)) as start, date '1998-12-31' as \"end\" from daily")(
    lambda d: daily.window_range(daily.visible_window(d, None, "1998-12-31"), None, "1998-12-31", "1991-06-01"))
add("p13_activity", ["receipts"], "select day, source, scope, (coalesce(calls > 2, false) or coalesce(cached_input_tokens > 500, false)) as active from receipts")(
    lambda r: r.select("day", "source", "scope", daily.has_activity(F.col("calls") - 2, F.col("cached_input_tokens") - 500).alias("active")))
add("p18_unpivot", ["daily"], "select day, source, cast(sum(tokens) as bigint) as tokens from daily where source in ('urgent', 'high', 'low') group by 1, 2")(
    lambda d: daily.normalize_legacy(d.groupBy("day").pivot("source", ["urgent", "high", "low"]).agg(F.sum("tokens")), "day", ["urgent", "high", "low"]))
add("u1_union", ["calls", "receipts"], "select day, source, cast(sum(tokens) as bigint) as tokens, count(scope) as scoped from (select day, source, input + output as tokens, null as scope from calls union all select day, source, tokens, scope from receipts) group by 1, 2")(
    lambda c, r: daily.union_receipts(c.select("day", "source", (F.col("input") + F.col("output")).alias("tokens")), r.select("day", "source", "tokens", "scope")).groupBy("day", "source").agg(F.sum("tokens").alias("tokens"), F.count("scope").alias("scoped")))
