"""Registered queries: receipt-level rules of costs, transport, decisions, history, corrections and evidence text."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyhouse.operators import privacy, receipts
from tallyhouse.plans.usage_queries import add

COST = "tokens % 7"


def _costs(c):
    k = F.col("tokens") % 7
    cost = F.struct(
        F.when(k == 1, 2).otherwise(1).alias("schema_version"), F.when(k == 2, "other").otherwise("openai_costs_day").alias("basis"), F.when(k == 3, "007").otherwise(F.concat(F.col("tokens").cast("string"), F.lit(".50e-3"))).alias("amount"),
        F.when(k == 4, "US").otherwise("usd").alias("currency"), F.when(k == 5, "minor").otherwise("major").alias("unit"), F.lit("reported").alias("currency_basis"),
    )
    return c.withColumn("cost", F.when(k != 6, cost))


add("p3_costs", ["claims"], f"select receipt_id, case {COST} when 1 then 'schema_version' when 2 then 'basis' when 3 then 'amount' when 4 then 'currency' when 5 then 'unit' else '' end as errors from claims")(
    lambda c: _costs(c).select("receipt_id", F.array_join(receipts.cost_errors(F.col("cost")), ",").alias("errors")))
add("p4_transport", ["claims"], "select receipt_id, case when source = 'view' and scope = 's1' and calls < 3 and snapshot_key like 'snap:%' then 'api' when calls = 1 then 'native_api_capture' when calls = 2 then 'tool_result_capture' else 'cli' end as surface, case when source = 'view' and scope = 's1' and calls < 3 and snapshot_key like 'snap:%' then case calls when 1 then 'native_api_capture' else 'tool_result_capture' end end as capture_method from claims")(
    lambda c: receipts.normalize_receipts(c.withColumn("provider", F.col("scope")).withColumn("surface", F.when(F.col("calls") == 1, "native_api_capture").when(F.col("calls") == 2, "tool_result_capture").otherwise("cli")), "view", "s1", "snap:").select("receipt_id", "surface", "capture_method"))
add("p15_receipt_privacy", ["claims"], "select receipt_id, concat_ws(',', case when tokens % 5 = 0 then 'unknown_field' end, case when tokens % 3 = 0 then 'long_label' end, case when keys is not null then 'bad_digest' end, case when calls = 2 then 'email' end) as findings from claims")(
    lambda c: privacy.receipt_privacy(c.select("receipt_id", F.parse_json(F.to_json(F.struct(F.when(F.col("tokens") % 3 == 0, F.repeat(F.lit("s"), 200)).otherwise(F.col("source")).alias("source"), F.col("keys").alias("correlation_keys"), F.when(F.col("calls") == 2, "by a@b.org").alias("provenance"), F.when(F.col("tokens") % 5 == 0, 1).alias("extra")))).alias("receipt")), ["source", "correlation_keys", "provenance"]).select("receipt_id", F.array_join("findings", ",").alias("findings")))
add("p17_provenance", ["claims"], "select receipt_id, concat_ws(',', case when tokens % 4 = 0 then 'method' end, case when calls > 2 then 'confidence' end, case when coalesce(len(keys), 0) = 0 then 'signals' end, case when tokens % 6 = 0 then 'digest' end) as errors from claims")(
    lambda c: privacy.provenance_errors(c.select("receipt_id", F.when(F.col("tokens") % 4 == 0, "odd").otherwise("rule").alias("method"), (F.col("calls") / 2).alias("confidence"), F.coalesce("keys", F.array().cast("array<string>")).alias("signals"), F.when(F.col("tokens") % 6 == 0, "md5:0").otherwise(F.concat(F.lit("sha256:"), F.sha2("receipt_id", 256))).alias("digest"))).select("receipt_id", F.array_join("errors", ",").alias("errors")))
add("p19_public", ["daily", "claims"], "select source, min(day) as first, max(day) as last, 'covered' as status, null as entries from daily group by 1 union all select source, null, null, null, count(*) from claims group by 1")(
    lambda d, c: (lambda v: v[0].select("source", F.col("from").alias("first"), F.col("to").alias("last"), "status").unionByName(v[1], allowMissingColumns=True))(privacy.public_view(d.groupBy("source").agg(F.min("day").alias("from"), F.max("day").alias("to"), F.lit("covered").alias("status"), F.lit("note").alias("note")), c)))
add("j13_decisions", ["claims"], "select source, account, mode, concat_ws(',', case when n > 1 then 'repeated' end, case when mode = 'odd' then 'mode' end, case when decided_on is null then 'date' end, case when evidence = ' ' then 'evidence' end) as errors from (select source, scope as account, case when tokens % 4 = 0 then 'odd' when tokens % 4 = 1 then 'additive' else 'overlapping' end as mode, case when calls < 2 then day end as decided_on, case when tokens % 5 = 0 then ' ' else 'e' end as evidence, count(*) over (partition by source, scope) as n from claims where day(day) < 3) where n > 1 or mode = 'odd' or decided_on is null or evidence = ' '")(
    lambda c: receipts.decision_errors(c.where("dayofmonth(day) < 3").select("source", F.col("scope").alias("account"), F.when(F.col("tokens") % 4 == 0, "odd").when(F.col("tokens") % 4 == 1, "additive").otherwise("overlapping").alias("mode"), F.when(F.col("calls") < 2, F.col("day")).alias("decided_on"), F.when(F.col("tokens") % 5 == 0, " ").otherwise("e").alias("evidence"))).select("source", "account", "mode", F.array_join("errors", ",").alias("errors")))
add("j18_costs_of_days", ["claims"], ", k as (select day, max(tokens) || '.50' as amount from claims where day(day) % 3 <> 0 group by 1) select receipt_id, amount as cost_amount, case when amount is not null then 'USD' end as cost_currency from claims left join k using (day)")(
    lambda c: receipts.attach_cost(c, c.where("dayofmonth(day) % 3 <> 0").groupBy("day").agg(F.concat(F.max("tokens").cast("string"), F.lit(".50")).alias("amount"), F.lit("USD").alias("currency"))).select("receipt_id", "cost_amount", "cost_currency"))
add("a12_messages", ["calls"], ", m as (select source, account || '-' || (input % 50) as message_id, ts, day, input, output, row_number() over (partition by source, account || '-' || (input % 50) order by ts desc, input desc, output desc) as n from calls) select day, source, cast(sum(input + output) as bigint) as tokens, count(*) as calls from m where n = 1 group by 1, 2 having sum(input + output) > 0")(
    lambda c: receipts.message_receipts(c.withColumn("message_id", F.concat(F.col("account"), F.lit("-"), F.col("input") % 50)), "input", "output"))
add("r8_history", ["claims"], "select receipt_id as key, case when up then t else tokens end as tokens, case when up then c else calls end as calls, case when tokens % 4 = 0 then 1 else 0 end + case when up then 1 else 0 end as versions, up as updated from (select *, tokens + tokens % 3 - 1 as t, calls + tokens % 2 as c, tokens % 5 <> 0 and (tokens % 3 > 0 and not (tokens % 3 = 1 and tokens % 2 = 0)) and not (tokens % 4 = 0 and tokens % 3 = 2) as up from claims)")(
    lambda c: receipts.append_history(c.select(F.col("receipt_id").alias("key"), "tokens", "calls", F.when(F.col("tokens") % 4 == 0, F.array(F.struct((F.col("tokens") + 1).alias("tokens"), (F.col("calls") + F.col("tokens") % 2).alias("calls")))).otherwise(F.array().cast("array<struct<tokens:bigint,calls:bigint>>")).alias("history")), c.where("tokens % 5 <> 0").select(F.col("receipt_id").alias("key"), (F.col("tokens") + F.col("tokens") % 3 - 1).alias("tokens"), (F.col("calls") + F.col("tokens") % 2).alias("calls"))).select("key", "tokens", "calls", F.size("history").alias("versions"), "updated"))
add("r11_retirements", ["claims"], ", a as (select case when tokens % 3 = 0 then 'x' else receipt_id end as id from claims where tokens % 4 <> 0) select receipt_id as id, by_ as superseded_by from (select receipt_id, case when tokens % 2 = 0 then receipt_id else 'x' end as by_ from claims where calls = 1) r where (select count(*) from a where a.id = r.by_) <> 1")(
    lambda c: receipts.check_retirements(c.where("calls = 1").select(F.col("receipt_id").alias("id"), F.when(F.col("tokens") % 2 == 0, F.col("receipt_id")).otherwise("x").alias("superseded_by")), c.where("tokens % 4 <> 0").select(F.when(F.col("tokens") % 3 == 0, "x").otherwise(F.col("receipt_id")).alias("id"))))
add("r13_corrections", ["claims"], "select case when tokens % 3 = 0 and calls = 1 then 'updated' when tokens % 3 = 0 then 'error' else 'added' end as outcome, case when tokens % 3 = 0 and calls = 1 then 'typo' end as correction, count(*) as n from claims group by 1, 2")(
    lambda c: receipts.corrected(c.withColumn("outcome", F.when(F.col("tokens") % 3 == 0, "error").otherwise("added")), F.col("calls") == 1, "typo", True).groupBy("outcome", "correction").agg(F.count("*").alias("n")))
add("f23_evidence", ["claims"], "select case when calls = 1 then 'No classified signal was available for this day' when calls = 2 then 'Source composition establishes ' || f else 'Automated classification: ' || s || ' supported ' || f end as text, count(*) as n from (select calls, case source when 'view' then 'feature work' when 'click' then 'fixes' end as f, case when tokens % 3 = 0 then 'commits and paths' when tokens % 3 = 1 then 'paths' else 'classified metadata' end as s from claims) group by 1")(
    lambda c: c.groupBy(receipts.evidence_text(F.col("source"), F.when(F.col("calls") == 1, "unresolved").when(F.col("calls") == 2, "source_derived").otherwise("rule"), F.when(F.col("tokens") % 3 == 0, F.array(F.lit("c"), F.lit("p"), F.lit("c"))).when(F.col("tokens") % 3 == 1, F.array(F.lit("p"), F.lit("?"))).otherwise(F.array(F.lit("?"))), {"view": "feature work", "click": "fixes"}, {"c": "commits", "p": "paths"}).alias("text")).agg(F.count("*").alias("n")))
