"""Projections of the star-schema tables to the shapes of a usage ledger, as DataFrames and as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tallyhouse.sources.tables import table

#: name -> (table, SQL that both Spark and DuckDB run; {t} stands for the table)
SQL: dict[str, tuple[str, str]] = {
    "calls": ("lineitem", """
        select concat(l_orderkey, '-', l_linenumber) as request_id, cast(l_shipdate as timestamp) as ts, cast(l_shipdate as date) as day,
          case l_returnflag when 'A' then 'tool_a' when 'N' then 'tool_n' else 'tool_r' end as source,
          concat('machine/m', l_suppkey % 4) as origin, concat('a', l_orderkey % 3) as account,
          cast(100 * l_quantity as bigint) as input, cast(l_quantity * round(100 * l_discount) as bigint) as cached,
          cast(l_quantity * round(100 * l_tax) as bigint) as cache_write, cast(floor(l_extendedprice) as bigint) as output
        from {t}"""),
    "counters": ("events", """
        select user_id as session, cast(ts as timestamp) as ts, cast(ts as date) as day, event_id, event_type as source,
          cast(regexp_extract(props, '([0-9]+)', 1) as bigint) as k, cast(floor(value * 10) as bigint) as amount
        from {t}"""),
    "receipts": ("events", """
        select cast(ts as date) as day, event_type as source, concat('s', user_id % 10) as scope,
          concat(event_type, ':', user_id % 10, ':', cast(cast(ts as date) as string)) as snapshot_key,
          case when user_id % 10 < 4 then 'tool' when user_id % 10 < 7 then 'provider' when user_id % 10 < 9 then 'reconstructed' else 'estimated' end as authority,
          case when user_id % 10 = 9 then 'estimated' else 'exact' end as fidelity,
          case when user_id % 10 = 5 then null else concat('machine/m', user_id % 4) end as origin,
          case when user_id % 10 = 7 then 'incomplete' end as coverage,
          case when user_id % 10 = 8 then null else count(*) end as calls,
          cast(sum(cast(floor(value * 10) as bigint)) as bigint) as tokens,
          cast(sum(cast(floor(value * 7) as bigint)) as bigint) as input_tokens,
          cast(sum(cast(floor(value * 10) as bigint) - cast(floor(value * 7) as bigint)) as bigint) as output_tokens,
          case when user_id % 10 = 2 then null else cast(sum(cast(floor(value * 3) as bigint)) as bigint) end as cached_input_tokens
        from {t} group by cast(ts as date), event_type, user_id % 10, case when user_id % 10 = 5 then null else concat('machine/m', user_id % 4) end"""),
    "snaps": ("events", """
        select key, source, day, event_id, tokens, case when k < 3 then n - 2 else n end as calls, k from (
          select concat(event_type, ':', user_id % 10, ':', cast(cast(ts as date) as string)) as key, event_type as source, cast(ts as date) as day, event_id,
            cast(regexp_extract(props, '([0-9]+)', 1) as bigint) as k,
            cast(sum(cast(regexp_extract(props, '([0-9]+)', 1) as bigint)) over w as bigint) as tokens, cast(count(*) over w as bigint) as n
          from {t} window w as (partition by event_type, user_id % 10, cast(ts as date) order by ts, event_id rows between unbounded preceding and current row)) s"""),
    "keys": ("lineitem", """
        select distinct concat(l_orderkey, '-', l_linenumber) as request_id,
          case l_returnflag when 'A' then 'tool_a' when 'N' then 'tool_n' else 'tool_r' end as source,
          case l_returnflag when 'A' then 'tool' when 'N' then 'provider' else 'estimated' end as authority,
          concat('scope', l_orderkey % 3) as scope from {t}"""),
    "claims": ("events", """
        select concat(event_type, ':', user_id, ':', cast(cast(ts as date) as string)) as receipt_id,
          case when user_id % 4 <> 0 then concat('snap:', event_type, ':', user_id, ':', cast(cast(ts as date) as string)) end as snapshot_key,
          cast(ts as date) as day, event_type as source, case when event_type = 'error' and user_id % 6 = 0 then 's9' else concat('s', user_id % 3) end as scope,
          case event_type when 'click' then 'provider' when 'purchase' then 'reconstructed' when 'error' then 'estimated' else 'tool' end as authority,
          case when event_type = 'error' then 'estimated' else 'exact' end as fidelity,
          cast(sum(cast(floor(value * 10) as bigint)) as bigint) as tokens, count(*) as calls,
          case when user_id % 7 <> 0 then sort_array(collect_set(concat('q', user_id, '-', cast(floor(dayofmonth(cast(ts as date)) / 2) as int), '-', cast(regexp_extract(props, '([0-9]+)', 1) as bigint) % 3))) end as keys
        from {t} group by event_type, user_id, cast(ts as date)"""),
    "daily": ("orders", """
        select cast(o_orderdate as date) as day, regexp_replace(lower(o_orderpriority), '[^a-z]+', '{g}') as source,
          cast(sum(cast(floor(o_totalprice) as bigint)) as bigint) as tokens, count(*) as calls,
          case when max(case when o_orderstatus = 'P' then 1 else 0 end) = 1 then 'estimated' else 'exact' end as fidelity,
          concat('machine/c', min(o_custkey % 5)) as origin,
          case min(o_orderpriority) when '1-URGENT' then 'feature' when '2-HIGH' then 'bugfix' when '3-MEDIUM' then 'unknown' when '4-NOT SPECIFIED' then 'unreviewed' end as driver
        from {t} group by cast(o_orderdate as date), regexp_replace(lower(o_orderpriority), '[^a-z]+', '{g}')"""),
    "chat": ("conversations", "select conv_id, turn, role, text, cast(date_add(date '2025-01-01', cast(conv_id % 60 as int)) as date) as day from {t}"),
}


def bind(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The binding ``name`` over the tables below ``sf_dir``."""
    source, sql = SQL[name]
    sql = sql.replace("{t}", "{source_rows}").replace("{g}", "")
    return spark.sql(sql, source_rows=table(spark, sf_dir, source))


def duck(*names: str) -> str:
    """A WITH clause that defines the bindings in DuckDB."""
    parts = []
    for name in names:
        source, sql = SQL[name]
        text = sql.replace("{t}", source).replace("'{g}')", "'', 'g')").replace("as string)", "as varchar)").replace("sort_array(collect_set(", "list_sort(list(distinct ").replace("date_add(date '2025-01-01', cast(conv_id % 60 as int))", "date '2025-01-01' + cast(conv_id % 60 as int)")
        parts.append(f"{name} as ({text})")
    return "with " + ", ".join(parts) + " "
