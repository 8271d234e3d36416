"""Telemetry-like queries bound to the events table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.functions.scoring import lookup
from loomgraph.operators import ops
from loomgraph.operators.scans import segment_of
from loomgraph.plans.registry import query
from loomgraph.plans.sqltext import sql_case


def micros(column: str = "ts") -> Column:
    return F.unix_micros(F.col(column).cast("timestamp"))


def k_value() -> Column:
    return F.get_json_object("props", "$.k")


def feedback_rows(t) -> DataFrame:
    return t.events.select(
        "event_id",
        F.col("event_type").alias("capability"),
        ((F.col("event_type") != "error") & (F.col("event_id") % 3 != 0)).alias("success"),
        F.col("value").alias("latency_ms"),
        F.col("ts").alias("created_at"),
    )


@query(
    "feedback_adjustment",
    """
    with r as (select *, row_number() over (partition by event_type order by ts desc, event_id desc) as rn from events),
    s as (select event_type as capability, count(*) as samples,
      avg(case when event_type <> 'error' and event_id % 3 <> 0 then 1.0 else 0.0 end) as sr, avg(greatest(0.0, value)) as ms
      from r where rn <= 200 group by 1)
    select capability, samples, round(sr, 6) as success_rate, round(greatest(-0.15, least(0.15, (sr - 0.5) * 0.24 - least(0.08, ms / 60000.0 * 0.08))), 6) as adjustment
    from s
    """,
)
def feedback_adjustment(t) -> DataFrame:
    return ops.feedback_adjustment(feedback_rows(t)).select(
        "capability",
        "samples",
        F.round("success_rate", 6).alias("success_rate"),
        F.round("adjustment", 6).alias("adjustment"),
    )


SPAN_NAMES = {"click": "tool.search", "view": "tool.read", "purchase": "context.fit"}


def spans(t) -> DataFrame:
    return t.events.select(
        F.col("user_id").cast("string").alias("trace_id"),
        F.col("event_id").alias("span_id"),
        F.col("event_id").alias("seq"),
        lookup(SPAN_NAMES, F.col("event_type"), "engine.run").alias("name"),
        F.when(F.col("event_type") == "error", "error").otherwise("ok").alias("status"),
        micros().alias("started_at"),
        F.col("value").alias("duration_ms"),
        F.create_map(F.lit("context_tokens"), k_value()).alias("attributes"),
    )


SPANS_SQL = f"""select cast(user_id as varchar) as trace_id, event_id as seq, {sql_case(SPAN_NAMES, 'event_type', 'engine.run')} as name,
  case when event_type = 'error' then 'error' else 'ok' end as status, epoch_us(ts) as started_at, value as duration_ms,
  cast(json_extract(props, '$.k') as bigint) as tok from events"""


@query(
    "trace_summary",
    f"""
    select trace_id, count(*) as spans, count(*) filter (status = 'error') as errors, round(sum(duration_ms), 4) as duration_ms,
      count(*) filter (starts_with(name, 'tool.')) as tool_calls, cast(sum(tok) as bigint) as context_tokens
    from ({SPANS_SQL}) group by trace_id
    """,
)
def trace_summary(t) -> DataFrame:
    return ops.trace_summary(spans(t)).withColumn("duration_ms", F.round("duration_ms", 4))


@query(
    "trace_names",
    f"select trace_id, row_number() over (partition by trace_id order by seq) as position, name from ({SPANS_SQL})",
)
def trace_names(t) -> DataFrame:
    rows = spans(t).withColumn("seg", segment_of(F.col("seq")))
    return ops.trace_names(rows, "seg")


@query(
    "recent_traces",
    f"select trace_id, max(started_at) as last_started from ({SPANS_SQL}) group by 1 order by 2 desc, 1 desc limit 12",
)
def recent_traces(t) -> DataFrame:
    return ops.recent_traces(spans(t), 12)


TELEMETRY_NAMES = {"view": "route.created", "click": "context.fitted", "purchase": "engine.executed"}


def telemetry(t) -> DataFrame:
    return t.events.select(
        "event_id",
        "ts",
        lookup(TELEMETRY_NAMES, F.col("event_type"), "other").alias("name"),
        F.create_map(
            F.lit("kind"),
            F.concat(F.lit("kind"), (F.col("user_id") % 4).cast("string")),
            F.lit("saved"),
            k_value(),
            F.lit("capability"),
            F.concat(F.lit("cap"), (F.col("user_id") % 3).cast("string")),
            F.lit("duration_ms"),
            F.col("value").cast("string"),
        ).alias("attributes"),
    )


@query(
    "telemetry_rollup",
    f"""
    with e as (select *, {sql_case(TELEMETRY_NAMES, 'event_type', 'other')} as name, cast(json_extract(props, '$.k') as bigint) as k from events)
    select 'counts' as section, name as key, cast(count(*) as double) as value from e group by name
    union all select 'routes', 'kind' || (user_id % 4), count(*) from e where name = 'route.created' group by 2
    union all select 'context_tokens_saved', '', sum(k) from e where name = 'context.fitted'
    union all select 'engine_avg_latency_ms', 'cap' || (user_id % 3), round(sum(value) / count(*), 2) from e where name = 'engine.executed' group by 2
    """,
)
def telemetry_rollup(t) -> DataFrame:
    return ops.telemetry_rollup(telemetry(t))


STATUS = {"error": 500, "signup": 201, "purchase": 404}


def requests(t) -> DataFrame:
    return t.events.select(
        "event_id",
        "ts",
        lookup(STATUS, F.col("event_type"), 200).alias("status"),
        F.concat(F.lit("/u/"), F.col("user_id").cast("string")).alias("path"),
        F.col("value").alias("duration_ms"),
    )


@query(
    "request_metrics",
    f"""
    with r as (select {sql_case(STATUS, 'event_type', 200)} as status, '/u/' || user_id as path, value from events)
    select 'total' as section, 'requests' as key, cast(count(*) as double) as value from r
    union all select 'total', 'errors', count(*) filter (status >= 500) from r
    union all select 'total', 'avg_duration_ms', round(avg(value), 6) from r
    union all select 'status', cast(status as varchar), count(*) from r group by 2
    union all select * from (select 'path', path, count(*) as c from r group by path order by c desc, path limit 20)
    """,
)
def request_metrics(t) -> DataFrame:
    return ops.request_metrics(requests(t)).withColumn("value", F.round("value", 6))


@query(
    "job_rollup",
    "select o_orderstatus as status, count(*) as jobs from orders group by 1",
)
def job_rollup(t) -> DataFrame:
    return ops.job_rollup(t.orders.withColumnRenamed("o_orderstatus", "status"))


def user_metric(t) -> DataFrame:
    """One metric per user; signup rows did not measure it."""
    return t.events.select(
        F.col("event_id").alias("snapshot_id"),
        F.col("user_id").alias("suite"),
        F.when(F.col("event_type") != "signup", F.col("value")).alias("value"),
        F.col("ts").alias("recorded_at"),
    )


@query(
    "metric_trend",
    """
    with r as (select user_id as suite, case when event_type <> 'signup' then value end as value, ts, event_id,
      row_number() over (partition by user_id order by ts desc, event_id desc) as rn from events),
    k as (select * from r where rn <= 100),
    s as (select suite, count(value) as samples, arg_min(value, rn * -1) filter (value is not null) as first,
      arg_max(value, rn * -1) filter (value is not null) as latest, min(value) as minimum, max(value) as maximum, avg(value) as average from k group by suite)
    select suite, samples, first, latest, minimum, maximum, round(average, 6) as average,
      case when first <> 0 then round((latest - first) / abs(first) * 100.0, 4) end as change_percent from s
    """,
)
def metric_trend(t) -> DataFrame:
    trend = ops.metric_trend(user_metric(t), ["suite"])
    return trend.withColumns(
        {"average": F.round("average", 6), "change_percent": F.round("change_percent", 4)}
    )


def strategy_rows(t) -> DataFrame:
    k = k_value().cast("int")
    return t.events.select(
        F.col("event_type").alias("strategy"),
        (F.col("event_id") % 4 != 0).alias("success"),
        F.col("value").alias("duration_ms"),
        k.alias("context_tokens"),
        (k % 7).alias("files_read"),
        (k % 3).alias("tool_calls"),
        ((k % 5) / 4).alias("path_recall"),
        ((k % 3) / 2).alias("symbol_recall"),
    )


K_SQL = "cast(json_extract(props, '$.k') as integer)"
SUMMARY_METRICS = "duration_ms context_tokens files_read tool_calls path_recall symbol_recall".split()


@query(
    "strategy_summary",
    f"""
    with e as (select event_type, event_id, value, {K_SQL} as k from events)
    select event_type as strategy, cast(count(*) as double) as cases, round(avg(case when event_id % 4 <> 0 then 1.0 else 0 end), 6) as success_rate,
      round(avg(value), 6) as avg_duration_ms, round(avg(k), 6) as avg_context_tokens, round(avg(k % 7), 6) as avg_files_read,
      round(avg(k % 3), 6) as avg_tool_calls, round(avg((k % 5) / 4.0), 6) as avg_path_recall, round(avg((k % 3) / 2.0), 6) as avg_symbol_recall
    from e group by 1
    """,
)
def strategy_summary(t) -> DataFrame:
    out = ops.strategy_summary(strategy_rows(t))
    names = ["success_rate", *[f"avg_{m}" for m in SUMMARY_METRICS]]
    return out.withColumns({c: F.round(c, 6) for c in names})


@query(
    "scenario_summary",
    f"""
    with e as (select event_type, event_id, value, {K_SQL} as k, user_id % 5 <> 0 as done from events)
    select event_type as scenario, count(*) as cases, count(*) filter (done) as completed,
      round(avg(case when event_id % 3 = 0 then 1.0 else 0 end) filter (done and event_id % 2 = 0), 6) as success_rate,
      round(avg(value) filter (done), 6) as avg_wall_time_ms, round(avg(k) filter (done), 6) as avg_estimated_context_tokens,
      round(avg(k % 7) filter (done and k % 2 = 0), 6) as avg_files_read, round(avg(k % 9) filter (done), 6) as avg_files_surfaced,
      round(avg(k % 3) filter (done), 6) as avg_tool_calls, round(avg(value / 10) filter (done and event_type = 'click'), 6) as avg_cost_usd
    from e group by 1
    """,
)
def scenario_summary(t) -> DataFrame:
    k = k_value().cast("int")
    rows = t.events.select(
        F.col("event_type").alias("scenario"),
        F.when(F.col("user_id") % 5 != 0, "ok").otherwise("error").alias("status"),
        F.when(F.col("event_id") % 2 == 0, F.col("event_id") % 3 == 0).alias("success"),
        F.col("value").alias("wall_time_ms"),
        k.alias("estimated_context_tokens"),
        F.when(k % 2 == 0, k % 7).alias("files_read"),
        (k % 9).alias("files_surfaced"),
        (k % 3).alias("tool_calls"),
        F.when(F.col("event_type") == "click", F.col("value") / 10).alias("cost_usd"),
    )
    out = ops.scenario_summary(rows)
    return out.withColumns(
        {c: F.round(c, 6) for c in out.columns if c.startswith("avg_") or c == "success_rate"}
    )


@query(
    "evaluation_summary",
    """
    with c as (select role as target, contains(lower(text), 'the') as passed, cast(ceil(length(text) / 4.0) as integer) as tokens,
      turn, length(text) % 100 as ms, case when conv_id % 7 = 0 then 'x' end as error from conversations)
    select target, cast(count(*) as double) as cases, round(avg(cast(passed as integer)), 6) as success_rate,
      round(avg(case when passed then 1.0 else 0.5 end), 6) as avg_score, round(avg(case when error is null then 1.0 else 0 end), 6) as execution_success_rate,
      round(avg(ms), 6) as avg_duration_ms, round(avg(tokens), 6) as avg_tokens, round(avg(turn), 6) as avg_tool_calls
    from c group by 1
    """,
)
def evaluation_summary(t) -> DataFrame:
    from loomgraph.functions.text import token_count

    passed = F.contains(F.lower("text"), F.lit("the"))
    rows = t.conversations.select(
        F.col("role").alias("target"),
        passed.alias("passed"),
        F.when(passed, 1.0).otherwise(0.5).alias("score"),
        token_count(F.col("text")).alias("tokens"),
        F.col("turn").alias("tool_calls"),
        (F.length("text") % 100).alias("duration_ms"),
        F.when(F.col("conv_id") % 7 == 0, "x").alias("error"),
    )
    out = ops.evaluation_summary(rows)
    return out.withColumns(
        {c: F.round(c, 6) for c in out.columns if c not in ("target", "cases")}
    )
