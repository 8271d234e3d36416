"""Streaming queries: each runs its stream to completion and returns the resulting table."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.functions.scoring import lookup
from loomgraph.operators.retrieval import feature_hash
from loomgraph.plans.events import SPAN_NAMES, SPANS_SQL, STATUS, TELEMETRY_NAMES, k_value
from loomgraph.plans.graphs import ACCESS_SQL, access_inputs
from loomgraph.plans.registry import ORACLES, query
from loomgraph.plans.sqltext import sql_case
from loomgraph.plans.stores import mutations, writes
from loomgraph.streaming import live, state
from loomgraph.streaming.sources import arrivals, drain, event_stream


class StreamTables:
    """The tables of a folder with ``events`` replaced by its stream."""

    def __init__(self, t) -> None:
        self.spark = t.spark
        self.events = event_stream(t.spark, t.folder, t.events.schema)


CLOSED_SQL = "epoch_us(time_bucket(interval '1 hour', ts)) + 3600000000 <= (select max(epoch_us(ts)) from events) - 600000000"


@query(
    "live_request_metrics",
    f"""
    select epoch_us(time_bucket(interval '1 hour', ts)) as window_start, '/u/' || user_id as path, count(*) as requests,
      count(*) filter ({sql_case(STATUS, 'event_type', 200)} >= 500) as errors, round(sum(value), 4) as duration_ms
    from events where {CLOSED_SQL} group by 1, 2
    """,
)
def live_request_metrics(t) -> DataFrame:
    rows = StreamTables(t).events.select(
        "ts",
        lookup(STATUS, F.col("event_type"), 200).alias("status"),
        F.concat(F.lit("/u/"), F.col("user_id").cast("string")).alias("path"),
        F.col("value").alias("duration_ms"),
    )
    out = drain(live.request_windows(rows, "1 hour", "10 minutes"), "requests")
    return out.withColumn("duration_ms", F.round("duration_ms", 4))


@query(
    "live_telemetry",
    f"""
    select epoch_us(time_bucket(interval '1 hour', ts)) as window_start, {sql_case(TELEMETRY_NAMES, 'event_type', 'other')} as name, count(*) as events
    from events where {CLOSED_SQL} group by 1, 2
    """,
)
def live_telemetry(t) -> DataFrame:
    rows = StreamTables(t).events.select("ts", lookup(TELEMETRY_NAMES, F.col("event_type"), "other").alias("name"))
    return drain(live.telemetry_windows(rows, "1 hour", "10 minutes"), "telemetry")


def spans_of(events: DataFrame) -> DataFrame:
    return events.select(
        "ts",
        F.col("user_id").cast("string").alias("trace_id"),
        lookup(SPAN_NAMES, F.col("event_type"), "engine.run").alias("name"),
        F.when(F.col("event_type") == "error", "error").otherwise("ok").alias("status"),
        F.col("value").alias("duration_ms"),
        F.create_map(F.lit("context_tokens"), k_value()).alias("attributes"),
    )


class Arrived:
    """The events that a growing folder streams."""

    def __init__(self, spark, events: DataFrame) -> None:
        self.spark, self.events = spark, events


def event_arrivals(t) -> Iterator[Arrived]:
    """Events in three parts, the stream stopped and started again between them."""
    rows = t.events.withColumn("ts", F.col("ts").cast("timestamp"))
    for stream in arrivals(rows, "event_id"):
        yield Arrived(t.spark, stream)


@query(
    "live_traces",
    f"""
    select trace_id, count(*) as spans, count(*) filter (status = 'error') as errors, round(sum(duration_ms), 4) as duration_ms,
      count(*) filter (starts_with(name, 'tool.')) as tool_calls, cast(sum(tok) as bigint) as context_tokens
    from ({SPANS_SQL}) group by trace_id
    """,
)
def live_traces(t) -> DataFrame:
    """Sums that stay in the state store and are read from it."""
    traces = state.LiveTraces(t.spark)
    for arrived in event_arrivals(t):
        traces.drain(spans_of(arrived.events))
    return traces.current().withColumn("duration_ms", F.round("duration_ms", 4))


@query(
    "closed_traces",
    f"""
    with s as (select *, coalesce(started_at - lag(started_at) over (partition by trace_id order by started_at) >= 21600000000, true) as fresh from ({SPANS_SQL})),
    g as (select *, sum(fresh::int) over (partition by trace_id order by started_at) as n from s)
    select min(started_at) as started_at, trace_id, count(*) as spans, count(*) filter (status = 'error') as errors, round(sum(duration_ms), 4) as duration_ms,
      count(*) filter (starts_with(name, 'tool.')) as tool_calls
    from g group by trace_id, n having max(started_at) + 21600000000 <= (select max(epoch_us(ts)) from events) - 3600000000
    """,
)
def closed_traces(t) -> DataFrame:
    out = drain(live.closed_traces(spans_of(StreamTables(t).events), "6 hours", "1 hour"), "sessions")
    return out.withColumn("duration_ms", F.round("duration_ms", 4))


@query(
    "audit_stream",
    f"select actor, outcome, count(*) as records from (select cast(user_id as varchar) as actor, case when allowed then 'allowed' else 'denied' end as outcome from ({ACCESS_SQL}) join events using (event_id)) group by 1, 2",
)
def audit_stream(t) -> DataFrame:
    _, members, policies = access_inputs(t)
    requests, _, _ = access_inputs(StreamWithStatic(t))
    rows = live.audit_stream(requests, members, policies).select("actor", "outcome")
    return drain(rows, "audit").groupBy("actor", "outcome").agg(F.count("*").alias("records"))


class StreamWithStatic(StreamTables):
    def __init__(self, t) -> None:
        super().__init__(t)
        self.customer, self.nation = t.customer, t.nation


@query(
    "alert_scan",
    """
    with j as (select o_orderstatus from orders), f as (select count(*) as n from j where o_orderstatus = 'F'),
    u as (select count(*) as n from supplier where s_acctbal < 0)
    select 'job.failure' as kind, 'critical' as severity, n || ' failed job(s) need attention.' as detail, n as count from f where n > 0
    union all select 'backend.unhealthy', 'warning', n || ' active backend(s) are unhealthy.', n from u where n > 0
    """,
)
def alert_scan(t) -> DataFrame:
    jobs = t.orders.select(
        F.col("o_orderkey").alias("job_id"),
        F.when(F.col("o_orderstatus") == "F", "failed").otherwise("done").alias("status"),
        F.col("o_orderdate").alias("created_at"),
    )
    backends = t.supplier.select("s_suppkey", (F.col("s_acctbal") >= 0).alias("healthy"))
    return live.alert_scan(jobs, backends).select("kind", "severity", "detail", "count")


@query(
    "acknowledge",
    """
    with n as (select event_id as id, case when event_id % 10 = 0 then 5 end as acknowledged_at from events where event_type = 'error'),
    a as (select event_id // 2 as id, event_id as acked from events where event_type <> 'error'), f as (select id, min(acked) as acked from a group by 1)
    select id as notification_id, coalesce(acknowledged_at, f.acked, -1) as acknowledged_at from n left join f using (id)
    """,
)
def acknowledge(t) -> DataFrame:
    notifications = t.events.filter("event_type = 'error'").select(
        F.col("event_id").alias("notification_id"),
        F.when(F.col("event_id") % 10 == 0, 5).cast("long").alias("acknowledged_at"),
    )
    acks = t.events.filter("event_type <> 'error'").select(
        F.floor(F.col("event_id") / 2).alias("notification_id"), F.col("event_id").alias("acknowledged_at")
    )
    out = live.acknowledge(notifications, acks)
    return out.withColumn("acknowledged_at", F.coalesce("acknowledged_at", F.lit(-1)))


@query("memory_sync_stream", ORACLES["memory_sync"])
def memory_sync_stream(t) -> DataFrame:
    merge = state.MemorySync(t.spark)
    for arrived in event_arrivals(t):
        merge.drain(mutations(arrived))
    out = merge.current()
    return out.withColumns({"clock_a": F.col("clock")["a"], "clock_b": F.col("clock")["b"]}).drop("clock")


@query("optimistic_write_stream", ORACLES["optimistic_writes"])
def optimistic_write_stream(t) -> DataFrame:
    seq = F.col("seq")
    expected = F.when(seq % 5 != 0, F.floor((seq * 7) % 23 / 4) + F.floor(seq / 800)).cast("long")
    checks = state.OptimisticWrites(t.spark)
    for arrived in event_arrivals(t):
        checks.drain(writes(arrived).withColumn("expected", expected))
    return checks.results().withColumns({c: F.coalesce(c, F.lit(-1)).cast("long") for c in ("revision", "found")})


@query("quota_stream", ORACLES["sliding_quota"])
def quota_stream(t) -> DataFrame:
    quota = state.SlidingQuota(t.spark, 3, 6 * 3_600_000_000)
    for arrived in event_arrivals(t):
        calls = arrived.events.select(
            (F.col("user_id") % 40).cast("string").alias("principal"),
            F.unix_micros("ts").alias("t"),
            F.col("event_id").alias("seq"),
        )
        quota.drain(calls)
    return quota.results().select("principal", "seq", "allowed")


@query(
    "semantic_refresh",
    """
    with d as (select doc_id, source, lang, case when doc_id % 10 = 0 then concat(text, ' (revised)') else text end as body, text from documents)
    select cast(doc_id as varchar) as id, source as path, lang as symbol, sha256(concat_ws(chr(1), body, source, lang)) as digest,
      cast(case when body is not distinct from text then 1 else 2 end as bigint) as version, 128 as cells
    from d
    """,
)
def semantic_refresh(t) -> DataFrame:
    """All documents come twice, every tenth with another text the second time: only those are embedded again."""
    index = state.SemanticRefresh(t.spark, feature_hash(128))
    ids = t.documents.select(
        F.col("doc_id").cast("string").alias("id"), "text", F.col("source").alias("path"), F.col("lang").alias("symbol"), F.lit(0).alias("round")
    )
    revised = F.when(F.col("id").cast("long") % 10 == 0, F.concat("text", F.lit(" (revised)"))).otherwise(F.col("text"))
    again = ids.withColumns({"text": revised, "round": F.lit(1)})
    for stream in arrivals(ids.unionByName(again), "round", 2):
        index.drain(stream)
    return index.current().select("id", "path", "symbol", "digest", "version", F.size("vector").alias("cells"))


@query(
    "alert_stream",
    """
    with bounds as (select min(o_orderkey) as low, max(o_orderkey) as high from orders),
    jobs as (select (o_orderkey - low) * 3 // (high - low + 1) as batch, o_orderstatus from orders, bounds),
    sick as (select count(*) as n from supplier where s_acctbal < 0)
    select cast(batch as bigint) as batch, 'job.failure' as kind, 'critical' as severity, count(*) || ' failed job(s) need attention.' as detail, count(*) as count
    from jobs where o_orderstatus = 'F' group by batch
    union all
    select cast(batch as bigint), 'backend.unhealthy', 'warning', n || ' active backend(s) are unhealthy.', n
    from (select distinct batch from jobs), sick where n > 0
    """,
)
def alert_stream(t) -> DataFrame:
    """Jobs arriving in three parts; every micro-batch appends its own notifications."""
    alerts = live.AlertLog(t.supplier.select("s_suppkey", (F.col("s_acctbal") >= 0).alias("healthy")))
    jobs = t.orders.select(
        F.col("o_orderkey").alias("job_id"),
        F.when(F.col("o_orderstatus") == "F", "failed").otherwise("done").alias("status"),
        F.col("o_orderdate").alias("created_at"),
    )
    for stream in arrivals(jobs, "job_id"):
        alerts.start(stream).awaitTermination()
    return alerts.notifications().select("batch", "kind", "severity", "detail", "count")
