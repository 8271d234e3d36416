"""Traces, telemetry, requests, jobs, feedback and metric history."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.functions.scoring import lenient_int
from loomgraph.operators.scans import ordinal


def trace_summary(spans: DataFrame) -> DataFrame:
    """Counts, errors, total duration, tool calls and context tokens per trace."""
    return spans.groupBy("trace_id").agg(
        F.count("*").alias("spans"),
        F.count_if(F.col("status") == "error").alias("errors"),
        F.sum("duration_ms").alias("duration_ms"),
        F.count_if(F.startswith("name", F.lit("tool."))).alias("tool_calls"),
        F.sum(lenient_int(F.try_element_at("attributes", F.lit("context_tokens")))).alias(
            "context_tokens"
        ),
    )


def trace_names(spans: DataFrame, segment: str) -> DataFrame:
    """Span names in recording order, one row each: a long trace never becomes one array."""
    placed = ordinal(spans, ["trace_id"], ["seq"], segment, "position")
    return placed.select("trace_id", "position", "name")


def recent_traces(spans: DataFrame, limit: int = 12) -> DataFrame:
    latest = spans.groupBy("trace_id").agg(F.max("started_at").alias("last_started"))
    return latest.orderBy(F.desc("last_started"), F.desc("trace_id")).limit(limit)


def telemetry_rollup(events: DataFrame) -> DataFrame:
    """Counts by name, routes by kind, tokens saved, mean engine latency: (section, key, value)."""

    def attr(key: str):
        return F.try_element_at("attributes", F.lit(key))

    name = F.coalesce("name", F.lit("unknown"))
    by_name = events.groupBy(name.alias("key")).agg(F.count("*").cast("double").alias("value"))
    routes = (
        events.filter("name = 'route.created'")
        .groupBy(F.coalesce(attr("kind"), F.lit("unknown")).alias("key"))
        .agg(F.count("*").cast("double").alias("value"))
    )
    saved = events.filter("name = 'context.fitted'").agg(
        F.coalesce(F.sum(lenient_int(attr("saved"))), F.lit(0)).cast("double").alias("value")
    )
    engine = (
        events.filter("name = 'engine.executed'")
        .groupBy(F.coalesce(attr("capability"), F.lit("unknown")).alias("key"))
        .agg(
            F.round(
                F.sum(F.coalesce(attr("duration_ms").try_cast("double"), F.lit(0.0))) / F.count("*"), 2
            ).alias("value")
        )
    )

    def section(df: DataFrame, label: str) -> DataFrame:
        return df.select(F.lit(label).alias("section"), "key", "value")

    return (
        section(by_name, "counts")
        .unionByName(section(routes, "routes"))
        .unionByName(section(saved.withColumn("key", F.lit("")), "context_tokens_saved"))
        .unionByName(section(engine, "engine_avg_latency_ms"))
    )


def request_metrics(requests: DataFrame, top: int = 20) -> DataFrame:
    """Totals, server errors and mean latency, counts by status, busiest paths."""
    totals = requests.agg(
        F.count("*").cast("double").alias("requests"),
        F.count_if(F.col("status") >= 500).cast("double").alias("errors"),
        F.coalesce(F.sum("duration_ms") / F.count("*"), F.lit(0.0)).alias("avg_duration_ms"),
    )
    overall = totals.select(
        F.explode(
            F.create_map(
                *[x for c in ("requests", "errors", "avg_duration_ms") for x in (F.lit(c), F.col(c))]
            )
        ).alias("key", "value")
    ).select(F.lit("total").alias("section"), "key", "value")
    statuses = requests.groupBy(F.col("status").cast("string").alias("key")).agg(
        F.count("*").cast("double").alias("value")
    )
    paths = (
        requests.groupBy(F.col("path").alias("key"))
        .agg(F.count("*").cast("double").alias("value"))
        .orderBy(F.desc("value"), "key")
        .limit(top)
    )
    return overall.unionByName(statuses.select(F.lit("status").alias("section"), "key", "value")).unionByName(
        paths.select(F.lit("path").alias("section"), "key", "value")
    )


def job_rollup(jobs: DataFrame) -> DataFrame:
    return jobs.groupBy("status").agg(F.count("*").alias("jobs"))


def feedback_adjustment(feedback: DataFrame, samples: int = 200) -> DataFrame:
    """Routing correction per capability from its latest outcomes.

    The ``row_number`` bound turns into a group limit on both sides of the shuffle, so a hot
    capability sends at most ``samples`` rows per input task.
    """
    newest = Window.partitionBy("capability").orderBy(F.desc("created_at"), F.desc("event_id"))
    recent = feedback.withColumn("_rn", F.row_number().over(newest)).filter(F.col("_rn") <= samples)
    stats = recent.groupBy("capability").agg(
        F.count("*").alias("samples"),
        F.avg(F.col("success").cast("double")).alias("success_rate"),
        F.avg(F.greatest(F.col("latency_ms"), F.lit(0.0))).alias("average_latency_ms"),
    )
    quality = (F.col("success_rate") - 0.5) * 0.24
    penalty = F.least(F.lit(0.08), F.col("average_latency_ms") / 60000.0 * 0.08)
    bounded = F.greatest(F.lit(-0.15), F.least(F.lit(0.15), quality - penalty))
    return stats.withColumn(
        "adjustment", F.when(F.col("samples") < 3, F.lit(0.0)).otherwise(bounded)
    )


def metric_trend(snapshots: DataFrame, keys: list[str], limit: int = 100) -> DataFrame:
    """First, latest, extremes, mean and percent change over the last ``limit`` snapshots."""
    newest = Window.partitionBy(*keys).orderBy(F.desc("recorded_at"), F.desc("snapshot_id"))
    kept = snapshots.withColumn("_rn", F.row_number().over(newest)).filter(F.col("_rn") <= limit)
    position = F.when(F.col("value").isNotNull(), F.struct("recorded_at", "snapshot_id"))
    stats = kept.groupBy(*keys).agg(
        F.count("value").alias("samples"),
        F.min_by("value", position).alias("first"),
        F.max_by("value", position).alias("latest"),
        F.min("value").alias("minimum"),
        F.max("value").alias("maximum"),
        F.avg("value").alias("average"),
    )
    change = (F.col("latest") - F.col("first")) / F.abs("first") * 100.0
    return stats.withColumn("change_percent", F.when(F.col("first") != 0, change))


def strategy_summary(results: DataFrame) -> DataFrame:
    metrics = (
        "duration_ms context_tokens files_read tool_calls path_recall symbol_recall".split()
    )
    return results.groupBy("strategy").agg(
        F.count("*").cast("double").alias("cases"),
        F.avg(F.col("success").cast("double")).alias("success_rate"),
        *[F.avg(m).alias(f"avg_{m}") for m in metrics],
    )


def scenario_summary(results: DataFrame) -> DataFrame:
    """Means over completed rows only; a metric nobody measured stays null."""
    done = F.col("status") == "ok"
    metrics = (
        "wall_time_ms estimated_context_tokens files_read files_surfaced tool_calls cost_usd".split()
    )
    return results.groupBy("scenario").agg(
        F.count("*").alias("cases"),
        F.count_if(done).alias("completed"),
        F.avg(F.when(done, F.col("success").cast("double"))).alias("success_rate"),
        *[F.avg(F.when(done, F.col(m))).alias(f"avg_{m}") for m in metrics],
    )


def evaluation_summary(results: DataFrame) -> DataFrame:
    return results.groupBy("target").agg(
        F.count("*").cast("double").alias("cases"),
        F.avg(F.col("passed").cast("double")).alias("success_rate"),
        F.avg("score").alias("avg_score"),
        F.avg(F.col("error").isNull().cast("double")).alias("execution_success_rate"),
        F.avg("duration_ms").alias("avg_duration_ms"),
        F.avg("tokens").alias("avg_tokens"),
        F.avg("tool_calls").alias("avg_tool_calls"),
    )
