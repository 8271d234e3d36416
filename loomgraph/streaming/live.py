"""Live metrics, traces, audit and alerts.

Watermarks are ours: they bound state, and late rows beyond them are dropped from windows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from loomgraph.operators.access import audit_rows, decide
from loomgraph.session import shared_path


def request_windows(requests: DataFrame, size: str = "1 minute", delay: str = "10 minutes") -> DataFrame:
    """Requests, server errors and latency per window and path, emitted once a window closes."""
    return (
        requests.withWatermark("ts", delay)
        .groupBy(F.window("ts", size).alias("w"), "path")
        .agg(
            F.count("*").alias("requests"),
            F.count_if(F.col("status") >= 500).alias("errors"),
            F.sum("duration_ms").alias("duration_ms"),
        )
        .select(F.unix_micros("w.start").alias("window_start"), "path", "requests", "errors", "duration_ms")
    )


def telemetry_windows(events: DataFrame, size: str = "1 minute", delay: str = "10 minutes") -> DataFrame:
    return (
        events.withWatermark("ts", delay)
        .groupBy(F.window("ts", size).alias("w"), "name")
        .agg(F.count("*").alias("events"))
        .select(F.unix_micros("w.start").alias("window_start"), "name", "events")
    )


def closed_traces(spans: DataFrame, gap: str = "30 minutes", delay: str = "1 hour") -> DataFrame:
    """Summary of each burst of a trace, emitted when the trace has been silent for ``gap``."""
    return (
        spans.withWatermark("ts", delay)
        .groupBy(F.session_window("ts", gap).alias("w"), "trace_id")
        .agg(
            F.count("*").alias("spans"),
            F.count_if(F.col("status") == "error").alias("errors"),
            F.sum("duration_ms").alias("duration_ms"),
            F.count_if(F.startswith("name", F.lit("tool."))).alias("tool_calls"),
        )
        .select(F.unix_micros("w.start").alias("started_at"), "trace_id", "spans", "errors", "duration_ms", "tool_calls")
    )


def audit_stream(requests: DataFrame, members: DataFrame, policies: DataFrame) -> DataFrame:
    """Policy decisions of a request stream against static members and policies."""
    return audit_rows(decide(requests, members, policies))


def alert_scan(jobs: DataFrame, backends: DataFrame, since: object = None) -> DataFrame:
    """Notifications for failed jobs, all or those created from ``since`` on, and for unhealthy backends."""
    recent = jobs if since is None else jobs.filter(F.col("created_at") >= F.lit(since))
    failed = recent.filter("status = 'failed'").agg(F.count("*").alias("n"))
    sick = backends.filter("not healthy").agg(F.count("*").alias("n"))

    def alert(counted: DataFrame, kind: str, severity: str, title: str, detail: str, resource: str) -> DataFrame:
        return counted.filter("n > 0").select(
            F.lit(kind).alias("kind"),
            F.lit(severity).alias("severity"),
            F.lit(title).alias("title"),
            F.concat(F.col("n").cast("string"), F.lit(detail)).alias("detail"),
            F.lit(resource).alias("resource"),
            F.col("n").alias("count"),
        )

    return alert(
        failed, "job.failure", "critical", "Background jobs failed", " failed job(s) need attention.", "jobs"
    ).unionByName(
        alert(
            sick, "backend.unhealthy", "warning", "Backend health degraded", " active backend(s) are unhealthy.", "backends"
        )
    )


class AlertLog:
    """Alerts of a job stream, scanned micro-batch by micro-batch and appended once each.

    A batch's notifications are one folder named after it, so a batch that is run again after a
    failure replaces its own and adds none twice. Started again at its ``location``, the
    stream goes on behind the last finished batch.
    """

    schema = "kind string, severity string, title string, detail string, resource string, count long"

    def __init__(self, backends: DataFrame, location: str | None = None) -> None:
        self.backends = backends
        self.location = location or shared_path(backends.sparkSession, "alerts")

    def start(self, jobs: DataFrame, **trigger) -> StreamingQuery:
        writer = jobs.writeStream.foreachBatch(self._scan).option("checkpointLocation", f"{self.location}/progress")
        return writer.trigger(**(trigger or {"availableNow": True})).start()

    def _scan(self, jobs: DataFrame, number: int) -> None:
        alert_scan(jobs, self.backends).write.mode("overwrite").parquet(f"{self.location}/log/batch={number}")

    def notifications(self) -> DataFrame:
        """All notifications with the batch that raised them."""
        return self.backends.sparkSession.read.schema(f"{self.schema}, batch long").parquet(f"{self.location}/log")


def acknowledge(notifications: DataFrame, acks: DataFrame) -> DataFrame:
    """Set ``acknowledged_at`` once: the first acknowledgement counts, set ones stay."""
    firsts = acks.groupBy("notification_id").agg(F.min("acknowledged_at").alias("_first"))
    joined = notifications.join(firsts, "notification_id", "left")
    return joined.withColumn("acknowledged_at", F.coalesce("acknowledged_at", "_first")).drop("_first")
