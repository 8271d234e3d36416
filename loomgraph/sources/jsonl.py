"""JSON-lines logs: spans, telemetry events, API requests. Bad lines are skipped."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SPAN_LINE = (
    "version INT, span STRUCT<trace_id STRING, span_id STRING, parent_id STRING, name STRING, "
    "status STRING, started_at STRING, ended_at STRING, duration_ms DOUBLE, "
    "attributes MAP<STRING,STRING>, error STRING>"
)
TELEMETRY_LINE = "name STRING, timestamp DOUBLE, attributes MAP<STRING,STRING>"
REQUEST_LINE = (
    "timestamp STRING, request_id STRING, trace_id STRING, method STRING, path STRING, "
    "status INT, duration_ms DOUBLE"
)
SPAN_VERSION = 1


def read_lines(spark: SparkSession, path: str, *, stream: bool = False) -> DataFrame:
    return (spark.readStream if stream else spark.read).text(path)


def _parsed(lines: DataFrame, schema: str) -> DataFrame:
    rows = lines.select(
        *[c for c in lines.columns if c != "value"],
        F.from_json("value", schema + ", _bad STRING", {"columnNameOfCorruptRecord": "_bad"}).alias("r"),
    )
    return rows.filter(F.col("r").isNotNull() & F.col("r._bad").isNull())


def parse_spans(lines: DataFrame) -> DataFrame:
    """Spans of the supported version with every required field present."""
    other = [c for c in lines.columns if c != "value"]
    rows = _parsed(lines, SPAN_LINE).filter(F.col("r.version") == SPAN_VERSION)
    required = "trace_id span_id name status started_at ended_at duration_ms".split()
    flat = rows.select(*other, "r.span.*").dropna(subset=required)
    return flat.withColumns(
        {
            "parent_id": F.nullif("parent_id", F.lit("")),
            "error": F.nullif("error", F.lit("")),
            "attributes": F.coalesce("attributes", F.create_map().cast("map<string,string>")),
        }
    )


def parse_telemetry(lines: DataFrame) -> DataFrame:
    other = [c for c in lines.columns if c != "value"]
    return _parsed(lines, TELEMETRY_LINE).select(*other, "r.name", "r.timestamp", "r.attributes")


def parse_requests(lines: DataFrame) -> DataFrame:
    other = [c for c in lines.columns if c != "value"]
    return _parsed(lines, REQUEST_LINE).select(*other, "r.*").drop("_bad")


def span_line():
    """A span row as its JSON line, for writing logs back."""
    return F.to_json(F.struct(F.lit(SPAN_VERSION).alias("version"), F.struct("*").alias("span")))
