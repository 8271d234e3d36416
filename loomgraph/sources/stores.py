"""Tables that change over time: graph revisions, snapshots, change feeds, vectors."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

# -- graph revisions ---------------------------------------------------------------------


def write_revision(graph: DataFrame, path: str) -> None:
    """Replace exactly the (repo, revision) partitions present in ``graph``."""
    (
        graph.write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("repo", "revision")
        .parquet(path)
    )


def list_revisions(graph: DataFrame) -> DataFrame:
    return graph.groupBy("repo", "revision").agg(
        F.max("created_at").alias("created_at"), F.count("*").alias("rows")
    )


def latest_revision(graph: DataFrame) -> DataFrame:
    return graph.groupBy("repo").agg(
        F.max_by("revision", F.struct("created_at", "revision")).alias("revision")
    )


def prune_revisions(revisions: DataFrame, keep: int) -> DataFrame:
    """The newest ``keep`` (at least one) revisions of each repository."""
    newest = Window.partitionBy("repo").orderBy(F.desc("created_at"), F.desc("revision"))
    return revisions.withColumn("_rn", F.row_number().over(newest)).filter(
        F.col("_rn") <= max(1, keep)
    ).drop("_rn")


# -- snapshots ---------------------------------------------------------------------------


def upsert_snapshots(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    """Incoming rows replace stored rows of the same snapshot id and metric."""
    both = stored.withColumn("_new", F.lit(0)).unionByName(incoming.withColumn("_new", F.lit(1)))
    rest = [c for c in stored.columns if c not in ("snapshot_id", "metric")]
    return (
        both.groupBy("snapshot_id", "metric")
        .agg(F.max_by(F.struct(*rest), F.struct("_new", "recorded_at")).alias("r"))
        .select("snapshot_id", "metric", "r.*")
        .select(*stored.columns)
    )


def snapshot_lines(snapshots: DataFrame, limit: int | None = None) -> DataFrame:
    """Snapshots, or the newest ``limit``, as JSON lines with the schema number (``metrics`` is a map)."""
    newest = snapshots if limit is None else snapshots.orderBy(F.desc("recorded_at"), F.desc("snapshot_id")).limit(limit)
    return newest.select(F.to_json(F.struct(F.lit(1).alias("schema"), F.struct("*").alias("snapshot"))).alias("value"))


def parse_snapshot_lines(lines: DataFrame) -> DataFrame:
    schema = (
        "schema INT, snapshot STRUCT<snapshot_id STRING, commit STRING, suite STRING, "
        "metrics MAP<STRING,DOUBLE>, recorded_at STRING>"
    )
    rows = lines.select(F.from_json("value", schema).alias("r")).filter("r.schema = 1")
    return rows.select("r.snapshot.*").filter("snapshot_id is not null and metrics is not null")


def _flatten(value: object, prefix: str, out: list[tuple[str, float | None]]) -> None:
    if isinstance(value, dict):
        for key, child in value.items():
            _flatten(child, f"{prefix}.{key}" if prefix else str(key), out)
    elif isinstance(value, list):
        for i, child in enumerate(value):
            _flatten(child, f"{prefix}[{i}]", out)
    elif prefix and (value is None or isinstance(value, (bool, int, float))):
        out.append((prefix, None if value is None else float(value)))


@F.pandas_udf(T.ArrayType(T.StructType().add("metric", "string").add("value", "double")))
def flatten_metrics(payload: pd.Series) -> pd.Series:
    """Numeric leaves of nested JSON as ``a.b`` and ``a[0]`` keys; nesting has no fixed depth."""

    def one(text: str | None) -> list[dict]:
        out: list[tuple[str, float | None]] = []
        try:
            _flatten(json.loads(text) if text else None, "", out)
        except ValueError:
            return []
        return [{"metric": m, "value": v} for m, v in out]

    return payload.map(one)


# -- change feed -------------------------------------------------------------------------


def pull_changes(feed: DataFrame, cursor: int, limit: int = 1000) -> DataFrame:
    """The next changes after a cursor, oldest first (a bounded top-k)."""
    return feed.filter(F.col("seq") > max(0, cursor)).orderBy("seq").limit(max(1, limit))


# -- vectors -----------------------------------------------------------------------------


def vector_error(vector):
    """Reason a vector is refused; null when it may be stored."""
    values = F.transform(vector, lambda v: v.cast("double"))
    return (
        F.when(F.coalesce(F.size(vector), F.lit(0)) == 0, "empty")
        .when(
            F.exists(values, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))),
            "not finite",
        )
        .when(F.forall(values, lambda v: v == 0.0), "all zeros")
    )


def upsert_vectors(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    """Last write per (namespace, key) among valid vectors; ``seq`` orders the writes."""
    both = stored.withColumn("_new", F.lit(0)).unionByName(incoming.withColumn("_new", F.lit(1)))
    valid = both.filter(vector_error(F.col("vector")).isNull())
    rest = [c for c in stored.columns if c not in ("namespace", "key")]
    return (
        valid.groupBy("namespace", "key")
        .agg(F.max_by(F.struct(*rest), F.struct("_new", "seq")).alias("r"))
        .select("namespace", "key", "r.*")
    )


def delete_vectors(stored: DataFrame, keys: DataFrame) -> DataFrame:
    return stored.join(keys.select("namespace", "key"), ["namespace", "key"], "left_anti")


def count_vectors(stored: DataFrame) -> DataFrame:
    return stored.groupBy("namespace").agg(F.count("*").alias("vectors"))
