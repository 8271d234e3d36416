"""Exported diffs: counts, statuses and changed line ranges."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FILE_MARK = "diff --git "
_HUNK = r"(?m)^@@ -\d+(?:,\d+)? \+(\d+)(?:,(\d+))? @@"


def read_patch(spark: SparkSession, path: str) -> DataFrame:
    """One record per changed file of ``git diff --unified=0``."""
    return spark.read.option("lineSep", "\n" + FILE_MARK).text(path)


def parse_numstat(lines: DataFrame) -> DataFrame:
    parts = F.split("value", "\t")
    other = [c for c in lines.columns if c != "value"]

    def count(i: int):
        return F.when(parts[i].rlike(r"^\d+$"), parts[i].try_cast("int")).otherwise(0)

    return lines.filter(F.size(parts) >= 3).select(
        *other,
        F.element_at(parts, -1).alias("path"),
        count(0).alias("additions"),
        count(1).alias("deletions"),
    )


def parse_name_status(lines: DataFrame) -> DataFrame:
    parts = F.split("value", "\t")
    other = [c for c in lines.columns if c != "value"]
    return lines.filter(F.size(parts) >= 2).select(
        *other, F.element_at(parts, -1).alias("path"), parts[0].alias("status")
    )


def parse_hunks(records: DataFrame) -> DataFrame:
    """Changed ranges on the new side; a pure deletion (count 0) leaves a null-range row."""
    other = [c for c in records.columns if c != "value"]
    target = F.regexp_extract("value", r"(?m)^\+\+\+ b/(.+?)\r?$", 1)
    starts = F.regexp_extract_all("value", F.lit(_HUNK), F.lit(1))
    counts = F.regexp_extract_all("value", F.lit(_HUNK), F.lit(2))
    pairs = F.zip_with(
        starts,
        counts,
        lambda s, c: F.struct(
            s.cast("int").alias("start"),
            F.when(c == "", 1).otherwise(c.try_cast("int")).alias("count"),
        ),
    )
    kept = F.filter(pairs, lambda h: h["count"] > 0)
    return (
        records.select(*other, target.alias("path"), F.explode_outer(kept).alias("h"))
        .filter("path <> ''")
        .select(*other, "path", F.col("h.start").alias("start"), (F.col("h.start") + F.col("h.count") - 1).alias("end"))
    )


def file_changes(
    numstat: DataFrame, statuses: DataFrame, hunks: DataFrame, keys: tuple[str, ...] = ()
) -> DataFrame:
    """One row per path any listing names; missing counts are 0, missing status is ``M``."""
    on = [*keys, "path"]
    ranges = hunks.groupBy(*on).agg(F.count("start").alias("ranges"))
    return (
        numstat.join(statuses, on, "full_outer")
        .join(ranges, on, "full_outer")
        .select(
            *on,
            F.coalesce("status", F.lit("M")).alias("status"),
            F.coalesce("additions", F.lit(0)).alias("additions"),
            F.coalesce("deletions", F.lit(0)).alias("deletions"),
            F.coalesce("ranges", F.lit(0)).alias("ranges"),
        )
    )
