"""Exported commit logs, blame listings and line histories.

Logs are read with the commit marker as record separator, so one record is one commit and a
large export splits across tasks without any ordering between lines.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

COMMIT_MARK = "@@"


def read_commit_log(spark: SparkSession, path: str) -> DataFrame:
    """Records of ``git log --format=@@%H|%an|%ae|%ad --name-only``."""
    return spark.read.option("lineSep", "\n" + COMMIT_MARK).text(path)


def parse_commit_log(records: DataFrame) -> DataFrame:
    """One row per (commit, touched path); a commit without paths keeps one null-path row."""
    body = F.regexp_replace("value", f"^{COMMIT_MARK}", "")
    lines = F.split(body, r"\r?\n")
    head = F.split(lines[0], r"\|", 4)
    paths = F.filter(
        F.transform(F.slice(lines, 2, F.greatest(F.size(lines), F.lit(1))), F.trim), lambda p: p != ""
    )
    other = [c for c in records.columns if c != "value"]
    return records.filter(F.trim(body) != "").select(
        *other,
        head[0].alias("sha"),
        F.get(head, F.lit(1)).alias("author"),
        F.get(head, F.lit(2)).alias("email"),
        F.get(head, F.lit(3)).try_cast("timestamp").alias("ts"),
        F.explode_outer(F.array_distinct(paths)).alias("path"),
    )


def parse_history_lines(records: DataFrame) -> DataFrame:
    """``sha|author|email|date|subject`` lines; anything with fewer fields is skipped."""
    parts = F.split("value", r"\|", 5)
    other = [c for c in records.columns if c != "value"]
    return records.filter(F.size(parts) == 5).select(
        *other, *[parts[i].alias(n) for i, n in enumerate(("sha", "author", "email", "date", "subject"))]
    )


def parse_blame(records: DataFrame) -> DataFrame:
    """Porcelain blame, one record per file read as whole text: one row per source line."""
    entry = (
        r"(?m)^\^?([0-9a-f]{6,64}) \d+ (\d+)(?: \d+)?\n((?:(?!\t).*\n)*)\t(.*)$"
    )
    groups = [F.regexp_extract_all("value", F.lit(entry), F.lit(i)) for i in range(1, 5)]
    zipped = F.arrays_zip(*[g.alias(n) for g, n in zip(groups, "sha line header content".split(), strict=True)])
    other = [c for c in records.columns if c != "value"]

    def header(name: str):
        return F.regexp_extract(F.col("b.header"), rf"(?m)^{name} (.*)$", 1)

    return records.select(*other, F.explode(zipped).alias("b")).select(
        *other,
        F.col("b.line").cast("int").alias("line"),
        F.col("b.sha").alias("sha"),
        header("author").alias("author"),
        F.regexp_replace(header("author-mail"), "[<>]", "").alias("email"),
        header("author-time").try_cast("long").alias("timestamp"),
        F.col("b.content").alias("content"),
    )
