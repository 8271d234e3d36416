"""File corpora as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.functions.text import is_excluded


def read_files(spark: SparkSession, root: str, repo: str = "", *, glob: str | None = None) -> DataFrame:
    """Files below a folder: ``repo, path, content, size, mtime_ns``; undecodable text is null."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    base = root.rstrip("/")
    relative = F.regexp_replace(
        F.regexp_replace("path", r"^[a-z0-9]+:/{1,3}", "/"), f"^\\Q{base}\\E/", ""
    )
    raw = reader.load(base)
    return raw.select(
        F.lit(repo).alias("repo"),
        relative.alias("path"),
        F.try_validate_utf8(F.col("content").cast("string")).alias("content"),
        F.col("length").alias("size"),
        (F.unix_micros("modificationTime") * 1000).alias("mtime_ns"),
    )


def scan_files(
    files: DataFrame, max_bytes: int | None = None, extra_excluded: tuple[str, ...] = ()
) -> DataFrame:
    """Files outside excluded folders and within the size bound.

    Order is left to the caller: a corpus-wide sort by path would only cost a range shuffle.
    """
    kept = files.filter(~is_excluded(F.col("path"), extra_excluded))
    return kept if max_bytes is None else kept.filter(F.col("size") <= max_bytes)
