"""Streaming readers and the run-to-completion helper used by queries and tests."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.session import shared_path


def parquet_stream(
    spark: SparkSession, folder: str, schema, glob: str = "*.parquet", files_per_trigger: int | None = None
) -> DataFrame:
    reader = spark.readStream.schema(schema).option("pathGlobFilter", glob)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(folder)


def event_stream(spark: SparkSession, folder: str, schema, files_per_trigger: int | None = None) -> DataFrame:
    """Events as a stream; ``ts`` becomes a zoned timestamp, which watermarks need."""
    rows = parquet_stream(spark, folder, schema, "events*.parquet", files_per_trigger)
    return rows.withColumn("ts", F.col("ts").cast("timestamp"))


def drain(stream: DataFrame, label: str, mode: str = "append") -> DataFrame:
    """Run an append stream over everything available into a fresh table and read it back."""
    spark = stream.sparkSession
    target, progress = shared_path(spark, label), shared_path(spark, f"{label}-progress")
    query = (
        stream.writeStream.outputMode(mode)
        .format("parquet")
        .option("path", target)
        .option("checkpointLocation", progress)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(target)


def arrivals(rows: DataFrame, order: str, parts: int = 3) -> Iterator[DataFrame]:
    """A table arriving as files: the stream over its folder, each time another part is there.

    Parts are equal ranges of ``order``, so a later part holds later rows. A stream that is drained
    after every part has been stopped and started again in between.
    """
    spark, folder = rows.sparkSession, shared_path(rows.sparkSession, "arrivals")
    low, high = rows.agg(F.min(order), F.max(order)).first()
    low, high = low or 0, high or 0
    for i in range(parts):
        here = F.expr(f"coalesce(({order} - {low}) * {parts} div {high - low + 1}, 0)") == i
        rows.where(here).write.mode("append").parquet(folder)
        yield spark.readStream.schema(rows.schema).parquet(folder)
