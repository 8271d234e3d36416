"""Staging, row identity and row marking shared by the operators."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.session import drop_stage, stage_at

#: The characters that separate words and that exact deduplication folds.
BLANKS = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"

#: Hash of the file path and row number inside the file: names a stored row.
FILE, ROW = "__file", "__row"
#: Name, as of ``row_name``, of the row that stays for a row.
KEEPER = "__keeper"

#: Bytes of bitmaps that one wave of ``marked_rows`` broadcasts.
WAVE_BYTES = 64 << 20
BITMAP_BYTES = 4096


def stage(df: DataFrame, label: str) -> DataFrame:
    """Write to the shared folder and read back: later work starts from the files."""
    return stage_at(df, label)[0]


def _scan_only(plan) -> bool:
    """Whether a plan is a file scan with projections and filters, so that stored rows map to rows."""
    if plan.nodeName() not in {"Project", "Filter", "SubqueryAlias", "LogicalRelation"}:
        return False
    children = plan.children()
    return all(_scan_only(children.apply(i)) for i in range(children.size()))


def stored(docs: DataFrame) -> DataFrame:
    """The frame itself if it is a plain file scan, else as staged, so that every pass names its rows alike."""
    return docs if _scan_only(docs._jdf.queryExecution().analyzed()) and _in_files(docs) else stage(docs, "rows")


def _in_files(docs: DataFrame) -> bool:
    try:
        return bool(docs.select("_metadata.row_index").columns)
    except AnalysisException:
        return False


def located(docs: DataFrame, *columns: str) -> DataFrame:
    """The columns asked for with ``FILE`` and ``ROW``, which no two rows share.

    A frame that is not a plain Parquet scan is staged first, so that a second pass meets the
    same rows under the same names. Other columns are left out, whatever their names.
    """
    place = [F.xxhash64("_metadata.file_path").alias(FILE), F.col("_metadata.row_index").alias(ROW)]
    if _scan_only(docs._jdf.queryExecution().analyzed()):
        try:
            return docs.select(*columns, *place)
        except AnalysisException:
            pass
    return stage(docs.select(*columns), "rows").select(*columns, *place)


def row_name(file: str = FILE, row: str = ROW) -> Column:
    """One number for a ``located`` row."""
    return F.xxhash64(file, row)


def bitmaps(marks: DataFrame) -> DataFrame:
    """``marks(FILE, ROW)`` as staged bitmaps of 32,768 rows each."""
    bucket = F.expr(f"bitmap_bucket_number({ROW} + 1)").alias("__bucket")
    bits = F.expr(f"bitmap_construct_agg(bitmap_bit_position({ROW} + 1))").alias("__bits")
    return stage(marks.groupBy(FILE, bucket).agg(bits), "marks")


def marked_rows(rows: DataFrame, bits: DataFrame, marked: bool = True) -> DataFrame:
    """The rows of a ``located`` frame that ``bitmaps`` name, or all others; ``rows`` are not shuffled.

    Bitmaps are broadcast in waves of ``WAVE_BYTES``, as many as their measured size asks for;
    each wave scans its own files.
    """
    waves = max(1, -(-bits.count() * BITMAP_BYTES // WAVE_BYTES))
    place = F.expr(f"bitmap_bit_position({ROW} + 1)")
    byte = F.conv(F.hex(F.expr(f"substring(__bits, cast(bitmap_bit_position({ROW} + 1) div 8 as int) + 1, 1)")), 16, 10)
    held = F.coalesce(F.expr("shiftright(__byte, cast(__place % 8 as int)) & 1") == 1, F.lit(False))
    found = None
    for wave in range(waves):
        here = F.pmod(F.col(FILE), F.lit(waves)) == wave
        part = (
            rows.where(here)
            .withColumn("__bucket", F.expr(f"bitmap_bucket_number({ROW} + 1)"))
            .join(F.broadcast(bits.where(here)), [FILE, "__bucket"], "inner" if marked else "left")
            .withColumns({"__byte": byte.cast("int"), "__place": place})
            .where(held if marked else ~held)
            .select(*rows.columns)
        )
        found = part if found is None else found.unionByName(part)
    return found


def slices(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """The batches in parts, so that what Python makes of them stays small."""
    for batch in batches:
        for i in range(0, batch.num_rows, rows):
            yield batch.slice(i, rows)


@contextmanager
def batches_of(spark: SparkSession, rows: int) -> Iterator[None]:
    """What is run inside goes to Python in batches of so many rows; the session gets its setting back.

    Spark builds a batch outside the heap, in buffers that double, and Python holds it once more:
    10,000 whole texts are a hundred megabytes a task.
    """
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def hand_back() -> None:
    """Return freed memory to the system: workers stay between tasks, beside the executor's heap."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def filled(text: str | Column) -> Column:
    """A text, null as empty."""
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))
