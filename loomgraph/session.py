"""Session helpers: table loading, durable checkpoints, shared folders."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


class Tables:
    """Lazy parquet tables of one folder: ``Tables(spark, dir).orders``."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        # Event times carry no zone; reading them as UTC keeps results independent of the host.
        spark.conf.set("spark.sql.session.timeZone", "UTC")
        self.spark = spark
        self.folder = folder.rstrip("/")

    def __getattr__(self, name: str) -> DataFrame:
        if name not in TABLES:
            raise AttributeError(name)
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")


    def spread(self, name: str) -> DataFrame:
        """A table whose few files hold less parallelism than the cluster, dealt out evenly.

        Meant in front of work that is heavy per row. A table of many splits, as at scale, is
        returned as it is, so no text is shuffled there.
        """
        table = getattr(self, name)
        wanted = self.spark.sparkContext.defaultParallelism
        return table if table.rdd.getNumPartitions() >= wanted else table.repartition(wanted)


def shared_folder(spark: SparkSession) -> str:
    """Folder every executor can reach, named by ``spark.checkpoint.dir``.

    Only a local-mode session may fall back to a temporary folder: there the driver and
    the executors are one process on one machine.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
    folder = tempfile.mkdtemp(prefix="loomgraph-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def shared_path(spark: SparkSession, label: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex[:12]}"


@contextmanager
def _shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Plans made and run inside leave no shuffle files. Otherwise they stay until the driver's collector meets them."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, "false")
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def durable(df: DataFrame) -> DataFrame:
    """Cut lineage with a replicated checkpoint, so a lost executor costs one re-read.

    Iterative operators call this once per round; without it the plan doubles each hop.
    """
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    with _shuffles_dropped(df.sparkSession):
        return _noted(df.select("*").checkpoint(eager=True))


def packed(df: DataFrame) -> DataFrame:
    """As ``durable``, for wide rows: files of compressed columns, a quarter of a checkpoint's bytes, in any order."""
    frame, path = stage_at(df, "packed")
    _PACKED.add(path.rsplit("/", 1)[1])
    return _noted(frame)


#: Folders that ``packed`` made, by name, and paths that the innermost ``scratch`` is to delete.
_PACKED: set[str] = set()
_SCRATCH: ContextVar[list[tuple[SparkSession, str]] | None] = ContextVar("scratch", default=None)


def _path_of(frame: DataFrame) -> str | None:
    """Where ``durable`` or ``packed`` wrote a frame; none for any other one."""
    plan = frame._jdf.queryExecution().analyzed()
    while plan.nodeName() == "ResolvedHint":
        plan = plan.child()
    if plan.nodeName() == "LogicalRDD" and plan.rdd().getCheckpointFile().isDefined():
        return plan.rdd().getCheckpointFile().get()
    if plan.nodeName() == "LogicalRelation" and plan.relation().getClass().getSimpleName() == "HadoopFsRelation":
        path = plan.relation().location().rootPaths().apply(0).toString()
        return path if path.rsplit("/", 1)[-1] in _PACKED else None
    return None


def _noted(frame: DataFrame) -> DataFrame:
    made = _SCRATCH.get()
    if made is not None and (path := _path_of(frame)):
        made.append((frame.sparkSession, path))
    return frame


@contextmanager
def scratch() -> Iterator[Callable[[DataFrame], DataFrame]]:
    """What ``durable`` and ``packed`` write inside is deleted at the end, but the frames that the function given is called with.

    For steps that end in stored rows: what leaves must not read what goes. Kept frames belong to the scratch around, if any.
    """
    made: list[tuple[SparkSession, str]] = []
    kept: set[str] = set()

    def keep(frame: DataFrame) -> DataFrame:
        kept.add(_path_of(frame))
        return frame

    token = _SCRATCH.set(made)
    try:
        yield keep
    finally:
        _SCRATCH.reset(token)
    around = _SCRATCH.get()
    for spark, path in made:
        if path not in kept:
            drop_stage(spark, path)
        elif around is not None:
            around.append((spark, path))


def release(*frames: DataFrame) -> None:
    """Delete what ``durable`` and ``packed`` wrote of frames that neither a later step nor a result reads. Other frames are left."""
    for frame in frames:
        if path := _path_of(frame):
            drop_stage(frame.sparkSession, path)


def stage_at(df: DataFrame, label: str) -> tuple[DataFrame, str]:
    """Write compressed to the shared folder and read back; with the path, for ``drop_stage`` once it is superseded."""
    spark = df.sparkSession
    path = shared_path(spark, label)
    with _shuffles_dropped(spark):
        df.select("*").write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def drop_stage(spark: SparkSession, path: str) -> None:
    """Delete a stage that nothing reads any more."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def large(df: DataFrame) -> DataFrame:
    """Joined by sorting both sides, never by sending one to the driver.

    Spark guesses a size from compressed files, and a checkpoint passes the guess on, so rows with
    generated or parsed text look small enough to broadcast at any size. The hint holds
    through selects, filters and aggregates up to the next join or union.
    """
    return df.hint("merge")
