"""Keyed state across micro-batches: shared memory, optimistic writes, quotas, semantic index, live traces.

State lives in Spark's state store (RocksDB with a changelog), one entry a key, so a micro-batch
reads and writes the keys it meets and nothing else. Progress, state and results lie below one
``location``: an operator that is created again with it goes on where the last one stopped.

Order matters inside a key, so the rows of one key are sorted in one task; the source's limit
(``maxFilesPerTrigger``, ``maxBytesPerTrigger``) bounds them by the size of a micro-batch. Sums,
where order does not matter, are combined before the shuffle instead.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from loomgraph.operators.memory import KEY
from loomgraph.operators.ops import trace_summary
from loomgraph.operators.quota import admit
from loomgraph.session import shared_path

STORE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}


class StatefulStream:
    """A stream with keyed state that can be stopped and started again.

    ``partitions`` splits the state's keys; it is fixed by the first start at a location.
    """

    def __init__(self, spark: SparkSession, location: str | None = None, partitions: int | None = None) -> None:
        self.spark = spark
        self.location = location or shared_path(spark, type(self).__name__.lower())
        shuffled = int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.partitions = partitions or min(shuffled, spark.sparkContext.defaultParallelism)

    @property
    def progress(self) -> str:
        return f"{self.location}/progress"

    def plan(self, rows: DataFrame) -> tuple[DataFrame, str]:
        """The operator over a stream, and its output mode."""
        raise NotImplementedError

    def start(self, rows: DataFrame, **trigger) -> StreamingQuery:
        """Start on a stream; without a trigger it runs over everything available and ends."""
        stream, mode = self.plan(rows)
        writer = stream.writeStream.outputMode(mode).option("checkpointLocation", self.progress)
        writer = writer.trigger(**(trigger or {"availableNow": True}))
        # A query keeps the settings it was started with; the session gets its own back.
        settings = STORE | {"spark.sql.shuffle.partitions": str(self.partitions)}
        before = {name: self.spark.conf.get(name, None) for name in settings}
        for name, value in settings.items():
            self.spark.conf.set(name, value)
        try:
            return self.sink(writer)
        finally:
            for name, value in before.items():
                if value is None:
                    self.spark.conf.unset(name)
                else:
                    self.spark.conf.set(name, value)

    def sink(self, writer) -> StreamingQuery:
        """Results are appended as files; a batch that is run again adds none twice."""
        return writer.format("parquet").option("path", f"{self.location}/results").start()

    def drain(self, rows: DataFrame) -> StatefulStream:
        self.start(rows).awaitTermination()
        return self

    def results(self) -> DataFrame:
        """What all micro-batches so far have given out."""
        return self.spark.read.schema(self.output).parquet(f"{self.location}/results")

    def entries(self, name: str = "state") -> DataFrame:
        """``key, value`` of the store as the last finished micro-batch left it."""
        return self.spark.read.format("statestore").option("stateVarName", name).load(self.progress).select("key", "value")


class KeyedStream(StatefulStream):
    """A stream whose keys are handled by a ``StatefulProcessor``."""

    key: list[str]
    output: str
    time_mode = "None"

    def processor(self) -> StatefulProcessor:
        raise NotImplementedError

    def prepared(self, rows: DataFrame) -> DataFrame:
        return rows

    def plan(self, rows: DataFrame) -> tuple[DataFrame, str]:
        handled = self.prepared(rows).groupBy(*self.key).transformWithState(
            statefulProcessor=self.processor(), outputStructType=self.output, outputMode="Append", timeMode=self.time_mode
        )
        return handled, "append"


class Remembering(StatefulProcessor):
    """Base of processors with one state value a key; ``row`` makes an output row of values.

    Every call on the state is a message to the JVM and back, so a key is not asked whether it has
    a value: without one it gives none.
    """

    schema: str
    names: str

    def row(self, *values: object) -> Row:
        return Row(*self.names.split())(*values)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", self.schema)

    def close(self) -> None:
        pass


MEMORY = "value string, node_id string, updated_at string, tombstone boolean, clock map<string,int>, applied long, ignored long, conflicts long"


def _later(one: tuple, other: tuple) -> bool:
    """Order with nulls first."""
    return [(x is not None, x or "") for x in one] > [(x is not None, x or "") for x in other]


class _MemoryMerge(Remembering):
    schema = MEMORY
    names = "namespace key value node_id updated_at tombstone clock applied ignored conflicts"

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        held = self.state.get()
        kept, clock = (held[:4], dict(held[4] or {})) if held else (None, {})
        applied, ignored, conflicts = held[5:] if held else (0, 0, 0)
        for row in sorted(rows, key=lambda r: r["seq"]):
            # A map arrives as a list of pairs.
            new, given = dict(row["clock"] or ()), (row["value"], row["node_id"], row["updated_at"], row["tombstone"])
            known = all(clock.get(node, 0) >= n for node, n in new.items())
            covers = all(new.get(node, 0) >= n for node, n in clock.items())
            if kept is not None and known:
                ignored += 1
            else:
                applied += 1
                if kept is None or covers:
                    kept = given
                else:
                    conflicts += 1
                    kept = given if _later((given[2], given[1]), (kept[2], kept[1])) else kept
            clock = {node: max(clock.get(node, 0), new.get(node, 0)) for node in sorted({*clock, *new})}
        entry = (*kept, clock, applied, ignored, conflicts)
        self.state.update(entry)
        yield self.row(*key, *entry)


class MemorySync(KeyedStream):
    """Shared-memory merge by vector clocks; ``results`` is the feed of changed entries.

    Rows: ``namespace, key, value, node_id, clock, updated_at, tombstone, seq``.
    """

    key = KEY
    output = f"namespace string, key string, {MEMORY}"

    def processor(self) -> StatefulProcessor:
        return _MemoryMerge()

    def current(self) -> DataFrame:
        """The entry of every key."""
        return self.entries().select("key.*", "value.*")


class _RevisionCheck(Remembering):
    schema = "revision long"
    names = "namespace key seq accepted revision found"

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        revision = (self.state.get() or (0,))[0]
        for row in sorted(rows, key=lambda r: r["seq"]):
            accepted = row["expected"] is None or row["expected"] == revision
            revision += accepted
            yield self.row(*key, row["seq"], accepted, revision if accepted else None, None if accepted else revision)
        self.state.update((revision,))


class OptimisticWrites(KeyedStream):
    """Revision-checked writes; ``results`` holds the verdict on each. Rows: ``namespace, key, seq, expected``."""

    key = KEY
    output = "namespace string, key string, seq long, accepted boolean, revision long, found long"

    def processor(self) -> StatefulProcessor:
        return _RevisionCheck()

    def prepared(self, rows: DataFrame) -> DataFrame:
        return rows.select(*KEY, "seq", "expected")

    def current(self) -> DataFrame:
        """The revision of every key."""
        return self.entries().select("key.*", "value.*")


class _QuotaCheck(Remembering):
    schema = "open array<bigint>"
    names = "principal t seq allowed"

    def __init__(self, limit: int, window: int) -> None:
        self.limit, self.window = limit, window

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        calls = sorted((row["seq"], row["t"]) for row in rows)
        carried = (self.state.get() or ([],))[0]
        allowed, left = admit([t for _, t in calls], carried, self.limit, self.window)
        for (seq, t), passed in zip(calls, allowed, strict=True):
            yield self.row(*key, t, seq, passed)
        self.state.update((left,))
        if left:
            self.handle.registerTimer((left[-1] + self.window) // 1000 + 1)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[Row]:
        """Forget a principal whose window has emptied."""
        held = self.state.get()
        if held:
            left = held[0]
            if not left or left[-1] + self.window <= expiredTimerInfo.getExpiryTimeInMs() * 1000:
                self.state.clear()
        return iter(())


class SlidingQuota(KeyedStream):
    """Quota decisions. Rows: ``principal, t, seq`` with ``t`` in microseconds, in one order with ``seq``.

    The state of a principal is its allowed calls inside the window, at most ``limit``; a timer
    clears it once the watermark, ``lateness`` behind the newest call, has passed them. Calls later
    than that are dropped.
    """

    key = ["principal"]
    output = "principal string, t long, seq long, allowed boolean"
    time_mode = "EventTime"

    def __init__(self, spark: SparkSession, limit: int, window_micros: int, location: str | None = None, lateness: str = "1 hour", **options) -> None:
        super().__init__(spark, location, **options)
        self.limit, self.window, self.lateness = limit, window_micros, lateness

    def processor(self) -> StatefulProcessor:
        return _QuotaCheck(self.limit, self.window)

    def prepared(self, rows: DataFrame) -> DataFrame:
        timed = rows.select("principal", "t", "seq", F.timestamp_micros("t").alias("_at"))
        return timed.withWatermark("_at", self.lateness)


class _DigestCheck(Remembering):
    schema = "digest string, version long"
    names = "id text path symbol digest version"

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        digest, version = self.state.get() or (None, 0)
        # Of several rows in a batch the one with the greatest digest counts: any fixed choice will do.
        row = max(rows, key=lambda r: r["digest"])
        if row["digest"] != digest:
            self.state.update((row["digest"], version + 1))
            yield self.row(*key, row["text"], row["path"], row["symbol"], row["digest"], version + 1)


class SemanticRefresh(KeyedStream):
    """Semantic index that embeds only new or changed documents.

    ``embed`` is any ``text -> array<double>`` column function. Documents: ``id, text, path,
    symbol``; a document is unchanged when all of them are. The state is a digest and a version
    a document; vectors are appended, and the index is the last version of each.
    """

    key = ["id"]
    changed = "id string, text string, path string, symbol string, digest string, version long"
    output = "id string, path string, symbol string, digest string, version long, vector array<double>"

    def __init__(self, spark: SparkSession, embed, location: str | None = None, **options) -> None:
        super().__init__(spark, location, **options)
        self.embed = embed

    def processor(self) -> StatefulProcessor:
        return _DigestCheck()

    def plan(self, rows: DataFrame) -> tuple[DataFrame, str]:
        digest = F.sha2(F.concat_ws("\u0001", "text", "path", "symbol"), 256)
        handled = rows.select("id", "text", "path", "symbol", digest.alias("digest")).groupBy(*self.key).transformWithState(
            statefulProcessor=self.processor(), outputStructType=self.changed, outputMode="Append", timeMode=self.time_mode
        )
        return handled.select("id", "path", "symbol", "digest", "version", self.embed(F.col("text")).alias("vector")), "append"

    def current(self) -> DataFrame:
        """The index: an aggregate by id over the appended versions."""
        rest = ("path", "symbol", "digest", "vector")
        last = self.results().groupBy("id").agg(F.max_by(F.struct(*rest), "version").alias("r"), F.max("version").alias("version"))
        return last.select("id", "r.*", "version")


class LiveTraces(StatefulStream):
    """Whole-trace sums of a span stream: a streaming aggregate, combined before the shuffle, so no trace is hot.

    Rows: ``trace_id, name, status, duration_ms, attributes``. Nothing is given out; ``current``
    reads the sums from the store.
    """

    def plan(self, rows: DataFrame) -> tuple[DataFrame, str]:
        return trace_summary(rows), "update"

    def sink(self, writer) -> StreamingQuery:
        return writer.format("noop").start()

    def current(self) -> DataFrame:
        stored = self.spark.read.format("statestore").load(self.progress)
        # The store names sums after their functions, twice the same; their order is the aggregate's.
        sums = "struct<spans:bigint,errors:bigint,duration_ms:double,tool_calls:bigint,context_tokens:bigint>"
        return stored.select("key.*", F.col("value").cast(sums).alias("sums")).select("trace_id", "sums.*")
