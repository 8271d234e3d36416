"""Streams with keyed state: several micro-batches, restarts, timers, and what a batch writes."""

import random
import time
from pathlib import Path

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from loomgraph.session import shared_path
from loomgraph.streaming import live, state
from loomgraph.streaming.sources import arrivals, parquet_stream
from test_memory import MUTATION, accept, as_states, expected_states, random_calls, random_mutations, sliding

CALL = "principal string, t long, seq long"


def write_part(spark, folder, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)


def write_parts(spark, data, schema, parts):
    folder = shared_path(spark, "parts")
    size = -(-len(data) // parts)
    for i in range(parts):
        write_part(spark, folder, data[i * size : (i + 1) * size], schema)
    return folder


def stream_of(spark, folder, files=1):
    return parquet_stream(spark, folder, spark.read.parquet(folder).schema, files_per_trigger=files)


def batches(query):
    query.awaitTermination()
    return [p for p in query.recentProgress if p["numInputRows"]]


@pytest.mark.parametrize("seed", [9, 10])
def test_memory_sync_over_several_batches(spark, seed):
    data = random_mutations(seed)
    merge = state.MemorySync(spark, partitions=2)
    assert len(batches(merge.start(stream_of(spark, write_parts(spark, data, MUTATION, 3))))) == 3
    assert as_states(merge.current()) == expected_states(data)
    # The feed names every key once a batch that met it; its last entries are the state.
    assert as_states(merge.results().dropDuplicates(["key", "applied", "ignored"]).groupBy("key").agg(
        F.max_by(F.struct("value", "node_id", "updated_at", "tombstone", "clock", "applied", "ignored", "conflicts"), F.col("applied") + F.col("ignored")).alias("r")
    ).select("key", "r.*")) == expected_states(data)


def test_memory_sync_goes_on_where_it_stopped(spark):
    """Stopped while it runs, then created anew at the same place, it gives what one run gives."""
    data = random_mutations(12, 150)
    folder = shared_path(spark, "parts")
    location = shared_path(spark, "memory")
    for i in range(3):
        write_part(spark, folder, data[i * 30 : (i + 1) * 30], MUTATION)
    running = state.MemorySync(spark, location, partitions=2).start(stream_of(spark, folder), processingTime="0 seconds")
    until = time.time() + 120
    while not any(p["numInputRows"] for p in running.recentProgress) and time.time() < until:
        time.sleep(0.05)
    running.stop()
    for i in range(3, 5):
        write_part(spark, folder, data[i * 30 : (i + 1) * 30], MUTATION)
    again = state.MemorySync(spark, location, partitions=2)
    again.drain(stream_of(spark, folder))
    assert as_states(again.current()) == expected_states(data)
    again.drain(stream_of(spark, folder))
    assert as_states(again.current()) == expected_states(data)


def test_a_batch_writes_what_it_changes(spark):
    many = [dict(namespace="n", key=f"k{i}", value="v" * 50, node_id="a", clock={"a": 1}, updated_at="1", tombstone=False, seq=i) for i in range(3000)]
    one = [dict(many[7], clock={"a": 2}, seq=9000)]
    folder = shared_path(spark, "parts")
    write_part(spark, folder, many, MUTATION)
    merge = state.MemorySync(spark, partitions=2)
    merge.drain(stream_of(spark, folder))
    first = changelogs(merge)
    write_part(spark, folder, one, MUTATION)
    merge.drain(stream_of(spark, folder))
    assert merge.current().count() == 3000
    assert merge.current().where("applied = 2").count() == 1
    assert 0 < changelogs(merge) - first < first / 50


def changelogs(merge):
    folder = Path(merge.progress.removeprefix("file:"))
    return sum(f.stat().st_size for f in folder.rglob("*.changelog"))


def test_optimistic_writes_over_several_batches(spark):
    rng = random.Random(11)
    data = [("n", rng.choice("ab"), i, rng.choice([None, 0, 1, i // 9])) for i in range(90)]
    folder = write_parts(spark, data, "namespace string, key string, seq long, expected long", 3)
    checks = state.OptimisticWrites(spark, partitions=2)
    checks.drain(stream_of(spark, folder))
    got = {r.seq: (r.accepted, r.revision, r.found) for r in checks.results().collect()}
    assert got == accept([d[1:] for d in data])
    accepted = {k: sum(got[i][0] for _, key, i, _ in data if key == k) for k in "ab"}
    assert {r.key: r.revision for r in checks.current().collect()} == accepted


def test_quota_over_several_batches_and_a_restart(spark):
    calls = [(p, t * 1_000_000, seq) for p, t, seq in random_calls(5, 120)]
    folder, location = shared_path(spark, "parts"), shared_path(spark, "quota")
    for i in range(3):
        write_part(spark, folder, calls[i * 40 : (i + 1) * 40], CALL)
        quota = state.SlidingQuota(spark, 3, 20_000_000, location, partitions=2)
        quota.drain(stream_of(spark, folder))
    assert {r.seq: r.allowed for r in quota.results().collect()} == sliding(calls, 3, 20_000_000)


def test_quota_forgets_principals_whose_window_is_empty(spark):
    calls = [(f"p{i}", 1_000_000 + i * 1_000, i) for i in range(40)] + [("late", 500_000_000, 40)]
    folder = shared_path(spark, "parts")
    quota = state.SlidingQuota(spark, 3, 20_000_000, lateness="1 second", partitions=2)
    for part in (calls[:40], calls[40:]):
        write_part(spark, folder, part, CALL)
        quota.drain(stream_of(spark, folder))
    assert [r.key.principal for r in quota.entries().collect()] == ["late"]
    assert quota.results().where("allowed").count() == 41


def test_semantic_refresh_embeds_changes_only(spark):
    docs = [(str(i), f"text {i}", "p", "s") for i in range(20)]
    folder = shared_path(spark, "parts")
    schema = "id string, text string, path string, symbol string"
    index = state.SemanticRefresh(spark, lambda text: F.array(F.length(text).cast("double")), partitions=2)
    write_part(spark, folder, docs, schema)
    index.drain(stream_of(spark, folder))
    write_part(spark, folder, [*docs[:18], ("18", "another text", "p", "s"), ("20", None, None, "s"), ("20", None, None, "s")], schema)
    index.drain(stream_of(spark, folder))
    assert index.results().count() == 22
    got = {r.id: (r.version, r.vector) for r in index.current().collect()}
    assert got["18"] == (2, [12.0]) and got["0"] == (1, [6.0]) and got["20"] == (1, [None]) and len(got) == 21


def test_a_document_takes_two_calls_on_the_state():
    """One asks for its value, one sets it, if it changed; each is a message to the JVM and back."""

    class Store:
        def __init__(self):
            self.held, self.calls = None, []

        def exists(self):
            self.calls.append("exists")
            return self.held is not None

        def get(self):
            self.calls.append("get")
            return self.held

        def update(self, value):
            self.calls.append("update")
            self.held = value

    check = state._DigestCheck()
    check.state = Store()
    row = Row(text="t", path="p", symbol="s", digest="d")
    assert [r.version for r in check.handleInputRows(("1",), iter([row]), None)] == [1]
    assert list(check.handleInputRows(("1",), iter([row]), None)) == []
    assert [r.version for r in check.handleInputRows(("1",), iter([Row(text="u", path="p", symbol="s", digest="e")]), None)] == [2]
    assert check.state.calls == ["get", "update", "get", "get", "update"]


def test_live_traces_add_up_over_restarts(spark):
    spans = spark.range(1000).selectExpr(
        "id", "if(id % 3 = 0, concat('t', id % 7), 'hot') as trace_id", "if(id % 2 = 0, 'tool.x', 'engine') as name",
        "if(id % 5 = 0, 'error', 'ok') as status", "cast(id as double) as duration_ms", "map('context_tokens', cast(id as string)) as attributes",
    )
    location = shared_path(spark, "traces")
    for stream in arrivals(spans, "id", 3):
        traces = state.LiveTraces(spark, location, partitions=2)
        traces.drain(stream)
    got = {r.trace_id: tuple(r)[1:] for r in traces.current().collect()}
    hot = [i for i in range(1000) if i % 3]
    assert got["hot"] == (len(hot), sum(i % 5 == 0 for i in hot), float(sum(hot)), sum(i % 2 == 0 for i in hot), sum(hot))
    assert len(got) == 8


def test_alerts_are_appended_once(spark):
    backends = spark.createDataFrame([(1, True), (2, False)], "id int, healthy boolean")
    jobs = spark.range(30).selectExpr("id as job_id", "if(id % 10 = 0, 'failed', 'done') as status", "id as created_at")
    alerts = live.AlertLog(backends)
    for stream in arrivals(jobs, "job_id", 3):
        alerts.start(stream).awaitTermination()
        alerts.start(stream).awaitTermination()
    got = sorted((r.batch, r.kind, r["count"]) for r in alerts.notifications().collect())
    assert got == [(b, k, 1) for b in range(3) for k in ("backend.unhealthy", "job.failure")]
    # A batch that is run again, as after a failure, replaces what it has written.
    alerts._scan(jobs.where("job_id < 10"), 0)
    assert alerts.notifications().count() == 6


def test_settings_of_the_session_stay(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    folder = write_parts(spark, [("a", 1, 1)], CALL, 1)
    state.SlidingQuota(spark, 1, 10, partitions=3).drain(stream_of(spark, folder))
    assert spark.conf.get("spark.sql.shuffle.partitions") == before
