"""Folds over shared memory and quotas against plain sequential versions."""

import random
from collections import deque

import pytest
from pyspark.sql import functions as F

from loomgraph.operators import memory, quota
from loomgraph.functions import clocks

MUTATION = "namespace string, key string, value string, node_id string, clock map<string,int>, updated_at string, tombstone boolean, seq long"


def fold(mutations):
    """Reference rule, one key at a time."""
    states = {}
    for m in sorted(mutations, key=lambda x: x["seq"]):
        cur = states.get(m["key"])
        if cur is None:
            states[m["key"]] = {**m, "applied": 1, "ignored": 0, "conflicts": 0}
            continue
        nodes = set(cur["clock"]) | set(m["clock"])
        le = all(cur["clock"].get(n, 0) <= m["clock"].get(n, 0) for n in nodes)
        ge = all(cur["clock"].get(n, 0) >= m["clock"].get(n, 0) for n in nodes)
        counts = {c: cur[c] for c in ("applied", "ignored", "conflicts")}
        if ge:
            cur["ignored"] += 1
        elif le:
            states[m["key"]] = {**m, **counts, "applied": counts["applied"] + 1}
        else:
            wins = (m["updated_at"], m["node_id"]) > (cur["updated_at"], cur["node_id"])
            merged = {n: max(cur["clock"].get(n, 0), m["clock"].get(n, 0)) for n in nodes}
            states[m["key"]] = {
                **(m if wins else cur), **counts, "clock": merged,
                "applied": counts["applied"] + 1, "conflicts": counts["conflicts"] + 1,
            }
    return states


def random_mutations(seed, n=120):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        clock = {node: rng.randrange(1, 2 + i // 15) for node in rng.sample("abc", rng.randrange(0, 4))}
        out.append(
            dict(
                namespace="ns", key=rng.choice("xxyz"), value=f"v{i}", node_id=rng.choice("abc"), clock=clock,
                updated_at=f"{rng.randrange(30):03}", tombstone=rng.random() < 0.1, seq=i,
            )
        )
    return out


def as_states(df):
    return {
        r.key: (r.value, r.node_id, r.updated_at, r.tombstone, dict(r.clock or {}), r.applied, r.ignored, r.conflicts)
        for r in df.collect()
    }


def expected_states(data):
    return {
        k: (s["value"], s["node_id"], s["updated_at"], s["tombstone"], s["clock"], s["applied"], s["ignored"], s["conflicts"])
        for k, s in fold(data).items()
    }


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_memory_sync_equals_fold(spark, seed):
    data = random_mutations(seed)
    df = spark.createDataFrame(data, MUTATION)
    assert as_states(memory.memory_sync(df, segment_rows=8)) == expected_states(data)


def test_clock_table(spark):
    cases = [({"a": 1}, {"a": 2}, "before"), ({"a": 2}, {"b": 1}, "concurrent"), ({}, {}, "equal"), ({"a": 3}, {"a": 2}, "after")]
    df = spark.createDataFrame(cases, "l map<string,int>, r map<string,int>, want string")
    got = df.select(clocks.compare(F.col("l"), F.col("r")).alias("c"), "want").collect()
    assert all(r.c == r.want for r in got)
    merged = df.select(clocks.merge(F.col("l"), F.col("r")).alias("m")).collect()
    assert [r.m for r in merged] == [{"a": 2}, {"a": 2, "b": 1}, {}, {"a": 3}]


def test_forced_newer_concurrent_write(spark):
    data = [
        dict(namespace="n", key="k", value="old", node_id="a", clock={"a": 2}, updated_at="1", tombstone=False, seq=1),
        dict(namespace="n", key="k", value="new", node_id="b", clock={"b": 1}, updated_at="2", tombstone=False, seq=2),
        dict(namespace="n", key="k", value="older", node_id="a", clock={"a": 1}, updated_at="9", tombstone=False, seq=3),
    ]
    row = memory.memory_sync(spark.createDataFrame(data, MUTATION)).first()
    assert (row.value, row.clock, row.conflicts, row.applied, row.ignored) == ("new", {"a": 2, "b": 1}, 1, 2, 1)


def test_two_replicas_converge(spark):
    a = dict(namespace="n", key="k", value="A", node_id="a", clock={"a": 1}, updated_at="1", tombstone=False)
    b = dict(namespace="n", key="k", value="B", node_id="b", clock={"b": 1}, updated_at="2", tombstone=False)
    states = []
    for order in ([a, b], [b, a]):
        data = [{**m, "seq": i} for i, m in enumerate(order)]
        row = memory.memory_sync(spark.createDataFrame(data, MUTATION)).first()
        states.append((row.value, row.clock))
    assert states[0] == states[1]


def accept(writes):
    current, out = {}, {}
    for key, seq, expected in sorted(writes, key=lambda w: w[1]):
        now = current.get(key, 0)
        if expected is None or expected == now:
            current[key] = now + 1
            out[seq] = (True, now + 1, None)
        else:
            out[seq] = (False, None, now)
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_optimistic_writes_equal_sequential_rule(spark, seed):
    rng = random.Random(seed)
    data = [(rng.choice("ab"), i, rng.choice([None, 0, 1, 2, 3, i // 8, i // 10])) for i in range(150)]
    df = spark.createDataFrame(data, "key string, seq long, expected long").withColumn("namespace", F.lit("n"))
    got = {r.seq: (r.accepted, r.revision, r.found) for r in memory.optimistic_writes(df, segment_rows=16).collect()}
    assert got == accept(data)


def test_team_memory_revisions(spark):
    df = spark.createDataFrame([("n", "k", "one", 1), ("n", "k", "two", 2)], "namespace string, key string, value string, seq long")
    assert [(r.value, r.revision) for r in memory.history(df).orderBy("revision").collect()] == [("one", 1), ("two", 2)]
    assert memory.latest(df).first().revision == 2
    assert memory.revisions(df).count() == 2


def sliding(calls, limit, window):
    open_calls, out = {}, {}
    for principal, t, seq in sorted(calls, key=lambda c: c[2]):
        q = open_calls.setdefault(principal, deque())
        while q and q[0] <= t - window:
            q.popleft()
        out[seq] = len(q) < limit
        if out[seq]:
            q.append(t)
    return out


def random_calls(seed, n=200):
    rng = random.Random(seed)
    t, out = 0, []
    for i in range(n):
        t += rng.choice([0, 1, 2, 5, 30])
        out.append((rng.choice("aaab"), t, i))
    return out


@pytest.mark.parametrize("segment", [7, 100000])
def test_sliding_quota_equals_sequential_rule(spark, segment):
    calls = random_calls(segment)
    df = spark.createDataFrame(calls, "principal string, t long, seq long")
    got = {r.seq: r.allowed for r in quota.sliding_quota(df, 3, 20, segment_rows=segment).collect()}
    assert got == sliding(calls, 3, 20)
