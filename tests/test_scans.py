"""Segmented scans, dyadic lookups and greedy keeps against brute force on random input."""

import random

import pytest
from pyspark.sql import functions as F

from loomgraph.operators import scans


def table(spark, rng, n, keys=3):
    data = [(f"k{rng.randrange(keys)}", i, rng.choice([None, 0, 1, 5, 9])) for i in range(n)]
    return data, spark.createDataFrame(data, "key string, seq long, v int")


@pytest.mark.parametrize("inclusive", [True, False])
@pytest.mark.parametrize("size", [1, 3, 1000])
def test_prefix_equals_plain_scan(spark, inclusive, size):
    rng = random.Random(size * 2 + inclusive)
    data, df = table(spark, rng, 60)
    df = df.withColumn("seg", scans.segment_of(F.col("seq"), size))
    out = scans.prefix(
        df, ["key"], ["seq"], "seg",
        {"s": ("sum", F.col("v")), "m": ("max", F.col("v")), "l": ("last", F.col("v"))}, inclusive=inclusive,
    )
    got = {r.seq: (r.s, r.m, r.l) for r in out.collect()}
    for key, seq, _ in data:
        seen = [v for k, s, v in data if k == key and (s <= seq if inclusive else s < seq) and v is not None]
        want = (sum(seen), max(seen), seen[-1]) if seen else (None, None, None)
        assert got[seq] == want


def test_asof_takes_latest_at_or_before(spark):
    rng = random.Random(4)
    left = [(rng.choice("ab"), rng.randrange(40), i) for i in range(40)]
    right = [(rng.choice("ab"), rng.randrange(40), f"r{i:02}") for i in range(30)]
    ldf = spark.createDataFrame(left, "key string, at long, id int")
    rdf = spark.createDataFrame(right, "key string, pos long, name string")
    out = scans.asof(ldf, rdf, ["key"], "at", "pos", F.col("name"), "hit", prefer=F.col("name"), segment_size=7)
    got = {r.id: r.hit for r in out.collect()}
    for key, at, i in left:
        options = [(pos, name) for k, pos, name in right if k == key and pos <= at]
        assert got[i] == (max(options)[1] if options else None)


def test_stab_finds_best_cover(spark):
    rng = random.Random(5)
    spans = [("f", s := rng.randrange(300), s + rng.choice([0, 1, 7, 150, 5000]), i) for i in range(60)]
    points = [("f", p) for p in range(0, 400, 3)]
    out = scans.stab(
        spark.createDataFrame(points, "path string, at int"),
        spark.createDataFrame(spans, "path string, s long, e long, id int"),
        ["path"], "at", "s", "e", F.struct("s", "id"), "hit", bits=8,
    )
    got = {r["at"]: r.hit for r in out.collect()}
    for _, p in points:
        cover = [(s, i) for _, s, e, i in spans if s <= p <= e]
        assert (tuple(got[p]) if got[p] else None) == (max(cover) if cover else None)


def test_overlapping_without_pairs(spark, rows):
    rng = random.Random(6)
    units = [("f", s := rng.randrange(100), s + rng.randrange(6), i) for i in range(50)]
    hunks = [("f", s := rng.randrange(100), s + rng.randrange(3)) for _ in range(12)]
    out = scans.overlapping(
        spark.createDataFrame(units, "path string, s int, e int, id int"),
        spark.createDataFrame(hunks, "path string, hs int, he int"),
        ["path"], "s", "e", "hs", "he",
    )
    want = sorted((i,) for _, s, e, i in units if any(s <= he and hs <= e for _, hs, he in hunks))
    assert sorted(rows(out, "id")) == want


def test_greedy_keep_equals_front_to_back_scan(spark):
    rng = random.Random(7)
    n = 40
    pairs = {tuple(sorted(rng.sample(range(n), 2))) for _ in range(70)}
    kept = set()
    for i in range(n):
        if not any((j, i) in pairs for j in kept):
            kept.add(i)
    out = scans.greedy_keep(
        spark.createDataFrame([(i,) for i in range(n)], "id int"),
        spark.createDataFrame(sorted(pairs), "earlier int, later int"),
    )
    assert {r.id for r in out.collect()} == kept
