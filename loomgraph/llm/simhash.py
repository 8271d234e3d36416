"""SimHash near-duplicates: pigeonhole blocks find the pairs, Hamming distances decide."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.llm.common import FILE, KEEPER, ROW, hand_back, located, row_name, stage
from loomgraph.llm.components import components

DISTANCE = 3
SHINGLE = 3
SEED = 42
#: Blocks of the 64 bits. Fingerprints at most DISTANCE apart agree on BLOCKS - DISTANCE of them.
BLOCKS = 6
#: Fingerprints of a bucket that are compared directly; larger buckets are blocked once more.
CROWD = 2048


def shingle_hashes(text: str | None, words: int = SHINGLE) -> np.ndarray:
    """Hashes of the text's word shingles, repeats included; one for fewer words, none without words."""
    parts = (text or "").encode().lower().split()
    if not parts:
        return np.array([], np.uint64)
    n = max(1, len(parts) - words + 1)
    joined = b" ".join(parts)
    ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1)
    starts = (ends - np.fromiter(map(len, parts), np.int64, len(parts)) - 1)[:n].tolist()
    stops = (ends[min(words, len(parts)) - 1 :] - 1)[:n].tolist()
    hashed = xxhash.xxh64_intdigest
    return np.fromiter((hashed(joined[a:b], SEED) for a, b in zip(starts, stops, strict=True)), np.uint64, n)


def fingerprint(text: str | None, words: int = SHINGLE) -> int:
    """Unsigned 64-bit SimHash of the text's word shingles; 0 without words."""
    return _majority(shingle_hashes(text, words))


def _majority(h: np.ndarray, step: int = 1 << 14) -> int:
    """Bits set in over half of the numbers."""
    counts = np.zeros(64, np.int64)
    for i in range(0, len(h), step):
        bits = np.unpackbits(h[i : i + step].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        counts += bits.sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(counts * 2 > len(h)).tobytes(), "big")


def fingerprints(rows: DataFrame) -> DataFrame:
    """doc_id, ``FILE``, ``ROW`` and fp (the 64 bits as a signed long) of ``located`` texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([fingerprint(x.as_py()) for x in batch.column("text")], np.uint64).view(np.int64)
            yield pa.record_batch({c: batch.column(c) for c in ("doc_id", FILE, ROW)} | {"fp": pa.array(fps)})
        hand_back()

    return rows.select(F.col("doc_id").cast("long"), FILE, ROW, "text").mapInArrow(run, f"doc_id long, {FILE} long, {ROW} long, fp long")


def block_masks(bits: int, blocks: int = BLOCKS, distance: int = DISTANCE) -> list[int]:
    """Masks of every choice of ``blocks - distance`` blocks of the set bits of ``bits``."""
    places = [i for i in range(64) if bits >> i & 1]
    cuts = np.array_split(np.array(places), blocks)
    masks = [sum(1 << int(i) for i in cut) for cut in cuts]
    return [sum(c) for c in combinations(masks, blocks - distance)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _near(fp: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links that join all close fingerprints with one key, rows in order of the key.

    Compares every row with the next, the second next and so on inside its run, and keeps a
    link only if it joins what no link before has joined: fewer than rows.
    """
    run_end = np.searchsorted(key, key, side="right")
    root = np.arange(len(fp))
    a: list[int] = []
    b: list[int] = []

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for step in range(1, int((run_end - np.arange(len(fp))).max(initial=1))):
        at = np.flatnonzero(np.arange(len(fp)) + step < run_end)
        root = root[root]
        at = at[(root[at] != root[at + step]) & (np.bitwise_count(fp[at] ^ fp[at + step]) <= DISTANCE)]
        for i in at.tolist():
            x, y = find(i), find(i + step)
            if x != y:
                root[max(x, y)] = min(x, y)
                a.append(i)
                b.append(i + step)
    return np.array(a, np.int64), np.array(b, np.int64)


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links inside every bucket. Rows come in order of their bucket; a cut bucket waits for the next batch."""
    names, rest = ["part", "key", "fp"], None
    batches = iter(batches)
    batch = next(batches, None)
    while batch is not None:
        following = next(batches, None)
        rows = np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in names])
        rows = rows if rest is None else np.concatenate([rest, rows], axis=1)
        bucket = np.cumsum((np.diff(rows[0], prepend=rows[0, :1]) != 0) | (np.diff(rows[1], prepend=rows[1, :1]) != 0))
        whole = len(bucket) if following is None else int(np.searchsorted(bucket, bucket[-1])) if len(bucket) else 0
        a, b = _near(rows[2, :whole].copy().view(np.uint64), bucket[:whole])
        yield pa.record_batch({"a": pa.array(rows[2, a]), "b": pa.array(rows[2, b])})
        rest = rows[:, whole:]
        batch = following


def _found(keyed: DataFrame) -> DataFrame:
    """Links inside the buckets ``part, key`` of the rows."""
    dealt = keyed.select("part", "key", "fp").repartition("part", "key").sortWithinPartitions("part", "key")
    return dealt.mapInArrow(_compare, "a long, b long")


def links(fps: DataFrame, crowd: int = CROWD) -> DataFrame:
    """``a, b`` at most DISTANCE bits apart, joining all of the distinct ``fps(fp)`` that are.

    Six blocks, of which close pairs share three: 20 keys of 32 bits for each fingerprint. Buckets
    of one are dropped before anything is compared. A bucket with more than ``crowd`` members is
    blocked again by its free bits, which leaves at most 2^16 different fingerprints with
    one key, whatever the data.
    """
    everything = (1 << 64) - 1
    masks = block_masks(everything)
    first = fps.select("fp", F.posexplode(F.array(*[F.lit(_signed(m)) for m in masks])).alias("part", "mask"))
    first = first.select("part", F.col("fp").bitwiseAND(F.col("mask")).alias("key"), "fp")
    sized = first.withColumn("n", F.count("*").over(Window.partitionBy("part", "key"))).where("n > 1")
    sized = stage(sized, "buckets")
    finer = [[m | free for free in block_masks(everything ^ m)] for m in masks]
    finer = F.array(*[F.array(*[F.lit(_signed(m)) for m in ms]) for ms in finer])
    second = sized.where(F.col("n") > crowd).select("part", "fp", F.posexplode(finer[F.col("part")]).alias("sub", "mask"))
    second = second.select((F.col("part") * 100 + F.col("sub")).alias("part"), F.col("fp").bitwiseAND(F.col("mask")).alias("key"), "fp")
    return _found(sized.where(F.col("n") <= crowd)).unionByName(_found(second))


def near_duplicates(docs: DataFrame, crowd: int = CROWD) -> DataFrame:
    """doc_id, fingerprint (hex), component_id and kept of every row, with ``FILE``, ``ROW`` and ``KEEPER``.

    Texts whose fingerprints differ in at most three bits are linked; component_id is the
    smallest doc_id reachable, and that row is kept, one of them where rows repeat. Null and
    empty texts have fingerprint zero, linked like any other; a null doc_id sorts last, so a
    component of null ids only has a null component_id; an empty table gives none; other columns
    are not read. Equal fingerprints are one before blocks are built, so copies cost nothing.
    """
    rows = stage(fingerprints(located(docs, "doc_id", "text")), "fingerprints")
    first = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", FILE, ROW)
    distinct = stage(rows.groupBy("fp").agg(F.min(first).alias("first")), "distinct")
    joined = distinct.join(components(links(distinct, crowd)).withColumnRenamed("node", "fp"), "fp", "left")
    joined = joined.withColumn("component", F.coalesce("component", "fp"))
    keepers = joined.groupBy("component").agg(F.min("first").alias("keeper"))
    labels = joined.select("fp", "component").join(keepers, "component").select("fp", "keeper")
    same = [F.col(f"keeper.{c}") == F.col(c) for c in (FILE, ROW)]
    return rows.join(labels, "fp").select(
        "doc_id",
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        F.col("keeper.doc_id").alias("component_id"),
        (same[0] & same[1]).alias("kept"),
        FILE,
        ROW,
        row_name(f"keeper.{FILE}", f"keeper.{ROW}").alias(KEEPER),
    )
