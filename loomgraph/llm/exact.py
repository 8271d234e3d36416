"""Exact deduplication: Golomb-coded fingerprint exchange, then byte verification of suspects."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.llm import golomb
from loomgraph.llm.common import BLANKS, FILE, ROW, bitmaps, filled, located, marked_rows, stage

#: Fingerprints that one owner holds, and that one sender sorts at a time.
OWNED = 1 << 21
SENT = 1 << 21

SENT_SCHEMA = f"owner int, {FILE} long, {ROW} long, n int, k int, code binary, counts binary, places binary"


def normalised(text: str | Column = "text") -> Column:
    """A text with every run of blanks as one space; null is empty."""
    return F.regexp_replace(filled(text), BLANKS, " ")


def _lists(h: np.ndarray, places: np.ndarray, owners: int) -> dict[str, list]:
    """One sender's distinct fingerprints per owner, coded, with the rows behind each of them."""
    h = h.view(np.uint64)
    order = np.argsort(h, kind="stable")
    names, first, counts = np.unique(h[order], return_index=True, return_counts=True)
    width = -(-(1 << 64) // owners)
    owner = (names // np.uint64(width)).astype(np.int64) if owners > 1 else np.zeros(len(names), np.int64)
    cuts = np.flatnonzero(np.diff(owner, prepend=-1))
    rows: dict[str, list] = {c: [] for c in ("owner", FILE, ROW, "n", "k", "code", "counts", "places")}
    for i, j in zip(cuts, [*cuts[1:], len(names)], strict=True):
        k, code = golomb.encode(names[i:j] - np.uint64(int(owner[i]) * width))
        lo, hi = first[i], first[j - 1] + counts[j - 1]
        held = (owner[i], *places[0], j - i, k, code, counts[i:j].astype("<u4").tobytes(), places[order[lo:hi]].tobytes())
        for name, value in zip(rows, held, strict=True):
            rows[name].append(value)
    return rows


def _send(owners: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        schema = None

        def flush():
            block = np.concatenate(held)
            held.clear()
            rows = _lists(np.ascontiguousarray(block[:, 0]), np.ascontiguousarray(block[:, 1:]), owners)
            kinds = {"owner": pa.int32(), FILE: pa.int64(), ROW: pa.int64(), "n": pa.int32(), "k": pa.int32()}
            return pa.record_batch({c: pa.array(v, kinds.get(c, pa.binary())) for c, v in rows.items()})

        for batch in batches:
            if batch.num_rows:
                held.append(np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in ("h", FILE, ROW)], axis=1))
            if sum(map(len, held)) >= SENT:
                yield flush()
        if held:
            yield flush()

    return run


def _answer(lists: pa.Table) -> pa.Table:
    """An owner's reply: for every list, a bit for each fingerprint that other rows share."""
    n, k, code, counts = (lists.column(c).to_pylist() for c in ("n", "k", "code", "counts"))
    names = np.concatenate([golomb.decode(*x) for x in zip(n, k, code, strict=True)])
    rows = np.concatenate([np.frombuffer(x, "<u4") for x in counts])
    _, at, lists_with = np.unique(names, return_inverse=True, return_counts=True)
    shared = (lists_with[at] > 1) | (rows > 1)
    bits, start = [], 0
    for size in n:
        bits.append(np.packbits(shared[start : start + size]).tobytes())
        start += size
    return pa.table({c: lists.column(c) for c in ("owner", FILE, ROW)} | {"bits": pa.array(bits, pa.binary())})


def _unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows behind the fingerprints whose bit is set."""
    for batch in batches:
        for x in batch.to_pylist():
            counts = np.frombuffer(x["counts"], "<u4")
            bits = np.unpackbits(np.frombuffer(x["bits"], np.uint8))[: x["n"]].astype(bool)
            places = np.frombuffer(x["places"], np.int64).reshape(-1, 2)[np.repeat(bits, counts)]
            yield pa.record_batch({FILE: places[:, 0].copy(), ROW: places[:, 1].copy()})


def suspects(marks: DataFrame) -> DataFrame:
    """Rows ``(FILE, ROW)`` of ``marks(FILE, ROW, h)`` whose fingerprint another row has too.

    Every partition sends each owner of a hash range its sorted distinct fingerprints, so a
    text that fills a third of the table reaches its owner once per sender. The owner
    returns a bitmap per list; what a sender needs to read it stays in the shared folder.
    """
    owners = max(1, -(-marks.count() // OWNED))
    sent = stage(marks.select("h", FILE, ROW).mapInArrow(_send(owners), SENT_SCHEMA), "lists")
    answers = (
        sent.select("owner", FILE, ROW, "n", "k", "code", "counts")
        .groupBy("owner")
        .applyInArrow(_answer, f"owner int, {FILE} long, {ROW} long, bits binary")
    )
    joined = sent.select("owner", FILE, ROW, "n", "counts", "places").join(answers, ["owner", FILE, ROW])
    return joined.mapInArrow(_unpack, f"{FILE} long, {ROW} long")


def exact_dedup(docs: DataFrame) -> DataFrame:
    """One row per document with its class of texts equal up to runs of blanks.

    Columns: doc_id, keep_id, group_size, kept, text_sha256, and ``FILE``, ``ROW`` naming the row.
    The row with the smallest doc_id stays; among repeated rows with that doc_id, one of them.
    Null doc_id sorts last, null text is empty, empty texts are a class like any other, and an
    empty table gives none. Other columns of ``docs`` are not read.

    Texts move only for suspects of the fingerprint exchange. They are grouped by their
    bytes, so a chance hit of two fingerprints joins nothing.
    """
    rows = located(docs, "doc_id", "text")
    marks = stage(
        rows.select("doc_id", FILE, ROW, F.sha2(normalised(), 256).alias("text_sha256"), F.xxhash64(normalised()).alias("h")),
        "texts",
    )
    asked = marked_rows(rows, bitmaps(suspects(marks))).select("doc_id", FILE, ROW, normalised().alias("norm"))
    classes = (
        asked.groupBy(F.xxhash64("norm").alias("h"), "norm")
        .agg(
            F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", FILE, ROW)).alias("keeper"),
            F.count("*").alias("group_size"),
        )
        .select("h", F.sha2("norm", 256).alias("text_sha256"), "keeper", "group_size")
    )
    alone = F.col("keeper").isNull()
    return marks.join(classes, ["h", "text_sha256"], "left").select(
        "doc_id",
        F.when(alone, F.col("doc_id")).otherwise(F.col("keeper.doc_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).alias("group_size"),
        (alone | ((F.col(f"keeper.{FILE}") == F.col(FILE)) & (F.col(f"keeper.{ROW}") == F.col(ROW)))).alias("kept"),
        "text_sha256",
        FILE,
        ROW,
    )
