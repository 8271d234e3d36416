"""Sliding-window quotas over recorded calls."""

from __future__ import annotations

from collections import deque

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.operators.scans import SEGMENT_ROWS, prefix, segment_of
from loomgraph.session import durable


def admit(times, carried, limit: int, window: int) -> tuple[list[bool], list[int]]:
    """Decide calls in time order; ``carried`` holds earlier allowed times still in the window."""
    open_calls = deque(carried)
    allowed = []
    for now in times:
        while open_calls and open_calls[0] <= now - window:
            open_calls.popleft()
        allowed.append(len(open_calls) < limit)
        if allowed[-1]:
            open_calls.append(now)
    return allowed, list(open_calls)


def sliding_quota(
    calls: DataFrame, limit: int, window_micros: int, segment_rows: int = SEGMENT_ROWS
) -> DataFrame:
    """Allowed flag per call: fewer than ``limit`` *allowed* calls in the window before it.

    ``calls`` has ``principal, t, seq`` (microseconds, unique order). A pause longer than the
    window empties it, so bursts between pauses are independent. A burst longer than
    ``segment_rows`` is cut; a segment is decided again whenever the allowed calls handed
    over by its predecessor change, until nothing changes. Principals with short bursts are
    settled in the first round; no task ever holds more than one segment.
    """
    rows = calls.select("principal", "t", "seq").withColumn("_seg", segment_of(F.col("seq"), segment_rows))
    lagged = prefix(rows, ["principal"], ["seq"], "_seg", {"_prev": ("last", F.col("t"))}, inclusive=False)
    pause = (F.col("_prev").isNull() | (F.col("t") - F.col("_prev") > window_micros)).cast("long")
    bursts = prefix(lagged.withColumn("_pause", pause), ["principal"], ["seq"], "_seg", {"burst": ("sum", F.col("_pause"))})
    placed = prefix(bursts, ["principal", "burst"], ["seq"], "_seg", {"_n": ("sum", F.lit(1))})
    part = F.floor((F.col("_n") - 1) / segment_rows).cast("long")
    work = durable(placed.select("principal", "burst", part.alias("part"), "t", "seq"))
    unit = ["principal", "burst", "part"]

    def decide(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("seq")
        carried = pdf["carried"].iloc[0]
        allowed, left = admit(pdf["t"], [] if carried is None else carried, limit, window_micros)
        out = pdf[[*unit, "seq"]].assign(allowed=allowed, left=None)
        out.at[out.index[-1], "left"] = left
        return out

    schema = "principal string, burst long, part long, seq long, allowed boolean, left array<long>"

    def run(segments: DataFrame) -> DataFrame:
        return durable(work.join(segments, unit).groupBy(*unit).applyInPandas(decide, schema))

    used = durable(work.select(*unit).distinct().withColumn("carried", F.array().cast("array<long>")))
    decided = run(used)
    while True:
        handed = decided.filter("left is not null").select(
            "principal", "burst", (F.col("part") + 1).alias("part"), F.col("left").alias("handed")
        )
        stale = durable(
            used.join(handed, unit)
            .filter(~F.col("handed").eqNullSafe(F.col("carried")))
            .select(*unit, F.col("handed").alias("carried"))
        )
        if stale.isEmpty():
            break
        redone = run(stale)
        decided = durable(decided.join(stale.select(*unit), unit, "left_anti").unionByName(redone))
        used = durable(used.join(stale.select(*unit), unit, "left_anti").unionByName(stale))
    return calls.join(decided.select("principal", "seq", "allowed"), ["principal", "seq"])
