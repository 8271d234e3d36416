"""Order-dependent building blocks that never hold one key's rows in a single task.

A plain ``Window.partitionBy(key).orderBy(...)`` sorts a whole key in one task. When one key
holds a third of the table that task never ends. Everything here cuts a key into segments of
bounded size, works inside segments, then combines the small per-segment results.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.session import durable, large, release

SEGMENT_ROWS = 1 << 16
DYADIC_BITS = 20


#: Spark limits ``row_number`` groups inside input tasks up to this bound on its own.
GROUP_LIMIT = 1000
SALTS = 256


def top_per(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], k: int) -> DataFrame:
    """First ``k`` rows per key.

    A small bound is applied before the shuffle by the optimizer. For a larger one every key
    is first cut into salted parts that are limited on their own, so no task sorts a whole
    hot key.
    """
    rows = df
    if k > GROUP_LIMIT:
        salt = F.pmod(F.xxhash64(*df.columns), F.lit(SALTS))
        part = Window.partitionBy(*keys, "_salt").orderBy(*order)
        rows = (
            df.withColumn("_salt", salt)
            .withColumn("_rn", F.row_number().over(part))
            .filter(F.col("_rn") <= k)
            .drop("_salt", "_rn")
        )
    whole = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("_rn", F.row_number().over(whole)).filter(F.col("_rn") <= k).drop("_rn")


def segment_of(order: Column, size: int = SEGMENT_ROWS) -> Column:
    """Segment number of a unique integer position: at most ``size`` rows share one."""
    return F.floor(order / F.lit(size)).cast("long")


def prefix(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column | str],
    segment: str,
    aggregates: dict[str, tuple[str, Column]],
    *,
    inclusive: bool = True,
) -> DataFrame:
    """Running aggregates per key over ``order``, computed in two levels.

    ``segment`` must be monotone in ``order``. ``aggregates`` maps an output name to
    ``(kind, expression)`` with kind ``sum``, ``max`` or ``last`` (last non-null value).
    Rows equal in ``order`` are separated arbitrarily, so pass a unique order.
    """
    keys = list(keys)
    end = 0 if inclusive else -1
    inside = (
        Window.partitionBy(*keys, segment).orderBy(*order).rowsBetween(Window.unboundedPreceding, end)
    )
    before = (
        Window.partitionBy(*keys).orderBy(segment).rowsBetween(Window.unboundedPreceding, -1)
    )

    def running(kind: str, value: Column, window) -> Column:
        if kind == "sum":
            return F.sum(value).over(window)
        if kind == "max":
            return F.max(value).over(window)
        return F.last(value, ignorenulls=True).over(window)

    staged = df.select("*", *[value.alias(f"_in_{name}") for name, (_, value) in aggregates.items()])
    totals = []
    for name, (kind, _) in aggregates.items():
        value = F.col(f"_in_{name}")
        if kind == "sum":
            totals.append(F.sum(value).alias(f"_seg_{name}"))
        elif kind == "max":
            totals.append(F.max(value).alias(f"_seg_{name}"))
        else:
            position = F.struct(*[F.col(c) if isinstance(c, str) else c for c in order])
            totals.append(
                F.max_by(value, F.when(value.isNotNull(), position)).alias(f"_seg_{name}")
            )
    carried = (
        staged.groupBy(*keys, segment)
        .agg(*totals)
        .select(
            *[F.col(k).alias(f"_k_{k}") for k in keys],
            F.col(segment).alias("_k_segment"),
            *[
                running(kind, F.col(f"_seg_{name}"), before).alias(f"_carry_{name}")
                for name, (kind, _) in aggregates.items()
            ],
        )
    )
    match = F.col(segment) == F.col("_k_segment")
    for k in keys:
        match = match & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    joined = staged.select(
        "*",
        *[
            running(kind, F.col(f"_in_{name}"), inside).alias(f"_run_{name}")
            for name, (kind, _) in aggregates.items()
        ],
    ).join(large(carried), match, "left")
    outputs = []
    for name, (kind, _) in aggregates.items():
        run, carry = F.col(f"_run_{name}"), F.col(f"_carry_{name}")
        if kind == "sum":
            both = F.coalesce(run, F.lit(0)) + F.coalesce(carry, F.lit(0))
            value = F.when(run.isNull() & carry.isNull(), None).otherwise(both)
        elif kind == "max":
            value = F.greatest(run, carry)
        else:
            value = F.coalesce(run, carry)
        outputs.append(value.alias(name))
    return joined.select(*df.columns, *outputs)


def ordinal(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], segment: str, name: str
) -> DataFrame:
    """``row_number`` per key without sorting a whole key in one task."""
    return prefix(df, keys, order, segment, {name: ("sum", F.lit(1))})


def asof(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    left_position: str,
    right_position: str,
    payload: Column,
    output: str,
    *,
    prefer: Column | None = None,
    segment_size: int = 1024,
) -> DataFrame:
    """Latest right row at or before each left position, per key.

    Both sides are reduced to one row per (key, position), interleaved and scanned, so the
    cost is linear: no left row ever meets more than one candidate. ``prefer`` picks among
    right rows at one position (largest wins).
    """
    keys = list(keys)
    tie = F.lit(0) if prefer is None else prefer
    best = right.groupBy(*keys, F.col(right_position).alias("_pos")).agg(
        F.max_by(payload, F.struct(tie)).alias("_value")
    )
    wanted = left.select(*keys, F.col(left_position).alias("_pos")).distinct()
    both = best.select(*keys, "_pos", F.lit(0).alias("_side"), "_value").unionByName(
        wanted.select(*keys, "_pos", F.lit(1).alias("_side"), F.lit(None).alias("_value"))
    )
    both = both.withColumn("_segment", segment_of(F.col("_pos"), segment_size))
    scanned = prefix(both, keys, ["_pos", "_side"], "_segment", {output: ("last", F.col("_value"))})
    found = scanned.filter("_side = 1").select(
        *[F.col(k).alias(f"_f_{k}") for k in keys], F.col("_pos").alias("_f_pos"), output
    )
    match = F.col(left_position) == F.col("_f_pos")
    for k in keys:
        match = match & F.col(k).eqNullSafe(F.col(f"_f_{k}"))
    return left.join(found, match, "left").select(*left.columns, output)


def _block_size(level: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), level.cast("int"))


def dyadic_cover(start: Column, end: Column, bits: int = DYADIC_BITS) -> Column:
    """Dyadic blocks whose disjoint union is the closed interval ``[start, end]``.

    Each block is ``(level, block)`` and spans ``2**level`` positions. An interval needs at
    most two blocks per level; the top level lists all of its blocks, so any span is exact.
    """

    def per_level(level: Column) -> Column:
        size = _block_size(level)
        low = F.ceil(start.cast("double") / size).cast("long")
        high = F.floor((end.cast("long") + 1).cast("double") / size).cast("long")
        after = low + (low % 2)
        first = F.when((low % 2 == 1) & (low < high), low)
        last = F.when((high % 2 == 1) & (after < high), high - 1)
        top = F.when(low < high, F.sequence(low, high - 1)).otherwise(
            F.array().cast("array<bigint>")
        )
        blocks = F.when(level == bits, top).otherwise(F.array(first, last))
        return F.transform(
            F.filter(blocks, lambda b: b.isNotNull()),
            lambda b: F.struct(level.cast("int").alias("level"), b.alias("block")),
        )

    return F.flatten(F.transform(F.sequence(F.lit(0), F.lit(bits)), per_level))


def dyadic_path(position: Column, bits: int = DYADIC_BITS) -> Column:
    """The block of every level that contains a position."""
    return F.transform(
        F.sequence(F.lit(0), F.lit(bits)),
        lambda level: F.struct(
            level.cast("int").alias("level"),
            F.floor(position.cast("double") / _block_size(level)).cast("long").alias("block"),
        ),
    )


def stab(
    points: DataFrame,
    intervals: DataFrame,
    keys: Sequence[str],
    position: str,
    start: str,
    end: str,
    best: Column,
    output: str,
    bits: int = DYADIC_BITS,
) -> DataFrame:
    """Best interval covering each position, per key (``max`` over the ``best`` struct).

    Intervals are broken into dyadic blocks and only the best of a block is kept before the
    join, so nested or repeated intervals never multiply: every (position, level) meets at
    most one row.
    """
    keys = list(keys)
    blocks = (
        intervals.filter(F.col(start) <= F.col(end))
        .select(*keys, best.alias("_best"), F.explode(dyadic_cover(F.col(start), F.col(end), bits)).alias("_b"))
        .groupBy(*keys, F.col("_b.level").alias("_level"), F.col("_b.block").alias("_block"))
        .agg(F.max("_best").alias("_best"))
    )
    wanted = points.select(*keys, F.col(position).alias("_pos")).distinct()
    hits = (
        wanted.select("*", F.explode(dyadic_path(F.col("_pos"), bits)).alias("_b"))
        .select(*keys, "_pos", F.col("_b.level").alias("_level"), F.col("_b.block").alias("_block"))
        .join(blocks, [*keys, "_level", "_block"])
        .groupBy(*keys, "_pos")
        .agg(F.max("_best").alias(output))
        .select(*[F.col(k).alias(f"_f_{k}") for k in keys], F.col("_pos").alias("_f_pos"), output)
    )
    match = F.col(position) == F.col("_f_pos")
    for k in keys:
        match = match & (F.col(k) == F.col(f"_f_{k}"))
    return points.join(hits, match, "left").select(*points.columns, output)


def overlapping(
    intervals: DataFrame,
    ranges: DataFrame,
    keys: Sequence[str],
    start: str,
    end: str,
    range_start: str,
    range_end: str,
) -> DataFrame:
    """Intervals that overlap at least one range of their key, without forming pairs.

    An interval overlaps some range exactly when, among the ranges that start at or before
    its end, the furthest end reaches its start: a running maximum plus one lookup.
    """
    keys = list(keys)
    furthest = (
        ranges.groupBy(*keys, F.col(range_start).alias("_rs"))
        .agg(F.max(range_end).alias("_re"))
        .withColumn("_segment", segment_of(F.col("_rs"), 1024))
    )
    reach = prefix(furthest, keys, ["_rs"], "_segment", {"_reach": ("max", F.col("_re"))})
    tagged = asof(intervals, reach, keys, end, "_rs", F.col("_reach"), "_reach_at_end")
    return tagged.filter(F.col("_reach_at_end") >= F.col(start)).select(*intervals.columns)


def greedy_keep(nodes: DataFrame, conflicts: DataFrame, identity: str = "id") -> DataFrame:
    """Nodes a front-to-back scan keeps when it drops whatever conflicts with a kept node.

    ``conflicts`` holds ``(earlier, later)`` pairs. Each round keeps every node left without
    an earlier neighbour and drops the neighbours of those; dropped nodes stop counting. The
    loop always advances, and needs as many rounds as the longest chain of decisions that
    depend on each other, not one per node.
    """
    open_pairs = durable(conflicts.select("earlier", "later").distinct())
    dropped_parts: list[DataFrame] = []
    while not open_pairs.isEmpty():
        free = (
            open_pairs.select("earlier")
            .distinct()
            .join(open_pairs.select(F.col("later").alias("earlier")).distinct(), "earlier", "left_anti")
        )
        dropped = durable(open_pairs.join(free, "earlier", "left_semi").select("later").distinct())
        dropped_parts.append(dropped)
        before, open_pairs = open_pairs, durable(
            open_pairs.join(dropped, "later", "left_anti").join(
                dropped.withColumnRenamed("later", "earlier"), "earlier", "left_anti"
            )
        )
        release(before)
    release(open_pairs)
    if not dropped_parts:
        return nodes
    dropped = reduce(DataFrame.unionByName, dropped_parts).withColumnRenamed("later", identity)
    return nodes.join(dropped, identity, "left_anti")
