"""Mixing sources to target weights: whole copies, and one more by a hash-seeded draw."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.llm.common import WORD, filled, stage

#: Sources in code point order weigh these, repeating; the mix takes this share of all words.
WEIGHTS = (5, 2, 1)
SHARE = (3, 2)
MOST = 2


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: tuple[int, int] = SHARE, most: int = MOST) -> DataFrame:
    """``target`` words per source from ``sizes(source, source_size)``, one row per source.

    Sources ask in proportion to their weights for ``share`` (a fraction) of all words. A target
    stops at ``most`` times its source; the excess is shared by weight among the others until
    none is above. The capped sources are those with the smallest size per weight, so they are
    found in one running sum: a source is capped if, with all sources before it capped, its
    share of the rest would still exceed its cap. Whole numbers are kept up to the last division.

    The windows run over one row per source, aggregated before.
    """
    arms = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.pmod(F.col("n") - 1, F.lit(len(weights))) + 1).cast("int"))
    ranked = sizes.withColumn("n", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())))
    ranked = ranked.withColumn("weight", arms.cast("long"))
    before = Window.orderBy(F.col("source_size") / F.col("weight"), "n").rowsBetween(Window.unboundedPreceding, -1)
    everyone = Window.partitionBy()
    spent = ranked.select(
        "source",
        "source_size",
        "weight",
        F.sum("source_size").over(everyone).alias("total"),
        F.sum("weight").over(everyone).alias("weights"),
        F.coalesce(F.sum("source_size").over(before), F.lit(0)).alias("capped"),
        F.coalesce(F.sum("weight").over(before), F.lit(0)).alias("gone"),
    )
    up, down = share
    rest = F.lit(up) * F.col("total") - F.lit(most * down) * F.col("capped")
    over = F.col("weight") * rest > F.lit(most * down) * F.col("source_size") * (F.col("weights") - F.col("gone"))
    # From the first source that is not capped on, all share what the capped ones leave.
    open_ = F.when(~over, F.struct("gone", "capped"))
    marked = spent.withColumn("left", F.min(open_).over(everyone))
    target = (F.col("weight") * (F.lit(up) * F.col("total") - F.lit(most * down) * F.col("left.capped"))).cast("double") / (
        F.lit(down) * (F.col("weights") - F.col("left.gone"))
    ).cast("double")
    is_open = F.col("left").isNotNull() & (F.col("gone") >= F.col("left.gone"))
    return marked.select(
        "source",
        "source_size",
        F.when(is_open, target).otherwise((F.lit(most) * F.col("source_size")).cast("double")).alias("target"),
    )


def draw(seed: int) -> F.Column:
    """A number in [0, 1) that depends on doc_id and seed alone."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("long") / F.lit(float(1 << 52))


ADDED = ("size", "source_size", "target", "copies")


#: Bytes of targets, 32 a source besides its name, that are broadcast.
TARGET_BYTES = 8 << 20


def _planned(docs: DataFrame, seed: int, targets: dict) -> DataFrame:
    """``docs`` with the columns of ``ADDED``, their names behind two underscores."""
    sized = docs.withColumn("__size", F.regexp_count(filled("text"), F.lit(WORD)).cast("long"))
    totals = sized.groupBy("source").agg(F.sum("__size").alias("source_size"))
    plan = source_targets(totals, **targets)
    plan = stage(plan.select(*[F.col(c).alias(f"__{c}") for c in ("source", "source_size", "target")]), "targets")
    # Texts stay where they are while the targets are small.
    size = plan.agg(F.sum(F.coalesce(F.octet_length("__source"), F.lit(0)) + 32)).first()[0] or 0
    if size <= TARGET_BYTES:
        plan = F.broadcast(plan)
    joined = sized.join(plan, sized["source"].eqNullSafe(F.col("__source")), "left").drop("__source")
    rate = F.when(F.col("__source_size") > 0, F.col("__target") / F.col("__source_size")).otherwise(F.lit(0.0))
    whole = F.floor(rate)
    return joined.withColumn("__copies", whole + F.when(draw(seed) < rate - whole, 1).otherwise(0))


def mix(docs: DataFrame, seed: int = 7, **targets) -> DataFrame:
    """``docs`` with size, source_size, target and copies: how often the mix takes each document.

    A document is taken floor(rate) times, rate being target over size of its source, and once
    more if its draw falls below the fraction; so none is taken more than ``MOST`` times, its
    source's words come near the target, and reruns agree. Null and empty texts have size 0; a
    source without words has target 0 and rate 0. Null sources form one source, the last. A very
    long text is counted in place. Targets come from one running sum over the sources, one row each.
    Repeated rows draw alike; an empty table gives none. Columns of ``docs`` with the added
    names are replaced. Sizes are summed on the map side; a source with a third of all rows
    meets its one target row by broadcast; above ``TARGET_BYTES`` of them, in a join that Spark splits.
    """
    planned = _planned(docs, seed, targets).drop(*ADDED)
    return planned.withColumnsRenamed({f"__{c}": c for c in ADDED})


def emit(docs: DataFrame, seed: int = 7, **targets) -> DataFrame:
    """Every row of ``docs``, with its own columns, as often as the mix takes it."""
    planned = _planned(docs, seed, targets).where("__copies > 0")
    return planned.withColumn("__copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("__copies")))).select(*docs.columns)
