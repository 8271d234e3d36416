"""Ranking, fusing and comparing evidence records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.functions.scoring import evidence_header, evidence_score, location


def _col(df: DataFrame, name: str, default: Column) -> Column:
    return F.coalesce(F.col(name), default) if name in df.columns else default


def scored(records: DataFrame) -> DataFrame:
    return records.withColumn(
        "score", evidence_score(F.col("trust"), F.col("confidence"), F.col("stale"))
    )


def rank_key(records: DataFrame) -> Column:
    """Strongest first; ties fall back to the tier's text, then location, then id."""
    zero, blank = F.lit(0), F.lit("")
    return F.struct(
        (-F.col("score")).alias("neg"),
        F.col("trust"),
        _col(records, "path", blank).alias("path"),
        _col(records, "start_line", zero).alias("line"),
        _col(records, "start_column", zero).alias("col"),
        F.col("evidence_id"),
    )


def rank(records: DataFrame, limit: int) -> DataFrame:
    """The strongest ``limit`` records overall."""
    ranked = scored(records)
    return ranked.orderBy(rank_key(ranked)).limit(limit)


def rank_per(records: DataFrame, keys: list[str], limit: int) -> DataFrame:
    """The strongest ``limit`` records per key; the bound limits rows before the shuffle."""
    ranked = scored(records)
    order = Window.partitionBy(*keys).orderBy(rank_key(ranked))
    return ranked.withColumn("position", F.row_number().over(order)).filter(F.col("position") <= limit)


def _identity(records: DataFrame) -> list[Column]:
    symbol = _col(records, "symbol", F.lit(""))
    target = _col(records, "target_symbol", F.lit(""))
    return [
        F.col("kind").alias("_i_kind"),
        _col(records, "path", F.lit("")).alias("_i_path"),
        F.coalesce(F.col("start_line").cast("string"), F.lit("None")).alias("_i_line"),
        F.coalesce(F.col("start_column").cast("string"), F.lit("None")).alias("_i_col"),
        F.when(symbol != "", symbol).otherwise(target).alias("_i_symbol"),
    ]


IDENTITY = ["_i_kind", "_i_path", "_i_line", "_i_col", "_i_symbol"]


def fuse(records: DataFrame) -> DataFrame:
    """Every record with the id of the strongest record at its location (``kept_id``).

    The rest of a location is listed as rows rather than as one array, and the strongest one
    is a ``min_by``, so a location that a third of the records share is combined map-side
    and its rows are joined in slices.
    """
    ranked = scored(records)
    keyed = ranked.select("*", *_identity(ranked))
    best = keyed.groupBy(*IDENTITY).agg(
        F.min_by(F.struct("evidence_id", "trust"), rank_key(ranked)).alias("_kept"),
        F.count("*").alias("records_at_location"),
    )
    return keyed.join(best, IDENTITY).select(
        *ranked.columns,
        F.col("_kept.evidence_id").alias("kept_id"),
        F.col("_kept.trust").alias("kept_trust"),
        "records_at_location",
    )


def deduplicate(records: DataFrame) -> DataFrame:
    """The strongest record per location with the number it superseded (no join back)."""
    ranked = scored(records)
    keyed = ranked.select("*", *_identity(ranked))
    return (
        keyed.groupBy(*IDENTITY)
        .agg(
            F.min_by(F.struct(*ranked.columns), rank_key(ranked)).alias("r"),
            (F.count("*") - 1).alias("superseded"),
        )
        .select("r.*", "superseded")
    )


def conflicts(records: DataFrame) -> DataFrame:
    """Kept records whose location also holds a different tier."""
    ranked = scored(records)
    keyed = ranked.select("*", *_identity(ranked))
    return (
        keyed.groupBy(*IDENTITY)
        .agg(
            F.min_by(F.struct(*ranked.columns), rank_key(ranked)).alias("r"),
            (F.min("trust") != F.max("trust")).alias("_differs"),
            (F.count("*") - 1).alias("superseded"),
        )
        .filter("_differs")
        .select("r.*", "superseded")
    )


def merge_bundles(records: list[DataFrame], reports: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Union of several providers' records, deduplicated, and one degraded flag.

    ``reports`` has ``provider, state``; a provider that is not available, or only stale,
    degrades the bundle.
    """
    union = records[0]
    for part in records[1:]:
        union = union.unionByName(part, allowMissingColumns=True)
    degraded = reports.agg(
        F.coalesce(F.bool_or(F.col("state") != "available"), F.lit(False)).alias("degraded")
    )
    return deduplicate(union), degraded


def to_chunks(records: DataFrame) -> DataFrame:
    """Deduplicated evidence as context chunks: header line, body, score as relevance."""
    kept = deduplicate(records)
    place = location(F.col("path"), F.col("start_line"), F.col("start_column"))
    header = evidence_header(F.col("trust"), F.col("kind"), place, F.col("symbol"))
    body = F.trim("content")
    return kept.select(
        F.col("evidence_id").alias("chunk_id"),
        F.concat(F.lit("evidence:"), "provider").alias("source"),
        F.when(body != "", F.concat(header, F.lit("\n"), body)).otherwise(header).alias("content"),
        F.col("score").alias("relevance"),
        "path",
    )
