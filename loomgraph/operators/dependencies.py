"""Dependency inventories: merge, lookup and version choice."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.functions.scoring import lookup
from loomgraph.functions.text import normalize_version, strip

# Narrowest scope first.
SCOPE_ORDER = {"runtime": 0, "build": 1, "optional": 2, "development": 3}


def _present(value: Column) -> Column:
    return F.when(value != "", value)


def merge_inventory(records: DataFrame) -> DataFrame:
    """One row per (repo, ecosystem, lower name): first declared and first resolved version.

    ``ordinal`` gives the scan order. All picks are ``min_by`` aggregates, so a dependency
    that every repository declares is combined map-side before the shuffle.
    """
    order = F.col("ordinal")

    def first(value: Column) -> Column:
        present = _present(value)
        return F.min_by(present, F.when(present.isNotNull(), order))

    declared = _present(F.col("declared"))
    declaring = F.min_by(F.col("manifest"), F.when(declared.isNotNull(), order))
    scope = F.min(lookup(SCOPE_ORDER, F.col("scope"), 9))
    merged = records.groupBy("repo", "ecosystem", F.lower("name").alias("key")).agg(
        F.min_by("name", order).alias("name"),
        first(F.col("declared")).alias("declared"),
        first(F.col("resolved")).alias("resolved"),
        F.coalesce(declaring, F.max_by("manifest", order)).alias("manifest"),
        first(F.col("lock_source")).alias("lock_source"),
        scope.alias("_scope"),
    )
    names = {str(rank): name for name, rank in SCOPE_ORDER.items()}
    return merged.withColumn("scope", lookup(names, F.col("_scope").cast("string"))).drop(
        "key", "_scope"
    )


def find_dependency(inventory: DataFrame, name: str) -> DataFrame:
    """Exact name matches if there are any, else names that contain the text."""
    needle = name.strip().lower()
    low = F.lower("name")
    if not needle:
        return inventory.limit(0)
    hits = inventory.filter(F.contains(low, F.lit(needle))).withColumn("_exact", low == needle)
    exact = hits.agg(F.coalesce(F.max("_exact"), F.lit(False))).scalar()
    return hits.withColumn("_any", exact).filter(F.col("_exact") | ~F.col("_any")).drop("_exact", "_any")


def dependency_for(inventory: DataFrame, names: DataFrame) -> DataFrame:
    """The entry each requested name documents: exact match, then resolved, then name order."""
    wanted = names.select(F.col("name").alias("requested"), F.lower(strip(F.col("name"))).alias("_k"))
    exact = inventory.withColumn("_k", F.lower("name")).groupBy("_k").agg(
        F.min_by(
            F.struct("ecosystem", "name", "declared", "resolved"),
            F.struct(F.col("resolved").isNull(), "name", "ecosystem"),
        ).alias("hit")
    )
    return wanted.join(exact, "_k", "left").select("requested", "hit.*")


def select_versions(requests: DataFrame, available: DataFrame) -> DataFrame:
    """Match each request to a published version label of its library.

    ``requests``: ``library, requested`` plus any columns. ``available``: ``library,
    version, ordinal``. Three equi-joins on pre-aggregated keys; nothing is ranked per
    library, so a library with very many labels stays spread over tasks.
    """
    wanted = requests.withColumn("_want", F.when(strip(F.col("requested")) != "", strip(F.col("requested"))))
    wanted = wanted.withColumn("_norm", normalize_version(F.col("_want")))
    exact = available.select("library", F.col("version").alias("_want"), F.lit(True).alias("_exact")).distinct()
    normal = available.groupBy("library", normalize_version(F.col("version")).alias("_norm")).agg(
        F.min_by("version", "ordinal").alias("_label")
    )
    listed = available.select("library", F.lit(True).alias("_listed")).distinct()
    joined = (
        wanted.join(exact, ["library", "_want"], "left")
        .join(normal, ["library", "_norm"], "left")
        .join(listed, "library", "left")
    )
    match = (
        F.when(F.col("_want").isNull(), "unversioned")
        .when(F.col("_exact"), "exact")
        .when(F.col("_label").isNotNull(), "normalized")
        .when(F.col("_listed").isNull(), "unmatched")
        .otherwise("fallback")
    )
    label = F.when(F.col("_exact"), F.col("_want")).otherwise(F.col("_label"))
    return joined.select(
        *requests.columns,
        match.alias("match"),
        F.when(F.col("_want").isNotNull(), label).alias("provider_version"),
        match.isin("exact", "normalized").alias("exact_version"),
    )
