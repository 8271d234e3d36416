"""Route requests to capabilities: one row per (request, capability)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.functions import routing


def route(requests: DataFrame, keys: list[str], feedback: DataFrame | None = None) -> DataFrame:
    """Scores, reasons and the selected flag for each capability of each request.

    ``requests`` has ``keys`` and ``query`` (and may carry ``kind``). ``feedback`` has
    ``capability, adjustment`` with at most one row per capability: five rows, joined as a
    literal-size table.
    """
    kind = F.col("kind") if "kind" in requests.columns else routing.classify(F.col("query"))
    scored = requests.select(*keys, "query", kind.alias("kind")).select(
        *keys,
        "kind",
        F.explode(routing.capability_scores(F.col("query"), F.col("kind"))).alias("capability", "base"),
    )
    if feedback is not None:
        known = feedback.filter(F.col("capability").isin(*routing.CAPABILITIES))
        scored = scored.join(known.select("capability", "adjustment"), "capability", "left")
    else:
        scored = scored.withColumn("adjustment", F.lit(0.0))
    total = F.col("base") + F.coalesce("adjustment", F.lit(0.0))
    # 1e-9 keeps sums such as 0.05 + 0.45 from landing just under the threshold.
    clamped = F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), total)), 9)
    rows = scored.select(*keys, "kind", "capability", clamped.alias("score"))
    chosen = F.col("score") >= routing.SELECT_THRESHOLD
    any_chosen = rows.groupBy(*keys).agg(F.max(chosen).alias("_any"))
    return rows.join(any_chosen, keys).select(
        *keys,
        "kind",
        "capability",
        "score",
        F.when(F.col("_any"), chosen).otherwise(F.col("capability") == "repository").alias("selected"),
        F.concat("capability", F.lit(" is relevant to a "), "kind", F.lit(" request")).alias("reason"),
    )
