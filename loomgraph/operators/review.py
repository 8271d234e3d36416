"""Pull-request review: changed symbols, their impact, affected tests and risk."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.operators.graph import NON_SYMBOL_KINDS, impact, impact_report
from loomgraph.operators.history import changed_symbols, pr_risk, symbol_ranges
from loomgraph.session import durable, large


def review(
    changes: DataFrame, hunks: DataFrame, nodes: DataFrame, edges: DataFrame, totals: DataFrame
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``(report, symbols, tests)`` for every change set.

    ``changes``: ``pr, repo, path, additions, deletions``; ``hunks``: ``pr, repo, path, start,
    end``; ``totals``: ``repo, path, lines``. Symbols are looked up by id, so two symbols of
    one name do not share an impact. Impact runs once per distinct changed symbol, for all
    change sets together.
    """
    symbols = nodes.filter(~F.col("kind").isin(*NON_SYMBOL_KINDS) & F.col("path").isNotNull() & F.col("line").isNotNull())
    ranged = symbol_ranges(symbols, totals).select("repo", "path", "id", "name", "line", "end")
    per_change = large(ranged).join(changes.select("pr", "repo", "path").distinct(), ["repo", "path"])
    touched = large(durable(changed_symbols(per_change, changes, hunks, ["pr", "repo", "path"])))
    scoped = F.concat_ws("\u0000", "repo", "id")
    graph_nodes = large(nodes.withColumn("id", scoped))
    graph_edges = large(edges.withColumns(
        {c: F.concat_ws("\u0000", "repo", c) for c in ("source", "target")}
    ))
    keyed = touched.withColumn("id", scoped)
    items = large(durable(impact(graph_nodes, graph_edges, keyed.select("id").distinct())))
    scores = impact_report(items).select(
        F.col("target").alias("id"),
        F.col("risk_score").alias("impact_risk"),
        (F.col("direct") + F.col("indirect")).alias("affected_nodes"),
        F.col("tests").alias("affected_tests"),
    )
    scored = keyed.join(scores, "id", "left").na.fill(0, ["impact_risk", "affected_nodes", "affected_tests"])
    tests = (
        keyed.select("pr", F.col("id").alias("target"))
        .join(items.filter("is_test").select("target", F.coalesce("path", "name").alias("test")), "target")
        .select("pr", "test")
        .distinct()
    )
    return pr_risk(changes, scored, ["pr"]), scored, tests
