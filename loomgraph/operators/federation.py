"""Many repositories as one graph: shared symbols and cross-repository dependencies."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.functions.text import normalize_dependency, path_aliases

SYMBOL_CONFIDENCE = 0.85
ALIAS_CONFIDENCE = 0.92
SUFFIX_CONFIDENCE = 0.76
#: Kind of the nodes that stand for a shared name, and the start of their ids.
HUB = "hub"


def node_id(repo, identity):
    return F.concat(F.lit("repo:"), repo, F.lit(":"), identity)


def namespaced(nodes: DataFrame) -> DataFrame:
    return nodes.withColumn("id", node_id(F.col("repo"), F.col("id")))


def namespaced_edges(edges: DataFrame) -> DataFrame:
    return edges.withColumns(
        {c: node_id(F.col("repo"), F.col(c)) for c in ("source", "target")}
    )


def symbol_groups(nodes: DataFrame) -> DataFrame:
    """Symbols whose (kind, lower name) occurs in several repositories, with partner counts.

    ``partners`` is the number of pair links a symbol takes part in, from two counts; no
    pairs are formed. ``nodes`` ids are already namespaced.
    """
    symbols = nodes.filter(~F.col("kind").isin("file", "module", "reference")).select(
        "repo", "id", "kind", F.lower("name").alias("name")
    )
    per_repo = symbols.groupBy("kind", "name", "repo").agg(F.count("*").alias("own"))
    totals = per_repo.groupBy("kind", "name").agg(
        F.sum("own").alias("members"), F.count("*").alias("repos")
    )
    shared = totals.filter("repos > 1")
    return (
        symbols.join(shared, ["kind", "name"])
        .join(per_repo, ["kind", "name", "repo"])
        .select("repo", "id", "kind", "name", "members", "repos", (F.col("members") - F.col("own")).alias("partners"))
    )


def symbol_links(groups: DataFrame) -> DataFrame:
    """Edges from every shared symbol to the hub of its (kind, name), at confidence 0.85.

    A hub stands for a link between each two of its members from different repositories, so
    the edges grow with the symbols, whatever the size of a group. ``graph.impact`` and
    ``graph.neighbourhood`` walk through hubs; ``symbol_partners`` lists pairs of chosen symbols.
    """
    return groups.select(
        F.col("id").alias("source"),
        F.concat(F.lit(f"{HUB}:symbol:"), "kind", F.lit(":"), "name").alias("target"),
        F.lit("cross_repo_symbol").alias("kind"),
        F.lit(SYMBOL_CONFIDENCE).alias("confidence"),
        F.col("repo").alias("repository"),
    )


def symbol_partners(groups: DataFrame, ids: DataFrame) -> DataFrame:
    """The pair links of a few chosen symbols, whatever the size of their groups."""
    chosen = groups.join(ids.select("id"), "id", "left_semi").select(
        "kind", "name", F.col("repo").alias("_r"), F.col("id").alias("source")
    )
    return chosen.join(groups.select("kind", "name", "repo", "id"), ["kind", "name"]).filter(
        F.col("_r") != F.col("repo")
    ).select("source", F.col("id").alias("target"))


def _suffixes(alias):
    """Every tail of an alias that starts right after a slash or a dot."""
    places = F.filter(
        F.sequence(F.lit(1), F.length(alias)), lambda i: F.substring(alias, i, F.lit(1)).isin("/", ".")
    )
    return F.array_distinct(F.transform(places, lambda i: alias.substr(i + 1, F.length(alias))))


def _linked(asks: DataFrame, offers: DataFrame, confidence: float) -> DataFrame:
    """Edges from asks to the hub of their key and from there to what offers it.

    A row is left out if the other side has its own repository only. That is known from the
    first and last repository of each side, so no key is expanded into pairs.
    """
    hub = F.concat(F.lit(f"{HUB}:path:{confidence}:"), "key")

    def other_side(rows: DataFrame, repo: str) -> DataFrame:
        return rows.groupBy("key").agg(F.min(repo).alias("_first"), F.max(repo).alias("_last"))

    def elsewhere(repo: str):
        return (F.col("_first") != F.col(repo)) | (F.col("_last") != F.col(repo))

    into = asks.join(other_side(offers, "target_repo"), "key").filter(elsewhere("source_repo"))
    out = offers.join(other_side(asks, "source_repo"), "key").filter(elsewhere("target_repo"))
    kind, sure = F.lit("cross_repo_dependency").alias("kind"), F.lit(confidence).alias("confidence")
    return into.select("source", hub.alias("target"), kind, sure, "dependency", F.col("source_repo").alias("repository")).unionByName(
        out.select(hub.alias("source"), "target", kind, sure, F.col("key").alias("dependency"), F.col("target_repo").alias("repository"))
    )


def dependency_links(nodes: DataFrame) -> DataFrame:
    """Unresolved names linked to files of other repositories, through a hub for each alias.

    An alias equal to the normalised name scores 0.92. Only names no file answers that way
    are matched against alias tails (0.76). Tails are exploded so both steps are equi-joins.
    ``nodes`` ids are already namespaced.
    """
    files = nodes.filter("kind = 'file' and path is not null and path <> ''").select(
        F.col("repo").alias("target_repo"), F.col("id").alias("target"), F.explode(path_aliases(F.col("path"))).alias("key")
    )
    asks = nodes.filter(F.col("kind").isin("module", "reference")).select(
        F.col("repo").alias("source_repo"),
        F.col("id").alias("source"),
        F.col("name").alias("dependency"),
        normalize_dependency(F.col("name")).alias("key"),
    )
    known = files.select("key").distinct()
    exact = _linked(asks, files, ALIAS_CONFIDENCE)
    tails = files.select("target_repo", "target", F.explode(_suffixes(F.col("key"))).alias("key")).distinct()
    loose = _linked(asks.join(known, "key", "left_anti"), tails, SUFFIX_CONFIDENCE)
    return exact.unionByName(loose)


def federate(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """One graph over all repositories: namespaced ids, links across them, and the hubs as nodes."""
    inside = namespaced(nodes)
    own = namespaced_edges(edges).select("source", "target", "kind")
    links = symbol_links(symbol_groups(inside)).select("source", "target", "kind")
    imports = dependency_links(inside).select("source", "target", "kind")
    across = links.unionByName(imports)
    ends = across.select(F.explode(F.array("source", "target")).alias("id")).filter(F.col("id").startswith(f"{HUB}:")).distinct()
    hubs = ends.withColumns({"kind": F.lit(HUB), "name": F.regexp_extract("id", r"^hub:[^:]*:[^:]*:(?s:(.*))$", 1)})
    everything = own.unionByName(across).filter("source <> target").dropDuplicates(["source", "target", "kind"])
    return inside.unionByName(hubs, allowMissingColumns=True), everything
